"""Near-duplicates, top-k, link graph and language model against brute force."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from tests.llm.helpers import no_docs, odd_docs
from tests.oracle import compare, connect
from tidemark.llm import lm, neardup, topk, urls
from tidemark.llm.common import table


def word_sets(rows):
    out = {}
    for i, text in rows:
        w = (text or "").encode().lower().split()
        out[i] = frozenset(zip(*(w[k:] for k in range(5)))) if len(w) >= 5 else frozenset([tuple(w)]) if w else frozenset()
    return out


def slow_components(sets, percent=75):
    ids = sorted(sets)
    top = {i: i for i in ids}

    def find(a):
        while top[a] != a:
            a = top[a]
        return a

    for x, i in enumerate(ids):
        for j in ids[:x]:
            a, b = sets[i], sets[j]
            if a and b and 100 * min(len(a), len(b)) >= percent * max(len(a), len(b)):
                both = len(a & b)
                if 100 * both >= percent * (len(a) + len(b) - both):
                    p, q = sorted((find(i), find(j)))
                    top[q] = p
    return {i: find(i) for i in ids}


def check_components(spark, docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    sets = word_sets(rows)
    want = slow_components(sets)
    got = neardup.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["n_shingles"] == len(sets[r["doc_id"]]) and r["component_id"] == want[r["doc_id"]] and r["kept"] == (r["doc_id"] == want[r["doc_id"]])
    return want


def test_op7_on_data(spark, data):
    check_components(spark, table(spark, data, "documents"))


def test_op7_group_of_near_copies(spark):
    """Chains through documents that are no hub, and many that just miss."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(150)]
    rows = [(0, " ".join(base))]
    for i in range(1, 220):
        own = list(base)
        for at in rng.sample(range(150), rng.choice([1, 2, 3, 4, 5, 6])):
            own[at] = f"n{rng.randint(0, 10**6)}"
        rows.append((i, " ".join(own)))
    rows += [(300 + i, " ".join(base[:60] + [f"p{i}_{k}" for k in range(60)])) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = check_components(spark, docs)
    assert 1 < len(set(want.values())) < len(rows)


def test_op7_odd(spark):
    got = {r["doc_id"]: r for r in neardup.near_duplicates(odd_docs(spark)).collect()}
    assert got[7]["component_id"] == 7 and got[8]["component_id"] == 7 and not got[8]["kept"]
    assert got[2]["n_shingles"] == 0 and got[2]["kept"] and got[3]["component_id"] == 3
    kept = neardup.drop_near_duplicates(odd_docs(spark))
    assert kept.columns == odd_docs(spark).columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 3, 4, 5, 6, 7, 9]
    assert neardup.near_duplicates(no_docs(spark)).count() == 0


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 102), (5, 5)], "u long, v long")
    got = {r["node"]: r["component"] for r in neardup.connected_components(edges).collect()}
    assert all(got[i] == 0 for i in range(61)) and got[102] == 100 and len(got) == 64


def test_op6_on_data(spark, data):
    assert compare(spark, connect(data), topk.op6_exact_topk, topk.ORACLE_SQL, data) == ""


def test_op6_ties_and_bad_vectors(spark):
    rng = random.Random(1)
    rows = [(i, [rng.choice([0.0, 1.0, 0.5, -1.0]) for _ in range(3)]) for i in range(400)]
    rows += [(401, None), (402, [1.0, None, 2.0]), (403, [float("nan"), 1.0, 1.0]), (404, []), (405, [float("inf"), 0.0, 0.0]), (7, rows[7][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as score", "2 as rank")
    got = {}
    for r in topk.top_k(df, df.filter("vec_id % 50 = 0")).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    whole = {i: [math.floor(256 * x) for x in v] for i, v in rows if i < 400}
    assert set(got) == {i for i in whole if i % 50 == 0}
    for q, own in got.items():
        want = sorted(((-sum(a * b for a, b in zip(whole[q], v)), i) for i, v in whole.items() if i != q))[:5]
        assert [(i, s) for _, i, s in sorted(own)] == [(i, -s) for s, i in want]
    assert topk.top_k(df.filter("false"), df.filter("false")).count() == 0


def test_threshold_walk_stops_early():
    rng = np.random.default_rng(0)
    x = np.floor(256 * rng.normal(0, 1, (4000, 3)))
    block = topk.Block(np.arange(4000), x)
    for q in np.floor(256 * rng.normal(0, 1, (20, 3))):
        ids, scores, read = block.search(q, -1, 5)
        want = np.lexsort((np.arange(4000), -(x @ q)))[:5]
        assert ids.tolist() == want.tolist() and read < 2000
        again, _, fewer = block.search(q, -1, 5, float(scores[-1]))
        assert again.tolist() == want.tolist() and fewer <= read
        none, _, least = block.search(q, -1, 5, float(scores[0]) * 4 + 1e9)  # another block has better ones
        assert not len(none) and least < 400


def test_op6_repeated_ids_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "LEAST_BLOCKS", 7)
    rng = np.random.default_rng(4)
    rows = [(int(i), [float(v) for v in rng.normal(0, 1, 4)]) for i in [*range(300), 7, 7, 50, 50]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    con = connect("/nowhere")
    con.register("embeddings", df.toPandas())
    want = sorted(con.sql(topk.ORACLE_SQL).fetchall())
    got = sorted(tuple(r) for r in topk.top_k(df, df.filter("vec_id % 50 = 0")).collect())
    assert [(a, b, c, d) for a, b, c, d in got] == [tuple(x) for x in want]


def test_op10_on_data(spark, data):
    assert compare(spark, connect(data), urls.op10_url_filters, urls.oracle_sql(), data) == ""


def test_op10_links_and_odd_urls(spark):
    rows = [
        (1, "http://a.net/x", '<a href="http://b.com/fr/">'), (2, "http://c.net/", '<a href="https://E.com/de/x">'), (3, "http://e.com/de/x", None), (4, None, None), (5, "HTTP://B.COM/FR/", "x"), (6, "nourl", "//"),
        (7, "http://b.com/fr/z?q=1#f", "<a href=//d.net>"), (8, "http://d.net?x", None), (9, "http://x.org", ""), (10, "http://sub.example.org/en/12", None), (10, "http://sub.example.org/en/12", None), (11, "https://x.example.org/es/q", "h" * 100000),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'v' as verdict", "'h' as host")
    got = {r["page_id"]: r for r in urls.judge(df).collect()}
    assert got[2]["verdict"] == "block" and got[2]["rule"] is None  # links to a blocked host
    assert got[8]["verdict"] == "allow" and got[1]["verdict"] == "allow"
    assert (got[4]["host"], got[4]["path"], got[6]["host"]) == ("", "", "") and got[9]["rule"] is None
    assert got[10]["rule"] == "example.org/en/1" and got[11]["rule"] == "example.org/es/" and got[7]["path"] == "/fr/z" and got[5]["host"] == "b.com"
    assert urls.judge(df.filter("false")).count() == 0
    con = connect("/nowhere")
    con.register("pages", df.select("page_id", "url", "html").toPandas())
    want = {tuple(r) for r in con.sql(urls.oracle_sql()).fetchall()}
    assert {tuple(r) for r in urls.judge(df).collect()} == want


def test_op1_on_data(spark, data):
    texts = {r["doc_id"]: r["text"] or "" for r in table(spark, data, "documents").collect()}
    tokens = {i: t.encode().lower().split() + [b"\n"] for i, t in texts.items()}
    c = Counter(x for i, t in tokens.items() if zlib.crc32(str(i).encode()) % 7 != 2 for x in t)
    n, v = sum(c.values()), len(c)
    got = lm.op1_lm_scoring(spark, data).collect()
    assert len(got) == len(texts)
    for r in got:
        own = tokens[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(own), sum(x in c for x in own), n) and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in own), rel=1e-9)
        assert r["score"] < 0
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_lm_sums_to_one_and_learns(spark):
    """A language of pairs: after a comes b. The model sees it, and its distribution sums to one."""
    docs = spark.createDataFrame([(i, "a b " * 20 + "c d " * 10) for i in range(40)], "doc_id long, text string")
    model, counts = lm.train(docs)
    u = model.units
    units = np.arange(lm.UNITS)
    begin = u.buckets - 1
    for one, two in ((0, 1), (begin, begin), (100, 3)):
        p = 10 ** model.told(np.full(lm.UNITS, one), np.full(lm.UNITS, two), units)
        assert p.sum() == pytest.approx(1, abs=1e-3)
    score = lambda text: lm.score(spark.createDataFrame([(1, text)], "doc_id long, text string"), model, counts).first()["score"]
    assert score("a b a b a b") > score("b b a a a b")
    assert u.total == 40 * 61


def test_op1_scores_by_plain_loops(spark, data):
    """The score of every text from the model's weights, one token after the other, with every softmax written out."""
    docs = table(spark, data, "documents").limit(60)
    model, counts = lm.train(docs)
    u, w = model.units, model.weights
    c = {bytes(r["token"]): r["c"] for r in counts.collect()}
    number = {t: i for i, t in enumerate(u.tokens)}

    def unit_of(token):
        return int(u.unit[number[token]]) if token in number else int(u.shape_unit[lm.shape_of(token)])

    def soft(x, i):
        x = [float(v) for v in x]
        return x[i] - max(x) - math.log(sum(math.exp(v - max(x)) for v in x))

    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for r in lm.score(docs, model, counts).collect():
        text = texts[r["doc_id"]]
        if len(text) > 3000:
            continue
        want, one, two = 0.0, u.buckets - 1, u.buckets - 1
        for token in text.encode().lower().split() + [b"\n"]:
            unit = unit_of(token)
            of_class, place = divmod(unit, lm.CLASS_SIZE)
            want += soft(w.class_bias + w.class_one[one] + w.class_two[two] + w.class_both[one, lm.joint_of(two)], of_class)
            want += soft(w.unit_bias[of_class] + w.unit_one[one, of_class] + w.unit_two[two, of_class], place)
            if token not in set(u.tokens[: lm.WORDS]):
                want += math.log((c[token] + 1) / int(u.shape_mass[lm.shape_of(token)]))
            one, two = int(u.bucket[unit]), one
        assert r["score"] == pytest.approx(want / math.log(10), rel=1e-4)


def test_lm_gradient_is_the_slope_of_the_likelihood():
    rng = np.random.default_rng(3)
    b, classes, size = 128, lm.CLASSES, lm.CLASS_SIZE
    shape = lambda *x: rng.normal(0, 0.3, x)
    w = lm.Weights(shape(classes), shape(b, classes), shape(b, classes), shape(b, lm.JOINT, classes), shape(classes, size), shape(b, classes, size), shape(b, classes, size))
    cells = np.array([3 * classes + 1, 3 * classes + 7, 90 * classes + 1])
    times, places, g = np.array([4.0, 2.0, 5.0]), (2, 9, 30), 11

    def likelihood():
        out = 0.0
        for cell, n, place in zip(cells, times, places):
            two, c = divmod(int(cell), classes)
            out += n * (lm._log_softmax(w.classes(g, two))[c] + lm._log_softmax(w.inside(g, two, c))[place])
        return out

    (seen, guess), (_, expected), (x, y) = lm.gradient(w, 0, g, cells, times)
    observed = np.zeros((classes, size))
    for cell, n, place in zip(cells, times, places):
        observed[cell % classes, place] += n
    for array, at, slope in ((w.class_one, (g, 7), (seen - guess)[7]), (w.unit_one, (g, 1, 30), (observed - expected)[1, 30]), (w.class_both, (g, lm.joint_of(90), 1), (x - y)[lm.joint_of(90), 1])):
        base, kept = likelihood(), array[at]
        array[at] += 1e-4
        assert (likelihood() - base) / 1e-4 == pytest.approx(float(slope), abs=0.02)
        array[at] = kept


def test_lm_dictionary_of_a_flat_vocabulary(spark, monkeypatch):
    monkeypatch.setattr(lm, "HEAD", 50)
    head, total, distinct = lm.head_of(spark.range(1000).selectExpr("cast(cast(id as string) as binary) token", "3L c"))
    assert 20 <= head.num_rows <= 50 and (total, distinct) == (3000, 1000)


def test_op1_odd(spark):
    model, counts = lm.train(odd_docs(spark))
    got = lm.score(odd_docs(spark), model, counts).collect()
    assert len(got) == 10 and all(r["n_known"] == r["n_tokens"] for r in got) and {r["n_tokens"] for r in got if r["doc_id"] in (2, 3, 4)} == {1}
    nothing, none = lm.train(no_docs(spark))
    assert all(r["n_known"] == 0 and r["train_tokens"] == 0 for r in lm.score(odd_docs(spark), nothing, none).collect())
    assert lm.score(no_docs(spark), model, counts).count() == 0


def test_null_ids_and_columns(spark, data):
    """A null in any column neither breaks an operator nor loses the row."""
    from tidemark.llm import byte_bpe, packing, pii, quality, toxicity
    from tidemark.llm.common import held_out

    docs = spark.createDataFrame([(None, "a b c d e f g"), (None, None), (1, "a b c d e f g"), (2, None)], "doc_id long, text string").selectExpr("*", "cast(null as string) lang", "cast(null as string) source", "cast(null as bigint) n_chars")
    labels = spark.createDataFrame([(None, 1, 0), (1, None, None), (2, 0, 1)], "doc_id long, quality int, toxic int")
    model, counts = lm.train(docs.filter(~held_out(docs["doc_id"], 7)))
    machine = toxicity.train(docs, labels)
    for out in (
        lm.score(docs, model, counts), pii.pii_spans(docs), quality.quality_rules(docs, quality.train(docs, labels)), packing.pack_documents(docs), neardup.near_duplicates(docs),
        toxicity.toxicity_scores(docs, machine), byte_bpe.byte_bpe_digest(docs), toxicity.drop_toxic(docs, labels), pii.redact(docs),
    ):
        assert len(out.collect()) == 4
    assert neardup.drop_near_duplicates(docs).count() >= 3
    pages = spark.createDataFrame([(None, None, None), (1, None, "<a href='//x.com/'>"), (2, "http://a.com/de/", None)], "page_id long, url string, html string")
    assert len(urls.judge(pages).collect()) == 3
    vectors = spark.createDataFrame([(None, [1.0]), (50, [1.0]), (51, None)], "vec_id long, embedding array<float>")
    assert topk.top_k(vectors, vectors.filter("vec_id % 50 = 0")).count() == 0
