"""Quality rules, toxicity and personal data against plain Python."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tests.llm.helpers import no_docs, odd_docs
from tidemark.llm import pii, quality, toxicity
from tidemark.llm.common import table


def slow_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(zip(words, words[1:], words[2:]))
    inside = {i + k for i, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] >= 2 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside)


def test_op4_on_data(spark, data):
    texts = {r["doc_id"]: r["text"] or "" for r in table(spark, data, "documents").collect()}
    got = quality.op4_quality_rules(spark, data).collect()
    assert len(got) == len(texts)
    for r in got:
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == slow_counts(texts[r["doc_id"]])
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]) and not (r["base_failed"] and r["kept"])


def test_counts_of_random_texts():
    rng = random.Random(4)
    for _ in range(300):
        text = "".join(rng.choice(["a", "b ", " ", "\n", "\x0b", "é", "#", "a b c ", "\x85", "|"]) for _ in range(rng.randint(0, 60)))
        assert quality.counts_of(text)[:5] == slow_counts(text)


def test_rules_find_the_planted_one():
    rng = np.random.default_rng(0)
    n = 3000
    counts = {c: rng.integers(50, 500, n) for c in quality.COUNTS}
    bad = (counts["n_symbols"] / counts["n_words"] >= 1.5) & (counts["n_upper"] / counts["word_chars"] >= 0.5)
    rules = quality.learn_rules(counts, bad)
    x = quality.statistics(counts)
    said = np.logical_or.reduce([r.covers(x) for r in rules])
    assert (said & bad).sum() >= 0.95 * bad.sum() and (said & ~bad).sum() <= 0.02 * n
    assert quality.learn_rules(counts, np.zeros(n, bool)) == [] and quality.learn_rules({c: v[:0] for c, v in counts.items()}, bad[:0]) == []


def test_op4_odd(spark, data):
    labels = table(spark, data, "labels")
    docs = odd_docs(spark)
    rules = [quality.Rule((("symbols_per_word", True, 0.2),), 1.0)]
    got = {r["doc_id"]: r for r in quality.quality_rules(docs, rules).collect()}
    assert got[2]["n_words"] == 0 and not got[2]["kept"] and got[5]["kept"]
    kept = quality.drop_low_quality(docs, rules)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {r for r, x in got.items() if x["kept"]}
    assert quality.train(no_docs(spark), labels) == [] and quality.train(docs, labels.filter("false")) == []
    assert quality.quality_rules(no_docs(spark), []).count() == 0


def test_toxicity_learns_words_prefixes_and_pairs():
    rng = np.random.default_rng(1)
    docs, y = [], []
    for _ in range(1500):
        own = set(rng.integers(0, 60, 8).tolist())
        toxic = 100 in own or rng.random() < 0.2
        if toxic:
            own |= {100, 101}
        elif rng.random() < 0.5:
            own.add(int(rng.choice([100, 101])))  # either alone is harmless
        docs.append(np.array(sorted(own), np.int32))
        y.append(int({100, 101} <= own))
    m = toxicity.fit(docs, np.array(y), l2=1e-5)
    slot = {t: i for i, t in enumerate(m.terms)}
    a, b = m.vectors[slot[100]], m.vectors[slot[101]]
    assert m.weights[slot[100]] + m.weights[slot[101]] + a @ b > max(m.weights[slot[100]], m.weights[slot[101]])


def test_op8_on_data(spark, data):
    got = toxicity.op8_toxicity(spark, data).collect()
    labels = {r["doc_id"]: r["toxic"] for r in table(spark, data, "labels").collect()}
    assert len(got) == table(spark, data, "documents").count()
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    known = [(labels[r["doc_id"]], r["predicted"]) for r in got if r["doc_id"] in labels]
    assert sum(a == b for a, b in known) >= 0.9 * len(known)


def test_held_out_recall(spark):
    docs = spark.createDataFrame([(i, ("you are an idiot and a moron today " if i % 5 == 0 else "have a lovely sunny day friend ") + f"n{i} " * 5) for i in range(600)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 == 0), 1) for i in range(600)], "doc_id long, toxic int, quality int")
    got = toxicity.toxicity_scores(docs, toxicity.train(docs, labels)).filter("held_out").collect()
    assert got and all(r["predicted"] == int(r["doc_id"] % 5 == 0) for r in got)


def test_toxicity_learns_a_rare_insult_from_all_of_sixteen_thousand_labels(spark):
    docs = spark.range(15000).selectExpr("id doc_id", "concat('have a lovely day ', if(id % 300 = 0, 'numbskull', 'friend')) text")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 300 = 0 as int) toxic")
    kept = sum(zlib.crc32(str(i).encode()) % 4 != 2 for i in range(15000))
    rows = []
    fit, toxicity.fit = toxicity.fit, lambda docs, labels: rows.extend(labels.tolist()) or fit(docs, labels)
    try:
        machine = toxicity.train(docs, labels)
    finally:
        toxicity.fit = fit
    assert len(rows) == kept and sum(rows) == sum(zlib.crc32(str(i).encode()) % 4 != 2 for i in range(0, 15000, 300))
    assert set(toxicity.terms_of(b"numbskull")) <= set(machine.terms.tolist())


def test_chosen_terms_are_those_of_a_plain_count():
    rng = np.random.default_rng(5)
    docs = [np.unique(rng.integers(0, 400, 12)).astype(np.int32) for _ in range(600)]
    y = np.array([float(x[0] < 15) for x in docs])
    want = []
    for t in range(400):
        has = np.array([t in x for x in docs])
        df, pos = has.sum(), (has * y).sum()
        chi = (pos - df * y.mean()) ** 2 / max(df * y.mean() * (1 - y.mean()) * (1 - df / len(y)), 1e-9)
        if df >= 3 and chi > 6.6:
            want.append((-chi, t))
    assert len(want) > 5 and toxicity.choose_terms(docs, y, 5).tolist() == sorted(t for _, t in sorted(want)[:5])
    assert not len(toxicity.choose_terms([np.zeros(0, np.int32)] * 4, np.array([0.0, 1, 0, 1]), 5))


def test_op8_odd(spark, data):
    labels = table(spark, data, "labels")
    m = toxicity.train(odd_docs(spark), labels.filter("false"))
    assert toxicity.toxicity_scores(odd_docs(spark), m).count() == 10
    assert toxicity.toxicity_scores(no_docs(spark), toxicity.train(no_docs(spark), labels)).count() == 0
    left = toxicity.drop_toxic(odd_docs(spark), labels)
    assert left.columns == odd_docs(spark).columns


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    return sum(v if i % 2 == 0 else v * 2 - 9 * (v > 4) for i, v in enumerate(map(int, reversed(digits)))) % 10 == 0


def slow_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")) or kind == "card" and not (14 <= len(digits) <= 19 and luhn(digits)) or kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), k, kind, m.end()))
    return [(kind, a, b) for a, _, kind, b in sorted(out)]


def held(spark, docs):
    texts = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
    got = {r["doc_id"]: r for r in pii.pii_spans(docs).collect()}
    for doc_id, text in texts:
        spans = slow_spans(text)
        said = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert got[doc_id]["base_sha256"] == hashlib.sha256(said.encode()).hexdigest(), (doc_id, text[:80], said)
        assert set(said.split(",")) - {""} <= set(got[doc_id]["spans"].split(","))
        for k in BASE:
            assert got[doc_id][f"n_{k}"] == sum(s[0] == k for s in spans)
    return got


def test_op2_on_data(spark, data):
    held(spark, table(spark, data, "documents"))


def test_op2_random_and_long(spark):
    rng = random.Random(3)
    parts = ["a", "b.", "@", ".", "1", "22", "4785380592391139", " ", "-", "+", "(", ")", "é", "_", "%", "255.1.2.3", "x@y.com", "+1 (743) 555-3824", "256.1.1.1.1", "\n", "٣", "0255.000.1.1"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))) for i in range(1500)]
    rows += [(5001, "a" * 50000), (5002, "1 " * 30000), (5003, "1." * 30000), (5004, "a@b." * 10000), (5005, None), (5006, "+1" * 20000), (5007, "1" * 50000)]
    held(spark, spark.createDataFrame(rows, "doc_id long, text string"))


def test_op2_extra_kinds_and_redaction(spark):
    docs = odd_docs(spark, [(20, "write to jane (at) example (dot) com or call (212) 555-0199 now, ssn 078-05-1120", "en", "s", 1), (21, "mail bob@site.org, card 4785380592391139.", "en", "s", 1)])
    spans = {r["doc_id"]: r["spans"] for r in pii.pii_spans(docs).collect()}
    assert "obfuscated:9:36" in spans[20] and "national:" in spans[20] and "ssn:" in spans[20]
    out = pii.redact(docs)
    assert out.columns == docs.columns
    new = {r["doc_id"]: r for r in out.collect()}
    assert new[21]["text"] == "mail [EMAIL], card [CARD]." and new[21]["n_chars"] == len(new[21]["text"])
    assert new[2]["text"] is None and new[5]["text"] == docs.filter("doc_id = 5").first()["text"]
    assert pii.pii_spans(no_docs(spark)).count() == 0 and pii.redact(no_docs(spark)).count() == 0


def test_reliabilities_find_the_bad_labeler():
    rng = random.Random(2)
    counts = Counter()
    for _ in range(4000):
        truth = rng.random() < 0.6
        counts[(0, tuple(int((rng.random() < a) == truth) for a in (0.95, 0.9, 0.5)))] += 1
    rates, post = pii.reliabilities([(k, v, n) for (k, v), n in sorted(counts.items())])
    assert rates[0][0] > 0.9 and rates[0][1] < 0.15 and abs(rates[2][0] - rates[2][1]) < 0.12


def test_native_plans(spark, data):
    plan = pii.redact(table(spark, data, "documents"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    assert F  # the operators use DataFrame functions only


def test_long_secrets_are_spans_to_their_end(spark):
    text = 'token = "' + "aB3" * 400 + '" and more'
    docs = spark.createDataFrame([(i, text) for i in range(20)] + [(99, "nothing here")], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in pii.pii_spans(docs).collect()}
    assert rows[0]["n_secret"] == 1 and rows[0]["spans"].endswith(f":{text.index(' and more')}") and rows[99]["n_spans"] == 0
    assert "aB3" not in pii.redact(docs).filter("doc_id = 0").first()["text"]


def test_labelled_sample_is_bounded_where_documents_repeat(spark):
    from tidemark.llm.common import labelled_sample

    docs = spark.createDataFrame([(i % 5, f"text {i % 10}") for i in range(500)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(5)], "doc_id long, toxic int")
    got = sorted(tuple(r) for r in labelled_sample(docs, labels, "toxic", 10).collect())
    assert got == [(i, f"text {i}", i % 2) for i in range(5)]
