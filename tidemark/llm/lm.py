"""Language-model scores from a hashed maximum-entropy model with a class-factored softmax (operator 1).

Units are the most frequent tokens and, for all others, hashed shapes (their last three bytes).
Units of like frequency form classes. P(token | context) is P(class | context) times
P(unit | class, context), times, for a shape, the token's share (count + 1) of the shape's; each shape
keeps one share for tokens never seen. The features are hashed: the bucket of the token before (n-gram),
of the one before that (skip), and, for the class, of both together. The hash space grows with the corpus,
from LEAST_BUCKETS to MOST_BUCKETS buckets a position.

Every token of the training texts counts. One pass gathers how often each class and unit follows each
pair of buckets; these counts are added up on the cluster and stored in slices, by the first and by the
second bucket. The weights are then trained by rounds of gradient updates that are distributed over the slices:
a round sends out the weights, each slice works out the gradient of the log likelihood of all its tokens
(observed less expected counts, full softmax) for the features it owns alone, and moves them along it,
each scaled by its count. Rounds take turns between the features of the two positions. Scoring is one scan
with sparse numpy lookups by batch; normalisers of units are worked out once for each distinct context of a batch.

Counts of all training tokens stay a distributed table. Only the HEAD most frequent ones are sent out (a
bounded dictionary); the rest of a text's tokens are joined with the table and added up for each row.
A token that training never saw may be frequent here: that join is left to Spark's splitting of skewed keys.

Null and empty texts hold only the end token. Very long texts are read whole, their tokens in chunks. Ties of
frequency go by the token's bytes (by its hash at HEAD's edge). Repeated rows are scored each. Without training
texts (an empty table) all counts are zero; an empty table of texts gives an empty result. Columns other than
doc_id and text are not read, so clashing names do no harm.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_map, forget, held_out, small_batches, stored, table, texts_of

END = b"\n"  # no word can hold it
HEAD = 65_536
WORDS, SHAPES, CLASS_SIZE = 3840, 256, 64
UNITS, CLASSES = WORDS + SHAPES, (WORDS + SHAPES) // CLASS_SIZE
#: Buckets of a position; three quarters are of single units, the last is the text's beginning.
LEAST_BUCKETS, MOST_BUCKETS = 128, 512
#: Buckets of both positions together, for each bucket of the first.
JOINT = 64
#: Contexts whose normalisers are worked out at once, and tables of counts that are added up at once.
CHUNK, FAN = 4096, 64
#: Distinct tokens a task counts before it passes its counts on.
FLUSH = 400_000


def tokens_of(text: str) -> list[bytes]:
    out = text.encode("utf-8", "replace").lower().split()
    out.append(END)
    return out


def shape_of(token: bytes) -> int:
    return zlib.crc32(token[-3:]) % SHAPES


def token_counts(docs: DataFrame) -> DataFrame:
    """token, c: how often every token occurs; tasks add up before the shuffle."""
    small_batches(docs.sparkSession)
    schema = "token binary, c long"

    def count(batches):
        seen: dict[bytes, int] = {}

        def rows():
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["token", "c"])

        for batch in batches:
            for text in texts_of(batch):
                for token in tokens_of(text):
                    seen[token] = seen.get(token, 0) + 1
            if len(seen) > FLUSH:
                yield rows()
                seen = {}
        if seen:
            yield rows()

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(count, schema).groupBy("token").agg(F.sum("c").alias("c"))


@dataclass
class Units:
    """The dictionary that is sent out; at most HEAD tokens."""

    total: int
    distinct: int
    tokens: list[bytes]
    counts: np.ndarray  # of the tokens
    unit: np.ndarray  # of the tokens
    shape_unit: np.ndarray  # of the shapes
    unit_count: np.ndarray
    shape_mass: np.ndarray
    bucket: np.ndarray  # of the units
    buckets: int

    def reader(self):
        """A function from texts to tokens, units, starts, places of the rare tokens and numbers in the dictionary."""
        number = {t: i for i, t in enumerate(self.tokens)}
        get = number.get

        def read(texts: list[str]):
            own = [tokens_of(x) for x in texts]
            starts = np.cumsum([0, *(len(x) for x in own[:-1])])
            flat = [t for x in own for t in x]
            at = np.array([get(t, -1) for t in flat], np.int64)
            rare = np.flatnonzero(at < 0)
            units = self.unit[at] if len(self.unit) else np.zeros(len(at), np.int64)
            if len(rare):
                units[rare] = self.shape_unit[np.array([shape_of(flat[i]) for i in rare.tolist()], np.int64)]
            return flat, units, starts, rare, at

        return read

    def contexts(self, units: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Buckets of the token before and of the one before that."""
        own = self.bucket[units]
        one, two = np.empty_like(own), np.empty_like(own)
        one[1:], two[2:] = own[:-1], own[:-2]
        begin = self.buckets - 1
        one[starts], two[starts] = begin, begin
        second = starts + 1
        two[second[second < len(own)]] = begin
        return one, two


def buckets_for(total: int) -> int:
    """A power of two that grows with the square root of the training tokens."""
    out = LEAST_BUCKETS
    while out < MOST_BUCKETS and 16 * out * out < total:
        out *= 2
    return out


def head_of(counts: DataFrame) -> tuple[pa.Table, int, int]:
    """The HEAD most frequent tokens (ties by hash), and the sums over all: tokens and distinct ones."""
    level = F.floor(F.log2("c") * 16).cast("int")  # some hundred levels at most
    levels = counts.groupBy(level.alias("level")).agg(F.count("*").alias("v"), F.sum("c").alias("n")).orderBy(F.desc("level")).collect()
    taken, least, share = 0, 1 << 30, 1.0
    for r in levels:  # whole levels from the top, and of the one at the edge the share that still fits
        least = r["level"]
        if taken + r["v"] > HEAD:
            share = (HEAD - taken) / r["v"]
            break
        taken += r["v"]
    parts = 1 << 20
    inside = (level > least) | ((level == least) & (F.pmod(F.xxhash64("token"), F.lit(parts)) < int(share * parts)))
    head = counts.filter(inside).select("token", "c").toArrow().sort_by([("c", "descending"), ("token", "ascending")])[:HEAD]
    return head, sum(r["n"] for r in levels), sum(r["v"] for r in levels)


def choose_units(counts: DataFrame) -> Units:
    """counts is a stored table."""
    head, total, distinct = head_of(counts)
    tokens, c = head["token"].to_pylist(), head["c"].to_numpy()
    buckets = buckets_for(total)
    own_buckets = buckets * 3 // 4
    words = set(tokens[:WORDS])

    def make():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            times, mass = np.zeros(SHAPES, np.int64), np.zeros(SHAPES, np.int64)
            for token, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if token not in words:
                    s = shape_of(token)
                    times[s] += n
                    mass[s] += n + 1
            return pa.RecordBatch.from_arrays([pa.array(range(SHAPES), pa.int32()), pa.array(times), pa.array(mass)], names=["shape", "times", "mass"])

        return run

    rows = arrow_map(counts.select("token", "c"), make, "shape int, times long, mass long").groupBy("shape").agg(F.sum("times").alias("times"), F.sum("mass").alias("mass")).collect()
    times, mass = np.zeros(SHAPES, np.int64), np.ones(SHAPES, np.int64)
    for r in rows:
        times[r["shape"]], mass[r["shape"]] = r["times"], r["mass"] + 1
    every = np.concatenate([c[:WORDS], np.zeros(WORDS - len(c[:WORDS]), np.int64), times])  # words, then shapes
    order = np.argsort(-every, kind="stable")
    place = np.empty(UNITS, np.int64)
    place[order] = np.arange(UNITS)
    own = [place[i] if i < WORDS else place[WORDS + shape_of(t)] for i, t in enumerate(tokens)]
    shape = np.array([shape_of(t) for t in tokens[:WORDS]] + [0] * (WORDS - len(tokens[:WORDS])) + list(range(SHAPES)))
    bucket = np.empty(UNITS, np.int64)
    bucket[place] = np.where(place < own_buckets, place, own_buckets + shape % (buckets - own_buckets - 1))
    return Units(total, distinct, tokens, c, np.array(own, np.int64), place[WORDS:], every[order], mass, bucket, buckets)


def gather(docs: DataFrame, units: Units, files: int = 32) -> DataFrame:
    """way (0 by the first bucket, 1 by the second), slice, part, cells, n: the counts of each slice.

    A cell is a class beside the other bucket, or, from buckets * CLASSES on, a unit of the slice itself. Tasks pass on
    the cells they met; at most FAN tables of a slice are added up at once, in as many levels as there are tasks for.
    """
    spark = docs.sparkSession
    send = spark.sparkContext.broadcast(units)
    size = units.buckets
    schema = "way int, slice int, part int, cells binary, n binary"
    names = ["way", "slice", "part", "cells", "n"]

    def count(batches):
        u = send.value
        read, part = u.reader(), TaskContext.get().partitionId()
        pairs, first, second = np.zeros(size * size * CLASSES, np.int32), np.zeros(size * UNITS, np.int32), np.zeros(size * UNITS, np.int32)
        for batch in batches:
            texts = texts_of(batch)
            for k in range(0, len(texts), 250):
                _, own, starts, _, _ = read(texts[k : k + 250])
                one, two = u.contexts(own, starts)
                for total, key in ((pairs, (one * size + two) * CLASSES + own // CLASS_SIZE), (first, one * UNITS + own), (second, two * UNITS + own)):
                    at, n = np.unique(key, return_counts=True)
                    total[at] += n.astype(np.int32)
        cube = pairs.reshape(size, size, CLASSES)
        for way, own in enumerate((first.reshape(size, -1), second.reshape(size, -1))):
            for g in range(size):
                flat = np.concatenate([(cube[g] if way == 0 else cube[:, g]).ravel(), own[g]])
                at = np.flatnonzero(flat)
                if len(at):
                    blobs = [pa.array([x.tobytes()], pa.binary()) for x in (at.astype(np.int32), flat[at].astype(np.int64))]
                    yield pa.RecordBatch.from_arrays([*(pa.array([x], pa.int32()) for x in (way, g, part)), *blobs], names=names)

    def add(rows: pa.Table) -> pa.Table:
        total = np.zeros(size * CLASSES + UNITS, np.int64)
        for cells, n in zip(rows["cells"], rows["n"]):
            total[np.frombuffer(cells.as_buffer(), np.int32)] += np.frombuffer(n.as_buffer(), np.int64)
        at = np.flatnonzero(total)
        return pa.table([*(rows[c][:1] for c in names[:3]), pa.array([at.astype(np.int32).tobytes()], pa.binary()), pa.array([total[at].tobytes()], pa.binary())], names=names)

    small_batches(spark)
    rows = docs.selectExpr("cast(doc_id as bigint) doc_id", "text")
    tasks = rows.rdd.getNumPartitions()
    out = rows.mapInArrow(count, schema)
    while tasks > FAN:
        out = out.withColumn("part", F.floor(F.col("part") / FAN).cast("int")).groupBy("way", "slice", "part").applyInArrow(add, schema)
        tasks = -(-tasks // FAN)
    return out.groupBy("way", "slice").applyInArrow(add, schema).repartition(files, "way", "slice")


@dataclass
class Weights:
    class_bias: np.ndarray
    class_one: np.ndarray  # bucket x class
    class_two: np.ndarray
    class_both: np.ndarray  # bucket x JOINT x class
    unit_bias: np.ndarray  # class x place
    unit_one: np.ndarray  # bucket x class x place
    unit_two: np.ndarray

    @property
    def buckets(self) -> int:
        return len(self.class_one)

    def classes(self, one, two) -> np.ndarray:
        """Logits of the classes for pairs of buckets."""
        return self.class_bias + self.class_one[one] + self.class_two[two] + self.class_both[one, joint_of(two)]

    def inside(self, one, two, of_class) -> np.ndarray:
        """Logits of the units of a class for pairs of buckets."""
        return self.unit_bias[of_class] + self.unit_one[one, of_class] + self.unit_two[two, of_class]


def joint_of(two):
    """The hashed place of a second bucket beside each first one."""
    return (two * 2654435761 >> 9) % JOINT


def _log_softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(-1, keepdims=True)
    return x - np.log(np.exp(x).sum(-1, keepdims=True))


def begin(units: Units) -> Weights:
    """Only the biases: the unigram model of the units."""
    n = (units.unit_count + 1.0).reshape(CLASSES, CLASS_SIZE)
    flat = lambda *shape: np.zeros(shape, np.float32)
    b = units.buckets
    shape = (b, CLASSES, CLASS_SIZE)
    return Weights(np.log(n.sum(1)).astype(np.float32), flat(b, CLASSES), flat(b, CLASSES), flat(b, JOINT, CLASSES), np.log(n).astype(np.float32), flat(*shape), flat(*shape))


def gradient(w: Weights, way: int, g: int, cells: np.ndarray, times: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Observed and expected counts of the slice's own features: class, unit (observed is not known here: zeros), both.

    The gradient of the log likelihood by a feature's weight is its observed less its expected count.
    """
    size = w.buckets
    seen = np.zeros(size * CLASSES, np.float32)
    seen[cells] = times
    seen = seen.reshape(size, CLASSES)
    rows = np.flatnonzero(seen.any(1))
    seen = seen[rows]
    pair = (lambda x: (np.full(len(x), g), x)) if way == 0 else (lambda x: (x, np.full(len(x), g)))
    guess = seen.sum(1, keepdims=True) * np.exp(_log_softmax(w.classes(*pair(rows))))
    both = np.zeros((2, JOINT, CLASSES), np.float32)
    if way == 0:
        np.add.at(both[0], joint_of(rows), seen)
        np.add.at(both[1], joint_of(rows), guess)
    other, of_class = cells // CLASSES, cells % CLASSES
    order = np.argsort(of_class, kind="stable")
    unit = np.zeros((CLASSES, CLASS_SIZE), np.float32)
    for k in range(0, len(order), CHUNK):
        at = order[k : k + CHUNK]
        c = of_class[at]
        spread = times[at, None] * np.exp(_log_softmax(w.inside(*pair(other[at]), c)))
        first = np.flatnonzero(np.r_[True, c[1:] != c[:-1]])
        unit[c[first]] += np.add.reduceat(spread, first)
    return [(seen.sum(0), guess.sum(0)), (np.zeros_like(unit), unit), (both[0], both[1])]


def moved(w: np.ndarray, observed: np.ndarray, expected: np.ndarray, rate: float, calm: float = 2.0, decay: float = 0.02) -> np.ndarray:
    """A step along the gradient (with a small pull to zero), scaled by the feature's count."""
    return (w + rate * (observed - expected - decay * w) / (np.maximum(observed, expected) + calm)).astype(np.float32)


def gradient_round(stats: DataFrame, w: Weights, way: int, rate: float = 0.8) -> Weights:
    """One distributed round of updates of the features of one position (and, with the first, of both together)."""
    spark = stats.sparkSession
    send = spark.sparkContext.broadcast(w)  # its size has the bound that MOST_BUCKETS sets

    def make():
        now = send.value
        own_class, own_unit = (now.class_one, now.unit_one) if way == 0 else (now.class_two, now.unit_two)

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            out: list[list] = [[], [], []]
            for cells, times, g in zip(*(batch.column(i).to_pylist() for i in range(3))):
                cells, times = np.frombuffer(cells, np.int32).astype(np.int64), np.frombuffer(times, np.int64).astype(np.float32)
                pair = cells < now.buckets * CLASSES
                (a, b), (_, e), (x, y) = gradient(now, way, g, cells[pair], times[pair])
                seen = np.zeros(UNITS, np.float32)
                seen[cells[~pair] - now.buckets * CLASSES] = times[~pair]
                seen = seen.reshape(CLASSES, CLASS_SIZE)
                steps = (moved(own_class[g], a, b, rate if way else rate / 2), moved(own_unit[g], seen, e, rate), moved(now.class_both[g], x, y, rate / 2))
                for column, step in zip(out, steps):
                    column.append(step.tobytes())
            return pa.RecordBatch.from_arrays([batch.column(2), *(pa.array(x, pa.binary()) for x in out)], names=["slice", "class", "unit", "both"])

        return run

    rows = arrow_map(stats.filter(F.col("way") == way).select("cells", "n", "slice"), make, "slice int, class binary, unit binary, both binary").toArrow()
    out = Weights(w.class_bias, w.class_one.copy(), w.class_two.copy(), w.class_both.copy(), w.unit_bias, w.unit_one.copy(), w.unit_two.copy())
    of_class, of_unit = (out.class_one, out.unit_one) if way == 0 else (out.class_two, out.unit_two)
    for i in range(rows.num_rows):  # one row for each bucket
        g = rows["slice"][i].as_py()
        of_class[g] = np.frombuffer(rows["class"][i].as_buffer(), np.float32)
        of_unit[g] = np.frombuffer(rows["unit"][i].as_buffer(), np.float32).reshape(CLASSES, CLASS_SIZE)
        if way == 0:
            out.class_both[g] = np.frombuffer(rows["both"][i].as_buffer(), np.float32).reshape(JOINT, CLASSES)
    send.destroy()
    return out


@dataclass
class Model:
    """What scoring needs: the units, the weights, and the log normaliser of the classes for each pair of buckets."""

    units: Units
    weights: Weights
    class_norm: np.ndarray

    def log10(self, units: np.ndarray, starts: np.ndarray) -> np.ndarray:
        one, two = self.units.contexts(units, starts)
        return self.told(one, two, units)

    def told(self, one: np.ndarray, two: np.ndarray, units: np.ndarray) -> np.ndarray:
        """log10 P(unit | buckets), elementwise."""
        w, (c, place) = self.weights, np.divmod(units, CLASS_SIZE)
        out = w.class_bias[c] + w.class_one[one, c] + w.class_two[two, c] + w.class_both[one, joint_of(two), c] - self.class_norm[one, two]
        out = out + w.unit_bias[c, place] + w.unit_one[one, c, place] + w.unit_two[two, c, place]
        context, back = np.unique((one * w.buckets + two) * CLASSES + c, return_inverse=True)
        norm = np.empty(len(context), np.float32)
        for k in range(0, len(context), CHUNK):
            pair, of_class = np.divmod(context[k : k + CHUNK], CLASSES)
            x = w.inside(*np.divmod(pair, w.buckets), of_class)
            top = x.max(-1)
            norm[k : k + CHUNK] = top + np.log(np.exp(x - top[:, None]).sum(-1))
        return (out - norm[back]) / np.float32(np.log(10))


def freeze(units: Units, w: Weights) -> Model:
    norm = np.empty((w.buckets, w.buckets), np.float32)
    two = np.arange(w.buckets)
    for g in range(w.buckets):
        x = w.classes(np.full(w.buckets, g), two)
        top = x.max(-1)
        norm[g] = top + np.log(np.exp(x - top[:, None]).sum(-1))
    return Model(units, w, norm)


def train(docs: DataFrame, rounds: int = 8) -> tuple[Model, DataFrame]:
    """The model and the stored table of token counts."""
    counts = stored(token_counts(docs), "lm-counts")
    units = choose_units(counts)
    weights = begin(units)
    if units.total:
        stats = stored(gather(docs, units), "lm-slices")
        for k in range(rounds):
            weights = gradient_round(stats, weights, k % 2)
        forget(stats)
    return freeze(units, weights), counts


def score(docs: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of every row."""
    send = docs.sparkSession.sparkContext.broadcast(model)
    size = np.log10(model.units.total + model.units.distinct + 1)

    def make():
        m = send.value
        u = m.units
        read = u.reader()
        own = np.log10(u.counts + 1.0)
        mass = np.log10(u.shape_mass)
        inner = np.array([0.0 if i < WORDS else own[i] - mass[shape_of(t)] for i, t in enumerate(u.tokens)])

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts, parts = texts_of(batch), []
            for k in range(0, len(texts), 250):
                flat, units, starts, rare, at = read(texts[k : k + 250])
                told = m.log10(units, starts).astype(float)
                known = at >= 0
                base = np.where(known, own[at], 0.0) if len(own) else np.zeros(len(at))
                if len(inner):
                    told += np.where(known, inner[at], 0.0)
                tokens = [flat[i] for i in rare.tolist()]
                told[rare] -= mass[np.array([shape_of(t) for t in tokens], np.int64)]
                n = np.diff([*starts, len(flat)])
                at_row = np.searchsorted(rare, [*starts, len(flat)])
                parts.append((n, np.add.reduceat(known, starts, dtype=np.int64), np.add.reduceat(base, starts), np.add.reduceat(told, starts), [tokens[a:b] for a, b in zip(at_row, at_row[1:])]))
            joined = [np.concatenate([p[i] for p in parts]) for i in range(4)] if parts else [np.zeros(0)] * 4
            rare_of = [x for p in parts for x in p[4]]
            return pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(x.astype(np.int64)) for x in joined[:2]), *(pa.array(x.astype(float)) for x in joined[2:]), pa.array(rare_of, pa.list_(pa.binary()))],
                names=["doc_id", "n_tokens", "n_known", "base", "told", "rare"],
            )

        return run

    seen = arrow_map(docs.selectExpr("cast(doc_id as bigint) doc_id", "text"), make, "doc_id long, n_tokens long, n_known long, base double, told double, rare array<binary>")
    seen = stored(seen.withColumn("row", F.monotonically_increasing_id()), "lm-seen")
    rare = seen.select("row", F.explode("rare").alias("token")).join(counts, "token", "left").groupBy("row").agg(F.sum(F.log10(F.coalesce("c", F.lit(0)) + 1.0)).alias("more"), F.count("c").alias("found"))
    out = seen.drop("rare").join(rare, "row", "left")
    more = F.coalesce("more", F.lit(0.0))
    return out.select(
        "doc_id", "n_tokens", (F.col("n_known") + F.coalesce("found", F.lit(0))).alias("n_known"), F.lit(int(model.units.total)).cast("long").alias("train_tokens"),
        (F.col("base") + more - F.col("n_tokens") * F.lit(float(size))).alias("base_score"), (F.col("told") + more).alias("score"),
    )


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model, counts = train(docs.filter(~held_out(F.col("doc_id"), 7)))
    out = score(docs, model, counts)
    return out.select("doc_id", held_out(F.col("doc_id"), 7).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
