"""Near-duplicates by MinHash, with exact confirmation and connected components (operator 7).

A document's set is its distinct five-word shingles. Universal hash functions give the set's minima;
five minima make a band, and documents that agree in a whole band share a bucket. Documents with
equal sets are one representative from the start. In each bucket the others are compared with one
hub; what the signatures do not rule out is confirmed on the full sets. Confirmed links are joined
into components by alternating large-star and small-star. Buckets that still hold several
components get another hub, and in the end the pairs across components that their rarest shingles,
places and sizes leave possible are compared, so that a link is skipped only between documents
already known to be connected. A group of copies is dealt into shares where its component is told.

With 48 bands of 5 minima a pair at the similarity limit of 0.75 shares no bucket with probability
2e-6. Signatures rule a pair out more than five standard errors below the limit.

Null texts and texts without words have an empty set and are linked with nothing; texts of fewer
than five words have their whole sequence as one shingle. Very long texts are hashed whole, in chunks of
bounded size. An empty table gives an empty result. Rows that repeat a doc_id are one document
to the links. Columns other than doc_id and text are not read (drop_near_duplicates keeps them).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_map, forget, stored, table, texts_of

WORDS, PERCENT = 5, 75
BANDS, ROWS = 48, 5
HUB_ROUNDS = 2
#: Cells of sizes for each e-fold, and the shares of a group of copies.
CELLS, SHARES = 20, 8
_rng = np.random.default_rng(7)
FACTORS = (_rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
SHIFTS = _rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint64).astype(np.uint32)
ODD = _rng.integers(0, 1 << 63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Share of agreeing minima (of 8 bits) under which a pair cannot be a link.
LEAST_AGREEMENT = PERCENT / 100 - 5 * (PERCENT / 100 * (1 - PERCENT / 100) / (BANDS * ROWS)) ** 0.5
#: Shingles hashed at once.
CHUNK = 1 << 15


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * ODD[14]
    x = (x ^ (x >> np.uint64(29))) * ODD[15]
    return x ^ (x >> np.uint64(32))


def shingles(text: str) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles; empty without words."""
    words = text.encode("utf-8", "replace").lower().split()
    n = len(words)
    if n == 0:
        return np.zeros(0, np.uint64)
    if n < WORDS:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=n)], np.uint64)
    digest = xxhash.xxh3_64_intdigest
    w = np.array([digest(x) for x in words], np.uint64)
    s = w[: n - WORDS + 1] * ODD[0]
    for k in range(1, WORDS):
        s += w[k : n - WORDS + 1 + k] * ODD[k]
    return np.unique(_mixed(s))


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """len(sets) x (BANDS * ROWS) minima of the universal hash functions; no set may be empty."""
    out = np.empty((len(sets), BANDS * ROWS), np.uint32)
    start = 0
    while start < len(sets):
        end, size = start, 0
        while end < len(sets) and (end == start or size + len(sets[end]) <= CHUNK):
            size += len(sets[end])
            end += 1
        x = (np.concatenate(sets[start:end]) >> np.uint64(32)).astype(np.uint32)
        at = np.cumsum([0, *(len(s) for s in sets[start : end - 1])])
        for k in range(BANDS * ROWS):
            out[start:end, k] = np.minimum.reduceat(x * FACTORS[k] + SHIFTS[k], at)
        start = end
    return out


def band_keys(m: np.ndarray) -> np.ndarray:
    """A 64-bit bucket of each band."""
    v = m.astype(np.uint64).reshape(len(m), BANDS, ROWS)
    key = np.arange(BANDS, dtype=np.uint64) * ODD[5]
    for k in range(ROWS):
        key = key + v[:, :, k] * ODD[6 + k]
    return _mixed(key).view(np.int64)


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, same (digest of the set, null if empty), signature (8 bits of each minimum), bands."""

    def make():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            sets = [shingles(x) for x in texts_of(batch)]
            full = [i for i, s in enumerate(sets) if len(s)]
            same: list[bytes | None] = [None] * len(sets)
            signature: list[bytes | None] = [None] * len(sets)
            bands: list[np.ndarray | None] = [None] * len(sets)
            if full:
                m = minima([sets[i] for i in full])
                short, keys = ((m * np.uint32(2654435769)) >> np.uint32(24)).astype(np.uint8), band_keys(m)
                for j, i in enumerate(full):
                    same[i] = xxhash.xxh3_128_digest(sets[i].tobytes())
                    signature[i], bands[i] = short[j].tobytes(), keys[j]
            return pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(same, pa.binary()), pa.array(signature, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                names=["doc_id", "n_shingles", "same", "signature", "bands"],
            )

        return run

    return arrow_map(docs.selectExpr("cast(doc_id as bigint) doc_id", "text"), make, "doc_id long, n_shingles long, same binary, signature binary, bands array<long>")


def shingle_sets(docs: DataFrame) -> DataFrame:
    """doc_id, shingles: the full set as sorted 64-bit numbers."""

    def make():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingles(x).tobytes() for x in texts_of(batch)], pa.binary())], names=["doc_id", "shingles"])

        return run

    return arrow_map(docs.selectExpr("cast(doc_id as bigint) doc_id", "text"), make, "doc_id long, shingles binary")


def _agreeing(pairs: DataFrame) -> DataFrame:
    """a, b of the pairs (a, b, x, y) whose signatures x and y agree often enough."""

    def make():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            width = BANDS * ROWS
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, width) for c in (2, 3))
            share = ((x == y).mean(1) - 1 / 256) / (1 - 1 / 256)
            return batch.select([0, 1]).filter(pa.array(share >= LEAST_AGREEMENT))

        return run

    return arrow_map(pairs.select("a", "b", "x", "y"), make, "a long, b long")


def _confirmed(pairs: DataFrame, percent: int) -> DataFrame:
    """u, v of the pairs (a, b, x, y) whose full sets x and y are similar enough."""

    def make():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            good = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * both >= percent * (len(x) + len(y) - both))
            return batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

        return run

    return arrow_map(pairs.select("a", "b", "x", "y"), make, "a long, b long").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()


def _with_both(pairs: DataFrame, of: DataFrame, column: str, percent: int | None = None) -> DataFrame:
    """Pairs (a, b) with the column's values x and y; percent also asks that the sizes allow the similarity."""
    left = of.select(F.col("doc_id").alias("a"), F.col(column).alias("x"), *([F.col("n_shingles").alias("nx")] if percent else []))
    right = of.select(F.col("doc_id").alias("b"), F.col(column).alias("y"), *([F.col("n_shingles").alias("ny")] if percent else []))
    out = pairs.join(left, "a").join(right, "b")
    if percent:
        out = out.filter(100 * F.least("nx", "ny") >= percent * F.greatest("nx", "ny"))
    return out.select("a", "b", "x", "y")


def connected_components(edges: DataFrame, most_rounds: int = 40) -> DataFrame:
    """node, component (its smallest node) of every node of the edges (u, v), by alternating large-star and small-star."""
    edges = stored(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc-edges")
    state = lambda df: df.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
    before = state(edges)
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*")
        after = stored(small.filter("u <> v").distinct(), "cc-edges")
        forget(edges)
        edges, now = after, state(after)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(nodes.select(F.col("component").alias("node"), "component").distinct())


def rare_pairs(placed: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b: pairs of different components that could be links by a shared shingle and its place; no link is missed.

    Shingles have one order for all documents: first those that no two components share, then by exact count,
    rarest first. Where the first shingle that two documents share stands at places p and q, they share at most
    n - p and m - q. So a document gives a row only for the shingles at which enough can still follow, and a
    row meets only the sizes that its place allows: these are dealt into cells of sizes, and the cell is
    part of the join's key.
    """

    def make():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            blobs = batch.column(2).to_pylist()
            own, key = [np.frombuffer(x, np.int64) for x in blobs], [xxhash.xxh3_64_intdigest(x) >> 1 for x in blobs]
            columns = [pa.array(key, pa.int64()), pa.array(map(len, own), pa.int64()), pa.array(own, pa.list_(pa.int64()))]
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["doc_id", "component", "key", "n", "own"])

        return run

    flat = arrow_map(placed.join(sets, "doc_id").select("doc_id", "component", "shingles"), make, "doc_id long, component long, key long, n long, own array<long>")
    flat = stored(flat.select("doc_id", "component", "key", "n", F.explode("own").alias("shingle")), "neardup-rest")
    often = flat.groupBy("shingle").agg(F.count("*").alias("times"), F.min("component").alias("p"), F.max("component").alias("q")).filter("p <> q").select("shingle", "times")
    own = Window.partitionBy("doc_id", "key")
    ordered = flat.join(often, "shingle").withColumn("at", F.col("n") - F.count("*").over(own) + F.row_number().over(own.orderBy("times", "shingle")) - 1)
    most = F.floor((F.col("n") - F.col("at")) * (100 + percent) / percent).cast("long") - F.col("n")  # the largest partner
    listed = ordered.select("doc_id", "component", "n", "shingle", F.least(most, F.floor(F.col("n") * 100 / percent).cast("long")).alias("most")).filter(100 * F.col("most") >= percent * F.col("n"))
    listed = stored(listed, "neardup-rare")
    cell = lambda n: F.floor(F.log(n) * CELLS).cast("int")
    one, two = (listed.select("shingle", *[F.col(x).alias(x[0] + k) for x in ("doc_id", "component", "n", "most")]) for k in "12")
    one = one.filter("m1 >= n1").withColumn("cell", F.explode(F.sequence(cell("n1"), cell("m1"))))
    fits = (F.col("n2") <= F.col("m1")) & (F.col("n1") <= F.col("m2")) & ((F.col("n1") < F.col("n2")) | ((F.col("n1") == F.col("n2")) & (F.col("d1") < F.col("d2"))))
    pairs = one.join(two.withColumn("cell", cell("n2")), ["shingle", "cell"]).filter(fits & (F.col("c1") != F.col("c2")))
    return pairs.select(F.greatest("d1", "d2").alias("a"), F.least("d1", "d2").alias("b"))


def link_components(docs: DataFrame, signed: DataFrame, percent: int = PERCENT) -> DataFrame:
    """node, component over the representatives of the stored signatures that have a link to another."""
    spark = docs.sparkSession
    first = signed.filter("same is not null and doc_id is not null").groupBy("same").agg(F.min("doc_id").alias("doc_id"))
    reps = signed.join(first, ["same", "doc_id"], "left_semi").select("doc_id", "n_shingles", "signature", "bands")
    members = reps.select("doc_id", F.explode("bands").alias("bucket")).distinct()
    crowded = members.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1").select("bucket")
    members = stored(members.join(crowded, "bucket").select("bucket", "doc_id"), "neardup-members")
    ids = members.select("doc_id").distinct()
    known = stored(reps.select("doc_id", "n_shingles", "signature").join(ids, "doc_id", "left_semi"), "neardup-signatures")
    sets = stored(shingle_sets(docs.selectExpr("cast(doc_id as bigint) doc_id", "text").join(ids, "doc_id", "left_semi")), "neardup-sets")

    def confirm(pairs: DataFrame) -> DataFrame:
        close = stored(_agreeing(_with_both(pairs, known, "signature", percent)).distinct(), "neardup-close")
        return stored(_confirmed(_with_both(close, sets, "shingles"), percent), "neardup-links")

    components = spark.createDataFrame([], "node long, component long")
    links = spark.createDataFrame([], "u long, v long")
    tried = None
    for turn in range(HUB_ROUNDS + 1):
        placed = members.join(components, members["doc_id"] == components["node"], "left").select("bucket", "doc_id", F.coalesce("component", "doc_id").alias("component"))
        if turn:
            mixed = placed.groupBy("bucket").agg(F.min("component").alias("p"), F.max("component").alias("q")).filter("p <> q").select("bucket")
            placed = stored(placed.join(mixed, "bucket"), "neardup-mixed")
            if placed.isEmpty():
                break
        if turn < HUB_ROUNDS:
            if turn:
                degree = links.select(F.explode(F.array("u", "v")).alias("doc_id")).groupBy("doc_id").agg(F.count("*").alias("degree"))
                ranked = placed.join(degree, "doc_id", "left").withColumn("rank", F.struct(F.coalesce("degree", F.lit(0)).alias("d"), F.xxhash64("doc_id", F.lit(turn)).alias("h")))
                hubs = ranked.groupBy("bucket").agg(F.max_by("doc_id", "rank").alias("hub"), F.max_by("component", "rank").alias("of"))
            else:
                hubs = placed.groupBy("bucket").agg(F.min("doc_id").alias("hub"), F.min("doc_id").alias("of"))
            pairs = placed.join(hubs, "bucket").filter("component <> of")
            pairs = pairs.select(F.greatest("doc_id", "hub").alias("a"), F.least("doc_id", "hub").alias("b"))
        else:
            pairs = rare_pairs(placed.select("doc_id", "component").distinct(), sets, percent)
        pairs = pairs.distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = stored(pairs, "neardup-pairs")
        tried = pairs if tried is None else tried.unionByName(pairs)
        fresh = confirm(pairs)
        if not fresh.isEmpty():
            links = links.unionByName(fresh)
            components = stored(connected_components(components.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(fresh)), "neardup-components")
    return components


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document."""
    signed = stored(signatures(docs), "neardup-minhash")
    components = link_components(docs, signed, percent)
    groups = signed.filter("same is not null and doc_id is not null").groupBy("same").agg(F.min("doc_id").alias("rep"), F.count("*").alias("many"))
    where = groups.join(components, groups["rep"] == components["node"], "left").filter("many > 1 or component is not null")
    where = where.select("same", F.coalesce("component", "rep").alias("component"), F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))).alias("share"))
    shared = signed.select("doc_id", "n_shingles", "same", F.pmod(F.xxhash64("doc_id"), F.lit(SHARES)).cast("int").alias("share"))
    out = shared.join(where, ["same", "share"], "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def drop_near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One document of each component (that with the smallest doc_id, once), with all its columns."""
    kept = near_duplicates(docs, percent).filter("kept").select(F.col("doc_id").alias("_kept"))
    return docs.join(kept, docs["doc_id"].cast("long").eqNullSafe(kept["_kept"]), "left_semi").dropDuplicates(["doc_id", "text"])


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
