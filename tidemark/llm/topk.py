"""Exact top-k by inner product with Fagin's threshold algorithm (operator 6).

Vectors are dealt to blocks by a hash of their id; a block holds, for each dimension, its vectors
sorted by that dimension (ties by id). A query walks these lists from the end that its own sign
favours, all to the same depth, and scores what it meets. No vector that it has not met can score
more than the sum of the values at that depth; when that bound is below the k-th best score, the
walk ends. The bound must be strictly below, as a tie may have a smaller id. One block is searched
first: its k-th best scores are the floors that the walks of all blocks begin with, so a block that
holds nothing good for a query is left early. Queries meet every block, in groups of bounded size; the
blocks' winners are merged by a window. Nothing is broadcast and no pair table is made.

Components are floor(256 x) of the component as a double. Vectors that are null, empty or hold null
or non-finite components take no part. A shorter vector counts as followed by zeros. Rows that
share an id are candidates each, but never for a query with that id; queries that share an id share
one list of results. An empty table gives an empty result. Only the id and the vector are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import table

BLOCK_ROWS, QUERY_ROWS, LEAST_BLOCKS = 8192, 16_384, 32
#: Largest integer below which sums of products are exact in doubles.
EXACT = float(1 << 53)


class Block:
    """Sorted lists of one block's integer vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors  # by id
        self.order = np.argsort(-vectors, axis=0, kind="stable")  # n x d, largest first, ties by id
        self.values = np.take_along_axis(vectors, self.order, axis=0)

    def search(self, query: np.ndarray, own: int, k: int, floor: float | None = None) -> tuple[np.ndarray, np.ndarray, int]:
        """ids and scores of the k best that reach the floor, ties to the smaller id; also how many vectors were scored."""
        n = len(self.ids)
        up, down = np.flatnonzero(query > 0), np.flatnonzero(query < 0)
        depth, met = 32, np.zeros(n, bool)
        scores = np.full(n, -np.inf, self.vectors.dtype)
        while True:
            depth = min(depth, n)
            now = np.zeros(n, bool)
            now[self.order[:depth, up]] = True
            now[self.order[n - depth :, down]] = True
            if depth == n:
                now[:] = True
            fresh = np.flatnonzero(now & ~met)
            scores[fresh] = self.vectors[fresh] @ query
            met |= now
            if met.all():
                break
            bound = self.values[depth - 1, up] @ query[up] + self.values[n - depth, down] @ query[down]
            if floor is not None and floor > bound:
                break
            got = scores[met & (self.ids != own)]
            if len(got) >= k and np.partition(got, len(got) - k)[len(got) - k] > bound:
                break
            depth *= 2
        scores[self.ids == own] = -np.inf
        best = np.argsort(-scores, kind="stable")[:k]  # stable and by id: ties to the smaller id
        best = best[np.isfinite(scores[best].astype(float))]
        if floor is not None:
            best = best[scores[best] >= floor]
        return self.ids[best], scores[best], int(met.sum())


def _matrix(rows: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray]:
    """ids, ascending, and their vectors as whole doubles."""
    ids, lists = rows["vec_id"].to_numpy(), rows["embedding"].to_pylist()
    order = sorted(range(len(ids)), key=lambda i: (ids[i], lists[i]))
    out = np.zeros((len(order), width))
    for j, i in enumerate(order):
        out[j, : len(lists[i])] = lists[i]
    return ids[order], np.floor(256.0 * out)


def search_block(candidates: pa.Table, queries: pa.Table, k: int) -> pa.Table:
    """The k best of this block for each query."""
    out = ([], [], [])
    if len(candidates) and len(queries):
        width = max(max(map(len, t["embedding"].to_pylist())) for t in (candidates, queries))
        ids, vectors = _matrix(candidates, width)
        own, asked = _matrix(queries, width)
        if width * np.abs(vectors).max() * np.abs(asked).max() >= EXACT:
            vectors, asked = _whole(vectors), _whole(asked)
        block = Block(ids, vectors)
        floors = dict(zip(queries["vec_id"].to_pylist(), queries["floor"].to_pylist()))
        for q, query in zip(own.tolist(), asked):
            got, scores, _ = block.search(query, q, k, floors[q])
            out[0].extend([q] * len(got))
            out[1].extend(got.tolist())
            out[2].extend(max(-(1 << 63), min((1 << 63) - 1, int(x))) for x in scores)
    return pa.table({"query_id": pa.array(out[0], pa.int64()), "vec_id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.int64())})


def _whole(x: np.ndarray) -> np.ndarray:
    """Python integers, for components whose products do not fit a double (scores are held inside a long)."""
    return np.frompyfunc(int, 1, 1)(x)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score. Both inputs have vec_id and embedding."""
    usable = lambda df: df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).filter(
        F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    )
    candidates, asked = usable(vectors), usable(queries)
    n, q = candidates.count(), asked.count()
    blocks, groups = max(LEAST_BLOCKS, -(-n // BLOCK_ROWS)), max(1, -(-q // QUERY_ROWS))
    hashed = lambda m: F.pmod(F.xxhash64("vec_id"), F.lit(m)).cast("int")
    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        return search_block(a, b, k)

    def searched(rows: DataFrame, wanted: DataFrame, among: int) -> DataFrame:
        left = rows.withColumn("_group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
        right = wanted.withColumn("_group", hashed(groups)).withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(among - 1))))
        found = left.groupBy("_block", "_group").cogroup(right.groupBy("_block", "_group")).applyInArrow(run, "query_id long, vec_id long, score long")
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        return found.withColumn("rank", rank).filter(F.col("rank") <= k)

    dealt = candidates.withColumn("_block", hashed(blocks))
    none = F.lit(None).cast("double")
    first = searched(dealt.filter("_block = 0"), asked.withColumn("floor", none), 1)
    floors = first.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").cast("double").alias("floor")).filter((F.col("n") >= k) & (F.abs("floor") < EXACT)).select(F.col("query_id").alias("vec_id"), "floor")
    floored = asked.join(floors, "vec_id", "left")
    return searched(dealt, floored, blocks).select("query_id", "rank", "vec_id", "score")


def op6_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.filter("vec_id % 50 = 0"))


ORACLE_SQL = """
WITH usable AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
    WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
    SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
    FROM usable q JOIN usable c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
ranked AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5"""
