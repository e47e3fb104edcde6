"""Toxicity scores from a factorization machine over hashed terms (operator 8).

Terms are the words of a text and their first four and five letters, hashed; a term counts once
however often it occurs. A factorization machine learns a weight for each term and a short vector
whose inner products weigh pairs of terms, so that an insult next to a group's name can count for
more than both do alone. The machine is fitted on at most max_labelled labelled documents of the
training share (a documented bound; the sample is the smallest hashes of doc_id); it takes the
terms that speak most for or against the label. Every text is scored whole, in one scan.

Labels, language, source and doc_id are no inputs of a score. Null and empty texts have no terms and
get the bias's score. Without usable labels, or with one label only, the score is that share for
every text. Repeated rows give repeated rows; a doc_id that is null is not held out.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_filter, arrow_map, held_out, labelled_sample, table, texts_of, trim

BUCKETS = 1 << 22
MAX_LABELLED = 16_000
MAX_TERMS = 4096
THRESHOLD = 0.3
MEMO = 250_000
LETTERS = regex.compile(r"\p{L}+")


def terms_of(run: bytes) -> list[int]:
    """Hashed terms of what stands between two white spaces."""
    out = []
    for word in LETTERS.findall(run.decode("utf-8", "replace").lower()):
        out.append(zlib.crc32(b"w" + word.encode()) % BUCKETS)
        for n in (4, 5):
            if len(word) >= n:
                out.append(zlib.crc32(b"%d" % n + word[:n].encode()) % BUCKETS)
    return out


def runs_of(text: str) -> set[bytes]:
    return set(text.encode("utf-8", "replace").split())


class Memo(dict):
    """Terms by run. A full memo stays as it is: common runs come early."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, run):
        got = self.make(run)
        if len(self) < MEMO:
            self[run] = got
        return got


@dataclass
class Machine:
    """bias, weight of each term, vectors of each term; slot gives a term's place."""

    bias: float
    terms: np.ndarray
    weights: np.ndarray
    vectors: np.ndarray

    def scorer(self):
        slot = {int(t): i for i, t in enumerate(self.terms)}
        memo = Memo(lambda run: tuple(slot[t] for t in terms_of(run) if t in slot))
        weights, vectors, squares = self.weights, self.vectors, self.vectors**2

        def score(text: str) -> float:
            own: set[int] = set()
            for got in map(memo.__getitem__, runs_of(text)):
                if got:
                    own.update(got)
            z = self.bias
            if own:
                at = np.fromiter(sorted(own), np.int64, len(own))
                v = vectors[at].sum(0)
                z += weights[at].sum() + 0.5 * (v @ v - squares[at].sum())
            return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))

        return score


def choose_terms(docs: list[np.ndarray], labels: np.ndarray, max_terms: int) -> np.ndarray:
    """The terms in at least three documents whose chi-square with the label is largest; a document names a term once, and labels are 0 or 1."""
    seen = np.zeros((2, max((int(x.max()) + 1 for x in docs if len(x)), default=0)), np.int32)  # all, labelled
    for x, y in zip(docs, labels):
        seen[0][x] += 1
        if y:
            seen[1][x] += 1
    terms = np.flatnonzero(seen[0])
    df, pos = seen[:, terms].astype(float)
    n, p = len(labels), labels.mean()
    expected = df * p
    chi = (pos - expected) ** 2 / np.maximum(expected * (1 - p) * (1 - df / n), 1e-9)
    good = (df >= 3) & (chi > 6.6) & (df < n)
    order = np.lexsort((terms[good], -chi[good]))[:max_terms]
    return np.sort(terms[good][order])


def fit(docs: list[np.ndarray], labels: np.ndarray, factors: int = 4, epochs: int = 30, rate: float = 0.1, l2: float = 1e-4, max_terms: int = MAX_TERMS) -> Machine:
    """Minibatch Adagrad on the logistic loss; docs are the hashed terms of each document."""
    share = float(labels.mean()) if len(labels) else 0.0
    share = min(max(share, 1e-6), 1 - 1e-6)
    bias = np.log(share / (1 - share))
    terms = choose_terms(docs, labels.astype(float), max_terms) if len(labels) and 0 < labels.mean() < 1 else np.zeros(0, np.int64)
    m = len(terms)
    rng = np.random.default_rng(8)
    w, v = np.zeros(m), rng.normal(0, 0.01, (m, factors))
    if not m:
        return Machine(bias, terms, w, v)
    active = []
    for x in docs:
        at = np.searchsorted(terms, x)
        at[at == m] = 0
        active.append(at[terms[at] == x])
    gw, gv, gb = np.full(m, 1e-6), np.full((m, factors), 1e-6), 1e-6
    y = labels.astype(float)
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for start in range(0, len(y), 256):
            batch = order[start : start + 256]
            own = [active[i] for i in batch]
            size = np.array([len(a) for a in own])
            flat = np.concatenate(own)
            row = np.repeat(np.arange(len(batch)), size)
            sums = np.zeros((len(batch), factors))
            np.add.at(sums, row, v[flat])
            pair = 0.5 * ((sums**2).sum(1) - np.bincount(row, (v[flat] ** 2).sum(1), len(batch)))
            z = bias + np.bincount(row, w[flat], len(batch)) + pair
            d = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y[batch]) / len(batch)
            dw = np.bincount(flat, d[row], m) + l2 * w
            dv = np.zeros((m, factors))
            np.add.at(dv, flat, d[row, None] * (sums[row] - v[flat]))
            dv += l2 * v
            db = d.sum()
            gw += dw**2
            gv += dv**2
            gb += db**2
            w -= rate * dw / np.sqrt(gw)
            v -= rate * 0.2 * dv / np.sqrt(gv)
            bias -= rate * db / np.sqrt(gb)
    return Machine(float(bias), terms, w, v)


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Machine:
    """Fit on labelled documents outside the held-out share."""

    def make():
        memo = Memo(lambda run: tuple(terms_of(run)))

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = []
            for text in texts_of(batch):
                own: set[int] = set()
                own.update(*map(memo.__getitem__, runs_of(text)))
                out.append(np.fromiter(sorted(own), np.int32, len(own)).tobytes())
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(out, pa.binary())], names=["doc_id", "label", "terms"])

        return run

    sample = labelled_sample(docs, labels, "toxic", max_labelled, lambda c: ~held_out(c, 4))
    got = arrow_map(sample, make, "doc_id long, label int, terms binary").toArrow().sort_by([("doc_id", "ascending"), ("label", "ascending"), ("terms", "ascending")])
    rows = [np.frombuffer(x.as_buffer(), np.int32) for x in got["terms"]]
    machine = fit(rows, (np.array(got["label"].to_pylist(), dtype=np.int64) > 0).astype(np.int64))
    del got, rows
    trim()
    return machine


def toxicity_scores(docs: DataFrame, machine: Machine, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    send = docs.sparkSession.sparkContext.broadcast(machine)  # at most MAX_TERMS terms

    def make():
        score = send.value.scorer()

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array([score(x) for x in texts_of(batch)], pa.float64())], names=["doc_id", "score"])

        return run

    scored = arrow_map(docs.selectExpr("cast(doc_id as bigint) doc_id", "text"), make, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id"), 4).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """The documents that score below the threshold, with all their columns; all of them if nothing could be learned."""
    machine = train(docs, labels, max_labelled)
    if not len(machine.terms):
        return docs
    send = docs.sparkSession.sparkContext.broadcast(machine)

    def make():
        score = send.value.scorer()
        return lambda batch: [score(x) < threshold for x in texts_of(batch)]

    return arrow_filter(docs, make)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity_scores(docs, train(docs, table(spark, sf_dir, "labels")))
