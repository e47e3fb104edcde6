"""Quality rules: statistics of every text and a learned decision list (operator 4).

Every text gets counts (words, symbols, repeated lines, words in repeated windows of three and so
on). A fixed base rule rejects very short and very repetitive texts. For the rest a decision list is
learned by sequential covering from labelled documents (at most max_labelled, a documented bound):
each rule is a conjunction of thresholds, grown on two thirds of the sample by the information it
gains about low quality, pruned on the other third, and kept while it is right often enough; what
it covers is taken away before the next is grown. The list becomes one ordered conditional
expression over the statistics, which Spark evaluates.

A null or empty text has no words, so the base rule rejects it. Without labels of both kinds the
list is empty and only the base rule decides. Repeated rows are judged alike. drop_low_quality
leaves every column of its input as it is, whatever its name.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_map, labelled_sample, table, texts_of

MAX_LABELLED = 20_000
MIN_WORDS = 50
#: Characters that count as symbols.
SYMBOLS = b"#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_upper", "n_digits", "n_marks", "n_words_upper")
#: Statistics the rules may use: name, numerator, denominator.
RATIOS = (
    ("mean_word_chars", "word_chars", "n_words"),
    ("symbols_per_word", "n_symbols", "n_words"),
    ("dup_line_share", "n_dup_lines", "n_lines"),
    ("repeat_word_share", "n_repeat_words", "n_words"),
    ("distinct_share", "n_distinct", "n_words"),
    ("upper_share", "n_upper", "word_chars"),
    ("upper_word_share", "n_words_upper", "n_words"),
    ("digit_share", "n_digits", "word_chars"),
    ("marks_per_word", "n_marks", "n_words"),
    ("words_per_line", "n_words", "n_lines"),
)
DIGITS, UPPER = b"0123456789", bytes(range(65, 91))


def repeat_words(words: list[bytes]) -> int:
    """Words that lie in a window of three words found at least twice."""
    n = len(words)
    if n < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter([number.setdefault(w, len(number)) for w in words], np.int64, n)
    pair = ids[:-1] * len(number) + ids[1:]
    if len(number) > 1_000_000:
        pair = np.unique(pair, return_inverse=True)[1]
    window = pair[:-1] * len(number) + ids[2:]
    order = np.argsort(window, kind="stable")
    same = np.diff(window[order]) == 0
    if not same.any():
        return 0
    repeated = np.zeros(n - 2, bool)
    repeated[order[:-1][same]] = True
    repeated[order[1:][same]] = True
    inside = np.zeros(n, bool)
    for k in range(3):
        inside[k : n - 2 + k] |= repeated
    return int(inside.sum())


def counts_of(text: str) -> tuple[int, ...]:
    raw = text.encode("utf-8", "replace")
    words = raw.split()
    joined = b"".join(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    drop = lambda chars: len(joined) - len(joined.translate(None, chars))
    distinct = set(words)
    return (
        len(words), len(text) - (len(raw) - len(joined)), drop(SYMBOLS), len(lines) - len(set(lines)), repeat_words(words),
        len(lines), len(distinct), drop(UPPER), drop(DIGITS), drop(b"!?"), sum(map(bytes.isupper, words)),
    )


def text_counts(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns named in keep, and the counts of every text."""
    names = ["doc_id", *keep, *COUNTS]
    kept = [docs.schema[c] for c in keep]

    def make():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = [counts_of(x) for x in texts_of(batch)]
            columns = zip(*rows) if rows else [()] * len(COUNTS)
            return pa.RecordBatch.from_arrays([batch.column(0), *(batch.column(2 + i) for i in range(len(kept))), *(pa.array(c, pa.int64()) for c in columns)], names=names)

        return run

    schema = "doc_id long, " + "".join(f"{f.name} {f.dataType.simpleString()}, " for f in kept) + ", ".join(f"{c} long" for c in COUNTS)
    return arrow_map(docs.selectExpr("cast(doc_id as bigint) doc_id", "text", *(f"`{c}`" for c in keep)), make, schema)


def base_failed() -> Column:
    """Fewer than MIN_WORDS words, or more than half of them in repeated windows."""
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


@dataclass(frozen=True)
class Rule:
    """A conjunction of (statistic, is_at_least, threshold) and its precision on the pruning sample."""

    tests: tuple[tuple[str, bool, float], ...]
    precision: float

    def column(self) -> Column:
        return reduce(lambda a, b: a & b, [(statistic(s) >= t) if up else (statistic(s) <= t) for s, up, t in self.tests])

    def covers(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return np.logical_and.reduce([(x[s] >= t) if up else (x[s] <= t) for s, up, t in self.tests])

    def __str__(self) -> str:
        return " and ".join(f"{s} {'>=' if up else '<='} {t:.6g}" for s, up, t in self.tests)


def statistic(name: str) -> Column:
    top, bottom = next((a, b) for s, a, b in RATIOS if s == name)
    return F.when(F.col(bottom) > 0, F.col(top) / F.col(bottom)).otherwise(F.lit(0.0))


def statistics(counts: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    return {s: np.divide(counts[a], counts[b], out=np.zeros(len(counts[a])), where=counts[b] > 0) for s, a, b in RATIOS}


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, max_tests: int) -> tuple:
    """Add the test that gains most information until no good document is covered."""
    inside, tests = np.ones(len(bad), bool), []
    while len(tests) < max_tests and bad[inside].any() and not bad[inside].all():
        p0, n0 = bad[inside].sum(), inside.sum()
        best = (0.0, None)
        for s, values in x.items():
            own = values[inside]
            order = np.argsort(own, kind="stable")
            v, b = own[order], np.cumsum(bad[inside][order])
            ends = np.flatnonzero(np.diff(v) > 0)  # cut between v[i] and v[i + 1]
            if not len(ends):
                continue
            cut = (v[ends] + v[ends + 1]) / 2
            for up, p, n in ((False, b[ends], ends + 1), (True, p0 - b[ends], n0 - ends - 1)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(p > 0, p * (np.log2(p / n) - np.log2(p0 / n0)), 0.0)
                k = int(np.argmax(gain))
                if gain[k] > best[0] + 1e-12:
                    best = (float(gain[k]), (s, up, float(cut[k])))
        if best[1] is None:
            break
        tests.append(best[1])
        s, up, t = best[1]
        inside &= (x[s] >= t) if up else (x[s] <= t)
    return tuple(tests)


def _prune(tests: tuple, x: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    """Drop last tests while (right - wrong) / covered on the pruning sample does not fall."""

    def worth(k: int) -> tuple[float, float]:
        inside = Rule(tests[:k], 0).covers(x)
        p, n = bad[inside].sum(), (~bad)[inside].sum()
        return ((p - n) / (p + n) if p + n else -1.0, p / (p + n) if p + n else 0.0)

    keep = max(range(1, len(tests) + 1), key=lambda k: (worth(k)[0], -k))
    return Rule(tests[:keep], float(worth(keep)[1]))


def learn_rules(counts: dict[str, np.ndarray], bad: np.ndarray, max_rules: int = 12, max_tests: int = 4, least_precision: float = 0.8) -> list[Rule]:
    """Sequential covering; an empty list if the labels do not have both values."""
    x, rules = statistics(counts), []
    third = np.arange(len(bad)) % 3 == 2
    left = np.ones(len(bad), bool)
    while len(rules) < max_rules:
        grow, prune = left & ~third, left & third
        if bad[grow].sum() < 3 or bad[grow].all():
            break
        tests = _grow({s: v[grow] for s, v in x.items()}, bad[grow], max_tests)
        if not tests:
            break
        rule = _prune(tests, {s: v[prune] for s, v in x.items()}, bad[prune])
        inside = rule.covers(x) & left
        if rule.precision < least_precision or not inside.any():
            break
        rules.append(rule)
        left &= ~inside
    return rules


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> list[Rule]:
    """Rules from the labelled documents that the base rule keeps."""
    sample = labelled_sample(docs, labels, "quality", max_labelled)
    got = text_counts(sample, keep=("label",)).toArrow()
    got = got.sort_by([("doc_id", "ascending"), *((c, "ascending") for c in ("label", *COUNTS))])
    counts = {c: got[c].to_numpy() for c in COUNTS}
    bad = got["label"].to_numpy() == 0
    passes = (counts["n_words"] >= MIN_WORDS) & (100 * counts["n_repeat_words"] <= 50 * counts["n_words"])
    return learn_rules({c: v[passes] for c, v in counts.items()}, bad[passes])


def verdict(rules: list[Rule]) -> Column:
    """kept, as one ordered conditional expression: the base rule, then the learned ones, then yes."""
    out = F.when(base_failed(), F.lit(False))
    for rule in rules:
        out = out.when(rule.column(), F.lit(False))
    return out.otherwise(F.lit(True))


def quality_rules(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """The counts and verdict of every document, in one scan."""
    counted = text_counts(docs)
    which = F.when(base_failed(), F.lit("base"))
    for rule in rules:
        which = which.when(rule.column(), F.lit(str(rule)))
    return counted.withColumn("base_failed", base_failed()).withColumn("kept", verdict(rules)).withColumn("rule", which)


def drop_low_quality(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """The documents that the rules keep, with all their columns."""
    names = [f"_quality_{c}" for c in COUNTS]
    schema = docs.schema
    for c in names:
        schema = type(schema)([*schema.fields]).add(c, "long")

    def make():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = [counts_of(x) for x in texts_of(batch)]
            columns = zip(*rows) if rows else [()] * len(COUNTS)
            return pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, pa.int64()) for c in columns)], names=[*batch.schema.names, *names])

        return run

    counted = arrow_map(docs, make, schema)
    inner = F.struct(*[F.col(f"_quality_{c}").alias(c) for c in COUNTS])
    flat = counted.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_quality_row"), inner.alias("_quality_counts")).select("_quality_row", "_quality_counts.*")
    return flat.filter(verdict(rules)).select("_quality_row.*")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = quality_rules(docs, train(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")
