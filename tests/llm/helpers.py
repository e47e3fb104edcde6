"""Small inputs with the awkward cases: nulls, empty and very long texts, ties, repeated rows, clashing columns."""

import pytest

pytest.importorskip("tidemark.llm")

LONG = " ".join(f"word{i % 997} and {i}" for i in range(9000))


def odd_docs(spark, more=()):
    """Columns that operators use for themselves must not get in their way."""
    rows = [
        (1, "The quick brown fox jumps over the lazy dog. " * 12, "en", "s", 1), (2, None, "en", "s", 0), (3, "", "de", None, 0), (4, " \n\t ", None, "s", 4), (5, LONG, "en", "s", len(LONG)),
        (6, "x" * 30000, "fr", "s", 30000), (7, "tie tie", "en", "s", 7), (8, "tie tie", "en", "s", 7), (8, "tie tie", "en", "s", 7), (9, "émigré 漢字 \U0001f600 straße", "fr", "s", 20), *more,
    ]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return d.selectExpr("*", "1 as score", "'k' as kept", "2L as n_words", "3L as length", "array(1) as spans")


def no_docs(spark):
    return odd_docs(spark).filter("false")
