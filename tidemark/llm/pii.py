"""Personal data by weak supervision (operator 2), with DataFrame functions only.

Candidates come from regular expressions: the four base kinds (email, ip, card, phone; a match that
fails its check is dropped and never retried) and the further kinds obfuscated email, national
phone, social security number, IBAN and credential. A start is the length of what split() leaves
before a match, so everything stays in the JVM.

Labelers vote yes, no or nothing on each candidate: format (the strict form of its kind), gazetteer
(top-level domains, calling codes, card prefixes, country codes, reserved addresses), context
(words of contact or of versions and numbering before it), edges (does it stand alone) and shape
(repeated or counting digits). Only the number of candidates for each pattern of votes reaches the
driver, at most 3^5 for each kind. There expectation-maximisation estimates how reliable each
labeler is and how likely each pattern is to be personal, and a logistic span classifier is fitted
to those expectations; it becomes a Spark expression. Base spans stay whatever it says; of the
other kinds the classifier's yes counts.

Null and empty texts have no spans, an empty table gives an empty result. Starts and ends are code points, the end exclusive. Repeated
rows are judged alike; columns other than doc_id and text are not read (redact keeps them as they
are). Patterns are possessive and start only where a run starts, so very long runs take linear time.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import stored, table

#: Kinds in the order in which spans with the same start are listed; the first four are the base.
KINDS = ("email", "ip", "card", "phone", "obfuscated", "national", "ssn", "iban", "secret")
BASE = 4

EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[ -]?[0-9]){13,}+"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
OBFUSCATED = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?: ?[(\[{] ?at ?[)\]}] ?| at )[A-Za-z0-9-]++(?:(?: ?[(\[{] ?dot ?[)\]}] ?| dot )[A-Za-z0-9-]++){1,32}+"
NATIONAL = r"(?<![0-9+(.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9-])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
SECRET = r"(?i)(?<![a-z0-9])(?:token|secret|password|passwd|api[_-]?key|access[_-]?key)\"? ?[:=] ?\"?[A-Za-z0-9+/_=-]{16,}+\"?"

#: Fixed word lists of the labelers.
TOP_LEVEL = r"(?i)(?:com|org|net|edu|gov|mil|int|info|biz|io|co|me|ai|app|dev|eu|de|fr|es|it|nl|uk|us|ca|ch|at|be|pl|se|no|dk|fi|pt|ru|cn|jp|kr|in|br|mx|au|nz|za|ie|cz)"
CALLING = r"(?:1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|2[1-9][0-9]|3[578][0-9]|42[0-9]|5[09][0-9]|6[789][0-9]|8[058][0-9]|9[679][0-9])"
CARD_PREFIX = r"(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5|4[4-9])|3[0689]|35)"
RESERVED_IP = r"(?:0|127|255|22[4-9]|23[0-9])\."
COUNTRIES = r"(?:AD|AE|AT|BE|BG|CH|CY|CZ|DE|DK|EE|ES|FI|FR|GB|GR|HR|HU|IE|IT|LI|LT|LU|LV|MC|MT|NL|NO|PL|PT|RO|SE|SI|SK)"
FOR_CONTEXT = r"(?i)(?:mail|contact|reach|write|phone|tel|call|mobile|fax|ring|dial|number|card|visa|credit|account|iban|bank|ssn|social|security|address|host|server|ip|login|user|token|secret|password|key|name)\b[^\n]{0,12}$"
AGAINST_CONTEXT = r"(?i)(?:version|release|v|section|chapter|figure|table|isbn|issn|doi|page|part|model|serial|order|sku)[ .:#]{0,3}$"


def _spans(text: Column, pattern: str, kind: int, guard: Column | None = None) -> tuple[Column, Column]:
    """(matches, lengths of what lies between them); the second scan is made only where there are matches."""
    none = F.array().cast("array<string>")
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return (found if guard is None else F.when(guard, found).otherwise(none)), F.split(text, pattern, -1)


def _located(matches: Column, between: Column, kind: Column) -> Column:
    """Structs (start, kind, end, said) of the matches."""
    kind_of = "array<struct<start:int,kind:int,end:int,said:string>>"
    pairs = F.arrays_zip(matches.alias("m"), between.alias("p"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(kind_of).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        at, end = acc["at"] + x["p"], acc["at"] + x["p"] + F.length(x["m"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(at.alias("start"), kind.alias("kind"), end.alias("end"), x["m"].alias("said")))).alias("out"))

    located = F.aggregate(F.slice(pairs, F.lit(1), F.size(matches)), start, step, lambda a: a["out"])
    return F.when(F.size(matches) > 0, located).otherwise(F.array().cast(kind_of))


def _digits(said: Column) -> Column:
    return F.regexp_replace(said, "[^0-9]", "")


def _luhn(said: Column) -> Column:
    """True if the digits' Luhn sum is a multiple of ten; the last digit counts once, the one before it twice."""
    d = _digits(said)

    def step(acc: Column, i: Column) -> Column:
        x = F.ascii(F.substr(d, F.length(d) - i, F.lit(1))) - 48
        twice = x * 2 - F.when(x > 4, 9).otherwise(0)
        return (acc + F.when(i % 2 == 1, twice).otherwise(x)).cast("int")

    return F.aggregate(F.sequence(F.lit(0), F.length(d) - 1), F.lit(0), step) % 10 == 0


def _valid(x: Column) -> Column:
    """The base kinds' checks; further kinds have none."""
    d = F.length(_digits(x["said"]))
    part = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9][0-9]?)?"
    return (
        F.when(x["kind"] == 1, x["said"].rlike(rf"^{part}\.{part}\.{part}\.{part}$"))
        .when(x["kind"] == 2, d.between(14, 19) & _luhn(x["said"]))
        .when(x["kind"] == 3, d.between(10, 15))
        .otherwise(F.lit(True))
    )


def candidates(docs: DataFrame, keep: bool = False) -> DataFrame:
    """doc_id (with keep: every column, in the struct _row), _text, base and more: arrays of (start, kind, end, said)."""
    first = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")] if keep else [F.col("doc_id").cast("long").alias("doc_id")]
    names = ["_row" if keep else "doc_id", "_text"]
    out = docs.select(*first, F.coalesce(F.col("text"), F.lit("")).alias("_text"))
    text = F.col("_text")
    has = lambda *words: F.lower(text).rlike("|".join(words)) if len(words) > 1 else F.contains(text, F.lit(words[0]))
    kinds = {
        0: (EMAIL, has("@")), 1: (IP, has(".")), 2: (CARD, None), 3: (PHONE, has("+")), 4: (OBFUSCATED, has("dot")),
        5: (NATIONAL, None), 6: (SSN, has("-")), 7: (IBAN, None), 8: (SECRET, F.contains(text, F.lit("=")) | F.contains(text, F.lit(":"))),
    }
    out = out.select(*names, *[_spans(text, p, k, g)[0].alias(f"m{k}") for k, (p, g) in kinds.items()])
    located = [
        F.filter(_located(F.col(f"m{k}"), F.when(F.size(f"m{k}") > 0, F.transform(_spans(text, p, k)[1], F.length)), F.lit(k)), _valid).alias(f"s{k}")
        for k, (p, _) in kinds.items()
    ]
    out = out.select(*names, *located)
    out = out.select(*names, F.array_sort(F.concat(*[f"s{k}" for k in range(BASE)])).alias("base"), F.array_sort(F.concat(*[f"s{k}" for k in range(BASE, len(KINDS))])).alias("_more"))
    apart = lambda x: ~F.exists("base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))
    return out.select(*names, "base", F.filter("_more", apart).alias("more"))


def votes(text: Column, x: Column) -> Column:
    """x with the votes of five labelers: 1 yes, 0 no, -1 nothing."""
    said, kind = x["said"], x["kind"]
    d = _digits(said)
    before = F.substring(text, F.greatest(x["start"] - 31, F.lit(1)), F.least(x["start"], F.lit(32)))
    after = F.substring(text, x["end"] + 1, F.lit(1))
    yes_no = lambda c: F.when(c, 1).otherwise(0)
    strict = (
        F.when(kind == 0, yes_no(said.rlike(r"^[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9][A-Za-z0-9.-]*\.[A-Za-z]{2,}$")))
        .when(kind == 1, yes_no(said.rlike(r"^(?:0|[1-9][0-9]{0,2})(?:\.(?:0|[1-9][0-9]{0,2})){3}$")))
        .when(kind == 2, yes_no(said.rlike(r"^[0-9]{14,19}$|^[0-9]{4}(?:[ -][0-9]{4}){3}$")))
        .when(kind == 3, yes_no(said.rlike(r"^\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?(?:[ .-]?[0-9]{2,4}){1,4}$")))
        .when(kind == 5, yes_no(said.rlike(r"^\([2-9][0-9]{2}\) ?[0-9]{3}-[0-9]{4}$|^[2-9][0-9]{2}([ .-])[0-9]{3}\1[0-9]{4}$")))
        .when(kind == 6, yes_no(~said.rlike(r"^(?:000|666|9)|-00-|-0000$")))
        .when(kind == 8, yes_no(said.rlike(r"[0-9]") & said.rlike(r"[A-Za-z0-9+/_-]{20}")))
        .otherwise(-1)
    )
    listed = (
        F.when(kind.isin(0, 4), yes_no(said.rlike(rf"[. )\]]{TOP_LEVEL}$")))
        .when(kind == 1, F.when(said.rlike(f"^{RESERVED_IP}"), 0).otherwise(-1))
        .when(kind == 2, yes_no(d.rlike(f"^{CARD_PREFIX}")))
        .when(kind == 3, yes_no(d.rlike(f"^{CALLING}")))
        .when(kind == 7, yes_no(said.rlike(f"^{COUNTRIES}")))
        .otherwise(-1)
    )
    context = F.when(before.rlike(AGAINST_CONTEXT), 0).when(before.rlike(FOR_CONTEXT), 1).otherwise(-1)
    edges = F.when(after.rlike("^[A-Za-z0-9@]") | before.rlike("[A-Za-z0-9@]$"), 0).otherwise(1)
    shape = F.when(F.length(d) >= 9, F.when(d.rlike(r"(\d)\1{6}|0123456|1234567|9876543"), 0).otherwise(1)).otherwise(-1)
    return F.struct(x["start"].alias("start"), kind.alias("kind"), x["end"].alias("end"), F.array(strict, listed, context, edges, shape).cast("array<int>").alias("v"))


def voted(docs: DataFrame, keep: bool = False) -> DataFrame:
    """candidates() with the votes of each span instead of its text."""
    found = candidates(docs, keep)
    text = F.col("_text")
    return found.select(*found.columns[: 1 + keep], *[F.transform(c, lambda x: votes(text, x)).alias(c) for c in ("base", "more")])


def vote_counts(spans: DataFrame) -> list[tuple[int, tuple[int, ...], int]]:
    """(kind, votes, number of candidates), one for each pattern that occurs."""
    one = spans.select(F.explode(F.concat("base", "more")).alias("x")).select(F.col("x.kind").alias("kind"), F.col("x.v").alias("v"))
    rows = one.groupBy("kind", "v").count().collect()
    return sorted((r["kind"], tuple(r["v"]), r["count"]) for r in rows)


def reliabilities(counts: list[tuple[int, tuple[int, ...], int]], rounds: int = 50) -> tuple[list[list[float]], list[float]]:
    """Expectation-maximisation: for each labeler P(yes | personal) and P(yes | not), and each pattern's P(personal).

    It begins at the share of yes votes; votes are taken as independent given the truth, and a labeler that
    says nothing does not count. Weak priors keep every rate inside (0, 1).
    """
    labelers = len(counts[0][1]) if counts else 0
    post = [(sum(x == 1 for x in v) + 1) / (sum(x >= 0 for x in v) + 1.5) for _, v, _ in counts]
    rates = [[0.8, 0.3] for _ in range(labelers)]
    for _ in range(rounds):
        for j in range(labelers):
            for t in (0, 1):
                share = [(p if t == 0 else 1 - p) * n for p, (_, _, n) in zip(post, counts)]
                said = [s for s, (_, v, _) in zip(share, counts) if v[j] >= 0]
                yes = sum(s for s, (_, v, _) in zip(share, counts) if v[j] == 1)
                a, b = ((4, 1), (1, 2))[t]
                rates[j][t] = (yes + a) / (sum(said) + a + b)
        total = sum(n for _, _, n in counts)
        prior = (sum(p * n for p, (_, _, n) in zip(post, counts)) + 2) / (total + 4)
        post = []
        for _, v, _ in counts:
            z = math.log(prior / (1 - prior))
            for j, x in enumerate(v):
                if x >= 0:
                    yes, no = rates[j] if x else (1 - rates[j][0], 1 - rates[j][1])
                    z += math.log(yes / no)
            post.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
    return rates, post


def _features(kind: int, v: tuple[int, ...]) -> list[float]:
    return [1.0, *(float(kind == k) for k in range(len(KINDS))), *(float(x == y) for x in v for y in (0, 1))]


def span_classifier(counts: list[tuple[int, tuple[int, ...], int]], steps: int = 300) -> list[float]:
    """Weights of a logistic classifier of (kind, votes), fitted to the expectations; patterns weigh log(1 + number)."""
    labelers = len(counts[0][1]) if counts else 5
    if not counts:
        return [0.0] * (1 + len(KINDS) + 2 * labelers)
    _, post = reliabilities(counts)
    rows = [(_features(k, v), p, math.log1p(n)) for (k, v, n), p in zip(counts, post)]
    total = sum(w for _, _, w in rows)
    weights = [0.0] * len(rows[0][0])
    for _ in range(steps):
        slope = [0.01 * w for w in weights]
        for x, p, n in rows:
            z = sum(a * b for a, b in zip(weights, x))
            d = n / total * (1 / (1 + math.exp(-z)) - p)
            for i, a in enumerate(x):
                slope[i] += d * a
        weights = [w - 1.0 * g for w, g in zip(weights, slope)]
    return weights


def says_yes(x: Column, weights: list[float]) -> Column:
    """The classifier as a Spark expression on a voted span."""
    n = 1 + len(KINDS)
    kinds = F.array(*[F.lit(w) for w in weights[1:n]])
    z = F.lit(weights[0]) + F.element_at(kinds, x["kind"] + 1)
    for j in range((len(weights) - n) // 2):
        vote = F.element_at(x["v"], j + 1)
        z = z + F.when(vote == 0, weights[n + 2 * j]).when(vote == 1, weights[n + 2 * j + 1]).otherwise(0.0)
    return z >= 0


def _said(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def chosen(weights: list[float]) -> Column:
    """Base spans and those of the others that the classifier takes, by start and kind."""
    return F.array_sort(F.concat("base", F.filter("more", lambda x: says_yes(x, weights))))


def pii_spans(docs: DataFrame) -> DataFrame:
    """doc_id, counts of base kinds, base_sha256, spans, counts of the further kinds and of all spans. Candidates and votes (no texts) are stored once and used twice."""
    spans = stored(voted(docs), "pii-votes")
    weights = span_classifier(vote_counts(spans))
    spans = spans.select("doc_id", "base", chosen(weights).alias("all"))
    many = [F.size(F.filter("all", lambda x: x["kind"] == k)).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    digest = F.sha2(_said(F.col("base")).cast("binary"), 256).alias("base_sha256")
    return spans.select("doc_id", *many[:BASE], digest, _said(F.col("all")).alias("spans"), *many[BASE:], F.size("all").cast("long").alias("n_spans"))


def redact(docs: DataFrame) -> DataFrame:
    """docs with [KIND] in place of every span in text (and n_chars, if there, counted anew); other columns stay."""
    weights = span_classifier(vote_counts(voted(docs)))
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def step(acc: Column, x: Column, text: Column) -> Column:
        fresh = x["start"] >= acc["at"]
        between = F.when(fresh, F.concat(F.substr(text, acc["at"] + 1, F.greatest(x["start"] - acc["at"], F.lit(0))), F.element_at(names, x["kind"] + 1))).otherwise(F.lit(""))
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.concat(acc["out"], between).alias("out"))

    found = voted(docs, keep=True).select("_row", chosen(weights).alias("spans"))
    text = F.col("_row.text")
    done = F.aggregate("spans", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), lambda a, x: step(a, x, text), lambda a: F.concat(a["out"], F.substr(text, a["at"] + 1, F.length(text))))
    out = found.select("_row", F.when(F.size("spans") > 0, done).otherwise(text).alias("_new"))
    columns = []
    for c in docs.columns:
        if c == "text":
            columns.append(F.col("_new").alias("text"))
        elif c == "n_chars":
            columns.append(F.when(F.col("_row.text").isNull(), F.col("_row.n_chars")).otherwise(F.length("_new").cast(docs.schema["n_chars"].dataType)).alias("n_chars"))
        else:
            columns.append(F.col(f"_row.`{c}`").alias(c))
    return out.select(*columns)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_spans(table(spark, sf_dir, "documents"))
