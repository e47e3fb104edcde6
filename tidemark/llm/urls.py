"""URL filter rules and link-graph propagation (operator 10), with DataFrame functions only.

A url's host and path decide which listed rule fits; the longest wins. Urls without a rule get
their host's verdict. For that, hosts form a graph: host edges are the absolute links in the pages'
html, counted for each pair of hosts before anything is shuffled by host, and both ways between a
host and its alias under a fixed prefix (www and the like). Trust is a personalised PageRank
from hosts with allowed urls along the edges; distrust starts at hosts with blocked urls and runs
along the reversed edges, to those who link to them. Both are iterated in Spark a fixed number of
times, the table being written to the shared folder every few rounds. A host is blocked if its
distrust is more than threshold times its trust.

Null urls, and urls without "://", have an empty host and path, no rule, and the verdict of the
empty host, which is allow. Null html has no links. Repeated pages count as often as they occur.
Columns other than page_id, url and html are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import ascii_lower, stored, table

#: (verdict, host, path)
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: A host under one of these is an alias of what follows.
ALIASES = ("www", "m", "blog", "mobile", "amp")
LINK = r"(?i)(?:href|src)\s*+=\s*+[\"']?(?:[a-z][a-z0-9+.-]{0,30}:)?//([^/?#\"'\s<>]+)"
ALIAS = rf"^(?:{'|'.join(ALIASES)})\.([^.]+\..+)$"
ROUNDS, DAMPING, THRESHOLD, STORE_EVERY = 12, 0.85, 1.0, 4


def parts(pages: DataFrame) -> DataFrame:
    """Add host and path."""
    url = F.coalesce(F.col("url"), F.lit(""))
    rest = F.when(F.contains(url, F.lit("://")), F.expr("substr(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    host = ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1))
    return pages.withColumns({"host": host, "path": F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)})


def _fits(host: str, path: str) -> Column:
    own = (F.col("host") == host) | F.col("host").endswith("." + host)
    return own & F.col("path").startswith(path)


def ruled(pages: DataFrame, rules=RULES) -> DataFrame:
    """Add rule and verdict of the longest listed rule, null where none fits."""
    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    pick = lambda value: reduce(lambda c, r: c.when(_fits(r[1], r[2]), F.lit(value(r))), ordered, F.when(F.lit(False), F.lit(None).cast("string")))
    return pages.withColumns({"rule": pick(lambda r: r[1] + r[2]), "verdict": pick(lambda r: r[0])})


def host_edges(pages: DataFrame) -> DataFrame:
    """src, dst, n: absolute links between different hosts, and both ways between a host and its alias."""
    links = F.when(F.contains("html", F.lit("//")), F.array_distinct(F.transform(F.regexp_extract_all("html", F.lit(LINK), F.lit(1)), ascii_lower)))
    linked = parts(pages).select(F.col("host").alias("src"), F.explode(links).alias("dst"))
    hosts = parts(pages).select("host").distinct().withColumn("other", F.regexp_extract("host", ALIAS, 1)).filter("other <> ''")
    both = hosts.select(F.explode(F.array(F.struct(F.col("host").alias("src"), F.col("other").alias("dst")), F.struct(F.col("other").alias("src"), F.col("host").alias("dst")))).alias("e")).select("e.*")
    every = linked.groupBy("src", "dst").agg(F.count("*").alias("n")).unionByName(both.withColumn("n", F.lit(1).cast("long")))
    return every.filter("src <> dst and src <> '' and dst <> ''").groupBy("src", "dst").agg(F.sum("n").alias("n"))


def propagate(seeds: DataFrame, edges: DataFrame, rounds: int = ROUNDS, damping: float = DAMPING) -> DataFrame:
    """host, trust, distrust. seeds: host, trust, distrust; edges: src, dst, n."""
    ways = edges.select(F.explode(F.array(
        F.struct(F.lit("trust").alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b"), "n"),
        F.struct(F.lit("distrust").alias("kind"), F.col("dst").alias("a"), F.col("src").alias("b"), "n"),
    )).alias("e")).select("e.*")
    total = ways.groupBy("kind", "a").agg(F.sum("n").alias("total"))
    ways = stored(ways.join(total, ["kind", "a"]).select("kind", "a", "b", (F.col("n") / F.col("total")).alias("share")), "host-edges")
    seed = seeds.select(F.explode(F.array(
        F.struct(F.lit("trust").alias("kind"), "host", F.col("trust").alias("seed")),
        F.struct(F.lit("distrust").alias("kind"), "host", F.col("distrust").alias("seed")),
    )).alias("s")).select("s.*").filter("seed > 0")
    seed = stored(seed, "host-seeds")
    rank = seed.withColumnRenamed("seed", "value")
    for k in range(1, rounds + 1):
        moved = ways.join(rank.withColumnRenamed("host", "a"), ["kind", "a"]).select("kind", F.col("b").alias("host"), (F.lit(damping) * F.col("share") * F.col("value")).alias("value"))
        rank = moved.unionByName(seed.select("kind", "host", ((1 - damping) * F.col("seed")).alias("value"))).groupBy("kind", "host").agg(F.sum("value").alias("value"))
        if k % STORE_EVERY == 0 and k < rounds:
            rank = stored(rank, "host-ranks")
    of = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("value"))), F.lit(0.0)).alias(kind)
    return rank.groupBy("host").agg(of("trust"), of("distrust"))


def host_seeds(pages: DataFrame, rules=RULES) -> DataFrame:
    """host, trust, distrust: shares of a host's urls that the rules allow and block."""
    share = lambda v: (F.count(F.when(F.col("verdict") == v, 1)) / F.count("*"))
    return ruled(parts(pages), rules).groupBy("host").agg(share("allow").alias("trust"), share("block").alias("distrust"))


def judge(pages: DataFrame, rules=RULES, rounds: int = ROUNDS, threshold: float = THRESHOLD) -> DataFrame:
    """page_id, host, path, rule, verdict of every page."""
    pages = pages.select("page_id", "url", "html")
    hosts = propagate(host_seeds(pages, rules), host_edges(pages), rounds).select("host", F.when(F.col("distrust") > threshold * F.col("trust"), F.lit("block")).otherwise(F.lit("allow")).alias("spread"))
    told = ruled(parts(pages.select("page_id", "url")), rules).join(hosts, "host", "left")
    return told.select("page_id", "host", "path", "rule", F.coalesce("verdict", "spread", F.lit("allow")).alias("verdict"))


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))


def oracle_sql(rules=RULES, rounds: int = ROUNDS) -> str:
    """The same in DuckDB, the rounds written out."""
    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    fits = lambda r: f"(host = '{r[1]}' OR ends_with(host, '.{r[1]}')) AND starts_with(path, '{r[2]}')"
    case = lambda value: "CASE " + " ".join(f"WHEN {fits(r)} THEN '{value(r)}'" for r in ordered) + " END"
    link = r"""(?i)(?:href|src)\s*=\s*["'']?(?:[a-z][a-z0-9+.-]{0,30}:)?//([^/?#"''\s<>]+)"""
    lower = lambda x: f"translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    text = f"""
WITH rest AS MATERIALIZED (SELECT page_id, html, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS MATERIALIZED (SELECT page_id, html, {lower("regexp_extract(rest, '^([^/?#]*)', 1)")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
ruled AS MATERIALIZED (SELECT page_id, host, path, {case(lambda r: r[1] + r[2])} AS rule, {case(lambda r: r[0])} AS verdict FROM parts),
links AS (SELECT host AS src, unnest(list_distinct(list_transform(regexp_extract_all(html, '{link}', 1), lambda x: {lower("x")}))) AS dst FROM parts WHERE contains(html, '//')),
aliases AS (SELECT host, regexp_extract(host, '^(?:{"|".join(ALIASES)})\\.([^.]+\\..+)$', 1) AS other FROM (SELECT DISTINCT host FROM parts)),
every AS (SELECT src, dst, count(*) AS n FROM links GROUP BY 1, 2 UNION ALL SELECT host, other, 1 FROM aliases WHERE other <> '' UNION ALL SELECT other, host, 1 FROM aliases WHERE other <> ''),
edges AS MATERIALIZED (SELECT src, dst, sum(n) AS n FROM every WHERE src <> dst AND src <> '' AND dst <> '' GROUP BY 1, 2),
ways AS MATERIALIZED (SELECT kind, a, b, n / sum(n) OVER (PARTITION BY kind, a) AS share FROM (SELECT 'trust' AS kind, src AS a, dst AS b, n FROM edges UNION ALL SELECT 'distrust', dst, src, n FROM edges)),
shares AS (SELECT host, count(*) FILTER (verdict = 'allow') / count(*) AS t, count(*) FILTER (verdict = 'block') / count(*) AS d FROM ruled GROUP BY 1),
seed AS MATERIALIZED (SELECT 'trust' AS kind, host, t AS seed FROM shares WHERE t > 0 UNION ALL SELECT 'distrust', host, d FROM shares WHERE d > 0),
r0 AS MATERIALIZED (SELECT kind, host, seed AS value FROM seed)"""
    for k in range(1, rounds + 1):
        text += f""",
r{k} AS MATERIALIZED (SELECT kind, host, sum(value) AS value FROM (SELECT w.kind, w.b AS host, {DAMPING} * share * value AS value FROM ways w JOIN r{k - 1} r ON w.kind = r.kind AND w.a = r.host UNION ALL SELECT kind, host, {1 - DAMPING} * seed FROM seed) GROUP BY 1, 2)"""
    return (
        text
        + f""",
hosts AS (SELECT host, CASE WHEN coalesce(sum(value) FILTER (kind = 'distrust'), 0) > {THRESHOLD} * coalesce(sum(value) FILTER (kind = 'trust'), 0) THEN 'block' ELSE 'allow' END AS spread FROM r{rounds} GROUP BY 1)
SELECT page_id, ruled.host AS host, path, rule, coalesce(verdict, spread, 'allow') AS verdict FROM ruled LEFT JOIN hosts ON ruled.host = hosts.host"""
    )
