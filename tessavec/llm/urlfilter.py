"""URL filters: rules on hosts and paths, and for the rest trust and distrust spread over the link graph.

Trust starts at hosts whose pages the rules mostly allow and follows links (personalised PageRank); distrust
starts at hosts whose pages the rules mostly block and runs against the links, as who links there is suspect.
A host is blocked when its distrust reaches ``threshold`` and exceeds its trust; both are known to ``TOLERANCE``,
and differences within it count as none.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import new_path, quoted, remove, stored

OUTPUT = ("host", "path", "rule", "verdict")
#: What any host may lack of its trust or distrust when the spreading ends.
TOLERANCE = 1e-9
#: Rounds of the spreading that one Spark job does.
_AT_ONCE = 4
#: Absolute or protocol-relative targets of href attributes; group 1 is the host.
_TARGET = r"""(?i)href\s*=\s*["']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s<>]+)"""


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str


#: Fixed values of the query.
QUERY_RULES = (Rule("allow", "org", "/"), Rule("block", "example.org", "/es/"), Rule("block", "example.org", "/en/1"), Rule("allow", "com", "/fr/"), Rule("block", "com", "/de/"))


def _ascii_lower(x: Column) -> Column:
    return F.translate(x, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, lower-cased A-Z; path: from there up to
    ``?``, ``#`` or the end. Null or no ``://``: both empty."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return _ascii_lower(host), F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)


def longest_rule(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """Struct (length, rule, verdict) of the longest rule that fits host and path, else null.

    ``rules`` is a short list that becomes part of the plan; the earlier of two equally long rules wins.
    """
    found = []
    for k, r in enumerate(rules):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        found.append(F.when(fits, F.struct(F.lit(len(r.host + r.path)).alias("length"), F.lit(-k).alias("order"), F.lit(r.host + r.path).alias("rule"), F.lit(r.verdict).alias("verdict"))))
    return F.array_max(F.array_compact(F.array(*found))) if found else F.lit(None).cast("struct<length:int,order:int,rule:string,verdict:string>")


def host_links(pages: DataFrame, host_col: str = "host", html_col: str = "html") -> DataFrame:
    """(src, dst, weight): links between different hosts, counted before they shuffle. Relative links stay at home."""
    target = F.explode(F.regexp_extract_all(F.coalesce(F.col(html_col), F.lit("")), F.lit(_TARGET), F.lit(1)))
    links = pages.where(F.col(host_col) != "").select(F.col(host_col).alias("src"), target.alias("dst"))
    return links.select("src", _ascii_lower(F.col("dst")).alias("dst")).where("src != dst").groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))


def spread(seeds: DataFrame, links: DataFrame, damping: float = 0.85, rounds: int | None = None, tolerance: float = TOLERANCE) -> DataFrame:
    """(host, trust, distrust). ``seeds`` has host, trust, distrust; ``links`` has src, dst, weight.

    Each round a host passes ``damping`` of its trust on along its links, and of its distrust against them, by
    the links' shares. What moves shrinks by ``damping`` a round at least, so all that is still to come to any host
    is at most damping / (1 - damping) of what moved last; rounds go on until that is within ``tolerance``, or for
    ``rounds`` if given.
    """
    if rounds is None and not (0 <= damping < 1 and tolerance > 0):
        raise ValueError("without a number of rounds, damping must be in [0, 1) and tolerance positive")
    if links.isEmpty():
        return seeds.select("host", (F.col("trust") * (1 - damping)).alias("trust"), (F.col("distrust") * (1 - damping)).alias("distrust"))
    spark = seeds.sparkSession
    out = links.groupBy("src").agg(F.sum("weight").alias("total"))
    into = links.groupBy("dst").agg(F.sum("weight").alias("total"))
    forward = links.join(out, "src").select(F.col("src").alias("from"), F.col("dst").alias("to"), (F.col("weight") / F.col("total")).alias("trust_share"), F.lit(0.0).alias("distrust_share"))
    back = links.join(into, "dst").select(F.col("dst").alias("from"), F.col("src").alias("to"), F.lit(0.0).alias("trust_share"), (F.col("weight") / F.col("total")).alias("distrust_share"))
    edges = stored(forward.unionByName(back), "edges")
    start = stored(seeds.select("host", (F.col("trust") * (1 - damping)).alias("trust"), (F.col("distrust") * (1 - damping)).alias("distrust")), "seeds")
    # trust_moved and distrust_moved are the part that has come all the way through every round so far
    moves = ("trust", "distrust")
    rank = start.select("host", *moves, *[F.col(c).alias(f"{c}_moved") for c in moves])
    fresh = start.select("host", *moves, *[F.lit(0.0).alias(f"{c}_moved") for c in moves])
    done, path = 0, None
    while rounds is None or done < rounds:
        now = _AT_ONCE if rounds is None else min(_AT_ONCE, rounds - done)
        for _ in range(now):
            passed = edges.join(rank, edges["from"] == rank["host"]).select(F.col("to").alias("host"), *[(damping * F.col(c + part) * F.col(f"{c}_share")).alias(c + part) for part in ("", "_moved") for c in moves])
            rank = fresh.unionByName(passed).groupBy("host").agg(*[F.sum(c).alias(c) for c in fresh.columns[1:]])
        done, last, path, schema = done + now, path, new_path(spark, "rank"), rank.schema
        rank.write.parquet(path)
        rank = spark.read.schema(schema).parquet(path)
        if last:
            remove(spark, last)
        if rounds is None and max(x or 0.0 for x in rank.agg(*[F.sum(f"{c}_moved") for c in moves]).first()) * damping <= tolerance * (1 - damping):
            break
    return rank.select("host", *moves)


def judge_urls(pages: DataFrame, rules: tuple[Rule, ...], url_col: str = "url", html_col: str = "html", majority: float = 0.5, threshold: float = 0.05, damping: float = 0.85, rounds: int | None = None) -> DataFrame:
    """Adds host, path, rule (or null) and verdict, allow or block; columns so named are replaced.

    A host is a trusted (blocked) seed where more than ``majority`` of its pages have an allow (block) rule.
    Pages without host have no rule and are allowed; hosts that nothing reaches are allowed.
    """
    names = [c for c in pages.columns if c.lower() not in OUTPUT]
    host, path = host_and_path(quoted(url_col))
    judged = pages.select(F.struct(*[quoted(c) for c in names]).alias("page") if names else F.lit(None).alias("page"), quoted(html_col).alias("html"), host.alias("host"), path.alias("path"))
    judged = judged.withColumn("found", longest_rule(F.col("host"), F.col("path"), rules))
    share = lambda v: F.avg(F.coalesce((F.col("found.verdict") == v).cast("int"), F.lit(0)))
    hosts = stored(judged.where("host != ''").groupBy("host").agg(share("allow").alias("allowed"), share("block").alias("blocked")), "hosts")
    seeds = hosts.select("host", (F.col("allowed") > majority).cast("double").alias("trust"), (F.col("blocked") > majority).cast("double").alias("distrust"))
    scores = spread(seeds, stored(host_links(judged, "host", "html"), "links"), damping, rounds)
    bad = stored(scores.where((F.col("distrust") >= threshold - TOLERANCE) & (F.col("distrust") - F.col("trust") > TOLERANCE)).select("host"), "bad")
    # only pages without a rule look their host up; the others are dealt at random, as no host has a slash
    asks = F.col("found").isNull() & (F.col("host") != "")
    judged = judged.withColumn("asks", F.when(asks, F.col("host")).otherwise(F.concat(F.lit("/"), F.pmod(F.xxhash64("path", "page"), F.lit(1 << 20)).cast("string"))))
    bad = bad.select(F.col("host").alias("bad"))
    told = judged.drop("html").join(bad, judged["asks"] == bad["bad"], "left")
    verdict = F.coalesce(F.col("found.verdict"), F.when(F.col("bad").isNotNull(), "block").otherwise("allow"))
    return told.select(*(["page.*"] if names else []), "host", "path", F.col("found.rule").alias("rule"), verdict.alias("verdict"))


def op8_url_filter(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return judge_urls(pages, QUERY_RULES).select("page_id", "host", "path", "rule", "verdict")


_RULE_ROWS = ", ".join(f"({k}, '{r.host}', '{r.path}', '{r.verdict}')" for k, r in enumerate(QUERY_RULES))
#: Host, path and rule of every page, and the rule's verdict; SQL doesn't express the spreading that judges the rest.
RULES_SQL = f"""
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM u),
r AS (SELECT * FROM (VALUES {_RULE_ROWS}) AS t(k, rule_host, rule_path, verdict)),
f AS (SELECT h.page_id, r.* FROM h JOIN r ON (h.host = rule_host OR ends_with(h.host, '.' || rule_host)) AND starts_with(h.path, rule_path)
  QUALIFY row_number() OVER (PARTITION BY h.page_id ORDER BY length(rule_host || rule_path) DESC, k) = 1)
SELECT h.page_id, h.host, h.path, f.rule_host || f.rule_path AS rule, f.verdict AS rule_verdict FROM h LEFT JOIN f USING (page_id)
"""
