"""URL filter: host-suffix and path-prefix expressions against a rule list.

Every url is expanded into the expressions ``host suffix + path prefix`` that a
rule could equal.  Expressions meet the rules in an equi-join on the first 32
bits of their SHA-256 digest; the full digest then confirms the meeting, and
among the confirmed rules of a url the longest wins.

Only path-prefix lengths and host-label counts that occur among the rules are
expanded, so that no expression is made which no rule could equal, and none is
left out.

Cases: a null url, or one without ``://``, has an empty host and path, fits no
rule and gets the default verdict.  A rule without a leading slash in its path
is taken as it stands.  Rules repeated or equal in length are ranked by host
length, then by text, then ``allow`` before ``block``.  An empty rule table
gives every url the default verdict.  Repeated urls are judged once and all
their rows get the result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from propflow.llm.shared import table

#: The rules of the query (host, path, verdict).
RULES = [
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
]

#: A rule table of at most this many rows is broadcast; a larger one is shuffled.
BROADCAST_RULES = 100_000

#: A-Z alone; lower() would also change other letters.
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: str = "url") -> tuple:
    """Columns host and path of a url column."""
    rest = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), _UPPER, _LOWER)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return host, path


def _expressions(host_labels: list[int], path_lengths: list[int]):
    """Array of structs (rule text, digest) a url with columns host, path can equal."""
    labels = F.split(F.col("host"), r"\.")
    suffixes = F.transform(
        F.filter(F.array(*[F.lit(n) for n in host_labels]), lambda n: n <= F.size(labels)),
        lambda n: F.array_join(F.slice(labels, F.size(labels) - n + 1, n), "."),
    )
    prefixes = F.transform(
        F.filter(F.array(*[F.lit(n) for n in path_lengths]), lambda n: n <= F.length("path")),
        lambda n: F.substring(F.col("path"), F.lit(1), n),
    )
    # the zero byte keeps ("a", "b/") apart from ("ab", "/")
    return F.flatten(
        F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, F.lit("\0"), p)))
    )


def filter_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """(id, host, path, rule, verdict) for each row of ``pages``.

    ``rules`` has columns host, path, verdict; a rule fits its host and all
    subdomains when the url's path starts with the rule's path.
    """
    digest = F.sha2(F.concat("host", F.lit("\0"), "path"), 256)
    known = (
        rules.where("host IS NOT NULL AND path IS NOT NULL")
        .select("host", "path", "verdict")
        .select(
            digest.alias("digest"),
            F.substring(digest, 1, 8).alias("short"),
            F.size(F.split("host", r"\.")).alias("labels"),
            F.length("path").alias("reach"),
            F.struct(
                (F.length("host") + F.length("path")).alias("length"),
                F.length("host").alias("host_length"),
                F.concat("host", "path").alias("rule"),
                # struct order breaks the last tie: allow over block
                (F.col("verdict") == "allow").alias("allows"),
                F.col("verdict").alias("verdict"),
            ).alias("won"),
        )
    )
    shape = known.agg(
        F.collect_set("labels").alias("labels"), F.collect_set("reach").alias("reaches"), F.count(F.lit(1)).alias("n")
    ).first()
    host, path = split_url("_url")
    rows = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"))
    judged = rows.select("_id", "_url", host.alias("host"), path.alias("path"))
    if shape.n:
        side = known.drop("labels", "reach")
        side = F.broadcast(side) if shape.n <= BROADCAST_RULES else side
        # one expansion for each distinct url, however often it occurs
        hits = (
            judged.where("path <> '' OR host <> ''")
            .select(F.col("_url").alias("_hit"), F.explode(_expressions(sorted(shape.labels), sorted(shape.reaches))).alias("expression"))
            .select("_hit", F.sha2("expression", 256).alias("full"))
            .withColumn("short", F.substring("full", 1, 8))
            .join(side, "short")
            .where("full = digest")
            .groupBy("_hit")
            .agg(F.max("won").alias("won"))
        )
        judged = judged.join(hits, F.col("_url") == F.col("_hit"), "left")
    else:
        judged = judged.withColumn("won", F.lit(None).cast("struct<rule:string,verdict:string>"))
    return judged.select(
        F.col("_id").alias(id_col),
        "host",
        "path",
        F.col("won.rule").alias("rule"),
        F.coalesce("won.verdict", F.lit(default)).alias("verdict"),
    )


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return filter_urls(table(spark, sf_dir, "pages"), rules)


SQL = r"""
WITH parts AS (
  SELECT page_id,
         regexp_extract(coalesce(url, ''), '^.*?://(.*)$', 1, 's') AS rest
  FROM pages
), cut AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM parts
), rules(h, p, v) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'),
         ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
)
SELECT c.page_id, any_value(c.host) AS host, any_value(c.path) AS path,
       arg_max(r.h || r.p, length(r.h || r.p)) AS rule,
       coalesce(arg_max(r.v, length(r.h || r.p)), 'allow') AS verdict
FROM cut c LEFT JOIN rules r
  ON (c.host = r.h OR ends_with(c.host, '.' || r.h)) AND starts_with(c.path, r.p)
GROUP BY c.page_id
"""
