"""URL filters: each URL becomes host-suffix and path-prefix expressions that are equi-joined with hashed rules.

A URL with h host labels makes h suffixes; of its path, only the prefixes whose
length some rule has. Both counts depend on the URL and the rule list, never on
the table. Expressions meet the rules on a 32-bit prefix of their SHA-256; the
full digest confirms a match, and the longest rule wins inside the URL's own row
group. Rows are numbered and regrouped in one pass, whose expressions Spark
aggregates map-side to one row per URL; nothing is joined back. The rule side is
broadcast only when it is counted to be small.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnwise.llm.common import UPPER, bounded_broadcast

#: (host, path prefix, verdict)
DEFAULT_RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]
DEFAULT_VERDICT = "allow"
#: Bits of the digest that the join uses, in hexadecimal digits.
SHORT_HEX = 8


def rule_table(spark: SparkSession, rules=DEFAULT_RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "host string, path string, verdict string")


def _digest(host, path):
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def parsed(pages: DataFrame) -> DataFrame:
    """page_id, host, path. Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased;
    path: from there up to ``?``, ``#`` or the end. Null, or no ``://``: both empty."""
    url = F.coalesce(F.col("url"), F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    return pages.select(
        "page_id",
        F.translate(host, UPPER, UPPER.lower()).alias("host"),
        F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(url)), r"(?s)^([^?#]*)", 1).alias("path"),
    )


def url_filter(pages: DataFrame, rules: DataFrame | None = None, default: str = DEFAULT_VERDICT) -> DataFrame:
    """One row per row of ``pages`` (page_id, url; other columns are ignored): page_id, host, path, rule, verdict.

    The rule that is longest (host and path together; of equals the longer
    host, then the block rule) decides; without one, ``default`` does and rule is null. Rows that
    repeat a page_id keep their own result. Null and broken URLs fit no rule
    with a host. An empty rule table leaves the default.
    """
    spark = pages.sparkSession
    rules = rule_table(spark) if rules is None else rules
    r = rules.select(
        F.translate(F.coalesce("host", F.lit("")), UPPER, UPPER.lower()).alias("r_host"), F.coalesce("path", F.lit("")).alias("r_path"), F.col("verdict").alias("r_verdict")
    ).where("r_host <> ''")
    r = r.select("*", _digest(F.col("r_host"), F.col("r_path")).alias("r_full"))
    r = r.select("*", F.substring("r_full", 1, SHORT_HEX).alias("short"))
    lengths = sorted(x[0] for x in r.select(F.length("r_path")).distinct().collect())  # bounded by the longest rule path
    urls = parsed(pages).withColumn("row", F.monotonically_increasing_id())  # in one branch only: a second reading may number rows otherwise
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.transform(
        F.filter(F.array(*[F.lit(n) for n in lengths]) if lengths else F.array().cast("array<int>"), lambda n: n <= F.length("path")),
        lambda n: F.substring(F.col("path"), F.lit(1), n),
    )
    digests = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: _digest(s, p))))
    spread = urls.select("row", "page_id", "host", "path", F.explode_outer(digests).alias("full"))
    spread = spread.withColumn("short", F.substring("full", 1, SHORT_HEX))
    met = spread.join(bounded_broadcast(r).withColumnRenamed("short", "r_short"), (F.col("short") == F.col("r_short")) & (F.col("full") == F.col("r_full")), "left")
    fit = F.struct(
        F.length(F.concat("r_host", "r_path")).alias("n"), F.length("r_host").alias("h"), F.col("r_verdict").alias("v"),
        F.concat("r_host", "r_path").alias("rule"),
    )
    best = met.groupBy("row", "page_id", "host", "path").agg(F.max(F.when(F.col("r_full").isNotNull(), fit)).alias("b"))
    return best.select("page_id", "host", "path", F.col("b.rule").alias("rule"), F.coalesce("b.v", F.lit(default)).alias("verdict"))
