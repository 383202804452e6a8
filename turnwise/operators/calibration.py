"""Calibration and agreement statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BINS = 10
#: Confidence from which a wrong answer is overconfident, and below which a right one is underconfident.
SURE = 0.64


def bin_of(confidence: Column, bins: int = BINS) -> Column:
    """0 to bins - 1 by lower bounds i * 0.1 in doubles, so that 0.3, 0.6 and 0.7 fall where those bounds put them."""
    out = F.lit(0)
    for i in range(1, bins):
        out = out + (confidence >= F.lit(i) * F.lit(0.1)).cast("int")
    return out


def bins(records: DataFrame, keys: list[str]) -> DataFrame:
    """keys, bin, n, n_correct, confidence (sum): all that calibration errors need, pre-aggregated to ten rows a key."""
    r = records.withColumn("bin", bin_of(F.col("confidence")))
    return r.groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("correct").cast("long")).alias("n_correct"), F.sum(F.col("confidence").cast("decimal(20,6)")).cast("double").alias("confidence"))


def errors(records: DataFrame, keys: list[str]) -> DataFrame:
    """ece and mce, six digits."""
    gap = F.abs(F.col("n_correct") / F.col("n") - F.col("confidence") / F.col("n"))
    return bins(records, keys).groupBy(*keys).agg(F.round(F.sum(gap * F.col("n")) / F.sum("n"), 6).alias("ece"), F.round(F.max(gap), 6).alias("mce"))


def pointwise(records: DataFrame, keys: list[str]) -> DataFrame:
    """brier, overconfidence, underconfidence; 0 over nothing."""
    c, ok = F.col("confidence"), F.col("correct")
    share = lambda top, whole: F.round(F.coalesce(F.count_if(top) / F.nullif(F.count_if(whole), F.lit(0)), F.lit(0.0)), 6)
    return records.groupBy(*keys).agg(
        F.round(F.coalesce(F.avg(F.pow(c - ok.cast("double"), 2)), F.lit(0.0)), 6).alias("brier"),
        share(~ok & (c >= SURE), ~ok).alias("overconfidence"), share(ok & (c < SURE), ok).alias("underconfidence"),
    )


def reliability(records: DataFrame, spark) -> DataFrame:
    """All ten bins, empty ones with null means."""
    b = bins(records, [])
    return spark.range(BINS).select(F.col("id").cast("int").alias("bin")).join(b, "bin", "left").select(
        "bin", F.coalesce("n", F.lit(0)).alias("n"), F.round(F.col("confidence") / F.col("n"), 6).alias("mean_confidence"), F.round(F.col("n_correct") / F.col("n"), 6).alias("accuracy")
    )


def fleiss_kappa(votes: DataFrame, item: str, category: str) -> DataFrame:
    """One row, kappa: equal raters per item; 0 with one rater, 1 with unanimity in one category."""
    counts = votes.groupBy(item, category).agg(F.count(F.lit(1)).alias("c"))
    per_item = counts.groupBy(item).agg(F.sum("c").alias("r"), F.sum(F.col("c") * F.col("c")).alias("sq"))
    agree = per_item.agg(F.count(F.lit(1)).alias("items"), F.max("r").alias("raters"), F.sum((F.col("sq") - F.col("r")) / F.nullif(F.col("r") * (F.col("r") - 1), F.lit(0))).alias("p"))
    share = counts.groupBy(category).agg(F.sum("c").alias("c"))
    expected = share.agg(F.sum(F.col("c") * F.col("c")).alias("sq"), F.sum("c").alias("n")).select((F.col("sq") / (F.col("n") * F.col("n"))).alias("pe"))
    j = agree.crossJoin(F.broadcast(expected))  # one row each
    p = F.col("p") / F.col("items")
    return j.select(F.round(F.when(F.col("raters") < 2, 0.0).when(F.col("pe") >= 1, 1.0).otherwise((p - F.col("pe")) / (1 - F.col("pe"))), 6).alias("kappa"))


def spearman(rows: DataFrame, x: str, y: str, keys: list[str] = []) -> DataFrame:  # noqa: B006
    """Rank correlation with average ranks; 0 where a side is constant. Ranks come from value counts, so windows see distinct values only."""
    def ranked(c: str) -> DataFrame:
        counts = rows.groupBy(*keys, c).agg(F.count(F.lit(1)).alias("_n"))
        w = Window.partitionBy(*keys).orderBy(c).rowsBetween(Window.unboundedPreceding, 0)
        return counts.select(*keys, c, (F.sum("_n").over(w) - (F.col("_n") - 1) / 2).alias(f"_r{c}"))

    j = rows.select(*keys, x, y).join(ranked(x), [*keys, x]).join(ranked(y), [*keys, y])
    rho = F.covar_pop(f"_r{x}", f"_r{y}") / F.nullif(F.stddev_pop(f"_r{x}") * F.stddev_pop(f"_r{y}"), F.lit(0.0))
    return j.groupBy(*keys).agg(F.round(F.coalesce(rho, F.lit(0.0)), 6).alias("spearman"))
