"""Deterministic sampling, assignment and packing. What the original leaves to chance is an integer hash of the key here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from turnwise.operators.relational import counted

MODULUS = 2147483647


def hashed(key: Column, salt: int = 0) -> Column:
    """A linear congruence of an integer key: the same in any engine."""
    return (key.cast("long") * F.lit(1103515245) + F.lit(12345 + salt)) % F.lit(MODULUS)


def positions(rows: DataFrame, group: list[str], order: list, bucket: Column) -> DataFrame:
    """``pos`` from 0 within each group; ``bucket`` must not fall as the order rises (see :func:`counted`)."""
    return counted(rows, [F.col(c) for c in group], order, bucket).withColumn("pos", F.col("pos") - 1)


def round_robin(rows: DataFrame, bank: DataFrame, n: int) -> DataFrame:
    """Row i takes bank entry i mod n. ``rows`` has pos, ``bank`` has slot."""
    return rows.join(F.broadcast(bank), F.pmod(F.col("pos"), F.lit(n)) == F.col("slot"))


def cursor(rows: DataFrame, key: str, order: list, step: Column, n: int) -> DataFrame:
    """A cursor per key that advances by step at each occurrence and wraps at n: its closed form."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("cursor", F.pmod(step * (F.row_number().over(w) - 1), F.lit(n)).cast("int"))


def near_equal_buckets(rows: DataFrame, group: list[str], order: list, k: int) -> DataFrame:
    """k buckets of nearly equal size, the first taking the remainder."""
    return rows.withColumn("bucket", F.ntile(k).over(Window.partitionBy(*group).orderBy(*order)))


def stratified_split(rows: DataFrame, strata: list[str], order: list, share: float) -> DataFrame:
    """``split``: val for max(1, floor(n * share)) rows of each stratum, else train."""
    by = Window.partitionBy(*strata)
    k = F.greatest(F.lit(1), F.floor(F.count(F.lit(1)).over(by) * share))
    return rows.withColumn("split", F.when(F.row_number().over(by.orderBy(*order)) <= k, "val").otherwise("train"))


def pack_groups(groups: DataFrame, capacity: int) -> DataFrame:
    """Greedy in order: groups (lane, ord, size) into batches that stay under capacity unless one group alone exceeds it.

    A fold over the sizes of a lane; lanes are independent, and hold sizes only.
    """
    zero = F.struct(F.lit(0).cast("long").alias("batch"), F.lit(0).cast("long").alias("used"), F.array().cast("array<struct<ord: bigint, batch: bigint>>").alias("out"))

    def step(acc, g):
        over = (acc["used"] > 0) & (acc["used"] + g["size"] > capacity)
        batch = acc["batch"] + over.cast("long")
        used = F.when(over, g["size"]).otherwise(acc["used"] + g["size"])
        return F.struct(batch.alias("batch"), used.alias("used"), F.concat(acc["out"], F.array(F.struct(g["ord"].alias("ord"), batch.alias("batch")))).alias("out"))

    lanes = groups.groupBy("lane").agg(F.array_sort(F.collect_list(F.struct(F.col("ord").cast("long").alias("ord"), F.col("size").cast("long").alias("size")))).alias("g"))
    return lanes.select("lane", F.explode(F.aggregate("g", zero, step)["out"]).alias("b")).select("lane", "b.ord", "b.batch")


def sequence_errors(flows: Column, intents: Column) -> Column:
    """Problems of a flow sequence as a sorted array of names."""
    n = F.size(flows)
    distinct_intents = F.array_distinct(intents)
    most = F.array_max(F.transform(distinct_intents, lambda x: F.size(F.filter(intents, lambda y: y == x))))
    checks = [
        ("length", (n < 5) | (n > 7)), ("duplicate", F.size(F.array_distinct(flows)) < n),
        ("few_intents", F.size(distinct_intents) < 3), ("crowded_intent", most > 2),
    ]
    return F.filter(F.array(*[F.when(bad, name) for name, bad in checks]), lambda x: x.isNotNull())


def repaired(flows: Column, known: list[str], longest: int = 7) -> Column:
    """Unknown flows dropped, repeats dropped, cut to the longest allowed."""
    ok = F.array(*[F.lit(k) for k in known])
    return F.slice(F.array_distinct(F.filter(flows, lambda f: F.array_contains(ok, f))), 1, longest)
