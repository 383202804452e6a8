"""Labelled extensions: nothing here is claimed to be part of the original. Event-time windows, cube, sessions, a warm-up."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnwise.plans import adapters as A
from turnwise.plans.registry import query
from turnwise.sources import files as S_

DAILY = "SELECT date_trunc('day', ts)::TIMESTAMP AS day, event_type, count(*) AS n FROM events GROUP BY ALL"


@query("EXT_daily_windows", DAILY)
def daily(spark, d):
    e = A.table(spark, d, "events")
    return e.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("day"), "event_type", "n")


@query("EXT_daily_windows_stream", DAILY)
def daily_stream(spark, d):
    """The same as a stream: watermark, tumbling window, all that is there; the state goes to a table after each wave."""
    base = S_.scratch(spark, "windows")
    schema = A.table(spark, d, "events").schema
    A.table(spark, d, "events").repartition(3).write.parquet(f"{base}/in")
    counts = (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
        .withColumn("ts", F.to_timestamp(F.concat(F.col("ts").cast("string"), F.lit("Z")))).withWatermark("ts", "400 days")  # event time is UTC
        .groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    )
    day = F.to_utc_timestamp(F.col("w.start"), F.current_timezone()).cast("timestamp_ntz").alias("day")
    sink = lambda rows, _: rows.select(day, "event_type", "n").write.mode("overwrite").parquet(f"{base}/out")
    counts.writeStream.outputMode("complete").foreachBatch(sink).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{base}/out")


@query("EXT_sessions", "WITH g AS (SELECT user_id, ts, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 1 DAY, true)::INT AS new FROM events), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS started, count(*) AS n FROM s GROUP BY user_id, k")
def sessions(spark, d):
    e = A.table(spark, d, "events")
    s = e.groupBy("user_id", F.session_window("ts", "1 day").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return s.select("user_id", F.col("w.start").alias("started"), "n")


@query("EXT_cube", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube(spark, d):
    return A.table(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("EXT_customer_revenue", "SELECT n_name, count(DISTINCT o_orderkey) AS orders, sum(round(l_extendedprice * 100)::BIGINT * (100 - round(l_discount * 100)::BIGINT))::BIGINT AS revenue_e4 FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' GROUP BY n_name")
def revenue(spark, d):
    t = lambda n: A.table(spark, d, n)
    j = t("lineitem").where("l_returnflag = 'R'").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    j = j.join(F.broadcast(t("nation")), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 rows
    cents = lambda c: F.round(F.col(c) * 100).cast("long")
    # in ten-thousandths, so that sums are exact whatever their order
    return j.groupBy("n_name").agg(F.count_distinct("o_orderkey").alias("orders"), F.sum(cents("l_extendedprice") * (100 - cents("l_discount"))).alias("revenue_e4"))
