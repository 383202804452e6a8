"""Incremental processing: files that arrive, keys that are done, bounded waves, retries."""

from __future__ import annotations

import hashlib
import logging
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from turnwise.operators.relational import counted


def run_available(
    spark: SparkSession, source: str, schema: str, sink: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame], key: str, files_per_wave: int = 2
) -> None:
    """Processes what has arrived in ``source`` (JSON lines), in waves of files, and appends it to ``sink`` (Parquet, a folder a wave).

    Of rows of one key the first wave's stands, and within a wave the smallest
    row. Keys that other waves have written are left out by an anti-join that reads the key
    column alone; a wave that is repeated after a failure replaces its own
    folder. The checkpoint remembers the files. Ends when nothing is left. Rows in the sink have ``wave``, the number of theirs.
    """
    run = hashlib.md5(checkpoint.encode()).hexdigest()[:8]  # another checkpoint counts its waves anew

    def wave(rows: DataFrame, wave_id: int) -> None:
        session = rows.sparkSession
        made = transform(rows)
        rest = [c for c in made.columns if c != key]
        new = made.groupBy(key).agg(F.min(F.struct(*rest)).alias("r")).select(key, "r.*") if rest else made.distinct()
        own = f"{run}-{wave_id}"
        try:
            new = new.join(session.read.parquet(sink).where(F.col("run") != own).select(key), key, "left_anti")
        except Exception as e:  # the first wave has no sink yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
        new.withColumn("wave", F.lit(wave_id).cast("long")).write.mode("overwrite").parquet(f"{sink}/run={own}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_wave).json(source)
    q = stream.writeStream.foreachBatch(wave).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def retried(rows: DataFrame, evaluate: Callable[[Column], Column], lane: str, key: str, batch_size: int, passes: int = 2) -> DataFrame:
    """``rows`` with ok, attempt and batch: what fails is batched anew, in half-sized batches of its lane, and evaluated again, ``passes`` times.

    ``evaluate`` gives a Column of the attempt number: whether a row succeeds then. Attempt 1
    is in batches of ``batch_size``; every row keeps the batch of its last attempt.
    """
    left, done = rows, None
    for attempt in range(1, passes + 2):
        size = batch_size if attempt == 1 else max(1, batch_size // 2)
        at = F.row_number().over(Window.partitionBy(lane).orderBy(key)) - 1
        tried = left.withColumns({"attempt": F.lit(attempt), "batch": F.floor(at / size), "ok": evaluate(F.lit(attempt))})
        final = tried if attempt == passes + 1 else tried.where("ok")
        done = final if done is None else done.unionByName(final)
        left = tried.where(~F.col("ok")).drop("attempt", "batch", "ok")
    return done


#: Parts of an error's text after which another attempt makes sense, and those after which none does. Fixed values.
RETRYABLE = "ratelimit|rate_limit|rate limit|resource_exhausted|timeout|internal|server|429|500|503"
EXHAUSTED = "per_day|per_model_per_day"


def paced(rows: DataFrame, lane: str, arrival: str, order: str, interval: int, bucket: int) -> DataFrame:
    """``rows`` with start: when each may go if a lane lets one go every ``interval``, in the order of arrival (ties: ``order``).

    One after the other, start is the later of the arrival and the last start plus the interval; so it is k * interval plus
    the running maximum of arrival - k * interval for the k-th of its lane. Both k and the maximum are found in two levels, by
    spans of ``bucket`` units of time, so that no task orders a whole lane.
    """
    rows = rows.withColumns({"_at": F.struct(arrival, order), "_b": F.floor(F.col(arrival) / bucket)})
    numbered = counted(rows, [F.col(lane)], "_at", F.col("_b")).withColumn("_v", F.col(arrival) - F.col("pos") * interval)
    tops = numbered.groupBy(lane, "_b").agg(F.max("_v").alias("_top"))
    before = Window.partitionBy(lane).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select(lane, "_b", F.max("_top").over(before).alias("_top"))
    within = F.max("_v").over(Window.partitionBy(lane, "_b").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    out = numbered.withColumn("_m", within).join(tops, [lane, "_b"])
    return out.withColumn("start", F.col("pos") * interval + F.greatest("_m", "_top")).drop("_at", "_b", "_v", "_m", "_top", "pos")


def backoff(error: Column, attempt: Column, base: float = 0.5, retries: int = 3) -> Column:
    """Seconds to wait after an error at ``attempt`` (from 0), doubling; null where no other attempt is made."""
    text = F.lower(error)
    least = F.when(text.contains("429"), 5.0).otherwise(0.5)
    return F.when(text.rlike(RETRYABLE) & ~text.rlike(EXHAUSTED) & (attempt < retries), F.greatest(F.lit(base) * F.pow(F.lit(2.0), attempt), least))


def generated(samples: DataFrame, existing: DataFrame, generate: Callable[[DataFrame], DataFrame], group: str, index: str, key: str, again: list[str] | None = None) -> DataFrame:
    """``existing`` rows and those that ``generate`` makes of the samples still lacking: in each group, the samples past as many as exist.

    With ``again``, just the samples with these keys are made, in place of what existed under them. ``generate``
    gives rows with the columns of ``existing``; a failure is a row it leaves out. It is asked about each sample once.
    """
    if again is not None:
        named = [F.lit(k) for k in again]
        return existing.where(~F.col(key).isin(named)).unionByName(generate(samples.where(F.col(key).isin(named))).select(*existing.columns))
    have = existing.groupBy(group).agg(F.count(F.lit(1)).alias("_have"))
    lacking = samples.join(have, group, "left").where(F.col(index) >= F.coalesce("_have", F.lit(0))).drop("_have")
    return existing.unionByName(generate(lacking).select(*existing.columns))


def rerun(spark: SparkSession, runner: Callable[[int, str], None], folder: str, name: str, seeds: list[int], schema: str) -> DataFrame:
    """Calls ``runner(seed, path)`` for each seed and reads what it wrote as JSON lines; a runner that raises is logged and has no rows."""
    made = None
    for seed in seeds:
        path = f"{folder}/{name}_seed{seed}.jsonl"
        try:
            runner(seed, path)
        except Exception as e:  # whatever a runner does must not stop the others
            logging.getLogger(__name__).warning("%s, seed %s: %s", name, seed, e)
            continue
        rows = spark.read.schema(schema).json(path)
        made = rows if made is None else made.unionByName(rows)
    return spark.createDataFrame([], schema) if made is None else made


def next_attempts(results: DataFrame, attempts: int = 3) -> DataFrame:
    """Rows that failed and may be tried again, with their next attempt number."""
    return results.where(~F.col("ok") & (F.col("attempt") < attempts)).withColumn("attempt", F.col("attempt") + 1)


def verdict(ok: Column, attempt: Column, attempts: int = 3) -> Column:
    """ok, retry, or warn: accepted with warnings after the last attempt."""
    return F.when(ok, "ok").when(attempt >= attempts, "warn").otherwise("retry")


def safe(value: Column, fallback: Column) -> Column:
    """The value, or the fallback where it is null: the column form of an error row."""
    return F.coalesce(value, fallback)


#: stage name -> expression of the reward; stages are joined by "+"
STAGES: dict[str, Callable[[], Column]] = {}


def stage(name: str):
    def put(f):
        STAGES[name] = f
        return f

    return put


def composed(spec: str, weights: list[float] | None = None) -> Column:
    """The weighted reward of stages like ``flow+tool``; equal weights by default."""
    names = spec.split("+")
    w = weights or [1 / len(names)] * len(names)
    return sum((STAGES[n]().cast("double") * x for n, x in zip(names, w, strict=True)), F.lit(0.0))
