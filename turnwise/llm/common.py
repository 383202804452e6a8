"""Shared pieces of the training-data operators: scratch space, size-checked broadcast, word expressions."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A join side is broadcast only when its counted rows are at most this many.
BROADCAST_ROWS = 200_000
#: ... and the measured text of its rows is at most this many bytes.
BROADCAST_BYTES = 64 << 20

SPACE_CLASS = r"[\x20\x09-\x0D]+"
NON_WORD_CLASS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or the context's checkpoint directory.

    Where both are unset, a local master, whose executor is the driver, gets a
    temporary folder; on a cluster that would hide files from the executors, so it is an error.
    """
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not found and not re.fullmatch(r"local(\[[^]]*\])?", context.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="turnwise-checkpoint-")
        context.setCheckpointDir(found)
    return found


def scratch_dir(spark: SparkSession, what: str) -> str:
    """A fresh folder name under :func:`shared_dir` for files an operator writes."""
    return f"{shared_dir(spark).rstrip('/')}/turnwise-{what}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and cut its lineage: a reliable checkpoint in the shared folder.

    Spark's context cleaner removes the files once nothing refers to them, where
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` is on.
    """
    shared_dir(df.sparkSession)
    if df.sparkSession.sparkContext.getCheckpointDir() is None:
        df.sparkSession.sparkContext.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def fits_broadcast(df: DataFrame, size: Column | None = None) -> bool:
    """Whether ``df`` is counted to have at most BROADCAST_ROWS rows and, by ``size`` of each, BROADCAST_BYTES bytes."""
    n, total = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(size) if size is not None else F.lit(0), F.lit(0))).first()
    return n <= BROADCAST_ROWS and total <= BROADCAST_BYTES


def bounded_broadcast(df: DataFrame, size: Column | None = None) -> DataFrame:
    """``df`` with a broadcast hint when it fits, and unchanged (a shuffled join) beyond that."""
    return F.broadcast(df) if fits_broadcast(df, size) else df


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else (``lower`` would also change accented letters)."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, UPPER.lower())
    )


def space_words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+``; null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS), "")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000):
    """Arrow batches of at most ``rows`` for what runs inside, then the session's setting as it was.

    Spark bounds a batch by 64 MB, of which each task holds some in the executor and in its worker; texts need far less.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, was_set = spark.conf.get(key), key in spark.conf.getAll
    if int(before) <= 0 or int(before) > rows:
        spark.conf.set(key, rows)
    try:
        yield
    finally:
        if was_set:
            spark.conf.set(key, before)
        else:
            spark.conf.unset(key)


def tidy() -> None:
    """Gives memory that a worker no longer uses back to the system: workers live on, next to others and the executor."""
    import pyarrow

    pyarrow.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def sliced(batches, rows: int = 1000):
    """The same rows in Arrow batches of at most ``rows``: Spark bounds a batch by bytes, and a worker turns one at a time into Python objects."""
    for b in batches:
        for first in range(0, b.num_rows, rows):
            yield b.slice(first, rows)
        tidy()


def without(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """``docs`` without the documents whose doc_id is in ``rejected``; rows without a doc_id can't be named and stay."""
    gone = cut(rejected.where("doc_id is not null").select(F.col("doc_id").alias("_gone")).distinct())
    return docs.join(bounded_broadcast(gone), F.col("doc_id") == F.col("_gone"), "left_anti")


def written(df: DataFrame, what: str) -> tuple[DataFrame, str]:
    """``df`` as a Parquet table in the shared folder, read again, and its path."""
    path = scratch_dir(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path), path


def delete(spark: SparkSession, path: str) -> None:
    """Removes a table that :func:`written` made, through Hadoop's file systems."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
