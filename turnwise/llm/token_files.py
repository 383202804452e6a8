"""Token-id files: flat unsigned integers, 64-bit document offsets, partition bases from prefix sums.

A folder holds, per shard k of a range partitioning by doc_id,

    tokens-k.bin   ids of its documents, end ids included, one after the other; uint16 where the vocabulary allows it, else uint32
    offsets-k.bin  int64, one more than documents: where each starts in tokens-k.bin, and the end
    doc_ids-k.bin  int64 in ascending order; the least int64 stands for null
    manifest/      Parquet, one row a shard: shard, width, n_docs, n_tokens

all little-endian. A shard's base is the sum of n_tokens over the shards before
it. Files appear under their names only when complete, and a repeated task writes
the same bytes, so losing an executor costs its running shards.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from turnwise.llm.bpe import END_ID, TOKENIZER, encoder, put_together
from turnwise.llm.common import small_batches
from turnwise.llm.files import Pending, mapped

NULL_ID = int(np.iinfo(np.int64).min)


def write_token_files(docs: DataFrame, folder: str, tokenizer: str = TOKENIZER, end_id: int = END_ID) -> None:
    """Encodes every whole text of ``docs`` (doc_id, text) into ``folder``, in ascending doc_id order (null first, ties by text)."""

    def run(batches):
        bpe = encoder(tokenizer)
        dtype = "<u2" if bpe.vocabulary <= 1 << 16 and end_id < 1 << 16 else "<u4"
        shard, files, offsets, ids = TaskContext.get().partitionId(), None, [np.zeros(1, np.int64)], []
        for b in put_together(batches):
            files = files or [Pending(folder, f"{kind}-{shard:06d}.bin") for kind in ("tokens", "offsets", "doc_ids")]
            tokens, at = bpe.encode_many(b.column("text"), end_id)
            files[0].write(tokens.astype(dtype).tobytes())
            offsets.append(offsets[-1][-1] + at[1:])
            ids.append(b.column("doc_id").fill_null(NULL_ID).to_numpy())
        if files:
            offsets, ids = np.concatenate(offsets), np.concatenate(ids)
            files[1].write(offsets.astype("<i8").tobytes())
            files[2].write(ids.astype("<i8").tobytes())
            for f in files:
                f.commit()
            yield pa.RecordBatch.from_pydict(
                {"shard": [shard], "width": [int(dtype[2])], "n_docs": [len(ids)], "n_tokens": [int(offsets[-1])]},
                schema=pa.schema([("shard", pa.int64()), ("width", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]),
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    written = ordered.mapInArrow(run, "shard long, width int, n_docs long, n_tokens long")
    with small_batches(docs.sparkSession):
        written.write.mode("overwrite").parquet(f"{folder}/manifest")


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files alone."""
    manifest = spark.read.parquet(f"{folder}/manifest")
    n = manifest.count()
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row a shard
    based = manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))

    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                name = f"{row['shard']:06d}.bin"
                tokens = mapped(folder, f"tokens-{name}", f"<u{row['width']}")
                offsets, ids = mapped(folder, f"offsets-{name}", "<i8"), mapped(folder, f"doc_ids-{name}", "<i8")
                crcs = [zlib.crc32(tokens[i:j].astype("<u4").tobytes()) for i, j in zip(offsets[:-1], offsets[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids, mask=np.asarray(ids) == NULL_ID), pa.array(offsets[:-1] + row["base"]),
                        pa.array(np.diff(offsets)), pa.array(crcs, pa.int64()),
                    ],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return based.repartitionByRange(max(1, n), "shard").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, folder: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """Writes the files, then returns what they say of each document.

    Null and empty texts are the end id alone; a null doc_id comes first and
    reads back as null; rows that repeat a doc_id stand next to each other,
    ordered by text; an empty table makes an empty manifest. Columns other than
    doc_id and text are ignored.
    """
    write_token_files(docs, folder, tokenizer)
    return read_token_files(docs.sparkSession, folder)
