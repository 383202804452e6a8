"""Best-fit decreasing packing of token pieces into sequences of a fixed length.

Pieces are dealt by hash into packing groups of some millions of tokens, each
large enough that its one part-filled sequence is lost among thousands. In a group,
a segment tree over remaining capacities finds the fullest open sequence that a
piece still fits, in log(capacity) steps. The number of groups follows the
tokens, so a task's work does not.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwise.llm.bpe import END_ID, TOKENIZER, encoder, put_together
from turnwise.llm.common import cut, small_batches

CAPACITY = 2048
GROUP_TOKENS = 8192 * CAPACITY
GROUP_PIECES = 400_000
#: The encoder's parts are smaller than by default, as the pipeline's earlier stages leave executors large.
CACHE_PIECES, MANY_BYTES = 1_000_000, 2 << 20


class Capacities:
    """Open sequences by remaining capacity; the tree holds in each node whether a leaf below has one."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _add(self, leaf: int, n: int) -> None:
        i = leaf + self.leaves
        while i:
            self.count[i] += n
            i >>= 1

    def put(self, remaining: int, sequence: int) -> None:
        if remaining:
            self.open[remaining].append(sequence)
            self._add(remaining, 1)

    def take(self, size: int) -> tuple[int, int] | None:
        """The open sequence with the least remaining capacity of at least ``size``: (sequence, remaining)."""
        i = size + self.leaves
        if not self.count[i]:
            while i > 1 and (i & 1 or not self.count[i + 1]):  # up to the first right neighbour that has one
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.leaves:
                i = 2 * i if self.count[2 * i] else 2 * i + 1
        leaf = i - self.leaves
        sequence = self.open[leaf].pop()
        self._add(leaf, -1)
        return sequence, leaf


def best_fit_decreasing(sizes, capacity: int = CAPACITY) -> tuple[list[int], list[int]]:
    """(sequence, offset) of each size, placed in order of falling size; ties in the order given."""
    sequence, offset = [0] * len(sizes), [0] * len(sizes)
    room, n = Capacities(capacity), 0
    for i in np.argsort(-np.asarray(sizes, np.int64), kind="stable").tolist():
        size = int(sizes[i])
        got = room.take(size)
        if got is None:
            got, n = (n, capacity), n + 1
        sequence[i], offset[i] = got[0], capacity - got[1]
        room.put(got[1] - size, got[0])
    return sequence, offset


def token_pieces(docs: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids, little-endian uint32 bytes) of every whole text.

    Texts of more than ``capacity`` ids are cut from their end, so that only the first piece may be shorter.
    """

    def run(batches):
        bpe = encoder(tokenizer, CACHE_PIECES, MANY_BYTES)
        for b in put_together(batches):
            rows = []
            ids, offsets = bpe.encode_many(b.column("text"), end_id)
            for doc_id, at, to in zip(b.column("doc_id").to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                n = to - at
                first = (n - 1) % capacity + 1
                for k, start in enumerate([0, *range(first, n, capacity)]):
                    stop = first if k == 0 else start + capacity
                    part = ids[at + start : at + stop]
                    rows.append((doc_id, k, start, stop - start, zlib.crc32(part), part.tobytes() if with_ids else None))
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            arrays = [pa.array(columns[i], t) for i, t in enumerate([pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()])]
            keep = 6 if with_ids else 5
            yield pa.RecordBatch.from_arrays(arrays[:keep], ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][:keep])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids binary" if with_ids else "")
    return rows.mapInArrow(run, schema)


def pack(pieces: DataFrame, capacity: int = CAPACITY, group_tokens: int = GROUP_TOKENS, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """``pieces`` (doc_id, piece, start, length, ids_crc32) with sequence_id and offset. Lengths are from 1 to ``capacity``."""
    tokens, rows = pieces.agg(F.coalesce(F.sum("length"), F.lit(0)), F.count(F.lit(1))).first()
    groups = max(1, -(-tokens // group_tokens), -(-rows // group_pieces))

    def run(key, table):
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        sequence, offset = best_fit_decreasing(table.column("length").to_pylist(), capacity)
        ids = np.asarray(sequence, np.int64) + (key[0].as_py() << 32)
        return table.drop_columns(["_group"]).append_column("sequence_id", pa.array(ids)).append_column("offset", pa.array(offset, pa.int64()))

    dealt = pieces.withColumn("_group", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups)))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return dealt.groupBy("_group").applyInArrow(run, schema)


def best_fit_packing(docs: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY) -> DataFrame:
    """Every whole text of ``docs`` (doc_id, text) as placed pieces: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are one piece, the end id; a null doc_id stays null;
    repeated rows are packed each; an empty table packs nothing. Other columns are ignored.
    """
    with small_batches(docs.sparkSession):
        pieces = cut(token_pieces(docs, tokenizer, capacity))
    return pack(pieces, capacity)


def packed_ids(docs: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY) -> DataFrame:
    """The sequences themselves: sequence_id, n_tokens, ids (little-endian uint32 bytes)."""
    with small_batches(docs.sparkSession):
        pieces = cut(token_pieces(docs, tokenizer, capacity, with_ids=True))
    placed = pack(pieces.drop("ids"), capacity)
    key = ["doc_id", "piece", "ids_crc32"]
    content = pieces.groupBy(*key).agg(F.first("ids").alias("ids"))
    on = [placed[k].eqNullSafe(content[k]) for k in key]
    joined = placed.join(content, on).select("sequence_id", "offset", "length", "ids")
    parts = F.array_sort(F.collect_list(F.struct("offset", "length", "ids")))  # at most `capacity` of them
    return joined.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), parts.alias("p")).select(
        "sequence_id", "n_tokens", F.aggregate(F.col("p.ids"), F.lit(b""), lambda a, x: F.concat(a, x)).alias("ids")
    )
