"""Benchmark decontamination: a prefix-filtered set join of benchmark windows with whole documents.

A window (13 consecutive item words, or a whole shorter item) occurs in a
document only if its rarest word does, so that one word is its necessary prefix.
Rarity is counted over all documents.

Documents are exploded to words inside a stage and meet two bit tables, which
are broadcast and never larger than SLOTS bits however many windows there are: words
that are no prefix word go by the first; around the rest, positional and length bounds leave the
places of windows, and those that are no benchmark window with this offset of its prefix go by the
second. What passes, which is occurrences and few others, is joined with the
windows on all their words, which is the exact test. So what is shuffled is one row per document and one
per occurrence, and no document's text leaves its stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwise.llm.common import NON_WORD_CLASS, ascii_lower, bounded_broadcast, cut

WINDOW = 13
#: A document is contaminated when hit words are at least one in this many.
HIT_PART = 20
#: Stands after a document's last word; it can't be a word.
END = "\x00"
#: Bits of a bit table: at most SLOTS / 64 rows of two longs are broadcast, some 30 MB.
SLOTS = 1 << 26


def _words(column: str):
    return F.array_remove(F.split(ascii_lower(F.coalesce(F.col(column), F.lit(""))), NON_WORD_CLASS), "")


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """win array<string>, items array<string>: the distinct windows and the items that have them."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), _words("text").alias("w")).where("size(w) > 0 and item is not null")
    starts = F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - (window - 1)))).alias("i")
    cutout = items.select("item", "w", starts).select("item", F.slice("w", F.col("i"), window).alias("win"))
    return cutout.groupBy("win").agg(F.sort_array(F.collect_set("item")).alias("items"))


def bit_table(hashes: DataFrame) -> DataFrame:
    """slot, bits: a set of the 64-bit numbers ``h``, by their lowest digits."""
    at = F.col("h").bitwiseAND(F.lit(SLOTS - 1))
    bit = F.expr("shiftleft(1L, cast(h & 63L as int))")
    return hashes.select(F.shiftright(at, 6).alias("slot"), bit.alias("bit")).groupBy("slot").agg(F.bit_or("bit").alias("bits"))


def in_table(rows: DataFrame, h: str, table: DataFrame) -> DataFrame:
    """``rows`` whose number ``h`` may be in a bit table."""
    slot = F.shiftright(F.col(h).bitwiseAND(F.lit(SLOTS - 1)), 6)
    met = rows.join(F.broadcast(table), slot == F.col("slot"))  # bounded by SLOTS
    return met.where(F.expr(f"shiftright(bits, cast({h} & 63L as int)) & 1L = 1L")).drop("slot", "bits")


def prefix_table(documents: DataFrame, windows: DataFrame) -> DataFrame:
    """windows with token, off (0-based): the word of each that is rarest over all documents (ties: the smaller, the first)."""
    vocabulary = windows.select(F.explode("win").alias("token")).distinct()
    met = documents.select(F.explode(_words("text")).alias("token")).withColumn("h", F.xxhash64("token"))
    counts = in_table(met, "h", cut(bit_table(vocabulary.select(F.xxhash64("token").alias("h"))))).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    spread = windows.select("win", "items", F.posexplode("win").alias("off", "token")).join(bounded_broadcast(cut(counts), F.length("token")), "token", "left")
    rarest = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token", "off")).alias("p")
    return spread.groupBy("win").agg(rarest, F.any_value("items").alias("items")).select("p.token", "p.off", "win", "items")


def occurrences(places: DataFrame, table: DataFrame) -> DataFrame:
    """doc_id, row, pos, last, start, length, items of the occurring windows of ``table``, and of the row after each document's last word."""
    shapes = table.select("off", F.size("win").alias("n")).distinct().orderBy("n", "off").collect()  # at most window * (window + 1) / 2
    prefixes = bit_table(table.select(F.xxhash64("token").alias("h")).union(places.sparkSession.range(1).select(F.xxhash64(F.lit(END)))))
    windows = bit_table(table.select(F.xxhash64("win", "off").alias("h")).union(places.sparkSession.range(1)))
    some = in_table(places.withColumn("h", F.xxhash64("word")), "h", cut(prefixes)).drop("h")
    shape = F.array(*[F.struct(F.lit(r.off).alias("off"), F.lit(r.n).alias("n")) for r in shapes]).cast("array<struct<off: int, n: int>>")
    fit = F.filter(shape, lambda s: (F.col("pos") >= s["off"]) & (F.col("pos") - s["off"] + s["n"] <= F.size("w")))
    around = F.transform(fit, lambda s: F.struct((F.col("pos") - s["off"]).alias("start"), F.slice("w", F.col("pos") - s["off"] + 1, s["n"]).alias("win"), s["off"].alias("off")))
    # the row after the last word has a key of its own that no window is, and passes as number 0
    last = F.col("word") == END
    end = F.array(F.struct(F.lit(0).alias("start"), F.array(F.lit(END), F.col("row").cast("string")).alias("win"), F.lit(0).alias("off")))
    cuts = some.select("doc_id", "row", "pos", last.alias("last"), F.explode(F.when(last, end).otherwise(around)).alias("c"))
    cuts = cuts.select("doc_id", "row", "pos", "last", "c.start", "c.win", F.when(F.col("last"), F.lit(0)).otherwise(F.xxhash64("c.win", "c.off")).cast("long").alias("h"))
    cuts = in_table(cuts, "h", cut(windows)).drop("h")
    met = cuts.join(table.select("win", "items"), "win", "left").where("last or items is not null")
    return met.select("doc_id", "row", "pos", "last", "start", F.size("win").alias("length"), "items")


def decontaminate(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, hit_part: int = HIT_PART) -> DataFrame:
    """One row per row of ``documents`` (doc_id, text): doc_id, n_words, n_hit, n_items, items_sha256, contaminated,
    and spans (array of start and length of the occurring windows, 0-based words, sorted).

    Rows that repeat a doc_id keep their own result; null and empty texts have
    no words and no hits; items without words, or with a null id, match
    nothing; equal items are each counted. With an empty benchmark every
    document is clean. Columns besides doc_id, text and item_id are ignored.
    """
    windows = cut(benchmark_windows(benchmark.select("item_id", "text"), window))
    table = cut(prefix_table(documents.select("text"), windows))
    rows = documents.select("doc_id", F.monotonically_increasing_id().alias("row"), _words("text").alias("w"))  # read once
    places = rows.select("doc_id", "row", "w", F.posexplode(F.concat("w", F.array(F.lit(END)))).alias("pos", "word"))
    met = occurrences(places, table).select(
        "doc_id", "row",
        F.when(F.col("last"), F.col("pos")).alias("n_words"),
        F.when(~F.col("last"), F.struct("start", "length")).alias("span"),
        F.when(~F.col("last"), F.col("items")).alias("items"),
    )
    per = met.groupBy("row", "doc_id").agg(
        F.max("n_words").cast("long").alias("n_words"),
        F.array_sort(F.collect_set("span")).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    zero = F.struct(F.lit(0).alias("to"), F.lit(0).alias("n"))
    step = lambda a, s: F.struct(
        F.greatest(a["to"], s["start"] + s["length"]).alias("to"),
        (a["n"] + F.greatest(F.lit(0), s["start"] + s["length"] - F.greatest(a["to"], s["start"]))).alias("n"),
    )
    out = per.select(
        "doc_id", "n_words", "spans",
        F.aggregate("spans", zero, step, lambda a: a["n"]).cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
    )
    bad = (F.col("n_hit") > 0) & (F.col("n_hit") * hit_part >= F.col("n_words"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", bad.alias("contaminated"), "spans")
