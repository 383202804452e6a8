"""Quality rules: per-document statistics, fences learnt from mergeable quantile sketches, joined filtering.

Everything is DataFrame expressions. A text is read once: its statistics are
computed by array functions inside its own row (no word ever crosses a
shuffle), then cut into a small table. The sketch of a metric in a group is a
log-linear histogram over integers: a value keeps its ``BITS`` leading binary
digits, so two sketches merge by adding counts, a group holds a few thousand
counters whatever its size, ranks are exact, a quantile is off by at most one part in 256, and
a recomputed task counts the same. Spark adds the counts map-side, so a source
with a third of all rows costs a few counter rows per task.

A metric's fence lies ``times`` spreads from its median, on both sides where ``lower`` says so. The
spread is the smaller of q90 - q50 and q50 - q10: junk lies on one side, and
what is less than two fifths of a group can't widen both. Where a metric hardly
varies (most texts have no symbol and no repeated line at all), ``slack`` is
the least distance; :func:`slack_report` counts the groups in which it decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from turnwise.llm.common import cut, let, space_words

#: Leading binary digits that a value keeps in a sketch.
BITS = 9
WINDOW = 8
#: Base rule: fewest words, and the largest share of repeated words in percent.
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: A group with fewer documents takes its language's sketch, then that of all documents.
MIN_GROUP = 100
#: metric -> (least slack, multiple of the spread, whether there is a lower fence). Rates are in millionths, word_len
#: in thousandths of a character, log_words in 256ths of a power of two. n_repeat_words has no fence of its own: nine
#: texts in ten have none, so there is no spread to learn, and the base rule bounds it.
FENCES = {
    "symbol_rate": (50_000, 6, False), "dup_line_rate": (50_000, 6, False), "punct_rate": (5_000, 6, True),
    "word_len": (100, 6, True), "log_words": (64, 6, True),
}
METRICS = list(FENCES)
LOWER = [m for m, (_, _, lower) in FENCES.items() if lower]
#: Metric columns and the bounds that a verdict reports.
BOUNDS = [f"{m}_max" for m in METRICS] + [f"{m}_min" for m in LOWER]
NO_PUNCTUATION = r"[^!-/:-@\[-`{-~]+"
NO_SYMBOL = r"[^#*$%&|<>]+"


def _repeat_words(words: Column) -> Column:
    """Words covered by 8-word windows that occur at least twice in the row."""
    hashes = F.transform(
        F.sequence(F.lit(1), F.size(words) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(words, i, WINDOW))
    )

    def covered(hs: Column) -> Column:
        ordered = F.array_sort(F.transform(hs, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def repeated(xs: Column) -> Column:
            at = lambda j: F.get(xs, j)["h"]
            hit = F.filter(xs, lambda x, j: (F.coalesce(at(j - 1) == x["h"], F.lit(False))) | F.coalesce(at(j + 1) == x["h"], F.lit(False)))
            starts = F.array_sort(F.transform(hit, lambda x: x["i"]))
            zero = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n"))
            step = lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(WINDOW), i - acc["last"])).alias("n"))
            return F.aggregate(starts, zero, step, lambda acc: acc["n"])

        return F.when(F.size(F.array_distinct(hs)) == F.size(hs), F.lit(0)).otherwise(let(ordered, repeated))

    return F.when(F.size(words) < WINDOW, F.lit(0)).otherwise(let(hashes, covered))


def text_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without its text, plus n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_punct (long).

    Null and empty texts have zeros everywhere.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    of_words = let(
        space_words(body),
        lambda w: F.struct(
            F.size(w).alias("n_words"),
            F.char_length(F.array_join(w, "")).alias("word_chars"),
            _repeat_words(w).alias("n_repeat_words"),
        ),
    )
    marks = let(
        F.regexp_replace(body, NO_PUNCTUATION, ""),
        lambda m: F.struct(F.octet_length(m).alias("n_punct"), F.octet_length(F.regexp_replace(m, NO_SYMBOL, "")).alias("n_symbols")),
    )
    n_dup_lines = let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))
    kept = [c for c in docs.columns if c != text]
    out = docs.select(*kept, of_words.alias("_w"), marks.alias("_m"), n_dup_lines.alias("_d"))
    names = {"n_words": "_w.n_words", "word_chars": "_w.word_chars", "n_symbols": "_m.n_symbols", "n_dup_lines": "_d", "n_repeat_words": "_w.n_repeat_words", "n_punct": "_m.n_punct"}
    return out.select(*kept, *[F.col(c).cast("long").alias(n) for n, c in names.items()])


def _digits(value: str) -> str:
    return f"length(bin({value}))"


def with_metrics(stats: DataFrame) -> DataFrame:
    """``stats`` and its metrics, whole numbers; no words make zeros."""
    ratio = lambda part, times, whole: F.coalesce(F.expr(f"({part} * {times}) div nullif({whole}, 0)"), F.lit(0)).cast("long")
    return stats.select(
        "*",
        ratio("n_symbols", 1_000_000, "word_chars").alias("symbol_rate"),
        ratio("n_dup_lines", 1_000_000, "n_words").alias("dup_line_rate"),
        ratio("n_punct", 1_000_000, "word_chars").alias("punct_rate"),
        ratio("word_chars", 1_000, "n_words").alias("word_len"),
        F.when(F.col("n_words") > 0, F.expr(f"({_digits('n_words')} - 2) * 256 + shiftright(shiftleft(n_words, 8), {_digits('n_words')} - 1)"))
        .otherwise(F.lit(0)).cast("long").alias("log_words"),
    )


def sketches(stats: DataFrame, keys: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """One row per (keys, metric, cell): the mergeable sketch. Rows of no words are left out."""
    cell = lambda m: F.expr(f"shiftleft(shiftright({m}, greatest(0, {_digits(m)} - {BITS})), greatest(0, {_digits(m)} - {BITS}))")
    metric = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), cell(m).alias("cell")) for m in METRICS])).alias("m")
    return stats.where("n_words > 0").select(*keys, metric).groupBy(*keys, "m.metric", "m.cell").agg(F.count(F.lit(1)).alias("n"))


def quantiles(sketch: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """10th percentile, median and 90th percentile of each (keys, metric): the least cell whose running count reaches the share."""
    by = [*keys, "metric"]
    merged = sketch.groupBy(*by, "cell").agg(F.sum("n").alias("n"))
    running = merged.select(
        *by, "cell",
        F.sum("n").over(Window.partitionBy(*by).orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)).alias("run"),
        F.sum("n").over(Window.partitionBy(*by)).alias("total"),
    )
    return running.groupBy(*by).agg(
        F.max("total").alias("total"),
        *[F.min(F.when(F.col("run") * 10 >= F.col("total") * k, F.col("cell"))).alias(f"q{k}0") for k in (1, 5, 9)],
    )


def thresholds(sketch: DataFrame, keys: tuple[str, str] = ("lang", "source"), min_group: int = MIN_GROUP) -> DataFrame:
    """``keys`` and, per metric, ``<metric>_max``, ``<metric>_min`` where it has one, and ``<metric>_slack``: whether the slack decides.

    Small groups take the merged sketch of their first key, then of all. The three levels go through one pass, told apart by ``level``.
    """
    first, second = keys
    levels = F.explode(F.array(*[F.struct(F.lit(n).alias("level"), *[(F.col(k) if n <= deep else F.lit(None).cast("string")).alias(k) for k, deep in ((first, 1), (second, 0))]) for n in range(3)])).alias("l")
    spread_out = sketch.select(levels, "metric", "cell", "n").select("l.*", "metric", "cell", "n")
    q = quantiles(spread_out, ("level", *keys)).withColumn("spread", F.least(F.col("q90") - F.col("q50"), F.col("q50") - F.col("q10")))
    found = []
    for m, (slack, times, lower) in FENCES.items():
        of = lambda x, m=m: F.max(F.when(F.col("metric") == m, x))
        away = F.greatest(F.lit(slack), F.col("spread") * times)
        found += [of(F.col("q50") + away).alias(f"{m}_max"), of(F.col("spread") * times < slack).alias(f"{m}_slack")]
        found += [of(F.col("q50") - away).alias(f"{m}_min")] if lower else []
    fences = cut(q.groupBy("level", *keys).agg(F.max("total").alias("total"), *found))  # a row a group
    columns = BOUNDS + [f"{m}_slack" for m in METRICS]
    first_level = fences.where("level = 1").select(*[F.col(c).alias(f"l_{c}") for c in fences.columns])
    everything = fences.where("level = 2").first()  # one row
    own = fences.where("level = 0")
    joined = own.join(first_level, own[first].eqNullSafe(F.col(f"l_{first}")), "left")
    of_all = lambda c: F.lit(everything[c] if everything else None).cast(fences.schema[c].dataType)
    pick = lambda c: F.when(F.col("total") >= min_group, F.col(c)).when(F.col("l_total") >= min_group, F.col(f"l_{c}")).otherwise(of_all(c)).alias(c)
    return joined.select(*keys, *[pick(c) for c in columns])


def slack_report(limits: DataFrame) -> DataFrame:
    """metric, groups, by_slack: in how many groups of :func:`thresholds` the least slack decides instead of the learnt spread."""
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"{m}_slack").cast("long").alias("x")) for m in METRICS])).alias("m")
    return limits.select(each).groupBy("m.metric").agg(F.count(F.lit(1)).alias("groups"), F.sum("m.x").alias("by_slack"))


def judged(stats: DataFrame, limits: DataFrame) -> DataFrame:
    """``stats`` with metrics, joined with the limits of their group: base_failed, kept and the bounds."""
    limits = limits.withColumnsRenamed({"lang": "_lang", "source": "_source"})
    rows = stats.join(limits, stats["lang"].eqNullSafe(limits["_lang"]) & stats["source"].eqNullSafe(limits["_source"]), "left")
    base = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)
    out = F.lit(False)
    for m in METRICS:
        out = out | F.coalesce(F.col(m) > F.col(f"{m}_max"), F.lit(False))
    for m in LOWER:
        out = out | F.coalesce(F.col(m) < F.col(f"{m}_min"), F.lit(False))
    return rows.withColumns({"base_failed": base, "kept": ~base & ~out})


def quality_rules(docs: DataFrame, min_group: int = MIN_GROUP) -> DataFrame:
    """Statistics and verdict per row of ``docs`` (doc_id, text, lang, source; other columns are ignored).

    Returns doc_id, the five counts, base_failed, kept, the metrics and their
    bounds. Repeated rows each get their own result; a null
    lang or source is a group of its own; null or empty text has zero words and
    fails the base rule; an empty table gives an empty result.
    """
    stats = cut(with_metrics(text_statistics(docs.select("doc_id", "lang", "source", "text"))))
    limits = thresholds(sketches(stats), min_group=min_group)
    return judged(stats, limits).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", *METRICS, *BOUNDS
    )
