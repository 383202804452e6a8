"""Readers and sinks of conversation files: JSON, JSON lines, Markdown tables, file-name columns, atomic rewrites."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CORRUPT = "_corrupt_record"


def checkpoints(spark: SparkSession) -> str:
    """The folder that the cluster shares: spark.checkpoint.dir. Where it is unset, a local master gets a temporary one; on a cluster that is an error."""
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not base and not re.fullmatch(r"local(\[[^]]*\])?", context.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    base = base or "file://" + tempfile.mkdtemp(prefix="turnwise-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(base)
    return base


def scratch(spark: SparkSession, what: str) -> str:
    """A fresh folder name in :func:`checkpoints`."""
    return f"{checkpoints(spark).rstrip('/')}/turnwise-{what}-{uuid.uuid4().hex}"


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A file that holds one object or a list of them."""
    return spark.read.option("multiLine", True).schema(schema).json(path)


def write_arrays(rows: DataFrame, path: str, part: str) -> None:
    """A JSON file for every value of the column ``part``, that holds a list of its rows.

    Each value has a folder and one row of text, so a file never holds two lists, of
    which :func:`read_json` would see the first only. A list is built in one row: values should be of bounded size.
    """
    fields = F.struct(*[c for c in rows.columns if c != part])
    rows.groupBy(part).agg(F.to_json(F.collect_list(fields)).alias("value")).write.partitionBy(part).text(path)


def read_lines(spark: SparkSession, path: str, schema: str, strict: bool = False) -> DataFrame:
    """JSON lines. Lenient: rows with ``_corrupt_record`` set for lines that don't parse; strict: the first one fails the query."""
    if strict:
        return spark.read.option("mode", "FAILFAST").schema(schema).json(path)
    lines = spark.read.text(path).where("trim(value) <> ''")
    parsed = F.from_json("value", f"{schema}, {CORRUPT} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    return lines.select(parsed.alias("j")).select("j.*")


def good(lines: DataFrame) -> DataFrame:
    """Without the lines that didn't parse."""
    return lines.where(F.col(CORRUPT).isNull()).drop(CORRUPT)


def file_columns(df: DataFrame) -> DataFrame:
    """domain, config_id and seed out of names like ``d0_c1_seed2.jsonl`` (folders and part files too); rows of other names are dropped."""
    name = F.regexp_extract(F.col("_metadata.file_path"), r"/([^/]+_seed\d+)(?:\.jsonl|/)", 1)
    parts = F.regexp_extract
    out = df.withColumn("_name", name).where("_name <> ''")
    pattern = r"^([^_]+)_(.+)_seed(\d+)$"
    return out.withColumns({"domain": parts("_name", pattern, 1), "config_id": parts("_name", pattern, 2), "seed": parts("_name", pattern, 3).cast("int")}).drop("_name")


def markdown_rows(lines: DataFrame, order: str = "n") -> DataFrame:
    """intent, flow, description of the pipe tables under ``## Intent (...)`` headings. ``lines``: doc, n, value of a small text.

    The heading is carried forward within its document.
    """
    head = F.nullif(F.regexp_extract("value", r"^## (\w+) \(", 1), F.lit(""))
    w = Window.partitionBy("doc").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    carried = lines.withColumn("intent", F.last(head, ignorenulls=True).over(w)).where(r"value RLIKE '^\\|' AND NOT value RLIKE '^\\|[ :-]+\\|' AND intent IS NOT NULL")
    cells = F.transform(F.split("value", r"\|"), lambda c: F.trim(c))
    return carried.select("doc", "intent", F.get(cells, F.lit(1)).alias("flow"), F.get(cells, F.lit(2)).alias("description")).where("flow <> 'Flow'")


def _moved(fs, source, target) -> None:
    if not fs.rename(source, target):
        raise OSError(f"{source} could not be renamed to {target}")


def delete_keys(spark: SparkSession, path: str, ids: DataFrame, key: str, staging: str) -> int:
    """Rewrites a JSON folder without the rows of ``ids``: to ``staging``, then by renaming. Returns the rows left.

    The old folder is deleted only once the new one stands in its place; a
    rename that fails leaves, or brings back, the old folder and raises.
    """
    rows = spark.read.json(path)
    rows.join(ids.select(key), key, "left_anti").write.mode("overwrite").json(staging)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    old, new, aside = hadoop(path), hadoop(staging), hadoop(f"{path}.old")
    fs = old.getFileSystem(spark._jsc.hadoopConfiguration())
    replace_folder(fs, old, new, aside)
    return spark.read.json(path).count()


def replace_folder(fs, old, new, aside) -> None:
    """``new`` takes the place of ``old``, which waits at ``aside`` until that has worked."""
    if fs.exists(aside):
        raise OSError(f"{aside} is left from a replacement that did not end")
    _moved(fs, old, aside)
    try:
        _moved(fs, new, old)
    except Exception:
        _moved(fs, aside, old)
        raise
    fs.delete(aside, True)


def category_rank(category: Column) -> Column:
    order = ["same_flow", "switch_flow", "ambiguous_first", "ambiguous_second"]
    at = F.array_position(F.array(*[F.lit(c) for c in order]), category)
    return F.when(at > 0, at).otherwise(F.lit(999))


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def first_that_exists(spark: SparkSession, paths: list[str]) -> str:
    for p in paths:
        if exists(spark, p):
            return p
    raise FileNotFoundError(", ".join(paths))


def remote_predictions(prompts: DataFrame, call, schema: str) -> DataFrame:
    """Predictions from an injected ``call(dict) -> dict`` per row, in Arrow batches; there is no default model."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_pylist([call(r) for r in b.to_pylist()])

    return prompts.mapInArrow(run, schema)


def chat_examples(history: DataFrame) -> DataFrame:
    """messages, label: the chat form of training examples. ``history``: speaker history texts, utterance, label."""
    said = F.transform("history", lambda h: F.struct(F.when(F.startswith(h, F.lit("agent")), "assistant").otherwise("user").alias("role"), F.regexp_replace(h, r"^\w+: ", "").alias("content")))
    last = F.array(F.struct(F.lit("user").alias("role"), F.col("utterance").alias("content")))
    return history.withColumn("messages", F.concat(said, last))


#: Most rows that go into a page.
PAGE_ROWS = 10_000
_DATA = "const DATA = "


def inject(rows: DataFrame, template: str) -> DataFrame:
    """One row, value: ``template`` with the rows as ``const DATA = [...];`` on a line of its own, in place of its own ``const DATA = ...;``.

    For results of at most PAGE_ROWS rows; more raise an error. JSON has no line
    feeds, and ``<`` is written as an escape, so no value ends the line or the script.
    """
    found = re.search(r"const DATA = [^\n]*?;", template)
    if not found:
        raise ValueError("the template has no const DATA = ...;")
    if rows.limit(PAGE_ROWS + 1).count() > PAGE_ROWS:
        raise ValueError(f"more than {PAGE_ROWS} rows for a page")
    before, after = template[: found.start()], template[found.end() :]
    data = rows.agg(F.to_json(F.array_sort(F.collect_list(F.struct(*rows.columns)))).alias("data"))
    return data.select(F.concat(F.lit(f"{before}\n{_DATA}"), F.replace("data", F.lit("<"), F.lit("\\u003c")), F.lit(f";\n{after}")).alias("value"))


def injected(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of a page that :func:`inject` made."""
    line = spark.read.text(path).where(F.col("value").startswith(_DATA)).select(F.expr(f"substring(value, {len(_DATA) + 1}, length(value) - {len(_DATA) + 1})").alias("data"))
    return line.select(F.inline(F.from_json("data", f"array<struct<{schema.replace(' ', ': ').replace(',:', ',')}>>")))


def markdown_table(rows: DataFrame) -> DataFrame:
    """value: the lines of a pipe table of a small result."""
    spark = rows.sparkSession
    head = spark.createDataFrame([(" | ".join(rows.columns),), (" | ".join("---" for _ in rows.columns),)], "value string")
    return head.unionByName(rows.select(F.concat_ws(" | ", *[F.col(c).cast("string") for c in rows.columns]).alias("value")))
