"""A reader of the YAML that tool catalogs are written in: nested mappings and lists by indentation, flow collections, quoted and plain scalars, comments."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

_KEY = re.compile(r"""("[^"]*"|'[^']*'|[^\s"'{\[#&*!|>%@`-][^:#]*|-[^\s:#][^:#]*)\s*:(?:\s+(.*))?$""")


def _bare(line: str) -> str:
    """Without a comment."""
    quote = ""
    for i, c in enumerate(line):
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'" and (i == 0 or line[i - 1] in " [{,:"):
            quote = c
        elif c == "#" and (i == 0 or line[i - 1].isspace()):
            return line[:i].rstrip()
    return line.rstrip()


def _scalar(text: str) -> str | None:
    if text[:1] in ("'", '"') and text[-1:] == text[:1] and len(text) > 1:
        inner = text[1:-1]
        return inner.replace("''", "'") if text[0] == "'" else inner.replace('\\"', '"').replace("\\n", "\n").replace("\\\\", "\\")
    return None if text in ("", "~", "null") else text


def _parts(text: str) -> list[str]:
    """The elements between top-level commas."""
    out, depth, quote, start = [], 0, "", 0
    for i, c in enumerate(text):
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'" and not text[start:i].strip().rpartition(":")[2].strip():
            quote = c
        elif c in "[{":
            depth += 1
        elif c in "]}":
            depth -= 1
        elif c == "," and not depth:
            out.append(text[start:i])
            start = i + 1
    return [x.strip() for x in [*out, text[start:]] if x.strip()]


def _flow(path: list[str], text: str):
    if text.startswith("["):
        for k, x in enumerate(_parts(text[1:-1])):
            yield from _flow([*path, str(k)], x)
    elif text.startswith("{"):
        for x in _parts(text[1:-1]):
            key, _, value = x.partition(":")
            yield from _flow([*path, _scalar(key.strip()) or ""], value.strip())
    else:
        yield path, _scalar(text)


def leaves(text: str):
    """(path, value) of each scalar, in order; an element of a list has its number as key. Empty collections have none; a key without a value has null."""
    lines = [(len(x) - len(x.lstrip(" ")), x.strip()) for x in map(_bare, text.split("\n")) if x.strip() and x.strip() != "---"]
    open_: list[list] = []  # indent, key, elements so far, whether it is an element itself
    for at, (indent, content) in enumerate(lines):
        while open_ and (open_[-1][0] > indent or open_[-1][0] == indent and not (content.startswith("- ") and not open_[-1][3])):
            open_.pop()
        while content.startswith("- "):
            number = open_[-1][2] if open_ else 0
            if open_:
                open_[-1][2] += 1
            open_.append([indent, str(number), 0, True])
            inner = content[2:].lstrip()
            indent, content = indent + len(content) - len(inner), inner
        path = [x[1] for x in open_]
        key = _KEY.match(content) if content[0] not in "[{" else None
        if not key:
            yield from _flow(path, content)
            continue
        name, value = _scalar(key[1].strip()) or "", (key[2] or "").strip()
        if value:
            yield from _flow([*path, name], value)
            continue
        open_.append([indent, name, 0, False])
        after = lines[at + 1] if at + 1 < len(lines) else (-1, "")
        if not (after[0] > indent or after[0] == indent and after[1].startswith("- ")):
            yield [*path, name], None


def read_yaml(spark: SparkSession, path: str) -> DataFrame:
    """file, n, path array<string>, value string: the scalars of each YAML file (a file is read whole, so these are catalogs, not data)."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            for name, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                rows = [{"file": name, "n": n, "path": p, "value": v} for n, (p, v) in enumerate(leaves(content.decode()))]
                kinds = pa.schema([("file", pa.string()), ("n", pa.int64()), ("path", pa.list_(pa.string())), ("value", pa.string())])
                yield pa.RecordBatch.from_pylist(rows, schema=kinds)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "file string, n bigint, path array<string>, value string")
