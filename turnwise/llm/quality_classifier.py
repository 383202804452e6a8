"""Quality classifier: a factorization machine over hashed words, structure statistics and length metadata.

Statistics of a text enter as terms of their own, one for each interval, so that
the machine learns their interactions with words and with each other.
"""

from __future__ import annotations

import re
from math import log2

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwise.llm import fm

_SYMBOLS = "#*$%&|<>~^=_{}[]\\@"


def _tenth(name: str, part: float, whole: float, times: int = 20) -> str:
    return f"{name}={int(times * part / whole) if whole else -1}"


def extract(text: str):
    words = text.split()
    n, lines = len(words), text.split("\n")
    distinct = set(words)
    marks = sum(map(text.count, _SYMBOLS))
    ends = sum(map(text.count, ".!?"))
    length = len(text)
    stats = [
        f"\tn={int(log2(n + 1))}",
        f"\tlines={int(log2(len(lines)))}",
        _tenth("\tupper", sum(map(str.isupper, words)), n),
        _tenth("\tdistinct", len(distinct), n, 10),
        _tenth("\ttwice", sum(map(str.__eq__, words, words[1:])), n),
        _tenth("\tmarks", marks, length, 50),
        _tenth("\tloud", text.count("!"), n, 10),
        _tenth("\tends", ends, n),
        _tenth("\tlen", length - n, n, 1),
        _tenth("\tdigits", sum(map(text.count, "0123456789")), length, 20),
        _tenth("\tsame", len(lines) - len(set(lines)), len(lines), 10),
    ]
    return distinct, stats


_SHAPE = re.compile(r"[^\W\d_]+")


def terms(word: str) -> list[str]:
    w = word[:64]
    return ["w" + w.lower(), "s" + _SHAPE.sub(lambda m: "X" if m[0].isupper() and len(m[0]) > 1 else "a", w)]


def held_out():
    return fm.crc_of_id(F.col("doc_id")) % 5 == 0


def quality_classifier(docs: DataFrame, labels: DataFrame, max_train_rows: int = fm.MAX_TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted per row of ``docs`` (doc_id, text).

    Learns ``labels.quality`` of rows that are not held out; nothing but the
    text enters a score. Null and empty texts get the score of an empty text; a
    null doc_id is not held out and never learnt from; repeated rows each get
    their score; without any label every score is one half. Other columns are
    ignored.
    """
    model = fm.train(docs, labels, "quality", held_out(), extract, terms, max_train_rows, min_strength=3.0)
    return fm.score(docs, model, held_out(), extract, terms)
