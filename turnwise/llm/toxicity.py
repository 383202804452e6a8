"""Toxicity: a factorization machine over hashed words and word beginnings.

Inflected and compounded languages hide an insult in the beginning of many
words; a term for each beginning lets the fit carry over to forms it never saw.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwise.llm import fm

_WORD = re.compile(r"\w+")


def extract(text: str):
    return set(_WORD.findall(text.lower())), ()


def terms(word: str) -> list[str]:
    out = ["w" + word[:64]]
    for n in (4, 5, 6):
        if len(word) > n:
            out.append(f"{n}{word[:n]}")
    return out


def held_out():
    return fm.crc_of_id(F.col("doc_id")) % 4 == 2


def toxicity(docs: DataFrame, labels: DataFrame, max_train_rows: int = fm.MAX_TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted per row of ``docs`` (doc_id, text).

    Learns ``labels.toxic`` of rows that are not held out; nothing but the text
    enters a score. Null and empty texts get the score of no terms; a null
    doc_id is not held out and never learnt from; repeated rows each get their
    score; without any label every score is one half. Other columns are ignored.
    """
    model = fm.train(docs, labels, "toxic", held_out(), extract, terms, max_train_rows)
    return fm.score(docs, model, held_out(), extract, terms)
