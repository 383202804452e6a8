"""Factorization machines over hashed terms: bounded training on labelled rows, linear-time scoring of all rows.

score(x) = sigmoid(b + sum w_i x_i + 1/2 (|sum v_i x_i|^2 - sum |v_i x_i|^2)), where x has a one for each
distinct hashed term of a text. The model keeps at most ``max_terms`` terms, so its size does not follow the corpus.

A term is kept if it goes with the label by itself, or in a pair with another
frequent term: a pair can tell what neither of its terms does, and only kept
terms can interact. Terms are counted by a groupBy over the sample; the fit, in
one task, gets only the terms that may be kept.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnwise.llm.common import cut, sliced, small_batches

#: Most labelled rows a fit uses: those whose doc_id has the smallest hashes.
MAX_TRAIN_ROWS = 12_000
#: Most terms a model keeps, by strength of association with the label.
MAX_TERMS = 1 << 15
MIN_DF = 3
#: Least strength, in standard deviations of a term's count of positive rows, that a kept term has.
MIN_STRENGTH = 5.0
#: Most frequent terms whose pairs are looked at, and the least strength of a pair, more than either term's own by PAIR_LEAD.
PAIR_TERMS = 1024
PAIR_STRENGTH = 7.0
PAIR_LEAD = 2.0
L2_W, L2_V = 1e-5, 1e-3
RANK = 8
EPOCHS = 12
BATCH = 256
#: Words remembered by a scoring worker before it starts afresh.
CACHE_WORDS = 150_000
PREDICT_AT = 0.3

_DOUBLES = pa.list_(pa.float64())
_MODEL = pa.schema([("ids", pa.list_(pa.int64())), ("w", _DOUBLES), ("v", _DOUBLES), ("bias", pa.float64())])

#: A term extractor: text -> (words to look up one by one, further terms of the whole text).
Extract = Callable[[str], tuple[set, list]]
#: word -> terms
Terms = Callable[[str], list]


def term_id(term: str) -> int:
    return zlib.crc32(term.encode("utf-8", "surrogatepass"))


@dataclass
class Model:
    ids: np.ndarray  # sorted uint32 hashes of the kept terms
    w: np.ndarray
    v: np.ndarray
    bias: float

    def positions(self) -> dict[int, int]:
        return dict(zip(self.ids.tolist(), range(len(self.ids)), strict=True))

    def score(self, at: list[int]) -> float:
        s = self.bias
        if at:
            v = self.v[at]
            total = v.sum(axis=0)
            s += float(self.w[at].sum()) + 0.5 * (float(total @ total) - float(np.einsum("ij,ij->", v, v)))
        return float(1.0 / (1.0 + np.exp(-min(60.0, max(-60.0, s)))))


def constant_model(rate: float) -> Model:
    """What a fit gives without rows, or with one label only."""
    rate = min(1 - 1e-3, max(1e-3, rate))
    return Model(np.zeros(0, np.uint32), np.zeros(0), np.zeros((0, RANK)), float(np.log(rate / (1 - rate))))


def telling_pairs(owner: np.ndarray, term: np.ndarray, ids: np.ndarray, df: np.ndarray, strength: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Terms, among the PAIR_TERMS most frequent, of pairs that go with the label by PAIR_LEAD more than either term does."""
    frequent = np.lexsort((ids, -df))[:PAIR_TERMS]
    frequent = frequent[df[frequent] >= MIN_DF]
    place = np.full(len(ids), -1, np.int64)
    place[frequent] = np.arange(len(frequent))
    at = place[term]
    x = np.zeros((len(y), len(frequent)), np.float32)
    x[owner[at >= 0], at[at >= 0]] = 1
    both, p = (x.T @ x).astype(np.float64), y.mean()
    with_1 = (x[y > 0].T @ x[y > 0]).astype(np.float64)
    z = np.abs(with_1 - both * p) / np.sqrt(np.maximum(both, 1) * p * (1 - p))
    alone = np.maximum.outer(strength[frequent], strength[frequent])
    return frequent[((z >= PAIR_STRENGTH) & (z >= alone + PAIR_LEAD) & (both >= MIN_DF)).any(axis=1)]


def gradient(theta: np.ndarray, bias: float, at: np.ndarray, size: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Of the mean log loss of a batch plus the decay of its terms: the terms used, their gradients (w, then v), that of the bias.

    ``at`` holds the terms of the rows one row after the other, ``size`` how many each has.
    """
    row = np.repeat(np.arange(len(y)), size)
    x = theta[at]
    sums, squares = np.zeros((len(y), RANK + 1)), np.zeros(len(y))
    full = np.flatnonzero(size)
    if len(at):
        cuts = np.concatenate([[0], np.cumsum(size[full])[:-1]])
        sums[full] = np.add.reduceat(x, cuts, axis=0)
        squares[full] = np.add.reduceat(np.einsum("ij,ij->i", x[:, 1:], x[:, 1:]), cuts)
    z = bias + sums[:, 0] + 0.5 * (np.einsum("ij,ij->i", sums[:, 1:], sums[:, 1:]) - squares)
    g = (1 / (1 + np.exp(-np.clip(z, -60, 60))) - y) / len(y)
    gx = np.empty_like(x)
    gx[:, 0] = g[row]
    gx[:, 1:] = g[row][:, None] * (sums[row, 1:] - x[:, 1:])
    used, back = np.unique(at, return_inverse=True)
    grad = np.stack([np.bincount(back, weights=gx[:, j], minlength=len(used)) for j in range(RANK + 1)], axis=1)
    return used, grad + theta[used] * np.concatenate([[L2_W], np.full(RANK, L2_V)]), float(g.sum())


def fit(
    rows: list[np.ndarray], labels: np.ndarray, seed: int = 7, max_terms: int = MAX_TERMS, min_strength: float = MIN_STRENGTH
) -> Model:
    """Adam on the log loss over mini-batches; deterministic for given rows in a given order."""
    y = np.asarray(labels, dtype=np.float64)
    n = len(rows)
    if n == 0 or y.min() == y.max():
        return constant_model(float(y.mean()) if n else 0.5)
    lengths = np.fromiter((len(r) for r in rows), np.int64, n)
    flat = np.concatenate(rows) if lengths.sum() else np.zeros(0, np.uint32)
    owner = np.repeat(np.arange(n), lengths)
    ids, inverse, df = np.unique(flat, return_inverse=True, return_counts=True)
    with_1 = np.bincount(inverse, weights=y[owner], minlength=len(ids))
    p = y.mean()
    strength = np.abs(with_1 - df * p) / np.sqrt(df * p * (1 - p))
    paired = telling_pairs(owner, inverse, ids, df, strength, y)
    strength[(df < MIN_DF) | (strength < min_strength)] = 0
    order = np.lexsort((ids, -strength))[:max_terms]
    keep = np.union1d(order[strength[order] > 0], paired)
    if not len(keep):
        return constant_model(float(p))
    place = np.full(len(ids), -1, np.int64)
    place[keep] = np.arange(len(keep))
    col = place[inverse]
    col, owner = col[col >= 0], owner[col >= 0]
    starts = np.searchsorted(owner, np.arange(n + 1))
    rng = np.random.default_rng(seed)
    d = len(keep)
    theta = np.concatenate([np.zeros((d, 1)), rng.normal(0, 0.01, (d, RANK))], axis=1)
    bias = float(np.log(p / (1 - p)))
    m, s = np.zeros_like(theta), np.zeros_like(theta)
    mb = sb = 0.0
    t = 0
    for epoch in range(EPOCHS):
        rate = 0.03 / (1 + 0.15 * epoch)
        shuffled = rng.permutation(n)
        for first in range(0, n, BATCH):
            batch = shuffled[first : first + BATCH]
            size = starts[batch + 1] - starts[batch]
            at = np.concatenate([col[starts[b] : starts[b + 1]] for b in batch])
            used, grad, gb = gradient(theta, bias, at, size, y[batch])
            t += 1
            m[used] = 0.9 * m[used] + 0.1 * grad
            s[used] = 0.999 * s[used] + 0.001 * grad * grad
            theta[used] -= rate * (m[used] / (1 - 0.9**t)) / (np.sqrt(s[used] / (1 - 0.999**t)) + 1e-8)
            mb, sb = 0.9 * mb + 0.1 * gb, 0.999 * sb + 0.001 * gb * gb
            bias -= rate * (mb / (1 - 0.9**t)) / (np.sqrt(sb / (1 - 0.999**t)) + 1e-8)
    return Model(ids[keep].astype(np.uint32), theta[:, 0].copy(), theta[:, 1:].copy(), bias)


def crc_of_id(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary"))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, held_out: Column, limit: int) -> DataFrame:
    """At most ``limit`` rows (doc_id, text, y) that are labelled and not held out: those whose doc_id has the smallest hash.

    A doc_id with several labels takes the largest, one with several texts the smallest text.
    """
    y = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out)
    y = y.groupBy("doc_id").agg((F.max(label) > 0).cast("int").alias("y"))
    chosen = docs.select("doc_id").join(y, "doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    text = F.coalesce("text", F.lit(""))
    return docs.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min(text).alias("text"))  # at most `limit` rows


def hashed_terms(extract: Extract, terms: Terms) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches):
        for b in sliced(batches):
            out = []
            for text in b.column("text").to_pylist():
                words, more = extract(text)
                out.append(np.array(sorted({term_id(t) for w in words for t in terms(w)} | {term_id(t) for t in more}), np.uint32).view(np.int32))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("y"), pa.array(out, pa.list_(pa.int32()))], ["doc_id", "y", "terms"]
            )

    return run


def candidate_terms(hashed: DataFrame, max_terms: int, min_strength: float) -> np.ndarray:
    """The terms that a fit may keep, sorted: the strongest ``max_terms`` and the PAIR_TERMS most frequent of ``hashed`` (y, terms)."""
    p = F.lit(hashed.agg(F.avg("y")).first()[0]).cast("double")
    counts = hashed.select("y", F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("y").alias("with_1"))
    spread = F.sqrt(F.nullif(F.col("df") * p * (1 - p), F.lit(0.0)))
    counts = cut(counts.where(F.col("df") >= MIN_DF).select("term", "df", (F.abs(F.col("with_1") - F.col("df") * p) / spread).alias("strength")))
    strong = counts.where(F.col("strength") > min_strength - 1e-6).orderBy(F.desc("strength"), "term").limit(max_terms)
    frequent = counts.orderBy(F.desc("df"), F.expr("term & 4294967295L")).limit(PAIR_TERMS)
    found = strong.select("term").union(frequent.select("term")).distinct().collect()  # at most max_terms + PAIR_TERMS numbers
    return np.sort(np.array([r[0] for r in found], np.int32))


def train(
    docs: DataFrame, labels: DataFrame, label: str, held_out: Column, extract: Extract, terms: Terms,
    max_train_rows: int = MAX_TRAIN_ROWS, max_terms: int = MAX_TERMS, min_strength: float = MIN_STRENGTH,
) -> Model:
    """Fit on the bounded sample, in one task; term numbers and the model, both bounded by ``max_terms``, reach the driver."""

    def only_candidates(batches):
        for b in batches:
            lists = b.column("terms")
            flat, at = lists.flatten().to_numpy(), np.asarray(lists.offsets).astype(np.int64) - lists.offsets[0].as_py()
            keep = np.isin(flat, candidates)
            ends = np.concatenate([[0], np.cumsum(keep)])[at].astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), pa.ListArray.from_arrays(ends, pa.array(flat[keep], pa.int32()))], ["doc_id", "y", "terms"])

    def run(table):
        order = np.argsort(table.column("doc_id").to_numpy(), kind="stable")
        rows = [np.array(table.column("terms")[int(i)].as_py(), np.int32).view(np.uint32) for i in order]
        m = fit(rows, table.column("y").to_numpy()[order], max_terms=max_terms, min_strength=min_strength)
        return pa.table({"ids": [m.ids.astype(np.int64)], "w": [m.w], "v": [m.v.reshape(-1)], "bias": [m.bias]}, schema=_MODEL)

    sample = labelled_sample(docs.select("doc_id", "text"), labels.select("doc_id", label), label, held_out, max_train_rows)
    kind = "doc_id bigint, y int, terms array<int>"
    with small_batches(docs.sparkSession):
        hashed = cut(sample.mapInArrow(hashed_terms(extract, terms), kind))
    candidates = candidate_terms(hashed, max_terms, min_strength)
    rows = hashed.mapInArrow(only_candidates, kind).withColumn("_one", F.lit(1))
    found = rows.groupBy("_one").applyInArrow(run, "ids array<bigint>, w array<double>, v array<double>, bias double").collect()
    if not found:
        return constant_model(0.5)
    ids, w, v, bias = found[0]
    return Model(np.array(ids, np.uint32), np.array(w, np.float64), np.array(v, np.float64).reshape(-1, RANK), bias)


def score(docs: DataFrame, model: Model, held_out: Column, extract: Extract, terms: Terms, predict_at: float = PREDICT_AT) -> DataFrame:
    """doc_id, held_out, score, predicted, per row of docs."""

    def run(batches):
        place, cache = model.positions(), {}
        for b in sliced(batches):
            out = []
            for text in b.column("text").to_pylist():
                words, more = extract(text or "")
                at = {place[i] for i in map(term_id, more) if i in place}
                for w in words:
                    got = cache.get(w)
                    if got is None:
                        if len(cache) >= CACHE_WORDS:
                            cache.clear()
                        got = cache[w] = tuple(place[i] for i in map(term_id, terms(w)) if i in place)
                    if got:
                        at.update(got)
                out.append(model.score(sorted(at)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(out, pa.float64())], ["doc_id", "held_out", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "text")
    with small_batches(docs.sparkSession):
        scored = cut(rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double"))  # three narrow columns
    return scored.withColumn("predicted", (F.col("score") >= predict_at).cast("int"))
