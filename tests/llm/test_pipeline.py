"""The pipeline against its stages in plain Python (the classifier's fit apart, whose scores are summed anew), and the shape of what stages return."""

import math
import zlib
from collections import Counter
from itertools import combinations

import corpus_pipeline
from pyspark.sql import functions as F
from test_operators import contamination, documents, frame, judged_by_rules, split_words  # noqa: F401

from turnwise.llm import fm
from turnwise.llm.quality_classifier import extract, held_out, terms


def test_run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = {r.doc_id: r.text for r in docs.collect()}
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in docs.collect()]
    left = {r[0] for r in judged_by_rules(rows, 100) if r[7]}
    assert left and len(left) < len(text)
    some = docs.where(F.col("doc_id").isin(sorted(left)))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    m = fm.train(some, labels, "quality", held_out(), extract, terms, min_strength=3.0)
    place = {int(t): k for k, t in enumerate(m.ids)}

    def good(t):
        """The pairwise sum, term by term."""
        words, more = extract(t or "")
        at = sorted({place[i] for i in map(fm.term_id, [x for w in words for x in terms(w)] + list(more)) if i in place})
        z = m.bias + sum(m.w[i] for i in at) + sum(float(m.v[i] @ m.v[j]) for i, j in combinations(at, 2))
        return 1 / (1 + math.exp(-z)) >= 0.3

    left = {i for i in left if good(text[i])}

    def shingles(t):
        w = split_words("".join(c.lower() if "A" <= c <= "Z" else c for c in t))
        return {tuple(w)} - {()} if len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    sets = {i: shingles(text[i]) for i in sorted(left)}
    root = {i: i for i in sets}
    changed = True
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            m = min(root[a], root[b])
            changed |= root[a] != m or root[b] != m
            root[a] = root[b] = m
    left = {i for i in sets if root[i] == i}
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    items = [(r.item_id, r.text) for r in bench.collect()]
    clean = {i for i in left if not contamination(text[i], items)[-1]}
    assert clean < left
    left = clean
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r.doc_id for r in rows} == left
    fill = Counter()
    for r in rows:
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= 2048 and len(fill) <= -(-sum(fill.values()) // 2048) + 1


def test_stages_keep_the_columns(spark, documents, sf_dir):  # noqa: F811
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "quality_classifier", "near_dedup", "decontamination", "packing"]
    docs = frame(spark, documents).withColumn("n_chars", F.length("text"))
    ids = Counter(d[0] for d in documents)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert sorted(out.columns) == sorted(docs.columns), name
        got = Counter(r.doc_id for r in out.collect())
        assert not got - ids and got[None] == ids[None]
        assert stage(spark, docs.limit(0), sf_dir).count() == 0
    placed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert Counter(r.doc_id for r in placed.where("piece = 0").collect()) == ids
    assert zlib.crc32(b"\0\0\0\0") in {r.ids_crc32 for r in placed.collect()}
