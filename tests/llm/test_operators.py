"""Each operator against a plain Python version, on small tables with the awkward cases in them."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from turnwise.llm import fm
from turnwise.llm import near_dedup as near_dedup_module
from turnwise.llm import quality_classifier as classifier_module
from turnwise.llm import toxicity as toxicity_module
from turnwise.llm.bpe import Encoder, tokenizer_path
from turnwise.llm.common import scratch_dir
from turnwise.llm.decontaminate import decontaminate
from turnwise.llm.license_scan import license_scan
from turnwise.llm.near_dedup import near_dedup
from turnwise.llm.packing import best_fit_decreasing, best_fit_packing, packed_ids
from turnwise.llm.quality_classifier import quality_classifier
from turnwise.llm import common
from turnwise.llm import quality_rules as quality_rules_module
from turnwise.llm.quality_rules import quality_rules
from turnwise.llm.token_files import token_files
from turnwise.llm.toxicity import toxicity
from turnwise.llm.url_filter import url_filter
from turnwise.llm.warc import warc_round_trip, write_warc

DOCS = "doc_id bigint, text string, lang string, source string"
SPACE = " \t\n\v\f\r"


def words_of(rng, n):
    return [rng.choice(["ba", "Ce", "dü", "fo", "gi"]) + rng.choice(["ll", "mm", "ñn", "rr"]) + str(rng.randrange(40)) for _ in range(n)]


@pytest.fixture(scope="module")
def documents():
    rng = random.Random(5)
    base = words_of(rng, 120)
    rows = [(0, " ".join(base)), (1, " ".join(base)), (2, " ".join([*base[:60], "X", *base[61:]]).upper()), (3, "\n".join(base[:119]))]
    rows += [(4, None), (5, ""), (6, " \t\n "), (7, "one two"), (8, "ONE  two"), (9, "one two three four five")]
    rows += [(10, " ".join(words_of(rng, 6000)) + " end"), (11, "a b c d e f g h " * 9), (12, "# * $ % & | < > " * 12)]
    rows += [(None, "a <|endoftext|> b"), (61, "<|endoftext|><|endoftext|>x")]
    rows += [(13, "same line here\n" * 30 + " ".join(words_of(rng, 50))), (None, " ".join(base)), (None, "nobody else has this"), (14, "twice"), (14, "twice")]
    other = " ".join(words_of(rng, 90))
    rows += [(62, "first text of two"), (64, "first text of two"), (64, other), (63, other + " tail"), (65, other), (65, "third of them"), (66, "third of them")]
    for k in range(15, 60):
        t = list(base) if k % 3 == 0 else words_of(rng, rng.randrange(1, 80))
        for _ in range(k % 7):
            t[rng.randrange(len(t))] = f"w{rng.randrange(999)}"
        rows.append((k, " ".join(t)))
    return [(i, t, None if k % 9 == 0 else "en" if k % 2 else "de", None if k % 11 == 0 else f"s{k % 2}") for k, (i, t) in enumerate(rows)]


def frame(spark, documents):
    df = spark.createDataFrame(documents, DOCS)
    for name in ("row", "w", "n", "key", "mark", "id", "_lang", "token", "last", "component", "sketch", "score", "_group", "digest"):
        df = df.withColumn(name, F.lit("clash"))
    return df


def split_words(text):
    out, word = [], ""
    for c in text or "":
        if c in SPACE:
            out += [word] if word else []
            word = ""
        else:
            word += c
    return out + ([word] if word else [])


def rule_counts(text):
    w = split_words(text)
    seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    hit = {i + j for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for j in range(8)}
    lines = [x for x in (text or "").split("\n") if split_words(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit)


PUNCTUATION = r"""!"#$%&'()*+,-./:;<=>?@[\]^_`{|}~"""


def rule_metrics(text):
    n, chars, symbols, dup, _ = rule_counts(text)
    b = n.bit_length()
    log = (b - 1) * 256 + (n * 256 >> (b - 1)) - 256 if n else 0
    return {
        "symbol_rate": symbols * 10**6 // chars if chars else 0, "dup_line_rate": dup * 10**6 // n if n else 0,
        "punct_rate": sum(c in PUNCTUATION for c in text or "") * 10**6 // chars if chars else 0, "word_len": chars * 1000 // n if n else 0, "log_words": log,
    }


def judged_by_rules(documents, min_group):
    """A tuple per document (doc_id, text, lang, source): doc_id, counts, base_failed, kept, metrics, bounds."""
    grid = defaultdict(list)
    for _, t, lang, source in documents:
        if rule_counts(t)[0]:
            for g in ((lang, source), (lang,), ()):
                grid[g].append(rule_metrics(t))
    fences = {}
    for g, of in grid.items():
        fences[g] = {}
        for m, (slack, times, lower) in quality_rules_module.FENCES.items():
            # the cell keeps nine binary digits
            x = sorted(v[m] >> max(0, v[m].bit_length() - 9) << max(0, v[m].bit_length() - 9) for v in of)
            q10, q50, q90 = (x[-(-len(x) * k // 10) - 1] for k in (1, 5, 9))
            away = max(slack, times * min(q90 - q50, q50 - q10))
            fences[g][f"{m}_max"] = q50 + away
            if lower:
                fences[g][f"{m}_min"] = q50 - away
    out = []
    for i, t, lang, source in documents:
        c, of = rule_counts(t), rule_metrics(t)
        base = c[0] < 20 or 100 * c[4] > 30 * c[0]
        bounds = fences[next(g for g in ((lang, source), (lang,), ()) if len(grid[g]) >= min_group or g == ())]
        fine = all(of[m] <= bounds[f"{m}_max"] and of[m] >= bounds.get(f"{m}_min", of[m]) for m in of)
        if not grid[(lang, source)]:  # only texts without words: no sketch, no bounds
            fine, bounds = True, dict.fromkeys(bounds)
        out.append((i, *c, base, fine and not base, *of.values(), *(bounds[b] for b in quality_rules_module.BOUNDS)))
    return out


def test_quality_rules(spark, documents):
    rows = quality_rules(frame(spark, documents), min_group=5).collect()
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", *quality_rules_module.METRICS, *quality_rules_module.BOUNDS]
    assert Counter((r.doc_id, *(r[n] for n in names)) for r in rows) == Counter(judged_by_rules(documents, 5))


def test_sketches_merge(spark):
    rng = random.Random(3)
    rows = [("en", f"s{k % 3}", rng.randrange(1, 40), *(rng.randrange(10 ** rng.randrange(1, 7)) for _ in range(5))) for k in range(3000)]
    metrics = quality_rules_module.METRICS
    stats = spark.createDataFrame(rows, "lang string, source string, n_words long, " + ", ".join(f"{m} long" for m in metrics))
    parts = [quality_rules_module.sketches(stats.where(F.col("source") == f"s{k}")) for k in range(3)]
    merged = quality_rules_module.quantiles(parts[0].union(parts[1]).union(parts[2]), ()).collect()
    for r in merged:
        x = sorted(row[3 + metrics.index(r.metric)] for row in rows)
        for q, k in ((r.q10, 1), (r.q50, 5), (r.q90, 9)):
            exact = x[-(-len(x) * k // 10) - 1]
            assert exact - exact / 256 <= q <= exact
    report = quality_rules_module.slack_report(quality_rules_module.thresholds(quality_rules_module.sketches(stats))).collect()
    assert {(r.metric, r.groups) for r in report} == {(m, 3) for m in metrics}


def test_quality_rules_of_a_dirty_source(spark):
    rng = random.Random(9)
    rows = []
    for k in range(400):
        junk = k % 10 < 3  # 30% of the source
        w = words_of(rng, 40)
        rows.append((k, " ".join(x + "#$" * 2 if junk and j % 2 else x for j, x in enumerate(w)), "en", "dirty"))
    got = {r.doc_id: r for r in quality_rules(spark.createDataFrame(rows, DOCS)).collect()}
    assert all(got[k].symbol_rate > 100_000 for k in range(400) if k % 10 < 3)
    assert {k for k, r in got.items() if r.kept} == {k for k in range(400) if k % 10 >= 3}


def test_near_dedup(spark, documents):
    def shingles(text):
        w = [x for x in split_words("".join(c.lower() if c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else c for c in text or ""))]
        return {tuple(w)} - {()} if len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    sets = [(i, shingles(t)) for i, t, _, _ in documents]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(range(len(sets)), 2):
        x, y = sets[a][1], sets[b][1]
        same_id = sets[a][0] == sets[b][0] is not None
        if same_id or x and y and 100 * len(x & y) >= 75 * len(x | y):
            parent[find(b)] = find(a)
    groups = defaultdict(list)
    for k, (i, _) in enumerate(sets):
        groups[find(k)].append(i)
    want = Counter()
    for k, (i, s) in enumerate(sets):
        c = min((x for x in groups[find(k)] if x is not None), default=None)
        want[i, len(s), c, i == c] += 1
    got = Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dedup(frame(spark, documents)).collect())
    assert got == want


@pytest.mark.parametrize("block", [2048, 16, 3])
def test_near_dedup_family_without_a_leader(spark, monkeypatch, block):
    monkeypatch.setattr(near_dedup_module, "BLOCK", block)
    rng = random.Random(3)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for k in range(150):
        t = list(base)
        for _ in range(rng.randrange(1, 9)):
            t[rng.randrange(200)] = f"x{rng.randrange(10**6)}"
        rows.append((k, " ".join(t), "en", "s"))
    sets = [{tuple(t.split()[i : i + 5]) for i in range(196)} for _, t, _, _ in rows]
    parent = list(range(150))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(range(150), 2):
        if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    got = {r.doc_id: r.component_id for r in near_dedup(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {k: find(k) for k in range(150)} and len(set(got.values())) > 1


@pytest.mark.parametrize(("operator", "label", "part", "rest"), [(toxicity, "toxic", 4, 2), (quality_classifier, "quality", 5, 0)])
def test_classifiers(spark, documents, operator, label, part, rest):
    rng = random.Random(1)
    docs, labels = [], []
    for k in range(900):
        w = [rng.choice("abcdefgh") * rng.randrange(1, 5) for _ in range(rng.randrange(20, 120))]
        y = k % 3 == 0
        if y:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), "vex" + rng.choice(["", "ed", "ing", "um", "ik"]))
        docs.append((k, " ".join(w), "en", "s"))
        labels.append((k, int(y)))
    odd = [d for d in documents if d[0] is None] + [(10_000 + k, t, None, None) for k, t in enumerate([None, "", "  ", "word " * 60_000])] + [docs[0], docs[0]]
    df = spark.createDataFrame(docs + odd, DOCS).withColumn("score", F.lit(1)).withColumn("held_out", F.lit(True))
    lab = spark.createDataFrame([*labels, (None, 1), (5, None), (7, labels[7][1]), (99_999, 1)], f"doc_id bigint, {label} int")
    rows = operator(df, lab).collect()
    assert Counter(r.doc_id for r in rows) == Counter(d[0] for d in docs + odd)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % part == rest) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id is not None and r.doc_id < 900]
    assert len(held) > 100 and sum(r.predicted == labels[r.doc_id][1] for r in held) >= 0.97 * len(held)


def test_classifier_without_labels(spark):
    df = spark.createDataFrame([(1, "x", "en", "s")], DOCS)
    assert [r.score for r in toxicity(df, spark.createDataFrame([], "doc_id bigint, toxic int")).collect()] == [0.5]
    assert toxicity(df.limit(0), spark.createDataFrame([(1, 1)], "doc_id bigint, toxic int")).count() == 0


@pytest.mark.parametrize(("module", "label"), [(toxicity_module, "toxic"), (classifier_module, "quality")])
def test_scores_are_the_pairwise_sums(spark, sf_dir, module, label):
    sf_dir = sf_dir.replace("sf0.001", "sf0.01")  # enough labels for a model of some terms
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    strength = {"min_strength": 3.0} if label == "quality" else {}
    m = fm.train(docs, labels, label, module.held_out(), module.extract, module.terms, **strength)
    assert len(m.ids) > 20 and np.abs(m.v).max() > 0.01
    place = {int(t): k for k, t in enumerate(m.ids)}
    got = {r.doc_id: r.score for r in getattr(module, "toxicity" if label == "toxic" else "quality_classifier")(docs, labels).collect()}
    for r in docs.collect():
        words, more = module.extract(r.text or "")
        at = sorted({place[i] for i in map(fm.term_id, [t for w in words for t in module.terms(w)] + list(more)) if i in place})
        z = m.bias + sum(m.w[i] for i in at) + sum(float(m.v[i] @ m.v[j]) for i, j in combinations(at, 2))
        assert abs(got[r.doc_id] - 1 / (1 + np.exp(-np.clip(z, -60, 60)))) < 1e-9


def test_gradient_is_that_of_the_loss():
    rng = np.random.default_rng(1)
    theta, y = rng.normal(0, 0.5, (7, fm.RANK + 1)), np.array([1.0, 0, 1, 0])
    rows = [np.array(x, np.int64) for x in ([0, 2, 3], [1], [], [0, 1, 4, 6])]

    def loss(t, bias):
        z = [bias + t[r, 0].sum() + sum(t[i, 1:] @ t[j, 1:] for i, j in combinations(r.tolist(), 2)) for r in rows]
        decay = sum((fm.L2_W * t[i, 0] ** 2 + fm.L2_V * (t[i, 1:] ** 2).sum()) / 2 for i in {i for r in rows for i in r.tolist()})
        return np.mean([np.log1p(np.exp(-x if k else x)) for x, k in zip(z, y, strict=True)]) + decay

    used, grad, g_bias = fm.gradient(theta, 0.2, np.concatenate(rows), np.array([len(r) for r in rows]), y)
    want = np.zeros_like(theta)
    for i in range(7):
        for j in range(fm.RANK + 1):
            e = np.zeros_like(theta)
            e[i, j] = 1e-5
            want[i, j] = (loss(theta + e, 0.2) - loss(theta - e, 0.2)) / 2e-5
    got = np.zeros_like(theta)
    got[used] = grad
    assert np.abs(got - want).max() < 1e-8 and abs(g_bias - (loss(theta, 0.2 + 1e-5) - loss(theta, 0.2 - 1e-5)) / 2e-5) < 1e-8


def test_toxicity_of_a_pair_of_words(spark):
    rng = random.Random(4)
    docs, labels = [], []
    for k in range(3000):
        w = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(20, 60))]
        a, b = rng.random() < 0.3, rng.random() < 0.3
        w += ["rattle"] * a + ["group"] * b
        rng.shuffle(w)
        docs.append((k, " ".join(w), "en", "s"))
        labels.append((k, int(a and b)))
    rows = toxicity(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id bigint, toxic int")).collect()
    held = [r for r in rows if r.held_out]
    assert sum(r.predicted == labels[r.doc_id][1] for r in held) >= 0.97 * len(held)


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    return lambda text: [*t.encode(text or "", add_special_tokens=False).ids, 0]


def crc(ids):
    return zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))


def test_encoder_is_the_library(plain):
    rng, e = random.Random(2), Encoder()
    parts = [" ", "  ", "\n", "\t", "The", "élan", "1", "22", "!", "'s", "'", "\u00a0", "\u3000", "x", "-", "<|endoftext|>", "\x1c", "\r\n", "日本", "👍", "a,\nb.", "<|endoftext", "|>", "_", "ÉCOLE", "½", "ü.", "(", ")ß", "\n\n", "ɏ", "”", "…", "×", "a-b_c"]
    texts = ["".join(rng.choices(parts, k=rng.randrange(30))) for _ in range(4000)]
    assert e.plain
    for some in (texts[:1000], [None, "", " ", "a b"], [], [texts[7] * 9000, texts[8]], texts[1000:]):
        ids, offsets = e.encode_many(pa.array(some, pa.string()), 0)
        assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:], strict=True)] == [plain(t) for t in some]


def test_token_files(spark, documents, plain):
    got = token_files(frame(spark, documents), scratch_dir(spark, "t")).collect()
    start, want = 0, []
    for i, t, _, _ in sorted(documents, key=lambda d: (d[0] is not None, d[0] or 0, d[1] or "")):
        ids = plain(t)
        want.append((i, start, len(ids), crc(ids)))
        start += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want


def test_packing(spark, documents, plain):
    df = frame(spark, documents)
    rows = best_fit_packing(df).collect()
    want = Counter()
    for i, t, _, _ in documents:
        ids = plain(t)
        first = (len(ids) - 1) % 2048 + 1
        for k, s in enumerate([0, *range(first, len(ids), 2048)]):
            part = ids[s : first if k == 0 else s + 2048]
            want[i, k, s, len(part), crc(part)] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    fill = defaultdict(list)
    for r in rows:
        fill[r.sequence_id].append((r.offset, r.length))
    for parts in fill.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(fill) <= -(-sum(r.length for r in rows) // 2048) + 1
    whole = packed_ids(df).collect()
    assert sum(r.n_tokens for r in whole) == sum(r.length for r in rows) and all(len(r.ids) == 4 * r.n_tokens for r in whole)


def test_best_fit_is_the_tightest_bin():
    rng = random.Random(4)
    for _ in range(30):
        sizes, cap = [rng.randrange(1, 65) for _ in range(rng.randrange(1, 200))], 64
        got, _ = best_fit_decreasing(sizes, cap)
        room, want = [], [0] * len(sizes)
        for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
            fits = [(r, k) for k, r in enumerate(room) if r >= sizes[i]]
            k = min(fits)[1] if fits else len(room)
            if not fits:
                room.append(cap)
            room[k] -= sizes[i]
            want[i] = k
        full = lambda of: sorted(sum(z for z, k in zip(sizes, of, strict=True) if k == j) for j in set(of))
        assert full(got) == full(want) and len(set(got)) == len(room)


def test_warc(spark):
    big, rng = "é" * 600, random.Random(6)
    rows = [(1, "http://a/x", big), (2, "http://b", big), (5, None, big), (5, "http://r", big), (3, "u", None), (4, "u", ""), (6, "line\nbreak", "short"), (7, "s", "short"), (None, "n", big), (None, "n", "only\x00one")]
    rows += [(10 + k, f"http://h/{k}", rng.choice("ab") * 1000) for k in range(40)] + [(100, "w", "x" * 300_000)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("digest", F.lit("clash")).withColumn("payload", F.lit(1))
    last = {}
    for i, _, h in rows:
        b = (h or "").encode()
        if len(b) >= 1000:
            last[b] = max(last.get(b) or -1, -1 if i is None else i)
    want = Counter()
    for i, _, h in rows:
        b = (h or "").encode()
        other = last.get(b, i) if last.get(b, i) != i else None
        want[i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if other is not None else "response", other] += 1
    folder = scratch_dir(spark, "w")
    got = warc_round_trip(df, folder).drop("url").collect()
    assert Counter(map(tuple, got)) == want
    again = scratch_dir(spark, "w")
    write_warc(df, again, roll_bytes=2000)
    write_warc(df, folder + "2", roll_bytes=2000)
    files = [spark.read.parquet(f"{x}/manifest") for x in (again, folder + "2")]
    assert files[0].count() > 4 and sorted(map(tuple, files[0].collect())) == sorted(map(tuple, files[1].collect()))


def test_license_scan(spark):
    rows = [
        ("a/LICENSE", "Released under the MIT License."), ("a/b/x.txt", "nothing"), ("a/b/c/y.txt", None), ("a/b/LICENSE", "no licence text of note here at all really"),
        ("d/COPYING.txt", "x\nThis work is licensed under the GNU General Public License, version 3."), ("d/e/f.txt", "words\nLicensed under the Apache License, Version 2.0.\nmore"),
        ("d/e/g.txt", ""), ("z.txt", "alone"), (None, "Released under the MIT License."), (None, None), ("d/e/g.txt", ""),
    ]
    df = spark.createDataFrame(rows, "path string, text string").withColumn("row", F.lit(1)).withColumn("license", F.lit("clash"))
    got = [(r.path, r.own_license, r.license, r.from_path) for r in license_scan(df).collect()]
    assert Counter(got) == Counter([
        ("a/LICENSE", "MIT", "MIT", None), ("a/b/x.txt", None, "MIT", "a/LICENSE"), ("a/b/c/y.txt", None, "MIT", "a/LICENSE"), ("a/b/LICENSE", None, "MIT", "a/LICENSE"),
        ("d/COPYING.txt", "GPL-3.0", "GPL-3.0", None), ("d/e/f.txt", "Apache-2.0", "Apache-2.0", None), ("d/e/g.txt", None, "GPL-3.0", "d/COPYING.txt"),
        ("d/e/g.txt", None, "GPL-3.0", "d/COPYING.txt"), ("z.txt", None, None, None), (None, "MIT", "MIT", None), (None, None, None, None),
    ])


def own_licenses(spark, lines):
    df = spark.createDataFrame([(f"f{k}.txt", x) for k, x in enumerate(lines)], "path string, text string")
    by = {r.path: r.own_license for r in license_scan(df).collect()}
    return [by[f"f{k}.txt"] for k in range(len(lines))]


def test_license_lines_of_the_documents(spark):
    want = {
        "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0", "All rights reserved.": "all-rights-reserved", "Released under the MIT License.": "MIT",
        "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.": "CC-BY-NC-ND-4.0",
        "Licensed under CC BY-SA 4.0.": "CC-BY-SA-4.0", "Licensed under CC BY 4.0.": "CC-BY-4.0", "SPDX-License-Identifier: CC-BY-NC-SA-4.0": "CC-BY-NC-SA-4.0",
        "This work is licensed under the GNU Affero General Public License, version 3.": "AGPL-3.0",
    }
    assert own_licenses(spark, [x for x in want for _ in range(20)]) == [x for x in want.values() for _ in range(20)]


def test_license_among_other_words(spark):
    pad = "lorem ipsum dolor sit amet " * 200
    want = [
        ("Foo is released under the MIT License.", "MIT"), ("Licensed under the MIT License, see LICENSE.txt", "MIT"),
        ("Copyright (c) 2024 Jane Doe. All rights reserved.", "all-rights-reserved"), ("# Copyright 2021 Acme Inc. Licensed under the Apache License, Version 2.0", "Apache-2.0"),
        (pad + "Licensed under CC BY-NC 4.0. " + pad, "CC-BY-NC-4.0"), (pad + "This work is licensed under the GNU General Public License, version 3. " + pad, "GPL-3.0"),
        ("Foo is released under the Bar License.", None), ("Acme 2 and all that: SPDX-License-Identifier: Foo-1.0 " + pad, None), (pad + "a driving licence " + pad, None),
    ]
    lines = [x for x, _ in want] + ["Released under the MIT License.", "Licensed under the Apache License, Version 2.0.", "All rights reserved."] * 300
    assert own_licenses(spark, lines)[: len(want)] == [x for _, x in want]


def benchmark_words(text):
    out, word = [], ""
    for c in (text or "") + " ":
        c = c.lower() if "A" <= c <= "Z" else c
        if c.isascii() and not ("0" <= c <= "9" or "a" <= c <= "z"):
            out += [word] if word else []
            word = ""
        else:
            word += c
    return out


def contamination(text, items):
    """n_words, n_hit, n_items, items_sha256, contaminated."""
    w, hit, found = benchmark_words(text), set(), set()
    for item, other in items:
        x = benchmark_words(other)
        if not x or item is None:
            continue
        n = min(13, len(x))
        wins = {tuple(x[k : k + n]) for k in range(len(x) - n + 1)}
        for k in range(len(w) - n + 1):
            if tuple(w[k : k + n]) in wins:
                hit |= set(range(k, k + n))
                found.add(str(item))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)


def test_decontaminate(spark, documents):
    rng = random.Random(8)
    items = [(1, " ".join(words_of(rng, 30))), (2, "short item"), (3, None), (4, "..."), (None, "one two"), (5, "one two"), (6, "ONE, two!"), (7, " ".join(words_of(rng, 13)))]
    docs = list(documents)
    docs += [(100, "x " * 40 + items[0][1].upper() + " y" * 40, "en", "s"), (101, items[7][1] + " " + items[7][1], "en", "s"), (102, " ".join(items[0][1].split()[:12]), "en", "s"), (103, "a short item here " + "pad " * 60, "en", "s")]
    want = Counter((i, *contamination(t, items)) for i, t, _, _ in docs)
    b = spark.createDataFrame(items, "item_id bigint, text string").withColumn("win", F.lit("clash"))
    got = decontaminate(frame(spark, docs), b).drop("spans").collect()
    assert Counter(map(tuple, got)) == want
    empty = decontaminate(frame(spark, docs), b.limit(0)).collect()
    assert len(empty) == len(docs) and not any(r.contaminated for r in empty)


def test_url_filter(spark, monkeypatch):
    rules = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]
    urls = [None, "", "nothing", "http://", "HTTP://WWW.Example.COM/en/7?x", "https://a.example.com/en/81", "http://example.net/de/8#f", "http://xexample.net/de/8", "ftp://é.org/es/", "http://com/en/"]
    urls += ["http://a.b.c.com/EN/1", "http://x.com?/en/", "http://x.com#/en/", "a://b://c.com/en/", "http://example.com/en/7/" + "y" * 5000, "http://.com/en/", "http://x.com/en/", "http://x.com/en/", "http://a\nb.com/en/q\nr?z"]
    want = Counter()
    for i, u in enumerate(urls):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        end = min([rest.find(c) for c in "/?#" if c in rest] + [len(rest)])
        host, path = rest[:end], rest[end:]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        path = path[: min([path.find(c) for c in "?#" if c in path] + [len(path)])]
        fit = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        want[i, host, path, max(fit)[1] if fit else None, max(fit)[2] if fit else "allow"] += 1
    df = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string").withColumn("host", F.lit("clash")).withColumn("row", F.lit(1))
    assert Counter(map(tuple, url_filter(df).collect())) == want
    # rows that arrive by a shuffle, or from a join, have no fixed order
    many = df.select("page_id", "url").crossJoin(spark.range(300).select(F.col("id").alias("k"))).select((F.col("page_id") + 100 * F.col("k")).alias("page_id"), "url")
    told = {i: rest for i, *rest in want}
    for other in (many.repartition(16), many.groupBy("page_id").agg(F.max("url").alias("url")), many.join(spark.range(5).select((F.col("id") * 7).alias("page_id")), "page_id", "left_anti")):
        rows = url_filter(other).collect()
        assert len(rows) == other.count() and all([r.host, r.path, r.rule, r.verdict] == told[r.page_id % 100] for r in rows)
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    assert Counter(map(tuple, url_filter(df).collect())) == want


def test_near_dedup_without_broadcast(spark, documents, monkeypatch):
    want = Counter(map(tuple, near_dedup(frame(spark, documents)).collect()))
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    assert Counter(map(tuple, near_dedup(frame(spark, documents)).collect())) == want


def test_rejected_documents_go_without_broadcast(spark, documents, monkeypatch):
    docs, gone = frame(spark, documents), spark.createDataFrame([(k,) for k in (1, 14, None, 999)], "doc_id bigint")
    want = Counter(d[0] for d in documents if d[0] not in (1, 14))
    for rows in (common.BROADCAST_ROWS, 0):
        monkeypatch.setattr(common, "BROADCAST_ROWS", rows)
        assert Counter(r.doc_id for r in common.without(docs, gone).collect()) == want


def test_no_session_setting_changes(spark, documents):
    before = dict(spark.conf.getAll)
    near_dedup(frame(spark, documents)).count()
    token_files(frame(spark, documents), scratch_dir(spark, "s")).count()
    assert dict(spark.conf.getAll) == before


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://host:7077"
        getConf = staticmethod(dict)
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext, conf = Context, {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Session)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], DOCS)
    bench, pages = spark.createDataFrame([], "item_id bigint, text string"), spark.createDataFrame([], "page_id bigint, url string, html string")
    assert toxicity(docs, spark.createDataFrame([], "doc_id bigint, toxic int")).count() == quality_classifier(docs, spark.createDataFrame([(1, 1)], "doc_id bigint, quality int")).count() == 0
    results = [quality_rules(docs), near_dedup(docs), token_files(docs, scratch_dir(spark, "e")), best_fit_packing(docs), decontaminate(docs, bench), url_filter(pages), warc_round_trip(pages, scratch_dir(spark, "e")), license_scan(spark.createDataFrame([], "path string, text string"))]
    assert [r.count() for r in results] == [0] * len(results)
