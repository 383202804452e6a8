"""Golden cases, edge inputs and properties of the operators."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnwise.functions import statistics as ST
from turnwise.functions import text as T
from turnwise.operators import calibration as C
from turnwise.operators import distribution as D
from turnwise.operators import relational as R
from turnwise.operators import sampling as O
from turnwise.operators import scoring as V
from turnwise.operators import similarity as M
from turnwise.sources import files as S
from turnwise.sources import yaml_text as Y
from turnwise.streaming import incremental as U


def vote(spark, lists):
    df = spark.createDataFrame([(1, v, f) for v, f in enumerate(lists)], "k int, voter int, detected_flows array<string>")
    r = V.set_vote(df, ["k"]).first()
    return r.answer, r.confidence


@pytest.mark.parametrize(("votes", "want"), [
    ([["A"], ["A"], ["B"]], ("A", 0.6667)), ([["A", "B"], ["B", "A"], ["C"]], ("A|B", 0.6667)), ([["A"], ["B"], ["C"]], ("A", 0.3333)),
    ([["A"], [], []], ("A", 1.0)), ([[], [], []], ("", 0.0)), ([["C"], ["B"], ["A"]], ("C", 0.3333)),
])
def test_majority_vote(spark, votes, want):
    assert vote(spark, votes) == want


@pytest.mark.parametrize(("votes", "recognised", "picked"), [
    ([["expand", "rework"], ["expand", "polish"], ["expand"]], True, "expand"), ([["expand"]] * 3, False, "expand"), ([["polish"], ["tone"], ["rework"]], True, "polish"),
])
def test_ambiguous_ensemble(spark, votes, recognised, picked):
    df = spark.createDataFrame([(1, v, f, ["expand", "rework"]) for v, f in enumerate(votes)], "k int, voter int, detected_flows array<string>, candidate_flows array<string>")
    r = V.ensemble_ambiguous(df, ["k"]).first()
    assert (r.recognised, r.picked, r.correct) == (recognised, picked, recognised and picked in ("expand", "rework"))


@pytest.mark.parametrize(("predicted", "gold", "candidates", "want"), [
    ([], [], [], (True, 1.0, 1.0)), (["a"], [], [], (False, 0.0, 0.0)), ([], ["a"], [], (False, 0.0, 0.0)), (["handle_ambiguity", "z"], ["a"], ["f", "g"], (True, 1.0, 1.0)),
    (["a", "x"], ["a"], [], (True, 0.5, 1.0)), (["a", "x", "y"], ["a"], [], (False, 0.3333, 1.0)), (["read_post"], ["a"], [], (False, 1.0, 0.0)),
    (["a"], ["a", "b"], [], (True, 1.0, 0.5)), (["a"], ["a", "b", "c"], [], (False, 1.0, 0.3333)),
])
def test_tool_score(spark, predicted, gold, candidates, want):
    df = spark.createDataFrame([(predicted, gold, candidates)], "p array<string>, g array<string>, c array<string>")
    assert tuple(df.select(V.tool_score(F.col("p"), F.col("g"), F.col("c"), ["read_post", "read_outline"]).alias("s")).select("s.*").first()) == want


def test_expected_pick(spark):
    df = spark.createDataFrame([(["expand"],), (["expand", "rework"],), (["expand", "polish"],)], "d array<string>")
    got = [r[0] for r in df.select(V.ambiguous_expected(F.col("d"), F.array(F.lit("expand"), F.lit("rework")))).collect()]
    assert got == [0.0, 1.0, 0.5]


def test_calibration_edges(spark):
    df = spark.createDataFrame([(i / 10,) for i in range(11)], "c double")
    assert [r[0] for r in df.select(C.bin_of(F.col("c"))).collect()] == [0, 1, 2, 2, 4, 5, 5, 6, 8, 9, 9]
    none = spark.createDataFrame([], "confidence double, correct boolean")
    assert C.errors(none, []).first().ece is None and C.pointwise(none, []).first().brier == 0.0
    one = spark.createDataFrame([(0.64, True), (0.64, False)], "confidence double, correct boolean")
    r = C.pointwise(one, []).first()
    assert (r.overconfidence, r.underconfidence) == (1.0, 0.0)
    assert C.spearman(one, "confidence", "correct").first().spearman == 0.0


def test_kappa(spark):
    votes = lambda rows: spark.createDataFrame(rows, "item int, category string")
    assert C.fleiss_kappa(votes([(1, "a"), (1, "a"), (2, "b"), (2, "b")]), "item", "category").first().kappa == 1.0
    assert C.fleiss_kappa(votes([(1, "a"), (2, "b")]), "item", "category").first().kappa == 0.0
    assert C.fleiss_kappa(votes([(1, "a"), (1, "a")]), "item", "category").first().kappa == 1.0


def test_divergence(spark):
    rows = lambda e, s: spark.createDataFrame([("eval", x) for x in e] + [("synth", x) for x in s], "source string, v string")
    jsd = lambda e, s: D.js_distance(D.aligned(rows(e, s), "v")).first().jsd
    assert jsd("aab", "aab") == 0.0 and jsd("a", "b") == 0.832555 and jsd("ab", "") == 1.0 and jsd("aab", "abb") == jsd("abb", "aab")
    assert D.ks_statistic(rows("aaa", "bbb"), "v").first().ks == 1.0 and D.ks_statistic(rows("ab", "ab"), "v").first().ks == 0.0


def test_text(spark):
    df = spark.createDataFrame([("  Hello,  (World)! -- 'x'",), ("",), (None,)], "t string")
    got = df.select(T.tokens(F.coalesce("t", F.lit(""))).alias("w"), T.word_count(F.col("t")).alias("n")).collect()
    assert [(r.w, r.n) for r in got] == [(["hello", "world", "x"], 4), ([], 0), ([], 0)]
    assert spark.range(1).select(T.decomposed(F.lit("{03A}"), {"0": "chat", "3": "compose", "A": "post"})).first()[0] == "chat(0) + compose(3) + post(A)"
    assert spark.range(1).select(T.jaccard(F.array().cast("array<string>"), F.array(F.lit("a")))).first()[0] == 0.0


def test_greedy_filter_is_the_sequential_pass(spark):
    rng = random.Random(1)
    for _ in range(3):
        pairs = {tuple(sorted(rng.sample(range(25), 2))) for _ in range(30)}
        kept = []
        for i in range(25):
            if not any((k, i) in pairs for k in kept):
                kept.append(i)
        got = M.greedy_survivors(spark.range(25), spark.createDataFrame(sorted(pairs), "a bigint, b bigint"))
        assert sorted(r.id for r in got.collect()) == kept


def test_jaccard_links(spark):
    rng = random.Random(2)
    sets = {i: frozenset(rng.sample(range(30), rng.randrange(1, 12))) for i in range(60)}
    sets |= {100 + i: s for i, s in list(sets.items())[:5]}
    df = spark.createDataFrame([(i, [str(t) for t in s]) for i, s in sets.items()], "id bigint, tokens array<string>")
    first = {}
    for i in sorted(sets):
        first.setdefault(sets[i], i)
    for threshold in (0.5, 0.6):
        members, links = M.jaccard_links(df, threshold)
        assert {(r["id"], r["class"]) for r in members.collect()} == {(i, first[s]) for i, s in sets.items()}
        reps = {first[s]: s for s in first}
        want = {(a, b) for a in reps for b in reps if a < b and len(reps[a] & reps[b]) > threshold * len(reps[a] | reps[b])}
        assert {(r.a, r.b) for r in links.collect()} == want


def test_survivor_chains(spark):
    links = [(1, 2), (2, 3), (4, 3), (10, 11), (11, 10), (12, 10), (20, 21), (21, 22), (22, 20), (23, 21), (24, 23)]
    got = {r.id: r.root for r in M.survivors(spark.createDataFrame(links, "removed bigint, kept_by bigint")).collect()}
    assert got == {1: 3, 2: 3, 4: 3, 10: 10, 11: 11, 12: 10, 20: 20, 21: 21, 22: 22, 23: 21, 24: 21}


def test_group_packing(spark):
    rng = random.Random(3)
    sizes = [rng.randrange(1, 12) for _ in range(40)]
    batch = used = 0
    want = []
    for i, s in enumerate(sizes):
        if used and used + s > 16:
            batch, used = batch + 1, 0
        used += s
        want.append((i, batch))
    df = spark.createDataFrame([("l", i, s) for i, s in enumerate(sizes)], "lane string, ord bigint, size bigint")
    assert sorted((r.ord, r.batch) for r in O.pack_groups(df, 16).collect()) == want


def test_strict_reader_fails(spark):
    path = S.scratch(spark, "strict")
    spark.createDataFrame([('{"a": 1}',), ('{"a": ',)], "value string").write.text(path)
    with pytest.raises(Exception, match="MALFORMED|malformed|FAILFAST"):
        S.read_lines(spark, path, "a int", strict=True).collect()
    assert S.good(S.read_lines(spark, path, "a int")).count() == 1


def test_last_wins_and_align(spark):
    rows = spark.createDataFrame([(1, 1, "old"), (1, 2, "new"), (2, 1, "only")], "k int, o int, v string")
    assert sorted((r.k, r.v) for r in R.last_wins(rows, ["k"], "o").collect()) == [(1, "new"), (2, "only")]
    gold = spark.createDataFrame([(1, 1, "f")], "convo_id bigint, turn_num int, flow string")
    preds = spark.createDataFrame([], "voter int, convo_id bigint, turn_num int, detected_flows array<string>")
    out = R.align(gold, preds, spark.createDataFrame([(0,), (1,)], "voter int")).collect()
    assert [r.detected_flows for r in out] == [[], []]
    assert R.accuracy_by(spark.createDataFrame([], "correct boolean")).first().accuracy == 0.0


def test_survivors_of_long_chains_and_cycles(spark):
    rng = random.Random(2)
    hop = {}
    for size, base in ((1, 0), (2, 1000), (64, 2000), (65, 3000), (96, 4000), (130, 5000)):
        hop |= {base + k: base + (k + 1) % size for k in range(size)}  # a cycle of each size
        hop |= {base + 500 + k: base + 501 + k if k < 90 else base + size // 2 for k in range(91)}  # a chain into it
    hop |= {9000 + k: 9001 + k for k in range(200)}  # and one that ends
    links = list(hop.items())
    rng.shuffle(links)

    def end(x):
        seen = set()
        while x in hop and x not in seen:
            seen.add(x)
            x = hop[x]
        return x

    got = {r.id: r.root for r in M.survivors(spark.createDataFrame(links, "removed long, kept_by long")).collect()}
    assert got == {x: end(x) for x in hop}


def test_judged_clusters(spark):
    ids = list("abcdefg")
    replies = [
        (1, 1, '```json\n{"clusters": [{"keep": "a", "remove": ["b", "zz", "a"]}, {"keep": "zz", "remove": ["c"]}]}\n```', ids),
        (1, 2, 'Sure: {"clusters": [{"keep": "d", "remove": ["e"]}, {"keep": "f", "remove": []}]} done', ids),
        (1, 3, "no json", ids), (1, 4, None, ids), (1, 5, '{"clusters": "x"}', ids), (2, 1, '{"clusters": [{"keep": "c", "remove": ["a"]}, {"keep": "g", "remove": ["e"]}]}', ids),
    ]
    clusters = M.parsed_clusters(spark.createDataFrame(replies, "phase int, n int, reply string, ids array<string>"))
    assert sorted((r.phase, r.keep, r.removes) for r in clusters.collect()) == [(1, "a", ["b"]), (1, "d", ["e"]), (2, "c", ["a"]), (2, "g", ["e"])]
    assert {r.id for r in M.merged_removals(clusters).collect()} == {"a", "b", "e"}


def test_numbers_past_three_digits(spark):
    df = spark.range(0, 4500, 3).select("id", F.lit("p").alias("prefix"))
    got = {r.id: r.new_id for r in R.renumber(df, "id", F.col("prefix"), F.floor(F.col("id") / 100)).collect()}
    assert got == {3 * k: f"p_{k + 1:03d}" for k in range(1500)}


def test_page_data_with_any_characters(spark, tmp_path):
    rows = [("a;b", 1), ("cost $5 \\1", 2), ("</script>", 3), ('quote " and\nline', 4), ("const DATA = [];", 5)]
    S.inject(spark.createDataFrame(rows, "name string, n int"), "<script>const DATA = null; draw(DATA);</script>").write.text(str(tmp_path / "p"))
    page = "\n".join(r.value for r in spark.read.text(str(tmp_path / "p")).collect())
    assert "draw(DATA);</script>" in page and page.count("</script>") == 1
    assert sorted((r.name, r.n) for r in S.injected(spark, str(tmp_path / "p"), "name string, n int").collect()) == sorted(rows)
    with pytest.raises(ValueError, match="more than"):
        S.inject(spark.range(S.PAGE_ROWS + 1), "const DATA = 1;")


def test_a_failed_rename_keeps_the_rows():
    class Files:
        def __init__(self, refuse):
            self.at, self.refuse, self.n = {"old": "rows", "new": "fewer"}, refuse, 0

        def exists(self, p):
            return p in self.at

        def rename(self, a, b):
            self.n += 1
            if self.n == self.refuse:
                return False
            self.at[b] = self.at.pop(a)
            return True

        def delete(self, p, _):
            del self.at[p]

    for refuse in (1, 2):
        fs = Files(refuse)
        with pytest.raises(OSError, match="renamed"):
            S.replace_folder(fs, "old", "new", "aside")
        assert fs.at == {"old": "rows", "new": "fewer"}
    fs = Files(0)
    S.replace_folder(fs, "old", "new", "aside")
    assert fs.at == {"old": "fewer"}


def test_yaml_leaves():
    text = "a:\n  b: [x, 'y, z', {k: 1}]\n  c:\nd:\n  - e: 1\n    f: \"#2\" # two\n  -  g\nh: {}\ni: http://x/y\n"
    want = [("a/b/0", "x"), ("a/b/1", "y, z"), ("a/b/2/k", "1"), ("a/c", None), ("d/0/e", "1"), ("d/0/f", "#2"), ("d/1", "g"), ("i", "http://x/y")]
    assert [("/".join(p), v) for p, v in Y.leaves(text)] == want and list(Y.leaves("")) == []


def test_pacing(spark):
    rng = random.Random(6)
    rows = [(k, f"l{k % 3}", rng.randrange(5000)) for k in range(400)]
    got = {r.id: r.start for r in U.paced(spark.createDataFrame(rows, "id long, lane string, at long"), "lane", "at", "id", 17, 300).collect()}
    free, want = {}, {}
    for k, lane, at in sorted(rows, key=lambda r: (r[2], r[0])):
        want[k] = max(at, free.get(lane, at))
        free[lane] = want[k] + 17
    assert got == want


def test_generation_replaces_named_rows(spark):
    samples = spark.createDataFrame([("a", k, f"a{k}") for k in range(4)], "category string, idx int, id string")
    old = spark.createDataFrame([("a0", "a", "old"), ("a1", "a", "old")], "id string, category string, text string")
    new = lambda s: s.withColumn("text", F.lit("new"))
    of = lambda df: sorted((r.id, r.text) for r in df.collect())
    assert of(U.generated(samples, old, new, "category", "idx", "id")) == [("a0", "old"), ("a1", "old"), ("a2", "new"), ("a3", "new")]
    assert of(U.generated(samples, old, new, "category", "idx", "id", ["a1", "a3"])) == [("a0", "old"), ("a1", "new"), ("a3", "new")]


def test_tail_probabilities(spark):
    of = lambda c: spark.range(1).select(c).first()[0]
    # tabled values
    for x, dof, p in ((3.841459, 1, 0.05), (5.991465, 2, 0.05), (18.307038, 10, 0.05), (124.342113, 100, 0.05), (23.209251, 10, 0.01), (0.0, 3, 1.0), (5000.0, 3, 0.0)):
        assert abs(of(ST.chi_square_tail(F.lit(x), F.lit(float(dof)))) - p) < 1e-6
    for t, dof, p in ((12.7062047, 1, 0.05), (2.228139, 10, 0.05), (1.959964, 1e7, 0.05), (-2.763262, 28, 0.01), (0.0, 5, 1.0)):
        assert abs(of(ST.t_tails(F.lit(t), F.lit(float(dof)))) - p) < 1e-6
    for x, p in ((1.3581, 0.05), (1.2238, 0.1), (1.6276, 0.01)):
        assert abs(of(ST.kolmogorov_tail(F.lit(x / 10), F.lit(200), F.lit(200))) - p) < 1e-4


def test_principal_components(spark):
    rng = np.random.default_rng(3)
    x = (rng.normal(size=(80, 6)) * [5, 3, 1, 1, 0.5, 0.1] + [1, 2, 3, 4, 5, 6]).astype(np.float32)
    rows = D.principal_components(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<float>"), "id", "v").orderBy("id").collect()
    c = x - x.mean(axis=0)
    _, _, vt = np.linalg.svd(c.astype(np.float64), full_matrices=False)
    for k in range(2):
        w = vt[k] * np.sign(vt[k][np.abs(vt[k]).argmax()])
        assert np.allclose([r[f"pc{k + 1}"] for r in rows], c @ w, atol=2e-5)


def test_topics(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(4, 5)) * 20
    x = [(i, (centres[i % 4] + rng.normal(size=5)).tolist(), "eval" if i % 4 < 3 and i % 8 < 4 or i % 4 == 0 else "synth") for i in range(200)]
    df = spark.createDataFrame(x, "id long, v array<double>, source string")
    assigned, found = D.topics(df, "v", k=4)
    rows, v = assigned.orderBy("id").collect(), np.array([r[1] for r in x])
    scaled = v / v.std(axis=0, ddof=1)
    near = ((scaled[:, None] - np.array(found)[None]) ** 2).sum(axis=2).argmin(axis=1)
    assert [r.topic for r in rows] == near.tolist()
    assert all(np.allclose(found[k], scaled[near == k].mean(axis=0), atol=1e-6) for k in range(4))
    table = D.topic_coverage(assigned).collect()
    by = {k: [sum(n == k and r[2] == s for n, r in zip(near, x)) for s in ("eval", "synth")] for k in range(4)}  # noqa: B905
    assert {r.topic: [r.n_eval, r.n_synth] for r in table} == by
    held = [k for k in by if by[k][0]]
    assert {r.coverage for r in table} == {round(sum(by[k][1] > 0 for k in held) / len(held), 6)}


def test_similar_pairs_are_those_of_brute_force(spark):
    rng = random.Random(8)
    sets = {}
    for i in range(300):
        base = sets[rng.randrange(i)] if i and rng.random() < 0.6 else {f"t{rng.randrange(60)}" for _ in range(rng.randrange(1, 40))}
        s = {t for t in base if rng.random() < 0.9} | {f"t{rng.randrange(60)}" for _ in range(rng.randrange(3))}
        sets[i] = s or {"t0"}
    for threshold in (0.5, 0.6, 0.75, 0.8):
        members, links = M.jaccard_links(spark.createDataFrame([(i, sorted(s)) for i, s in sets.items()] + [(999, [])], "id int, tokens array<string>"), threshold)
        first = {}
        for i in sorted(sets):
            first.setdefault(frozenset(sets[i]), i)
        assert {r.id: r["class"] for r in members.collect()} == {i: first[frozenset(s)] for i, s in sets.items()}
        ids = sorted(first.values())
        want = {(a, b) for a in ids for b in ids if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) > threshold}
        assert {(r.a, r.b) for r in links.collect()} == want and want


def test_similar_pairs_in_several_blocks_and_rounds(spark, monkeypatch):
    for name, small in (("NUMBERED", 16), ("HELD", 300), ("BLOCK", 80), ("ROUND", 2000)):
        monkeypatch.setattr(M, name, small)
    rng, sets = random.Random(9), {}
    for i in range(120):
        base = sets[rng.randrange(i)] if i and rng.random() < 0.6 else {f"t{rng.randrange(80)}" for _ in range(rng.randrange(1, 30))}
        sets[i] = {t for t in base if rng.random() < 0.95} | {f"own{i}"}
    _, links = M.jaccard_links(spark.createDataFrame([(i, sorted(s)) for i, s in sets.items()], "id bigint, tokens array<string>"), 0.5)
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) > 0.5}
    got = [(r.a, r.b) for r in links.collect()]
    assert sorted(got) == sorted(want) and want


def test_arrays_of_conversations_come_back_whole(spark, tmp_path):
    from turnwise.plans.catalog import QUERIES

    text = lambda i, t: None if (i + t) % 5 == 0 else "x" * (i % 7 + t)
    turns = [(i, t, "user", text(i, t)) for i in range(0, 9000, 91) for t in range(1 + i % 3)]
    spark.createDataFrame(turns, "conv_id bigint, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    want = {}
    for i, _, _, x in turns:
        n, chars = want.get(i, (0, None))
        want[i] = n + 1, chars if x is None else (chars or 0) + len(x)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as on larger tables, groups come out of several partitions
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        got = {r.convo_id: (r.n_turns, r.chars) for r in QUERIES["S1_json_array_scan"](spark, str(tmp_path)).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == want


def test_entry_works_without_the_optional_subpackage(tmp_path):
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/turnwise", tmp_path / "turnwise", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and e.oracle_sql() and not any(x.startswith('op') or x == 'pipeline' for x in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
