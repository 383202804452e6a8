"""Queries of sources, sinks, sampling, similarity and incremental processing."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from turnwise.functions import text as T
from turnwise.operators import relational as R
from turnwise.operators import sampling as O
from turnwise.operators import scoring as V
from turnwise.operators import similarity as M
from turnwise.plans import adapters as A
from turnwise.plans.adapters import with_views as W
from turnwise.plans.corpus_queries import TOK
from turnwise.plans.registry import query
from turnwise.plans.relational_queries import S, scored
from turnwise.plans.scoring_queries import TOOLS, TURN, tool_scores
from turnwise.sources import files as S_
from turnwise.sources import yaml_text as Y
from turnwise.streaming import incremental as U

TURN_SCHEMA = "convo_id bigint, category string, turns array<struct<turn_num: int, speaker: string, utterance: string, flow: string, intent: string, candidate_flows: array<string>>>"
PER_CONVO = "SELECT convo_id, count(*) AS n_turns, sum(length(utterance))::BIGINT AS chars FROM turns GROUP BY convo_id"


#: Conversations are ordered by spans of their ids.
SPAN = "convo_id div 1000"


def per_convo(convos):
    return convos.select("convo_id", F.size("turns").cast("long").alias("n_turns"), F.aggregate("turns", F.lit(None).cast("long"), lambda a, t: F.coalesce(a + F.length(t["utterance"]), a, F.length(t["utterance"]))).alias("chars"))


@query("S1_json_array_scan", W("turns", PER_CONVO))
def s1(spark, d):
    path = S_.scratch(spark, "array")
    S_.write_arrays(R.nest(A.turns(spark, d)).withColumn("part", F.expr(SPAN)), path, "part")
    return per_convo(S_.read_json(spark, path, TURN_SCHEMA))


@query("S2_single_or_list", W("turns", PER_CONVO))
def s2(spark, d):
    path = S_.scratch(spark, "single")
    rows = R.nest(A.turns(spark, d))
    one = rows.withColumn("part", F.when(F.col("convo_id") < 10, F.col("convo_id")).otherwise(-1)).groupBy("part").agg(F.collect_list(F.struct("convo_id", "category", "turns")).alias("c"))
    one.select(F.when(F.size("c") == 1, F.to_json(F.col("c")[0])).otherwise(F.to_json("c")).alias("value"), "part").repartition(16, "part").write.partitionBy("part").text(path)
    return per_convo(S_.read_json(spark, path, TURN_SCHEMA))


def lines_with_damage(spark, d, path):
    good = R.nest(A.turns(spark, d)).select(F.to_json(F.struct("convo_id", "category", "turns")).alias("value"))
    bad = spark.createDataFrame([('{"convo_id": 1, "turns": [',), ("not json",)], "value string")
    good.unionByName(bad).write.text(path)


@query("S3_lines_skip_bad", W("turns", PER_CONVO))
def s3(spark, d):
    path = S_.scratch(spark, "lines")
    lines_with_damage(spark, d, path)
    return per_convo(S_.good(S_.read_lines(spark, path, TURN_SCHEMA)))


@query("S4_last_wins", W("preds", "SELECT config_id, convo_id, turn_num, max_by(latency_ms, seed) AS latency_ms FROM preds GROUP BY ALL"))
def s4(spark, d):
    return R.last_wins(A.preds(spark, d).select("config_id", *TURN, "latency_ms", "seed"), ["config_id", *TURN], "seed").drop("seed")


@query("S5_scan_keyed", W("preds", "SELECT convo_id, max_by(latency_ms, turn_num) AS latency_ms FROM preds WHERE voter = 0 GROUP BY convo_id"))
def s5(spark, d):
    return R.last_wins(A.preds(spark, d).where("voter = 0").select("convo_id", "turn_num", "latency_ms"), ["convo_id"], "turn_num").drop("turn_num")


@query("S6_file_name_columns", W("preds", "SELECT domain, config_id, seed, count(*) AS n FROM preds GROUP BY ALL"))
def s6(spark, d):
    path = S_.scratch(spark, "named")
    p = A.preds(spark, d).select("convo_id", "turn_num", F.concat_ws("_", "domain", "config_id", F.concat(F.lit("seed"), "seed")).alias("name"))
    names = [r[0] for r in p.select("name").distinct().orderBy("name").collect()]  # one a run
    for n in names:
        p.where(F.col("name") == n).drop("name").write.json(f"{path}/{n}")
    rows = S_.file_columns(spark.read.schema("convo_id bigint, turn_num int").option("recursiveFileLookup", True).json(path))
    return rows.groupBy("domain", "config_id", "seed").agg(F.count(F.lit(1)).alias("n"))


@query("S7_summary_scan", W("preds", "SELECT config_id, round(avg(latency_ms), 4) AS mean FROM preds GROUP BY config_id"))
def s7(spark, d):
    path = S_.scratch(spark, "summaries")
    s = A.preds(spark, d).groupBy("config_id").agg(F.round(F.avg("latency_ms"), 4).alias("mean"))
    s.select("config_id", F.struct("mean").alias("summary"), F.col("config_id").alias("run")).write.partitionBy("run").json(path)  # a file a run
    return S_.read_json(spark, path, "config_id string, summary struct<mean: double>").select("config_id", "summary.mean")


@query("S8_config_scan", W("configs", "SELECT config_id, model, rate_in FROM configs"))
def s8(spark, d):
    path = S_.scratch(spark, "configs")
    A.configs(spark).write.json(path)
    return spark.read.schema("config_id string, model string, rate_in double").json(path)


@query("S10_markdown_tables", "SELECT * FROM (VALUES ('Ask', 'chat', 'Talk'), ('Ask', 'query', 'Look up'), ('Make', 'post', 'Write')) t(intent, flow, description)")
def s10(spark, d):
    text = ["# Flows", "| x | y |", "## Ask (2)", "| Flow | What |", "|---|---|", "| chat | Talk |", "| query | Look up |", "", "## Make (1)", "| Flow | What |", "|:--|--:|", "| post | Write |"]
    lines = spark.createDataFrame([("m", i, x) for i, x in enumerate(text)], "doc string, n int, value string")
    return S_.markdown_rows(lines).drop("doc")


@query("S11_append_sink", W("preds", "SELECT config_id, 2 * count(*) AS n FROM preds GROUP BY config_id"))
def s11(spark, d):
    path = S_.scratch(spark, "append")
    for _ in range(2):
        A.preds(spark, d).select("config_id", "convo_id").write.mode("append").json(path)
    return spark.read.schema("config_id string, convo_id bigint").json(path).groupBy("config_id").agg(F.count(F.lit(1)).alias("n"))


@query("S12_overwrite_sink", W("preds", "SELECT config_id, count(*) AS n FROM preds GROUP BY config_id"))
def s12(spark, d):
    path = S_.scratch(spark, "overwrite")
    for _ in range(2):
        A.preds(spark, d).select("config_id", "convo_id").write.mode("overwrite").json(path)
    return spark.read.schema("config_id string, convo_id bigint").json(path).groupBy("config_id").agg(F.count(F.lit(1)).alias("n"))


@query("S13_delete_keys", W("turns", "SELECT DISTINCT convo_id FROM turns WHERE convo_id % 3 <> 0"))
def s13(spark, d):
    path = S_.scratch(spark, "keys")
    ids = A.turns(spark, d).select("convo_id").distinct()
    ids.write.json(path)
    S_.delete_keys(spark, path, ids.where("convo_id % 3 = 0"), "convo_id", f"{path}.staged")
    return spark.read.schema("convo_id bigint").json(path)


@query("S14_sorted_finalise", W("turns", "SELECT convo_id, category, row_number() OVER (ORDER BY CASE category WHEN 'same_flow' THEN 1 WHEN 'switch_flow' THEN 2 WHEN 'ambiguous_first' THEN 3 ELSE 4 END, convo_id) AS at FROM (SELECT DISTINCT convo_id, category FROM turns)"))
def s14(spark, d):
    c = A.turns(spark, d).select("convo_id", "category").distinct()
    rank = S_.category_rank(F.col("category"))
    return R.counted(c, [], [rank, F.col("convo_id")], F.struct(rank.alias("rank"), F.expr(SPAN).alias("span"))).withColumnRenamed("pos", "at")


@query("S15_compact_json", W("turns", "SELECT convo_id, '{\"convo_id\":' || convo_id || ',\"category\":\"' || category || '\"}' AS line FROM (SELECT DISTINCT convo_id, category FROM turns)"))
def s15(spark, d):
    c = A.turns(spark, d).select("convo_id", "category").distinct()
    return c.select("convo_id", F.to_json(F.struct("convo_id", "category")).alias("line"))


@query("S16_summary_sink", S("SELECT config_id, round(sum(correct::INT) / count(*), 6) AS accuracy FROM scored GROUP BY config_id"))
def s16(spark, d):
    path = S_.scratch(spark, "summary")
    R.accuracy_by(scored(spark, d), "config_id").select("config_id", "accuracy").write.json(path)
    return spark.read.schema("config_id string, accuracy double").json(path)


CATALOG = """# tools
version: 1  # of the format
tools:
  read:
    name: "Read: a post"
    input_schema:
      properties:
        post_id: {type: string, description: "The id, whole"}
      required: [post_id]
    idempotent: true
  write:
    name: 'It''s a draft'
    tags: []
    steps:
    - one
    - {kind: two, of: [a, b]}
    - name: three
      last: ~
"""
LEAVES = [
    ("version", "1"), ("tools/read/name", "Read: a post"), ("tools/read/input_schema/properties/post_id/type", "string"),
    ("tools/read/input_schema/properties/post_id/description", "The id, whole"), ("tools/read/input_schema/required/0", "post_id"), ("tools/read/idempotent", "true"),
    ("tools/write/name", "It''s a draft"), ("tools/write/steps/0", "one"), ("tools/write/steps/1/kind", "two"), ("tools/write/steps/1/of/0", "a"),
    ("tools/write/steps/1/of/1", "b"), ("tools/write/steps/2/name", "three"), ("tools/write/steps/2/last", None),
]


@query("S19_yaml_catalog", "SELECT * FROM (VALUES " + ", ".join(f"({n}::BIGINT, '{p}', " + (f"'{v}')" if v else "NULL)") for n, (p, v) in enumerate(LEAVES)) + ") t(n, path, value)")
def s19(spark, d):
    path = S_.scratch(spark, "yaml")
    spark.createDataFrame([(CATALOG,)], "value string").write.text(path)
    return Y.read_yaml(spark, f"{path}/part-*").select("n", F.array_join("path", "/").alias("path"), "value")


@query("S20_injected_model", W("turns", "SELECT convo_id, turn_num, length(utterance)::BIGINT AS answer FROM gold"))
def s20(spark, d):
    """The remote model is an injected callable; here one that counts characters."""
    call = lambda r: {"convo_id": r["convo_id"], "turn_num": r["turn_num"], "answer": len(r["utterance"])}
    return S_.remote_predictions(A.gold(spark, d).select(*TURN, "utterance"), call, "convo_id bigint, turn_num bigint, answer bigint").select("convo_id", F.col("turn_num").cast("int").alias("turn_num"), "answer")


@query("S21_fallback_path", "SELECT count(*) AS n FROM benchmark")
def s21(spark, d):
    return spark.read.parquet(S_.first_that_exists(spark, [f"{d}/synthetic.parquet", f"{d}/benchmark.parquet"])).agg(F.count(F.lit(1)).alias("n"))


@query("S22_lenient_load", W("turns", "SELECT count(DISTINCT convo_id) AS good_lines, 2 AS bad_lines FROM turns"))
def s22(spark, d):
    path = S_.scratch(spark, "lenient")
    lines_with_damage(spark, d, path)
    bad = F.col(S_.CORRUPT).isNotNull()
    return S_.read_lines(spark, path, TURN_SCHEMA).select(bad.alias("bad"), "convo_id").agg(F.count_if(~F.col("bad")).alias("good_lines"), F.count_if("bad").cast("int").alias("bad_lines"))


@query("S23_strict_load", W("turns", PER_CONVO))
def s23(spark, d):
    path = S_.scratch(spark, "strict")
    R.nest(A.turns(spark, d)).write.json(path)
    return per_convo(S_.read_lines(spark, path, TURN_SCHEMA, strict=True))


@query("S24_chat_sink", W("turns", "SELECT convo_id, turn_num, (row_number() OVER (PARTITION BY convo_id ORDER BY turn_num))::INTEGER AS n_messages FROM turns"))
def s24(spark, d):
    path = S_.scratch(spark, "chat")
    S_.chat_examples(R.history(A.turns(spark, d))).select(*TURN, "messages").write.json(path)
    back = spark.read.schema("convo_id bigint, turn_num int, messages array<struct<role: string, content: string>>").json(path)
    return back.select(*TURN, F.size("messages").alias("n_messages"))


@query("S25_hard_failure", "SELECT TRUE AS raised")
def s25(spark, d):
    from pyspark.errors import AnalysisException

    try:
        spark.read.parquet(f"{d}/no_such_table.parquet")
    except AnalysisException:
        return spark.range(1).select(F.lit(True).alias("raised"))
    return spark.range(1).select(F.lit(False).alias("raised"))


@query("S26_metric_sink", "SELECT event_type, round(avg(value), 4) AS mean FROM events GROUP BY event_type")
def s26(spark, d):
    path = S_.scratch(spark, "metrics")
    A.table(spark, d, "events").groupBy("event_type").agg(F.round(F.avg("value"), 4).alias("mean")).write.json(path)
    return spark.read.schema("event_type string, mean double").json(path)


@query("S27_dimension_loads", W("flows tools", "SELECT (SELECT count(*) FROM flows) AS flows, (SELECT count(*) FROM tools) AS tools, (SELECT count(*) FROM (SELECT unnest(edge_flows) FROM flows)) AS edges"))
def s27(spark, d):
    f = A.flows(spark).agg(F.count(F.lit(1)).alias("flows"), F.sum(F.size("edge_flows")).alias("edges"))
    return f.crossJoin(F.broadcast(A.tools(spark).agg(F.count(F.lit(1)).alias("tools")))).select("flows", "tools", "edges")  # one row each


# -- similarity -------------------------------------------------------------

DOC_TOKENS = f"t AS (SELECT DISTINCT doc_id AS id, unnest({TOK.replace('utterance', 'text')}) AS token FROM documents), n AS (SELECT id, count(*) AS n FROM t GROUP BY id)"
PAIRS = ", pairs AS (SELECT a, b, s / (x.n + y.n - s) AS jaccard FROM (SELECT p.id AS a, q.id AS b, count(*) AS s FROM t p JOIN t q ON p.token = q.token AND p.id < q.id GROUP BY ALL) JOIN n x ON x.id = a JOIN n y ON y.id = b)"


def doc_tokens(spark, d):
    return A.table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.array_distinct(T.tokens(F.col("text"))).alias("tokens"))


CLASSES = ", k AS (SELECT id, list_sort(list(token)) AS ts FROM t GROUP BY id), cl AS (SELECT id, min(id) OVER (PARTITION BY ts) AS class, count(*) OVER (PARTITION BY ts) - 1 AS n_copies FROM k), ln AS (SELECT p.a AS x, p.b AS y FROM pairs p WHERE jaccard > 0.6 UNION ALL SELECT p.b, p.a FROM pairs p WHERE jaccard > 0.6), lc AS (SELECT c.class, count(DISTINCT d.class) AS n_links FROM ln JOIN cl c ON c.id = x JOIN cl d ON d.id = y WHERE c.class <> d.class GROUP BY c.class), counts AS (SELECT id, class, coalesce(n_links, 0) AS n_links, n_copies FROM cl LEFT JOIN lc USING (class))"


@query("J7_similar_pairs", f"WITH {DOC_TOKENS}{PAIRS}{CLASSES} SELECT id AS doc_id, class, n_links, n_copies FROM counts")
def j7(spark, d):
    return M.link_counts(*M.jaccard_links(doc_tokens(spark, d), 0.6)).withColumnRenamed("id", "doc_id")


@query("T5_uniqueness", f"WITH {DOC_TOKENS}{PAIRS} SELECT doc_id, doc_id NOT IN (SELECT a FROM pairs WHERE jaccard > 0.6 UNION SELECT b FROM pairs WHERE jaccard > 0.6) AS is_unique FROM documents")
def t5(spark, d):
    c = M.link_counts(*M.jaccard_links(doc_tokens(spark, d), 0.6)).withColumnRenamed("id", "doc_id")
    alone = F.coalesce((F.col("n_links") == 0) & (F.col("n_copies") == 0), F.lit(True))
    return A.table(spark, d, "documents").select("doc_id").join(c, "doc_id", "left").select("doc_id", alone.alias("is_unique"))


GREEDY = ", e AS (SELECT b AS id, list(a) AS nb FROM pairs WHERE jaccard > 0.5 GROUP BY b), o AS MATERIALIZED (SELECT doc_id AS id, row_number() OVER (ORDER BY doc_id) AS k, coalesce(nb, []::BIGINT[]) AS nb FROM documents LEFT JOIN e ON e.id = doc_id), g AS (SELECT 0::BIGINT AS k, []::BIGINT[] AS kept UNION ALL SELECT o.k, CASE WHEN list_has_any(kept, nb) THEN kept ELSE list_append(kept, o.id) END FROM g JOIN o ON o.k = g.k + 1) SELECT unnest(kept) AS doc_id FROM g WHERE k = (SELECT max(k) FROM g)"


@query("T15_greedy_filter", f"WITH RECURSIVE {DOC_TOKENS}{PAIRS}{GREEDY}")
def t15(spark, d):
    """Order-dependent. Of equal texts only the first can survive."""
    members, links = M.jaccard_links(doc_tokens(spark, d), 0.5)
    ids = A.table(spark, d, "documents").select(F.col("doc_id").alias("id")).distinct()
    ids = ids.join(members.where("id <> class").select("id"), "id", "left_anti")
    return M.greedy_survivors(ids, links).withColumnRenamed("id", "doc_id")


T17 = """WITH RECURSIVE l AS (SELECT n_nationkey AS id, (n_nationkey * 2 + 1) % 25 AS nxt FROM nation WHERE n_nationkey % 5 <> 0),
w AS (SELECT id, nxt AS cur, [id] AS path FROM l UNION ALL SELECT w.id, l.nxt, list_append(path, cur) FROM w JOIN l ON l.id = w.cur WHERE NOT list_contains(path, cur)),
e AS (SELECT id, cur FROM w WHERE list_contains(path, cur) OR cur NOT IN (SELECT id FROM l))
SELECT id::BIGINT AS id, cur::BIGINT AS root FROM e"""


@query("T17_survivor_chase", T17)
def t17(spark, d):
    n = A.table(spark, d, "nation").where("n_nationkey % 5 <> 0").selectExpr("CAST(n_nationkey AS BIGINT) AS removed", "CAST((n_nationkey * 2 + 1) % 25 AS BIGINT) AS kept_by")
    return M.survivors(n)


def judge_replies(spark, d):
    """Two phases of a judge's replies on documents, phase, n, reply, ids. Phase 1 sees batches of 60 and names those of equal
    language and n_chars % 7 one cluster; phase 2 sees what is left at n_chars % 3 = 0, by n_chars % 11. Replies are fenced, wrapped in words, or broken, and name strangers."""
    docs = A.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), "doc_id", "lang", "n_chars")

    def phase(rows, number, batch, group):
        c = rows.groupBy(batch.alias("n"), *group).agg(F.array_sort(F.collect_list("doc_id")).alias("m"))
        c = c.where("size(m) > 1").select("n", F.col("m")[0].cast("string").alias("keep"), F.concat(F.col("m").cast("array<string>"), F.array(F.lit("nobody"))).alias("remove"))
        told = c.groupBy("n").agg(F.to_json(F.struct(F.array_sort(F.collect_list(F.struct("keep", "remove"))).alias("clusters"))).alias("json"))
        shown = rows.groupBy(batch.alias("n")).agg(F.collect_list("id").alias("ids"))
        wrapped = F.when(F.col("n") % 5 == 4, "no json").when(F.col("n") % 3 == 0, F.concat(F.lit("```json\n"), "json", F.lit("\n```"))).when(F.col("n") % 3 == 1, F.concat(F.lit("Here: "), "json", F.lit(" done"))).otherwise(F.col("json"))
        return told.join(shown, "n").select(F.lit(number).alias("phase"), "n", wrapped.alias("reply"), "ids")

    first = phase(docs, 1, F.floor(F.col("doc_id") / 60), ["lang", F.col("n_chars") % 7])
    gone = M.merged_removals(M.parsed_clusters(first))
    second = phase(docs.where("n_chars % 3 = 0").join(gone, "id", "left_anti"), 2, F.floor(F.col("doc_id") / 6000), [F.col("n_chars") % 11])
    return first.unionByName(second)


T16 = """WITH p AS (SELECT doc_id, n_chars, min(doc_id) OVER (PARTITION BY doc_id // 60, lang, n_chars % 7) AS keep, (doc_id // 60) % 5 = 4 AS broken FROM documents),
s AS (SELECT doc_id, n_chars FROM p WHERE broken OR doc_id = keep),
q AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY doc_id // 6000, n_chars % 11) AS keep, (doc_id // 6000) % 5 = 4 AS broken FROM s WHERE n_chars % 3 = 0)
SELECT doc_id FROM s WHERE doc_id NOT IN (SELECT doc_id FROM q WHERE doc_id <> keep AND NOT broken)"""


@query("T16_semantic_dedup", T16)
def t16(spark, d):
    """Judges are outside; their replies are parsed and checked, the clusters of both phases merged, and what they remove goes."""
    gone = M.merged_removals(M.parsed_clusters(judge_replies(spark, d)))
    return A.table(spark, d, "documents").select("doc_id").join(gone.select(F.col("id").cast("bigint").alias("doc_id")), "doc_id", "left_anti")


# -- sampling and ordering --------------------------------------------------

H = "((convo_id * 1103515245 + 12345) % 2147483647)"
CONVOS = "cv AS (SELECT DISTINCT convo_id, category, domain FROM turns)"


def convos(spark, d):
    return A.turns(spark, d).select("convo_id", "category", "domain").distinct()


@query("O4_group_top_k", W("turns", f", {CONVOS} SELECT category, convo_id FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY {H}, convo_id) AS r FROM cv) WHERE r <= 4"))
def o4(spark, d):
    return R.top_per_group(convos(spark, d), ["category"], [O.hashed(F.col("convo_id")), F.col("convo_id")], 4).select("category", "convo_id")


@query("O5_pair_sampling", W("flows", ", p AS (SELECT a.name AS a, b.name AS b, a.intent = b.intent AS same, (substr(a.name, 2)::BIGINT * 100 + substr(b.name, 2)::BIGINT) AS k FROM flows a JOIN flows b ON a.name < b.name) SELECT a, b, same FROM (SELECT *, row_number() OVER (PARTITION BY same ORDER BY (k * 1103515245 + 12345) % 2147483647, a, b) AS r FROM p) WHERE r <= 5"))
def o5(spark, d):
    f = A.flows(spark)
    a, b = f.select(F.col("name").alias("a"), F.col("intent").alias("ia")), f.select(F.col("name").alias("b"), F.col("intent").alias("ib"))
    p = a.join(F.broadcast(b), F.col("a") < F.col("b")).withColumn("same", F.col("ia") == F.col("ib"))  # an ontology of some dozens
    k = F.substring("a", 2, 9).cast("long") * 100 + F.substring("b", 2, 9).cast("long")
    return R.top_per_group(p, ["same"], [O.hashed(k), F.col("a"), F.col("b")], 5).select("a", "b", "same")


@query("O6_confusable_sampling", W("flows", ", e AS (SELECT DISTINCT least(a, b) AS flow_a, greatest(a, b) AS flow_b FROM (SELECT name AS a, unnest(edge_flows) AS b FROM flows WHERE intent NOT IN ('Plan', 'Internal')) JOIN flows f ON f.name = b AND f.intent NOT IN ('Plan', 'Internal') WHERE a <> b), r AS (SELECT *, row_number() OVER (ORDER BY flow_a, flow_b) - 1 AS k, count(*) OVER () AS n FROM e) SELECT i, flow_a, flow_b FROM range(10) t(i) JOIN r ON k = i % n"))
def o6(spark, d):
    e = R.edge_pairs(A.flows(spark))
    bank = R.ranked(e, [F.col("flow_a"), F.col("flow_b")]).withColumn("slot", F.col("rank") - 1)
    n = bank.agg(F.max("rank").alias("n"))
    i = spark.range(10).select(F.col("id").alias("i")).crossJoin(F.broadcast(n))  # one row
    return i.join(F.broadcast(bank), F.col("i") % F.col("n") == F.col("slot")).select("i", "flow_a", "flow_b")


@query("O7_triples", W("flows", ", t AS (SELECT a.name AS a, b.name AS b, c.name AS c, substr(a.name, 2)::BIGINT * 10000 + substr(b.name, 2)::BIGINT * 100 + substr(c.name, 2)::BIGINT AS k FROM flows a JOIN flows b ON a.name < b.name AND a.intent <> b.intent JOIN flows c ON b.name < c.name AND c.intent NOT IN (a.intent, b.intent)) SELECT a, b, c FROM t ORDER BY (k * 1103515245 + 12345) % 2147483647, a, b, c LIMIT 6"))
def o7(spark, d):
    f = A.flows(spark)
    of = lambda x: F.broadcast(f.select(F.col("name").alias(x), F.col("intent").alias(f"i{x}")))  # noqa: E731  an ontology of some dozens
    t = of("a").join(of("b"), (F.col("a") < F.col("b")) & (F.col("ia") != F.col("ib"))).join(of("c"), (F.col("b") < F.col("c")) & ~F.col("ic").isin(F.col("ia"), F.col("ib")))
    k = F.substring("a", 2, 9).cast("long") * 10000 + F.substring("b", 2, 9).cast("long") * 100 + F.substring("c", 2, 9).cast("long")
    return t.orderBy(O.hashed(k), "a", "b", "c").limit(6).select("a", "b", "c")


BANK = ["b0", "b1", "b2"]


@query("O8_round_robin", W("turns", f", {CONVOS}, r AS (SELECT convo_id, row_number() OVER (PARTITION BY category ORDER BY convo_id) - 1 AS pos FROM cv) SELECT convo_id, 'b' || (pos % 3) AS entry FROM r"))
def o8(spark, d):
    bank = spark.createDataFrame(list(enumerate(BANK)), "slot int, entry string")
    return O.round_robin(O.positions(convos(spark, d), ["category"], [F.col("convo_id")], F.expr(SPAN)), bank, len(BANK)).select("convo_id", "entry")


@query("O9_anchor_round_robin", W("turns", f", {CONVOS}, r AS (SELECT convo_id, row_number() OVER (PARTITION BY category ORDER BY convo_id) - 1 AS pos FROM cv) SELECT convo_id, 'f' || (2 * pos % 12) AS a, 'f' || ((2 * pos + 1) % 12) AS b FROM r"))
def o9(spark, d):
    p = O.positions(convos(spark, d), ["category"], [F.col("convo_id")], F.expr(SPAN))
    at = lambda k: F.concat(F.lit("f"), F.pmod(2 * F.col("pos") + k, F.lit(12)))
    return p.select("convo_id", at(0).alias("a"), at(1).alias("b"))


@query("O10_tool_cursor", W("turns", "SELECT convo_id, turn_num, ((1 + (flow = 'f1')::INT) * (row_number() OVER (PARTITION BY flow ORDER BY convo_id, turn_num) - 1) % 3)::INTEGER AS cursor FROM gold"))
def o10(spark, d):
    step = F.when(F.col("flow") == "f1", 2).otherwise(1)
    return O.cursor(A.gold(spark, d), "flow", [F.col("convo_id"), F.col("turn_num")], step, 3).select(*TURN, "cursor")


@query("O11_category_split", W("turns", f", {CONVOS} SELECT convo_id, ntile(4) OVER (PARTITION BY domain ORDER BY {H}, convo_id)::INTEGER AS bucket FROM cv"))
def o11(spark, d):
    return O.near_equal_buckets(convos(spark, d), ["domain"], [O.hashed(F.col("convo_id")), F.col("convo_id")], 4).select("convo_id", "bucket")


@query("O12_chunk_to_model", W("turns", f", {CONVOS}, r AS (SELECT convo_id, row_number() OVER (PARTITION BY domain ORDER BY convo_id) - 1 AS pos, count(*) OVER (PARTITION BY domain) AS n FROM cv) SELECT convo_id, floor(pos / ceil(n / 3))::BIGINT AS model FROM r"))
def o12(spark, d):
    p = O.positions(convos(spark, d), ["domain"], [F.col("convo_id")], F.expr(SPAN)).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("domain")))
    return p.select("convo_id", F.floor(F.col("pos") / F.ceil(F.col("n") / 3)).alias("model"))


@query("O13_batches", W("turns", f", {CONVOS}, r AS (SELECT convo_id, row_number() OVER (PARTITION BY domain ORDER BY convo_id) - 1 AS pos FROM cv) SELECT convo_id, (pos // 16)::BIGINT AS batch FROM r"))
def o13(spark, d):
    return O.positions(convos(spark, d), ["domain"], [F.col("convo_id")], F.expr(SPAN)).select("convo_id", F.floor(F.col("pos") / 16).alias("batch"))


FOLD = ", z AS MATERIALIZED (SELECT domain AS lane, convo_id AS ord, count(*) AS size, row_number() OVER (PARTITION BY domain ORDER BY convo_id) AS k FROM turns GROUP BY domain, convo_id), f AS (SELECT lane, k, ord, size AS used, 0::BIGINT AS batch FROM z WHERE k = 1 UNION ALL SELECT z.lane, z.k, z.ord, CASE WHEN f.used + z.size > 16 THEN z.size ELSE f.used + z.size END, f.batch + (f.used + z.size > 16)::BIGINT FROM f JOIN z ON z.lane = f.lane AND z.k = f.k + 1) SELECT lane, ord, batch FROM f"


@query("O14_group_batches", W("turns", FOLD).replace("WITH", "WITH RECURSIVE", 1))
def o14(spark, d):
    g = A.turns(spark, d).groupBy("domain", "convo_id").agg(F.count(F.lit(1)).alias("size")).select(F.col("domain").alias("lane"), F.col("convo_id").alias("ord"), "size")
    return O.pack_groups(g, 16)


@query("O15_stratified_split", W("turns", f", {CONVOS}, r AS (SELECT convo_id, row_number() OVER (PARTITION BY category, domain ORDER BY {H}, convo_id) AS k, greatest(1, floor(count(*) OVER (PARTITION BY category, domain) * 0.2::DOUBLE)) AS v FROM cv) SELECT convo_id, CASE WHEN k <= v THEN 'val' ELSE 'train' END AS split FROM r"))
def o15(spark, d):
    return O.stratified_split(convos(spark, d), ["category", "domain"], [O.hashed(F.col("convo_id")), F.col("convo_id")], 0.2).select("convo_id", "split")


@query("O16_random_split", W("turns", f", {CONVOS} SELECT convo_id, CASE WHEN {H} % 10 < 2 THEN 'val' ELSE 'train' END AS split FROM cv"))
def o16(spark, d):
    return convos(spark, d).select("convo_id", F.when(O.hashed(F.col("convo_id")) % 10 < 2, "val").otherwise("train").alias("split"))


@query("O17_flow_pick", W("turns", f", {CONVOS} SELECT convo_id, 'f' || ({H} % 12) AS flow, CASE WHEN category = 'same_flow' THEN NULL ELSE 'f' || (({H} % 12 + 1) % 12) END AS other FROM cv"))
def o17(spark, d):
    k = O.hashed(F.col("convo_id")) % 12
    f = lambda x: F.concat(F.lit("f"), x.cast("string"))
    return convos(spark, d).select("convo_id", f(k).alias("flow"), F.when(F.col("category") != "same_flow", f((k + 1) % 12)).alias("other"))


SEQ = "sq AS (SELECT convo_id, list(flow ORDER BY turn_num) AS fl, list(intent ORDER BY turn_num) AS it FROM turns GROUP BY convo_id)"


def sequences(spark, d):
    s = A.turns(spark, d).groupBy("convo_id").agg(F.array_sort(F.collect_list(F.struct("turn_num", "flow", "intent"))).alias("s"))
    return s.select("convo_id", F.col("s.flow").alias("fl"), F.col("s.intent").alias("it"))


@query("O18_sequence_validation", W("turns", f", {SEQ} SELECT convo_id, trim(CASE WHEN len(fl) < 5 OR len(fl) > 7 THEN 'length ' ELSE '' END || CASE WHEN len(list_distinct(fl)) < len(fl) THEN 'duplicate ' ELSE '' END || CASE WHEN len(list_distinct(it)) < 3 THEN 'few_intents ' ELSE '' END || CASE WHEN list_max(list_transform(list_distinct(it), lambda x: len(list_filter(it, lambda y: y = x)))) > 2 THEN 'crowded_intent' ELSE '' END) AS errors FROM sq"))
def o18(spark, d):
    return sequences(spark, d).select("convo_id", F.array_join(O.sequence_errors(F.col("fl"), F.col("it")), " ").alias("errors"))


@query("O19_sequence_repair", W("turns", f", {SEQ}, k AS (SELECT convo_id, u.f, min(u.i) AS i FROM (SELECT convo_id, unnest(fl) AS f, generate_subscripts(fl, 1) AS i FROM sq) u WHERE f <> 'f11' GROUP BY ALL), o AS (SELECT convo_id, string_agg(f, ',' ORDER BY i) AS r FROM (SELECT *, row_number() OVER (PARTITION BY convo_id ORDER BY i) AS p FROM k) WHERE p <= 7 GROUP BY convo_id) SELECT sq.convo_id, coalesce(r, '') AS repaired FROM sq LEFT JOIN o USING (convo_id)"))
def o19(spark, d):
    known = [f"f{i}" for i in range(11)]
    return sequences(spark, d).select("convo_id", F.array_join(O.repaired(F.col("fl"), known), ",").alias("repaired"))


@query("O20_flow_subset", W("flows", "SELECT name FROM flows ORDER BY (substr(name, 2)::BIGINT * 1103515245 + 12345) % 2147483647, name LIMIT 5"))
def o20(spark, d):
    return A.flows(spark).select("name").orderBy(O.hashed(F.substring("name", 2, 9).cast("long")), "name").limit(5)


@query("O21_persona_hint", W("turns", f", {CONVOS} SELECT convo_id, CASE WHEN {H} % 10 < 3 THEN 'p' || ({H} % 5) END AS persona FROM cv"))
def o21(spark, d):
    h = O.hashed(F.col("convo_id"))
    return convos(spark, d).select("convo_id", F.when(h % 10 < 3, F.concat(F.lit("p"), (h % 5).cast("string"))).alias("persona"))


@query("O22_display_order", W("configs", "SELECT config_id, coalesce(list_position(['m1', 'm0'], model), 999)::BIGINT AS at FROM configs"))
def o22(spark, d):
    at = F.array_position(F.array(F.lit("m1"), F.lit("m0")), F.col("model"))
    return A.configs(spark).select("config_id", F.when(at > 0, at).otherwise(999).alias("at"))


@query("O23_category_sampler", W("turns", f", {CONVOS} SELECT category, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY {H}, convo_id) AS r FROM cv) WHERE r <= 3 GROUP BY category"))
def o23(spark, d):
    return R.top_per_group(convos(spark, d), ["category"], [O.hashed(F.col("convo_id")), F.col("convo_id")], 3).groupBy("category").agg(F.count(F.lit(1)).alias("n"))


@query("O24_skip_existing", W("turns", f", {CONVOS}, r AS (SELECT category, convo_id, row_number() OVER (PARTITION BY category ORDER BY convo_id) AS k FROM cv) SELECT category, convo_id FROM r WHERE k > CASE category WHEN 'same_flow' THEN 3 WHEN 'switch_flow' THEN 1 ELSE 0 END"))
def o24(spark, d):
    have = spark.createDataFrame([("same_flow", 3), ("switch_flow", 1)], "category string, have int")
    p = O.positions(convos(spark, d), ["category"], [F.col("convo_id")], F.expr(SPAN)).join(F.broadcast(have), "category", "left")
    return p.where(F.col("pos") + 1 > F.coalesce("have", F.lit(0))).select("category", "convo_id")


# -- incremental ------------------------------------------------------------


@query("U1_resume", W("turns", "SELECT DISTINCT convo_id, convo_id % 2 = 0 AS even FROM turns"))
def u1(spark, d):
    base = S_.scratch(spark, "resume")
    c = convos(spark, d).select("convo_id")
    for part in range(3):
        c.where(F.col("convo_id") % 3 == part).coalesce(1).write.mode("append").json(f"{base}/in")
    c.where("convo_id % 5 = 0").coalesce(1).write.mode("append").json(f"{base}/in")  # arrives twice
    for _ in range(2):
        U.run_available(spark, f"{base}/in", "convo_id bigint", f"{base}/out", f"{base}/state", lambda r: r.withColumn("even", F.col("convo_id") % 2 == 0), "convo_id")
    return spark.read.parquet(f"{base}/out").select("convo_id", "even")


@query("U2_waves", W("turns", f", {CONVOS} SELECT convo_id, category, convo_id % 5 AS wave FROM cv"))
def u2(spark, d):
    """Five files, a wave each, in the order of their arrival; a row of an earlier wave that comes again is not taken."""
    base = S_.scratch(spark, "waves")
    c = convos(spark, d).select("convo_id", "category")
    for part in range(5):
        again = c.where(F.col("convo_id") % 5 == part - 1).withColumn("category", F.lit("late"))
        c.where(F.col("convo_id") % 5 == part).unionByName(again).coalesce(1).write.mode("append").json(f"{base}/in")
    U.run_available(spark, f"{base}/in", "convo_id bigint, category string", f"{base}/out", f"{base}/state", lambda r: r, "convo_id", files_per_wave=1)
    return spark.read.parquet(f"{base}/out").select("convo_id", "category", "wave")


RETRY = """, {CONVOS}, a1 AS (SELECT *, (row_number() OVER (PARTITION BY domain ORDER BY convo_id) - 1) // 8 AS batch FROM cv), f1 AS (SELECT convo_id, domain FROM a1 WHERE convo_id % 4 IN (1, 2)),
a2 AS (SELECT *, (row_number() OVER (PARTITION BY domain ORDER BY convo_id) - 1) // 4 AS batch FROM f1), f2 AS (SELECT convo_id, domain FROM a2 WHERE convo_id % 8 IN (1, 2)),
a3 AS (SELECT *, (row_number() OVER (PARTITION BY domain ORDER BY convo_id) - 1) // 4 AS batch FROM f2)
SELECT convo_id, 1 AS attempt, batch, true AS ok FROM a1 WHERE convo_id % 4 NOT IN (1, 2) UNION ALL SELECT convo_id, 2, batch, true FROM a2 WHERE convo_id % 8 NOT IN (1, 2) UNION ALL SELECT convo_id, 3, batch, convo_id % 16 NOT IN (1, 2) FROM a3"""


@query("U3_retry_passes", W("turns", RETRY.replace("{CONVOS}", CONVOS)))
def u3(spark, d):
    """What fails goes into half-sized batches, twice at most; the evaluator stands for a provider that fails less often each time."""
    ok = lambda attempt: ~(F.col("convo_id") % F.pow(F.lit(2), attempt + 1)).isin(1, 2)
    return U.retried(convos(spark, d).select("convo_id", "domain"), ok, "domain", "convo_id", 8).select("convo_id", "attempt", "batch", "ok")


@query("U4_gated_retry", W("turns", f", {CONVOS} SELECT convo_id, CASE WHEN convo_id % 4 <> 1 THEN 'ok' WHEN convo_id % 3 + 1 >= 3 THEN 'warn' ELSE 'retry' END AS verdict FROM cv"))
def u4(spark, d):
    return convos(spark, d).select("convo_id", U.verdict(F.col("convo_id") % 4 != 1, F.col("convo_id") % 3 + 1).alias("verdict"))


ERRORS = "CASE event_id % 5 WHEN 0 THEN 'Error: 429' WHEN 1 THEN 'Timeout' WHEN 2 THEN '429 per_day' WHEN 3 THEN 'ValueError' END"


@query("U5_rate_limit", f"WITH e AS (SELECT event_id, event_type, epoch_us(ts) // 1000 AS t_ms, row_number() OVER (PARTITION BY event_type ORDER BY epoch_us(ts) // 1000, event_id) AS k, lower({ERRORS}) AS error FROM events) SELECT event_id, (3000000 * k + max(t_ms - 3000000 * k) OVER (PARTITION BY event_type ORDER BY k ROWS UNBOUNDED PRECEDING))::BIGINT AS start, CASE WHEN regexp_matches(error, '429|timeout') AND NOT contains(error, 'per_day') AND event_id % 4 < 3 THEN greatest(0.5::DOUBLE * 2 ** (event_id % 4), CASE WHEN contains(error, '429') THEN 5 ELSE 0.5 END) END::DOUBLE AS delay FROM e")
def u5(spark, d):
    """A lane an event type, one event in 50 minutes; waits after errors."""
    e = A.table(spark, d, "events").select("event_id", "event_type", F.expr("timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)").alias("at"), F.expr(ERRORS).alias("error"))
    p = U.paced(e, "event_type", "at", "event_id", 3_000_000, 86_400_000)
    return p.select("event_id", "start", U.backoff(F.col("error"), F.col("event_id") % 4).alias("delay"))


@query("U7_error_rows", "SELECT event_id, coalesce(TRY_CAST(CASE WHEN event_id % 6 = 0 THEN 'x' ELSE json_extract_string(props, '$.k') END AS BIGINT), -1) AS k, event_id % 6 = 0 AS failed FROM events")
def u7(spark, d):
    raw = F.when(F.col("event_id") % 6 == 0, "x").otherwise(F.get_json_object("props", "$.k"))
    k = raw.try_cast("bigint")
    return A.table(spark, d, "events").select("event_id", U.safe(k, F.lit(-1)).alias("k"), k.isNull().alias("failed"))


@U.stage("flow")
def _flow_reward():
    return F.col("flow_reward")


@U.stage("tool")
def _tool_reward():
    return F.col("tool_reward")


REWARD = " SELECT t.convo_id, t.turn_num, t.voter, round(0.5 * t.correct::INT + 0.5 * coalesce(len(p.detected_flows) = 1 AND p.detected_flows[1] = g.flow, false)::INT, 6)::DOUBLE AS reward FROM tool_scores t JOIN gold g USING (convo_id, turn_num) LEFT JOIN preds p USING (convo_id, turn_num, voter)"


@query("U8_stage_registry", W("tool_turns preds", TOOLS + REWARD))
def u8(spark, d):
    s = scored(spark, d).select(*TURN, "voter", F.col("correct").cast("double").alias("flow_reward"))
    t = tool_scores(spark, d).select(*TURN, "voter", F.col("correct").cast("double").alias("tool_reward")).join(s, [*TURN, "voter"])
    return t.select(*TURN, "voter", F.round(U.composed("flow+tool"), 6).alias("reward"))


@query("V21_fuzzy_match", "SELECT event_id, event_id % 3 <> 0 OR event_id % 2 = 0 AS match FROM events")
def v21(spark, d):
    """Normalised equality first; what is left goes to the injected judge, here one that accepts even ids."""
    want = F.col("event_type")
    got = F.when(F.col("event_id") % 3 == 0, F.concat(want, F.lit("~"))).otherwise(F.upper(want))
    judge = F.col("event_id") % 2 == 0
    return A.table(spark, d, "events").select("event_id", ((V.normalised(want) == V.normalised(got)) | judge).alias("match"))


@query("V32_reward_callbacks", S("SELECT voter, convo_id, turn_num, (CASE WHEN len(candidate_flows) > 0 THEN len(list_intersect(detected_flows, candidate_flows)) > 0 ELSE correct END)::INT::DOUBLE AS reward FROM scored"))
def v32(spark, d):
    by_row = {"clear": lambda: F.col("correct"), "ambiguous": lambda: F.arrays_overlap("detected_flows", "candidate_flows")}
    kind = F.size("candidate_flows") > 0
    return scored(spark, d).select("voter", *TURN, F.when(kind, by_row["ambiguous"]()).otherwise(by_row["clear"]()).cast("double").alias("reward"))


SFT = """, ok AS (SELECT voter, convo_id, turn_num, '{"flows":["' || detected_flows[1] || '"]}' AS label FROM scored WHERE correct AND len(detected_flows) = 1),
v AS (SELECT DISTINCT voter FROM preds),
said AS (SELECT v.voter, t.convo_id, t.turn_num, label, speaker, utterance, CASE WHEN speaker = 'user' THEN 'user: ' || utterance || chr(10) || 'assistant: ' || coalesce(label, '[skipped]') ELSE 'assistant: ' || utterance END AS said
  FROM turns t CROSS JOIN v LEFT JOIN ok ON ok.voter = v.voter AND ok.convo_id = t.convo_id AND ok.turn_num = t.turn_num AND speaker = 'user'),
h AS (SELECT *, string_agg(said, chr(10)) OVER (PARTITION BY voter, convo_id ORDER BY turn_num ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM said)
SELECT voter, convo_id, turn_num, label, 'system: flows of ' || voter || coalesce(chr(10) || before, '') || chr(10) || 'user: ' || utterance AS dialogue FROM h WHERE label IS NOT NULL"""


@query("U10_rerun", W("preds", "SELECT seed, convo_id, turn_num FROM preds WHERE config_id = 'c1' AND seed IN (1, 2)"))
def u10(spark, d):
    """A runner is a function; the third seed's fails and is passed over."""
    def runner(seed, path):
        if seed == 9:
            raise RuntimeError("no such seed")
        A.preds(spark, d).where((F.col("config_id") == "c1") & (F.col("seed") == seed)).select("seed", *TURN).write.json(path)

    return U.rerun(spark, runner, S_.scratch(spark, "rerun"), "d0_c1", [1, 2, 9], "seed int, convo_id bigint, turn_num int")


MADE = "SELECT category, idx, 'c' || category || '_' || printf('%03d', idx + 1) AS id, {0} AS text FROM s"


@query("U13_generation", W("turns", f", {CONVOS}, s AS (SELECT category, convo_id // 4 AS idx FROM cv), h AS ({MADE.format("'old'")} WHERE idx < 5), n AS ({MADE.format("'new ' || idx")} WHERE idx >= coalesce((SELECT count(*) FROM h WHERE h.category = s.category), 0) AND idx % 6 <> 5) SELECT id, category, text FROM h UNION ALL SELECT id, category, text FROM n"))
def u13(spark, d):
    """A batch over all categories that goes on where an earlier one ended; the generator is injected and fails on every sixth sample."""
    idx = F.expr("convo_id div 4")
    number = F.lpad((idx + 1).cast("string"), F.greatest(F.lit(3), F.length((idx + 1).cast("string"))), F.lit("0"))
    samples = convos(spark, d).select("category", idx.alias("idx"), F.concat(F.lit("c"), "category", F.lit("_"), number).alias("id"))
    old = samples.where("idx < 5").select("id", "category", F.lit("old").alias("text"))
    new = lambda s: s.where("idx % 6 <> 5").withColumn("text", F.concat(F.lit("new "), F.col("idx").cast("string")))
    return U.generated(samples, old, new, "category", "idx", "id")


@query("U11_sft_labels", S(SFT))
def u11(spark, d):
    """Examples of turns on which the ensemble was right and sure, with the whole history; other turns stay in it as [skipped]."""
    s = scored(spark, d).withColumn("confidence", F.when(F.size("detected_flows") > 0, 1 / F.size("detected_flows")).otherwise(0.0))
    label = F.to_json(F.struct(F.col("detected_flows").alias("flows")))
    votes = s.select("voter", *TURN, F.when(F.col("correct") & (F.col("confidence") >= 0.7), label).alias("label"))
    x = R.sft_examples(A.turns(spark, d), votes, lambda voter: F.concat(F.lit("flows of "), voter.cast("string")))
    dialogue = F.array_join(F.transform("messages", lambda m: F.concat_ws(": ", m["role"], m["content"])), "\n")
    return x.select("voter", *TURN, "label", dialogue.alias("dialogue"))


@query("U12_trajectory_cleaning", W("turns", "SELECT convo_id, sum(CASE WHEN turn_num % 3 = 0 THEN 0 ELSE length(utterance) END)::BIGINT AS chars FROM turns GROUP BY convo_id"))
def u12(spark, d):
    m = A.turns(spark, d).groupBy("convo_id").agg(F.collect_list(F.struct("speaker", F.when(F.col("turn_num") % 3 != 0, F.col("utterance")).alias("content"))).alias("messages"))
    clean = F.transform("messages", lambda x: x.withField("content", F.coalesce(x["content"], F.lit(""))))
    return m.select("convo_id", F.aggregate(clean, F.lit(0).cast("long"), lambda a, x: a + F.length(x["content"])).alias("chars"))


@query("U14_backfill", W("turns", f", {CONVOS}, k AS (SELECT category, convo_id FROM cv WHERE convo_id % 5 <> 2), t AS (SELECT category, count(*) AS n FROM cv GROUP BY category), h AS (SELECT category, count(*) AS have FROM k GROUP BY category), x AS (SELECT category, convo_id, row_number() OVER (PARTITION BY category ORDER BY convo_id) AS r FROM (SELECT category, convo_id + 1000000 AS convo_id FROM cv)) SELECT category, convo_id, 'survivor' AS origin FROM k UNION ALL SELECT category, convo_id, 'backfill' FROM x JOIN t USING (category) LEFT JOIN h USING (category) WHERE r <= n - coalesce(have, 0)"))
def u14(spark, d):
    """Each category gets back the count that it had before dedup, from newly generated rows."""
    c = convos(spark, d).select("category", "convo_id")
    new = c.withColumn("convo_id", F.col("convo_id") + 1_000_000)
    return M.backfilled(c.where("convo_id % 5 <> 2"), new, c.groupBy("category").agg(F.count(F.lit(1)).alias("n")), "category", "convo_id")


@query("U15_backfill_column", W("turns", "SELECT convo_id, turn_num, 'tool' || ((row_number() OVER (PARTITION BY flow ORDER BY convo_id, turn_num) - 1) % 4) AS tool FROM gold"))
def u15(spark, d):
    return O.cursor(A.gold(spark, d), "flow", [F.col("convo_id"), F.col("turn_num")], F.lit(1), 4).select(*TURN, F.concat(F.lit("tool"), F.col("cursor").cast("string")).alias("tool"))


ANSWER = "CASE WHEN convo_id % 11 = 0 THEN '  LEAKED:  names ' || flow || ' ' WHEN convo_id % 11 = 1 THEN 'not sure' WHEN convo_id % 11 = 2 THEN 'leaked: x' ELSE 'CLEAN' END"


@query("U16_leakage_gate", W("turns", f", a AS (SELECT convo_id, turn_num, utterance, flow, trim({ANSWER}) AS answer FROM gold), r AS (SELECT *, CASE WHEN starts_with(answer, 'LEAKED:') THEN 'leakage: ' || trim(substr(answer, 8)) END AS judged, regexp_matches(utterance, '(?i)\\b' || flow || '\\b') AS named FROM a) SELECT convo_id, turn_num, judged IS NULL AND NOT named AS passed, concat_ws('; ', judged, CASE WHEN named THEN 'name: ' || flow END) AS reasons FROM r"))
def u16(spark, d):
    """The judge's answers come as text; only LEAKED: rejects, and the label's own name in the text does too."""
    g = A.gold(spark, d).select(*TURN, "utterance", "flow", F.expr(ANSWER.replace("' || flow || '", "', flow, '").replace("THEN '  LEAKED", "THEN concat('  LEAKED").replace(", ' ' WHEN", ", ' ') WHEN")).alias("answer"))
    judged = T.leak_reason(F.col("answer"))
    named = F.expr(r"utterance RLIKE concat('(?i)\\b', flow, '\\b')")
    reasons = F.concat_ws("; ", judged, F.when(named, F.concat(F.lit("name: "), "flow")))
    return g.select(*TURN, (judged.isNull() & ~named).alias("passed"), reasons.alias("reasons"))


# -- set operations ---------------------------------------------------------


@query("SET_operations", W("turns", ", a AS (SELECT DISTINCT flow FROM gold WHERE domain = 'd0'), b AS (SELECT DISTINCT flow FROM gold WHERE domain = 'd1' AND k < 8) SELECT 'union' AS op, flow FROM (SELECT * FROM a UNION SELECT * FROM b) UNION ALL SELECT 'intersect', flow FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'except', flow FROM (SELECT * FROM a EXCEPT SELECT * FROM b)"))
def set_operations(spark, d):
    g = A.gold(spark, d)
    a, b = g.where("domain = 'd0'").select("flow").distinct(), g.where("domain = 'd1' AND k < 8").select("flow").distinct()
    tag = lambda df, n: df.select(F.lit(n).alias("op"), "flow")
    return tag(a.union(b).distinct(), "union").unionByName(tag(a.intersect(b), "intersect")).unionByName(tag(a.subtract(b), "except"))


# -- presentation and execution --------------------------------------------


@query("S17_report_injection", S("SELECT config_id, round(sum(correct::INT) / count(*), 6) AS accuracy FROM scored GROUP BY config_id"))
def s17(spark, d):
    """A small result goes into a page as ``const DATA = [...];`` and is read out of it again."""
    path = S_.scratch(spark, "page")
    r = R.accuracy_by(scored(spark, d), "config_id").select("config_id", "accuracy")
    S_.inject(r, "<html><script>const DATA = null;</script></html>").write.text(path)
    return S_.injected(spark, path, "config_id string, accuracy double")


@query("S18_markdown_report", S("SELECT config_id, round(sum(correct::INT) / count(*), 6) AS accuracy FROM scored GROUP BY config_id"))
def s18(spark, d):
    path = S_.scratch(spark, "report")
    r = R.accuracy_by(scored(spark, d), "config_id").select("config_id", "accuracy")
    S_.markdown_table(r).write.text(path)
    cells = F.split("value", r" \| ")
    rows = spark.read.text(path).where("NOT value RLIKE '^(config_id|---)'")
    return rows.select(cells[0].alias("config_id"), cells[1].cast("double").alias("accuracy"))


@query("U6_parallel_conversations", W("turns", "SELECT convo_id, count(*) AS n, max(length(utterance))::BIGINT AS longest FROM turns GROUP BY convo_id"))
def u6(spark, d):
    """One task slot a partition instead of one thread a conversation; Spark chooses how many."""
    t = A.turns(spark, d)
    return t.groupBy("convo_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.length("utterance")).cast("long").alias("longest"))


@query("U9_injected_evaluator", "SELECT event_id, event_id % 3 <> 0 OR length(event_type) > 4 AS match FROM events")
def u9(spark, d):
    """An evaluator in Python, in Arrow batches, is asked about the rows that normalised equality leaves open, and about no others."""
    @F.pandas_udf("boolean")
    def judge(want: pd.Series) -> pd.Series:
        return want.str.len() > 4

    e = A.table(spark, d, "events").select("event_id", "event_type", F.when(F.col("event_id") % 3 == 0, F.concat("event_type", F.lit("~"))).otherwise(F.upper("event_type")).alias("got"))
    same = V.normalised(F.col("event_type")) == V.normalised(F.col("got"))
    return e.where(same).select("event_id", F.lit(True).alias("match")).unionByName(e.where(~same).select("event_id", judge("event_type").alias("match")))
