"""Queries of the projections, joins and aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from turnwise.operators import relational as R
from turnwise.plans import adapters as A
from turnwise.plans.adapters import with_views as W
from turnwise.plans.registry import query

CLEAR = "(size(detected_flows) = 1 AND detected_flows[0] = flow)"
#: One scored row per gold turn and voter.
SCORED_SQL = """, aligned AS (SELECT g.*, v.voter, coalesce(p.detected_flows, []::VARCHAR[]) AS detected_flows, p.latency_ms, p.input_tokens, p.output_tokens
  FROM gold g CROSS JOIN (SELECT unnest(range(5))::INTEGER AS voter) v LEFT JOIN preds p USING (voter, convo_id, turn_num)),
scored AS (SELECT *, 'c' || (voter % 3) AS config_id, (voter // 3 + 1)::INTEGER AS seed, len(detected_flows) = 1 AND coalesce(detected_flows[1] = flow, false) AS correct, detected_flows[1] AS detected FROM aligned) """


def voters(spark):
    return spark.range(5).selectExpr("CAST(id AS INT) AS voter")


def scored(spark, d):
    p = A.preds(spark, d)
    out = R.align(A.gold(spark, d), p, voters(spark)).join(p.select("voter", "convo_id", "turn_num", "latency_ms", "input_tokens", "output_tokens"), ["voter", "convo_id", "turn_num"], "left")
    return out.selectExpr("*", "concat('c', voter % 3) AS config_id", "CAST(voter div 3 + 1 AS INT) AS seed", f"{CLEAR} AS correct", "get(detected_flows, 0) AS detected")


def S(body: str) -> str:
    return W("preds", SCORED_SQL + body)


@query("P1_flatten_user_turns", W("turns", "SELECT convo_id, turn_num, category, utterance, flow, 'human' AS model FROM gold"))
def p1(spark, d):
    return R.flatten(R.nest(A.turns(spark, d)), "user").select("convo_id", "turn_num", "category", "utterance", "flow", "model")


@query("P2_flatten_agent_turns", W("turns", "SELECT convo_id, turn_num, utterance FROM turns WHERE speaker = 'agent'"))
def p2(spark, d):
    return R.flatten(R.nest(A.turns(spark, d)), "agent").select("convo_id", "turn_num", "utterance")


@query("P3_flatten_with_category", W("turns", "SELECT category, speaker, count(*) AS n FROM turns GROUP BY ALL"))
def p3(spark, d):
    return R.flatten(R.nest(A.turns(spark, d))).groupBy("category", "speaker").agg(F.count(F.lit(1)).alias("n"))


@query("P4_gold_lookup", W("turns", "SELECT convo_id, turn_num, flow, array_to_string(candidate_flows, ',') AS candidates, category, domain FROM gold"))
def p4(spark, d):
    return A.gold(spark, d).select("convo_id", "turn_num", "flow", F.array_join("candidate_flows", ",").alias("candidates"), "category", "domain")


@query("P5_drop_excluded", W("turns", "SELECT convo_id, turn_num FROM gold WHERE NOT coalesce(exclude, false)"))
def p5(spark, d):
    return A.gold(spark, d).where("NOT coalesce(exclude, false)").select("convo_id", "turn_num")


@query("P6_user_facing_flows", W("flows", "SELECT name, intent FROM flows WHERE intent NOT IN ('Plan', 'Internal')"))
def p6(spark, d):
    return R.user_facing(A.flows(spark)).select("name", "intent")


@query("P7_candidate_set", W("flows", "SELECT name FROM flows WHERE intent <> 'Internal' AND (intent = 'i1' OR name IN (SELECT unnest(edge_flows) FROM flows WHERE intent = 'i1'))"))
def p7(spark, d):
    return R.candidate_set(A.flows(spark), spark.createDataFrame([("i1",)], "intent string"))


@query("P8_tools_of_flow", W("tools", "SELECT name FROM tools WHERE NOT internal_component AND list_contains(_flows, 'f2')"))
def p8(spark, d):
    return R.tools_of_flow(A.tools(spark), "f2").select("name")


@query("P9_strip_metadata", "SELECT conv_id AS convo_id, count(*) AS n_turns FROM conversations GROUP BY conv_id")
def p9(spark, d):
    rows = A.table(spark, d, "conversations").groupBy(F.col("conv_id").alias("convo_id")).agg(F.count(F.lit(1)).alias("n_turns"))
    rows = rows.withColumns({"_flows": F.lit("x"), "internal_component": F.lit(True)})
    return rows.drop(*[c for c in rows.columns if c.startswith("_") or c == "internal_component"])


@query("P10_intent_scope", W("turns", "SELECT convo_id, turn_num, CASE WHEN len(candidate_flows) > 0 THEN array_to_string(list_sort(list_distinct(list_transform(candidate_flows, lambda f: 'i' || (substr(f, 2)::INTEGER // 3)))), ',') ELSE intent END AS intents FROM gold"))
def p10(spark, d):
    cand = F.array_distinct(F.transform("candidate_flows", lambda f: F.concat(F.lit("i"), F.floor(F.substring(f, 2, 9).cast("int") / 3).cast("string"))))
    scope = F.when(F.size("candidate_flows") > 0, cand).otherwise(F.array("intent"))
    return A.gold(spark, d).select("convo_id", "turn_num", F.array_join(F.array_sort(scope), ",").alias("intents"))


@query("P11_skip_kind", W("tool_turns", "SELECT CASE WHEN len(candidate_flows) > 0 THEN 'ambiguous' WHEN len(gold_tools) = 0 THEN 'zero_tool' WHEN len(gold_tools) = 1 THEN 'single_tool' ELSE 'call' END AS kind, count(*) AS n FROM tool_turns GROUP BY ALL"))
def p11(spark, d):
    kind = R.skip_kind(F.size("candidate_flows") > 0, F.size("gold_tools"))
    return A.tool_turns(spark, d).groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("P12_trivial_result", W("tool_turns", "SELECT convo_id, turn_num, len(gold_tools) = 0 OR list_contains(gold_tools, 't1') AS correct FROM tool_turns WHERE voter = 0 AND len(gold_tools) <= 1"))
def p12(spark, d):
    t = A.tool_turns(spark, d).where("voter = 0 AND size(gold_tools) <= 1")
    return t.select("convo_id", "turn_num", F.when(F.size("gold_tools") == 0, True).otherwise(F.array_contains("gold_tools", "t1")).alias("correct"))


@query("P13_sparse_patch", W("turns", "SELECT convo_id, turn_num, CASE WHEN (convo_id + turn_num) % 6 = 0 THEN 'fixed' ELSE flow END AS flow, intent FROM gold"))
def p13(spark, d):
    g = A.gold(spark, d)
    fixes = g.where("(convo_id + turn_num) % 6 = 0").select("convo_id", "turn_num", F.lit("fixed").alias("flow"), F.lit(None).cast("string").alias("intent"))
    return R.patch(g, fixes, ["convo_id", "turn_num"], ["flow", "intent"]).select("convo_id", "turn_num", "flow", "intent")


@query("P14_label_join", W("turns", "SELECT g.convo_id, g.turn_num, 't' || (g.k % 3) AS target, FALSE AS missing FROM gold g WHERE category = 'same_flow' AND convo_id % 8 = 0 UNION ALL SELECT g.convo_id, g.turn_num, NULL, TRUE FROM gold g WHERE category = 'same_flow' AND convo_id % 8 <> 0"))
def p14(spark, d):
    g = A.gold(spark, d).where("category = 'same_flow'")
    labels = A.gold(spark, d).where("convo_id % 8 = 0").select("convo_id", "turn_num", F.concat(F.lit("t"), F.col("k") % 3).alias("target"))
    return g.join(labels, ["convo_id", "turn_num"], "left").select("convo_id", "turn_num", "target", F.col("target").isNull().alias("missing"))


@query("P15_label_template", W("turns", "SELECT convo_id, first(utterance ORDER BY turn_num) AS opening, count(*) AS n FROM gold GROUP BY convo_id"))
def p15(spark, d):
    n = R.nest(A.gold(spark, d))
    built = n.select("convo_id", F.struct(F.col("turns")[0]["utterance"].alias("opening"), F.size("turns").cast("long").alias("n")).alias("c"))
    return built.select("convo_id", "c.opening", "c.n")


@query("P16_config_selection", W("configs", "SELECT config_id, model FROM configs WHERE rate_in IS NOT NULL AND rate_in < 2"))
def p16(spark, d):
    return A.configs(spark).where("rate_in < 2").select("config_id", "model")


@query("P17_seed_range", "SELECT s, unnest(CASE s WHEN '1-5' THEN [1,2,3,4,5] WHEN '1,3,5' THEN [1,3,5] ELSE [1] END)::INTEGER AS seed FROM (VALUES ('1'), ('1-5'), ('1,3,5')) v(s)")
def p17(spark, d):
    v = spark.createDataFrame([("1",), ("1-5",), ("1,3,5",)], "s string")
    ends = F.transform(F.split("s", "-"), lambda x: x.try_cast("int"))
    listed = F.transform(F.split("s", ","), lambda x: x.try_cast("int"))
    return v.select("s", F.explode(F.when(F.contains("s", F.lit("-")), F.sequence(F.element_at(ends, 1), F.element_at(ends, -1))).otherwise(listed)).alias("seed"))


@query("P18_renumber", W("turns", "SELECT convo_id, domain || '_' || printf('%03d', row_number() OVER (PARTITION BY domain ORDER BY convo_id)) AS new_id FROM (SELECT DISTINCT convo_id, domain FROM turns)"))
def p18(spark, d):
    return R.renumber(A.turns(spark, d).select("convo_id", "domain").distinct(), "convo_id", F.col("domain"), F.floor(F.col("convo_id") / 1000)).select("convo_id", "new_id")


@query("P19_answer_set", W("preds", "SELECT array_to_string(list_sort(list_distinct(detected_flows)), '|') AS answer, count(*) AS n FROM preds GROUP BY ALL"))
def p19(spark, d):
    return A.preds(spark, d).groupBy(R.answer_key(F.col("detected_flows")).alias("answer")).agg(F.count(F.lit(1)).alias("n"))


@query("P20_history", W("turns", "SELECT convo_id, turn_num, coalesce(string_agg(speaker || ': ' || utterance, chr(10)) OVER (PARTITION BY convo_id ORDER BY turn_num ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS history FROM turns"))
def p20(spark, d):
    return R.history(A.turns(spark, d)).select("convo_id", "turn_num", F.array_join("history", "\n").alias("history"))


@query("P21_flows_by_intent", W("flows", "SELECT intent, string_agg(name, ',' ORDER BY name) AS names FROM flows GROUP BY intent"))
def p21(spark, d):
    return A.flows(spark).groupBy("intent").agg(F.array_join(F.array_sort(F.collect_list("name")), ",").alias("names"))


@query("P22_flow_descriptor", W("flows", "SELECT name, intent, dax, array_to_string(edge_flows, ',') AS edges FROM flows"))
def p22(spark, d):
    return A.flows(spark).select("name", "intent", "dax", F.array_join("edge_flows", ",").alias("edges"))


@query("P23_flow_tool_index", W("tools", "SELECT flow, string_agg(name, ',' ORDER BY name) AS tools, count(*) AS n_tools FROM (SELECT name, unnest(_flows) AS flow FROM tools WHERE NOT internal_component) GROUP BY flow"))
def p23(spark, d):
    return R.flow_tool_index(A.tools(spark))


@query("P24_tool_flow_map", W("tools", "SELECT name, unnest(_flows) AS flow FROM tools"))
def p24(spark, d):
    return A.tools(spark).select("name", F.explode("_flows").alias("flow"))


@query("P25_non_blank_utterances", W("turns", "SELECT speaker, count(*) AS n, sum(length(utterance))::BIGINT AS chars FROM turns WHERE trim(utterance) <> '' GROUP BY speaker"))
def p25(spark, d):
    return A.turns(spark, d).where("trim(utterance) <> ''").groupBy("speaker").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("utterance")).alias("chars"))


@query("P26_gold_label", W("turns", "SELECT convo_id, turn_num, CASE WHEN len(candidate_flows) > 0 THEN '{\"flows\":[\"' || array_to_string(candidate_flows, '\",\"') || '\"]}' ELSE '{\"flows\":[\"' || flow || '\"]}' END AS label FROM gold"))
def p26(spark, d):
    flows = F.when(F.size("candidate_flows") > 0, F.col("candidate_flows")).otherwise(F.array("flow"))
    return A.gold(spark, d).select("convo_id", "turn_num", F.to_json(F.struct(flows.alias("flows"))).alias("label"))


@query("P27_ensemble_label", W("preds", "SELECT convo_id, turn_num, '{\"flows\":[' || coalesce('\"' || nullif(array_to_string(detected_flows, '\",\"'), '') || '\"', '') || ']}' AS label FROM preds WHERE voter = 1"))
def p27(spark, d):
    return A.preds(spark, d).where("voter = 1").select("convo_id", "turn_num", F.to_json(F.struct(F.col("detected_flows").alias("flows"))).alias("label"))


@query("P28_manifest_compaction", W("tools", "SELECT name, string_agg(f || '*', ' ' ORDER BY f) AS rendered FROM (SELECT name, substr(unnest(_flows), 1, 80) AS f FROM tools) GROUP BY name"))
def p28(spark, d):
    rendered = F.array_join(F.transform(F.array_sort("_flows"), lambda x: F.concat(F.substring(x, 1, 80), F.lit("*"))), " ")
    return A.tools(spark).select("name", rendered.alias("rendered"))


@query("P29_slot_schema_lookup", W("turns flows", "SELECT g.convo_id, g.turn_num, coalesce(f.dax, '{}') AS slots FROM gold g LEFT JOIN (SELECT * FROM flows WHERE intent <> 'Internal') f ON g.flow = f.name"))
def p29(spark, d):
    f = A.flows(spark).where("intent <> 'Internal'").select(F.col("name").alias("flow"), "dax")
    return A.gold(spark, d).join(F.broadcast(f), "flow", "left").select("convo_id", "turn_num", F.coalesce("dax", F.lit("{}")).alias("slots"))  # an ontology


@query("P30_row_key", W("turns", "SELECT convo_id || '_t' || turn_num AS query_key FROM gold"))
def p30(spark, d):
    return A.gold(spark, d).select(F.concat_ws("_t", "convo_id", "turn_num").alias("query_key"))


@query("P31_voter_count", "SELECT s, coalesce(nullif(regexp_extract(s, '^(\\d+)v', 1), '')::INTEGER, 0) AS n FROM (VALUES ('3v-1'), ('10v-2'), ('v-3'), ('single')) t(s)")
def p31(spark, d):
    v = spark.createDataFrame([("3v-1",), ("10v-2",), ("v-3",), ("single",)], "s string")
    return v.select("s", F.coalesce(F.regexp_extract("s", r"^(\d+)v", 1).try_cast("int"), F.lit(0)).alias("n"))


@query("P32_batch_scores", W("preds", "SELECT g.convo_id, g.turn_num, coalesce(p.latency_ms, f.latency_ms, -1) AS latency_ms FROM gold g LEFT JOIN (SELECT * FROM preds WHERE voter = 0) p USING (convo_id, turn_num) LEFT JOIN (SELECT * FROM preds WHERE voter = 1) f USING (convo_id, turn_num)"))
def p32(spark, d):
    p = A.preds(spark, d)
    own = p.where("voter = 0").select("convo_id", "turn_num", F.col("latency_ms").alias("own"))
    other = p.where("voter = 1").select("convo_id", "turn_num", F.col("latency_ms").alias("other"))
    g = A.gold(spark, d).select("convo_id", "turn_num")
    return g.join(own, ["convo_id", "turn_num"], "left").join(other, ["convo_id", "turn_num"], "left").select("convo_id", "turn_num", F.coalesce("own", "other", F.lit(-1)).alias("latency_ms"))


@query("P33_report_row", W("configs", "SELECT config_id, coalesce(model, config_id) || ' (' || provider || ')' AS label FROM configs"))
def p33(spark, d):
    return A.configs(spark).select("config_id", F.concat(F.coalesce("model", "config_id"), F.lit(" ("), F.col("provider"), F.lit(")")).alias("label"))


# -- joins ------------------------------------------------------------------


@query("J1_gold_left_preds", S("SELECT voter, convo_id, turn_num, array_to_string(detected_flows, ',') AS detected, correct FROM scored"))
def j1(spark, d):
    return scored(spark, d).select("voter", "convo_id", "turn_num", F.array_join("detected_flows", ",").alias("detected"), "correct")


@query("J2_voter_alignment", S("SELECT convo_id, turn_num, string_agg(array_to_string(detected_flows, '+'), '/' ORDER BY voter) AS votes FROM scored GROUP BY ALL"))
def j2(spark, d):
    v = F.array_sort(F.collect_list(F.struct("voter", F.array_join("detected_flows", "+").alias("x"))))
    return scored(spark, d).groupBy("convo_id", "turn_num").agg(F.array_join(F.transform(v, lambda s: s["x"]), "/").alias("votes"))


@query("J3_config_dimension", W("preds configs", "SELECT p.config_id, model, count(*) AS n FROM preds p JOIN configs c USING (config_id) GROUP BY ALL"))
def j3(spark, d):
    return A.preds(spark, d).join(F.broadcast(A.configs(spark)), "config_id").groupBy("config_id", "model").agg(F.count(F.lit(1)).alias("n"))  # a config list


@query("J4_flow_intent_default", W("preds flows", "SELECT coalesce(f.intent, 'Unknown') AS intent, count(*) AS n FROM preds p LEFT JOIN (SELECT * FROM flows WHERE intent <> 'Plan') f ON f.name = p.detected_flows[1] GROUP BY ALL"))
def j4(spark, d):
    f = A.flows(spark).where("intent <> 'Plan'").select(F.col("name").alias("detected"), "intent")
    p = A.preds(spark, d).select(F.get("detected_flows", F.lit(0)).alias("detected"))
    return p.join(F.broadcast(f), "detected", "left").groupBy(F.coalesce("intent", F.lit("Unknown")).alias("intent")).agg(F.count(F.lit(1)).alias("n"))


@query("J5_overlap", W("preds", "SELECT convo_id FROM preds WHERE voter = 0 AND latency_ms < 1500 INTERSECT SELECT convo_id FROM preds WHERE voter = 1 AND latency_ms < 1500 INTERSECT SELECT convo_id FROM preds WHERE voter = 2 AND latency_ms < 1500"))
def j5(spark, d):
    p = A.preds(spark, d).where("latency_ms < 1500")
    of = lambda v: p.where(F.col("voter") == v).select("convo_id")
    return of(0).intersect(of(1)).intersect(of(2))


@query("J6_head_to_head", S("SELECT a.category, count(*) FILTER (a.correct AND b.correct) AS both, count(*) FILTER (a.correct AND NOT b.correct) AS only_a, count(*) FILTER (NOT a.correct AND b.correct) AS only_b, count(*) FILTER (NOT a.correct AND NOT b.correct) AS neither FROM scored a JOIN scored b USING (convo_id, turn_num) WHERE a.voter = 0 AND b.voter = 1 GROUP BY ALL"))
def j6(spark, d):
    # one pass: the two voters' answers come together by key, not by position
    s = scored(spark, d).where("voter IN (0, 1)").groupBy("convo_id", "turn_num", "category").agg(F.max(F.expr("voter = 0 AND correct")).alias("a"), F.max(F.expr("voter = 1 AND correct")).alias("b"))
    return s.groupBy("category").agg(F.expr("count_if(a AND b)").alias("both"), F.expr("count_if(a AND NOT b)").alias("only_a"), F.expr("count_if(b AND NOT a)").alias("only_b"), F.expr("count_if(NOT a AND NOT b)").alias("neither"))


@query("J8_edge_self_join", W("flows", "SELECT DISTINCT least(a, b) AS flow_a, greatest(a, b) AS flow_b FROM (SELECT name AS a, unnest(edge_flows) AS b FROM flows WHERE intent NOT IN ('Plan', 'Internal')) JOIN flows f ON f.name = b AND f.intent NOT IN ('Plan', 'Internal') WHERE a <> b"))
def j8(spark, d):
    return R.edge_pairs(A.flows(spark))


@query("J9_adjacent_edges", W("turns flows", ", n AS (SELECT convo_id, turn_num, flow, lead(flow) OVER (PARTITION BY convo_id ORDER BY turn_num) AS nxt FROM gold) SELECT convo_id, turn_num, flow, nxt FROM n JOIN flows f ON f.name = n.flow AND list_contains(f.edge_flows, nxt)"))
def j9(spark, d):
    w = Window.partitionBy("convo_id").orderBy("turn_num")
    n = A.gold(spark, d).select("convo_id", "turn_num", "flow", F.lead("flow").over(w).alias("nxt"))
    e = A.flows(spark).select(F.col("name").alias("flow"), F.explode("edge_flows").alias("nxt"))
    return n.join(F.broadcast(e), ["flow", "nxt"], "left_semi").select("convo_id", "turn_num", "flow", "nxt")


@query("J10_resume_anti_join", W("preds", "SELECT DISTINCT convo_id FROM gold WHERE convo_id NOT IN (SELECT convo_id FROM preds WHERE voter = 0 AND latency_ms < 900)"))
def j10(spark, d):
    done = A.preds(spark, d).where("voter = 0 AND latency_ms < 900").select("convo_id")
    return A.gold(spark, d).select("convo_id").distinct().join(done, "convo_id", "left_anti")


@query("J11_set_difference", W("corpora", ", t AS (SELECT DISTINCT source, unnest(tools) || flow AS tool FROM corpora) SELECT 'eval_only' AS side, tool FROM t WHERE source = 'eval' AND tool NOT IN (SELECT tool FROM t WHERE source = 'synth') UNION ALL SELECT 'synth_only', tool FROM t WHERE source = 'synth' AND tool NOT IN (SELECT tool FROM t WHERE source = 'eval')"))
def j11(spark, d):
    t = A.corpora(spark, d).select("source", "flow", F.explode("tools").alias("t")).select("source", F.concat("t", "flow").alias("tool")).distinct()
    by = t.groupBy("tool").agg(F.count(F.lit(1)).alias("n"), F.first("source").alias("s")).where("n = 1")  # both differences in one pass
    return by.select(F.concat("s", F.lit("_only")).alias("side"), "tool")


@query("J12_model_comparison", W("preds configs", ", a AS (SELECT config_id, avg(latency_ms) AS x FROM preds WHERE seed = 1 GROUP BY ALL), b AS (SELECT config_id, avg(latency_ms) AS y FROM preds WHERE seed = 2 GROUP BY ALL) SELECT c.config_id, CASE provider WHEN 'gemma' THEN 'google' ELSE provider END AS provider, round(x, 4) AS first_ms, round(y, 4) AS second_ms FROM configs c LEFT JOIN a USING (config_id) LEFT JOIN b USING (config_id)"))
def j12(spark, d):
    by = A.preds(spark, d).groupBy("config_id").agg(*[F.round(F.sum(F.when(F.col("seed") == s, F.col("latency_ms"))) / F.count(F.when(F.col("seed") == s, 1)), 4).alias(n) for s, n in ((1, "first_ms"), (2, "second_ms"))])
    return A.configs(spark).join(by, "config_id", "left").select("config_id", F.when(F.col("provider") == "gemma", "google").otherwise(F.col("provider")).alias("provider"), "first_ms", "second_ms")


@query("J13_hero_join", S(", a AS (SELECT config_id, sum(correct::INT) / count(*) AS x FROM scored WHERE seed = 1 GROUP BY ALL), b AS (SELECT config_id, sum(correct::INT) / count(*) AS y FROM scored WHERE seed = 2 GROUP BY ALL) SELECT config_id, round(x, 6) AS flat, round(y, 6) AS pipeline, round(y - x, 6) AS delta, round((y - x) / nullif(x, 0), 6) AS gain FROM a LEFT JOIN b USING (config_id)"))
def j13(spark, d):
    of = lambda s, n: scored(spark, d).where(F.col("seed") == s).groupBy("config_id").agg((F.sum(F.col("correct").cast("int")) / F.count(F.lit(1))).alias(n))
    j = of(1, "x").join(of(2, "y"), "config_id", "left")
    return j.select("config_id", F.round("x", 6).alias("flat"), F.round("y", 6).alias("pipeline"), F.round(F.col("y") - F.col("x"), 6).alias("delta"), F.round((F.col("y") - F.col("x")) / F.nullif("x", F.lit(0)), 6).alias("gain"))


@query("J14_ablation_delta", S(", r AS (SELECT config_id, category, seed, sum(correct::INT) / count(*) AS x FROM scored GROUP BY ALL) SELECT a.config_id, a.category, round(b.x - a.x, 6) AS delta FROM r a JOIN r b USING (config_id, category) WHERE a.seed = 1 AND b.seed = 2"))
def j14(spark, d):
    r = scored(spark, d).groupBy("config_id", "category").pivot("seed", [1, 2]).agg(F.sum(F.col("correct").cast("int")) / F.count(F.lit(1)))
    return r.where("`1` IS NOT NULL AND `2` IS NOT NULL").select("config_id", "category", F.round(F.col("2") - F.col("1"), 6).alias("delta"))


@query("J15_distillation_join", W("preds", ", e AS (SELECT DISTINCT convo_id FROM preds WHERE voter = 0) SELECT g.convo_id, g.turn_num, p.latency_ms FROM gold g JOIN e USING (convo_id) LEFT JOIN (SELECT * FROM preds WHERE voter = 0) p USING (convo_id, turn_num)"))
def j15(spark, d):
    p = A.preds(spark, d).where("voter = 0")
    g = A.gold(spark, d).select("convo_id", "turn_num").join(p.select("convo_id"), "convo_id", "left_semi")
    return g.join(p.select("convo_id", "turn_num", "latency_ms"), ["convo_id", "turn_num"], "left")


@query("J16_manifest_index", W("tool_turns tools", ", m AS (SELECT name, unnest(_flows) AS f FROM tools) SELECT t.convo_id, t.turn_num, t.tool, m.f IS NOT NULL AS known FROM (SELECT convo_id, turn_num, flow, unnest(gold_tools) AS tool FROM tool_turns WHERE voter = 0) t LEFT JOIN m ON m.name = t.tool AND m.f = t.flow"))
def j16(spark, d):
    m = A.tools(spark).select(F.col("name").alias("tool"), F.explode("_flows").alias("flow"), F.lit(True).alias("k"))
    t = A.tool_turns(spark, d).where("voter = 0").select("convo_id", "turn_num", "flow", F.explode("gold_tools").alias("tool"))
    return t.join(F.broadcast(m), ["tool", "flow"], "left").select("convo_id", "turn_num", "tool", F.coalesce("k", F.lit(False)).alias("known"))


@query("J17_three_way", S("SELECT a.convo_id, a.turn_num, CASE WHEN NOT a.correct AND NOT b.correct AND c.correct THEN 'only_third' WHEN a.detected_flows = b.detected_flows AND b.detected_flows = c.detected_flows THEN 'AGREE' ELSE 'DIFFER' END AS kind FROM scored a JOIN scored b USING (convo_id, turn_num) JOIN scored c USING (convo_id, turn_num) WHERE a.voter = 0 AND b.voter = 1 AND c.voter = 2 AND NOT a.correct AND NOT b.correct"))
def j17(spark, d):
    s = scored(spark, d).where("voter < 3").groupBy("convo_id", "turn_num").agg(F.array_sort(F.collect_list(F.struct("voter", "correct", "detected_flows"))).alias("v"))
    v = lambda i, f: F.col("v")[i][f]
    kind = F.when(v(2, "correct"), "only_third").when((v(0, "detected_flows") == v(1, "detected_flows")) & (v(1, "detected_flows") == v(2, "detected_flows")), "AGREE").otherwise("DIFFER")
    return s.where(~v(0, "correct") & ~v(1, "correct")).select("convo_id", "turn_num", kind.alias("kind"))
