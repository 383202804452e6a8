"""Queries of the aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnwise.operators import relational as R
from turnwise.plans import adapters as A
from turnwise.plans.adapters import with_views as W
from turnwise.plans.registry import query
from turnwise.plans.relational_queries import S, scored

ACC = "round(sum(correct::INT) / count(*), 6) AS accuracy, count(*) AS n"


@query("A1_accuracy_top1", S("SELECT coalesce(round(sum(correct::INT) / nullif(count(*), 0), 6), 0.0) AS accuracy, count(*) AS n FROM scored"))
def a1(spark, d):
    return R.accuracy_by(scored(spark, d))


@query("A2_accuracy_per_intent", S(f"SELECT intent, {ACC} FROM scored GROUP BY intent"))
def a2(spark, d):
    return R.accuracy_by(scored(spark, d), "intent")


@query("A3_accuracy_per_category", S(f"SELECT voter, category, {ACC} FROM scored GROUP BY ALL"))
def a3(spark, d):
    return R.accuracy_by(scored(spark, d), "voter", "category")


@query("A4_accuracy_per_turn", S(f"SELECT turn_num, {ACC} FROM scored GROUP BY ALL"))
def a4(spark, d):
    return R.accuracy_by(scored(spark, d), "turn_num")


@query("A5_confusion_matrix", S("SELECT flow, " + ", ".join(f"count(*) FILTER (detected = 'f{i}') AS f{i}" for i in range(6)) + " FROM scored WHERE detected IN ('f0','f1','f2','f3','f4','f5') AND flow IN ('f0','f1','f2','f3','f4','f5') GROUP BY flow"))
def a5(spark, d):
    names = [f"f{i}" for i in range(6)]
    return R.confusion(scored(spark, d), names).groupBy("flow").pivot("detected", names).agg(F.sum("n")).na.fill(0)


@query("A6_near_miss_rate", S("SELECT round(count(*) FILTER (detected = 'f' || ((k + 1) % 12) OR detected = 'f' || ((k + 5) % 12)) / nullif(count(*), 0), 6) AS near_miss_rate, count(*) AS errors FROM scored WHERE NOT correct"))
def a6(spark, d):
    edges = A.flows(spark).select(F.col("name").alias("flow"), F.explode("edge_flows").alias("detected"), F.lit(1).alias("near"))
    e = scored(spark, d).where("NOT correct").join(F.broadcast(edges), ["flow", "detected"], "left")  # an ontology
    return e.agg(F.round(F.count("near") / F.count(F.lit(1)), 6).alias("near_miss_rate"), F.count(F.lit(1)).alias("errors"))


RUN = """round(sum(correct::INT) / count(*), 4) AS accuracy, floor(quantile_cont(latency_ms, 0.5) FILTER (latency_ms > 0))::BIGINT AS p50, floor(quantile_cont(latency_ms, 0.95) FILTER (latency_ms > 0))::BIGINT AS p95,
 sum(input_tokens)::BIGINT AS tokens_in, sum(output_tokens)::BIGINT AS tokens_out, round(count(*) FILTER (latency_ms IS NULL) / count(*), 4) AS failure_rate"""


def run_stats(rows, *keys):
    late = F.when(F.col("latency_ms") > 0, F.col("latency_ms"))
    return rows.groupBy(*keys).agg(
        F.round(F.sum(F.col("correct").cast("int")) / F.count(F.lit(1)), 4).alias("accuracy"),
        F.floor(F.percentile(late, 0.5)).alias("p50"), F.floor(F.percentile(late, 0.95)).alias("p95"),
        F.sum("input_tokens").alias("tokens_in"), F.sum("output_tokens").alias("tokens_out"),
        F.round(F.count_if(F.col("latency_ms").isNull()) / F.count(F.lit(1)), 4).alias("failure_rate"),
    )


@query("A7_run_summary", S(f"SELECT config_id, seed, {RUN}, round(sum(correct::INT) FILTER (category = 'same_flow') / count(*) FILTER (category = 'same_flow'), 4) AS same_flow FROM scored WHERE NOT exclude GROUP BY ALL"))
def a7(spark, d):
    rows = scored(spark, d).where("NOT exclude")
    cat = rows.groupBy("config_id", "seed").agg(F.round(F.sum(F.expr("IF(category = 'same_flow', CAST(correct AS INT), NULL)")) / F.count_if(F.col("category") == "same_flow"), 4).alias("same_flow"))
    return run_stats(rows, "config_id", "seed").join(cat, ["config_id", "seed"])


@query("A8_run_stats_report", S(f"SELECT config_id, seed, {RUN}, count(*) FILTER (detected <> flow) AS confused FROM scored GROUP BY ALL"))
def a8(spark, d):
    rows = scored(spark, d)
    more = rows.groupBy("config_id", "seed").agg(F.count_if(F.col("detected") != F.col("flow")).alias("confused"))
    return run_stats(rows, "config_id", "seed").join(more, ["config_id", "seed"])


@query("A9_tool_run_stats", W("tool_turns", "SELECT voter, count(*) AS n, count(*) FILTER (len(predicted_tools) = 0) AS null_calls, count(*) FILTER (exclude) AS excluded, count(*) FILTER (list_contains(predicted_tools, 'handle_ambiguity')) AS ambiguity_flagged, count(DISTINCT predicted_tools[1]) AS top_tools FROM tool_turns GROUP BY voter"))
def a9(spark, d):
    return A.tool_turns(spark, d).groupBy("voter").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.size("predicted_tools") == 0).alias("null_calls"), F.count_if("exclude").alias("excluded"),
        F.count_if(F.array_contains("predicted_tools", "handle_ambiguity")).alias("ambiguity_flagged"), F.count_distinct(F.get("predicted_tools", F.lit(0))).alias("top_tools"),
    )


INTENT_OF = "'i' || (substr(detected, 2)::INTEGER // 3)"


@query("A10_intent_run_stats", S(f"SELECT intent AS expected, {INTENT_OF} AS got, count(*) AS n FROM scored WHERE detected IS NOT NULL GROUP BY ALL"))
def a10(spark, d):
    got = F.concat(F.lit("i"), F.floor(F.substring("detected", 2, 9).cast("int") / 3).cast("string"))
    return scored(spark, d).where("detected IS NOT NULL").groupBy(F.col("intent").alias("expected"), got.alias("got")).agg(F.count(F.lit(1)).alias("n"))


@query("A11_minimal_run_stats", S("SELECT voter, round(sum(correct::INT) / count(*), 6) AS accuracy, sum(input_tokens)::BIGINT AS tokens_in, sum(output_tokens)::BIGINT AS tokens_out FROM scored GROUP BY voter"))
def a11(spark, d):
    return scored(spark, d).groupBy("voter").agg(R.rate(F.col("correct")).alias("accuracy"), F.sum("input_tokens").alias("tokens_in"), F.sum("output_tokens").alias("tokens_out"))


@query("A12_cross_seed", S(", r AS (SELECT config_id, domain, seed, sum(correct::INT) / count(*) AS a FROM scored GROUP BY ALL) SELECT config_id, domain, round(avg(a), 6) AS mean, round(coalesce(stddev_samp(a), 0), 6) AS std, count(*) AS seeds FROM r GROUP BY ALL"))
def a12(spark, d):
    r = scored(spark, d).groupBy("config_id", "domain", "seed").agg((F.sum(F.col("correct").cast("int")) / F.count(F.lit(1))).alias("a"))
    return r.groupBy("config_id", "domain").agg(F.round(F.avg("a"), 6).alias("mean"), F.round(F.coalesce(F.stddev_samp("a"), F.lit(0.0)), 6).alias("std"), F.count(F.lit(1)).alias("seeds"))


@query("A13_baseline_ranking", S(", r AS (SELECT config_id, seed, sum(correct::INT) / count(*) AS a FROM scored GROUP BY ALL) SELECT config_id, round(avg(a), 6) AS mean FROM r GROUP BY ALL ORDER BY mean DESC, config_id LIMIT 2"))
def a13(spark, d):
    r = scored(spark, d).groupBy("config_id", "seed").agg((F.sum(F.col("correct").cast("int")) / F.count(F.lit(1))).alias("a"))
    return r.groupBy("config_id").agg(F.round(F.avg("a"), 6).alias("mean")).orderBy(F.desc("mean"), "config_id").limit(2)


@query("A14_multi_key_counters", W("tool_turns", "SELECT flow, category, turn_num, count(*) FILTER (len(predicted_tools) = 0) AS nulls, count(*) AS n FROM tool_turns GROUP BY GROUPING SETS ((flow), (category), (turn_num))"))
def a14(spark, d):
    t = A.tool_turns(spark, d).select("flow", "category", "turn_num", "predicted_tools")
    sets = t.groupingSets([["flow"], ["category"], ["turn_num"]], "flow", "category", "turn_num")
    return sets.agg(F.count_if(F.size("predicted_tools") == 0).alias("nulls"), F.count(F.lit(1)).alias("n"))


@query("A15_two_key_breakdown", S(f"SELECT category, turn_num, {ACC} FROM scored GROUP BY ALL"))
def a15(spark, d):
    return R.accuracy_by(scored(spark, d), "category", "turn_num")


COVER = """, c AS (SELECT flow, len(predicted_tools) AS offered, len(list_intersect(gold_tools, predicted_tools)) > 0 AS correct, predicted_tools[1] AS tool FROM tool_turns),
m AS (SELECT flow, tool FROM (SELECT flow, tool, row_number() OVER (PARTITION BY flow ORDER BY count(*) DESC, tool) AS r FROM c WHERE tool IS NOT NULL GROUP BY flow, tool) WHERE r = 1)"""


@query("A16_coverage_per_flow", W("tool_turns", COVER + " SELECT c.flow, count(*) AS n, count(*) FILTER (correct) AS n_correct, count(*) FILTER (offered = 0) AS nulls, round(sum(offered) / count(*), 6) AS mean_offered, any_value(m.tool) AS modal_tool FROM c LEFT JOIN m USING (flow) GROUP BY c.flow"))
def a16(spark, d):
    t = A.tool_turns(spark, d).select("flow", "gold_tools", "predicted_tools", F.get("predicted_tools", F.lit(0)).alias("tool"))
    per = t.groupBy("flow", "tool").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.arrays_overlap("gold_tools", "predicted_tools")).alias("ok"), F.count_if(F.size("predicted_tools") == 0).alias("nulls"), F.sum(F.size("predicted_tools")).alias("offered"))
    modal = F.min_by("tool", F.when(F.col("tool").isNotNull(), F.struct(-F.col("n"), F.col("tool"))))  # most frequent, ties by name
    return per.groupBy("flow").agg(F.sum("n").alias("n"), F.sum("ok").alias("n_correct"), F.sum("nulls").alias("nulls"), F.round(F.sum("offered") / F.sum("n"), 6).alias("mean_offered"), modal.alias("modal_tool"))


@query("A17_distinct_key_counts", W("turns", "SELECT category, count(DISTINCT convo_id) AS n FROM turns GROUP BY category"))
def a17(spark, d):
    return A.turns(spark, d).select("convo_id", "category").distinct().groupBy("category").agg(F.count(F.lit(1)).alias("n"))


@query("A18_pipeline_composition", S(", r AS (SELECT domain, category, 0.95::DOUBLE * 0.9::DOUBLE * (sum(correct::INT) / count(*)) AS x, count(*) AS w FROM scored GROUP BY ALL), dd AS (SELECT domain, sum(x * w) / sum(w) AS a FROM r GROUP BY domain) SELECT round(avg(a), 6) AS composed FROM dd"))
def a18(spark, d):
    """Composed from stage accuracies under assumed independence; not a measurement of a pipeline."""
    r = scored(spark, d).groupBy("domain", "category").agg((F.lit(0.95) * F.lit(0.9) * F.sum(F.col("correct").cast("int")) / F.count(F.lit(1))).alias("x"), F.count(F.lit(1)).alias("w"))
    return r.groupBy("domain").agg((F.sum(F.col("x") * F.col("w")) / F.sum("w")).alias("a")).agg(F.round(F.avg("a"), 6).alias("composed"))


@query("A19_confusion_top_k", S(", c AS (SELECT flow, detected, config_id, count(*) AS n FROM scored WHERE detected <> flow GROUP BY ALL), t AS (SELECT flow, detected, sum(n)::BIGINT AS n, (list(config_id ORDER BY n DESC, config_id))[1:3] AS models FROM c GROUP BY ALL) SELECT flow, detected, n, array_to_string(models, ', ') AS models FROM t ORDER BY n DESC, flow, detected LIMIT 15"))
def a19(spark, d):
    c = scored(spark, d).where("detected <> flow").groupBy("flow", "detected", "config_id").agg(F.count(F.lit(1)).alias("n"))
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "config_id")))  # at most one entry a config
    t = c.groupBy("flow", "detected").agg(F.sum("n").alias("n"), F.array_join(F.slice(F.transform(ranked, lambda x: x["config_id"]), 1, 3), ", ").alias("models"))
    return t.orderBy(F.desc("n"), "flow", "detected").limit(15)


@query("A20_progress_matrix", W("preds", ", e AS (SELECT count(*) AS n FROM gold), c AS (SELECT config_id, seed, count(*) AS n FROM preds GROUP BY ALL) SELECT config_id, " + ", ".join(f"coalesce(max(CASE WHEN seed = {s} THEN c.n || '/' || e.n || ' (' || (100 * c.n // e.n) || '%)' END), '0/' || any_value(e.n) || ' (0%)') AS seed{s}" for s in (1, 2)) + " FROM c, e GROUP BY config_id"))
def a20(spark, d):
    expected = A.gold(spark, d).agg(F.count(F.lit(1)).alias("e"))
    c = A.preds(spark, d).groupBy("config_id").pivot("seed", [1, 2]).agg(F.count(F.lit(1))).na.fill(0).crossJoin(F.broadcast(expected))  # one row
    cell = lambda s: F.format_string("%d/%d (%d%%)", F.col(str(s)), F.col("e"), F.floor(100 * F.col(str(s)) / F.col("e"))).alias(f"seed{s}")
    return c.select("config_id", cell(1), cell(2))


@query("A21_cost_estimate", W("preds configs", ", t AS (SELECT config_id, sum(input_tokens) AS i, sum(output_tokens) AS o FROM preds GROUP BY ALL) SELECT config_id, round((i * coalesce(rate_in, 1) + o * coalesce(rate_out, 1)) / 1e6, 6) AS cost FROM t LEFT JOIN configs USING (config_id)"))
def a21(spark, d):
    t = A.preds(spark, d).groupBy("config_id").agg(F.sum("input_tokens").alias("tokens_in"), F.sum("output_tokens").alias("tokens_out"))
    return R.cost(t, A.configs(spark)).select("config_id", F.round("cost", 6).alias("cost"))


@query("A22_ensemble_cost", "WITH e(ensemble_id, composition, n) AS (VALUES ('e1', ['c0', 'c1'], 2), ('e2', ['c0'], 3), ('e3', ['c0', 'c9', 'cx'], 3)), p(c, r) AS (VALUES ('c0', 0.5::DOUBLE), ('c1', 1.5), ('c9', 3)) SELECT ensemble_id, round(CASE WHEN len(any_value(composition)) = 1 THEN any_value(n) * max(coalesce(r, 1)) ELSE sum(coalesce(r, 1)) END, 6) AS cost FROM (SELECT *, unnest(composition) AS m FROM e) LEFT JOIN p ON c = m GROUP BY ensemble_id")
def a22(spark, d):
    e = spark.createDataFrame([("e1", ["c0", "c1"], 2), ("e2", ["c0"], 3), ("e3", ["c0", "c9", "cx"], 3)], "ensemble_id string, composition array<string>, n int")
    m = e.select("ensemble_id", "n", F.size("composition").alias("k"), F.explode("composition").alias("config_id")).join(F.broadcast(A.configs(spark)), "config_id", "left")
    one = F.coalesce("rate_in", F.lit(1.0))
    return m.groupBy("ensemble_id").agg(F.round(F.when(F.max("k") == 1, F.max("n") * F.max(one)).otherwise(F.sum(one)), 6).alias("cost"))


@query("A23_provider_effects", W("corpora", ", t AS (SELECT intent, unnest(list_filter(regexp_split_to_array(lower(utterance), '\\s+'), lambda x: x <> '')) AS w FROM corpora), a AS (SELECT intent, count(*) AS n, round(avg(length(utterance)), 4) AS mean, round(stddev_pop(length(utterance)), 4) AS std FROM corpora GROUP BY intent), b AS (SELECT intent, round(count(DISTINCT w) / count(*), 6) AS ttr FROM t GROUP BY intent) SELECT * FROM a JOIN b USING (intent)"))
def a23(spark, d):
    c = A.corpora(spark, d)
    a = c.groupBy("intent").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.length("utterance")), 4).alias("mean"), F.round(F.stddev_pop(F.length("utterance")), 4).alias("std"))
    w = c.select("intent", F.explode(F.regexp_extract_all(F.lower("utterance"), F.lit(r"\S+"), F.lit(0))).alias("w")).groupBy("intent", "w").agg(F.count(F.lit(1)).alias("k"))
    return a.join(w.groupBy("intent").agg(F.round(F.count(F.lit(1)) / F.sum("k"), 6).alias("ttr")), "intent")


@query("A24_validation_rollup", W("turns", ", v AS (SELECT convo_id, min(length(utterance)) > 20 AS ok FROM turns GROUP BY ALL) SELECT count(*) AS total, count(*) FILTER (ok) AS passed, count(*) FILTER (NOT ok) AS failed, round(count(*) FILTER (ok) / count(*), 6) AS pass_rate, coalesce(string_agg(convo_id::VARCHAR, ',' ORDER BY convo_id) FILTER (NOT ok), '') AS failed_ids FROM v"))
def a24(spark, d):
    v = A.turns(spark, d).groupBy("convo_id").agg((F.min(F.length("utterance")) > 20).alias("ok"))
    ids = F.array_join(F.array_sort(F.collect_list(F.when(~F.col("ok"), F.col("convo_id")))).cast("array<string>"), ",")  # the report lists them
    return v.agg(F.count(F.lit(1)).alias("total"), F.count_if("ok").alias("passed"), F.count_if(~F.col("ok")).alias("failed"), F.round(F.count_if("ok") / F.count(F.lit(1)), 6).alias("pass_rate"), ids.alias("failed_ids"))


@query("A25_breakdown_metrics", S("SELECT category, domain, round(sum(correct::INT) / count(*), 6) AS accuracy, count(*) FILTER (len(candidate_flows) > 0) AS ambiguous, count(*) FILTER (len(detected_flows) >= 2) AS recognised FROM scored GROUP BY GROUPING SETS ((category), (domain))"))
def a25(spark, d):
    s = scored(spark, d).select("category", "domain", "correct", "candidate_flows", "detected_flows").groupingSets([["category"], ["domain"]], "category", "domain")
    return s.agg(R.rate(F.col("correct")).alias("accuracy"), F.count_if(F.size("candidate_flows") > 0).alias("ambiguous"), F.count_if(F.size("detected_flows") >= 2).alias("recognised"))


@query("A26_reward_stats", S("SELECT convo_id, round(avg(correct::INT), 6) AS mean, round(stddev_pop(correct::INT), 6) AS std, min(correct::INT) AS lo, max(correct::INT) AS hi FROM scored GROUP BY convo_id"))
def a26(spark, d):
    r = F.col("correct").cast("int")
    return scored(spark, d).groupBy("convo_id").agg(F.round(F.avg(r), 6).alias("mean"), F.round(F.stddev_pop(r), 6).alias("std"), F.min(r).alias("lo"), F.max(r).alias("hi"))


@query("A27_histogram", "WITH m AS (SELECT min(value) AS lo, max(value) AS hi FROM events) SELECT least(9, floor((value - lo) / (hi - lo) * 10))::BIGINT AS bin, count(*) AS n FROM events, m GROUP BY bin")
def a27(spark, d):
    e = A.table(spark, d, "events").select("value")
    m = e.agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    x = e.crossJoin(F.broadcast(m))  # one row
    return x.groupBy(F.least(F.lit(9), F.floor((F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo")) * 10)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query("A28_null_parameter_rate", "SELECT event_type, count(*) AS n, count(*) FILTER (json_extract_string(props, '$.k')::INT % 3 = 0) AS nulls, round(count(*) FILTER (json_extract_string(props, '$.k')::INT % 3 = 0) / count(*), 6) AS rate FROM events GROUP BY event_type")
def a28(spark, d):
    params = F.create_map(F.lit("k"), F.expr("IF(CAST(get_json_object(props, '$.k') AS INT) % 3 = 0, NULL, get_json_object(props, '$.k'))"))
    e = A.table(spark, d, "events").select("event_type", F.explode(params).alias("param", "v"))
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("v").isNull()).alias("nulls"), F.round(F.count_if(F.col("v").isNull()) / F.count(F.lit(1)), 6).alias("rate"))


OVER = ", o AS (SELECT convo_id FROM preds WHERE voter = 0 INTERSECT SELECT convo_id FROM preds WHERE voter = 3) "


@query("A29_overlap_statistics", S(OVER + f"SELECT category, turn_num, {ACC} FROM scored WHERE voter = 0 AND convo_id IN (SELECT convo_id FROM o) GROUP BY GROUPING SETS ((), (category), (turn_num))"))
def a29(spark, d):
    p = A.preds(spark, d)
    both = p.where("voter = 0").select("convo_id").intersect(p.where("voter = 3").select("convo_id"))
    s = scored(spark, d).where("voter = 0").join(both, "convo_id", "left_semi").select("category", "turn_num", "correct")
    return s.groupingSets([[], ["category"], ["turn_num"]], "category", "turn_num").agg(R.rate(F.col("correct")).alias("accuracy"), F.count(F.lit(1)).alias("n"))


@query("A30_accuracy_where", S("SELECT voter, round(sum(correct::INT) FILTER (length(utterance) > 100) / nullif(count(*) FILTER (length(utterance) > 100), 0), 6) AS accuracy, count(*) FILTER (length(utterance) > 100) AS n FROM scored GROUP BY voter"))
def a30(spark, d):
    long_ = F.length("utterance") > 100
    return scored(spark, d).groupBy("voter").agg(F.round(F.sum(F.when(long_, F.col("correct").cast("int"))) / F.nullif(F.count_if(long_), F.lit(0)), 6).alias("accuracy"), F.count_if(long_).alias("n"))


@query("A31_overlap_distribution", W("preds", ", o AS (SELECT convo_id FROM preds WHERE voter = 0 AND latency_ms < 1200 GROUP BY convo_id) SELECT category, count(*) FILTER (o.convo_id IS NOT NULL) AS inside, count(*) AS total, count(*) FILTER (o.convo_id IS NULL) AS rest FROM gold LEFT JOIN o USING (convo_id) GROUP BY category"))
def a31(spark, d):
    o = A.preds(spark, d).where("voter = 0 AND latency_ms < 1200").select("convo_id").distinct().withColumn("i", F.lit(1))
    j = A.gold(spark, d).select("convo_id", "category").join(o, "convo_id", "left")
    return j.groupBy("category").agg(F.count("i").alias("inside"), F.count(F.lit(1)).alias("total"), F.count_if(F.col("i").isNull()).alias("rest"))


@query("A32_latency_per_model", W("preds configs", "SELECT model, round(avg(latency_ms), 4) AS mean, min(latency_ms) AS lo, max(latency_ms) AS hi FROM preds JOIN configs USING (config_id) GROUP BY model"))
def a32(spark, d):
    j = A.preds(spark, d).join(F.broadcast(A.configs(spark)), "config_id")
    return j.groupBy("model").agg(F.round(F.avg("latency_ms"), 4).alias("mean"), F.min("latency_ms").alias("lo"), F.max("latency_ms").alias("hi"))


TM = ", m AS (SELECT name, array_to_string(list_sort(_flows), ',') AS covers, _flows FROM tools) "


@query("A33_wrong_tool_confusion", W("tool_turns tools", TM + ", w AS (SELECT tool, flow, count(*) AS n FROM (SELECT flow, gold_tools, unnest(predicted_tools) AS tool FROM tool_turns) WHERE NOT list_contains(gold_tools, tool) GROUP BY ALL) SELECT tool, flow, n, covers FROM w JOIN m ON m.name = w.tool ORDER BY n DESC, tool, flow LIMIT 20"))
def a33(spark, d):
    t = A.tool_turns(spark, d).select("flow", "gold_tools", F.explode("predicted_tools").alias("tool")).where("NOT array_contains(gold_tools, tool)")
    m = A.tools(spark).select(F.col("name").alias("tool"), F.array_join(F.array_sort("_flows"), ",").alias("covers"))
    return t.groupBy("tool", "flow").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(m), "tool").orderBy(F.desc("n"), "tool", "flow").limit(20)


@query("A34_unmapped_flows", W("tool_turns", "SELECT flow, count(*) AS n, count(*) FILTER (len(predicted_tools) = 0) AS n_correct, count(*) FILTER (len(predicted_tools) > 0) AS responded FROM tool_turns WHERE len(gold_tools) = 0 GROUP BY flow"))
def a34(spark, d):
    return A.tool_turns(spark, d).where("size(gold_tools) = 0").groupBy("flow").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.size("predicted_tools") == 0).alias("n_correct"), F.count_if(F.size("predicted_tools") > 0).alias("responded"))


@query("A35_reasonable_errors", W("tool_turns tools", ", m AS (SELECT name, _flows FROM tools) SELECT CASE WHEN list_contains(_flows, '*') THEN 'generic' WHEN list_contains(_flows, flow) THEN 'covers' ELSE 'other' END AS kind, count(*) AS n FROM (SELECT flow, gold_tools, unnest(predicted_tools) AS tool FROM tool_turns) t JOIN m ON m.name = tool WHERE NOT list_contains(gold_tools, tool) GROUP BY ALL"))
def a35(spark, d):
    t = A.tool_turns(spark, d).select("flow", "gold_tools", F.explode("predicted_tools").alias("tool")).where("NOT array_contains(gold_tools, tool)")
    j = t.join(F.broadcast(A.tools(spark).select(F.col("name").alias("tool"), "_flows")), "tool")
    return j.groupBy(F.expr("CASE WHEN array_contains(_flows, '*') THEN 'generic' WHEN array_contains(_flows, flow) THEN 'covers' ELSE 'other' END").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("A36_flow_deep_dive", W("tool_turns", "SELECT coalesce(predicted_tools[1], 'none') AS called, count(*) AS n, count(*) FILTER (list_contains(gold_tools, predicted_tools[1])) AS mapped FROM tool_turns WHERE flow = 'f4' GROUP BY ALL"))
def a36(spark, d):
    first = F.get("predicted_tools", F.lit(0))
    return A.tool_turns(spark, d).where("flow = 'f4'").groupBy(F.coalesce(first, F.lit("none")).alias("called")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.array_contains("gold_tools", first)).alias("mapped"))


@query("A37_ambiguous_breakdown", W("turns", "SELECT flow, count(*) FILTER (len(candidate_flows) > 0) AS with_candidates, count(*) FILTER (len(candidate_flows) = 0) AS without FROM gold WHERE category LIKE 'ambiguous%' GROUP BY flow"))
def a37(spark, d):
    return A.gold(spark, d).where("startswith(category, 'ambiguous')").groupBy("flow").agg(F.count_if(F.size("candidate_flows") > 0).alias("with_candidates"), F.count_if(F.size("candidate_flows") == 0).alias("without"))


@query("A38_universal_check", W("tool_turns", "SELECT voter, bool_and(len(predicted_tools) = 0) AS all_null FROM tool_turns WHERE len(gold_tools) = 0 GROUP BY voter"))
def a38(spark, d):
    return A.tool_turns(spark, d).where("size(gold_tools) = 0").groupBy("voter").agg(F.bool_and(F.size("predicted_tools") == 0).alias("all_null"))


@query("A39_clear_subset", W("tool_turns", "SELECT len(predicted_tools) = 0 AS is_null, count(*) AS n, count(*) FILTER (len(list_intersect(gold_tools, predicted_tools)) > 0) AS hit FROM tool_turns WHERE len(gold_tools) > 0 AND len(candidate_flows) = 0 GROUP BY ALL"))
def a39(spark, d):
    t = A.tool_turns(spark, d).where("size(gold_tools) > 0 AND size(candidate_flows) = 0")
    return t.groupBy((F.size("predicted_tools") == 0).alias("is_null")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.arrays_overlap("gold_tools", "predicted_tools")).alias("hit"))


@query("A40_tools_offered", W("tool_turns", "SELECT len(predicted_tools)::INTEGER AS offered, count(*) AS n, round(count(*) FILTER (len(list_intersect(gold_tools, predicted_tools)) > 0) / count(*), 6) AS accuracy FROM tool_turns GROUP BY ALL"))
def a40(spark, d):
    return A.tool_turns(spark, d).groupBy(F.size("predicted_tools").alias("offered")).agg(F.count(F.lit(1)).alias("n"), F.round(F.count_if(F.arrays_overlap("gold_tools", "predicted_tools")) / F.count(F.lit(1)), 6).alias("accuracy"))


@query("A41_completeness", W("preds", "SELECT config_id, domain, count(DISTINCT seed) AS seeds, count(DISTINCT seed) < 2 AS partial FROM preds GROUP BY ALL"))
def a41(spark, d):
    s = A.preds(spark, d).select("config_id", "domain", "seed").distinct().groupBy("config_id", "domain").agg(F.count(F.lit(1)).alias("seeds"))
    return s.withColumn("partial", F.col("seeds") < 2)


@query("A42_findings", S(", r AS (SELECT category, sum(correct::INT) FILTER (seed = 1) / count(*) FILTER (seed = 1) AS a, sum(correct::INT) FILTER (seed = 2) / count(*) FILTER (seed = 2) AS b FROM scored GROUP BY category), q AS (SELECT category, round(b - a, 6) AS x FROM r) SELECT count(*) FILTER (x > 0) AS wins, count(*) AS n, round(avg(x), 6) AS mean_delta, arg_max(category, (x, category)) AS best, arg_min(category, (x, category)) AS worst FROM q"))
def a42(spark, d):
    r = scored(spark, d).groupBy("category").agg(*[(F.sum(F.when(F.col("seed") == s, F.col("correct").cast("int"))) / F.count_if(F.col("seed") == s)).alias(n) for s, n in ((1, "a"), (2, "b"))])
    q = r.select("category", F.round(F.col("b") - F.col("a"), 6).alias("x"))
    order = F.struct("x", "category")
    return q.agg(F.count_if(F.col("x") > 0).alias("wins"), F.count(F.lit(1)).alias("n"), F.round(F.avg("x"), 6).alias("mean_delta"), F.max_by("category", order).alias("best"), F.min_by("category", order).alias("worst"))


@query("A43_heldout_reward", S("SELECT round(avg(correct::INT), 6) AS mean, round(stddev_pop(correct::INT), 6) AS std FROM scored WHERE convo_id % 5 = 0"))
def a43(spark, d):
    r = F.col("correct").cast("int")
    return scored(spark, d).where("convo_id % 5 = 0").agg(F.round(F.avg(r), 6).alias("mean"), F.round(F.stddev_pop(r), 6).alias("std"))


@query("A44_report_header", S(", r AS (SELECT config_id, round(sum(correct::INT) / count(*), 6) AS a FROM scored GROUP BY ALL) SELECT (SELECT count(DISTINCT convo_id) FROM scored) AS convos, (SELECT count(*) FROM gold) AS labels, arg_max(config_id, (a, config_id)) AS best, max(a) AS best_accuracy FROM r"))
def a44(spark, d):
    s = scored(spark, d)
    r = s.groupBy("config_id").agg(R.rate(F.col("correct")).alias("a")).agg(F.max_by("config_id", F.struct("a", "config_id")).alias("best"), F.max("a").alias("best_accuracy"))
    g = A.gold(spark, d).agg(F.count_distinct("convo_id").alias("convos"), F.count(F.lit(1)).alias("labels"))
    return g.crossJoin(F.broadcast(r))  # one row each


@query("O1_rank_by_metric", S("SELECT config_id, category, accuracy, row_number() OVER (ORDER BY accuracy DESC, config_id, category) AS rank FROM (SELECT config_id, category, round(sum(correct::INT) / count(*), 6) AS accuracy FROM scored GROUP BY ALL)"))
def o1(spark, d):
    r = R.accuracy_by(scored(spark, d), "config_id", "category").drop("n")
    return R.ranked(r, [F.desc("accuracy"), F.col("config_id"), F.col("category")])


@query("O2_top_n", W("preds", "SELECT voter, convo_id, turn_num, latency_ms FROM preds ORDER BY latency_ms DESC, voter, convo_id, turn_num LIMIT 10"))
def o2(spark, d):
    return A.preds(spark, d).select("voter", "convo_id", "turn_num", "latency_ms").orderBy(F.desc("latency_ms"), "voter", "convo_id", "turn_num").limit(10)


@query("O3_most_common", W("turns", "SELECT flow, count(*) AS n FROM gold GROUP BY flow ORDER BY n DESC, min((convo_id, turn_num)) LIMIT 5"))
def o3(spark, d):
    g = A.gold(spark, d).groupBy("flow").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("convo_id", "turn_num")).alias("first"))
    return g.orderBy(F.desc("n"), "first").limit(5).drop("first")


@query("S9_dimension_override", W("configs", "SELECT config_id, CASE provider WHEN 'gemma' THEN 'google' ELSE provider END AS provider FROM configs"))
def s9(spark, d):
    return A.configs(spark).select("config_id", F.when(F.col("provider") == "gemma", "google").otherwise(F.col("provider")).alias("provider"))

