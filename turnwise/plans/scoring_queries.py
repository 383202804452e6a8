"""Queries of voting, scoring, ensembles and calibration."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnwise.operators import calibration as C
from turnwise.operators import relational as R
from turnwise.operators import scoring as V
from turnwise.plans import adapters as A
from turnwise.plans.adapters import with_views as W
from turnwise.plans.registry import query
from turnwise.plans.relational_queries import S, scored

TURN = ["convo_id", "turn_num"]
KEY = "array_to_string(list_sort(list_distinct(detected_flows)), '|')"
#: voted: convo_id, turn_num, answer, confidence
VOTED = f""", sets AS (SELECT convo_id, turn_num, {KEY} AS answer, count(*) AS w, min(voter) AS first FROM scored GROUP BY ALL),
voted AS (SELECT convo_id, turn_num, coalesce(max_by(answer, w * 100 - first) FILTER (answer <> ''), '') AS answer, round(coalesce(max(w) FILTER (answer <> '') / sum(w) FILTER (answer <> ''), 0), 4) AS confidence FROM sets GROUP BY ALL)"""


def lcg(*keys: str) -> str:
    out = "0::BIGINT"
    for k in keys:
        out = f"(({out} * 1103515245 + {k}::BIGINT * 12345 + 7919) % 2147483647)"
    return out


@query("V1_clear_score", S("SELECT voter, convo_id, turn_num, correct FROM scored"))
def v1(spark, d):
    return scored(spark, d).select("voter", *TURN, V.clear_score(F.col("detected_flows"), F.col("flow")).alias("correct"))


AMB = "len(detected_flows) >= 2 AND coalesce(list_contains(candidate_flows, detected_flows[(" + lcg("convo_id", "turn_num", "voter") + " % greatest(len(detected_flows), 1)) + 1]), false)"


@query("V2_ambiguous_score", S(f"SELECT voter, convo_id, turn_num, {AMB} AS correct, round(CASE WHEN len(detected_flows) >= 2 THEN len(list_filter(detected_flows, lambda x: list_contains(candidate_flows, x))) / len(detected_flows) ELSE 0 END, 6) AS expected FROM scored WHERE len(candidate_flows) > 0"))
def v2(spark, d):
    s = scored(spark, d).where("size(candidate_flows) > 0")
    pick = V.ambiguous_score(F.col("detected_flows"), F.col("candidate_flows"), F.col("convo_id"), F.col("turn_num"), F.col("voter"))
    return s.select("voter", *TURN, pick.alias("correct"), F.round(V.ambiguous_expected(F.col("detected_flows"), F.col("candidate_flows")), 6).alias("expected"))


@query("V3_majority_vote", S(VOTED + " SELECT * FROM voted"))
def v3(spark, d):
    return V.set_vote(scored(spark, d), TURN)


@query("V4_weighted_scalar_vote", W("votes", ", c AS (SELECT item, category AS answer, sum(rater)::DOUBLE AS w, min(rater) AS first FROM votes GROUP BY ALL) SELECT item, max_by(answer, (w, -first)) AS answer, round(max(w) / sum(w), 4) AS confidence FROM c GROUP BY item"))
def v4(spark, d):
    return V.scalar_vote(A.votes(spark, d), ["item"], "category", "rater", F.col("rater"))


@query("V5_scalar_majority", W("votes", ", c AS (SELECT item, category AS answer, count(*)::DOUBLE AS w, min(rater) AS first FROM votes GROUP BY ALL) SELECT item, max_by(answer, (w, -first)) AS answer, round(max(w) / sum(w), 4) AS confidence FROM c GROUP BY item"))
def v5(spark, d):
    return V.scalar_vote(A.votes(spark, d), ["item"], "category", "rater")


@query("V6_element_majority", W("tool_turns", "SELECT convo_id, turn_num, item, count(*) AS votes FROM (SELECT convo_id, turn_num, unnest(list_distinct(predicted_tools)) AS item FROM tool_turns) GROUP BY ALL HAVING count(*) >= 3"))
def v6(spark, d):
    return V.element_vote(A.tool_turns(spark, d), TURN, "predicted_tools", F.lit(5))


ENS = f""", live AS (SELECT * FROM scored WHERE len(candidate_flows) > 0 AND {KEY} <> ''), ps AS (SELECT convo_id, turn_num, {KEY} AS a, count(*) AS n, max(len(detected_flows) >= 2) AS many FROM live GROUP BY ALL),
rec AS (SELECT convo_id, turn_num, max(many) OR max(n) * 2 <= sum(n) AS recognised FROM ps GROUP BY ALL),
pf AS (SELECT convo_id, turn_num, f, count(*) AS n, min(voter) AS first, any_value(candidate_flows) AS c FROM (SELECT *, unnest(detected_flows) AS f FROM live) GROUP BY ALL),
pick AS (SELECT convo_id, turn_num, arg_min((f, c), (-n, first, f)) AS p FROM pf GROUP BY ALL),
ens AS (SELECT convo_id, turn_num, recognised, p[1] AS picked, recognised AND list_contains(p[2], p[1]) AS correct FROM rec JOIN pick USING (convo_id, turn_num))"""


@query("V7_ensemble_ambiguous", S(ENS + " SELECT * FROM ens"))
def v7(spark, d):
    return V.ensemble_ambiguous(scored(spark, d).where("size(candidate_flows) > 0"), TURN)


@query("V8_ensemble_clear", S(VOTED + " SELECT v.convo_id, v.turn_num, v.answer = g.flow AS correct FROM voted v JOIN gold g USING (convo_id, turn_num)"))
def v8(spark, d):
    return V.set_vote(scored(spark, d), [*TURN, "flow"]).select(*TURN, (F.col("answer") == F.col("flow")).alias("correct"))


@query("V9_voter_set_scorecard", S(VOTED + ENS + " SELECT g.category, count(*) AS n, round(sum((v.answer = g.flow)::INT) / count(*), 6) AS accuracy, round(100 * count(*) FILTER (e.recognised) / nullif(count(*) FILTER (len(g.candidate_flows) > 0), 0), 4) AS recognised_pct, round(100 * count(*) FILTER (e.correct) / nullif(count(*) FILTER (e.recognised), 0), 4) AS selected_pct FROM gold g JOIN voted v USING (convo_id, turn_num) LEFT JOIN ens e USING (convo_id, turn_num) GROUP BY g.category"))
def v9(spark, d):
    s = scored(spark, d)
    voted = V.set_vote(s, [*TURN, "flow", "category"])
    amb = s.where("size(candidate_flows) > 0")
    ens = V.ensemble_ambiguous(amb, TURN).select(*TURN, "recognised", F.col("correct").alias("selected"))
    base = voted.join(amb.select(*TURN, F.lit(True).alias("amb")).distinct(), TURN, "left").join(ens, TURN, "left")
    pct = lambda a, b: F.round(100 * F.count_if(a) / F.nullif(F.count_if(b), F.lit(0)), 4)
    return base.groupBy("category").agg(
        F.count(F.lit(1)).alias("n"), R.rate(F.col("answer") == F.col("flow")).alias("accuracy"),
        pct(F.col("recognised"), F.col("amb")).alias("recognised_pct"), pct(F.col("selected"), F.col("recognised")).alias("selected_pct"),
    )


@query("V10_compose_ensemble", S(VOTED.replace("FROM scored", "FROM scored WHERE voter IN (0, 2, 4)") + " SELECT convo_id, turn_num, v.answer, confidence, v.answer = g.flow AS correct FROM voted v JOIN gold g USING (convo_id, turn_num)"))
def v10(spark, d):
    v = V.set_vote(scored(spark, d).where("voter IN (0, 2, 4)"), [*TURN, "flow"])
    return v.select(*TURN, "answer", "confidence", (F.col("answer") == F.col("flow")).alias("correct"))


SELF = """, runs AS (SELECT *, dense_rank() OVER (PARTITION BY config_id ORDER BY seed) AS k FROM preds), okc AS (SELECT config_id FROM runs GROUP BY config_id HAVING max(k) >= 2),
sc AS (SELECT r.config_id, convo_id, turn_num, %s AS answer, count(*) AS w, min(seed) AS first FROM runs r JOIN okc USING (config_id) WHERE k <= 2 GROUP BY ALL)""" % KEY


@query("V11_self_consistency", W("preds", SELF + " SELECT config_id, convo_id, turn_num, coalesce(max_by(answer, w * 100 - first) FILTER (answer <> ''), '') AS answer, round(coalesce(max(w) FILTER (answer <> '') / sum(w) FILTER (answer <> ''), 0), 4) AS confidence FROM sc GROUP BY ALL"))
def v11(spark, d):
    p = A.preds(spark, d)
    seeds = p.select("config_id", "seed").distinct().groupBy("config_id").agg(F.slice(F.array_sort(F.collect_list("seed")), 1, 2).alias("first"), F.count(F.lit(1)).alias("n")).where("n >= 2")
    use = p.join(F.broadcast(seeds), "config_id").where(F.array_contains("first", F.col("seed")))  # a config list
    return V.set_vote(use, ["config_id", *TURN], voter="seed")


@query("V12_bootstrap", W("preds", f", b AS (SELECT pass, m AS voter_slot, ({lcg('pass', 'm')} % 5)::INTEGER AS voter FROM range(5) t(pass), range(3) u(m)), s AS (SELECT pass, convo_id, turn_num, {KEY} AS answer, count(*) AS w, min(voter_slot) AS first FROM b JOIN preds USING (voter) GROUP BY ALL), v AS (SELECT pass, convo_id, turn_num, max_by(answer, w * 100 - first) FILTER (answer <> '') AS answer FROM s GROUP BY ALL), a AS (SELECT pass, round(count(*) FILTER (v.answer = g.flow) / count(*), 8) AS acc FROM gold g LEFT JOIN v USING (convo_id, turn_num), (SELECT 1) GROUP BY pass) SELECT round(avg(acc), 6) AS mean, round(coalesce(stddev_samp(acc), 0), 6) AS std, count(*) AS passes FROM a WHERE pass IS NOT NULL"))
def v12(spark, d):
    seed = lambda a, b: F.expr(f"(((0L * 1103515245 + {a} * 12345 + 7919) % 2147483647) * 1103515245 + {b} * 12345 + 7919) % 2147483647")
    draws = spark.range(15).selectExpr("id div 3 AS pass", "id % 3 AS slot").withColumn("voter", (seed("pass", "slot") % 5).cast("int"))
    voted = V.set_vote(A.preds(spark, d).join(F.broadcast(draws), "voter"), ["pass", *TURN], voter="slot")  # fifteen rows
    j = voted.join(A.gold(spark, d).select(*TURN, "flow"), TURN)
    acc = j.groupBy("pass").agg(F.round(F.count_if(F.col("answer") == F.col("flow")) / F.count(F.lit(1)), 8).alias("acc"))
    return acc.agg(F.round(F.avg("acc"), 6).alias("mean"), F.round(F.coalesce(F.stddev_samp("acc"), F.lit(0.0)), 6).alias("std"), F.count(F.lit(1)).alias("passes"))


@query("V13_mixed_voters", W("preds", f", m AS (SELECT * FROM preds WHERE (config_id, seed) IN (('c0', 1), ('c1', 2), ('c2', 1))), s AS (SELECT convo_id, turn_num, {KEY} AS answer, count(*) AS w, min(voter) AS first FROM m GROUP BY ALL) SELECT convo_id, turn_num, coalesce(max_by(answer, w * 100 - first) FILTER (answer <> ''), '') AS answer, round(coalesce(max(w) FILTER (answer <> '') / sum(w) FILTER (answer <> ''), 0), 4) AS confidence FROM s GROUP BY ALL"))
def v13(spark, d):
    return V.set_vote(A.preds(spark, d).where("(config_id = 'c0' AND seed = 1) OR (config_id = 'c1' AND seed = 2) OR (config_id = 'c2' AND seed = 1)"), TURN)


ENSEMBLES = "(VALUES ('e_all', 0), ('e_all', 1), ('e_all', 2), ('e_all', 3), ('e_all', 4), ('e_even', 0), ('e_even', 2), ('e_even', 4), ('e_one', 1))"
RANKED = f""", e(ensemble_id, voter) AS {ENSEMBLES}, s AS (SELECT ensemble_id, convo_id, turn_num, flow, {KEY} AS answer, count(*) AS w, min(voter) AS first FROM scored JOIN e USING (voter) GROUP BY ALL),
v AS (SELECT ensemble_id, convo_id, turn_num, flow, coalesce(max_by(answer, w * 100 - first) FILTER (answer <> ''), '') AS answer FROM s GROUP BY ALL), a AS (SELECT ensemble_id, round(count(*) FILTER (answer = flow) / count(*), 5) AS accuracy FROM v GROUP BY ALL)"""


def ensemble_members(spark):
    rows = [("e_all", v) for v in range(5)] + [("e_even", v) for v in (0, 2, 4)] + [("e_one", 1)]
    return spark.createDataFrame(rows, "ensemble_id string, voter int")


def ensemble_accuracy(spark, d):
    v = V.set_vote(scored(spark, d).join(F.broadcast(ensemble_members(spark)), "voter"), ["ensemble_id", *TURN, "flow"])  # a config list
    return v.groupBy("ensemble_id").agg(F.round(F.count_if(F.col("answer") == F.col("flow")) / F.count(F.lit(1)), 5).alias("accuracy"))


@query("V14_ensemble_rank", S(RANKED + " SELECT ensemble_id, accuracy, row_number() OVER (ORDER BY accuracy DESC, ensemble_id) AS rank FROM a"))
def v14(spark, d):
    return R.ranked(ensemble_accuracy(spark, d), [F.desc("accuracy"), F.col("ensemble_id")])


@query("V15_single_confidence", W("preds", "SELECT voter, convo_id, turn_num, round(CASE WHEN len(detected_flows) > 0 THEN 1 / len(detected_flows) ELSE 0 END, 4) AS confidence FROM preds"))
def v15(spark, d):
    f = F.col("detected_flows")
    most = F.array_max(F.transform(f, lambda x: F.size(F.filter(f, lambda y: x == y))))  # repeated flows raise it
    return A.preds(spark, d).select("voter", *TURN, F.round(F.when(F.size(f) > 0, most / F.size(f)).otherwise(0.0), 4).alias("confidence"))


@query("V16_intent_score", S("SELECT voter, convo_id, turn_num, CASE WHEN len(candidate_flows) > 0 THEN list_contains(candidate_flows, lower(trim(' ' || upper(detected) || ' '))) ELSE lower(trim(' ' || upper(detected) || ' ')) = flow END AS correct FROM scored WHERE detected IS NOT NULL"))
def v16(spark, d):
    s = scored(spark, d).where("detected IS NOT NULL")
    odd = F.concat(F.lit(" "), F.upper("detected"), F.lit(" "))
    return s.select("voter", *TURN, V.intent_score(odd, F.col("flow"), F.col("candidate_flows")).alias("correct"))


TOOLS = """, x AS (SELECT *, list_distinct(predicted_tools) AS p, list_distinct(gold_tools) AS g FROM tool_turns),
y AS (SELECT *, list_filter(p, lambda t: NOT (t IN ('t6', 't7') AND NOT list_contains(g, t))) AS paid, len(list_intersect(p, g)) AS hits FROM x),
z AS (SELECT *, CASE WHEN len(paid) = 0 THEN 1.0 ELSE hits / len(paid) END AS pr, CASE WHEN len(g) = 0 THEN 1.0 ELSE hits / len(g) END AS re FROM y),
ts AS (SELECT voter, convo_id, turn_num, CASE WHEN len(candidate_flows) > 0 AND list_contains(p, 'handle_ambiguity') THEN 1 WHEN len(g) = 0 AND len(p) = 0 THEN 1 WHEN len(g) = 0 THEN (CASE WHEN len(paid) = 0 THEN 1 ELSE 2 END) WHEN len(p) = 0 THEN 2 ELSE 3 END AS kind,
  hits >= ceil(len(g) / 2) AND (len(paid) < 3 OR pr >= 0.5) AS enough, pr, re FROM z),
tool_scores AS (SELECT voter, convo_id, turn_num, CASE kind WHEN 1 THEN true WHEN 2 THEN false ELSE enough END AS correct, round(CASE kind WHEN 1 THEN 1.0 WHEN 2 THEN 0.0 ELSE pr END, 4)::DOUBLE AS "precision", round(CASE kind WHEN 1 THEN 1.0 WHEN 2 THEN 0.0 ELSE re END, 4)::DOUBLE AS recall FROM ts)"""


def tool_scores(spark, d):
    s = V.tool_score(F.col("predicted_tools"), F.col("gold_tools"), F.col("candidate_flows"), list(A.FREEBIES))
    return A.tool_turns(spark, d).select("voter", *TURN, s.alias("s")).select("voter", *TURN, "s.*")


@query("V17_tool_score", W("tool_turns", TOOLS + " SELECT * FROM tool_scores"))
def v17(spark, d):
    return tool_scores(spark, d)


#: gold parameters a: every turn, b: where k is even; predicted by a call of tool tA unless k = 7, with b left out where k % 4 = 0
PARAMS = """, pr AS (SELECT convo_id, turn_num, k, 'a' AS param, 'V' || (k % 5) AS want, CASE WHEN k <> 7 THEN ' v' || ((k + convo_id % 2) % 5) END AS got, 'exact' AS method FROM gold
UNION ALL SELECT convo_id, turn_num, k, 'b', 'w' || k, CASE WHEN k <> 7 AND k % 4 <> 0 THEN 'W' || k END, NULL FROM gold WHERE k % 2 = 0),
params AS (SELECT convo_id, turn_num, param, CASE WHEN k = 7 THEN 'missing_tool' WHEN got IS NULL THEN 'missing_param' WHEN method IS NULL THEN 'error' ELSE method END AS method, coalesce(lower(trim(want)) = lower(trim(got)), false) AS match FROM pr)"""


def param_rows(spark, d):
    g = A.gold(spark, d).selectExpr(
        "convo_id", "turn_num",
        "map('tA', IF(k % 2 = 0, map('a', concat('V', k % 5), 'b', concat('w', k), 'n', CAST(NULL AS STRING)), map('a', concat('V', k % 5)))) AS gold",
        """IF(k = 7, CAST(array() AS ARRAY<STRUCT<name: STRING, args: MAP<STRING, STRING>>>), array(named_struct('name', 'tA', 'args', IF(k % 4 = 0, map('a', concat(' v', (k + convo_id % 2) % 5)), map('a', concat(' v', (k + convo_id % 2) % 5), 'b', concat('W', k)))),
           named_struct('name', 'tA', 'args', map('a', 'second call')))) AS predicted""",
    )
    methods = spark.createDataFrame([("tA", "a", "exact")], "tool string, param string, method string")
    return V.param_details(g, F.broadcast(methods))  # a manifest


@query("V18_param_score", W("turns", PARAMS + " SELECT convo_id, turn_num, round(coalesce(count(*) FILTER (match) / nullif(count(*), 0), 1), 6) AS param_accuracy, count(*) AS scored, count(*) FILTER (method = 'missing_tool') AS missing_tool, count(*) FILTER (method = 'missing_param') AS missing_param, count(*) FILTER (method = 'error') AS errors FROM params GROUP BY ALL"))
def v18(spark, d):
    return param_rows(spark, d).groupBy(*TURN).agg(
        F.round(F.count_if("match") / F.count(F.lit(1)), 6).alias("param_accuracy"), F.count(F.lit(1)).alias("scored"),
        *[F.count_if(F.col("method") == m).alias(n) for m, n in (("missing_tool", "missing_tool"), ("missing_param", "missing_param"), ("error", "errors"))],
    )


@query("V19_normalised_match", "SELECT event_id, lower(trim('  ' || upper(event_type))) = event_type AS same FROM events")
def v19(spark, d):
    return A.table(spark, d, "events").select("event_id", (V.normalised(F.concat(F.lit("  "), F.upper("event_type"))) == F.col("event_type")).alias("same"))


@query("V20_structured_match", "SELECT event_id, json_extract_string(props, '$.k')::INT % 2 = 0 AS match FROM events")
def v20(spark, d):
    e = A.table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))
    gold = F.create_map(F.lit("k"), F.col("k"), F.lit("odd"), F.lit("0"))
    got = F.create_map(F.lit("k"), F.col("k"), F.lit("odd"), (F.col("k").cast("int") % 2).cast("string"), F.lit("extra"), F.lit("x"))
    return e.select("event_id", F.forall(F.map_entries(gold), lambda x: F.coalesce(F.try_element_at(got, x["key"]) == x["value"], F.lit(False))).alias("match"))


@query("V22_funnel", S("SELECT voter, count(*) FILTER (substr(detected, 2)::INT // 3 = k // 3) AS intent_ok, count(*) FILTER (substr(detected, 2)::INT // 3 = k // 3 AND correct) AS flow_ok, count(*) FILTER (substr(detected, 2)::INT // 3 = k // 3 AND correct AND length(utterance) % 2 = 0) AS slot_ok FROM scored GROUP BY voter"))
def v22(spark, d):
    s = scored(spark, d)
    i = F.coalesce(F.floor(F.substring("detected", 2, 9).cast("int") / 3) == F.floor(F.col("k") / 3), F.lit(False))
    f1 = F.when(F.length("utterance") % 2 == 0, 0.5).otherwise(0.49)
    return s.groupBy("voter").agg(F.count_if(i).alias("intent_ok"), F.count_if(i & F.col("correct")).alias("flow_ok"), F.count_if(i & F.col("correct") & (f1 >= 0.5)).alias("slot_ok"))


@query("V23_slot_score", W("tool_turns", ", s AS (SELECT voter, convo_id, turn_num, list_distinct(predicted_tools) AS dt, CASE WHEN k = 5 THEN []::VARCHAR[] ELSE ['t0', 't1', 't2', 't3', 't6'] END AS sk, gold_tools AS gk FROM tool_turns), pr AS (SELECT *, CASE WHEN len(sk) = 0 THEN (CASE WHEN len(dt) = 0 THEN 1.0 ELSE 0.0 END) WHEN len(dt) = 0 THEN 1.0 ELSE len(list_intersect(dt, sk)) / len(dt) END AS p, CASE WHEN len(sk) = 0 THEN (CASE WHEN len(dt) = 0 THEN 1.0 ELSE 0.0 END) WHEN len(gk) = 0 THEN 1.0 ELSE len(list_intersect(dt, gk)) / len(gk) END AS r FROM s) SELECT voter, convo_id, turn_num, round(p, 6)::DOUBLE AS \"precision\", round(r, 6)::DOUBLE AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6)::DOUBLE AS f1 FROM pr"))
def v23(spark, d):
    t = A.tool_turns(spark, d)
    schema = F.when(F.col("k") == 5, F.array().cast("array<string>")).otherwise(F.array(*[F.lit(x) for x in ("t0", "t1", "t2", "t3", "t6")]))
    s = V.slot_score(F.array_distinct("predicted_tools"), schema, F.col("gold_tools"))
    return t.select("voter", *TURN, s.alias("s")).select("voter", *TURN, "s.*")


@query("V24_match_method", W("turns", PARAMS + " SELECT method, count(*) AS n, count(*) FILTER (match) AS matched FROM params GROUP BY method"))
def v24(spark, d):
    return param_rows(spark, d).groupBy("method").agg(F.count(F.lit(1)).alias("n"), F.count_if("match").alias("matched"))


@query("V25_label_agreement", W("tool_turns", ", c AS (SELECT convo_id, turn_num, category, item, count(*) AS v, any_value(gold_tools) AS g FROM (SELECT *, unnest(list_distinct(predicted_tools)) AS item FROM tool_turns) GROUP BY ALL HAVING count(*) >= 3), s AS (SELECT convo_id, turn_num, list_sort(list(item)) AS items FROM c GROUP BY ALL), t AS (SELECT DISTINCT convo_id, turn_num, category, list_sort(list_distinct(gold_tools)) AS g FROM tool_turns WHERE len(gold_tools) > 0) SELECT category, count(*) AS n, count(*) FILTER (coalesce(items = g, false)) AS agree FROM t LEFT JOIN s USING (convo_id, turn_num) GROUP BY category"))
def v25(spark, d):
    t = A.tool_turns(spark, d)
    voted = V.element_vote(t, TURN, "predicted_tools", F.lit(5)).groupBy(*TURN).agg(F.array_join(F.array_sort(F.collect_list("item")), "|").alias("voted"))
    gold = t.where("size(gold_tools) > 0 AND voter = 0").select(*TURN, "category", R.answer_key(F.col("gold_tools")).alias("g"))
    return gold.join(voted, TURN, "left").groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("g") == F.col("voted")).alias("agree"))


@query("V26_ambiguity_baseline", S(f", r AS (SELECT config_id, seed, count(*) FILTER (len(detected_flows) >= 2) / count(*) AS rec, count(*) FILTER ({AMB}) / count(*) AS ov FROM scored WHERE len(candidate_flows) > 0 GROUP BY ALL) SELECT config_id, round(avg(rec), 6) AS recognised, round(coalesce(stddev_samp(rec), 0), 6) AS recognised_std, round(avg(ov), 6) AS overall FROM r GROUP BY config_id"))
def v26(spark, d):
    s = scored(spark, d).where("size(candidate_flows) > 0")
    pick = V.ambiguous_score(F.col("detected_flows"), F.col("candidate_flows"), F.col("convo_id"), F.col("turn_num"), F.col("voter"))
    r = s.groupBy("config_id", "seed").agg((F.count_if(F.size("detected_flows") >= 2) / F.count(F.lit(1))).alias("rec"), (F.count_if(pick) / F.count(F.lit(1))).alias("ov"))
    return r.groupBy("config_id").agg(F.round(F.avg("rec"), 6).alias("recognised"), F.round(F.coalesce(F.stddev_samp("rec"), F.lit(0.0)), 6).alias("recognised_std"), F.round(F.avg("ov"), 6).alias("overall"))


@query("V27_composed_reward", S("SELECT voter, convo_id, turn_num, round(correct::INT * 0.5 + (len(detected_flows) > 0)::INT * 0.5, 6)::DOUBLE AS reward FROM scored"))
def v27(spark, d):
    weights = {"correct": 0.5, "answered": 0.5}
    s = scored(spark, d).withColumn("answered", F.size("detected_flows") > 0)
    total = sum((F.col(c).cast("double") * w for c, w in weights.items()), F.lit(0.0))
    return s.select("voter", *TURN, F.round(total, 6).alias("reward"))


@query("V28_group_advantage", S(", r AS (SELECT convo_id, turn_num, voter, 2 * correct::INT - 1 AS r FROM scored), z AS (SELECT *, avg(r) OVER w AS m, stddev_pop(r) OVER w AS s FROM r WINDOW w AS (PARTITION BY convo_id, turn_num)) SELECT convo_id, turn_num, voter, round((r - m) / s, 6) AS advantage FROM z WHERE s > 0"))
def v28(spark, d):
    r = scored(spark, d).select(*TURN, "voter", F.col("correct").cast("double").alias("reward"))
    return V.advantages(r, TURN, "reward").select(*TURN, "voter", F.round("advantage", 6).alias("advantage"))


@query("V29_hallucinated_tools", W("tool_turns tools", "SELECT voter, tool, count(*) AS n FROM (SELECT voter, unnest(predicted_tools) AS tool FROM tool_turns) WHERE tool NOT IN (SELECT name FROM tools) GROUP BY ALL"))
def v29(spark, d):
    t = A.tool_turns(spark, d).select("voter", F.explode("predicted_tools").alias("tool"))
    known = A.tools(spark).select(F.col("name").alias("tool"))
    return t.join(F.broadcast(known), "tool", "left_anti").groupBy("voter", "tool").agg(F.count(F.lit(1)).alias("n"))


@query("V30_value_in_utterance", W("turns", "SELECT convo_id, turn_num, count(*) FILTER (length(v) > 2 AND contains(lower(utterance), v)) AS hits FROM (SELECT convo_id, turn_num, utterance, unnest(['the', 'of', 'ing', 'zzz']) AS v FROM gold) GROUP BY ALL"))
def v30(spark, d):
    args = F.create_map(*[F.lit(x) for x in ("p1", "the", "p2", "of", "p3", "ing", "p4", "zzz")])
    found = F.size(F.filter(F.map_values(args), lambda v: (F.length(v) > 2) & F.contains(F.lower("utterance"), v)))
    return A.gold(spark, d).select(*TURN, found.cast("long").alias("hits"))


@query("V31_stage_rewards", W("tool_turns preds", TOOLS + " SELECT t.convo_id, t.turn_num, t.voter, t.correct::INT::DOUBLE AS tool_reward, coalesce(len(p.detected_flows) = 1 AND p.detected_flows[1] = g.flow, false)::INT::DOUBLE AS flow_reward FROM tool_scores t JOIN gold g USING (convo_id, turn_num) LEFT JOIN preds p USING (convo_id, turn_num, voter)"))
def v31(spark, d):
    s = scored(spark, d).select(*TURN, "voter", F.col("correct").cast("double").alias("flow_reward"))
    return tool_scores(spark, d).select(*TURN, "voter", F.col("correct").cast("double").alias("tool_reward")).join(s, [*TURN, "voter"])


@query("V33_run_modes", W("tool_turns", TOOLS + S(" SELECT 'flow' AS mode, voter, count(*) AS n, count(*) FILTER (correct) AS n_correct FROM scored GROUP BY voter UNION ALL SELECT 'tool', voter, count(*), count(*) FILTER (correct) FROM tool_scores GROUP BY voter").split("gold AS (SELECT * FROM turns WHERE speaker = 'user')", 1)[1]))
def v33(spark, d):
    rows = scored(spark, d).select(F.lit("flow").alias("mode"), "voter", "correct").unionByName(tool_scores(spark, d).select(F.lit("tool").alias("mode"), "voter", "correct"))
    return rows.groupBy("mode", "voter").agg(F.count(F.lit(1)).alias("n"), F.count_if("correct").alias("n_correct"))


@query("V34_calibration_records", S(VOTED + " SELECT 'cross' AS kind, convo_id, turn_num, confidence, v.answer = g.flow AS correct, g.category, g.domain FROM voted v JOIN gold g USING (convo_id, turn_num) UNION ALL SELECT 'single', convo_id, turn_num, round(CASE WHEN len(detected_flows) > 0 THEN 1 / len(detected_flows) ELSE 0 END, 4), correct, category, domain FROM scored WHERE voter = 0"))
def v34(spark, d):
    s = scored(spark, d)
    cross = V.set_vote(s, [*TURN, "flow", "category", "domain"]).select(F.lit("cross").alias("kind"), *TURN, "confidence", (F.col("answer") == F.col("flow")).alias("correct"), "category", "domain")
    one = s.where("voter = 0").select(F.lit("single").alias("kind"), *TURN, F.round(F.when(F.size("detected_flows") > 0, 1 / F.size("detected_flows")).otherwise(0.0), 4).alias("confidence"), "correct", "category", "domain")
    return cross.unionByName(one)


@query("V35_ranked_accuracy", S(RANKED + " SELECT ensemble_id, accuracy FROM a ORDER BY accuracy DESC, ensemble_id LIMIT 2"))
def v35(spark, d):
    return ensemble_accuracy(spark, d).orderBy(F.desc("accuracy"), "ensemble_id").limit(2)


BIN = "(" + " + ".join(f"(confidence >= {i} * 0.1::DOUBLE)::INT" for i in range(1, 10)) + ")"


def bins_sql(keys: str = "") -> str:
    k = f"{keys}, " if keys else ""
    return f", b AS (SELECT {k}{BIN} AS bin, count(*) AS n, sum(correct::INT)::BIGINT AS ok, sum(confidence::DECIMAL(20, 6))::DOUBLE AS conf FROM calib GROUP BY {k}bin) "


@query("C1_ece", W("calib", bins_sql() + "SELECT round(sum(abs(ok / n - conf / n) * n) / sum(n), 6) AS ece FROM b"))
def c1(spark, d):
    return C.errors(A.calib(spark, d), []).select("ece")


@query("C2_mce", W("calib", bins_sql("domain") + "SELECT domain, round(max(abs(ok / n - conf / n)), 6) AS mce FROM b GROUP BY domain"))
def c2(spark, d):
    return C.errors(A.calib(spark, d), ["domain"]).select("domain", "mce")


POINT = """round(avg((confidence - correct::INT) ** 2), 6) AS brier, round(coalesce(count(*) FILTER (NOT correct AND confidence >= 0.64) / nullif(count(*) FILTER (NOT correct), 0), 0), 6) AS overconfidence,
 round(coalesce(count(*) FILTER (correct AND confidence < 0.64) / nullif(count(*) FILTER (correct), 0), 0), 6) AS underconfidence"""


@query("C3_brier", W("calib", "SELECT domain, round(avg((confidence - correct::INT) ** 2), 6) AS brier FROM calib GROUP BY domain"))
def c3(spark, d):
    return C.pointwise(A.calib(spark, d), ["domain"]).select("domain", "brier")


@query("C4_reliability", W("calib", bins_sql() + "SELECT r.bin::INTEGER AS bin, coalesce(n, 0) AS n, round(conf / n, 6) AS mean_confidence, round(ok / n, 6) AS accuracy FROM range(10) r(bin) LEFT JOIN b ON b.bin = r.bin"))
def c4(spark, d):
    return C.reliability(A.calib(spark, d), spark)


@query("C5_overconfidence", W("calib", f"SELECT category, overconfidence FROM (SELECT category, {POINT} FROM calib GROUP BY category)"))
def c5(spark, d):
    return C.pointwise(A.calib(spark, d), ["category"]).select("category", "overconfidence")


@query("C6_underconfidence", W("calib", f"SELECT category, underconfidence FROM (SELECT category, {POINT} FROM calib GROUP BY category)"))
def c6(spark, d):
    return C.pointwise(A.calib(spark, d), ["category"]).select("category", "underconfidence")


@query("C7_fleiss_kappa", W("raters", ", c AS (SELECT item, category, count(*) AS c FROM raters GROUP BY ALL), p AS (SELECT avg((sq - 5) / 20) AS p FROM (SELECT item, sum(c * c) AS sq FROM c GROUP BY item)), e AS (SELECT sum((t / n) ** 2) AS pe FROM (SELECT category, sum(c) AS t FROM c GROUP BY category), (SELECT sum(c) AS n FROM c)) SELECT round((p - pe) / (1 - pe), 6) AS kappa FROM p, e"))
def c7(spark, d):
    return C.fleiss_kappa(A.raters(spark, d), "item", "category")


SPEAR = ", n AS (SELECT confidence, correct::INT::DOUBLE AS y, rank() OVER (ORDER BY confidence) + (count(*) OVER (PARTITION BY confidence) - 1) / 2 AS rx, rank() OVER (ORDER BY correct) + (count(*) OVER (PARTITION BY correct) - 1) / 2 AS ry FROM calib)"


@query("C8_spearman", W("calib", SPEAR + " SELECT round(corr(rx, ry), 6) AS spearman FROM n"))
def c8(spark, d):
    return C.spearman(A.calib(spark, d), "confidence", "correct")


@query("C9_calibration_bundle", W("calib", bins_sql() + f", e AS (SELECT round(sum(abs(ok / n - conf / n) * n) / sum(n), 5) AS ece, round(max(abs(ok / n - conf / n)), 5) AS mce FROM b), q AS (SELECT {POINT} FROM calib) SELECT ece, mce, round(brier, 5) AS brier, round(overconfidence, 5) AS overconfidence, round(underconfidence, 5) AS underconfidence FROM e, q"))
def c9(spark, d):
    r = A.calib(spark, d)
    j = C.errors(r, []).crossJoin(F.broadcast(C.pointwise(r, [])))  # one row each
    return j.select(*[F.round(c, 5).alias(c) for c in ("ece", "mce", "brier", "overconfidence", "underconfidence")])


@query("C10_grouped_calibration", W("calib", f", g AS (SELECT domain, category, {BIN} AS bin, count(*) AS n, sum(correct::INT) AS ok, sum(confidence::DECIMAL(20, 6)) AS conf FROM calib GROUP BY ALL), s AS (SELECT domain, category, bin, sum(n) AS n, sum(ok) AS ok, sum(conf)::DOUBLE AS conf FROM g GROUP BY GROUPING SETS ((bin), (domain, bin), (category, bin))) SELECT domain, category, sum(n)::BIGINT AS n, round(sum(abs(ok / n - conf / n) * n) / sum(n), 6) AS ece FROM s GROUP BY domain, category"))
def c10(spark, d):
    b = C.bins(A.calib(spark, d), ["domain", "category"])
    s = b.groupingSets([["bin"], ["domain", "bin"], ["category", "bin"]], "domain", "category", "bin").agg(F.sum("n").alias("n"), F.sum("n_correct").alias("ok"), F.sum("confidence").alias("conf"))
    gap = F.abs(F.col("ok") / F.col("n") - F.col("conf") / F.col("n"))
    return s.groupBy("domain", "category").agg(F.sum("n").alias("total"), F.round(F.sum(gap * F.col("n")) / F.sum("n"), 6).alias("ece")).withColumnRenamed("total", "n")


@query("C11_capped_top_k", W("calib", ", a AS (SELECT category, domain, round(sum(correct::INT) / count(*), 6) AS accuracy FROM calib GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY accuracy DESC, category) AS rank FROM a) SELECT category, domain, accuracy, rank FROM r WHERE rank <= 5 ORDER BY accuracy DESC, domain, category LIMIT 10"))
def c11(spark, d):
    a = A.calib(spark, d).groupBy("category", "domain").agg(R.rate(F.col("correct")).alias("accuracy"))
    return R.top_per_group(a, ["domain"], [F.desc("accuracy"), F.col("category")], 5).orderBy(F.desc("accuracy"), "domain", "category").limit(10)


@query("C12_best_worst", W("calib", bins_sql("domain") + f", e AS (SELECT domain, round(sum(abs(ok / n - conf / n) * n) / sum(n), 6) AS ece FROM b GROUP BY domain), q AS (SELECT domain, {POINT} FROM calib GROUP BY domain) SELECT arg_min(domain, (ece, domain)) AS best, arg_max(domain, (overconfidence, domain)) AS most_overconfident FROM e JOIN q USING (domain)"))
def c12(spark, d):
    r = A.calib(spark, d)
    j = C.errors(r, ["domain"]).join(C.pointwise(r, ["domain"]), "domain")
    return j.agg(F.min_by("domain", F.struct("ece", "domain")).alias("best"), F.max_by("domain", F.struct("overconfidence", "domain")).alias("most_overconfident"))
