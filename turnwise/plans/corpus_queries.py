"""Queries of corpus comparison and text checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnwise.functions import text as T
from turnwise.operators import distribution as D
from turnwise.operators import relational as R
from turnwise.plans import adapters as A
from turnwise.plans.adapters import with_views as W
from turnwise.plans.registry import query


def al(value: str, src: str = "corpora", keys: str = "") -> str:
    k = f"{keys}, " if keys else ""
    part = f"PARTITION BY {keys}" if keys else ""
    return f""", c AS (SELECT {k}{value}, count(*) FILTER (source = 'eval') AS n_eval, count(*) FILTER (source = 'synth') AS n_synth FROM {src} WHERE {value} IS NOT NULL GROUP BY ALL),
al AS (SELECT *, n_eval / nullif(sum(n_eval) OVER ({part}), 0) AS p, n_synth / nullif(sum(n_synth) OVER ({part}), 0) AS q FROM c) """


JSD = """round(CASE WHEN coalesce(sum(n_eval), 0) = 0 OR coalesce(sum(n_synth), 0) = 0 THEN 1 ELSE sqrt(greatest(0, (coalesce(sum(p * ln(p / ((p + q) / 2))) FILTER (p > 0), 0) + coalesce(sum(q * ln(q / ((p + q) / 2))) FILTER (q > 0), 0)) / 2)) END, 6) AS jsd"""
TOOLS = ", ct AS (SELECT source, category, flow, intent, unnest(tools) AS tool FROM corpora)"


@query("X1_aligned_probabilities", W("corpora", al("flow") + "SELECT flow, n_eval, n_synth, round(p, 6) AS p, round(q, 6) AS q FROM al"))
def x1(spark, d):
    return D.aligned(A.corpora(spark, d), "flow").select("flow", "n_eval", "n_synth", F.round("p", 6).alias("p"), F.round("q", 6).alias("q"))


@query("X2_jensen_shannon", W("corpora", al("flow") + f"SELECT {JSD} FROM al"))
def x2(spark, d):
    return D.js_distance(D.aligned(A.corpora(spark, d), "flow"))


CHI = """, e AS (SELECT *, n_eval * sum(n_synth) OVER () / sum(n_eval) OVER () AS e FROM al WHERE n_eval > 0),
g AS (SELECT coalesce(sum((n_synth - e) ** 2 / nullif(e, 0)), 0) AS x, count(*) - 1 AS dof FROM e),
gp AS (SELECT x, dof, (dof / 2 - 1) * ln(2) + lgamma(dof / 2) AS c, least(sqrt(x), sqrt(dof) + 14) / 20000 AS h FROM g)
SELECT round(x, 4) AS chi2, dof, round(CASE WHEN dof < 1 OR x <= 0 THEN 1 ELSE greatest(0, 1 - (SELECT sum(h * exp((dof - 1) * ln((i + 0.5) * h) - ((i + 0.5) * h) ** 2 / 2 - c)) FROM (SELECT unnest(range(20000)) AS i))) END, 6)::DOUBLE AS p FROM gp"""


@query("X3_chi_square", W("corpora", al("flow") + CHI))
def x3(spark, d):
    return D.chi_square(D.aligned(A.corpora(spark, d), "flow"))


def ent(value: str, src: str, keys: str = "") -> str:
    k = f"{keys}, " if keys else ""
    part = f"PARTITION BY {keys}" if keys else ""
    g = f" GROUP BY {keys}" if keys else ""
    return f", ec AS (SELECT {k}{value}, count(*) AS n FROM {src} WHERE {value} IS NOT NULL GROUP BY ALL), ep AS (SELECT *, n / sum(n) OVER ({part}) AS p FROM ec) SELECT {k}round(-sum(p * log2(p)), 6) AS entropy, count(*) AS n_unique, round(CASE WHEN count(*) > 1 THEN -sum(p * log2(p)) / log2(count(*)) ELSE 0 END, 6) AS uniformity FROM ep{g}"


@query("X4_entropy", "WITH z AS (SELECT 1)" + ent("event_type", "events"))
def x4(spark, d):
    return D.entropy(A.table(spark, d, "events"), "event_type")


@query("X5_flow_diversity", W("corpora", ", f AS (SELECT * FROM corpora WHERE flow <> 'f3')" + ent("flow", "f", "source")))
def x5(spark, d):
    return D.entropy(A.corpora(spark, d).where("flow <> 'f3'"), "flow", ["source"])  # one flow stands for the excluded label


@query("X6_intent_diversity", W("corpora", ent("intent", "corpora", "source")))
def x6(spark, d):
    return D.entropy(A.corpora(spark, d), "intent", ["source"])


@query("X7_tool_diversity", W("corpora", TOOLS + ent("tool", "ct", "source").replace("SELECT source, round(", "SELECT ep.source, any_value(mt.mean_tools) AS mean_tools, round(").replace("FROM ep", "FROM ep JOIN (SELECT source, round(sum(len(tools)) / count(*), 6) AS mean_tools FROM corpora GROUP BY source) mt USING (source)").replace("GROUP BY source", "GROUP BY ep.source").replace("AS mean_tools FROM corpora GROUP BY ep.source", "AS mean_tools FROM corpora GROUP BY source")))
def x7(spark, d):
    c = A.corpora(spark, d)
    mean = c.groupBy("source").agg(F.round(F.sum(F.size("tools")) / F.count(F.lit(1)), 6).alias("mean_tools"))
    return D.entropy(c.select("source", F.explode("tools").alias("tool")), "tool", ["source"]).join(mean, "source")


@query("X8_flow_distribution", W("corpora", al("flow") + ", r AS (SELECT flow, n_eval, n_synth, round(q / nullif(p, 0), 6) AS ratio FROM al) SELECT * FROM r WHERE ratio IS NULL OR ratio < 0.5 OR ratio > 2"))
def x8(spark, d):
    return D.flagged(D.aligned(A.corpora(spark, d), "flow"), "flow")


@query("X9_intent_distribution", W("corpora", al("intent") + f"SELECT {JSD} FROM al"))
def x9(spark, d):
    return D.js_distance(D.aligned(A.corpora(spark, d), "intent"))


LEN = "round(avg(x), 4) AS mean, round(quantile_cont(x, 0.5), 4)::DOUBLE AS median, round(stddev_pop(x), 4) AS std, round(quantile_cont(x, 0.1), 4)::DOUBLE AS p10, round(quantile_cont(x, 0.9), 4)::DOUBLE AS p90"
WC = "len(regexp_extract_all(utterance, '\\S+'))"


@query("X10_length_stats", W("corpora", f"SELECT source, {LEN} FROM (SELECT source, {WC} AS x FROM corpora) GROUP BY source"))
def x10(spark, d):
    return D.length_stats(A.corpora(spark, d), T.word_count(F.col("utterance")), ["source"])


def ks(keys: str, src: str) -> str:
    k, part, g = (f"{keys}, ", f"PARTITION BY {keys}", f" GROUP BY {keys}") if keys else ("", "", "")
    return f""", kc AS (SELECT {k}x, count(*) FILTER (source = 'eval') AS a, count(*) FILTER (source = 'synth') AS b FROM {src} GROUP BY ALL),
kg AS (SELECT {k}abs(sum(a) OVER r / nullif(sum(a) OVER e, 0) - sum(b) OVER r / nullif(sum(b) OVER e, 0)) AS gap FROM kc WINDOW e AS ({part}), r AS ({part} ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) SELECT {k}round(max(gap), 6) AS ks FROM kg{g}"""


def ks_p(src: str) -> str:
    """ks and p of a whole table."""
    gap = ks("", src).removesuffix(" SELECT round(max(gap), 6) AS ks FROM kg")
    return gap + f""", kd AS (SELECT max(gap) AS d, (SELECT count(*) FROM {src} WHERE source = 'eval') AS n, (SELECT count(*) FROM {src} WHERE source = 'synth') AS m FROM kg),
kx AS (SELECT d, d * sqrt(n * m / nullif(n + m, 0)) AS x, n, m FROM kd)
SELECT round(d, 6) AS ks, round(CASE WHEN n = 0 OR m = 0 OR x < 0.2 THEN 1 ELSE least(1, greatest(0, (SELECT sum(2 * CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END * exp(-2.0::DOUBLE * k * k * x * x)) FROM (SELECT unnest(range(1, 101)) AS k)))) END, 6)::DOUBLE AS p FROM kx"""


@query("X11_two_sample_ks", W("corpora", f", l AS (SELECT category, source, {WC} AS x FROM corpora)" + ks_p("l")))
def x11(spark, d):
    return D.ks_statistic(A.corpora(spark, d).select("source", T.word_count(F.col("utterance")).alias("x")), "x")


TOK = r"list_filter(list_transform(regexp_extract_all(lower(utterance), '\S+'), lambda w: regexp_replace(w, '^[!-/:-@\[-`{-~]+|[!-/:-@\[-`{-~]+$', '', 'g')), lambda w: w <> '')"


@query("X12_vocabulary", W("corpora", f", t AS (SELECT source, unnest({TOK}) AS w FROM corpora), c AS (SELECT w, count(*) FILTER (source = 'eval') AS a, count(*) FILTER (source = 'synth') AS b FROM t GROUP BY w) SELECT round(count(*) FILTER (a > 0) / sum(a), 6) AS ttr_eval, round(count(*) FILTER (b > 0) / sum(b), 6) AS ttr_synth, round(count(*) FILTER (a > 0 AND b > 0) / count(*), 6) AS jaccard, count(*) FILTER (a >= 2 AND b = 0) AS eval_only FROM c"))
def x12(spark, d):
    t = A.corpora(spark, d).select("source", F.explode(T.tokens(F.col("utterance"))).alias("w"))
    c = t.groupBy("w").agg(F.count_if(F.col("source") == "eval").alias("a"), F.count_if(F.col("source") == "synth").alias("b"))
    n = F.count_if
    return c.agg(
        F.round(n(F.col("a") > 0) / F.sum("a"), 6).alias("ttr_eval"), F.round(n(F.col("b") > 0) / F.sum("b"), 6).alias("ttr_synth"),
        F.round(n((F.col("a") > 0) & (F.col("b") > 0)) / F.count(F.lit(1)), 6).alias("jaccard"), n((F.col("a") >= 2) & (F.col("b") == 0)).alias("eval_only"),
    )


@query("X13_tool_usage", W("corpora", TOOLS + al("tool", "ct") + f"SELECT {JSD}, round(100 * count(*) FILTER (n_eval > 0 AND n_synth > 0) / nullif(count(*) FILTER (n_eval > 0), 0), 4) AS coverage_pct, count(*) FILTER (n_eval > 0 AND n_synth = 0) AS gaps, count(*) FILTER (n_eval = 0) AS noise FROM al"))
def x13(spark, d):
    a = D.aligned(A.corpora(spark, d).select("source", F.explode("tools").alias("tool")), "tool")
    n = F.count_if
    cover = a.agg(F.round(100 * n((F.col("n_eval") > 0) & (F.col("n_synth") > 0)) / F.nullif(n(F.col("n_eval") > 0), F.lit(0)), 4).alias("coverage_pct"), n((F.col("n_eval") > 0) & (F.col("n_synth") == 0)).alias("gaps"), n(F.col("n_eval") == 0).alias("noise"))
    return D.js_distance(a).crossJoin(F.broadcast(cover))  # one row each


TRANS = """, r AS (SELECT convo_id, flow, lead(flow) OVER w AS nxt, row_number() OVER w AS k FROM gold WINDOW w AS (PARTITION BY convo_id ORDER BY turn_num)), tr AS (SELECT convo_id, flow AS from_flow, nxt AS to_flow FROM r WHERE k = 1 AND nxt IS NOT NULL)"""


@query("X14_transition_matrix", W("turns", TRANS + " SELECT from_flow, to_flow, count(*) AS n FROM tr GROUP BY ALL"))
def x14(spark, d):
    return D.transitions(A.turns(spark, d)).groupBy("from_flow", "to_flow").agg(F.count(F.lit(1)).alias("n"))


@query("X15_transition_cosine", W("turns", TRANS + ", c AS (SELECT from_flow, to_flow, count(*) FILTER (convo_id % 2 = 0) AS a, count(*) FILTER (convo_id % 2 = 1) AS b FROM tr GROUP BY ALL) SELECT round(sum(a * b) / sqrt(sum(a * a) * sum(b * b)), 6) AS cosine, round(100 * count(*) FILTER (a > 0 AND b > 0) / count(*) FILTER (a > 0), 4) AS coverage_pct, count(*) FILTER (a > 0 AND b = 0) AS missing FROM c"))
def x15(spark, d):
    t = D.transitions(A.turns(spark, d))
    c = t.groupBy("from_flow", "to_flow").agg(F.count_if(F.col("convo_id") % 2 == 0).alias("a"), F.count_if(F.col("convo_id") % 2 == 1).alias("b"))
    dot = lambda x, y: F.sum(F.col(x) * F.col(y))
    return c.agg(
        F.round(dot("a", "b") / F.sqrt(dot("a", "a") * dot("b", "b")), 6).alias("cosine"),
        F.round(100 * F.count_if((F.col("a") > 0) & (F.col("b") > 0)) / F.count_if(F.col("a") > 0), 4).alias("coverage_pct"),
        F.count_if((F.col("a") > 0) & (F.col("b") == 0)).alias("missing"),
    )


@query("X16_transition_heatmap", W("turns", TRANS + ", c AS (SELECT from_flow, to_flow, count(*) AS n FROM tr GROUP BY ALL) SELECT from_flow, to_flow, round(n / sum(n) OVER (PARTITION BY from_flow), 6) AS share FROM c"))
def x16(spark, d):
    from pyspark.sql.window import Window

    c = D.transitions(A.turns(spark, d)).groupBy("from_flow", "to_flow").agg(F.count(F.lit(1)).alias("n"))
    return c.select("from_flow", "to_flow", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("from_flow")), 6).alias("share"))


@query("X17_embedding_similarity", "WITH e AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), m AS (SELECT label, i, avg(x) AS m FROM e GROUP BY ALL) SELECT a.label AS \"left\", b.label AS \"right\", round(sum(a.m * b.m), 4) + 0.0 AS cosine FROM m a JOIN m b ON a.i = b.i AND a.label <= b.label GROUP BY ALL")
def x17(spark, d):
    return D.mean_cosine(A.table(spark, d, "embeddings"), "label", "embedding")


@query("X18_pca_2d")
def x18(spark, d):
    return D.principal_components(A.table(spark, d, "embeddings"), "vec_id", "embedding")


@query("X19_topic_coverage")
def x19(spark, d):
    v = A.table(spark, d, "embeddings").withColumn("source", F.when(F.col("vec_id") % 2 == 0, "eval").otherwise("synth"))
    return D.topic_coverage(D.topics(v, "embedding")[0])


@query("X20_context_dependence", W("turns", f", w AS (SELECT domain, {WC} AS x FROM gold) SELECT domain, round(count(*) FILTER (x < 8) / count(*), 6) AS terse FROM w GROUP BY domain"))
def x20(spark, d):
    return A.gold(spark, d).groupBy("domain").agg(R.rate(T.word_count(F.col("utterance")) < 8).alias("terse"))


@query("X21_per_category", W("corpora", al("flow", keys="category") + f", l AS (SELECT category, source, {WC} AS x FROM corpora)" + ks("category", "l").replace(" SELECT category, round(max(gap)", ", kk AS (SELECT category, round(max(gap)") + f"), jj AS (SELECT category, {JSD} FROM al GROUP BY category) SELECT category, jsd, coalesce(ks, 1) AS ks FROM jj LEFT JOIN kk USING (category)"))
def x21(spark, d):
    c = A.corpora(spark, d)
    k = D.ks_statistic(c.select("source", "category", T.word_count(F.col("utterance")).alias("x")), "x", ["category"])
    return D.js_distance(D.aligned(c, "flow", ["category"]), ["category"]).join(k, "category", "left").select("category", "jsd", F.coalesce("ks", F.lit(1.0)).alias("ks"))


@query("X22_turn_position", W("corpora", ", c2 AS (SELECT * REPLACE (CASE WHEN convo_id % 4 < 2 THEN 1 ELSE 3 END AS turn_num) FROM corpora)" + al("flow", "c2", "turn_num") + f"SELECT turn_num, {JSD} FROM al GROUP BY turn_num"))
def x22(spark, d):
    c = A.corpora(spark, d).withColumn("turn_num", F.when(F.col("convo_id") % 4 < 2, 1).otherwise(3))
    return D.js_distance(D.aligned(c, "flow", ["turn_num"]), ["turn_num"])


@query("X23_agent_responses", W("turns", f", l AS (SELECT CASE WHEN convo_id % 2 = 0 THEN 'eval' ELSE 'synth' END AS source, {WC} AS x FROM turns WHERE speaker = 'agent')" + ks_p("l")))
def x23(spark, d):
    t = A.turns(spark, d).where("speaker = 'agent'").select(F.when(F.col("convo_id") % 2 == 0, "eval").otherwise("synth").alias("source"), T.word_count(F.col("utterance")).alias("x"))
    return D.ks_statistic(t, "x")


@query("X24_conditional_jsd", W("corpora", TOOLS + al("tool", "ct", "flow") + f", j AS (SELECT flow, {JSD}, sum(n_eval) AS a, sum(n_synth) AS b FROM al GROUP BY flow) SELECT flow, jsd FROM j WHERE a > 0 AND b > 0 ORDER BY jsd DESC, flow LIMIT 5"))
def x24(spark, d):
    t = D.aligned(A.corpora(spark, d).select("source", "flow", F.explode("tools").alias("tool")), "tool", ["flow"])
    both = t.groupBy("flow").agg(F.sum("n_eval").alias("a"), F.sum("n_synth").alias("b")).where("a > 0 AND b > 0").select("flow")
    return D.js_distance(t, ["flow"]).join(both, "flow", "left_semi").orderBy(F.desc("jsd"), "flow").limit(5)


@query("X25_scorecard", W("corpora", al("flow", keys="category") + f", j AS (SELECT category, {JSD} FROM al GROUP BY category) SELECT category, CASE WHEN jsd <= 0.05 THEN 'green' WHEN jsd <= 0.2 THEN 'yellow' ELSE 'red' END AS rating FROM j"))
def x25(spark, d):
    limits = spark.createDataFrame([("jsd", 0.05, 0.2)], "metric string, green double, yellow double")
    j = D.js_distance(D.aligned(A.corpora(spark, d), "flow", ["category"]), ["category"]).crossJoin(F.broadcast(limits))  # one row a metric
    return j.select("category", F.expr("CASE WHEN jsd <= green THEN 'green' WHEN jsd <= yellow THEN 'yellow' ELSE 'red' END").alias("rating"))


@query("X26_stratified_sample", W("corpora", ", r AS (SELECT category, convo_id, row_number() OVER (PARTITION BY category ORDER BY (convo_id * 1103515245 + 12345) % 2147483647, convo_id) AS k FROM corpora) SELECT category, convo_id FROM r WHERE k <= 5"))
def x26(spark, d):
    c = A.corpora(spark, d).select("category", "convo_id", F.expr("(convo_id * 1103515245 + 12345) % 2147483647").alias("h"))
    return R.top_per_group(c, ["category"], [F.col("h"), F.col("convo_id")], 5).select("category", "convo_id")


@query("X27_welch_t", W("corpora", ", s AS (SELECT avg(length(utterance)) FILTER (source = 'eval') AS me, avg(length(utterance)) FILTER (source = 'synth') AS ms, var_samp(length(utterance)) FILTER (source = 'eval') / count(*) FILTER (source = 'eval') AS a, var_samp(length(utterance)) FILTER (source = 'synth') / count(*) FILTER (source = 'synth') AS b, count(*) FILTER (source = 'eval') AS ne, count(*) FILTER (source = 'synth') AS ns FROM corpora), u AS (SELECT (me - ms) / sqrt(a + b) AS t, (a + b) ** 2 / (a ** 2 / (ne - 1) + b ** 2 / (ns - 1)) AS dof FROM s), w AS (SELECT t, dof, lgamma((dof + 1) / 2) - lgamma(dof / 2) - ln(dof * pi()) / 2 AS c, abs(t) / 20000 AS h FROM u) SELECT round(t, 4) AS t, round(dof, 2) AS dof, round(greatest(0, 1 - 2 * (SELECT sum(h * exp(c - (dof + 1) / 2 * ln(1 + ((i + 0.5) * h) ** 2 / dof))) FROM (SELECT unnest(range(20000)) AS i))), 6)::DOUBLE AS p FROM w"))
def x27(spark, d):
    return D.welch_t(A.corpora(spark, d), F.length("utterance"))


@query("X28_judge_rollup", W("corpora", "SELECT category, source, count(*) AS n, count(*) FILTER (convo_id % 5 + 1 <= 2) AS low, round(sum(convo_id % 5 + 1) / count(*), 6) AS mean FROM corpora GROUP BY ALL"))
def x28(spark, d):
    """Judges are external; their scores (here from the key) are rolled up."""
    s = A.corpora(spark, d).withColumn("score", F.col("convo_id") % 5 + 1)
    return s.groupBy("category", "source").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("score") <= 2).alias("low"), F.round(F.sum("score") / F.count(F.lit(1)), 6).alias("mean"))


# -- text -------------------------------------------------------------------


@query("T1_encoding", f"SELECT doc_id, regexp_matches(text, '[{T.BANNED}]') AS banned FROM documents")
def t1(spark, d):
    return A.table(spark, d, "documents").select("doc_id", T.has_banned(F.col("text")).alias("banned"))


@query("T2_format", W("turns", "SELECT convo_id, count(*) = 3 AND string_agg(speaker, ',' ORDER BY turn_num) = 'user,agent,user' AS ok FROM turns GROUP BY convo_id"))
def t2(spark, d):
    n = R.nest(A.turns(spark, d))
    return n.select("convo_id", ((F.size("turns") == 3) & (F.transform("turns", lambda t: t["speaker"]) == F.array(F.lit("user"), F.lit("agent"), F.lit("user")))).alias("ok"))


NAMES = ["the", "and", "idiot", "apache"]


@query("T3_label_leak", "SELECT doc_id, " + " || ".join(f"CASE WHEN regexp_matches(text, '(?i)\\b{n}\\b') THEN '{n} ' ELSE '' END" for n in NAMES) + " AS leaked FROM documents")
def t3(spark, d):
    names = T.names_leaked(F.col("text"), NAMES)
    return A.table(spark, d, "documents").select("doc_id", F.array_join(F.transform(names, lambda x: F.concat(x, F.lit(" "))), "").alias("leaked"))


@query("T4_length", W("turns", f"SELECT convo_id, turn_num, length(utterance) > 1 AND {WC} <= CASE speaker WHEN 'user' THEN 100 ELSE 80 END AS ok FROM turns"))
def t4(spark, d):
    limit = F.when(F.col("speaker") == "user", 100).otherwise(80)
    return A.turns(spark, d).select("convo_id", "turn_num", ((F.length("utterance") > 1) & (T.word_count(F.col("utterance")) <= limit)).alias("ok"))


@query("T6_disambiguating_keyword", f"WITH b AS (SELECT item_id, unnest(list_distinct({TOK.replace('utterance', 'text')})) AS w FROM benchmark), c AS (SELECT w, min(item_id) AS item_id FROM b WHERE length(w) > 7 GROUP BY w HAVING count(DISTINCT item_id) = 1) SELECT item_id, count(*) AS keywords FROM c GROUP BY item_id")
def t6(spark, d):
    w = A.table(spark, d, "benchmark").select("item_id", F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("w")).where("length(w) > 7")
    return w.groupBy("w").agg(F.min("item_id").alias("item_id"), F.max("item_id").alias("m")).where("item_id = m").groupBy("item_id").agg(F.count(F.lit(1)).alias("keywords"))


@query("T7_multi_request", "SELECT doc_id, regexp_matches(text, '(?i)" + "|".join(T.MULTI_REQUEST).replace("'", "''") + "') AS several FROM documents")
def t7(spark, d):
    return A.table(spark, d, "documents").select("doc_id", F.col("text").rlike("(?i)" + "|".join(T.MULTI_REQUEST)).alias("several"))


@query("T8_trivial_keyword", W("flows turns", "SELECT convo_id, turn_num, regexp_matches(utterance, '(?i)\\b(f0|f1|f2|f3|f4|f5|that)\\b') AS trivial FROM gold"))
def t8(spark, d):
    names = [f"f{i}" for i in range(6)] + ["that"]  # the user-facing flows' names
    return A.gold(spark, d).select("convo_id", "turn_num", F.col("utterance").rlike(rf"(?i)\b({'|'.join(names)})\b").alias("trivial"))


@query("T9_validator", W("turns", f", c AS (SELECT convo_id, count(*) AS n, max({WC}) AS longest, min(length(utterance)) AS shortest FROM turns GROUP BY convo_id) SELECT convo_id, trim(CASE WHEN n <> 3 THEN 'format ' ELSE '' END || CASE WHEN longest > 80 THEN 'long ' ELSE '' END || CASE WHEN shortest < 20 THEN 'short ' ELSE '' END) AS issues, n = 3 AND longest <= 80 AND shortest >= 20 AS passed FROM c"))
def t9(spark, d):
    c = A.turns(spark, d).groupBy("convo_id").agg(F.count(F.lit(1)).alias("n"), F.max(T.word_count(F.col("utterance"))).alias("longest"), F.min(F.length("utterance")).alias("shortest"))
    issues = F.filter(F.array(F.when(F.col("n") != 3, "format"), F.when(F.col("longest") > 80, "long"), F.when(F.col("shortest") < 20, "short")), lambda x: x.isNotNull())
    return c.select("convo_id", F.array_join(issues, " ").alias("issues"), (F.size(issues) == 0).alias("passed"))


@query("T10_quality_gate", W("turns", f"SELECT convo_id, turn_num, trim(CASE WHEN regexp_matches(utterance, '{T.FILLER}') THEN 'filler ' ELSE '' END || CASE WHEN {WC} > 9 THEN 'long ' ELSE '' END || CASE WHEN NOT regexp_matches(utterance, '{T.CONNECTOR}') THEN 'no_connector' ELSE '' END) AS reasons FROM gold"))
def t10(spark, d):
    u = F.col("utterance")
    reasons = F.filter(F.array(F.when(u.rlike(T.FILLER), "filler"), F.when(T.word_count(u) > 9, "long"), F.when(~u.rlike(T.CONNECTOR), "no_connector")), lambda x: x.isNotNull())
    return A.gold(spark, d).select("convo_id", "turn_num", F.array_join(reasons, " ").alias("reasons"))


@query("T11_corpus_heuristics", W("corpora", f"SELECT source, count(*) AS n, count(*) FILTER (regexp_matches(utterance, '{T.FILLER}')) AS filler, round(coalesce(count(*) FILTER (regexp_matches(utterance, '{T.CONNECTOR}')) / nullif(count(*), 0), 1), 6) AS connector_rate FROM corpora GROUP BY source"))
def t11(spark, d):
    u = F.col("utterance")
    return A.corpora(spark, d).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if(u.rlike(T.FILLER)).alias("filler"), F.round(F.count_if(u.rlike(T.CONNECTOR)) / F.count(F.lit(1)), 6).alias("connector_rate"))


@query("T12_tokeniser", f"SELECT doc_id, len({TOK.replace('utterance', 'text')})::INTEGER AS n, md5(array_to_string({TOK.replace('utterance', 'text')}, ' ')) AS digest FROM documents")
def t12(spark, d):
    t = A.table(spark, d, "documents").select("doc_id", T.tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").alias("n"), F.md5(F.array_join("t", " ").cast("binary")).alias("digest"))


@query("T13_word_count", "SELECT doc_id, len(regexp_extract_all(text, '\\S+'))::INTEGER AS n FROM documents")
def t13(spark, d):
    return A.table(spark, d, "documents").select("doc_id", T.word_count(F.col("text")).alias("n"))


@query("T14_jaccard", f"WITH t AS (SELECT doc_id, list_distinct({TOK.replace('utterance', 'text')}) AS t FROM documents) SELECT a.doc_id, round(CASE WHEN len(a.t) = 0 OR len(b.t) = 0 THEN 0 ELSE len(list_intersect(a.t, b.t)) / (len(a.t) + len(b.t) - len(list_intersect(a.t, b.t))) END, 6)::DOUBLE AS jaccard FROM t a JOIN t b ON b.doc_id = a.doc_id + 1")
def t14(spark, d):
    t = A.table(spark, d, "documents").select("doc_id", T.tokens(F.col("text")).alias("t"))
    b = t.select((F.col("doc_id") - 1).alias("doc_id"), F.col("t").alias("u"))
    return t.join(b, "doc_id").select("doc_id", F.round(T.jaccard(F.col("t"), F.col("u")), 6).alias("jaccard"))


@query("T18_sanitise", "SELECT item_id, regexp_replace(replace(translate('“' || text || '…”—x', '‘’“”' || chr(160), '''''\"\" '), '…', '...'), '\\s*[–—]\\s*', ', ', 'g') AS clean FROM benchmark")
def t18(spark, d):
    return A.table(spark, d, "benchmark").select("item_id", T.sanitised(F.concat(F.lit("“"), F.col("text"), F.lit("…”—x"))).alias("clean"))


@query("T19_artefact_fix", "SELECT count(*) FILTER (replace(replace(replace(text, '..', '.'), ' ,', ','), '!!', '!') <> text) AS changed, sum(length(replace(replace(replace(text, '..', '.'), ' ,', ','), '!!', '!')))::BIGINT AS chars FROM documents")
def t19(spark, d):
    fixed = F.col("text")
    for a, b in (("..", "."), (" ,", ","), ("!!", "!")):
        fixed = F.replace(fixed, F.lit(a), F.lit(b))
    return A.table(spark, d, "documents").agg(F.count_if(fixed != F.col("text")).alias("changed"), F.sum(F.length(fixed)).alias("chars"))


@query("T20_json_reply", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def t20(spark, d):
    fenced = F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```"))
    return A.table(spark, d, "events").select("event_id", F.get_json_object(T.json_reply(fenced), "$.k").alias("k"))


@query("T21_flow_list", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'f1,f2' WHEN 1 THEN event_type WHEN 2 THEN event_type ELSE '' END AS flows FROM events")
def t21(spark, d):
    reply = F.expr("""CASE event_id % 4 WHEN 0 THEN '```json\n{"flows": ["F1 ", " f2"]}\n```' WHEN 1 THEN concat('{"flow": " ', upper(event_type), '"}')
                      WHEN 2 THEN concat('sorry, "flow_name": "', event_type, '" it is') ELSE 'no idea' END""")
    return A.table(spark, d, "events").select("event_id", F.array_join(T.flow_list(reply), ",").alias("flows"))


@query("T22_schema_parse", "SELECT event_type, count(*) FILTER (json_extract_string(props, '$.k')::INT >= 50) AS valid, count(*) AS n FROM events GROUP BY event_type")
def t22(spark, d):
    p = A.table(spark, d, "events").select("event_type", F.from_json("props", "k int").alias("p"))
    return p.groupBy("event_type").agg(F.count_if(F.coalesce(F.col("p.k") >= 50, F.lit(False))).alias("valid"), F.count(F.lit(1)).alias("n"))


HEX = {"0": "chat", "1": "query", "3": "compose", "4": "plan", "6": "filter", "9": "order", "A": "post", "B": "send"}


@query("T23_dax", W("flows", "SELECT name, array_to_string(list_transform(regexp_extract_all(dax, '[0-9A-F]'), lambda x: coalesce(CASE x " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in HEX.items()) + " END || '(' || x || ')', '?' || x)), ' + ') AS spelled FROM flows"))
def t23(spark, d):
    return A.flows(spark).select("name", T.decomposed(F.col("dax"), HEX).alias("spelled"))
