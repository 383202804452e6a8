"""Derived, deterministic views of the driver tables in the shape of the conversation data model.

The labels are synthetic: they exercise operator semantics and say nothing about any model.
Each view has a Spark form here and a DuckDB form in :data:`CTE`, from the same integer arithmetic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

N_FLOWS = 12
#: tools per name; a tool serves the flows that its number divides into
N_TOOLS = 8
FREEBIES = ("t6", "t7")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """convo_id, turn_num, speaker, utterance, category, flow, intent, candidate_flows, domain, exclude; one row a turn."""
    c = table(spark, sf_dir, "conversations")
    return c.select("*", (F.length("text") % N_FLOWS).cast("int").alias("k")).selectExpr(
        "conv_id AS convo_id", "CAST(turn AS INT) AS turn_num", "CASE role WHEN 'assistant' THEN 'agent' ELSE role END AS speaker", "text AS utterance",
        "CASE conv_id % 4 WHEN 0 THEN 'same_flow' WHEN 1 THEN 'switch_flow' WHEN 2 THEN 'ambiguous_first' ELSE 'ambiguous_second' END AS category",
        "concat('f', k) AS flow", "concat('i', k div 3) AS intent",
        f"CASE WHEN (conv_id + turn) % 5 = 0 THEN array(concat('f', k), concat('f', (k + 1) % {N_FLOWS})) ELSE array() END AS candidate_flows",
        "concat('d', conv_id % 2) AS domain", "(conv_id * 3 + turn) % 19 = 0 AS exclude", "k",
    )


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns(spark, sf_dir).where("speaker = 'user'")


def preds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """voter, config_id, seed, convo_id, turn_num, detected_flows, latency_ms, input_tokens, output_tokens; some rows are missing."""
    v = F.explode(F.sequence(F.lit(0), F.lit(4))).alias("voter")
    g = gold(spark, sf_dir).select("convo_id", "turn_num", "k", F.length("utterance").alias("n"), "domain", v)
    g = g.where("(convo_id + turn_num * 2 + voter) % 23 <> 0").withColumn(
        "p", F.expr(f"(k + CASE WHEN (convo_id * 7 + turn_num * 3 + voter * 5) % 4 = 0 THEN 1 ELSE 0 END) % {N_FLOWS}")
    )
    return g.selectExpr(
        "voter", "concat('c', voter % 3) AS config_id", "CAST(voter div 3 + 1 AS INT) AS seed", "domain", "convo_id", "turn_num",
        f"""CASE WHEN (convo_id * 11 + turn_num + voter) % 17 = 0 THEN CAST(array() AS ARRAY<STRING>)
                WHEN (convo_id + turn_num + voter) % 5 = 0 THEN array(concat('f', p), concat('f', (p + 1) % {N_FLOWS})) ELSE array(concat('f', p)) END AS detected_flows""",
        "CAST((n * 13 + voter * 101) % 2000 AS BIGINT) AS latency_ms", "CAST(n AS BIGINT) AS input_tokens", "CAST(10 + voter AS BIGINT) AS output_tokens",
    )


def tool_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold and predicted tools per user turn and voter: gold_tools, predicted_tools, candidate_flows, flow, category."""
    v = F.explode(F.sequence(F.lit(0), F.lit(4))).alias("voter")
    g = gold(spark, sf_dir).select("convo_id", "turn_num", "category", "flow", "domain", "k", "candidate_flows", "exclude", F.length("utterance").alias("n"), v)
    return g.selectExpr(
        "*",
        "filter(array(IF(k = 11, NULL, concat('t', k % 6)), IF(k % 3 = 0, concat('t', (k + 2) % 6), NULL), IF(k % 4 = 0, concat('t', (k + 3) % 6), NULL)), x -> x IS NOT NULL) AS gold_tools",
        """filter(array(IF((convo_id + turn_num + voter) % 13 = 0, NULL, concat('t', (k + IF((convo_id * 5 + turn_num + voter * 3) % 4 = 0, 1, 0)) % 6)),
               IF((convo_id + voter) % 3 = 0, concat('t', (k + 2) % 6), NULL), IF((turn_num + voter) % 4 = 0, 't6', NULL), IF((convo_id + turn_num) % 7 = 0, 't7', NULL),
               IF((convo_id * 3 + voter) % 29 = 0, 'handle_ambiguity', NULL)), x -> x IS NOT NULL) AS predicted_tools""",
    )


def calib(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, confidence (k/10, on every bin edge), correct, domain, category."""
    return table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id").selectExpr(
        "doc_id", "(n_chars % 11) / 10D AS confidence", "quality = 1 AS correct", "lang AS domain", "source AS category"
    )


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item, rater, category: every event is a vote on its user, raters numbered in time."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("item"), F.row_number().over(w).alias("rater"), F.col("event_type").alias("category"))


def raters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item, rater 1 to 5, category: the votes of a user in consecutive items of five; kappa needs equal counts, so a last item of fewer is none."""
    from pyspark.sql.window import Window

    v = votes(spark, sf_dir).select(F.concat_ws(":", "item", F.expr("(rater - 1) div 5")).alias("item"), ((F.col("rater") - 1) % 5 + 1).alias("rater"), "category")
    return v.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("item"))).where("n = 5").drop("n")


def flows(spark: SparkSession) -> DataFrame:
    """name, intent, dax, edge_flows: twelve flows of four intents."""
    return spark.range(N_FLOWS).selectExpr(
        "concat('f', id) AS name", "CASE id div 3 WHEN 2 THEN 'Plan' WHEN 3 THEN 'Internal' ELSE concat('i', id div 3) END AS intent",
        "concat('{', upper(lpad(conv(CAST(id * 37 AS STRING), 10, 16), 3, '0')), '}') AS dax",
        f"array(concat('f', (id + 1) % {N_FLOWS}), concat('f', (id + 5) % {N_FLOWS})) AS edge_flows",
    )


def tools(spark: SparkSession) -> DataFrame:
    """name, _flows, internal_component."""
    return spark.range(N_TOOLS).selectExpr(
        "concat('t', id) AS name", f"IF(id = 7, array('*'), transform(sequence(0, 3), x -> concat('f', (id * 2 + x * 5) % {N_FLOWS}))) AS _flows", "id = 5 AS internal_component"
    )


def configs(spark: SparkSession) -> DataFrame:
    """config_id, model, provider, rate_in, rate_out; c2 has no price."""
    return spark.createDataFrame(
        [("c0", "m0", "google", 0.5, 2.0), ("c1", "m1", "gemma", 1.5, 6.0), ("c2", "m2", "other", None, None), ("c9", "m9", "other", 3.0, 9.0)],
        "config_id string, model string, provider string, rate_in double, rate_out double",
    )


def corpora(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two corpora out of documents: source eval or synth, convo_id, flow, intent, category, utterance, tools."""
    return table(spark, sf_dir, "documents").selectExpr(
        "IF(doc_id % 2 = 0, 'eval', 'synth') AS source", "doc_id AS convo_id", "concat('f', (n_chars + IF(doc_id % 2 = 0, 0, doc_id % 3)) % 9) AS flow", "lang AS intent",
        "concat('g', doc_id % 4) AS category", "CAST(doc_id % 2 * 2 + 1 AS INT) AS turn_num", "text AS utterance",
        "filter(array(IF(n_chars % 5 = 0, NULL, concat('t', n_chars % 7)), IF(n_chars % 3 = 0, concat('t', n_chars % 4), NULL)), x -> x IS NOT NULL) AS tools",
    )


#: The same views for DuckDB, to be put into WITH.
CTE = {
    "turns": """turns AS (SELECT convo_id, turn_num, speaker, utterance, category, 'f' || k AS flow, 'i' || (k // 3) AS intent,
  CASE WHEN (convo_id + turn_num) % 5 = 0 THEN ['f' || k, 'f' || ((k + 1) % 12)] ELSE []::VARCHAR[] END AS candidate_flows, 'd' || (convo_id % 2) AS domain, (convo_id * 3 + turn_num) % 19 = 0 AS exclude, k
  FROM (SELECT conv_id AS convo_id, turn::INTEGER AS turn_num, CASE role WHEN 'assistant' THEN 'agent' ELSE role END AS speaker, text AS utterance,
    CASE conv_id % 4 WHEN 0 THEN 'same_flow' WHEN 1 THEN 'switch_flow' WHEN 2 THEN 'ambiguous_first' ELSE 'ambiguous_second' END AS category, (length(text) % 12)::INTEGER AS k FROM conversations)),
gold AS (SELECT * FROM turns WHERE speaker = 'user')""",
    "preds": """preds AS (SELECT voter, 'c' || (voter % 3) AS config_id, (voter // 3 + 1)::INTEGER AS seed, domain, convo_id, turn_num,
  CASE WHEN (convo_id * 11 + turn_num + voter) % 17 = 0 THEN []::VARCHAR[] WHEN (convo_id + turn_num + voter) % 5 = 0 THEN ['f' || p, 'f' || ((p + 1) % 12)] ELSE ['f' || p] END AS detected_flows,
  ((n * 13 + voter * 101) % 2000)::BIGINT AS latency_ms, n::BIGINT AS input_tokens, (10 + voter)::BIGINT AS output_tokens
  FROM (SELECT convo_id, turn_num, domain, voter, length(utterance) AS n, (k + CASE WHEN (convo_id * 7 + turn_num * 3 + voter * 5) % 4 = 0 THEN 1 ELSE 0 END) % 12 AS p
        FROM gold, (SELECT unnest(range(5))::INTEGER AS voter) WHERE (convo_id + turn_num * 2 + voter) % 23 <> 0))""",
    "tool_turns": """tool_turns AS (SELECT convo_id, turn_num, category, flow, domain, k, candidate_flows, exclude, length(utterance) AS n, voter,
  list_filter([CASE WHEN k <> 11 THEN 't' || (k % 6) END, CASE WHEN k % 3 = 0 THEN 't' || ((k + 2) % 6) END, CASE WHEN k % 4 = 0 THEN 't' || ((k + 3) % 6) END], lambda x: x IS NOT NULL) AS gold_tools,
  list_filter([CASE WHEN (convo_id + turn_num + voter) % 13 <> 0 THEN 't' || ((k + CASE WHEN (convo_id * 5 + turn_num + voter * 3) % 4 = 0 THEN 1 ELSE 0 END) % 6) END,
    CASE WHEN (convo_id + voter) % 3 = 0 THEN 't' || ((k + 2) % 6) END, CASE WHEN (turn_num + voter) % 4 = 0 THEN 't6' END, CASE WHEN (convo_id + turn_num) % 7 = 0 THEN 't7' END,
    CASE WHEN (convo_id * 3 + voter) % 29 = 0 THEN 'handle_ambiguity' END], lambda x: x IS NOT NULL) AS predicted_tools
  FROM gold, (SELECT unnest(range(5))::INTEGER AS voter))""",
    "calib": "calib AS (SELECT doc_id, (n_chars % 11) / 10::DOUBLE AS confidence, quality = 1 AS correct, lang AS domain, source AS category FROM labels JOIN documents USING (doc_id))",
    "votes": "votes AS (SELECT user_id AS item, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rater, event_type AS category FROM events)",
    "raters": """raters AS (SELECT item, rater, category FROM (SELECT *, count(*) OVER (PARTITION BY item) AS n FROM (
  SELECT item || ':' || ((rater - 1) // 5) AS item, (rater - 1) % 5 + 1 AS rater, category FROM votes)) WHERE n = 5)""",
    "flows": """flows AS (SELECT 'f' || id AS name, CASE id // 3 WHEN 2 THEN 'Plan' WHEN 3 THEN 'Internal' ELSE 'i' || (id // 3) END AS intent, '{' || printf('%03X', id * 37) || '}' AS dax,
  ['f' || ((id + 1) % 12), 'f' || ((id + 5) % 12)] AS edge_flows FROM (SELECT unnest(range(12)) AS id))""",
    "tools": """tools AS (SELECT 't' || id AS name, CASE WHEN id = 7 THEN ['*'] ELSE list_transform(range(4), lambda x: 'f' || ((id * 2 + x * 5) % 12)) END AS _flows, id = 5 AS internal_component FROM (SELECT unnest(range(8)) AS id))""",
    "configs": "configs(config_id, model, provider, rate_in, rate_out) AS (VALUES ('c0', 'm0', 'google', 0.5::DOUBLE, 2::DOUBLE), ('c1', 'm1', 'gemma', 1.5::DOUBLE, 6::DOUBLE), ('c2', 'm2', 'other', NULL, NULL), ('c9', 'm9', 'other', 3::DOUBLE, 9::DOUBLE))",
    "corpora": """corpora AS (SELECT CASE WHEN doc_id % 2 = 0 THEN 'eval' ELSE 'synth' END AS source, doc_id AS convo_id, 'f' || ((n_chars + CASE WHEN doc_id % 2 = 0 THEN 0 ELSE doc_id % 3 END) % 9) AS flow, lang AS intent,
  'g' || (doc_id % 4) AS category, (doc_id % 2 * 2 + 1)::INTEGER AS turn_num, text AS utterance,
  list_filter([CASE WHEN n_chars % 5 <> 0 THEN 't' || (n_chars % 7) END, CASE WHEN n_chars % 3 = 0 THEN 't' || (n_chars % 4) END], lambda x: x IS NOT NULL) AS tools FROM documents)""",
}
_NEEDS = {"preds": ["turns"], "raters": ["votes"], "tool_turns": ["turns"]}


def with_views(names: str, body: str) -> str:
    """DuckDB SQL: WITH the named views, then ``body`` (a SELECT, or further CTEs and a SELECT after a leading comma)."""
    order: list[str] = []
    for n in names.split():
        order += [x for x in [*_NEEDS.get(n, []), n] if x not in order]
    return "WITH " + ",\n".join(CTE[n] for n in order) + (body if body.lstrip().startswith(",") else "\n" + body)
