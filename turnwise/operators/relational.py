"""Relational operators over conversations and predictions: flattening, scoping, joins, roll-ups, rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


# -- projections and filters ------------------------------------------------


def nest(turns: DataFrame) -> DataFrame:
    """One row a conversation with its turns in order: the nested form that readers deliver."""
    turn = F.struct("turn_num", "speaker", "utterance", "flow", "intent", "candidate_flows")
    return turns.groupBy("convo_id", "category").agg(F.array_sort(F.collect_list(turn)).alias("turns"))


def flatten(convos: DataFrame, speaker: str | None = None, default_model: str = "human") -> DataFrame:
    """One row a turn; ``_model`` falls back to ``default_model``."""
    model = F.coalesce(F.col("_model") if "_model" in convos.columns else F.lit(None).cast("string"), F.lit(default_model))
    out = convos.select("convo_id", "category", model.alias("model"), F.explode("turns").alias("t")).select("convo_id", "category", "model", "t.*")
    return out.where(F.col("speaker") == speaker) if speaker else out


def user_facing(flows: DataFrame) -> DataFrame:
    return flows.where(~F.col("intent").isin("Plan", "Internal"))


def candidate_set(flows: DataFrame, intents: DataFrame) -> DataFrame:
    """Flow names of ``intents`` with the flows one edge away, none of them Internal."""
    seeds = flows.join(intents, "intent", "left_semi")
    near = seeds.select(F.explode("edge_flows").alias("name"))
    wanted = seeds.select("name").union(near).distinct()
    return flows.where("intent <> 'Internal'").join(wanted, "name", "left_semi").select("name")


def tools_of_flow(tools: DataFrame, flow: str) -> DataFrame:
    """Tools that list the flow by name; a wildcard does not match."""
    return tools.where(~F.coalesce("internal_component", F.lit(False)) & F.array_contains("_flows", flow))


def flow_tool_index(tools: DataFrame) -> DataFrame:
    own = tools.where(~F.coalesce("internal_component", F.lit(False))).select("name", F.explode("_flows").alias("flow"))
    return own.groupBy("flow").agg(F.array_join(F.sort_array(F.collect_list("name")), ",").alias("tools"), F.count(F.lit(1)).alias("n_tools"))


def answer_key(flows: Column) -> Column:
    """A set of answers as a groupable string: distinct, sorted."""
    return F.array_join(F.array_sort(F.array_distinct(flows)), "|")


def skip_kind(ambiguous: Column, n_tools: Column) -> Column:
    """ambiguous, zero_tool, single_tool or call, the first that holds."""
    return F.when(ambiguous, "ambiguous").when(n_tools == 0, "zero_tool").when(n_tools == 1, "single_tool").otherwise("call")


def history(turns: DataFrame) -> DataFrame:
    """Each turn with the ordered texts before it. A frame of one conversation, so bounded by its length."""
    w = Window.partitionBy("convo_id").orderBy("turn_num").rowsBetween(Window.unboundedPreceding, -1)
    said = F.struct("turn_num", F.concat_ws(": ", "speaker", "utterance").alias("said"))
    return turns.withColumn("history", F.transform(F.array_sort(F.collect_list(said).over(w)), lambda x: x["said"]))


def sft_examples(turns: DataFrame, votes: DataFrame, prompt) -> DataFrame:
    """voter, convo_id, turn_num, label, messages: a training example for each labelled user turn of each voter.

    ``votes``: voter, convo_id, turn_num, label (null where the turn is not to be learnt). messages are ``prompt(voter)`` as
    system, every earlier message and the turn's own text. A user turn is followed by its label, or [skipped]; an agent turn is its text, or [OK].
    """
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    names = votes.select("voter", "convo_id").distinct()
    each = turns.select("convo_id", "turn_num", "speaker", "utterance").join(names, "convo_id").join(votes, ["voter", "convo_id", "turn_num"], "left")
    user = F.col("speaker") == "user"
    said = F.when(user, F.array(message("user", F.col("utterance")), message("assistant", F.coalesce("label", F.lit("[skipped]")))))
    said = said.otherwise(F.array(message("assistant", F.coalesce("utterance", F.lit("[OK]")))))
    w = Window.partitionBy("voter", "convo_id").orderBy("turn_num").rowsBetween(Window.unboundedPreceding, -1)  # one conversation
    before = F.transform(F.array_sort(F.collect_list(F.struct("turn_num", "said")).over(w)), lambda x: x["said"])
    told = each.withColumn("said", said).withColumn("before", F.flatten(before)).where(user & F.col("label").isNotNull())
    messages = F.concat(F.array(message("system", prompt(F.col("voter")))), "before", F.array(message("user", F.col("utterance"))))
    return told.select("voter", "convo_id", "turn_num", "label", messages.alias("messages"))


def patch(base: DataFrame, fixes: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Sparse overrides: a non-null field of ``fixes`` replaces that of ``base``."""
    fx = fixes.select(*keys, *[F.col(c).alias(f"_{c}") for c in fields])
    out = base.join(fx, keys, "left")
    return out.withColumns({c: F.coalesce(F.col(f"_{c}"), F.col(c)) for c in fields}).drop(*[f"_{c}" for c in fields])


def last_wins(rows: DataFrame, keys: list[str], ordinal: str) -> DataFrame:
    """The row with the largest ordinal of each key, without a sort: max_by pre-aggregates map-side."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), ordinal).alias("r")).select(*keys, "r.*")


def counted(rows: DataFrame, group: list, order: str | list, bucket: Column) -> DataFrame:
    """``pos`` from 1 in the order of ``order`` within each group (expressions), in two levels, so that no task orders a whole group.

    ``bucket`` must not fall as ``order`` rises. Rows are counted per bucket, the small table of counts is summed up, and
    only the rows of one bucket are ordered together.
    """
    keys, order = [f"_g{i}" for i in range(len(group))], order if isinstance(order, list) else [order]
    dealt = rows.withColumns({**dict(zip(keys, group, strict=True)), "_bucket": bucket})
    sizes = dealt.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(*keys, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = dealt.withColumn("_r", F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy(*order)))
    return own.join(sizes, [*keys, "_bucket"]).withColumn("pos", F.col("_before") + F.col("_r")).drop(*keys, "_bucket", "_n", "_r", "_before")


def renumber(rows: DataFrame, order: str, prefix: Column, bucket: Column) -> DataFrame:
    """{prefix}_{position of ``order`` within the prefix, at least three digits}; ``bucket`` as in :func:`counted`."""
    digits = F.col("pos").cast("string")
    out = counted(rows, [prefix], order, bucket)
    return out.withColumn("new_id", F.concat(prefix, F.lit("_"), F.lpad(digits, F.greatest(F.lit(3), F.length(digits)), F.lit("0")))).drop("pos")


# -- joins ------------------------------------------------------------------

#: Most names of a dimension that a plan writes out.
MAX_VOTERS = 1000


def align(gold: DataFrame, preds: DataFrame, voters: DataFrame) -> DataFrame:
    """Gold x voters with predictions; a missing one is an empty list, never a missing row.

    Each gold row carries the list of ``voters`` (a dimension of at most MAX_VOTERS names), so nothing is cross-joined.
    """
    names = [r[0] for r in voters.select("voter").distinct().orderBy("voter").limit(MAX_VOTERS + 1).collect()]
    if len(names) > MAX_VOTERS:
        raise ValueError(f"more than {MAX_VOTERS} voters")
    kind = voters.schema["voter"].dataType.simpleString()
    keyed = gold.withColumn("voter", F.explode(F.array(*[F.lit(n) for n in names]).cast(f"array<{kind}>")))
    p = preds.select("voter", "convo_id", "turn_num", "detected_flows")
    return keyed.join(p, ["voter", "convo_id", "turn_num"], "left").withColumn("detected_flows", F.coalesce("detected_flows", F.array().cast("array<string>")))


def edge_pairs(flows: DataFrame) -> DataFrame:
    """Unordered pairs of user-facing flows that an edge connects."""
    ok = user_facing(flows)
    e = ok.select(F.col("name").alias("a"), F.explode("edge_flows").alias("b"))
    e = e.join(ok.select(F.col("name").alias("b")), "b", "left_semi")
    return e.select(F.least("a", "b").alias("flow_a"), F.greatest("a", "b").alias("flow_b")).where("flow_a <> flow_b").distinct()


# -- aggregates -------------------------------------------------------------


def rate(flag: Column) -> Column:
    """Share of true rows to six digits from integer counts; 0.0 over nothing."""
    n = F.count(flag)
    return F.round(F.when(n > 0, F.sum(flag.cast("long")) / n).otherwise(F.lit(0.0)), 6)


def accuracy_by(results: DataFrame, *keys: str) -> DataFrame:
    return results.groupBy(*keys).agg(rate(F.col("correct")).alias("accuracy"), F.count(F.lit(1)).alias("n"))


def confusion(results: DataFrame, names: list[str] | None = None) -> DataFrame:
    r = results.where(F.col("detected").isNotNull())
    if names is not None:
        r = r.where(F.col("flow").isin(names) & F.col("detected").isin(names))
    return r.groupBy("flow", "detected").agg(F.count(F.lit(1)).alias("n"))


def cost(tokens: DataFrame, prices: DataFrame, key: str = "config_id") -> DataFrame:
    """(input x rate_in + output x rate_out) / 1e6; a missing price is 1."""
    j = tokens.join(F.broadcast(prices.select(key, "rate_in", "rate_out")), key, "left")  # a price list
    one = F.lit(1.0)
    return j.withColumn("cost", (F.col("tokens_in") * F.coalesce("rate_in", one) + F.col("tokens_out") * F.coalesce("rate_out", one)) / 1e6)


def top_per_group(rows: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    w = Window.partitionBy(*group).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def ranked(rows: DataFrame, order: list[Column]) -> DataFrame:
    """Rank over all rows: for results that are already small aggregates."""
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(*order)))
