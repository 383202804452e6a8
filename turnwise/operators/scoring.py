"""Scoring and voting as column builders and grouped DataFrame operators. Every tie has an explicit rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from turnwise.operators.relational import answer_key


def clear_score(detected: Column, flow: Column) -> Column:
    """Exactly one detected flow, the right one."""
    return F.coalesce((F.size(detected) == 1) & (F.get(detected, F.lit(0)) == flow), F.lit(False))


def hash_pick(items: Column, *keys: Column) -> Column:
    """A pick that is random in effect and the same in every run: an integer recurrence of the keys, modulo the length."""
    seed = F.lit(0).cast("long")
    for k in keys:
        seed = (seed * 1103515245 + k.cast("long") * 12345 + 7919) % 2147483647
    return F.get(items, F.pmod(seed, F.greatest(F.size(items), F.lit(1))).cast("int"))


def ambiguous_score(detected: Column, candidates: Column, *keys: Column) -> Column:
    """Recognised (at least two flows) and the picked one is a candidate."""
    return (F.size(detected) >= 2) & F.coalesce(F.array_contains(candidates, hash_pick(detected, *keys)), F.lit(False))


def ambiguous_expected(detected: Column, candidates: Column) -> Column:
    """The probability that a uniform pick of a recognised answer is a candidate."""
    inside = F.size(F.filter(detected, lambda x: F.array_contains(candidates, x)))
    return F.when(F.size(detected) >= 2, inside / F.size(detected)).otherwise(F.lit(0.0))


def set_vote(votes: DataFrame, keys: list[str], flows: str = "detected_flows", voter: str = "voter", weight: Column | None = None) -> DataFrame:
    """Majority over whole answer sets. Empty answers leave the denominator; ties go to the set of the first voter.

    Returns keys, answer (flows joined by "|", empty if nobody answered), confidence (4 digits).
    """
    w = F.lit(1.0) if weight is None else weight.cast("double")
    v = votes.select(*keys, answer_key(F.col(flows)).alias("answer"), F.col(voter).alias("_v"), w.alias("_w"))
    per = v.groupBy(*keys, "answer").agg(F.sum("_w").alias("_w"), F.min("_v").alias("_first"))
    live = F.col("answer") != ""
    order = F.struct(F.col("_w"), -F.col("_first"))
    total = F.sum(F.when(live, F.col("_w")))
    return per.groupBy(*keys).agg(
        F.coalesce(F.max_by(F.when(live, F.col("answer")), F.when(live, order)), F.lit("")).alias("answer"),
        F.round(F.coalesce(F.max(F.when(live, F.col("_w"))) / total, F.lit(0.0)), 4).alias("confidence"),
    )


def scalar_vote(votes: DataFrame, keys: list[str], vote: str, voter: str = "voter", weight: Column | None = None) -> DataFrame:
    """Weighted majority of single values; null votes are ignored; ties go to the value of the first voter."""
    w = F.lit(1.0) if weight is None else weight.cast("double")
    v = votes.where(F.col(vote).isNotNull()).select(*keys, F.col(vote).alias("answer"), F.col(voter).alias("_v"), w.alias("_w"))
    per = v.groupBy(*keys, "answer").agg(F.sum("_w").alias("_w"), F.min("_v").alias("_first"))
    return per.groupBy(*keys).agg(
        F.max_by("answer", F.struct(F.col("_w"), -F.col("_first"))).alias("answer"),
        F.round(F.max("_w") / F.sum("_w"), 4).alias("confidence"),
    )


def element_vote(votes: DataFrame, keys: list[str], items: str, voters: Column) -> DataFrame:
    """Items that at least half of the voters (rounded up) named."""
    named = votes.select(*keys, voters.alias("_n"), F.explode(F.array_distinct(F.col(items))).alias("item"))
    return named.groupBy(*keys, "item").agg(F.count(F.lit(1)).alias("votes"), F.max("_n").alias("_n")).where(F.col("votes") >= F.ceil(F.col("_n") / 2)).drop("_n")


def ensemble_ambiguous(votes: DataFrame, keys: list[str]) -> DataFrame:
    """recognised: any voter with two flows, or the top set held by at most half of the active; selected: the modal flow
    (ties to the first voter's, then by name) is a candidate."""
    sets = votes.select(*keys, "voter", "candidate_flows", "detected_flows", answer_key(F.col("detected_flows")).alias("answer")).where("answer <> ''")
    per_set = sets.groupBy(*keys, "answer").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("detected_flows") >= 2).alias("many"))
    seen = per_set.groupBy(*keys).agg((F.max("many") | (F.max("n") * 2 <= F.sum("n"))).alias("recognised"))
    flows = sets.select(*keys, "voter", "candidate_flows", F.explode("detected_flows").alias("flow"))
    per_flow = flows.groupBy(*keys, "flow").agg(F.count(F.lit(1)).alias("n"), F.min("voter").alias("first"), F.first("candidate_flows").alias("c"))
    picked = per_flow.groupBy(*keys).agg(F.min_by(F.struct("flow", "c"), F.struct(-F.col("n"), F.col("first"), F.col("flow"))).alias("p"))
    out = seen.join(picked, keys)
    return out.select(*keys, "recognised", F.col("p.flow").alias("picked"), (F.col("recognised") & F.array_contains("p.c", F.col("p.flow"))).alias("correct"))


def intent_score(detected: Column, intent: Column, candidates: Column) -> Column:
    norm = lambda c: F.lower(F.trim(c))
    low = F.transform(F.coalesce(candidates, F.array().cast("array<string>")), norm)
    return F.when(F.size(low) > 0, F.array_contains(low, norm(detected))).otherwise(norm(detected) == norm(intent))


def tool_score(predicted: Column, gold: Column, candidates: Column, freebies: list[str]) -> Column:
    """struct(correct, precision, recall): recall floor of half the gold tools, a precision gate from three tools that aren't free on."""
    free = F.array(*[F.lit(x) for x in freebies])
    p, g = F.array_distinct(predicted), F.array_distinct(gold)
    paid = F.array_except(p, F.array_except(free, g))
    hits = F.size(F.array_intersect(p, g))
    precision = F.when(F.size(paid) == 0, F.lit(1.0)).otherwise(hits / F.size(paid))
    recall = F.when(F.size(g) == 0, F.lit(1.0)).otherwise(hits / F.size(g))
    made = lambda c, x, y: F.struct(c.alias("correct"), F.round(x, 4).alias("precision"), F.round(y, 4).alias("recall"))
    yes, no, one, zero = F.lit(True), F.lit(False), F.lit(1.0), F.lit(0.0)
    enough = (hits >= F.ceil(F.size(g) / 2)) & ((F.size(paid) < 3) | (precision >= 0.5))
    return (
        F.when((F.size(candidates) > 0) & F.array_contains(p, "handle_ambiguity"), made(yes, one, one))
        .when((F.size(g) == 0) & (F.size(p) == 0), made(yes, one, one))
        .when(F.size(g) == 0, made(F.size(paid) == 0, F.when(F.size(paid) == 0, one).otherwise(zero), F.when(F.size(paid) == 0, one).otherwise(zero)))
        .when(F.size(p) == 0, made(no, zero, zero))
        .otherwise(made(enough, precision, recall))
    )


def normalised(value: Column) -> Column:
    return F.lower(F.trim(value.cast("string")))


def param_details(turns: DataFrame, methods: DataFrame) -> DataFrame:
    """A row per gold parameter with a value: method and match. The first call of a tool counts; an unknown method is an error row.

    ``turns``: key columns, gold map<tool, map<param, value>>, predicted array<struct<name, args map>>. ``methods``: tool, param, method.
    """
    keys = [c for c in turns.columns if c not in ("gold", "predicted")]
    g = turns.select(*keys, "predicted", F.explode("gold").alias("tool", "params")).select(*keys, "predicted", "tool", F.explode("params").alias("param", "want")).where("want IS NOT NULL")
    call = F.get(F.filter("predicted", lambda x: x["name"] == F.col("tool")), F.lit(0))
    g = g.withColumn("call", call).withColumn("got", F.try_element_at(F.col("call")["args"], F.col("param"))).join(methods, ["tool", "param"], "left")
    same = F.coalesce(normalised(F.col("want")) == normalised(F.col("got")), F.lit(False))
    kind = F.when(F.col("call").isNull(), "missing_tool").when(F.col("got").isNull(), "missing_param").when(F.col("method").isNull(), "error").otherwise(F.col("method"))
    return g.select(*keys, "tool", "param", kind.alias("method"), same.alias("match"))


def slot_score(detected: Column, schema_keys: Column, gold_keys: Column) -> Column:
    """struct(precision, recall, f1) over slot names; with an empty schema, all 1 when nothing is detected, else 0."""
    hit = F.size(F.array_intersect(detected, gold_keys))
    precision = F.when(F.size(detected) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(detected, schema_keys)) / F.size(detected))
    recall = F.when(F.size(gold_keys) == 0, F.lit(1.0)).otherwise(hit / F.size(gold_keys))
    none = F.size(schema_keys) == 0
    alone = F.when(F.size(detected) == 0, F.lit(1.0)).otherwise(F.lit(0.0))
    p, r = F.when(none, alone).otherwise(precision), F.when(none, alone).otherwise(recall)
    return F.struct(F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0)), 6).alias("f1"))


def advantages(rewards: DataFrame, group: list[str], reward: str) -> DataFrame:
    """2r - 1, z-scored in its group with the population deviation; groups without spread are dropped."""
    w = Window.partitionBy(*group)
    r = rewards.withColumn("_r", F.col(reward) * 2 - 1)
    r = r.withColumn("_m", F.avg("_r").over(w)).withColumn("_s", F.stddev_pop("_r").over(w)).where("_s > 0")
    return r.withColumn("advantage", (F.col("_r") - F.col("_m")) / F.col("_s")).drop("_r", "_m", "_s")
