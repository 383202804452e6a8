"""Comparison of two corpora by distributions. A corpus pair is a table with a ``source`` column, eval or synth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from turnwise.functions import statistics as S


def aligned(rows: DataFrame, value: str, keys: list[str] = []) -> DataFrame:  # noqa: B006
    """keys, value, n_eval, n_synth, p, q: the outer union of values, zero-filled. One pre-aggregated pass, no join of counts."""
    side = lambda s: F.count_if(F.col("source") == s)
    c = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(side("eval").alias("n_eval"), side("synth").alias("n_synth"))
    w = Window.partitionBy(*keys)
    share = lambda n: F.col(n) / F.nullif(F.sum(n).over(w), F.lit(0))
    return c.withColumn("p", share("n_eval")).withColumn("q", share("n_synth"))


def js_distance(table: DataFrame, keys: list[str] = []) -> DataFrame:  # noqa: B006
    """sqrt of the Jensen-Shannon divergence (natural log); 1.0 if a side is empty."""
    m = (F.col("p") + F.col("q")) / 2
    part = lambda x: F.sum(F.when(F.col(x) > 0, F.col(x) * F.log(F.col(x) / m)))
    d = F.greatest(F.lit(0.0), (F.coalesce(part("p"), F.lit(0.0)) + F.coalesce(part("q"), F.lit(0.0))) / 2)
    empty = (F.coalesce(F.sum("n_eval"), F.lit(0)) == 0) | (F.coalesce(F.sum("n_synth"), F.lit(0)) == 0)
    return table.groupBy(*keys).agg(F.round(F.when(empty, 1.0).otherwise(F.sqrt(d)), 6).alias("jsd"))


def chi_square(table: DataFrame, keys: list[str] = []) -> DataFrame:  # noqa: B006
    """Goodness of fit of synth to eval, chi2, dof and p: values unseen in eval are dropped, expectations rescaled to the observed total.

    Where either side is empty the statistic is 0 and p is 1.
    """
    w = Window.partitionBy(*keys)
    t = table.where("n_eval > 0").withColumn("e", F.col("n_eval") * F.sum("n_synth").over(w) / F.sum("n_eval").over(w))
    c = t.groupBy(*keys).agg(F.coalesce(F.sum(F.pow(F.col("n_synth") - F.col("e"), 2) / F.nullif("e", F.lit(0.0))), F.lit(0.0)).alias("x"), (F.count(F.lit(1)) - 1).alias("dof"))
    return c.select(*keys, F.round("x", 4).alias("chi2"), "dof", F.round(S.chi_square_tail(F.col("x"), F.col("dof").cast("double")), 6).alias("p"))


def entropy(rows: DataFrame, value: str, keys: list[str] = []) -> DataFrame:  # noqa: B006
    """Bits, number of values and uniformity (entropy over its maximum)."""
    w = Window.partitionBy(*keys)
    c = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    p = c.withColumn("p", F.col("n") / F.sum("n").over(w))
    h = -F.sum(F.col("p") * F.log2("p"))
    n = F.count(F.lit(1))
    return p.groupBy(*keys).agg(F.round(h, 6).alias("entropy"), n.alias("n_unique"), F.round(F.when(n > 1, h / F.log2(n)).otherwise(F.lit(0.0)), 6).alias("uniformity"))


def flagged(table: DataFrame, value: str) -> DataFrame:
    """Values whose share ratio synth to eval lies outside [0.5, 2]; null ratio where eval has none."""
    ratio = F.round(F.col("q") / F.nullif("p", F.lit(0.0)), 6)
    return table.withColumn("ratio", ratio).where("ratio IS NULL OR ratio < 0.5 OR ratio > 2").select(value, "n_eval", "n_synth", "ratio")


def length_stats(rows: DataFrame, value: Column, keys: list[str]) -> DataFrame:
    x = rows.select(*keys, value.alias("x"))
    return x.groupBy(*keys).agg(
        F.round(F.avg("x"), 4).alias("mean"), F.round(F.percentile("x", 0.5), 4).alias("median"), F.round(F.stddev_pop("x"), 4).alias("std"),
        F.round(F.percentile("x", 0.1), 4).alias("p10"), F.round(F.percentile("x", 0.9), 4).alias("p90"),
    )


def ks_statistic(rows: DataFrame, value: str, keys: list[str] = []) -> DataFrame:  # noqa: B006
    """Two-sample Kolmogorov-Smirnov, ks and its p by the limit law: windows run over distinct values only."""
    c = rows.groupBy(*keys, value).agg(F.count_if(F.col("source") == "eval").alias("a"), F.count_if(F.col("source") == "synth").alias("b"))
    run = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy(*keys)
    f = lambda x: F.sum(x).over(run) / F.nullif(F.sum(x).over(every), F.lit(0))
    gaps = c.select(*keys, "a", "b", F.abs(f("a") - f("b")).alias("gap")).groupBy(*keys).agg(F.max("gap").alias("d"), F.sum("a").alias("n"), F.sum("b").alias("m"))
    return gaps.select(*keys, F.round("d", 6).alias("ks"), F.round(S.kolmogorov_tail(F.col("d"), F.col("n"), F.col("m")), 6).alias("p"))


def transitions(turns: DataFrame) -> DataFrame:
    """convo_id, from_flow, to_flow of the first two user turns. Bounded work per conversation, pre-aggregated."""
    firsts = turns.where("speaker = 'user'").groupBy("convo_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("turn_num", "flow"))), 1, 2).alias("f")).where("size(f) = 2")
    return firsts.select("convo_id", F.col("f")[0]["flow"].alias("from_flow"), F.col("f")[1]["flow"].alias("to_flow"))


def mean_cosine(vectors: DataFrame, key: str, vec: str, include_diagonal: bool = True) -> DataFrame:
    """Mean pairwise cosine within and across groups of unit vectors: the dot product of mean vectors, so linear in rows."""
    e = vectors.select(key, F.posexplode(vec).alias("i", "x")).groupBy(key, "i").agg(F.avg(F.col("x").cast("double")).alias("m"), F.count(F.lit(1)).alias("n"))
    a, b = e.alias("a"), e.alias("b")
    j = a.join(b, F.col("a.i") == F.col("b.i")).where(F.col(f"a.{key}") <= F.col(f"b.{key}"))
    out = j.groupBy(F.col(f"a.{key}").alias("left"), F.col(f"b.{key}").alias("right")).agg(F.sum(F.col("a.m") * F.col("b.m")).alias("c"), F.max("a.n").alias("n"))
    if not include_diagonal:
        out = out.withColumn("c", F.when(F.col("left") == F.col("right"), (F.col("c") * F.col("n") - 1) / (F.col("n") - 1)).otherwise(F.col("c")))
    return out.select("left", "right", (F.round("c", 4) + 0.0).alias("cosine"))


def welch_t(rows: DataFrame, value: Column) -> DataFrame:
    """The t statistic of eval against synth with unequal variances, its degrees of freedom and two-sided p."""
    x = rows.select("source", value.cast("double").alias("x"))
    of = lambda f, s: f(F.when(F.col("source") == s, F.col("x")))
    s = x.agg(*[of(f, side).alias(f"{n}_{side}") for side in ("eval", "synth") for f, n in ((F.avg, "m"), (F.var_samp, "v"), (F.count, "n"))])
    a, b = F.col("v_eval") / F.col("n_eval"), F.col("v_synth") / F.col("n_synth")
    dof = F.pow(a + b, 2) / (F.pow(a, 2) / (F.col("n_eval") - 1) + F.pow(b, 2) / (F.col("n_synth") - 1))
    s = s.select(((F.col("m_eval") - F.col("m_synth")) / F.sqrt(a + b)).alias("_t"), dof.alias("_dof"))  # names that no output column has: inside a lambda Spark takes that first
    return s.select(F.round("_t", 4).alias("t"), F.round("_dof", 2).alias("dof"), F.round(S.t_tails(F.col("_t"), F.col("_dof")), 6).alias("p"))


def principal_components(vectors: DataFrame, key: str, vec: str, k: int = 2) -> DataFrame:
    """key, pc1 ... pck: coordinates of the centred vectors on their principal components.

    The sign of a component is free; here its largest loading (ties: the first) is positive.
    """
    import numpy as np
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.stat import Summarizer

    v = vectors.select(key, vec, array_to_vector(vec).alias("_v"))
    loadings = PCA(k=k, inputCol="_v", outputCol="_p").fit(v).pc.toArray()  # dimensions x k
    mean = v.select(Summarizer.mean(F.col("_v")).alias("m")).first()["m"].toArray()
    loadings = loadings * np.sign(loadings[np.abs(loadings).argmax(axis=0), np.arange(k)])
    centred = F.zip_with(F.col(vec), F.array(*[F.lit(float(x)) for x in mean]), lambda x, m: x - m)
    on = lambda j: F.aggregate(F.zip_with(centred, F.array(*[F.lit(float(x)) for x in loadings[:, j]]), lambda x, w: x * w), F.lit(0.0), lambda a, x: a + x)
    return vectors.select(key, *[F.round(on(j), 6).alias(f"pc{j + 1}") for j in range(k)])


def topics(vectors: DataFrame, vec: str, k: int = 8, seed: int = 42):
    """``vectors`` with topic, by k-means on coordinates scaled to unit deviation, and the centres in that scale (k lists)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import StandardScaler
    from pyspark.ml.functions import array_to_vector

    v = vectors.withColumn("_v", array_to_vector(vec))
    scaled = StandardScaler(inputCol="_v", outputCol="_s", withMean=False, withStd=True).fit(v).transform(v)
    model = KMeans(k=k, seed=seed, maxIter=50, featuresCol="_s", predictionCol="topic").fit(scaled)
    return model.transform(scaled).drop("_v", "_s"), [c.tolist() for c in model.clusterCenters()]


def topic_coverage(assigned: DataFrame) -> DataFrame:
    """topic, n_eval, n_synth, kind (covered, eval_only, synth_only), and coverage: the share of topics with eval rows that hold synth rows too (1.0 if none has)."""
    side = lambda s: F.count_if(F.col("source") == s)
    t = assigned.groupBy("topic").agg(side("eval").alias("n_eval"), side("synth").alias("n_synth"))
    kind = F.when((F.col("n_eval") > 0) & (F.col("n_synth") > 0), "covered").when(F.col("n_eval") > 0, "eval_only").otherwise("synth_only")
    every = Window.partitionBy(F.lit(0))  # k rows
    t = t.withColumn("kind", kind)
    held = F.sum((F.col("n_eval") > 0).cast("int")).over(every)
    share = F.sum((F.col("kind") == "covered").cast("int")).over(every) / F.nullif(held, F.lit(0))
    return t.withColumn("coverage", F.round(F.coalesce(share, F.lit(1.0)), 6))
