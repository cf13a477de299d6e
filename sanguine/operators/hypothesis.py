"""Which test compares the methods of a result set, and what it says: normality, equal variances, omnibus and pairs.

A result set is a set of cells (set, block, method, value): a value for each method on each block, a data set or a video. Many sets are tested by
one plan; each takes the branch that its own values call for. All but the tail probabilities of the few result rows are grouped aggregates.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tails import f_tail, normal_quantile, per_row, signed_rank_tail, studentised_tail
from .stats import ASCENDING, chi2_tail


def cells(results: DataFrame, metrics: tuple[str, ...] = ("MAE",), block: str = "dataset", by: tuple[str, ...] = ()) -> DataFrame:
    """(set, block, method, value): medians by block and method of each metric, device prefixes stripped; `set` is the metric, after the values of `by`.

    Only blocks that have all methods of their set are kept; NULL and NaN values don't count.
    """
    name = F.regexp_replace("method", "^(?i)(cupy_|cpu_|torch_)", "")
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])).alias("x")
    rows = results.select(*by, F.col(block).cast("string").alias("block"), name.alias("method"), each)
    rows = rows.select(F.concat_ws("|", *[F.col(c).cast("string") for c in by], "x.metric").alias("set"), "block", "method", F.col("x.value").alias("value"))
    rows = rows.filter(F.col("value").isNotNull() & ~F.isnan("value")).groupBy("set", "block", "method").agg(F.median("value").alias("value"))
    methods = rows.groupBy("set").agg(F.count_distinct("method").alias("k"))
    whole = rows.groupBy("set", "block").agg(F.count("*").alias("k")).join(methods, ["set", "k"]).select("set", "block")
    return rows.join(whole, ["set", "block"])


def normality(rows: DataFrame) -> DataFrame:
    """(set, method, n, w, p): Shapiro and Francia's W', the squared correlation of the ordered values with Blom's normal scores, and Royston's probability (1993).

    From five values on; NULL below, and where all values are equal. The ranks come from a sort, of which a task sees a method of a set as a stream.
    """
    own = Window.partitionBy("set", "method")
    placed = rows.select("set", "method", "value", F.row_number().over(own.orderBy("value")).alias("r"), F.count("*").over(own).alias("n"))
    scored = placed.withColumn("m", normal_quantile((F.col("r") - 0.375) / (F.col("n") + 0.25)))
    w = F.when((F.max("n") > 4) & (F.max("value") > F.min("value")), F.try_divide(F.pow(F.covar_pop("value", "m"), 2), F.var_pop("value") * F.var_pop("m")))
    out = scored.groupBy("set", "method").agg(F.max("n").alias("n"), w.alias("w"))
    u = F.ln(F.ln("n")) - F.ln("n")
    v = F.ln(F.ln("n")) + F.try_divide(F.lit(2.0), F.ln("n"))
    z = F.try_divide(F.ln(F.when(F.col("w").isNotNull(), F.greatest(1 - F.col("w"), F.lit(1e-15)))) - (-1.2725 + 1.0521 * u), 1.0308 - 0.26758 * v)
    return out.withColumn("p", per_row(lambda x: 0.5 * math.erfc(x / math.sqrt(2)))(z))


def equal_variances(rows: DataFrame) -> DataFrame:
    """(set, k, cells, f, p): Brown and Forsythe's test, the one-way analysis of the values' distances from their method's median. NULL where no distance varies within a method."""
    mid = rows.groupBy("set", "method").agg(F.median("value").alias("mid"))
    far = rows.join(mid, ["set", "method"]).select("set", "method", F.abs(F.col("value") - F.col("mid")).alias("d"))
    by_method = far.groupBy("set", "method").agg(F.count("*").alias("n"), F.avg("d").alias("mean"), F.var_pop("d").alias("var"))
    total = by_method.groupBy("set").agg(F.count("*").alias("k"), F.sum("n").alias("cells"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("__all"), F.sum(F.col("n") * F.col("var")).alias("__within"))
    between = by_method.join(total, "set").groupBy("set").agg(F.sum(F.col("n") * F.pow(F.col("mean") - F.col("__all"), 2)).alias("__between"))
    f = F.try_divide((F.col("cells") - F.col("k")) * F.col("__between"), (F.col("k") - 1) * F.col("__within"))
    return total.join(between, "set").select("set", "k", "cells", f.alias("f")).withColumn("p", per_row(f_tail)("f", F.col("k") - 1, F.col("cells") - F.col("k")))


def choice(rows: DataFrame, alpha: float = 0.05) -> DataFrame:
    """(set, k, n, normal, equal, test): `anova` where every method's values may be normal (alpha shared by the methods) and their variances
    equal, or where two normal methods are compared in pairs; else `wilcoxon` for two methods and `friedman` for more. `none` for one method.
    Fewer than five blocks, or values that are all equal, are not taken for normal."""
    bound = normality(rows).groupBy("set").agg(F.count("*").alias("k"), F.max("n").alias("n"), F.min(F.coalesce("p", F.lit(-1.0))).alias("least"))
    spread = equal_variances(rows).select("set", F.coalesce(F.col("p") >= alpha, F.lit(False)).alias("equal"))
    normal = F.col("least") >= alpha / F.col("k")
    test = F.when(F.col("k") < 2, "none").when(normal & (F.col("equal") | (F.col("k") == 2)), "anova").when(F.col("k") == 2, "wilcoxon").otherwise("friedman")
    return bound.join(spread, "set").withColumn("normal", normal).withColumn("test", test).select("set", "k", "n", "normal", "equal", "test")


def _of(rows: DataFrame, chosen: DataFrame, test: str) -> DataFrame:
    """Cells of the sets that take a branch, with k and n; a row a set is joined in."""
    return rows.join(chosen.filter(F.col("test") == test).select("set", "k", "n"), "set")


def _repeated(rows: DataFrame) -> DataFrame:
    """(set, k, n, f, mse): analysis of variance of repeated measures, methods against what is left beside methods and blocks. From centred sums."""
    mean = F.avg("value").over(Window.partitionBy("set"))
    centred = rows.select("set", "k", "n", "block", "method", (F.col("value") - mean).alias("v"))
    total = centred.groupBy("set", "k", "n").agg(F.sum(F.col("v") * F.col("v")).alias("total"))
    part = lambda c: centred.groupBy("set", c).agg(F.avg("v").alias("m"), F.count("*").alias("c")).groupBy("set").agg(F.sum(F.col("c") * F.col("m") * F.col("m")).alias(f"by_{c}"))
    out = total.join(part("block"), "set").join(part("method"), "set")
    rest = F.greatest(F.col("total") - F.col("by_block") - F.col("by_method"), F.lit(0.0))
    mse = F.try_divide(rest, (F.col("k") - 1) * (F.col("n") - 1))
    return out.select("set", "k", "n", F.try_divide(F.try_divide(F.col("by_method"), F.col("k") - 1), mse).alias("f"), mse.alias("mse"))


def _ranks(rows: DataFrame) -> DataFrame:
    """rows with `rank` within the block, smallest first, equal ones averaged, and `same`, how many share it."""
    own, same = Window.partitionBy("set", "block").orderBy("value"), Window.partitionBy("set", "block", "value")
    return rows.withColumn("same", F.count("*").over(same)).withColumn("rank", F.rank().over(own) + (F.col("same") - 1) / 2)


def _friedman(rows: DataFrame) -> DataFrame:
    """(set, k, n, chi2): corrected for ties; NULL where all values of each block are equal."""
    ranked = _ranks(rows)
    ties = ranked.groupBy("set").agg(F.sum(F.col("same") * F.col("same") - 1).alias("ties"))
    means = ranked.groupBy("set", "k", "n", "method").agg(F.avg("rank").alias("rank"))
    k, n = F.col("k"), F.col("n")
    spread = means.groupBy("set", "k", "n").agg(F.sum(F.pow(F.col("rank") - (k + 1) / 2, 2)).alias("s")).join(ties, "set")
    return spread.select("set", "k", "n", F.try_divide(12 * n / (k * (k + 1)) * F.col("s"), 1 - F.try_divide(F.col("ties"), n * k * (k * k - 1))).alias("chi2"))


def _pairs_of_two(rows: DataFrame) -> DataFrame:
    """(set, w, m, ties): the smaller sum of signed ranks of the two methods' differences that aren't zero, their number, and t ** 3 - t summed over equal sizes."""
    d = rows.groupBy("set", "block").agg((F.max_by("value", "method") - F.min_by("value", "method")).alias("d")).filter("d <> 0")
    same = F.count("*").over(Window.partitionBy("set", F.abs("d")))
    ranked = d.select("set", "d", same.alias("t"), (F.rank().over(Window.partitionBy("set").orderBy(F.abs("d"))) + (same - 1) / 2).alias("r"))
    part = lambda c: F.sum(F.when(c, F.col("r")).otherwise(0.0))
    out = ranked.groupBy("set").agg(F.least(part(F.col("d") > 0), part(F.col("d") < 0)).alias("w"), F.count("*").alias("m"), F.sum(F.col("t") * F.col("t") - 1).cast("double").alias("ties"))
    return rows.select("set").distinct().join(out, "set", "left").select("set", F.coalesce("w", F.lit(0.0)).alias("w"), F.coalesce("m", F.lit(0)).alias("m"), F.coalesce("ties", F.lit(0.0)).alias("ties"))


def omnibus(rows: DataFrame, alpha: float = 0.05, chosen: DataFrame | None = None) -> DataFrame:
    """(set, k, n, normal, equal, test, statistic, dof1, dof2, p, differ) of each set: F of repeated measures, Friedman's chi square or Wilcoxon's W, by `choice`.

    p is NULL where the statistic has no value (nothing varies), and then the methods don't differ.
    """
    chosen = choice(rows, alpha) if chosen is None else chosen
    f = _repeated(_of(rows, chosen, "anova")).select("set", F.col("f").alias("statistic"), (F.col("k") - 1).cast("double").alias("dof1"), ((F.col("k") - 1) * (F.col("n") - 1)).cast("double").alias("dof2"))
    f = f.withColumn("p", per_row(f_tail)("statistic", "dof1", "dof2"))
    r = _friedman(_of(rows, chosen, "friedman")).select("set", F.col("chi2").alias("statistic"), (F.col("k") - 1).cast("double").alias("dof1"), F.lit(None).cast("double").alias("dof2"))
    r = r.withColumn("p", per_row(lambda x, d: chi2_tail(x, int(d)))("statistic", "dof1"))
    w = _pairs_of_two(_of(rows, chosen, "wilcoxon")).select("set", F.col("w").alias("statistic"), F.col("m").cast("double").alias("dof1"), F.lit(None).cast("double").alias("dof2"), per_row(lambda x, m, t: signed_rank_tail(x, int(m), t))("w", "m", "ties").alias("p"))
    out = chosen.join(f.unionByName(r).unionByName(w), "set", "left")
    return out.withColumn("differ", F.coalesce(F.col("p") < alpha, F.lit(False)))


def pairs(rows: DataFrame, alpha: float = 0.05, chosen: DataFrame | None = None) -> DataFrame:
    """(set, test, a, b, gap, q, p, differ) for each two methods a < b of a set of more than two: Tukey's test of the means with the error of repeated measures,
    or Nemenyi's of the average ranks, as the set's branch is. gap is a's less b's; q counts deviations of a studentised range."""
    chosen = choice(rows, alpha) if chosen is None else chosen
    chosen = chosen.filter("k > 2")
    anova, rank = _of(rows, chosen, "anova"), _of(rows, chosen, "friedman")
    error = _repeated(anova)
    level = anova.groupBy("set", "method").agg(F.avg("value").alias("level")).join(error, "set")
    level = level.select("set", "method", "level", "k", F.sqrt(F.col("mse") / F.col("n")).alias("se"), ((F.col("k") - 1) * (F.col("n") - 1)).cast("double").alias("dof"), F.lit("tukey").alias("test"))
    k = F.col("k")
    mean_rank = _ranks(rank).groupBy("set", "method", "k", "n").agg(F.avg("rank").alias("level"))
    mean_rank = mean_rank.select("set", "method", "level", "k", F.sqrt(k * (k + 1) / (12 * F.col("n"))).alias("se"), F.lit(math.inf).alias("dof"), F.lit("nemenyi").alias("test"))
    both = level.unionByName(mean_rank)
    a = both.withColumnsRenamed({"method": "a", "level": "la"})
    b = both.select("set", F.col("method").alias("b"), F.col("level").alias("lb"))
    gap = F.col("la") - F.col("lb")
    out = a.join(b, "set").filter("a < b").select("set", "test", "a", "b", gap.alias("gap"), F.try_divide(F.abs(gap), F.col("se")).alias("q"), "k", "dof")
    out = out.withColumn("p", per_row(lambda q, k, dof: studentised_tail(q, int(k), dof))("q", "k", "dof"))
    return out.select("set", "test", "a", "b", "gap", "q", "p", F.coalesce(F.col("p") < alpha, F.lit(False)).alias("differ"))


def best(rows: DataFrame, metric: Column | str | None = None) -> DataFrame:
    """(set, method, mean, median, avg_rank, place): the methods of each set in order of their average rank; errors rank upwards, all else downwards.

    metric: the metric's name, if it isn't the set's last part.
    """
    name = F.element_at(F.split("set", r"\|"), -1) if metric is None else F.lit(metric) if isinstance(metric, str) else metric
    turned = rows.withColumn("own", F.col("value")).withColumn("value", F.when(name.isin(*ASCENDING), F.col("value")).otherwise(-F.col("value")))
    out = _ranks(turned).groupBy("set", "method").agg(F.avg("own").alias("mean"), F.median("own").alias("median"), F.avg("rank").alias("avg_rank"))
    return out.withColumn("place", F.rank().over(Window.partitionBy("set").orderBy("avg_rank")))
