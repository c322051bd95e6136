"""Statistics that the operators share, from counts of equal values: ranks, distribution distances, runs.

Rows collapse to one for each (group, value) by an aggregation that combines inside tasks; only
those go through a window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def with_mask(panel: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """The panel with ``mask`` (1 where x0 is missing), ``median`` of the observed and ``x0f`` (x0 filled with it); as it is where it has them."""
    if {"mask", "median", "x0f"} <= set(panel.columns):
        return panel
    clean = panel.withColumn("x0", F.when(~F.isnan("x0"), F.col("x0")))
    median = clean.groupBy("dataset_id").agg(F.percentile("x0", 0.5).alias("median"))
    out = clean.join(median, "dataset_id")
    return out.withColumns({"mask": F.when(F.col("x0").isNull(), 1).otherwise(0), "x0f": F.coalesce("x0", "median")})


def unpivoted(panel: DataFrame, columns=("x1", "x2", "x3", "x4"), keep=("dataset_id", "row_id", "mask")) -> DataFrame:
    """One row for each predictor: the kept columns, var, value."""
    return panel.select(*keep, F.explode(F.array(*[F.struct(F.lit(c).alias("var"), F.col(c).alias("value")) for c in columns])).alias("v")).select(
        *keep, "v.var", "v.value"
    )


def value_counts(df: DataFrame, by: list[str], value: str, a: Column, b: Column) -> DataFrame:
    """by, value, a, b (numbers of rows of either sample), ca, cb (so far in order of value), na, nb (in all)."""
    counts = df.groupBy(*by, F.col(value).alias("value")).agg(F.sum(a.cast("long")).alias("a"), F.sum(b.cast("long")).alias("b"))
    so_far = W.partitionBy(*by).orderBy("value")
    whole = W.partitionBy(*by)
    return counts.withColumns(
        {"ca": F.sum("a").over(so_far), "cb": F.sum("b").over(so_far), "na": F.sum("a").over(whole), "nb": F.sum("b").over(whole)}
    )


def ks(df: DataFrame, by: list[str], value: str, a: Column, b: Column) -> DataFrame:
    """by, ks, na, nb: the greatest difference of two empirical distributions (null if one is empty)."""
    c = value_counts(df, by, value, a, b)
    gap = F.abs(F.when(F.col("na") > 0, F.col("ca") / F.col("na")) - F.when(F.col("nb") > 0, F.col("cb") / F.col("nb")))
    return c.groupBy(*by).agg(F.max(gap).alias("ks"), F.max("na").alias("na"), F.max("nb").alias("nb"))


def rank_sums(df: DataFrame, by: list[str], value: str, flag: Column, listed: int = 0) -> DataFrame:
    """by, n1, n0, rank_sum (mean ranks of rows with the flag), rank_squares (of all rows), ties (sum of t^3 - t); with ``listed`` also
    tied: how many rows share each value, in order (empty for groups of more than ``listed`` rows)."""
    c = value_counts(df, by, value, flag, 1 - flag)
    t = F.col("a") + F.col("b")
    rank = F.col("ca") + F.col("cb") - t + (t + 1) / F.lit(2.0)
    pairs = F.collect_list(F.when(F.col("na") + F.col("nb") <= listed, F.struct("value", t.alias("t"))))
    return c.groupBy(*by).agg(
        F.sum("a").alias("n1"), F.sum("b").alias("n0"), F.sum(F.col("a") * rank).alias("rank_sum"),
        F.sum(t * rank * rank).alias("rank_squares"), F.sum((t * t * t - t).cast("double")).alias("ties"),
        *([F.transform(F.sort_array(pairs), lambda x: x.t).alias("tied")] if listed else []),
    )


def auc(df: DataFrame, by: list[str], score: str, flag: Column) -> DataFrame:
    """by, auc, n1, n0: the chance that a flagged row scores above another (null for one class)."""
    s = rank_sums(df, by, score, flag)
    pairs = F.col("n1") * F.col("n0")
    return s.select(*by, F.when(pairs > 0, (F.col("rank_sum") - F.col("n1") * (F.col("n1") + 1) / 2.0) / pairs).alias("auc"), "n1", "n0")


def runs(df: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """One row for each maximal run of equal values in order: by, value, length."""
    w = W.partitionBy(*by).orderBy(order)
    starts = df.select(*by, order, value, F.when(F.lag(value).over(w).eqNullSafe(F.col(value)) & (F.row_number().over(w) > 1), 0).otherwise(1).alias("new"))
    marked = starts.withColumn("run", F.sum("new").over(w))
    return marked.groupBy(*by, "run").agg(F.first(value).alias("value"), F.count(F.lit(1)).alias("length"))


def corr(a: str | Column, b: str | Column) -> Column:
    """Pearson correlation as an aggregate; null where one side does not vary."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    known = a.isNotNull() & b.isNotNull()
    a, b = F.when(known, a.cast("double")), F.when(known, b.cast("double"))
    return F.try_divide(F.covar_pop(a, b), F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0)))


def zero_safe(x: Column, digits: int = 6) -> Column:
    """Rounded for reports; -0.0 becomes 0.0."""
    return F.round(x, digits) + F.lit(0.0)
