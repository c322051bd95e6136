"""Statistical tests of the missing mask: statistics by aggregation, tails by small vectorised functions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lacuna.functions import exact, special

from .kernels import corr, ks, rank_sums, unpivoted, with_mask

DS = ["dataset_id"]
#: U tests of at most so many rows count all ways to deal their ranks, ties or not.
EXACT_ROWS = 60
#: U tests without ties do so where a side has at most so many rows.
EXACT_SIDE = 8
#: The largest side of an exact two-sample test without ties (U or Kolmogorov-Smirnov); asymptotic beyond.
EXACT_UNTIED = 10_000


def _tail(f, *columns) -> Column:
    """A column of p-values from columns of statistics; a null statistic has a null p-value."""
    def run(*series: pd.Series) -> pd.Series:
        return pd.Series(f(*[s.to_numpy("float64", na_value=float("nan")) for s in series]))

    if len(columns) == 1:
        @F.pandas_udf("double")
        def one(a: pd.Series) -> pd.Series:
            return run(a)

        return F.nanvl(one(*columns), F.lit(None).cast("double"))
    if len(columns) == 2:
        @F.pandas_udf("double")
        def two(a: pd.Series, b: pd.Series) -> pd.Series:
            return run(a, b)

        return F.nanvl(two(*columns), F.lit(None).cast("double"))

    @F.pandas_udf("double")
    def three(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        return run(a, b, c)

    return F.nanvl(three(*columns), F.lit(None).cast("double"))


def welch_statistics(panel: DataFrame) -> DataFrame:
    """dataset_id, var, n1, n0, t, df of missing against observed rows, where each side has three rows and there is spread."""
    long = unpivoted(with_mask(panel))
    side = lambda f, k: f(F.when(F.col("mask") == k, F.col("value")))
    g = long.groupBy(*DS, "var").agg(
        side(F.count, 1).alias("n1"), side(F.count, 0).alias("n0"), (side(F.avg, 1) - side(F.avg, 0)).alias("d"), side(F.var_samp, 1).alias("v1"), side(F.var_samp, 0).alias("v0")
    )
    a, b = F.col("v1") / F.col("n1"), F.col("v0") / F.col("n0")
    ok = g.where((F.col("n1") >= 3) & (F.col("n0") >= 3) & (a + b > 0))
    return ok.select(*DS, "var", "n1", "n0", (F.col("d") / F.sqrt(a + b)).alias("t"), F.round(F.pow(a + b, 2) / (a * a / (F.col("n1") - 1) + b * b / (F.col("n0") - 1)), 4).alias("df"))


def little_proxy(panel: DataFrame) -> DataFrame:
    """dataset_id, tests, p: Welch p-values of the predictors combined by Fisher's sum (chi-squared of even degrees)."""
    w = welch_statistics(panel).withColumn("p", F.greatest(_tail(special.t_two_sided, "t", "df"), F.lit(1e-300)))
    s = w.groupBy(*DS).agg((-2 * F.sum(F.log("p"))).alias("x"), (2 * F.count(F.lit(1))).cast("double").alias("df"), F.count(F.lit(1)).alias("tests"))
    return s.select(*DS, "tests", _tail(special.chi2_upper, "x", "df").alias("p"))


def levene_statistics(panel: DataFrame) -> DataFrame:
    """dataset_id, var, f, df: median-centred Levene statistic of the two sides, five rows each at least."""
    long = unpivoted(with_mask(panel))
    med = long.groupBy(*DS, "var", "mask").agg(F.percentile("value", 0.5).alias("med"))
    z = long.join(med, [*DS, "var", "mask"]).select(*DS, "var", "mask", F.abs(F.col("value") - F.col("med")).alias("z"))
    g = z.groupBy(*DS, "var", "mask").agg(F.count(F.lit(1)).alias("n"), F.avg("z").alias("m"), (F.var_pop("z") * F.count(F.lit(1))).alias("q"))
    pick = lambda c, k: F.max(F.when(F.col("mask") == k, F.col(c)))
    t = g.groupBy(*DS, "var").agg(*[pick(c, k).alias(f"{c}{k}") for c in "nmq" for k in (0, 1)])
    n, mean = F.col("n0") + F.col("n1"), (F.col("n0") * F.col("m0") + F.col("n1") * F.col("m1")) / (F.col("n0") + F.col("n1"))
    between = F.col("n0") * F.pow(F.col("m0") - mean, 2) + F.col("n1") * F.pow(F.col("m1") - mean, 2)
    q = F.col("q0") + F.col("q1")
    return t.where((F.least("n0", "n1") >= 5) & F.col("n0").isNotNull() & F.col("n1").isNotNull() & (q > 1e-12)).select(*DS, "var", (between / (q / (n - 2))).alias("f"), (n - 2).alias("df"))


def levene_bonferroni(panel: DataFrame) -> DataFrame:
    """dataset_id, tests, p: the least p-value times their number, at most one."""
    p = levene_statistics(panel).withColumn("p", _tail(special.f_upper, "f", F.lit(1.0), F.col("df").cast("double")))
    return p.groupBy(*DS).agg(F.count(F.lit(1)).alias("tests"), F.least(F.min("p") * F.count(F.lit(1)), F.lit(1.0)).alias("p"))


def log_pval_x1(panel: DataFrame) -> DataFrame:
    """-log10 of the p-value of X1's correlation with the mask (floor 1e-100); 0 without spread."""
    df = with_mask(panel)
    a = df.groupBy(*DS).agg(corr("mask", "x1").alias("r"), F.count(F.lit(1)).alias("n"))
    r = F.when(~F.isnan("r"), F.col("r"))
    t = F.abs(r) * F.sqrt((F.col("n") - 2) / F.greatest(1 - r * r, F.lit(1e-300)))
    p = _tail(special.t_two_sided, "t", "df")
    made = a.select(*DS, t.alias("t"), (F.col("n") - 2).cast("double").alias("df")).withColumn("p", p)
    return made.select(*DS, F.coalesce(-F.log10(F.greatest("p", F.lit(1e-100))), F.lit(0.0)).alias("log_pval_X1_mask"))


def mannwhitney_statistics(panel: DataFrame, value: str = "x1") -> DataFrame:
    """dataset_id, n1, n0, u of missing rows over observed ones."""
    s = rank_sums(with_mask(panel), DS, value, F.col("mask"))
    return s.select(*DS, "n1", "n0", (F.col("rank_sum") - F.col("n1") * (F.col("n1") + 1) / 2.0).alias("u"))


@F.pandas_udf(T.DoubleType())
def _exact_u(tied: pd.Series, n1: pd.Series, n0: pd.Series, rank_sum: pd.Series, ties: pd.Series) -> pd.Series:
    """Exact p-values of the U test where a table of counts is small enough, else null."""
    def one(tied, a, b, total, ties):
        if min(a, b) == 0:
            return None
        if len(tied):
            return exact.rank_sum(exact.doubled_ranks(tied), int(a), total)
        if ties == 0 and min(a, b) <= EXACT_SIDE and max(a, b) <= EXACT_UNTIED:
            return exact.untied_u(total - a * (a + 1) / 2, a, b)
        return None

    return pd.Series([one(*x) for x in zip(tied, n1, n0, rank_sum, ties, strict=True)], dtype="float64")


def mannwhitney_pval(panel: DataFrame, value: str = "x1") -> DataFrame:
    """Two-sided p-value of the U test; 1 without two sides.

    Exact up to ``EXACT_ROWS`` rows (all ways to deal the ranks, ties included) and, without ties, where a side has at most ``EXACT_SIDE`` rows; else
    the normal approximation with corrections for ties and continuity.
    """
    s = rank_sums(with_mask(panel), DS, value, F.col("mask"), EXACT_ROWS)
    n1, n0 = F.col("n1"), F.col("n0")
    n, u = n1 + n0, F.col("rank_sum") - n1 * (n1 + 1) / 2.0
    spread = F.sqrt(n1 * n0 / 12.0 * ((n + 1) - F.try_divide("ties", n * (n - 1))))
    z = F.when(spread > 0, F.greatest(F.abs(u - n1 * n0 / 2.0) - 0.5, F.lit(0.0)) / spread)
    made = s.select(*DS, z.alias("z"), _exact_u("tied", "n1", "n0", "rank_sum", "ties").alias("counted")).withColumn("p", _tail(special.normal_two_sided, "z"))
    return made.select(*DS, F.coalesce(F.nanvl("counted", F.lit(None).cast("double")), "p", F.lit(1.0)).alias("X1_mannwhitney_pval"))


def max_mask_correlation(panel: DataFrame) -> DataFrame:
    """dataset_id, var, r: the predictor of the greatest absolute correlation with the mask."""
    c = unpivoted(with_mask(panel)).groupBy(*DS, "var").agg(F.abs(corr("value", "mask")).alias("r")).where(~F.isnan("r") & F.col("r").isNotNull())
    return c.groupBy(*DS).agg(F.max_by("var", F.struct(F.round("r", 9).alias("r"), "var")).alias("var"), F.max("r").alias("r"))


@F.pandas_udf(T.DoubleType())
def _exact_ks(ks: pd.Series, na: pd.Series, nb: pd.Series) -> pd.Series:
    """Exact p-values of two samples of at most ``EXACT_UNTIED`` rows each, else null."""
    known = ks.notna() & (na <= EXACT_UNTIED) & (nb <= EXACT_UNTIED)
    return pd.Series([exact.two_sample_ks(d, int(a), int(b)) if k else None for d, a, b, k in zip(ks, na, nb, known, strict=True)], dtype="float64")


def mnar_ks_test(panel: DataFrame) -> DataFrame:
    """dataset_id, ks, p of observed against filled X0; null below ten observed or three missing rows.

    Exact for samples of at most ``EXACT_UNTIED`` rows, as if all values were different (the filled column repeats the observed one: a
    conservative p-value), asymptotic beyond.
    """
    k = ks(with_mask(panel), DS, "x0f", 1 - F.col("mask"), F.lit(1))
    ok = (F.col("na") >= 10) & (F.col("nb") - F.col("na") >= 3)
    made = k.select(*DS, F.when(ok, F.col("ks")).alias("ks"), "na", "nb", (F.col("na") * F.col("nb") / (F.col("na") + F.col("nb"))).alias("n"))
    counted = F.nanvl(_exact_ks("ks", "na", "nb"), F.lit(None).cast("double"))
    return made.select(*DS, "ks", F.coalesce(counted, _tail(special.kolmogorov_upper, "ks", "n")).alias("p"))


def normality_ks(panel: DataFrame) -> DataFrame:
    """dataset_id, ks, p of the standardised observed X0 against the normal distribution (more than twenty observed rows)."""
    obs = panel.where(F.col("x0").isNotNull() & ~F.isnan("x0"))
    m = obs.groupBy(*DS).agg(F.avg("x0").alias("m"), F.greatest(F.stddev_pop("x0"), F.lit(1e-10)).alias("s"), F.count(F.lit(1)).alias("n")).where("n > 20")
    c = obs.groupBy(*DS, "x0").agg(F.count(F.lit(1)).alias("k"))
    w = W.partitionBy(*DS).orderBy("x0")
    z = c.join(m, DS).select(*DS, "n", "k", F.sum("k").over(w).alias("upto"), ((F.col("x0") - F.col("m")) / F.col("s")).alias("z"))
    cdf = _tail(special.normal_cdf, "z")
    g = z.withColumn("cdf", cdf).groupBy(*DS, "n").agg(F.max(F.greatest(F.col("upto") / F.col("n") - F.col("cdf"), F.col("cdf") - (F.col("upto") - F.col("k")) / F.col("n"))).alias("ks"))
    return g.select(*DS, "ks", _tail(special.kolmogorov_upper, "ks", F.col("n").cast("double")).alias("p"))
