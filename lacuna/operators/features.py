"""Features of the missing mask, one row for each dataset of a panel.

``x0f`` is X0 with its gaps filled by the dataset's median; so all missing rows sit on one value,
which several features measure on purpose.  Datasets without any or with only missing values get
the stated defaults.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kernels import ks, rank_sums, runs, unpivoted, with_mask

DS = ["dataset_id"]
PREDICTORS = ("x1", "x2", "x3", "x4")


def _skew(x: str) -> Column:
    return F.coalesce(F.skewness(x), F.lit(0.0))


def _shift(x: str) -> Column:
    return F.avg(F.when(F.col("mask") == 1, F.col(x))) - F.avg(F.when(F.col("mask") == 0, F.col(x)))


def moments(panel: DataFrame) -> DataFrame:
    """Missing rate, ratios of mean and spread to the filled X0, skew difference, shifts of predictors, kurtosis."""
    df = with_mask(panel)
    q = lambda x: F.percentile(x, F.array(F.lit(0.25), F.lit(0.75)))
    agg = df.groupBy(*DS).agg(
        F.avg("mask").alias("X0_missing_rate"), F.count("x0").alias("n_obs"), F.sum("mask").alias("n_missing"),
        F.avg("x0").alias("mo"), F.avg("x0f").alias("mf"), q("x0").alias("qo"), q("x0f").alias("qf"),
        (_skew("x0") - _skew("x0f")).alias("skew_diff"), F.kurtosis("x0").alias("kurtosis"), *[_shift(x).alias(f"d{x}") for x in PREDICTORS],
    )
    c = F.col
    plain = (c("n_obs") < 2) | (c("n_missing") == 0)
    none = (c("n_missing") == 0) | (c("n_obs") == 0)
    iqr = lambda q: c(q)[1] - c(q)[0]
    return agg.select(
        *DS, "X0_missing_rate",
        F.when(plain | (F.abs("mf") <= 1e-10), 1.0).otherwise(c("mo") / c("mf")).alias("X0_obs_vs_full_ratio"),
        F.when(plain | (F.abs(iqr("qf")) <= 1e-10), 1.0).otherwise(iqr("qo") / iqr("qf")).alias("X0_iqr_ratio"),
        F.when(plain, 0.0).otherwise(c("skew_diff")).alias("X0_obs_skew_diff"),
        F.when(none, 0.0).otherwise(c("dx1")).alias("X1_mean_diff"),
        F.when(none, 0.0).otherwise(sum((F.abs(f"d{x}") for x in PREDICTORS), start=F.lit(0.0)) / 4).alias("X0_mean_shift_X1_to_X4"),
        F.when(none | (c("n_obs") <= 10), 0.0).otherwise(F.coalesce("kurtosis", F.lit(0.0))).alias("caafe_kurtosis_excess"),
    )


def little_proxy_score(panel: DataFrame) -> DataFrame:
    """Mean over X1..X4 of the Kolmogorov-Smirnov distance between rows with and without X0."""
    long = unpivoted(with_mask(panel))
    by_var = ks(long, [*DS, "var"], "value", F.col("mask"), 1 - F.col("mask"))
    return by_var.groupBy(*DS).agg((F.sum(F.coalesce("ks", F.lit(0.0))) / 4).alias("little_proxy_score"))


def ks_obs_vs_imputed(panel: DataFrame) -> DataFrame:
    """Kolmogorov-Smirnov distance between the observed X0 and the filled one."""
    got = ks(with_mask(panel), DS, "x0f", 1 - F.col("mask"), F.lit(1))
    some = (F.col("na") > 1) & (F.col("na") < F.col("nb"))
    return got.select(*DS, F.when(some, F.col("ks")).otherwise(0.0).alias("X0_ks_obs_vs_imputed"))


def tail_missing_ratio(panel: DataFrame) -> DataFrame:
    """Missing rate in the top quarter of the filled X0 over that in the second quarter."""
    df = with_mask(panel)
    cuts = df.groupBy(*DS).agg(F.percentile("x0f", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    x, q = F.col("x0f"), F.col("q")
    rate = lambda inside: F.avg(F.when(inside, F.col("mask")))
    got = df.join(cuts, DS).groupBy(*DS).agg(
        rate((x >= q[0]) & (x < q[1])).alias("r2"), rate(x >= q[2]).alias("r4"), F.min("mask").alias("all_gone"), F.max("mask").alias("any_gone")
    )
    r2, r4 = F.col("r2"), F.col("r4")
    value = F.when(r2 > 1e-10, r4 / r2).when(r2.isNotNull() & (r4 > 0), r4 * 10).otherwise(1.0)
    return got.select(*DS, F.when((F.col("all_gone") == 1) | (F.col("any_gone") == 0), 1.0).otherwise(value).alias("X0_tail_missing_ratio"))


def mask_entropy(panel: DataFrame) -> DataFrame:
    """Shannon entropy (bits) of the shares of the mask's runs in row order."""
    df = panel.select(*DS, "row_id", F.when(F.col("x0").isNull() | F.isnan("x0"), 1).otherwise(0).alias("mask"))
    each = runs(df, DS, "row_id", "mask")
    totals = each.groupBy(*DS).agg(F.sum("length").alias("n"), F.count_distinct("value").alias("kinds"))
    p = F.col("length") / F.col("n")
    bits = F.sum(-p * F.log2(p + 1e-10))
    return each.join(totals, DS).groupBy(*DS).agg(F.when(F.max("kinds") < 2, 0.0).otherwise(bits).alias("mask_entropy"))


def censoring_score(panel: DataFrame) -> DataFrame:
    """Absolute Spearman correlation of the filled X0 and the mask."""
    s = rank_sums(with_mask(panel), DS, "x0f", F.col("mask"))
    n = F.col("n1") + F.col("n0")
    p = F.col("n1") / n
    spread = F.sqrt(p * (1 - p)) * F.sqrt(F.col("rank_squares") / n - F.pow((n + 1) / 2.0, 2))
    cov = F.col("rank_sum") / n - p * (n + 1) / 2.0
    return s.select(*DS, F.when(spread > 1e-12, F.abs(cov / spread)).otherwise(0.0).alias("X0_censoring_score"))


def kl_density(panel: DataFrame, bins: int = 20) -> DataFrame:
    """Kullback-Leibler divergence of observed from missing rows over equal bins of the filled X0."""
    df = with_mask(panel)
    ends = df.groupBy(*DS).agg(F.min("x0f").alias("lo"), F.max("x0f").alias("hi"), F.sum("mask").alias("m"), F.sum(1 - F.col("mask")).alias("o"))
    lo, hi = F.col("lo"), F.col("hi")
    at = F.least(F.floor((F.col("x0f") - lo) / (hi + 1e-10 - lo) * bins), F.lit(bins - 1)).cast("int")
    filled = df.join(ends, DS).groupBy(*DS, "lo", "hi", "m", "o", at.alias("bin")).agg(
        (F.sum("mask") + 1e-10).alias("hm"), (F.sum(1 - F.col("mask")) + 1e-10).alias("ho")
    )
    eps = bins * 1e-10
    pm, po = F.col("hm") / (F.col("m") + eps), F.col("ho") / (F.col("o") + eps)
    empty_m, empty_o = 1e-10 / (F.col("m") + eps), 1e-10 / (F.col("o") + eps)
    part = filled.groupBy(*DS, "lo", "hi", "m", "o").agg(F.sum(po * F.log(po / pm)).alias("kl"), F.count(F.lit(1)).alias("filled"))
    rest = (bins - F.col("filled")) * empty_o * F.log(empty_o / empty_m)
    off = (F.col("m") < 5) | (F.col("o") < 5) | (hi - lo < 1e-10)
    return part.select(*DS, F.when(off, 0.0).otherwise(F.col("kl") + rest).alias("caafe_kl_density"))


def _entropy(p: Column) -> Column:
    return F.when((p > 0) & (p < 1), -p * F.log2(p) - (1 - p) * F.log2(1 - p)).otherwise(0.0)


def cond_entropy(panel: DataFrame, value: str = "x0f") -> DataFrame:
    """Share of the mask's entropy that at most five equal bins of the filled X0 (or another column) explain."""
    df = with_mask(panel)
    ends = df.groupBy(*DS).agg(
        F.min(value).alias("lo"), F.max(value).alias("hi"), F.least(F.lit(5), F.count_distinct(value)).alias("bins"),
        F.count(F.lit(1)).alias("n"), F.avg("mask").alias("p"),
    )
    width = F.col("hi") - F.col("lo")
    at = F.when(width > 0, F.least(F.floor((F.col(value) - F.col("lo")) / width * F.col("bins")), F.col("bins") - 1)).otherwise(0)
    each = df.join(ends, DS).groupBy(*DS, "n", "p", at.alias("bin")).agg(F.count(F.lit(1)).alias("k"), F.avg("mask").alias("pb"))
    got = each.groupBy(*DS, "n", "p").agg(F.sum(F.col("k") / F.col("n") * _entropy(F.col("pb"))).alias("rest"))
    h = _entropy(F.col("p"))
    return got.select(*DS, F.when((F.col("n") > 10) & (h > 1e-10), (h - F.col("rest")) / h).otherwise(0.0).alias("caafe_cond_entropy_X0_mask"))


def density_ratio(panel: DataFrame) -> DataFrame:
    """Kernel density of observed over filled X0 at ten percentiles (5, 15, ... 95): range and ratio of the ends."""
    df = with_mask(panel)
    tenths = F.array(*[F.lit(p / 100) for p in range(5, 100, 10)])
    stats = df.groupBy(*DS).agg(
        F.percentile("x0", tenths).alias("points"), F.count("x0").alias("no"), F.count("x0f").alias("nf"),
        F.stddev_samp("x0").alias("so"), F.stddev_samp("x0f").alias("sf"), F.stddev_pop("x0").alias("spread"), F.sum("mask").alias("m"),
    )
    stats = stats.withColumn("use", (F.col("m") >= 10) & (F.col("no") >= 10) & (F.col("spread") >= 1e-10) & (F.size(F.array_distinct("points")) >= 3))
    width = lambda s, n: F.col(s) * F.pow(F.col(n).cast("double"), F.lit(-0.2))
    rows = stats.where("use").join(df.select(*DS, "x0", "x0f"), DS).select(*DS, "no", "nf", width("so", "no").alias("bo"), width("sf", "nf").alias("bf"), "x0", "x0f", F.posexplode("points").alias("k", "at"))
    bell = lambda x, b: F.exp(-F.pow((F.col("at") - F.col(x)) / F.col(b), 2) / 2) / F.col(b)
    dens = rows.groupBy(*DS, "k").agg((F.sum(bell("x0", "bo")) / F.first("no")).alias("d"), (F.sum(bell("x0f", "bf")) / F.first("nf")).alias("f"))
    root = 0.3989422804014327  # 1 / sqrt(2 pi)
    ratio = dens.select(*DS, "k", (root * F.col("d") / F.greatest(root * F.col("f"), F.lit(1e-10))).alias("r"))
    ends = ratio.groupBy(*DS).agg((F.max("r") - F.min("r")).alias("range"), F.max_by("r", "k").alias("top"), F.min_by("r", "k").alias("low"))
    out = stats.select(*DS).join(ends, DS, "left")
    tail = F.least(F.greatest(F.col("top") / F.greatest("low", F.lit(1e-10)), F.lit(0.01)), F.lit(100.0))
    return out.select(
        *DS, F.coalesce(F.least("range", F.lit(10.0)), F.lit(0.0)).alias("adv_density_ratio_range"), F.coalesce(tail, F.lit(1.0)).alias("adv_density_ratio_tail_asym")
    )


def extract_features(panel: DataFrame, label: str | None = "label", advanced: bool = True) -> DataFrame:
    """All features in one row for each dataset, with source_group and label; infinite values are null, null statistics 0.

    Those of the mask's moments, ranks, distributions and runs, of its linear models, of the fold test and of the forest of X0; ``advanced``
    adds density ratios, imputation divergence and residual dependence.  Each family is one job of its own, written before they are joined.
    """
    from lacuna.sources.stage import materialize

    from . import linear, residuals
    from .forest import auc_self_delta
    from .tests import log_pval_x1, mannwhitney_pval

    families = [moments, little_proxy_score, ks_obs_vs_imputed, tail_missing_ratio, mask_entropy, censoring_score, kl_density, cond_entropy, linear.mechdetect_features, log_pval_x1, mannwhitney_pval, auc_self_delta]
    families += [density_ratio, residuals.imputation_divergence, residuals.residual_dependence] if advanced else []
    keys = panel.groupBy(*DS).agg(F.first("source_group").alias("source_group"), *([F.first(label).alias("label")] if label else []))
    for family in families:
        keys = keys.join(materialize(family(panel)), DS, "left")
    doubles = [c for c, t in keys.dtypes if t == "double"]
    return keys.withColumns({c: F.coalesce(F.when(F.abs(c) < float("inf"), F.col(c)), F.lit(0.0)) for c in doubles})
