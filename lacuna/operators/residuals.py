"""Regressions of X0 and of the mask on the predictors, and what they leave: residual dependence, estimated values, imputations.

Least squares for all datasets at once: one aggregation of sums of products around the means, and 4 x 4 systems in a small vectorised function.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.sources.stage import materialize

from .forest import by_dataset
from .kernels import corr, with_mask
from .ranks import placed

DS = ["dataset_id"]
X = ("x1", "x2", "x3", "x4")
#: Rows below which nothing is estimated, and the share of variance that makes an estimate worth using.
LEAST_ROWS, LEAST_R2 = 10, 0.1


def with_known_predictors(panel: DataFrame) -> DataFrame:
    """``with_mask``, and unknown predictors filled with their dataset's mean (0 where none is known)."""
    df = with_mask(panel)
    known = {x: F.nanvl(F.col(x), F.lit(None).cast("double")) for x in X}
    means = df.groupBy(*DS).agg(*[F.avg(known[x]).alias(f"mean_{x}") for x in X])
    return df.join(means, DS).withColumns({x: F.coalesce(known[x], F.col(f"mean_{x}"), F.lit(0.0)) for x in X}).drop(*[f"mean_{x}" for x in X])


def least_squares(df: DataFrame, targets: dict[str, Column]) -> DataFrame:
    """dataset_id, n and for each target its mean, slopes (array) and share of variance; rows without the target do not count."""
    base = df.select(*DS, *X, *[t.alias(f"t_{k}") for k, t in targets.items()])
    out = None
    for k in targets:
        own = base.where(F.col(f"t_{k}").isNotNull())
        m = own.groupBy(*DS).agg(*[F.avg(x).alias(f"m_{x}") for x in X], F.avg(f"t_{k}").alias("m_t"), F.count(F.lit(1)).alias("n"))
        z = [F.col(x) - F.col(f"m_{x}") for x in X] + [F.col(f"t_{k}") - F.col("m_t")]
        pairs = [(i, j) for i in range(5) for j in range(i, 5)]
        c = own.join(m, DS).groupBy(*DS, "n", "m_t", *[f"m_{x}" for x in X]).agg(*[F.sum(z[i] * z[j]).alias(f"c{i}{j}") for i, j in pairs])

        def solve(frames, k=k, pairs=pairs):
            for f in frames:
                a = np.zeros((len(f), 5, 5))
                for i, j in pairs:
                    a[:, i, j] = a[:, j, i] = f[f"c{i}{j}"]
                slopes = np.einsum("nij,nj->ni", np.linalg.pinv(a[:, :4, :4], rcond=1e-12, hermitian=True), a[:, :4, 4]) if len(f) else np.zeros((0, 4))
                told = np.einsum("ni,ni->n", slopes, a[:, :4, 4])
                r2 = np.clip(np.divide(told, a[:, 4, 4], out=np.zeros(len(f)), where=a[:, 4, 4] > 1e-12), 0, 1)
                means = f[[f"m_{x}" for x in X]].to_numpy(float)
                yield pd.DataFrame({"dataset_id": f["dataset_id"], f"{k}_n": f["n"], f"{k}_base": f["m_t"] - (slopes * means).sum(axis=1), f"{k}_slopes": slopes.tolist(), f"{k}_r2": r2})

        made = c.mapInPandas(solve, f"dataset_id string, {k}_n long, {k}_base double, {k}_slopes array<double>, {k}_r2 double")
        out = made if out is None else out.join(made, DS, "full")
    return out


def predicted(k: str) -> Column:
    """The fit's value of a row; products are added in the order of the predictors."""
    return sum((F.col(x) * F.col(f"{k}_slopes")[i] for i, x in enumerate(X)), start=F.col(f"{k}_base"))


def residual_dependence(panel: DataFrame) -> DataFrame:
    """dataset_id, adv_partial_dcor_X0_mask, adv_residual_spearman_X0_mask, adv_residual_pearson_X0_mask.

    Distance correlation, absolute Spearman and absolute Pearson correlation of what the predictors leave of the filled X0 and of the mask; 0 below 20
    rows or five missing ones.
    """
    df = with_known_predictors(panel)
    fits = least_squares(df, {"x": F.col("x0f"), "m": F.col("mask").cast("double")})
    # residuals that differ by rounding only are ties
    left = df.join(fits, DS).select(*DS, F.round(F.col("x0f") - predicted("x"), 6).alias("a"), F.round(F.col("mask") - predicted("m"), 9).alias("b"), "mask", "row_id")
    left = materialize(left)
    ranked = left
    for c in "ab":
        ranked = _mean_ranks(ranked, c)
    g = ranked.groupBy(*DS).agg(corr("a", "b").alias("r"), corr("rank_a", "rank_b").alias("rho"), F.count(F.lit(1)).alias("n"), F.sum("mask").alias("m"))
    g = g.join(distance_correlation(left, DS, "a", "b", "row_id").withColumnRenamed("dcor", "d"), DS, "left")
    value = lambda c: F.when((F.col("n") >= 20) & (F.col("m") >= 5) & ~F.isnan(c), F.coalesce(F.abs(c), F.lit(0.0))).otherwise(0.0)
    return g.select(*DS, value("d").alias("adv_partial_dcor_X0_mask"), value("rho").alias("adv_residual_spearman_X0_mask"), value("r").alias("adv_residual_pearson_X0_mask"))


def distance_correlation(df: DataFrame, by: list[str], a: str, b: str, row: str) -> DataFrame:
    """by, dcor: the distance correlation (of the samples, squared covariances over all pairs) of two columns in each group; ``row`` tells rows apart.

    O(n log n) for n rows.  Sums of distances from a row come from running sums in order of a column.  Products of distances need, for each row, sums over the rows
    that are before it in both orders: by places in b, these are the left halves of the dyadic blocks in whose right half the row lies, so each row
    enters one running sum (in order of a) for each power of two.  Running sums are made by ranges: no group is one task.  Columns are centred and
    scaled first; 0 where one does not vary.
    """
    m = df.groupBy(*by).agg(*[f(c).alias(f"{k}_{n}") for n, c in (("a", a), ("b", b)) for k, f in (("mean", F.avg), ("sd", F.stddev_pop))], F.count(F.lit(1)).alias("n"))
    z = lambda n, c: (F.col(c) - F.col(f"mean_{n}")) / F.col(f"sd_{n}")
    rows = df.join(m.where((F.col("sd_a") > 1e-12) & (F.col("sd_b") > 1e-12)), by).select(*by, F.col(row).alias("row"), z("a", a).alias("a"), z("b", b).alias("b"), "n")
    for c in "ab":
        rows = placed(rows, by, [c, "row"], f"at_{c}", {f"upto_{c}": F.col(c)})
    rows = materialize(rows)
    # distances of a row to all others: those before it and those after it (centred columns sum to 0)
    total = {c: F.col(c) * (2 * F.col(f"at_{c}") - F.col("n")) - 2 * F.col(f"upto_{c}") for c in "ab"}
    sums = rows.groupBy(*by).agg(
        F.max("n").alias("n"), *[F.sum(total[c]).alias(f"all_{c}") for c in "ab"], F.sum(total["a"] * total["b"]).alias("cross"),
        *[F.sum(total[c] * total[c]).alias(f"cross_{c}") for c in "ab"], *[F.sum(F.col(c) * F.col(c)).alias(f"sq_{c}") for c in "ab"],
        F.sum(F.col("a") * F.col("b")).alias("ab"),
    )
    # pairs with i before j in a: (a_j - a_i) |b_j - b_i| is its product of differences, taken twice where i is before j in b, less once for every pair
    levels = F.sequence(F.lit(0), F.floor(F.log2(F.greatest("n", F.lit(2)).cast("double"))).cast("int") + 1)
    place = F.col("at_b") - 1
    each = rows.select(*by, "row", "a", "b", "at_a", place.alias("p"), F.explode(levels).alias("level"))
    half = F.expr("shiftright(p, level)")
    each = each.select(*by, "level", F.shiftright(half, 1).alias("pair"), (half % 2).alias("right"), "a", "b", "at_a")
    left = F.when(F.col("right") == 0, 1).otherwise(0)
    held = {"l1": left.cast("double"), "la": left * F.col("a"), "lb": left * F.col("b"), "lab": left * F.col("a") * F.col("b")}
    met = placed(each, [*by, "level", "pair"], ["at_a"], "turn", held).where("right = 1")
    both = met.groupBy(*by).agg(F.sum(F.col("a") * F.col("b") * F.col("l1") - F.col("b") * F.col("la") - F.col("a") * F.col("lb") + F.col("lab")).alias("both"))
    n = F.col("n").cast("double")
    every = n * F.col("ab")  # products of differences over all pairs, as the columns are centred
    s1 = 2 * (2 * F.coalesce("both", F.lit(0.0)) - every)
    cov = s1 / (n * n) + F.col("all_a") * F.col("all_b") / F.pow(n, F.lit(4)) - 2 * F.col("cross") / F.pow(n, F.lit(3))
    var = {c: 2 * F.col(f"sq_{c}") / n + F.pow(F.col(f"all_{c}") / (n * n), F.lit(2)) - 2 * F.col(f"cross_{c}") / F.pow(n, F.lit(3)) for c in "ab"}
    made = sums.join(both, by, "left").select(*by, F.sqrt(F.greatest(cov, F.lit(0.0)) / F.sqrt(F.greatest(var["a"] * var["b"], F.lit(1e-300)))).alias("dcor"))
    return m.select(*by).join(made, by, "left").select(*by, F.coalesce("dcor", F.lit(0.0)).alias("dcor"))


def _mean_ranks(df: DataFrame, c: str) -> DataFrame:
    """df with the mean rank of column c in its dataset; equal values are counted before they are ordered."""
    from pyspark.sql import Window as W

    counts = df.groupBy(*DS, c).agg(F.count(F.lit(1)).alias("k"))
    ranks = counts.select(*DS, c, (F.sum("k").over(W.partitionBy(*DS).orderBy(c)) - (F.col("k") - 1) / 2.0).alias(f"rank_{c}"))
    return df.join(ranks, [*DS, c])


def regression_quartile_rates(panel: DataFrame) -> DataFrame:
    """dataset_id, x0_imputation_r2, q1_rate..q4_rate: missing rates by quartile of X0, missing values estimated by least squares on the predictors.

    Where the fit explains less than a tenth of the variance (or nothing can be fitted) all four are the overall rate.
    """
    df = with_known_predictors(panel)
    fits = least_squares(df, {"x": F.col("x0")})
    est = df.join(fits, DS, "left").select(*DS, "mask", "x_n", "x_r2", F.coalesce("x0", predicted("x")).alias("est"))
    cuts = est.groupBy(*DS).agg(
        F.percentile("est", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"), F.avg("mask").alias("rate"), F.sum("mask").alias("m"), F.max("x_n").alias("n"), F.max("x_r2").alias("r2")
    )
    r2 = F.when((F.col("m") > 0) & (F.col("n") >= LEAST_ROWS), F.round("r2", 4)).otherwise(0.0)
    cuts = cuts.withColumn("told", F.coalesce(r2, F.lit(0.0))).drop("r2", "m", "n")
    e, q = F.col("est"), F.col("q")
    part = F.when(e < q[0], 1).when(e < q[1], 2).when(e < q[2], 3).otherwise(4)
    g = est.drop("x_n", "x_r2").join(cuts, DS).withColumn("part", part).groupBy(*DS).agg(
        F.max("told").alias("r2"), F.max("rate").alias("rate"), *[F.avg(F.when(F.col("part") == k, F.col("mask"))).alias(f"part{k}") for k in range(1, 5)]
    )
    rate = lambda k: F.when(F.col("r2") >= LEAST_R2, F.coalesce(F.col(f"part{k}"), F.lit(0.0))).otherwise(F.col("rate"))
    return g.select(*DS, F.col("r2").alias("x0_imputation_r2"), *[rate(k).alias(f"q{k}_rate") for k in range(1, 5)])


def bayesian_ridge(x: np.ndarray, y: np.ndarray, rounds: int = 300) -> tuple[np.ndarray, float]:
    """Slopes and intercept of a ridge whose two precisions are those of highest evidence (MacKay's updates, flat priors)."""
    mean_x, mean_y = x.mean(axis=0), y.mean()
    xc, yc, tiny = x - mean_x, y - mean_y, 1e-6
    values, vectors = np.linalg.eigh(xc.T @ xc)
    values, target = np.maximum(values, 0.0), vectors.T @ (xc.T @ yc)
    noise, weight, slopes = 1.0 / max(y.var(), 1e-12), 1.0, np.zeros(x.shape[1])
    for _ in range(rounds):
        before, slopes = slopes, vectors @ (target / (values + weight / noise))
        used = (noise * values / (weight + noise * values)).sum()
        weight = (used + 2 * tiny) / ((slopes**2).sum() + 2 * tiny)
        noise = (len(y) - used + 2 * tiny) / (((yc - xc @ slopes) ** 2).sum() + 2 * tiny)
        if np.abs(slopes - before).sum() < 1e-3:
            break
    return slopes, float(mean_y - mean_x @ slopes)


def nearest_means(x: np.ndarray, donors: np.ndarray, values: np.ndarray, k: int = 5) -> np.ndarray:
    """Mean value of the k nearest donors (the earlier of equally near ones) of each row."""
    out = np.empty(len(x))
    for a in range(0, len(x), 256):
        d = ((x[a : a + 256, None, :] - donors[None, :, :]) ** 2).sum(axis=2)
        out[a : a + 256] = values[np.argsort(d, axis=1, kind="stable")[:, :k]].mean(axis=1)
    return out


def _ks(a: np.ndarray, b: np.ndarray) -> float:
    at = np.concatenate([a, b])
    return float(np.abs(np.searchsorted(np.sort(a), at, "right") / len(a) - np.searchsorted(np.sort(b), at, "right") / len(b)).max())


def imputation_divergence(panel: DataFrame, seed: int = 46) -> DataFrame:
    """dataset_id, adv_imputation_divergence_ks, _wasserstein and adv_imputation_cv.

    Missing X0 filled by the median, by five nearest rows and by a Bayesian ridge on the predictors: mean pairwise Kolmogorov-Smirnov
    distance, greatest pairwise Wasserstein distance, and spread of the three means (at most 10); 0 below five rows on a side.
    """
    keys = ("adv_imputation_divergence_ks", "adv_imputation_divergence_wasserstein", "adv_imputation_cv")

    def work(rows, rng):
        gone = rows["mask"].to_numpy() == 1
        if min(gone.sum(), (~gone).sum()) < 5:
            return dict.fromkeys(keys, 0.0)
        x = rows[list(X)].to_numpy(float)
        x = np.where(np.isnan(x), np.nan_to_num(np.nanmedian(x, axis=0)), x)
        y, most = rows["x0f"].to_numpy(float)[~gone], int(min(5, (~gone).sum() - 1))
        slopes, base = bayesian_ridge(x[~gone], y)
        made = [np.full(gone.sum(), np.median(y)), nearest_means(x[gone], x[~gone], y, most), x[gone] @ slopes + base]
        pairs = [(made[i], made[j]) for i, j in ((0, 1), (0, 2), (1, 2))]
        means = np.array([v.mean() for v in made])
        return dict(zip(keys, (
            float(np.mean([_ks(a, b) for a, b in pairs])), float(max(np.abs(np.sort(a) - np.sort(b)).mean() for a, b in pairs)),
            float(min(means.std() / max(np.abs(means).mean(), 1e-10), 10.0)),
        ), strict=True))

    return by_dataset(panel, work, ", ".join(f"{k} double" for k in keys), seed)
