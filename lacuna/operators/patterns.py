"""Little's test over the patterns of missing values: rows become sums by pattern, and the rest works on at most 32 rows for each dataset."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.functions import special

DS = ["dataset_id"]
COLUMNS = ("x0", "x1", "x2", "x3", "x4")
_PAIRS = [(i, j) for i in range(5) for j in range(i, 5)]
MOST_ROUNDS, NEAR = 500, 1e-10


def pattern_sums(panel: DataFrame) -> DataFrame:
    """dataset_id, pattern (bit k: column k is known), n, sums and sums of products of the known values, centred and scaled by the dataset."""
    known = {c: ~F.isnan(c) & F.col(c).isNotNull() for c in COLUMNS}
    clean = panel.select(*DS, *[F.when(known[c], F.col(c)).alias(c) for c in COLUMNS])
    s = clean.groupBy(*DS).agg(*[f(c).alias(f"{k}_{c}") for c in COLUMNS for k, f in (("m", F.avg), ("s", F.stddev_pop))])
    z = lambda c: F.when(F.col(c).isNotNull(), F.when(F.col(f"s_{c}") > 1e-12, (F.col(c) - F.col(f"m_{c}")) / F.col(f"s_{c}")).otherwise(0.0))
    pattern = sum((F.when(F.col(c).isNotNull(), 1 << k).otherwise(0) for k, c in enumerate(COLUMNS)), start=F.lit(0))
    rows = clean.join(s, DS).select(*DS, pattern.alias("pattern"), *[z(c).alias(f"z{k}") for k, c in enumerate(COLUMNS)])
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0.0))
    return rows.groupBy(*DS, "pattern").agg(
        F.count(F.lit(1)).alias("n"), *[zero(f"z{k}").alias(f"a{k}") for k in range(5)], *[zero(F.col(f"z{i}") * F.col(f"z{j}")).alias(f"c{i}{j}") for i, j in _PAIRS]
    )


def _moments(parts: list) -> tuple[np.ndarray, np.ndarray]:
    """Maximum likelihood mean and covariance of a normal distribution by EM, from (known columns, n, sums, products)."""
    total = sum(n for _, n, _, _ in parts)
    mean, cov = np.zeros(5), np.eye(5)
    for _ in range(MOST_ROUNDS):
        first, second = np.zeros(5), np.zeros((5, 5))
        for o, n, s, c in parts:
            m = ~o
            so, coo = s[o], c[np.ix_(o, o)]
            first[o] += so
            second[np.ix_(o, o)] += coo
            if m.any():
                b = cov[np.ix_(m, o)] @ np.linalg.pinv(cov[np.ix_(o, o)]) if o.any() else np.zeros((m.sum(), 0))
                a = mean[m] - b @ mean[o]
                cross = np.outer(a, so) + b @ coo
                first[m] += n * a + b @ so
                second[np.ix_(m, o)] += cross
                second[np.ix_(o, m)] += cross.T
                rest = cov[np.ix_(m, m)] - b @ cov[np.ix_(o, m)]
                second[np.ix_(m, m)] += n * np.outer(a, a) + np.outer(a, b @ so) + np.outer(b @ so, a) + b @ coo @ b.T + n * rest
        new_mean = first / total
        new_cov = second / total - np.outer(new_mean, new_mean)
        moved = max(np.abs(new_mean - mean).max(), np.abs(new_cov - cov).max())
        mean, cov = new_mean, new_cov
        if moved < NEAR:
            break
    return mean, cov


def _little(rows: pd.DataFrame) -> tuple[float, int]:
    """Statistic and degrees of freedom of a dataset."""
    parts = []
    for r in rows.itertuples():
        o = np.array([bool(r.pattern >> k & 1) for k in range(5)])
        c = np.zeros((5, 5))
        for i, j in _PAIRS:
            c[i, j] = c[j, i] = getattr(r, f"c{i}{j}")
        parts.append((o, int(r.n), np.array([getattr(r, f"a{k}") for k in range(5)]), c))
    # columns that never vary tell nothing, and rows without a known value neither
    total = sum(p[3] for p in parts)
    varies = np.diag(total) > 1e-9
    parts = [(p[0] & varies, *p[1:]) for p in parts if (p[0] & varies).any()]
    degrees = int(sum(p[0].sum() for p in parts) - varies.sum())
    if degrees <= 0:
        return float("nan"), 0
    mean, cov = _moments([(p[0] | ~varies, p[1], p[2], p[3]) for p in parts])
    stat = 0.0
    for o, n, s, _ in parts:
        d = s[o] / n - mean[o]
        stat += n * float(d @ np.linalg.pinv(cov[np.ix_(o, o)]) @ d)
    return stat, degrees


def little_mcar(panel: DataFrame) -> DataFrame:
    """dataset_id, little_stat, little_df, little_p: chi-squared test that all patterns of missing values have the same means.

    One pattern alone (nothing, or everything, is missing) has no test: null and 0.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:  # at most 32 rows
        return pd.DataFrame([(rows["dataset_id"].iloc[0], *_little(rows))], columns=["dataset_id", "little_stat", "little_df"])

    made = pattern_sums(panel).groupBy(*DS).applyInPandas(run, "dataset_id string, little_stat double, little_df long")

    @F.pandas_udf("double")
    def tail(x: pd.Series, k: pd.Series) -> pd.Series:
        return pd.Series(special.chi2_upper(x.to_numpy(float), k.to_numpy(float)))

    p = F.nanvl(tail("little_stat", F.col("little_df").cast("double")), F.lit(None).cast("double"))
    return made.select(*DS, F.nanvl("little_stat", F.lit(None).cast("double")).alias("little_stat"), "little_df", p.alias("little_p"))
