"""Features of the mask by greedy forests and boosted trees: one task for the rows of a dataset.

Trees are fitted and scored on at most ``ROWS`` rows of a dataset, drawn by a hash of the row (a bounded sample); smaller datasets are used
whole.  Draws depend on the seed and the dataset's number only.  The permutation tests, which use all rows, are in ``mask_forest``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.functions import trees
from lacuna.functions.rng import row_number_sql, uniform

from .kernels import with_mask
from .mask_forest import mask_auc_permutation, pklm

DS = ["dataset_id"]
#: Rows of a dataset that a forest may use.
ROWS = 5000
#: Rows that either side of the mask needs.
LEAST_SIDE = 5
_X = ["x1", "x2", "x3", "x4"]


def by_dataset(panel: DataFrame, work, schema: str, seed: int) -> DataFrame:
    """work(rows of a dataset in order of row_id: x0f, x1..x4, mask; random generator) -> dict of values, for every dataset."""
    df = with_mask(panel)
    sizes = panel.groupBy(*DS).agg(F.count(F.lit(1)).alias("n_rows"))
    drawn = df.join(sizes, DS).where(uniform(seed + 501, row_number_sql()) < ROWS / F.col("n_rows"))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("row_id")
        rng = np.random.default_rng([seed, int(rows["dataset_no"].iloc[0])])
        return pd.DataFrame([{"dataset_id": rows["dataset_id"].iloc[0], **work(rows, rng)}])

    return drawn.select(*DS, "dataset_no", "row_id", "mask", "x0f", *_X).groupBy(*DS).applyInPandas(run, f"dataset_id string, {schema}")


def _cv_auc(codes: np.ndarray, y: np.ndarray, fold: np.ndarray, score) -> list[float]:
    got = [trees.auc(score(codes[fold != k], y[fold != k], codes[fold == k]), y[fold == k]) for k in range(int(fold.max()) + 1)]
    return [x for x in got if x == x]


def auc_self_delta(panel: DataFrame, n_trees: int = 50, depth: int = 4, least: int = 10, seed: int = 44) -> DataFrame:
    """dataset_id, caafe_auc_self_delta: what the filled X0 adds to the five-fold AUC of a forest of the mask, at least 0."""

    def work(rows, rng):
        y = rows["mask"].to_numpy()
        side = min(y.sum(), len(y) - y.sum())
        if side < LEAST_SIDE:
            return {"caafe_auc_self_delta": 0.0}
        codes, fold = trees.binned(rows[[*_X, "x0f"]].to_numpy(float)), trees.folds_of(y, int(min(5, max(2, side))), rng)
        score = lambda a, b, c: trees.forest_scores(a, b, c, n_trees, depth, least, rng)
        without, both = (_cv_auc(c, y, fold, score) for c in (codes[:, :4], codes))
        mean = lambda v: sum(v) / len(v) if v else 0.5
        return {"caafe_auc_self_delta": max(0.0, mean(both) - mean(without))}

    return by_dataset(panel, work, "caafe_auc_self_delta double", seed)


def boosted_tasks(panel: DataFrame, folds: int = 10, rounds: int = 50, depth: int = 3, least: int = 20, rate: float = 0.1, seed: int = 45) -> DataFrame:
    """dataset_id, auc_complete, auc_shuffled, auc_excluded, mwu_p: boosted trees of the mask from X0 and predictors, of a permuted mask, and from predictors alone.

    mwu_p is the two-sided U test between the fold AUCs of the first two tasks (normal approximation with corrections for ties and continuity).
    """

    def work(rows, rng):
        y = rows["mask"].to_numpy()
        side = min(y.sum(), len(y) - y.sum())
        if side < LEAST_SIDE:
            return {"auc_complete": 0.5, "auc_shuffled": 0.5, "auc_excluded": 0.5, "mwu_p": 1.0}
        codes, n = trees.binned(rows[[*_X, "x0f"]].to_numpy(float)), int(min(folds, max(2, side)))
        score = lambda a, b, c: trees.boosted_scores(a, b, c, rounds, depth, least, rate, rng)
        mixed = rng.permutation(y)
        got = [_cv_auc(c, t, trees.folds_of(t, n, rng), score) for c, t in ((codes, y), (codes, mixed), (codes[:, :4], y))]
        mean = lambda v: sum(v) / len(v) if v else 0.5
        return {"auc_complete": mean(got[0]), "auc_shuffled": mean(got[1]), "auc_excluded": mean(got[2]), "mwu_p": _u_test(got[0], got[1])}

    return by_dataset(panel, work, "auc_complete double, auc_shuffled double, auc_excluded double, mwu_p double", seed)


def _u_test(a: list[float], b: list[float]) -> float:
    n, m = len(a), len(b)
    if n < 2 or m < 2:
        return 1.0
    both = np.array([*a, *b])
    _, where, ties = np.unique(both, return_inverse=True, return_counts=True)
    rank = (np.cumsum(ties) - (ties - 1) / 2)[where]
    u = rank[:n].sum() - n * (n + 1) / 2
    spread = np.sqrt(n * m / 12 * ((n + m + 1) - (ties**3 - ties).sum() / ((n + m) * (n + m - 1))))
    from math import erfc, sqrt

    return float(erfc(max(abs(u - n * m / 2) - 0.5, 0.0) / spread / sqrt(2))) if spread > 0 else 1.0


__all__ = ["auc_self_delta", "boosted_tasks", "by_dataset", "mask_auc_permutation", "pklm"]
