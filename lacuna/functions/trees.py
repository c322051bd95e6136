"""Trees on binned predictors, for the rows of one dataset at a time (numpy arrays inside a task)."""

from __future__ import annotations

import numpy as np

#: Bins of a predictor.
BINS = 32


def binned(x: np.ndarray) -> np.ndarray:
    """Each column as bin numbers: the place of a value among few distinct ones, else among quantiles; unknown values count as the median."""
    out = np.empty(x.shape, np.int64)
    for j in range(x.shape[1]):
        column = x[:, j]
        known = column[~np.isnan(column)]
        column = np.where(np.isnan(column), np.median(known) if len(known) else 0.0, column)
        edges = np.unique(column)
        if len(edges) > BINS:
            edges = np.unique(np.quantile(column, np.arange(1, BINS) / BINS, method="lower"))
        out[:, j] = np.searchsorted(edges, column, side="left")
    return np.minimum(out, BINS - 1)


def grow(codes: np.ndarray, g: np.ndarray, h: np.ndarray, count: np.ndarray, depth: int, least: int, rng: np.random.Generator, features: int):
    """One tree by greedy cuts: (feature and cut of each inner node, value g / h of each leaf).

    g: what is summed (label times weight, or gradient), h: its weight (or curvature), count: rows; a leaf has ``least`` rows.  Each node
    chooses among ``features`` features.
    """
    n, k = codes.shape
    node, plan, by_feature = np.zeros(n, np.int64), [], np.ascontiguousarray(codes.T)
    weights = [np.tile(w, k) for w in ((g, h) if count is h else (g, h, count))]
    for level in range(depth):
        nodes = 1 << level
        allowed = rng.random((nodes, k)).argsort(axis=1).argsort(axis=1) < features
        at = ((np.arange(k)[:, None] * nodes + node) * BINS + by_feature).ravel()
        left = [np.bincount(at, w, k * nodes * BINS).reshape(k, nodes, BINS).cumsum(axis=2) for w in weights]
        right = [x[:, :, -1:] - x for x in left]
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = left[0] ** 2 / left[1] + right[0] ** 2 / right[1] - left[0][:, :, -1:] ** 2 / left[1][:, :, -1:]
        gain = np.where((left[-1] >= least) & (right[-1] >= least) & allowed.T[:, :, None], gain, -1.0)
        flat = gain.transpose(1, 0, 2).reshape(nodes, k * BINS)
        top = flat.argmax(axis=1)
        good = flat[np.arange(nodes), top] > 1e-12
        feature, cut = np.where(good, top // BINS, 0), np.where(good, top % BINS, BINS)
        plan.append((feature, cut))
        node = 2 * node + (codes[np.arange(n), feature[node]] > cut[node])
    leaves = 1 << depth
    total, weight = np.bincount(node, g, leaves), np.bincount(node, h, leaves)
    return plan, np.where(weight > 0, total / np.maximum(weight, 1e-12), g.sum() / max(h.sum(), 1e-12))


def leaf_of(plan, codes: np.ndarray) -> np.ndarray:
    node = np.zeros(len(codes), np.int64)
    for feature, cut in plan:
        node = 2 * node + (codes[np.arange(len(codes)), feature[node]] > cut[node])
    return node


def forest_scores(train: np.ndarray, y: np.ndarray, test: np.ndarray, trees: int, depth: int, least: int, rng: np.random.Generator) -> np.ndarray:
    """Mean of the trees' shares of label 1, each grown on a bootstrap sample with a square root of the features at a node."""
    out = np.zeros(len(test))
    for _ in range(trees):
        w = np.bincount(rng.integers(0, len(y), len(y)), minlength=len(y)).astype(float)
        plan, value = grow(train, w * y, w, w, depth, least, rng, max(1, int(train.shape[1] ** 0.5)))
        out += value[leaf_of(plan, test)]
    return out / trees


def boosted_scores(train: np.ndarray, y: np.ndarray, test: np.ndarray, rounds: int, depth: int, least: int, rate: float, rng: np.random.Generator) -> np.ndarray:
    """Log odds by boosting of the logistic loss with Newton leaves."""
    start = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    f, out, one = np.full(len(y), start), np.full(len(test), start), np.ones(len(y))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-f))
        plan, value = grow(train, y - p, p * (1 - p) + 1e-9, one, depth, least, rng, train.shape[1])
        f += rate * value[leaf_of(plan, train)]
        out += rate * value[leaf_of(plan, test)]
    return out


def auc(score: np.ndarray, y: np.ndarray) -> float:
    """The chance that a row of label 1 scores above one of label 0 (NaN for one class)."""
    pos, neg = score[y == 1], np.sort(score[y == 0])
    if not len(pos) or not len(neg):
        return float("nan")
    return float((np.searchsorted(neg, pos, "left") + np.searchsorted(neg, pos, "right")).sum() / (2.0 * len(pos) * len(neg)))


def folds_of(y: np.ndarray, folds: int, rng: np.random.Generator) -> np.ndarray:
    """Fold of each row, dealt within labels."""
    out = np.empty(len(y), np.int64)
    for label in (0, 1):
        rows = rng.permutation(np.flatnonzero(y == label))
        out[rows] = np.arange(len(rows)) % folds
    return out
