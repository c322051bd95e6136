"""Permutation tests of the mask by forests, over all rows of datasets of any size.

Trees have their cuts drawn without a look at labels, by the path only, so a tree is a function of (seed, dataset, number) and one set of trees serves the mask
and all its permutations.  Everything else adds up over blocks of a dataset's rows: what each leaf holds of every permutation, and histograms of
the shares that the trees then give to rows.  Blocks draw their part of a bootstrap sample, of a permutation and of the folds by the exact distribution of
such parts given the blocks' sizes.  A dataset of one block (``BLOCK`` rows) is finished where it is; a larger one takes two passes over its
blocks, with sums of leaves added tree by tree in between.  No row is left out, and no dataset is one task.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.sources.stage import materialize

from .kernels import with_mask

DS = ["dataset_id"]
_X = ("x1", "x2", "x3", "x4")
#: Rows of a block, bins of a predictor, rows that either side of the mask needs, folds, steps of a score.
BLOCK, BINS, LEAST_SIDE, FOLDS, STEPS = 5000, 32, 5, 5, 1000


@dataclass(frozen=True)
class Forest:
    """How trees are drawn, and what is asked of them: ``held`` for five-fold scores, else out-of-bag shares."""

    permutations: int
    trees: int
    depth: int
    least: int
    seed: int
    held: bool


def drawn(spec: Forest, no: int, top: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Features and cuts (trees x nodes, for each level): a feature at random, a cut at random between the bins that the path leaves of it."""
    rng = np.random.default_rng([spec.seed, no, 1])
    low, high = np.zeros((spec.trees, 1, len(top)), np.int64), np.broadcast_to(top, (spec.trees, 1, len(top))).astype(np.int64)
    features, cuts, every = [], [], np.arange(spec.trees)[:, None]
    for level in range(spec.depth):
        nodes = np.arange(1 << level)[None, :]
        feature = rng.integers(0, len(top), (spec.trees, 1 << level))
        a, b = low[every, nodes, feature], high[every, nodes, feature]
        cut = a + np.floor(rng.random(feature.shape) * np.maximum(b - a, 1)).astype(np.int64)
        features.append(feature)
        cuts.append(cut)
        low, high = np.repeat(low, 2, axis=1), np.repeat(high, 2, axis=1)
        high[every, 2 * nodes, feature] = np.minimum(cut, b)
        low[every, 2 * nodes + 1, feature] = np.minimum(cut + 1, b)
    return features, cuts


def leaf(codes: np.ndarray, features: list[np.ndarray], cuts: list[np.ndarray], tree: int) -> np.ndarray:
    """The leaf of each row in one tree."""
    node, rows = np.zeros(len(codes), np.int64), np.arange(len(codes))
    for feature, cut in zip(features, cuts, strict=True):
        node = 2 * node + (codes[rows, feature[tree, node]] > cut[tree, node])
    return node


class Block:
    """A block of a dataset's rows: codes of predictors (rows x 4) and mask, with the sizes and missing rows of all its blocks."""

    def __init__(self, spec: Forest, rows: pd.DataFrame):
        rows = rows.sort_values("row_id")
        first = rows.iloc[0]
        self.spec, self.no, self.at = spec, int(first["dataset_no"]), int(first["block"])
        self.sizes, self.gone = np.array(first["sizes"], np.int64), np.array(first["gone"], np.int64)
        self.codes, mask = rows[["c1", "c2", "c3", "c4"]].to_numpy(np.int64), rows["mask"].to_numpy(np.int64)
        self.n, self.m, self.top = int(self.sizes.sum()), int(self.gone.sum()), np.array([first[f"top{k}"] for k in range(1, 5)], np.int64)
        self.plan = drawn(spec, self.no, self.top)
        columns = [mask]
        for k in range(spec.permutations):
            ones = int(self._rng(4, k).multivariate_hypergeometric(self.sizes, self.m, method="marginals")[self.at])
            columns.append(self._rng(5, k, self.at).permutation(len(mask)) < ones)
        self.labels = np.array(columns, np.float32).T  # rows x (mask and permutations)
        self.fold = np.empty(len(mask), np.int64)
        for side in (0, 1):  # dealt within either side, going on where earlier blocks ended
            own = np.flatnonzero(mask == side)
            before = (self.gone if side else self.sizes - self.gone)[: self.at].sum()
            self.fold[self._rng(6, side, self.at).permutation(own)] = (before + np.arange(len(own))) % FOLDS

    def _rng(self, *what: int) -> np.random.Generator:
        return np.random.default_rng([self.spec.seed, self.no, *what])

    def _weight(self, tree: int) -> np.ndarray:
        """How often each row is in the tree's bootstrap sample."""
        size = len(self.labels)
        times = self._rng(2, tree).multinomial(self.n, self.sizes / self.n)[self.at]
        return np.bincount(self._rng(3, tree, self.at).integers(0, size, times), minlength=size).astype(np.float32)

    def cells(self, tree: int) -> np.ndarray:
        at = leaf(self.codes, *self.plan, tree)
        return at * FOLDS + self.fold if self.spec.held else at

    def sums(self, tree: int) -> np.ndarray:
        """cells x (weight, then labels of each column) of a tree; a cell is a leaf, or a leaf and a fold."""
        cell, count = self.cells(tree), (1 << self.spec.depth) * (FOLDS if self.spec.held else 1)
        w = np.ones(len(cell), np.float32) if self.spec.held else self._weight(tree)
        order = np.argsort(cell, kind="stable")
        first = np.flatnonzero(np.diff(cell[order], prepend=-1))
        out = np.zeros((count, self.labels.shape[1] + 1))
        columns = np.concatenate([w[:, None], self.labels * w[:, None]], axis=1)
        if len(first):
            out[cell[order][first]] = np.add.reduceat(columns[order], first, axis=0, dtype=np.float64)
        return out

    def values(self, sums: np.ndarray) -> np.ndarray:
        """The share of label 1 in each cell (of the other folds, where scores are held out)."""
        if self.spec.held:
            own = sums.reshape(1 << self.spec.depth, FOLDS, -1)
            sums = (own.sum(axis=1, keepdims=True) - own).reshape(sums.shape)
        overall = self.m / self.n
        return np.where(sums[:, :1] >= self.spec.least, sums[:, 1:] / np.maximum(sums[:, :1], 1), overall).astype(np.float32)

    def histogram(self, sums_of) -> np.ndarray:
        """Counts of rows by column, label (and fold) and step of their mean share over the trees; sums_of(tree): the dataset's sums."""
        spec, out, times = self.spec, np.zeros_like(self.labels), np.zeros((len(self.labels), 1), np.float32)
        for tree in range(spec.trees):
            value, cell = self.values(sums_of(tree)), self.cells(tree)
            use = slice(None) if spec.held else np.flatnonzero(self._weight(tree) == 0)
            out[use] += value[cell[use]]
            times[use] += 1
        share = np.where(times > 0, out / np.maximum(times, 1), np.float32(self.m / self.n))
        columns = self.labels.shape[1]
        steps, groups = (STEPS + 1, FOLDS) if spec.held else (20, 1)
        step = np.minimum(np.floor(share * STEPS + 0.5) if spec.held else np.floor(share * 20), steps - 1).astype(np.int64)
        group = (self.fold if spec.held else np.zeros(len(share), np.int64))[:, None]
        at = ((np.arange(columns)[None, :] * groups + group) * 2 + self.labels.astype(np.int64)) * steps + step
        return np.bincount(at.ravel(), minlength=columns * groups * 2 * steps).reshape(columns, groups, 2, steps)


def divergences(counts: np.ndarray) -> np.ndarray:
    """Jensen-Shannon divergence of the shares of the two labels, for each column of a histogram (columns, 1, label, step)."""
    c = counts[:, 0].astype(float)
    p = c / np.maximum(c.sum(axis=2, keepdims=True), 1) + 1e-10
    mid = p.mean(axis=1, keepdims=True)
    return 0.5 * (p * np.log(p / mid)).sum(axis=(1, 2))


def aucs(counts: np.ndarray) -> np.ndarray:
    """The mean over folds of the chance that label 1 scores above label 0, for each column of a histogram (columns, folds, label, step)."""
    zero, one = counts[:, :, 0].astype(float), counts[:, :, 1].astype(float)
    below = np.cumsum(zero, axis=2) - zero / 2
    pairs = zero.sum(axis=2) * one.sum(axis=2)
    got = np.divide((one * below).sum(axis=2), pairs, out=np.full(pairs.shape, np.nan), where=pairs > 0)
    known = ~np.isnan(got)
    return np.where(known.any(axis=1), np.nan_to_num(got).sum(axis=1) / np.maximum(known.sum(axis=1), 1), 0.5)


def coded(panel: DataFrame) -> DataFrame:
    """dataset_id, dataset_no, row_id, mask, c1..c4 (bins of the predictors, by quantiles), top1..top4 (their last bins), block, sizes and gone (rows and missing rows of all blocks)."""
    df = with_mask(panel)
    known = {x: F.nanvl(F.col(x), F.lit(None).cast("double")) for x in _X}
    cuts = F.array(*[F.lit(k / BINS) for k in range(1, BINS)])
    edges = panel.groupBy(*DS).agg(
        F.count(F.lit(1)).alias("n"), *[F.array_sort(F.array_distinct(F.percentile(known[x], cuts))).alias(f"e{k}") for k, x in enumerate(_X, 1)], *[F.percentile(known[x], 0.5).alias(f"mid{k}") for k, x in enumerate(_X, 1)]
    )
    edges = materialize(edges.withColumn("blocks", F.ceil(F.col("n") / BLOCK)))
    each = df.join(edges, DS)
    empty = F.array().cast("array<double>")
    code = lambda k, x: F.size(F.filter(F.coalesce(f"e{k}", empty), lambda e: e < F.coalesce(known[x], F.col(f"mid{k}")))).cast("short")
    block = F.pmod(F.xxhash64("row_id"), F.col("blocks")).cast("int")
    rows = materialize(each.select(*DS, "dataset_no", "row_id", "mask", block.alias("block"), *[code(k, x).alias(f"c{k}") for k, x in enumerate(_X, 1)]))
    parts = rows.groupBy(*DS, "block").agg(F.count(F.lit(1)).alias("size"), F.sum("mask").alias("m")).groupBy(*DS).agg(F.array_sort(F.collect_list(F.struct("block", "size", "m"))).alias("parts"))
    tops = edges.select(*DS, *[F.size(F.coalesce(f"e{k}", empty)).alias(f"top{k}") for k in range(1, 5)])
    pick = lambda c: F.transform("parts", lambda p: p[c])
    kept = parts.join(tops, DS).select(*DS, pick("size").alias("sizes"), pick("m").alias("gone"), pick("block").alias("names"), *[f"top{k}" for k in range(1, 5)])
    out = rows.join(kept, DS)
    return out.withColumn("block", (F.array_position("names", F.col("block")) - 1).cast("int")).drop("names")  # empty blocks do not count


def tested(panel: DataFrame, spec: Forest, finish, schema: str, none: dict) -> DataFrame:
    """dataset_id and finish(histogram) of every dataset; ``none`` where a side of the mask has fewer than LEAST_SIDE rows."""
    rows = coded(panel)
    sum_of = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    side = F.least(sum_of("gone"), sum_of("sizes") - sum_of("gone"))
    poor = rows.where(side < LEAST_SIDE).select(*DS).distinct().select(*DS, *[F.lit(v).alias(k) for k, v in none.items()])
    rows = rows.where(side >= LEAST_SIDE)
    kinds = f"dataset_id string, {schema}"

    def alone(f: pd.DataFrame) -> pd.DataFrame:
        block = Block(spec, f)
        return pd.DataFrame([{"dataset_id": f["dataset_id"].iloc[0], **finish(block.histogram(block.sums))}])

    out = rows.where(F.size("sizes") == 1).groupBy(*DS).applyInPandas(alone, kinds).unionByName(poor.select(*DS, *none))
    large = rows.where(F.size("sizes") > 1)
    if not large.limit(1).count():
        return out
    large, by_block = materialize(large), [*DS, "block"]

    def leaves(f: pd.DataFrame) -> pd.DataFrame:
        block = Block(spec, f)
        return pd.DataFrame({"dataset_id": f["dataset_id"].iloc[0], "tree": range(spec.trees), "sums": [block.sums(t).astype(np.float64).tobytes() for t in range(spec.trees)]})

    def added(f: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(x, np.float64) for x in f["sums"])
        return pd.DataFrame({"dataset_id": [f["dataset_id"].iloc[0]], "tree": [f["tree"].iloc[0]], "sums": [total.tobytes()]})

    sums = "dataset_id string, tree int, sums binary"
    # a block holds a few thousand rows; a tree's sums, one small table for each block
    partial = materialize(large.groupBy(*by_block).applyInPandas(leaves, sums))
    total = materialize(partial.groupBy(*DS, "tree").applyInPandas(added, sums))
    sent = materialize(total.join(large.select(*by_block).distinct(), DS))
    shape = (1 << spec.depth) * (FOLDS if spec.held else 1), spec.permutations + 2

    def counted(f: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
        block, by_tree = Block(spec, f), dict(zip(s["tree"], s["sums"], strict=True))
        made = block.histogram(lambda t: np.frombuffer(by_tree[t], np.float64).reshape(shape))
        return pd.DataFrame({"dataset_id": f["dataset_id"].iloc[0], "part": range(len(made)), "counts": [x.astype(np.int64).tobytes() for x in made]})

    parts = materialize(large.groupBy(*by_block).cogroup(sent.groupBy(*by_block)).applyInPandas(counted, "dataset_id string, part int, counts binary"))
    tail = (1, 2, 20) if not spec.held else (FOLDS, 2, STEPS + 1)

    def merged(f: pd.DataFrame) -> pd.DataFrame:
        whole = sum(np.frombuffer(x, np.int64) for x in f["counts"])
        return pd.DataFrame({"dataset_id": [f["dataset_id"].iloc[0]], "part": [f["part"].iloc[0]], "counts": [whole.tobytes()]})

    def ended(f: pd.DataFrame) -> pd.DataFrame:
        made = np.stack([np.frombuffer(x, np.int64).reshape(tail) for x in f.sort_values("part")["counts"]])
        return pd.DataFrame([{"dataset_id": f["dataset_id"].iloc[0], **finish(made)}])

    whole = parts.groupBy(*DS, "part").applyInPandas(merged, "dataset_id string, part int, counts binary")
    return out.unionByName(whole.groupBy(*DS).applyInPandas(ended, kinds))


def pklm(panel: DataFrame, permutations: int = 100, n_trees: int = 100, depth: int = 5, least: int = 10, seed: int = 42) -> DataFrame:
    """dataset_id, pklm_stat, pklm_p, pklm_log_stat.

    The statistic is the divergence of the forest's out-of-bag shares between missing and observed rows; the p-value is the share
    of permuted masks that reach it.  Fewer than five rows on a side: 0 and 1.
    """

    def finish(counts: np.ndarray) -> dict:
        got = divergences(counts)
        return {"pklm_stat": float(got[0]), "pklm_p": float((got[1:] >= got[0]).mean()), "pklm_log_stat": float(np.log1p(got[0]))}

    spec = Forest(permutations, n_trees, depth, least, seed, False)
    return tested(panel, spec, finish, "pklm_stat double, pklm_p double, pklm_log_stat double", {"pklm_stat": 0.0, "pklm_p": 1.0, "pklm_log_stat": 0.0})


def mask_auc_permutation(panel: DataFrame, permutations: int = 200, n_trees: int = 100, depth: int = 5, least: int = 10, seed: int = 43) -> DataFrame:
    """dataset_id, auc_obs, auc_p, auc_z: five-fold AUC of the mask from the predictors against permuted masks; scores count to 1 / STEPS.

    Fewer than five rows on a side: 0.5, 1 and 0.
    """

    def finish(counts: np.ndarray) -> dict:
        got = aucs(counts)
        return {"auc_obs": float(got[0]), "auc_p": float((got[1:] >= got[0]).mean()), "auc_z": float((got[0] - got[1:].mean()) / max(got[1:].std(), 1e-9))}

    spec = Forest(permutations, n_trees, depth, least, seed, True)
    return tested(panel, spec, finish, "auc_obs double, auc_p double, auc_z double", {"auc_obs": 0.5, "auc_p": 1.0, "auc_z": 0.0})
