"""Boosted trees of several classes: softmax gradients, one tree for each class a round, all classes' histograms in one aggregation a level.

Predictors are bins (one byte each).  For each level of a round one pass over the rows adds up gradients, curvatures and rows by (class, node, feature, bin);
these few sums choose the cuts of all classes, and after the last level they also give the leaves.  Scores of earlier rounds are written with the rows every
``KEEP`` rounds.  What reaches the driver is bounded by classes, nodes, features and bins, whatever the number of rows.

Defined cases: a class without rows has probability 0; one class alone has probability 1; an unknown value goes with the lowest bin.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.sources.stage import materialize

#: Bins of a predictor, and rounds after which scores are written.
BINS, KEEP = 32, 5
_RIDGE = 1.0


@dataclass
class Boosted:
    """A fitted model: base scores of the classes that occur, and for each round and class the levels (feature, cut) and leaves of a tree."""

    columns: list[str]
    edges: list[np.ndarray]
    classes: list[int]
    base: np.ndarray
    rounds: list[list[tuple[list, np.ndarray]]] = field(default_factory=list)
    losses: list[float] = field(default_factory=list)

    def codes(self, f: pd.DataFrame) -> np.ndarray:
        x = f[self.columns].to_numpy(float)
        out = np.zeros(x.shape, np.uint8)
        for j, e in enumerate(self.edges):
            out[:, j] = np.where(np.isnan(x[:, j]), 0, np.searchsorted(e, x[:, j], side="left"))
        return out

    def scores(self, codes: np.ndarray, start: np.ndarray | None = None, first: int = 0) -> np.ndarray:
        """Scores of the classes, from those of the rounds before ``first`` on."""
        out = np.tile(self.base, (len(codes), 1)) if start is None else start.copy()
        for trees in self.rounds[first:]:
            for k, (plan, leaves) in enumerate(trees):
                out[:, k] += leaves[node_of(plan, codes)]
        return out

    def transform(self, df: DataFrame) -> DataFrame:
        """df with prediction and probability (array of classes 0..2)."""
        shared = df.sparkSession.sparkContext.broadcast(self)
        most = max([2, *self.classes]) + 1

        def run(frames):
            one = shared.value
            for f in frames:
                p = np.zeros((len(f), most))
                p[:, one.classes] = softmax(one.scores(one.codes(f)))
                yield f.assign(prediction=p.argmax(axis=1).astype(float), probability=p.tolist())

        kinds = ", ".join(f"`{c}` {t}" for c, t in df.dtypes)
        return df.mapInPandas(run, f"{kinds}, prediction double, probability array<double>")


def node_of(plan: list, codes: np.ndarray) -> np.ndarray:
    node, rows = np.zeros(len(codes), np.int64), np.arange(len(codes))
    for feature, cut in plan:
        node = 2 * node + (codes[rows, feature[node]] > cut[node])
    return node


def softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _cuts(sums: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For (node, feature, bin, [g, h, n]): feature and cut of each node, and the leaves' values on both sides of it."""
    left = sums.cumsum(axis=2)
    whole = left[:, :, -1:, :]
    right = whole - left
    score = lambda s: s[..., 0] ** 2 / (s[..., 1] + _RIDGE)
    gain = np.where((left[..., 2] >= least) & (right[..., 2] >= least), score(left) + score(right) - score(whole), -1.0)
    flat = gain.reshape(len(sums), -1)
    top = flat.argmax(axis=1)
    good = flat[np.arange(len(sums)), top] > 1e-9
    feature, cut = np.where(good, top // sums.shape[2], 0), np.where(good, top % sums.shape[2], 255)
    at = np.arange(len(sums)), feature, np.minimum(cut, sums.shape[2] - 1)
    value = lambda s: s[..., 0] / (s[..., 1] + _RIDGE)
    both = np.stack([np.where(good, value(left[at]), value(whole[:, 0, 0])), np.where(good, value(right[at]), value(whole[:, 0, 0]))], axis=1)
    return feature, cut, both.ravel()


def fit(train: DataFrame, columns: list[str], rounds: int = 20, depth: int = 3, rate: float = 0.3, least: int = 5) -> Boosted:
    """A model of label (whole numbers) by the columns."""
    probs = [k / BINS for k in range(1, BINS)]
    edges = [np.unique(np.array(e, float)) for e in train.approxQuantile(columns, probs, 0.001)]
    sizes = {int(r["label"]): r["n"] for r in train.groupBy("label").agg(F.count(F.lit(1)).alias("n")).orderBy("label").collect()}
    classes, total = list(sizes), sum(sizes.values())
    model = Boosted(columns, edges, classes, np.log([n / total for n in sizes.values()]) if classes else np.zeros(0))
    if len(classes) < 2:
        return model
    k, sc = len(classes), train.sparkSession.sparkContext
    first = sc.broadcast(model)

    def coded(frames):
        for f in frames:
            codes = first.value.codes(f)
            scores = np.tile(first.value.base, (len(f), 1))
            yield pd.DataFrame({"label": np.searchsorted(classes, f["label"].to_numpy()), "codes": [c.tobytes() for c in codes], "scores": [s.tobytes() for s in scores]})

    kind = "label int, codes binary, scores binary"
    rows, kept = materialize(train.select("label", *columns).mapInPandas(coded, kind)), 0
    for number in range(rounds):
        plans: list[list] = [[] for _ in range(k)]
        for level in range(depth):
            sent = sc.broadcast((model, plans, kept))

            def sums(frames, sent=sent, level=level):
                one, own, since = sent.value
                cells = k * (1 << level) * len(columns) * BINS
                out, loss = np.zeros((3, cells)), 0.0
                for f in frames:
                    if not len(f):
                        continue
                    codes = np.frombuffer(b"".join(f["codes"]), np.uint8).reshape(len(f), -1)
                    p = softmax(one.scores(codes, np.frombuffer(b"".join(f["scores"]), float).reshape(len(f), -1), since))
                    label = f["label"].to_numpy()
                    loss -= np.log(np.maximum(p[np.arange(len(f)), label], 1e-15)).sum()
                    for c in range(k):
                        g, h = (label == c) - p[:, c], p[:, c] * (1 - p[:, c])
                        node = node_of(own[c], codes)
                        at = (((c * (1 << level) + node)[:, None] * len(columns) + np.arange(len(columns))) * BINS + codes).ravel()
                        for i, w in enumerate((g, h, np.ones(len(f)))):
                            out[i] += np.bincount(at, np.repeat(w, len(columns)), cells)
                full = np.flatnonzero(out[2])
                yield pd.DataFrame({"cell": [*full.tolist(), -1], "g": [*out[0, full], loss], "h": [*out[1, full], 0.0], "n": [*out[2, full], 0.0]})

            got = rows.mapInPandas(sums, "cell long, g double, h double, n double").groupBy("cell").agg(*[F.sum(c).alias(c) for c in "ghn"]).toPandas()  # bounded
            table = np.zeros((k * (1 << level) * len(columns) * BINS, 3))
            inner = got[got["cell"] >= 0]
            table[inner["cell"].to_numpy()] = inner[["g", "h", "n"]].to_numpy()
            table = table.reshape(k, 1 << level, len(columns), BINS, 3)
            made = [_cuts(table[c], least) for c in range(k)]
            for c in range(k):
                plans[c] = [*plans[c], made[c][:2]]
            if not level:
                model.losses.append(float(got.loc[got["cell"] < 0, "g"].sum()) / total)
        model.rounds.append([(plans[c], rate * made[c][2]) for c in range(k)])
        if (number + 1) % KEEP == 0 and number + 1 < rounds:
            sent = sc.broadcast((model, kept))

            def scored(frames, sent=sent):
                one, since = sent.value
                for f in frames:
                    codes = np.frombuffer(b"".join(f["codes"]), np.uint8).reshape(len(f), -1)
                    scores = one.scores(codes, np.frombuffer(b"".join(f["scores"]), float).reshape(len(f), -1), since)
                    yield f.assign(scores=[s.tobytes() for s in scores])

            rows, kept = materialize(rows.mapInPandas(scored, kind)), number + 1
    return model
