"""Attribution of a forest's probabilities to features: path-dependent Shapley values over the nodes of a fitted ``pyspark.ml`` forest.

What a tree says of a row when some features are unknown follows both ways of their cuts by the share of training rows that went each way.  A
leaf then counts as its value times a product over the features on its path, each either what the row does there (1 or 0) or the share, and the Shapley
value of such a product has a closed form in the coefficients of a polynomial.  It depends on the row only through which features it satisfies, so each
leaf has a small table of them (two to the number of its features); rows look it up.

Nodes come as a table that Spark writes with the model; trees of bounded depth go to every task, rows stay where they are.
"""

from __future__ import annotations

import uuid
from math import factorial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.sources.stage import shared_dir

#: Nodes of a forest that may be sent to every task.
NODES = 2_000_000


def nodes(model) -> DataFrame:
    """tree, id, weights (of the classes), left, right, feature, cut of each node of a fitted forest; children are -1 in leaves."""
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    path = f"{shared_dir(spark)}/lacuna-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    model.write().save(path)
    n = lambda c: F.col(f"nodeData.{c}")
    return spark.read.parquet(f"{path}/data").select(
        F.col("treeID").alias("tree"), n("id").alias("id"), n("impurityStats").alias("weights"), n("leftChild").alias("left"), n("rightChild").alias("right"),
        n("split.featureIndex").alias("feature"), F.get(n("split.leftCategoriesOrThreshold"), F.lit(0)).alias("cut"),
    )


def leaves(tree: pd.DataFrame) -> list[tuple[list[int], np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(features, lower ends, upper ends, shares, class shares) of each leaf of one tree, features once each; a row passes where low < x <= high."""
    at = {r.id: r for r in tree.itertuples()}
    out, todo = [], [(0, {})]
    while todo:
        k, held = todo.pop()
        node, size = at[k], float(np.sum(at[k].weights))
        if node.left < 0:
            ends = [held[f] for f in held]
            out.append((list(held), *(np.array([e[i] for e in ends], float) for i in range(3)), np.asarray(node.weights, float) / max(size, 1e-300)))
            continue
        for child, right in ((node.left, False), (node.right, True)):
            low, high, share = held.get(node.feature, (-np.inf, np.inf, 1.0))
            share *= float(np.sum(at[child].weights)) / max(size, 1e-300)
            todo.append((child, {**held, node.feature: (max(low, node.cut), high, share) if right else (low, min(high, node.cut), share)}))
    return out


def tables(shares: np.ndarray) -> np.ndarray:
    """Shapley values (leaf, pattern, feature) of the product of a leaf's features, for leaves with equally many: shares is (leaf, feature).

    Bit j of a pattern says that the row passes the cuts on feature j.
    """
    n, d = shares.shape
    passes = ((np.arange(1 << d)[:, None] >> np.arange(d)) & 1).astype(float)
    weight = np.array([factorial(k) * factorial(d - 1 - k) / factorial(d) for k in range(d)])
    out = np.empty((n, 1 << d, d))
    for j in range(d):
        c = np.zeros((n, 1 << d, d))  # c[k]: sum over sets of k other features that are known
        c[..., 0] = 1
        for i in range(d):
            if i != j:
                up = c * shares[:, None, i, None]
                up[..., 1:] += c[..., :-1] * passes[None, :, i, None]
                c = up
        out[..., j] = (passes[None, :, j] - shares[:, None, j]) * (c @ weight)
    return out


class Attribution:
    """The leaves of a forest, ready to be looked up."""

    def __init__(self, made: pd.DataFrame, features: int):
        self.features, self.classes = features, len(made["weights"].iloc[0])
        self.trees = [leaves(own) for _, own in made.groupby("tree")]
        self.base = np.mean([sum(v * np.prod(z) for *_, z, v in tree) for tree in self.trees], axis=0)

    def values(self, x: np.ndarray) -> np.ndarray:
        """(row, feature, class): what each feature adds to the probability of each class."""
        out = np.zeros((len(x), self.features, self.classes))
        for tree in self.trees:
            by_size: dict[int, list] = {}
            for leaf in tree:
                by_size.setdefault(len(leaf[0]), []).append(leaf)
            for d, own in by_size.items():
                if not d:
                    continue
                made = tables(np.array([z for _, _, _, z, _ in own]))
                for (feature, low, high, _, value), table in zip(own, made, strict=True):
                    v = x[:, feature]
                    passed = ~(v <= low) & ((high == np.inf) | (v <= high))  # an unknown value goes right, as in the forest
                    got = table[passed @ (1 << np.arange(d))]
                    out[:, feature, :] += got[:, :, None] * value
        return out / len(self.trees)


def attributed(model, df: DataFrame, columns: list[str]) -> DataFrame:
    """id, base and values (arrays: by class, and by feature and class) of the probabilities of a fitted pipeline that scales its features and ends in a forest."""
    made = nodes(model.stages[-1])
    if (n := made.count()) > NODES:
        raise ValueError(f"a forest of {n} nodes is too large to be sent to every task")
    shared = df.sparkSession.sparkContext.broadcast(Attribution(made.toPandas(), len(columns)))
    from pyspark.ml.functions import vector_to_array

    rows = model.transform(df.select("id", "label", *columns)).select("id", vector_to_array("scaled").alias("x"))

    def run(frames):
        one = shared.value
        for f in frames:
            x = np.array(f["x"].tolist(), float).reshape(len(f), one.features)
            got = [one.values(x[a : a + 4096]) for a in range(0, len(x), 4096)]
            values = np.concatenate(got) if got else np.zeros((0, one.features, one.classes))
            yield pd.DataFrame({"id": f["id"], "base": [one.base.tolist()] * len(f), "values": values.tolist()})

    return rows.mapInPandas(run, "id long, base array<double>, values array<array<double>>")


def mean_attribution(model, df: DataFrame, columns: list[str], label: int = 1) -> DataFrame:
    """var, mean: the mean absolute attribution of the probability of ``label`` to each feature."""
    each = attributed(model, df, columns).select(F.posexplode("values").alias("at", "own"))
    names = F.element_at(F.array(*[F.lit(c) for c in columns]), F.col("at") + 1)
    return each.groupBy(names.alias("var")).agg(F.avg(F.abs(F.coalesce(F.get("own", F.lit(label)), F.lit(0.0)))).alias("mean"))
