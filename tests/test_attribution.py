"""Shapley values of forests against their definition, and against the forest's probabilities."""

import itertools
import math
import random

import numpy as np
import pandas as pd
import pytest

from lacuna.operators import attribution, classify

COLUMNS = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(12)
    made = [(i, a, b, c, rng.gauss(0, 1)) for i in range(240) for a, b, c in [(rng.gauss(0, 1), rng.gauss(0, 1), float(rng.randrange(3)))]]
    return spark.createDataFrame([(i, int(a > 0) + int(b * a > 0.3), a, b, c, d) for i, a, b, c, d in made], "id long, label int, a double, b double, c double, d double").cache()


def expected(tree, x, known, k=0):
    """What a tree says of x with only some features known."""
    node = tree[k]
    if node.left < 0:
        return np.array(node.weights) / sum(node.weights)
    if node.feature in known:
        return expected(tree, x, known, node.left if x[node.feature] <= node.cut else node.right)
    share = sum(tree[node.left].weights) / sum(node.weights)
    return share * expected(tree, x, known, node.left) + (1 - share) * expected(tree, x, known, node.right)


def test_values_are_those_of_all_subsets(rows):
    model = classify.fit(rows, COLUMNS, "forest")
    made = attribution.nodes(model.stages[-1]).where("tree < 4").toPandas()
    trees = [{r.id: r for r in own.itertuples()} for _, own in made.groupby("tree")]
    one = attribution.Attribution(made, 4)
    rng = np.random.default_rng(1)
    x = np.vstack([rng.normal(0, 1, (9, 4)), [[np.nan, 0.1, -0.5, np.nan]]])
    got = one.values(x)
    for i, row in enumerate(x):
        for f in range(4):
            others = [g for g in range(4) if g != f]
            want = 0.0
            for size in range(4):
                for known in itertools.combinations(others, size):
                    weight = math.factorial(size) * math.factorial(3 - size) / math.factorial(4)
                    want = want + weight * np.mean([expected(t, row, {*known, f}) - expected(t, row, set(known)) for t in trees], axis=0)
            assert got[i, f] == pytest.approx(want, abs=1e-9)


def test_values_add_up_to_the_prediction(rows):
    model = classify.fit(rows, COLUMNS, "forest")
    probability = {r["id"]: [r["p0"], r["p1"], r["p2"]] for r in classify.predict(model, rows).collect()}
    got = attribution.attributed(model, rows, COLUMNS).collect()
    assert len(got) == 240
    for r in got:
        assert np.array(r["base"]) + np.array(r["values"]).sum(axis=0) == pytest.approx(probability[r["id"]], abs=1e-9)
    mean = {r["var"]: r["mean"] for r in attribution.mean_attribution(model, rows, COLUMNS).collect()}
    assert set(mean) == set(COLUMNS) and mean["a"] > 3 * mean["d"]


def test_a_stump_and_a_bare_root():
    stump = pd.DataFrame({"tree": [0, 0, 0], "id": [0, 1, 2], "weights": [[4.0, 4.0], [4.0, 0.0], [0.0, 4.0]], "left": [1, -1, -1], "right": [2, -1, -1], "feature": [1, -1, -1], "cut": [0.5, None, None]})
    one = attribution.Attribution(stump, 2)
    assert one.values(np.array([[9.0, 0.0], [9.0, 1.0]])).tolist() == [[[0, 0], [0.5, -0.5]], [[0, 0], [-0.5, 0.5]]] and one.base.tolist() == [0.5, 0.5]
    bare = attribution.Attribution(stump.iloc[1:2].assign(id=0), 2)
    assert not bare.values(np.zeros((3, 2))).any() and bare.base.tolist() == [1.0, 0.0]


def test_change_between_levels(rows):
    out = {r["var"]: r for r in classify.level_importance_shift(rows.where("id % 3 > 0"), rows.where("id % 3 = 0"), COLUMNS).collect()}
    assert set(out) == set(COLUMNS) and out["a"]["first"] > out["d"]["first"]
    assert all(r["delta"] == pytest.approx(r["second"] - r["first"]) for r in out.values())
