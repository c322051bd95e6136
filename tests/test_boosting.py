"""Boosting of several classes: loss, probabilities, and a round against plain sums."""

import random

import numpy as np
import pandas as pd
import pytest

from lacuna.operators import boosting, classify


@pytest.fixture(scope="module")
def rings(spark):
    rng = random.Random(3)
    made = [(i, rng.uniform(-1, 1), rng.uniform(-1, 1)) for i in range(900)]
    return spark.createDataFrame([(i, min(2, int(3 * (a * a + b * b))), a, b) for i, a, b in made], "id long, label int, a double, b double").cache()


def test_loss_falls_and_probabilities_add_up(rings):
    model = boosting.fit(rings.where("id % 3 > 0"), ["a", "b"], rounds=12)
    assert len(model.losses) == 12 and all(y < x for x, y in zip(model.losses, model.losses[1:], strict=False))
    out = classify.predict(model, rings.where("id % 3 = 0")).collect()
    assert all(abs(r["p0"] + r["p1"] + r["p2"] - 1) < 1e-9 for r in out)
    assert np.mean([r["label"] == r["y_pred"] for r in out]) > 0.85


def test_first_round_is_that_of_plain_sums(rings):
    model = boosting.fit(rings.repartition(5), ["a", "b"], rounds=1, depth=1, rate=1.0)
    f = rings.toPandas()
    codes, share = model.codes(f), f["label"].value_counts(normalize=True).sort_index().to_numpy()
    for c in range(3):
        g, h, best = (f["label"] == c) - share[c], share[c] * (1 - share[c]), (-1.0,)
        for j in range(2):
            for cut in range(31):
                left = codes[:, j] <= cut
                if min(left.sum(), (~left).sum()) >= 5:
                    sides = [(g[s].sum(), h * s.sum() + 1) for s in (left, ~left)]
                    gain = sum(a * a / b for a, b in sides) - g.sum() ** 2 / (h * len(f) + 1)
                    if gain > best[0] + 1e-9:
                        best = (gain, j, cut, [a / b for a, b in sides])
        plan, leaves = model.rounds[0][c]
        assert (plan[0][0][0], plan[0][1][0]) == best[1:3] and leaves == pytest.approx(best[3])


def test_odd_tables(spark, rings):
    two = boosting.fit(rings.where("label <> 1"), ["a", "b"], rounds=3)
    assert classify.predict(two, rings).where("p1 = 0 and abs(p0 + p2 - 1) < 1e-9").count() == 900
    one = boosting.fit(rings.where("label = 2"), ["a", "b"], rounds=3)
    assert classify.predict(one, rings.limit(5)).where("p2 = 1 and y_pred = 2").count() == 5
    assert two.codes(pd.DataFrame({"a": [np.nan, 9.0], "b": [0.0, -9.0]}))[:, 0].tolist() == [0, len(two.edges[0])]
    assert classify.predict(two, rings.limit(0)).count() == 0
