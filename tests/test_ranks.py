"""Work by ranges and blocks, and the distance correlation, against plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lacuna.operators import ranks, residuals


def test_running_sums_and_neighbours_of_a_group_in_many_ranges(spark):
    rng = random.Random(4)
    rows = [(i, "hot" if i % 10 else f"g{i % 7}", rng.randrange(50)) for i in range(700)]
    df = spark.createDataFrame(rows, "id long, g string, v long").repartition(6)
    placed = ranks.placed(df, ["g"], ["v", "id"], "place", {"upto": F.col("v")})
    near = {"before": lambda w: F.lag("v", 2).over(w), "after": lambda w: F.lead("v", 2).over(w)}
    got = {r["id"]: r for r in ranks.with_near(placed, ["g"], "place", 2, near, block=5).collect()}
    assert len(got) == len(rows)
    for g in {r[1] for r in rows}:
        own = sorted((v, i) for i, k, v in rows if k == g)
        for k, (_, i) in enumerate(own):
            assert got[i]["place"] == k + 1 and got[i]["upto"] == sum(x for x, _ in own[: k + 1])
            assert got[i]["before"] == (own[k - 2][0] if k >= 2 else None) and got[i]["after"] == (own[k + 2][0] if k + 2 < len(own) else None)


def plain_dcor(a, b):
    centred = lambda x: (d := np.abs(x[:, None] - x[None, :])) - d.mean(axis=0) - d.mean(axis=1)[:, None] + d.mean()
    x, y = centred(np.array(a, float)), centred(np.array(b, float))
    spread = np.sqrt((x * x).mean() * (y * y).mean())
    return float(np.sqrt(max((x * y).mean(), 0) / spread)) if spread > 1e-12 else 0.0


def test_distance_correlation_is_that_of_the_definition(spark):
    rng = np.random.default_rng(3)
    panels = {
        "line": [(x, 2 * x) for x in rng.normal(0, 1, 50)], "square": [(x, x * x) for x in rng.normal(0, 1, 300)], "free": list(zip(rng.normal(0, 1, 200), rng.normal(5, 9, 200), strict=True)),
        "ties": [(float(rng.integers(0, 4)), float(rng.integers(0, 2))) for _ in range(120)], "two": [(0.0, 1.0), (1.0, 0.0)], "constant": [(1.0, float(i)) for i in range(9)], "one": [(1.0, 1.0)],
        "far": [(1e8 + x, x) for x in rng.normal(0, 1, 40)],
    }
    rows = [(g, i, float(a), float(b)) for g, own in panels.items() for i, (a, b) in enumerate(own)]
    df = spark.createDataFrame(rows, "g string, row long, a double, b double")
    got = {r["g"]: r["dcor"] for r in residuals.distance_correlation(df, ["g"], "a", "b", "row").collect()}
    assert set(got) == set(panels)
    for g, own in panels.items():
        assert got[g] == pytest.approx(plain_dcor(*zip(*own, strict=True)), abs=1e-6), g


def test_groups_are_dealt_as_one_by_one():
    rng = random.Random(9)
    from lacuna.operators import evaluate

    for _ in range(400):
        folds, sizes = rng.randrange(1, 7), sorted((rng.choice([1, 2, 3, 7, 50, 1000]) for _ in range(rng.randrange(1, 60))), reverse=True)
        load, want = [0] * folds, []
        for s in sizes:
            f = min(range(folds), key=lambda f: (load[f], f))
            load[f] += s
            want.append(f)
        kinds = sorted({(s, sizes.count(s)) for s in sizes}, reverse=True)
        turns, got = evaluate.dealt(kinds, folds), []
        for s, n in kinds:
            own = [t for t in turns if t[0] == s]
            for place in range(1, n + 1):
                _, first, cycle = [t for t in own if t[1] <= place][-1]
                got.append(cycle[(place - first) % len(cycle)])
        assert got == want
        assert len(turns) <= len(kinds) * folds
