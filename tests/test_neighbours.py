"""Nearest neighbours and balancing against a comparison with every row."""

import collections

import numpy as np
import pytest

from lacuna.operators import classify, neighbours

SCHEMA = "id long, label int, a double, b double"


def cloud(n, seed, kind="mixed"):
    """Rows of unlike density: clusters, a line, copies of few points (a third of all rows), far single rows."""
    rng = np.random.default_rng(seed)
    points = np.concatenate([
        rng.normal(0, 1, (n // 3, 2)), rng.integers(0, 3, (n // 3, 2)).astype(float) if kind == "mixed" else rng.normal(2, 0.1, (n // 3, 2)),
        rng.normal(3, 0.3, (n - 2 * (n // 3) - 3, 2)), [[1e6, 0], [1e6, 1], [-1e4, -1e4]],
    ])
    labels = rng.choice(3, n, p=[0.6, 0.3, 0.1])
    ids = rng.permutation(3 * n)[:n]
    return [(int(i), int(y), float(a), float(b)) for i, y, (a, b) in zip(ids, labels, points, strict=True)]


def plain(queries, among, k):
    """The k nearest rows of each query, by rounded squared distance and id."""
    near = sorted(among)
    ids, x = np.array([r[0] for r in near]), np.array([r[2:] for r in near], float)
    out = {}
    for q in queries:
        d = np.round((q[2] - x[:, 0]) ** 2 + (q[3] - x[:, 1]) ** 2, 9)
        d[ids == q[0]] = np.inf
        order = [int(i) for i in np.argsort(d, kind="stable")[:k] if d[i] < np.inf]
        out[q[0]] = [(near[i][0], near[i][1]) for i in order]
    return out


@pytest.mark.parametrize(("n", "kind"), [(10_000, "mixed"), (4_000, "dense"), (40, "mixed"), (5, "mixed")])
def test_neighbours_are_those_among_all_rows(spark, n, kind):
    rows = cloud(n, n, kind)
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r["id"]: list(zip(r["near_ids"], r["near_labels"], strict=True)) for r in neighbours.nearest(df, df, ["a", "b"], 5).collect()}
    assert got == plain(rows, rows, 5)


def test_neighbours_in_another_table(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 16)
    rows, others = cloud(600, 1), cloud(300, 2)
    others = [(r[0] + 10_000, *r[1:]) for r in others]
    queries, among = (spark.createDataFrame(x, SCHEMA) for x in (others, rows))
    got = {r["id"]: list(zip(r["near_ids"], r["near_labels"], strict=True)) for r in neighbours.nearest(queries, among, ["a", "b"], 3).collect()}
    assert got == plain(others, rows, 3)
    alone = neighbours.nearest(queries.limit(1), among.limit(0), ["a", "b"], 3).first()
    assert alone["near_ids"] == [] and neighbours.nearest(queries.limit(0), among, ["a", "b"], 3).count() == 0


def test_cleaning_of_ten_thousand_rows(spark):
    rows = cloud(10_000, 7)
    df, near = spark.createDataFrame(rows, SCHEMA), plain(rows, rows, 3)
    label = {r[0]: r[1] for r in rows}
    votes = {i: collections.Counter(y for _, y in n) for i, n in near.items()}
    most = {i: min(range(3), key=lambda y, v=v: (-v[y], y)) for i, v in votes.items()}
    assert {r["id"] for r in classify.cleaned(df, ["a", "b"], "enn").collect()} == {i for i in label if most[i] == label[i]}
    first = {i: n[0][0] for i, n in near.items()}
    linked = {i for i, j in first.items() if first[j] == i and label[i] != label[j]}
    assert len(linked) > 500
    assert {r["id"] for r in classify.cleaned(df, ["a", "b"], "tomek").collect()} == set(label) - linked


@pytest.mark.parametrize("borderline", [False, True])
def test_synthetic_rows_of_ten_thousand(spark, borderline):
    rows = cloud(10_000, 9)
    out = classify.smote(spark.createDataFrame(rows, SCHEMA), ["a", "b"], borderline=borderline).collect()
    sizes = collections.Counter(r["label"] for r in out)
    assert len(set(sizes.values())) == 1 and len({r["id"] for r in out}) == len(out)
    at = {r[0]: r for r in rows}
    seen = plain(rows, rows, 5)
    for label in range(3):
        own = [r for r in rows if r[1] == label]
        base = [r for r in own if 2 * sum(y == label for _, y in seen[r[0]]) <= len(seen[r[0]])] if borderline else own
        near, base = plain(base, own, 3), sorted(base)
        made = sorted((r for r in out if r["synthetic"] and r["label"] == label), key=lambda r: -r["id"])
        share, rest = divmod(len(made), len(base))
        owners = [b for p, b in enumerate(base) for _ in range(share + (p < rest))]
        for r, b in zip(made, owners, strict=True):  # each lies between its row and one of the three nearest of all of its class
            ends = [at[i] for i, _ in near[b[0]]]
            assert any(abs((e[2] - b[2]) * (r["b"] - b[3]) - (e[3] - b[3]) * (r["a"] - b[2])) <= 1e-9 * max(1, abs(e[2]), abs(b[2])) ** 2 for e in ends)
