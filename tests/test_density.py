"""Kernel densities by blocks of reference points against the definition."""

import math

import numpy as np
import pytest

from lacuna.operators import diagnose


@pytest.mark.parametrize("together", [3, 512])
def test_densities_under_all_reference_points(spark, together):
    rng = np.random.default_rng(2)
    refs = [("MCAR", rng.normal(0, 1, 3).tolist()) for _ in range(20)] + [("MAR", rng.normal(50, 1, 3).tolist()) for _ in range(7)] + [("MNAR", [0.0, 0.0, 0.0])] * 2
    points = [(f"D{i}", rng.normal(0, 2, 3).tolist()) for i in range(9)]
    reference = spark.createDataFrame(refs, "label string, ref array<double>")
    got = {(r["dataset_id"], r["label"]): r["loglik"] for r in diagnose.kde_loglik(spark.createDataFrame(points, "dataset_id string, vec array<double>"), reference, 0.7, 3, together).collect()}
    assert len(got) == 27
    for name, x in points:
        for label in ("MCAR", "MAR", "MNAR"):
            e = [-sum((a - b) ** 2 for a, b in zip(x, r, strict=True)) / (2 * 0.49) for k, r in refs if k == label]
            top = max(e)
            want = top + math.log(sum(math.exp(v - top) for v in e)) - math.log(len(e)) - 3 * (math.log(0.7) + 0.5 * math.log(2 * math.pi))
            assert got[name, label] == pytest.approx(want, rel=1e-9)
    assert diagnose.kde_loglik(spark.createDataFrame(points, "dataset_id string, vec array<double>"), reference.limit(0), 0.7, 3).count() == 0


def _log_density(x, refs, h):
    e = [-sum((a - b) ** 2 for a, b in zip(x, r, strict=True)) / (2 * h * h) for r in refs]
    return max(e) + math.log(sum(math.exp(v - max(e)) for v in e)) - math.log(len(e)) - len(x) * (math.log(h) + 0.5 * math.log(2 * math.pi))


@pytest.mark.parametrize("together", [2, 512])
def test_held_out_densities_use_all_points_of_other_folds(spark, together):
    rng = np.random.default_rng(5)
    rows = [(f"D{i}", ("MCAR", "MAR", "MNAR")[i % 3], i // 3 % 4, rng.normal(i % 3, 1, 2).tolist()) for i in range(40)]
    rows += [("twin", "MAR", 0, rows[1][3]), ("far", "MNAR", 1, [500.0, -500.0])]
    points = spark.createDataFrame(rows, "dataset_id string, label string, fold int, vec array<double>")
    others = lambda label, fold: [r[3] for r in rows if r[1] == label and r[2] != fold]
    got = {(r["dataset_id"], r["label"]): r["loglik"] for r in diagnose.bayes_cv(points, 0.8, 2, together).collect()}
    assert got == {(name, label): pytest.approx(_log_density(x, others(label, fold), 0.8), rel=1e-9) for name, _, fold, x in rows for label in ("MCAR", "MAR", "MNAR")}
    widths = {r["bandwidth"]: (r["loglik"], r["best"]) for r in diagnose.select_bandwidth(points, 5, 2, together).collect()}
    want = {h: sum(_log_density(x, others(label, fold), h) for _, label, fold, x in rows) for h in widths}
    assert len(widths) == 5 and all(widths[h][0] == pytest.approx(want[h], rel=1e-9) for h in want)
    assert [h for h, (_, best) in widths.items() if best] == [max(want, key=want.get)]


def test_points_of_one_fold_have_no_density(spark):
    points = spark.createDataFrame([("a", "MAR", 1, [0.0]), ("b", "MAR", 1, [1.0])], "dataset_id string, label string, fold int, vec array<double>")
    assert diagnose.bayes_cv(points, 1.0, 1).count() == 0 and diagnose.bayes_cv(points.limit(0), 1.0, 1).count() == 0
