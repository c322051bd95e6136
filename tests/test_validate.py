"""Tests of the mask, forests, residuals, neighbours and balancing against plain versions; the protocol on panels of known mechanism."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lacuna.functions import digamma, special, trees
from lacuna.operators import classify, forest, nearest, patterns, ranks, residuals, validate

SCHEMA = "dataset_id string, dataset_no long, source_group string, row_id long, x0 double, x1 double, x2 double, x3 double, x4 double, label int, mechanism string"


def _panel(kind, no, n=300, seed=0):
    rng = np.random.default_rng([seed, no])
    x = rng.normal(0, 1, (n, 5))
    if kind == "MCAR":
        gone = rng.random(n) < 0.2
    elif kind == "MAR":
        gone = rng.random(n) < np.clip(1 / (1 + np.exp(-3 * x[:, 1])) * 0.4, 0, 0.95)
    else:
        gone = x[:, 0] > np.quantile(x[:, 0], 0.8)
    return [(f"D{no}", no, "g", i, None if gone[i] else float(x[i, 0]), *map(float, x[i, 1:]), ("MCAR", "MAR", "MNAR").index(kind), kind) for i in range(n)]


@pytest.fixture(scope="module")
def panel(spark):
    rows = _panel("MCAR", 0) + _panel("MAR", 1) + _panel("MNAR", 2)
    rows += [("E1", 3, "g", i, float(i), 1.0, 2.0, float(i % 3), 0.5, 0, "MCAR") for i in range(40)]  # nothing missing
    rows += [("E2", 4, "g", i, None, 1.0, 2.0, float(i % 3), float("nan") if i % 5 == 0 else 0.5, 0, "MCAR") for i in range(40)]  # all missing, gaps in a predictor
    rows += [("E3", 5, "g", 0, 1.0, 1.0, 1.0, 1.0, 1.0, 0, "MCAR")]
    return spark.createDataFrame(rows, SCHEMA)


def by(df):
    return {r["dataset_id"]: r for r in df.collect()}


def test_little_follows_the_mechanism(panel):
    got = by(patterns.little_mcar(panel))
    assert got["D0"]["little_p"] > 0.01 and got["D1"]["little_p"] < 1e-6 and got["D0"]["little_df"] == 4
    assert got["E1"]["little_p"] is None and got["E3"]["little_p"] is None


def test_little_equals_its_definition(spark):
    """Patterns in several columns: the statistic at moments that no further EM step moves."""
    rng = np.random.default_rng(5)
    x = rng.normal(0, 1, (200, 5)) @ rng.normal(0, 1, (5, 5))
    x[rng.random((200, 5)) < 0.15] = np.nan
    x = x[~np.isnan(x).all(axis=1)]
    rows = [("A", 1, "g", i, *[None if math.isnan(v) else float(v) for v in r], 0, "MCAR") for i, r in enumerate(x)]
    got = patterns.little_mcar(spark.createDataFrame(rows, SCHEMA)).first()
    mean, cov = np.nanmean(x, axis=0), np.diag(np.nanvar(x, axis=0))
    for _ in range(400):
        first, second = np.zeros(5), np.zeros((5, 5))
        for r in x:
            o = ~np.isnan(r)
            full, rest = r.copy(), np.zeros((5, 5))
            if not o.all():
                b = cov[np.ix_(~o, o)] @ np.linalg.inv(cov[np.ix_(o, o)])
                full[~o] = mean[~o] + b @ (r[o] - mean[o])
                rest[np.ix_(~o, ~o)] = cov[np.ix_(~o, ~o)] - b @ cov[np.ix_(o, ~o)]
            first += full
            second += np.outer(full, full) + rest
        mean, cov = first / len(x), second / len(x) - np.outer(first, first) / len(x) ** 2
    stat, degrees = 0.0, -5
    for key in {tuple(~np.isnan(r)) for r in x}:
        o = np.array(key)
        own = np.array([r[o] for r in x if (~np.isnan(r) == o).all()])
        d = own.mean(axis=0) - mean[o]
        stat, degrees = stat + len(own) * d @ np.linalg.inv(cov[np.ix_(o, o)]) @ d, degrees + o.sum()
    assert got["little_df"] == degrees and got["little_stat"] == pytest.approx(stat, rel=1e-4)


def test_forest_tests_tell_a_mask_that_follows_predictors(panel):
    p, a, d = by(forest.pklm(panel, 60, 40)), by(forest.mask_auc_permutation(panel, 60, 40)), by(forest.auc_self_delta(panel, 15))
    assert p["D0"]["pklm_p"] > 0.02 and p["D1"]["pklm_p"] < 0.02
    assert a["D1"]["auc_obs"] > 0.7 and a["D1"]["auc_p"] < 0.02 and a["D1"]["auc_z"] > 3 and a["D0"]["auc_p"] > 0.02
    assert d["D2"]["caafe_auc_self_delta"] > 0.2 and all(d[k]["caafe_auc_self_delta"] == 0 for k in ("E1", "E2", "E3"))
    assert (p["E1"]["pklm_stat"], p["E1"]["pklm_p"]) == (0, 1) and (a["E3"]["auc_obs"], a["E3"]["auc_p"]) == (0.5, 1)
    assert by(forest.pklm(panel.repartition(7), 60, 40)) == p  # draws depend on rows only


def test_boosted_tasks(panel):
    got = by(forest.boosted_tasks(panel, 4, 20))
    assert got["D1"]["auc_excluded"] > 0.65 and got["D2"]["auc_complete"] - got["D2"]["auc_excluded"] > 0.2 and abs(got["D0"]["auc_shuffled"] - 0.5) < 0.25


def test_trees_add_up():
    rng = np.random.default_rng(3)
    codes, y = rng.integers(0, 9, (80, 3)), rng.integers(0, 2, 80)
    w = np.ones(80)
    plan, value = trees.grow(codes, w * y, w, w, 3, 5, rng, 3)
    leaf = trees.leaf_of(plan, codes)
    for k in set(leaf.tolist()):
        assert (leaf == k).sum() >= 5 and value[k] == pytest.approx(y[leaf == k].mean())
    assert trees.auc(np.array([1, 2, 2, 3.0]), np.array([0, 0, 1, 1])) == 0.875


def brute_mi(v, label, k=3):
    n, out = len(v), []
    psi = lambda x: -0.5772156649015329 + sum(1 / i for i in range(1, x))
    for i in range(n):
        own = sorted(abs(v[i] - v[j]) for j in range(n) if label[j] == label[i] and j != i)
        m = min(k, len(own))
        out.append(psi(m) - psi(len(own) + 1) - psi(max(1, sum(abs(v[i] - x) < own[m - 1] for x in v))))
    return max(0.0, psi(n) + sum(out) / n)


def test_mutual_information_equals_its_definition(spark):
    rng = random.Random(3)
    rows = [(i, "a", rng.gauss(0, 1) + 3 * (i % 2), i % 2) for i in range(60)] + [(100 + i, "b", rng.gauss(0, 1), i % 3) for i in range(50)]
    got = {r["var"]: r["mi"] for r in nearest.mutual_information(spark.createDataFrame(rows, "id long, var string, value double, label int"), ["var"], "id", "label").collect()}
    for var in "ab":
        own = [r for r in rows if r[1] == var]
        assert got[var] == pytest.approx(brute_mi([r[2] for r in own], [r[3] for r in own]), abs=1e-4)
    assert got["a"] > 0.05


def test_digamma(spark):
    for x in (1, 2, 7, 300):
        got = spark.sql(f"select {digamma.digamma_sql(str(x))} as d").first()[0]
        assert got == pytest.approx(-0.5772156649015329 + sum(1 / i for i in range(1, x)), abs=1e-8)


def test_residuals_equal_plain_least_squares(panel):
    got = by(residuals.residual_dependence(panel))
    for k, no in (("D0", 0), ("D2", 2)):
        rows = _panel(("MCAR", "MAR", "MNAR")[no], no)
        x0 = np.array([np.nan if r[4] is None else r[4] for r in rows])
        x = np.column_stack([np.ones(len(rows)), [r[5:9] for r in rows]])
        filled, mask = np.where(np.isnan(x0), np.nanmedian(x0), x0), np.isnan(x0).astype(float)
        left = [y - x @ np.linalg.lstsq(x, y, rcond=None)[0] for y in (filled, mask)]
        assert got[k]["adv_residual_pearson_X0_mask"] == pytest.approx(abs(np.corrcoef(*left)[0, 1]), abs=1e-6)
        rank = [np.argsort(np.argsort(v)) for v in left]
        assert got[k]["adv_residual_spearman_X0_mask"] == pytest.approx(abs(np.corrcoef(*rank)[0, 1]), abs=1e-6)
    assert got["E3"]["adv_partial_dcor_X0_mask"] == 0


def test_imputations(panel):
    got = by(residuals.imputation_divergence(panel))
    assert got["E1"]["adv_imputation_cv"] == got["E2"]["adv_imputation_cv"] == 0 and 0 < got["D2"]["adv_imputation_divergence_ks"] <= 1
    rng = np.random.default_rng(2)
    x = rng.normal(0, 1, (400, 4))
    y = x @ np.array([1.0, -2.0, 0.5, 0.0]) + 3 + rng.normal(0, 0.1, 400)
    slopes, base = residuals.bayesian_ridge(x, y)
    assert slopes == pytest.approx([1, -2, 0.5, 0], abs=0.03) and base == pytest.approx(3, abs=0.03)
    near = residuals.nearest_means(np.array([[0.0], [9.0]]), np.arange(10.0)[:, None], np.arange(10.0) * 10, 3)
    assert near.tolist() == [10.0, 80.0]


def test_places_without_one_task_for_a_group(spark):
    rng = random.Random(4)
    rows = [("a" if i % 9 else "b", rng.randrange(50), i) for i in range(700)]
    got = ranks.placed(spark.createDataFrame(rows, "g string, v int, id long").repartition(5), ["g"], ["v", "id"], "place").collect()
    for g in "ab":
        own = sorted((r for r in got if r["g"] == g), key=lambda r: (r["v"], r["id"]))
        assert [r["place"] for r in own] == list(range(1, len(own) + 1))


def test_balancing(spark):
    rng = random.Random(6)
    rows = [(i, 0, rng.gauss(0, 1), rng.gauss(0, 1)) for i in range(60)] + [(100 + i, 1, rng.gauss(4, 1), rng.gauss(4, 1)) for i in range(13)] + [(200 + i, 2, rng.gauss(-4, 1), 0.0) for i in range(7)]
    df = spark.createDataFrame(rows, "id long, label int, a double, b double")
    out = classify.smote(df, ["a", "b"]).collect()
    assert {k: sum(r["label"] == k for r in out) for k in range(3)} == {0: 60, 1: 60, 2: 60} and len({r["id"] for r in out}) == 180
    points = {k: [(r[2], r[3]) for r in rows if r[1] == k] for k in range(3)}
    for r in out:
        if r["synthetic"]:  # on a way between a row and one of its three nearest of the same class
            on = False
            for p in points[r["label"]]:
                for q in sorted(points[r["label"]], key=lambda q, p=p: (q[0] - p[0]) ** 2 + (q[1] - p[1]) ** 2)[1:4]:
                    cross = (q[0] - p[0]) * (r["b"] - p[1]) - (q[1] - p[1]) * (r["a"] - p[0])
                    on |= abs(cross) < 1e-9 and min(p[0], q[0]) - 1e-9 <= r["a"] <= max(p[0], q[0]) + 1e-9
            assert on
    assert classify.smote(df.where("label = 0 or id = 100"), ["a", "b"]).count() == 61
    clean = classify.smote_clean(df, ["a", "b"], "enn").groupBy("label").count().collect()
    assert all(r["count"] > 50 for r in clean) and classify.smote_clean(df, ["a", "b"], "under").count() == 21
    assert classify.smote_clean(df, ["a", "b"], "tomek").count() <= 180 and classify.smote(df, ["a", "b"], borderline=True).count() == 180


def test_neighbours_vote(spark):
    rng = random.Random(8)
    rows = [(i, i % 3, rng.gauss(3 * (i % 3), 0.5), rng.gauss(0, 1)) for i in range(150)]
    df = spark.createDataFrame(rows, "id long, label int, a double, b double")
    got = classify.knn_classify(df.where("id < 120"), df.where("id >= 120"), ["a", "b"]).collect()
    assert sum(r["label"] == r["y_pred"] for r in got) >= 26


def test_importance_of_a_shuffled_column(spark):
    rng = random.Random(9)
    rows = [(i, i % 2, float(i % 2) + rng.gauss(0, 0.1), rng.gauss(0, 1)) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, label int, a double, b double")
    got = {r["var"]: r["mean"] for r in classify.permutation_importance(classify.fit(df, ["a", "b"], "forest"), df, ["a", "b"], 4).collect()}
    assert got["a"] > 0.3 > abs(got["b"])


def test_signed_ranks():
    assert special.signed_rank_two_sided(np.array([0.0, 7.0]), np.array([5.0, 5.0])).tolist() == [0.0625, pytest.approx(2 * 16 / 32 if 16 / 32 < 0.5 else 1.0)]
    big = special.signed_rank_two_sided(np.array([500.0]), np.array([60.0]))[0]
    assert 0 < big < 0.01


def test_the_protocol_on_known_panels(panel):
    got = by(validate.validate_datasets(panel, permutations=40))
    assert len(got) == 6 and got["D0"]["prediction"] == "MCAR" and got["D1"]["rejects_mcar"] and got["D1"]["prediction"] == "MAR"
    assert got["D2"]["caafe_auc_self_delta"] > 0.05 and got["E3"]["n_tests_valid"] <= 1
    points = validate.score_vector(validate.scores(panel, 20)).select(F.when(F.col("dataset_id") == "D1", "MAR").when(F.col("dataset_id") == "D2", "MNAR").otherwise("MCAR").alias("label"), F.col("vec").alias("ref"))
    bayes = by(validate.validate_datasets(panel, 20, reference=points))
    assert bayes["D1"]["prediction"] == "MAR" and bayes["D1"]["p_mar"] > 0.5
