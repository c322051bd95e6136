"""Edge cases and recovery: what the mask's features, tests and rules say of panels with known truth."""

import math

import pytest
from pyspark.sql import functions as F

from lacuna.functions.rng import uniform_sql
from lacuna.operators import diagnose, evaluate, features, kernels, prepare, profiles, simulate
from lacuna.sources import io


def panel(spark, x0, name="d", no=1):
    rows = [(name, no, "g", i + 1, v, float(i % 7), float(i % 5), float(i % 3), float(i)) for i, v in enumerate(x0)]
    return spark.createDataFrame(rows, "dataset_id string, dataset_no long, source_group string, row_id long, x0 double, x1 double, x2 double, x3 double, x4 double")


EDGES = {
    "none missing": [float(i) for i in range(30)], "all missing": [None] * 30, "constant": [1.0, None] * 15, "few": [1.0] * 28 + [None] * 2,
    "one row": [None], "ties": [float(i % 2) if i % 3 else None for i in range(30)], "nan": [float("nan") if i % 4 == 0 else float(i) for i in range(30)],
}
FEATURES = ("moments", "little_proxy_score", "ks_obs_vs_imputed", "tail_missing_ratio", "mask_entropy", "censoring_score", "kl_density", "cond_entropy", "density_ratio")


@pytest.mark.parametrize("name", FEATURES)
def test_features_of_edge_datasets(spark, name):
    df = None
    for i, (k, v) in enumerate(EDGES.items()):
        p = panel(spark, v, k, i)
        df = p if df is None else df.unionByName(p)
    rows = getattr(features, name)(df).collect()
    assert {r["dataset_id"] for r in rows} == set(EDGES)
    assert all(v is None or not math.isnan(v) for r in rows for v in tuple(r)[1:])
    assert getattr(features, name)(df.limit(0)).count() == 0


def test_draws_do_not_depend_on_partitions(spark):
    df = spark.range(1000).withColumn("u", F.expr(uniform_sql(3, "id")))
    assert df.repartition(7).agg(F.sum("u")).first()[0] == pytest.approx(df.coalesce(1).agg(F.sum("u")).first()[0], abs=1e-9)
    low, high, mean = df.agg(F.min("u"), F.max("u"), F.avg("u")).first()
    assert 0 <= low < high < 1 and abs(mean - 0.5) < 0.05


@pytest.mark.parametrize("way", list(simulate.VARIANTS))
def test_simulation_hits_about_the_rate(spark, way):
    base = simulate.base_panel(spark, 4, 400)
    out = simulate.simulate(base, way, 0.1, 5)
    assert out.columns == base.columns and out.count() == 1600
    rate = out.groupBy("dataset_id").agg(F.avg(F.col("x0").isNull().cast("double")).alias("r")).collect()
    assert all(0 < r["r"] < 0.25 for r in rate)
    one = simulate.simulate(panel(spark, [1.0, 2.0, 3.0]), way, 0.01, 5)
    assert one.where("x0 is null").count() >= 1


def test_signals_move_the_right_way(spark):
    base = simulate.base_panel(spark, 4, 600)
    ks = {w: features.little_proxy_score(simulate.simulate(base, w, 0.1, 9)).agg(F.avg("little_proxy_score")).first()[0] for w in ("mcar_uniform", "mar_rank")}
    assert ks["mar_rank"] > ks["mcar_uniform"] + 0.1
    ratio = {w: features.moments(simulate.simulate(base, w, 0.1, 9)).agg(F.avg("X0_obs_vs_full_ratio")).first()[0] for w in ("mcar_uniform", "mnar_quantile_threshold")}
    assert ratio["mnar_quantile_threshold"] != pytest.approx(ratio["mcar_uniform"], abs=1e-4)


def test_mcnemar_golden(spark):
    rows = [(i, "g", c, "m", 0, 0, 0 if (c == "a" or i >= 6) else 1, 0.5, 0.3, 0.2) for i in range(20) for c in ("a", "b")]
    df = spark.createDataFrame(rows, "sample_id long, source_group string, config string, model string, fold int, y_true int, y_pred int, p0 double, p1 double, p2 double")
    r = evaluate.mcnemar(df, "a", "b").first()
    assert (r["b"], r["c"]) == (6, 0) and r["chi2"] == pytest.approx(25 / 6)


def test_posteriors_add_up(spark):
    ref = spark.createDataFrame([(m, [float(k) for _ in range(10)]) for k, m in enumerate(diagnose.LABELS) for _ in range(3)], "label string, ref array<double>")
    pts = spark.createDataFrame([("a", [0.1] * 10), ("b", [1.9] * 10), ("c", [0.5] * 10)], "dataset_id string, vec array<double>")
    rows = {r["dataset_id"]: r for r in diagnose.diagnose_bayes(diagnose.kde_loglik(pts, ref, 1.0)).collect()}
    assert all(r["p_mcar"] + r["p_mar"] + r["p_mnar"] == pytest.approx(1.0) for r in rows.values())
    assert rows["a"]["prediction"] == "MCAR" and rows["b"]["prediction"] == "MNAR" and rows["c"]["ambiguous"]


def test_null_p_values_do_not_count(spark):
    df = spark.createDataFrame([("a", None, 0.01, None), ("b", None, None, None), ("c", 0.01, 0.2, None), ("d", 0.01, 0.01, 0.9)], "dataset_id string, little_p double, pklm_p double, levene_p double")
    got = {r["dataset_id"]: r["rejects_mcar"] for r in diagnose.mcar_vote(df).collect()}
    assert got == {"a": True, "b": False, "c": False, "d": True}


def test_hot_deck_and_cap(spark):
    p = panel(spark, [float(i) if i % 2 else None for i in range(100)])
    full = prepare.hotdeck_impute(p, "x0")
    assert full.where("x0 is null").count() == 0 and full.join(p.where("x0 is not null").select("x0").distinct(), "x0", "left_semi").count() == 100
    assert prepare.cap_missing_rate(p).where("x0 is null").count() == 10
    none = panel(spark, [None] * 5)
    assert prepare.hotdeck_impute(none, "x0").where("x0 is null").count() == 5


def test_auc_with_ties(spark):
    df = spark.createDataFrame([("a", 1.0, 1), ("a", 1.0, 0), ("a", 2.0, 1), ("a", 0.0, 0), ("b", 1.0, 1)], "k string, s double, y int")
    got = {r["k"]: r["auc"] for r in kernels.auc(df, ["k"], "s", F.col("y")).collect()}
    assert got == {"a": 0.875, "b": None}


def test_vote_without_confidence(spark):
    df = spark.createDataFrame([("a", "MAR", 0.0, 0.5, 0.5), ("b", "MNAR", 0.9, 0.1, 0.2), ("b", "MAR", 0.1, 0.3, 0.2)], "dataset_id string, mechanism string, confidence double, consistency double, surprise double")
    got = {r["dataset_id"]: r for r in profiles.weighted_vote(df).collect()}
    assert got["a"]["vote_mcar"] == got["a"]["vote_mnar"] and got["b"]["winner"] == "MNAR" and got["b"]["agreement"] == 0.5


def test_files_round_trip(spark, tmp_path):
    for mech, name, body in (("MAR", "MAR_titanic_age_boot001.txt", "0.5\t1\t2\t3\t4\n\t1\t2\t3\t4\n"), ("MCAR", "MCAR_uniform_seed1_mr5.txt", "NaN\t0\t0\t0\t0\n")):
        (tmp_path / mech).mkdir()
        (tmp_path / mech / name).write_text("X0\tX1\tX2\tX3\tX4\n" + body)
    df = io.read_datasets(spark, str(tmp_path))
    rows = sorted((r["mechanism"], r["source_group"], r["x0"]) for r in df.where("x0 is not null").collect())
    assert df.count() == 3 and rows == [("MAR", "MAR_titanic_age", 0.5)]


def test_calibration_round_trip(spark, tmp_path):
    th = spark.createDataFrame([("auc_mar", 0.6)], "name string, threshold double")
    pts = spark.createDataFrame([(m, [0.0]) for m in ("MCAR", "MAR")], "label string, ref array<double>")
    io.write_calibration(th, pts, str(tmp_path / "c"))
    with pytest.raises(ValueError, match="MNAR"):
        io.read_calibration(spark, str(tmp_path / "c"))


def test_new_files_are_worked_on_once(spark, tmp_path):
    from lacuna.streaming.resume import process_new_files

    p = panel(spark, [1.0, None, 3.0])
    for i in range(2):
        p.write.mode("append").parquet(str(tmp_path / "in"))
        process_new_files(spark, str(tmp_path / "in"), p.schema, prepare.dataset_summary, str(tmp_path / "out"), str(tmp_path / "ck"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_wide_feature_row(spark):
    base = simulate.base_panel(spark, 3, 120)
    out = features.extract_features(simulate.simulate(base, "mar_rank", 0.1, 2), label=None)
    assert out.count() == 3 and all(v is not None for r in out.collect() for v in r)
