"""Classifiers on separable clouds; folds of whole groups."""

import random

import pytest

from lacuna.operators import classify, evaluate


@pytest.fixture(scope="module")
def clouds(spark):
    rng = random.Random(1)
    rows = [(i, i % 3, rng.gauss(3 * (i % 3), 0.5), rng.gauss(0, 1), i % 4) for i in range(240)]
    return spark.createDataFrame(rows, "id long, label int, a double, b double, fold int").cache()


@pytest.mark.parametrize("kind", ["forest", "logistic", "perceptron", "boosting", "linear_svm"])
def test_separable_classes(clouds, kind):
    out = classify.predict(classify.fit(clouds.where("id % 5 <> 0"), ["a", "b"], kind), clouds.where("id % 5 = 0"))
    hits = out.where("label = y_pred").count() / out.count()
    assert hits > (0.6 if kind == "linear_svm" else 0.9)  # one linear cut cannot hold the middle class


def test_components_importance_and_folds(clouds):
    pca = classify.pca_share(clouds, ["a", "b"]).collect()
    assert pca[-1]["cumulative"] == pytest.approx(1.0)
    assert classify.feature_importance(clouds, ["a", "b"]).where("rank = 1").first()["var"] == "a"
    folded = evaluate.group_kfold(clouds.drop("fold").withColumnRenamed("label", "g"), "g", 2)
    assert folded.groupBy("g").agg({"fold": "min"}).count() == 3 and folded.count() == 240


def test_two_levels(clouds):
    from lacuna.operators import evaluate

    out = evaluate.route(classify.hierarchical(clouds.where("id % 5 <> 0"), clouds.where("id % 5 = 0"), ["a", "b"]), "hard")
    acc = {r["level"]: r["accuracy"] for r in classify.level_accuracies(out).collect()}
    assert acc["all"] > 0.9 and acc["mcar or rest"] > 0.9


def test_gaussian_kernel_holds_the_middle_class(clouds):
    out = classify.fit_predict(clouds.where("id % 5 <> 0"), clouds.where("id % 5 = 0"), ["a", "b"], "rbf_svm")
    assert out.where("label = y_pred").count() / out.count() > 0.85


def test_a_class_that_training_lacked_has_no_probability(clouds):
    out = classify.predict(classify.fit(clouds.where("label < 2"), ["a", "b"], "logistic"), clouds.where("label = 2"))
    assert out.where("p2 = 0 and p0 + p1 > 0.99").count() == 80
