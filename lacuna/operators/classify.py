"""Classifiers of feature tables with ``pyspark.ml``: id, label (0, 1, 2) and feature columns in, predictions out."""

from __future__ import annotations

import random

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.classification import LinearSVC, LogisticRegression, MultilayerPerceptronClassifier, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.functions import search
from lacuna.functions.rng import uniform
from lacuna.sources.stage import materialize

from . import boosting
from .attribution import mean_attribution
from .neighbours import nearest
from .ranks import placed

SMALL = 100


def estimator(kind: str, features: int, rows: int, weight: str | None = None):
    """A classifier by name, with plainer settings for fewer than SMALL rows."""
    small = rows < SMALL
    common = {"featuresCol": "scaled", "labelCol": "label"}
    weighted = {"weightCol": weight} if weight else {}
    if kind == "forest":
        return RandomForestClassifier(numTrees=50 if small else 100, maxDepth=4 if small else 8, seed=42, **common, **weighted)
    if kind == "logistic":
        return LogisticRegression(maxIter=100, regParam=0.1 if small else 0.01, **common, **weighted)
    if kind == "perceptron":
        return MultilayerPerceptronClassifier(layers=[features, 8 if small else 32, 3], maxIter=60, seed=42, **common)
    if kind in ("linear_svm", "rbf_svm"):
        return OneVsRest(classifier=LinearSVC(maxIter=30, featuresCol="scaled"), **common)
    raise ValueError(kind)


#: Random features that stand for a Gaussian kernel.
FOURIER = 100


def fourier_features(df: DataFrame, columns: list[str], train: DataFrame, count: int = FOURIER, seed: int = 17) -> DataFrame:
    """df with ``r0``..: cosines of random projections of z-scores, whose products approximate a Gaussian kernel of width 1 / number of columns (Rahimi and Recht)."""
    rng = np.random.default_rng(seed)
    w, b = rng.normal(0, (2 / len(columns)) ** 0.5, (count, len(columns))), rng.uniform(0, 2 * np.pi, count)
    s = train.agg(*[f(c).alias(f"{k}_{c}") for c in columns for k, f in (("m", F.avg), ("s", F.stddev_pop))])  # one row
    z = F.array(*[F.when(F.col(f"s_{c}") > 1e-12, (F.col(c) - F.col(f"m_{c}")) / F.col(f"s_{c}")).otherwise(0.0) for c in columns])
    j = df.join(F.broadcast(s)).withColumn("z_scores", z)
    waves = [(F.cos(sum((F.col("z_scores")[i] * float(w[k, i]) for i in range(len(columns))), start=F.lit(float(b[k])))) * (2 / count) ** 0.5).alias(f"r{k}") for k in range(count)]
    return j.select(*df.columns, *waves)


def fit_predict(train: DataFrame, test: DataFrame, columns: list[str], kind: str) -> DataFrame:
    """Predictions of ``test`` by a classifier fitted on ``train``, of any kind."""
    if kind == "rbf_svm":
        names = [f"r{k}" for k in range(FOURIER)]
        return predict(fit(fourier_features(train, columns, train), names, kind), fourier_features(test, columns, train))
    return predict(fit(train, columns, kind), test)


def fit(train: DataFrame, columns: list[str], kind: str, weight: str | None = None):
    if kind == "boosting":  # Spark's own boosted trees are binary
        return boosting.fit(train, columns, 10 if train.limit(SMALL).count() < SMALL else 20)
    stages = [VectorAssembler(inputCols=columns, outputCol="features"), StandardScaler(inputCol="features", outputCol="scaled", withMean=True)]
    return Pipeline(stages=[*stages, estimator(kind, len(columns), train.limit(SMALL).count(), weight)]).fit(train)


def _probability(out: DataFrame):
    """The probabilities of a model's output as an array; None where it has none."""
    kind = dict(out.dtypes).get("probability")
    return None if kind is None else F.col("probability") if kind == "array<double>" else vector_to_array("probability")


def predict(model, test: DataFrame) -> DataFrame:
    """id, label, y_pred and, where the classifier has them, p0..p2 (0 for a class that its training rows lacked)."""
    out = model.transform(test)
    p = _probability(out)
    extra = [F.coalesce(F.get(p, F.lit(k)), F.lit(0.0)).alias(f"p{k}") for k in range(3)] if p is not None else []
    return out.select("id", "label", F.col("prediction").cast("int").alias("y_pred"), *extra)


def cross_validate(df: DataFrame, columns: list[str], kind: str, folds: int) -> DataFrame:
    """Predictions of every row by the model fitted without its fold (column ``fold``)."""
    out = None
    for k in range(folds):
        made = fit_predict(df.where(F.col("fold") != k), df.where(F.col("fold") == k), columns, kind).withColumn("fold", F.lit(k))
        out = made if out is None else out.unionByName(made)
    return out


def pca_share(df: DataFrame, columns: list[str], share: float = 0.95) -> DataFrame:
    """component, variance, cumulative and kept: the components that explain ``share`` of the variance of z-scores."""
    stages = [VectorAssembler(inputCols=columns, outputCol="features"), StandardScaler(inputCol="features", outputCol="scaled", withMean=True)]
    model = Pipeline(stages=[*stages, PCA(k=len(columns), inputCol="scaled", outputCol="pc")]).fit(df).stages[-1]
    rows, total = [], 0.0
    for i, v in enumerate(model.explainedVariance.toArray()):
        rows.append((i, float(v), total + float(v), total < share))
        total += float(v)
    return df.sparkSession.createDataFrame(rows, "component int, variance double, cumulative double, kept boolean")


def feature_importance(train: DataFrame, columns: list[str]) -> DataFrame:
    """var, importance, rank of a forest on the training rows."""
    values = fit(train, columns, "forest").stages[-1].featureImportances.toArray()
    order = sorted(range(len(columns)), key=lambda i: (-values[i], columns[i]))
    return train.sparkSession.createDataFrame([(columns[i], float(values[i]), r + 1) for r, i in enumerate(order)], "var string, importance double, rank int")


def _positive(train: DataFrame, test: DataFrame, columns: list[str], kind: str, name: str) -> DataFrame:
    """test with the probability of label 1 of a two-class fit."""
    out = fit(train, columns, kind).transform(test)
    return out.withColumn(name, _probability(out)[1]).select(*test.columns, name)


def hierarchical(train: DataFrame, test: DataFrame, columns: list[str], kind: str = "logistic") -> DataFrame:
    """id, label, p_rest = P(not MCAR) and p_mnar = P(MNAR | not MCAR): one fit on all rows, one on those that are not MCAR."""
    first = train.withColumn("label", (F.col("label") > 0).cast("int"))
    second = train.where("label > 0").withColumn("label", (F.col("label") == 2).cast("int"))
    made = _positive(first, test, columns, kind, "p_rest")
    return _positive(second, made, columns, kind, "p_mnar").select("id", "label", "p_rest", "p_mnar")


def level_accuracies(predictions: DataFrame) -> DataFrame:
    """level, accuracy, n: MCAR against the rest, MAR against MNAR among rows that are neither in truth nor in prediction MCAR, and all three."""
    c = predictions.select("label", "y_pred")
    one = c.select(F.lit("mcar or rest").alias("level"), ((F.col("label") > 0) == (F.col("y_pred") > 0)).alias("hit"))
    two = c.where("label > 0 and y_pred > 0").select(F.lit("mar or mnar"), F.col("label") == F.col("y_pred"))
    return one.union(two).union(c.select(F.lit("all"), F.col("label") == F.col("y_pred"))).groupBy("level").agg(F.avg(F.col("hit").cast("double")).alias("accuracy"), F.count(F.lit(1)).alias("n"))


# ---- neighbours ---------------------------------------------------------------------------------


def standardised(df: DataFrame, columns: list[str], train: DataFrame) -> DataFrame:
    """df with the columns as z-scores of ``train`` (0 where that does not vary)."""
    s = train.agg(*[f(c).alias(f"{k}_{c}") for c in columns for k, f in (("m", F.avg), ("s", F.stddev_pop))])  # one row
    z = {c: F.when(F.col(f"s_{c}") > 1e-12, (F.col(c) - F.col(f"m_{c}")) / F.col(f"s_{c}")).otherwise(0.0) for c in columns}
    return df.join(F.broadcast(s)).withColumns(z).select(*df.columns)


def _equal(labels: str, k: int):
    """How many of an array's labels are k."""
    return F.size(F.filter(labels, lambda x: x == k))


def _majority(labels: str):
    """The commonest label of an array (the lowest of equals)."""
    count = [_equal(labels, k) for k in range(3)]
    return F.when((count[0] >= count[1]) & (count[0] >= count[2]), 0).when(count[1] >= count[2], 1).otherwise(2)


def knn_classify(train: DataFrame, test: DataFrame, columns: list[str]) -> DataFrame:
    """id, label, y_pred: vote of the five nearest training rows (three, if there are fewer than a hundred) on z-scores."""
    among = standardised(train.select("id", "label", *columns), columns, train)
    near = nearest(standardised(test.select("id", "label", *columns), columns, train), among, columns, 3 if among.limit(SMALL).count() < SMALL else 5)
    return near.select("id", "label", _majority("near_labels").alias("y_pred"))


# ---- balancing -----------------------------------------------------------------------------------


def smote(df: DataFrame, columns: list[str], seed: int = 71, borderline: bool = False) -> DataFrame:
    """id, label, columns, synthetic: every class brought to the size of the largest one by points between a row and one of its nearest of the same class.

    Three neighbours (fewer, if the smallest class has no more), the nearest among all rows of the class; nothing is made if a class has one row.  Copies are
    dealt evenly over the rows in order of id.  Synthetic rows are numbered through all classes, downwards from the least id or 0; neighbour and place on
    the way are draws of that number.  ``borderline``: only rows with at least half of five neighbours of other classes are built upon (where a class has some).
    """
    sizes = {r["label"]: r["n"] for r in df.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each class
    base = materialize(df.select(F.col("id").cast("long").alias("id"), "label", *[F.col(c).cast("double").alias(c) for c in columns]))
    out = base.withColumn("synthetic", F.lit(False))
    if min(sizes.values(), default=0) < 2:
        return out
    most, k = max(sizes.values()), min(3, min(sizes.values()) - 1)
    start, made_before = min(base.agg(F.min("id")).first()[0], 0), 0
    for label, n in sorted(sizes.items()):
        if n == most:
            continue
        own, of_class, n_base = base.where(F.col("label") == label), base.where(F.col("label") == label), n
        if borderline:
            seen = materialize(nearest(own, base, columns, 5).where(_equal("near_labels", label) * 2 <= F.size("near_labels")).select(*own.columns))
            if (m := seen.count()) > 0:
                own, n_base = seen, m
        share, rest = divmod(most - n, n_base)
        copies = (F.lit(share) + F.when(F.col("place") <= rest, 1).otherwise(0)).cast("int")
        earlier = (F.col("place") - 1) * share + F.least(F.col("place") - 1, F.lit(rest))  # copies of the rows before
        ranked = placed(own.withColumn("all", F.lit(1)), ["all"], ["id"], "place").drop("all").where(copies > 0)
        near = nearest(ranked, of_class, columns, k).withColumn("copy", F.explode(F.sequence(F.lit(1), copies)))
        near = near.withColumn("synthetic_no", made_before + earlier + F.col("copy"))
        way, chosen = uniform(seed + 1, "synthetic_no"), F.col("near_values")[F.floor(uniform(seed, "synthetic_no") * F.size("near_values")).cast("int")]
        made = near.select((start - F.col("synthetic_no")).alias("id"), "label", *[(F.col(c) + way * (chosen[i] - F.col(c))).alias(c) for i, c in enumerate(columns)], F.lit(True).alias("synthetic"))
        out, made_before = out.unionByName(made), made_before + most - n
    return out


def smote_clean(df: DataFrame, columns: list[str], method: str = "enn", seed: int = 71) -> DataFrame:
    """``smote``, then rows are taken out whose label differs from that of most of their three nearest ("enn"), or that are each other's nearest
    with different labels ("tomek"); "under" draws each class down to the smallest one instead, "none" leaves all as it is."""
    if method in ("none", "under"):
        base = df.select("id", "label", *columns).withColumn("synthetic", F.lit(False))
        if method == "none":
            return base
        least = base.groupBy("label").agg(F.count(F.lit(1)).alias("n")).agg(F.min("n").alias("least"))
        ranked = placed(base.withColumn("keep_draw", uniform(seed + 3, "id")), ["label"], ["keep_draw", "id"], "keep_place")
        return ranked.join(F.broadcast(least)).where("keep_place <= least").select(*base.columns)
    return cleaned(materialize(smote(df, columns, seed)), columns, method)


def cleaned(df: DataFrame, columns: list[str], method: str) -> DataFrame:
    """df without the rows that edited neighbours ("enn") or Tomek links ("tomek") take out; neighbours are looked for among all rows."""
    near = nearest(df, df, columns, 3 if method == "enn" else 1)
    if method == "enn":
        return near.where((F.size("near_labels") == 0) | (_majority("near_labels") == F.col("label"))).select(*df.columns)
    first = materialize(near.where(F.size("near_ids") > 0).select("id", F.col("near_ids")[0].alias("met"), (F.col("near_labels")[0] != F.col("label")).alias("differ")))
    back = first.select(F.col("id").alias("met"), F.col("met").alias("id"))
    gone = first.where("differ").join(back, ["id", "met"]).select("id")
    return df.join(gone, "id", "left_anti").select(*df.columns)


# ---- calibration, search -------------------------------------------------------------------------


def platt_calibrate(train: DataFrame, test: DataFrame, columns: list[str], kind: str = "forest", folds: int = 3) -> DataFrame:
    """id, label, y_pred, p0..p2: probabilities of a classifier through a sigmoid for each class, fitted on out-of-fold scores and made to sum to one.

    train has a column ``fold``.
    """
    logit = lambda p: F.log(F.greatest(p, F.lit(1e-6)) / F.greatest(1 - F.col(p), F.lit(1e-6)))
    held = cross_validate(train, columns, kind, folds)
    made = fit_predict(train, test, columns, kind)
    for k in range(3):
        score = held.select((F.col("label") == k).cast("int").alias("is_k"), logit(f"p{k}").alias("s"))
        one = Pipeline(stages=[VectorAssembler(inputCols=["s"], outputCol="v"), LogisticRegression(featuresCol="v", labelCol="is_k", probabilityCol=f"sure{k}", rawPredictionCol=f"raw{k}", predictionCol=f"pred{k}")]).fit(score)
        made = one.transform(made.withColumn("s", logit(f"p{k}"))).withColumn(f"q{k}", F.coalesce(F.get(vector_to_array(f"sure{k}"), F.lit(1)), F.lit(0.0))).drop("s", "v", f"sure{k}", f"raw{k}", f"pred{k}")
    total = F.greatest(F.col("q0") + F.col("q1") + F.col("q2"), F.lit(1e-12))
    out = made.select("id", "label", *[(F.col(f"q{k}") / total).alias(f"p{k}") for k in range(3)])
    top = F.greatest("p0", "p1", "p2")
    return out.select("id", "label", F.when(F.col("p0") == top, 0).when(F.col("p1") == top, 1).otherwise(2).alias("y_pred"), "p0", "p1", "p2")


#: Settings that the search may choose for each kind of model.
SPACE = {
    "forest": {"trees": (10, 60), "depth": (2, 9), "share": [0.5, 0.75, 1.0]},
    "logistic": {"penalty": (1e-4, 1.0, "log")},
}


def hyperparameter_search(df: DataFrame, columns: list[str], trials: int = 8, folds: int = 3, seed: int = 42, start: int = 3) -> DataFrame:
    """level, trial, kind, trees, depth, share, penalty, accuracy, best: the history of a search for both levels (MCAR or not; MAR or MNAR), by accuracy over folds.

    After ``start`` random trials each is proposed by Parzen estimators of the good and the other trials before it (see ``functions.search``).  df has a
    column ``fold`` of whole groups (0 .. folds - 1).
    """
    history = []
    for level, sub in (("mcar or rest", df.withColumn("label", (F.col("label") > 0).cast("int"))), ("mar or mnar", df.where("label > 0").withColumn("label", (F.col("label") - 1).cast("int")))):
        rng = random.Random(seed)
        sub = materialize(sub.select("label", "fold", *columns))  # every trial reads it
        stages = [VectorAssembler(inputCols=columns, outputCol="raw_features"), StandardScaler(inputCol="raw_features", outputCol="features", withMean=True)]
        rows_of = Pipeline(stages=stages).fit(sub).transform(sub.withColumn("fold", F.col("fold").cast("int")))
        done: list[tuple[dict, float]] = []
        for _ in range(trials):
            s = search.proposed(SPACE, done, rng, start)
            if s["kind"] == "forest":
                model = RandomForestClassifier(numTrees=s["trees"], maxDepth=s["depth"], subsamplingRate=s["share"], featuresCol="features", labelCol="label", seed=seed)
            else:
                model = LogisticRegression(maxIter=50, regParam=s["penalty"], featuresCol="features", labelCol="label")
            cv = CrossValidator(estimator=model, estimatorParamMaps=[{}], evaluator=MulticlassClassificationEvaluator(labelCol="label", metricName="accuracy"), numFolds=folds, foldCol="fold")
            done.append((s, float(cv.fit(rows_of).avgMetrics[0])))
        top = max(range(trials), key=lambda i: (done[i][1], -i))
        history += [(level, i, s["kind"], s.get("trees"), s.get("depth"), s.get("share"), s.get("penalty"), score, i == top) for i, (s, score) in enumerate(done)]
    return df.sparkSession.createDataFrame(history, "level string, trial int, kind string, trees int, depth int, share double, penalty double, accuracy double, best boolean")


# ---- relevance by models --------------------------------------------------------------------------


def permutation_importance(model, df: DataFrame, columns: list[str], repeats: int = 10, seed: int = 61) -> DataFrame:
    """var, mean, std: how much accuracy falls when a column is shuffled, over ``repeats`` shuffles.

    A shuffle moves the column by a drawn distance around the rows in order of a draw; all columns and repeats are scored in one pass.
    """
    n, rng = df.count(), random.Random(seed)
    ranked = placed(df.select("id", "label", *columns).withColumn("shuffle_draw", uniform(seed, "id")), [], ["shuffle_draw", "id"], "place").drop("shuffle_draw")
    shifts = [rng.randrange(1, max(n, 2)) for _ in range(repeats)]
    other = ranked.select(F.col("place").alias("at"), F.struct(*columns).alias("other"))
    shift = F.explode(F.array(*[F.struct(F.lit(k).alias("repeat"), F.lit(x).alias("by")) for k, x in enumerate(shifts)])).alias("shift")
    each = ranked.select("*", shift).withColumn("at", (F.col("place") - 1 + F.col("shift.by")) % n + 1).join(other, "at")
    base = model.transform(df).agg(F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("base"))
    changed = each.select("label", F.col("shift.repeat").alias("repeat"), F.explode(F.array(*[
        F.struct(F.lit(c).alias("var"), *[(F.col(f"other.{c}") if c == x else F.col(x)).alias(x) for x in columns]) for c in columns])).alias("row")).select("label", "repeat", "row.*")
    hit = model.transform(changed).groupBy("var", "repeat").agg(F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("accuracy"))
    drop = hit.join(F.broadcast(base)).select("var", (F.col("base") - F.col("accuracy")).alias("fall"))
    return drop.groupBy("var").agg(F.avg("fall").alias("mean"), F.stddev_pop("fall").alias("std"))


def recursive_elimination(df: DataFrame, columns: list[str], keep: int = 15, step: int = 5) -> DataFrame:
    """var, rank, selected: the least important ``step`` features of a forest go, again and again, until ``keep`` are left (rank 1)."""
    left, rounds = list(columns), []
    while len(left) > keep:
        values = fit(df, left, "forest").stages[-1].featureImportances.toArray()
        order = sorted(range(len(left)), key=lambda i: (values[i], left[i]))
        rounds.append([left[i] for i in order[: min(step, len(left) - keep)]])
        left = [c for c in left if c not in rounds[-1]]
    rows = [(c, 1, True) for c in left] + [(c, k + 2, False) for k, gone in enumerate(reversed(rounds)) for c in gone]
    return df.sparkSession.createDataFrame(rows, "var string, rank int, selected boolean")


def level_importance_shift(train: DataFrame, test: DataFrame, columns: list[str]) -> DataFrame:
    """var, first, second, delta: mean absolute Shapley value of each feature at both levels (MCAR or not; MAR or MNAR) and its change."""
    one = lambda df: df.withColumn("label", (F.col("label") > 0).cast("int"))
    two = lambda df: df.where("label > 0").withColumn("label", (F.col("label") == 2).cast("int"))
    first, second = (mean_attribution(fit(f(train), columns, "forest"), f(test), columns).select("var", F.col("mean").alias(n)) for f, n in ((one, "first"), (two, "second")))
    return first.join(second, "var", "left").select("var", "first", F.coalesce("second", F.lit(0.0)).alias("second")).withColumn("delta", F.col("second") - F.col("first"))
