"""Evaluation of predictions: confusion counts, reports, comparisons, resampling and paired tests.

Predictions: sample_id, source_group, config, model, fold, y_true, y_pred, p0, p1, p2; classes 0 MCAR, 1 MAR, 2 MNAR.
Everything after the confusion counts works on a few rows for each model.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lacuna.functions import exact, special
from lacuna.functions.draws import multinomial
from lacuna.functions.rng import uniform
from lacuna.sources.stage import materialize

from .ranks import placed
from .tests import _tail

CLASSES = (0, 1, 2)
BY = ["config", "model"]


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def confusion_matrix(predictions: DataFrame, by: list[str] = BY) -> DataFrame:
    """by, y_true, n_pred_0, n_pred_1, n_pred_2; every class of truth has its row."""
    grid = predictions.select(*by).distinct().withColumn("y_true", F.explode(F.array(*map(F.lit, CLASSES))))
    counts = predictions.groupBy(*by, "y_true").pivot("y_pred", list(CLASSES)).count()
    return grid.join(counts, [*by, "y_true"], "left").select(*by, "y_true", *[F.coalesce(F.col(str(c)), F.lit(0)).alias(f"n_pred_{c}") for c in CLASSES])


def classification_report(predictions: DataFrame, by: list[str] = BY) -> DataFrame:
    """by, class, precision, recall, f1, support, and the accuracy and macro F1 of the model (0 where a share has no base)."""
    m = confusion_matrix(predictions, by)
    total = W.partitionBy(*by)
    hit = sum((F.when(F.col("y_true") == c, F.col(f"n_pred_{c}")).otherwise(0) for c in CLASSES), start=F.lit(0))
    support = sum((F.col(f"n_pred_{c}") for c in CLASSES), start=F.lit(0))
    predicted = F.lit(0)
    for c in CLASSES:
        predicted = F.when(F.col("y_true") == c, F.sum(f"n_pred_{c}").over(total)).otherwise(predicted)
    each = m.select(*by, F.col("y_true").alias("class"), hit.alias("hit"), support.alias("support"), predicted.alias("predicted"))
    each = each.withColumns({"precision": _ratio(F.col("hit"), F.col("predicted")), "recall": _ratio(F.col("hit"), F.col("support"))})
    each = each.withColumn("f1", _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    return each.select(
        *by, "class", "precision", "recall", "f1", "support",
        _ratio(F.sum("hit").over(total), F.sum("support").over(total)).alias("accuracy"), F.avg("f1").over(total).alias("macro_f1"),
    )


def accuracy_by_group(predictions: DataFrame) -> DataFrame:
    """source_group, config, model, n, accuracy, label (the commonest truth, the lowest of equals) and place from the worst."""
    a = predictions.groupBy("source_group", *BY).agg(
        F.count(F.lit(1)).alias("n"), F.avg((F.col("y_true") == F.col("y_pred")).cast("double")).alias("accuracy"), *[F.count_if(F.col("y_true") == c).alias(f"c{c}") for c in CLASSES]
    )
    top = F.greatest("c0", "c1", "c2")
    label = F.when(F.col("c0") == top, 0).when(F.col("c1") == top, 1).otherwise(2)
    place = F.row_number().over(W.partitionBy(*BY).orderBy("accuracy", "source_group"))
    return a.select("source_group", *BY, "n", "accuracy", label.alias("label"), place.cast("long").alias("place"))


def draw_number(cell: str) -> str:
    """SQL text: the number of a cell's draw in the resample ``replicate``."""
    return f"replicate * 16 + {cell}"


@F.pandas_udf(T.ArrayType(T.LongType()))
def _resample(counts: pd.Series, draws: pd.Series) -> pd.Series:
    """One multinomial resample of each row's counts: cell after cell, a binomial share of what is left."""
    return pd.Series(list(multinomial(np.stack(counts.to_list()), np.stack(draws.to_list()))))


def bootstrap_ci(predictions: DataFrame, replicates: int = 1000, seed: int = 11, by: list[str] = BY) -> DataFrame:
    """2.5 and 97.5 percentiles of accuracy and macro F1 over resamples of each model's predictions.

    Both follow from the nine counts of (truth, prediction), so a resample of n rows with replacement draws these counts: a multinomial
    of n, by binomials of each cell given the cells before (inverse distribution, one draw a cell). n is kept.
    """
    t, p = F.col("y_true"), F.col("y_pred")
    grid = [(i, j) for i in CLASSES for j in CLASSES]
    cells = predictions.groupBy(*by).agg(F.array(*[F.count_if((t == i) & (p == j)) for i, j in grid]).alias("counts"))
    each = cells.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    draws = F.array(*[uniform(seed, draw_number(str(k))) for k in range(len(grid))])
    made = each.repartition(*by, "replicate").select(*by, _resample("counts", draws).alias("v"))
    over = lambda test: sum((F.col("v")[k] for k, c in enumerate(grid) if test(*c)), start=F.lit(0))
    f1 = sum((_ratio(2 * over(lambda i, j: i == j == c), over(lambda i, j: i == c) + over(lambda i, j: j == c)) for c in CLASSES), start=F.lit(0.0)) / 3
    ends = lambda x, name: [F.percentile(x, q).alias(f"{name}_{end}") for end, q in (("low", 0.025), ("high", 0.975))]
    accuracy = _ratio(over(lambda i, j: i == j), over(lambda i, j: True))
    return made.select(*by, accuracy.alias("accuracy"), f1.alias("f1")).groupBy(*by).agg(*ends("accuracy", "accuracy"), *ends("f1", "macro_f1"))


def _paired(predictions: DataFrame, first: str, second: str, column: str, others: list[str]) -> DataFrame:
    a = predictions.where(F.col(column) == first).select("sample_id", *others, (F.col("y_true") == F.col("y_pred")).alias("a"))
    b = predictions.where(F.col(column) == second).select("sample_id", *others, (F.col("y_true") == F.col("y_pred")).alias("b"))
    return a.join(b, ["sample_id", *others])


def mcnemar(predictions: DataFrame, first: str, second: str, column: str = "config") -> DataFrame:
    """model, b (only the first is right), c (only the second), chi2 with continuity correction (0 where b + c = 0), p."""
    others = [c for c in BY if c != column]
    p = _paired(predictions, first, second, column, others).groupBy(*others).agg(
        F.count_if(F.col("a") & ~F.col("b")).alias("b"), F.count_if(~F.col("a") & F.col("b")).alias("c")
    )
    d = F.abs(F.col("b") - F.col("c")) - 1
    made = p.select(*others, "b", "c", F.when(F.col("b") + F.col("c") > 0, d * d / (F.col("b") + F.col("c"))).otherwise(0.0).alias("chi2"))
    return made.withColumn("z", F.sqrt("chi2")).select("*", _tail(special.normal_two_sided, "z").alias("p")).drop("z")


def fold_scores(predictions: DataFrame) -> DataFrame:
    return predictions.groupBy(*BY, "fold").agg(F.avg((F.col("y_true") == F.col("y_pred")).cast("double")).alias("score"))


#: Signed-rank tests of at most so many differences count all signs.
EXACT_SIGNS = 50


@F.pandas_udf(T.DoubleType())
def _signed_rank(ranks: pd.Series, n: pd.Series, w: pd.Series, squares: pd.Series) -> pd.Series:
    """Two-sided p-values: exact where the doubled ranks are listed, else normal with the variance of the ranks at hand (ties included)."""
    def one(ranks, n, w, squares):
        return exact.signed_rank(ranks, w) if len(ranks) else math.erfc(abs(w - n * (n + 1) / 4) / math.sqrt(squares / 4) / math.sqrt(2))

    return pd.Series([one(*x) for x in zip(ranks, n, w, squares, strict=True)], dtype="float64")


def wilcoxon(scores: DataFrame, first: str, second: str) -> DataFrame:
    """Signed-rank statistic of fold scores of two configs, for each model: n without zero differences, W (the lesser sum), two-sided p
    (exact over all signs up to ``EXACT_SIGNS`` differences, ties with their mean ranks; the normal approximation beyond)."""
    a = scores.where(F.col("config") == first).select("model", "fold", F.col("score").alias("a"))
    b = scores.where(F.col("config") == second).select("model", "fold", F.col("score").alias("b"))
    d = a.join(b, ["model", "fold"]).select("model", F.round(F.col("a") - F.col("b"), 9).alias("d")).where("d <> 0").withColumn("size", F.abs("d"))
    rank = F.rank().over(W.partitionBy("model").orderBy("size")) + (F.count(F.lit(1)).over(W.partitionBy("model", "size")) - 1) / 2.0
    s = d.withColumns({"rank": rank, "of": F.count(F.lit(1)).over(W.partitionBy("model"))}).groupBy("model").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("d") > 0, F.col("rank")).otherwise(0.0)).alias("plus"), F.sum(F.when(F.col("d") < 0, F.col("rank")).otherwise(0.0)).alias("minus"),
        F.sum(F.col("rank") * F.col("rank")).alias("squares"), F.collect_list(F.when(F.col("of") <= EXACT_SIGNS, (2 * F.col("rank")).cast("long"))).alias("ranks"),
    )
    made = s.withColumn("w", F.least("plus", "minus"))
    return made.select("model", "n", "w", _signed_rank("ranks", "n", "w", "squares").alias("p"))


def friedman(scores: DataFrame) -> DataFrame:
    """Friedman's statistic of models ranked within each (config, fold), with its correction for ties: k, blocks, statistic, p."""
    block = ["config", "fold"]
    s = scores.withColumn("score", F.round("score", 9))
    rank = F.rank().over(W.partitionBy(*block).orderBy("score")) + (F.count(F.lit(1)).over(W.partitionBy(*block, "score")) - 1) / 2.0
    ranked = s.withColumn("rank", rank)
    sums = ranked.groupBy("model").agg(F.sum("rank").alias("r"), F.count(F.lit(1)).alias("blocks"))
    t = s.groupBy(*block, "score").agg(F.count(F.lit(1)).alias("t")).agg(F.sum(F.pow("t", 3) - F.col("t")).alias("ties"))
    a = sums.agg(F.count(F.lit(1)).alias("k"), F.max("blocks").alias("blocks"), F.sum(F.col("r") * F.col("r")).alias("squares"))
    k, n = F.col("k"), F.col("blocks")
    plain = 12.0 / (n * k * (k + 1)) * F.col("squares") - 3 * n * (k + 1)
    made = a.join(t).select("k", "blocks", (plain / (1 - F.col("ties") / (n * k * (k * k - 1)))).alias("statistic"))
    return made.withColumn("df", (F.col("k") - 1).cast("double")).select("*", _tail(special.chi2_upper, "statistic", "df").alias("p")).drop("df")


def compare_configs(predictions: DataFrame, baseline: str, others: list[str]) -> DataFrame:
    """Accuracy of each model under each config, and differences to the baseline."""
    acc = predictions.groupBy("model").pivot("config", [baseline, *others]).agg(F.avg((F.col("y_true") == F.col("y_pred")).cast("double")))
    return acc.select("model", *[F.col(c) for c in (baseline, *others)], *[(F.col(c) - F.col(baseline)).alias(f"delta_{c}") for c in others])


def long_form(wide: DataFrame, key: str, columns: list[str], name: str = "config", value: str = "accuracy") -> DataFrame:
    return wide.unpivot(key, columns, name, value)


def summary_by_variant(predictions: DataFrame) -> DataFrame:
    """Mean, sample deviation and maximum of the models' accuracies in each config, and the best model (first name of equals)."""
    acc = predictions.groupBy(*BY).agg(F.avg((F.col("y_true") == F.col("y_pred")).cast("double")).alias("accuracy"))
    best = F.min_by("model", F.struct((-F.col("accuracy")).alias("a"), "model"))
    return acc.groupBy("config").agg(
        F.avg("accuracy").alias("mean_accuracy"), F.stddev_samp("accuracy").alias("std_accuracy"), F.max("accuracy").alias("max_accuracy"), best.alias("best_model")
    )


def cv_gap(direct: DataFrame, other: DataFrame) -> DataFrame:
    """Mean score of two schemes for each model and their difference; both tables: model, score."""
    a = direct.groupBy("model").agg(F.avg("score").alias("first"))
    b = other.groupBy("model").agg(F.avg("score").alias("second"))
    return a.join(b, "model").select("model", "first", "second", (F.col("second") - F.col("first")).alias("gap"))


def experiment_overview(predictions: DataFrame) -> DataFrame:
    """For each config: best accuracy, best and mean recall of MNAR, mean, deviation and relative spread of fold scores."""
    rep = classification_report(predictions)
    a = rep.groupBy("config").agg(
        F.max("accuracy").alias("best_accuracy"), F.max(F.when(F.col("class") == 2, F.col("recall"))).alias("best_mnar_recall"), F.avg(F.when(F.col("class") == 2, F.col("recall"))).alias("mean_mnar_recall")
    )
    f = fold_scores(predictions).groupBy("config").agg(F.avg("score").alias("cv_mean"), F.stddev_samp("score").alias("cv_std"))
    return a.join(f, "config").withColumn("cv_spread", F.when(F.col("cv_mean") > 0, F.col("cv_std") / F.col("cv_mean")))


def seed_stability(scores: DataFrame) -> DataFrame:
    """model, seeds, mean, deviation, range, stable (deviation below 5 % of the mean); scores: model, seed, score."""
    a = scores.groupBy("model").agg(
        F.count(F.lit(1)).alias("seeds"), F.avg("score").alias("mean"), F.stddev_samp("score").alias("std"), (F.max("score") - F.min("score")).alias("range")
    )
    return a.withColumn("stable", F.col("std") < 0.05 * F.col("mean"))


#: Named targets: metric, relation, value (fixed values).
TARGETS = (("best_accuracy", ">", 0.70), ("best_mnar_recall", ">", 0.40), ("cv_spread", "<", 0.20))


def target_check(overview: DataFrame) -> DataFrame:
    """config, metric, value, target, met: collected metrics against named targets."""
    long = overview.unpivot("config", [t[0] for t in TARGETS], "metric", "value")
    target, met = F.lit(None).cast("double"), F.lit(None).cast("boolean")
    for name, relation, bound in TARGETS:
        is_it = F.col("metric") == name
        target = F.when(is_it, bound).otherwise(target)
        met = F.when(is_it, F.col("value") > bound if relation == ">" else F.col("value") < bound).otherwise(met)
    return long.select("config", "metric", "value", target.alias("target"), F.coalesce(met, F.lit(False)).alias("met"))


# ---- splits --------------------------------------------------------------------------------


def group_shuffle_split(df: DataFrame, group: str, number: str, share: float = 0.25, seed: int = 5) -> DataFrame:
    """df with ``test``: whole groups, the first ceil(share x groups) in order of a draw; ``number`` is a whole number constant within groups."""
    groups = df.groupBy(group).agg(F.min(number).alias("k")).withColumn("u", uniform(seed, "k"))
    place = F.row_number().over(W.orderBy("u", group))  # one row for each group
    chosen = groups.select(group, place.alias("place"), F.count(F.lit(1)).over(W.partitionBy()).alias("groups"))
    return df.join(chosen, group).withColumn("test", F.col("place") <= F.ceil(share * F.col("groups"))).drop("place", "groups")


def stratified_kfold(df: DataFrame, label: str, number: str, folds: int = 5, seed: int = 6, repeats: int = 1) -> DataFrame:
    """df with ``fold``: rows of each label in order of a draw, dealt in turn; with several ``repeats`` also ``repeat``, each with draws of its own."""
    if repeats > 1:
        parts = [stratified_kfold(df, label, number, folds, seed + 101 * k).withColumn("repeat", F.lit(k)) for k in range(repeats)]
        return reduce(DataFrame.unionByName, parts)
    dealt = placed(df.withColumn("fold_draw", uniform(seed, number)), [label], ["fold_draw", number], "fold_place")
    return dealt.withColumn("fold", ((F.col("fold_place") - 1) % folds).cast("int")).drop("fold_draw", "fold_place")


def leave_one_out(df: DataFrame, number: str) -> DataFrame:
    """df with ``fold``: every row is one of its own."""
    return df.withColumn("fold", F.col(number))


def leave_one_group_out(df: DataFrame, group: str) -> DataFrame:
    """df with ``fold``: every group is one.  A fold's training rows are those of the others, so no row is copied."""
    return df.withColumn("fold", F.col(group))


def fold_sizes(df: DataFrame) -> DataFrame:
    """fold, n_test, n_train, train_groups of folds that are whole groups."""
    own = df.groupBy("fold").agg(F.count(F.lit(1)).alias("n_test"))
    total = own.agg(F.sum("n_test").alias("n"), F.count(F.lit(1)).alias("groups"))
    return own.join(F.broadcast(total)).select("fold", "n_test", (F.col("n") - F.col("n_test")).alias("n_train"), (F.col("groups") - 1).alias("train_groups"))


def dealt(sizes: list[tuple[int, int]], folds: int) -> list[tuple[int, int, list[int]]]:
    """(size, first, cycle) for groups dealt one by one, the largest first, each to the lightest fold (the lowest of equals).

    sizes: (size, number of groups), falling.  From the first-th group of a size on (until the next entry of that size), groups go to the folds of the
    cycle in turn: between two turns of the lightest fold, every fold that is lighter than its next load has one.
    """
    load, out = [0] * folds, []
    for size, count in sizes:
        done = 0
        while done < count:
            order = sorted(range(folds), key=lambda f: (load[f], f))
            low = order[0]
            cycle = [f for f in order if (load[f], f) < (load[low] + size, low)]
            items = count - done
            if len(cycle) < folds:
                other = order[len(cycle)]
                turns, rest = divmod(load[other] - load[low], size)
                items = min(items, len(cycle) * (turns - (rest == 0 and other < low)))
            out.append((size, done + 1, cycle))
            for place, f in enumerate(cycle):
                load[f] += size * (items // len(cycle) + (place < items % len(cycle)))
            done += items
    return out


def group_kfold(df: DataFrame, group: str, folds: int = 5) -> DataFrame:
    """df with ``fold``: whole groups, the largest first (of equal ones the least name), each to the lightest fold.

    Groups of one size are dealt in bulk: what goes through the driver is the number of groups of each size, at most the root of twice the rows.
    """
    sizes = materialize(df.groupBy(group).agg(F.count(F.lit(1)).alias("group_rows")))
    kinds = [(r["group_rows"], r["n"]) for r in sizes.groupBy("group_rows").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("group_rows")).collect()]
    turns = dealt(kinds, folds)
    schema = "group_rows long, turns array<struct<first:long,cycle:array<int>>>"
    by_size: dict[int, list] = {}
    for size, first, cycle in turns:
        by_size.setdefault(size, []).append((first, cycle))
    table = df.sparkSession.createDataFrame(list(by_size.items()), schema)
    ranked = placed(sizes, ["group_rows"], [group], "group_place").join(table, "group_rows")
    turn = F.element_at(F.filter("turns", lambda t: t.first <= F.col("group_place")), -1)
    own = ranked.withColumn("turn", turn).select(group, F.get("turn.cycle", ((F.col("group_place") - F.col("turn.first")) % F.size("turn.cycle")).cast("int")).alias("fold"))
    return df.join(own, group)


# ---- routing of two-level classifiers ---------------------------------------------------------


def route(df: DataFrame, kind: str, cut: float = 0.5) -> DataFrame:
    """y_pred from p_rest = P(not MCAR) and p_mnar = P(MNAR | not MCAR).

    hard / threshold: one cut on p_rest, then 0.5 on p_mnar; soft3zone: sure below .35 and above .65, blended between; fullprob: always blended.
    """
    p, m = F.col("p_rest"), F.col("p_mnar")
    second = F.when(m >= 0.5, 2).otherwise(1)
    a, b, c = 1 - p, p * (1 - m), p * m
    blended = F.when((a >= b) & (a >= c), 0).when(b >= c, 1).otherwise(2)
    if kind == "soft3zone":
        out = F.when(p < 0.35, 0).when(p > 0.65, second).otherwise(blended)
    elif kind == "fullprob":
        out = blended
    else:
        out = F.when(p >= cut, second).otherwise(0)
    return df.withColumn("y_pred", out)


def tune_route_threshold(df: DataFrame) -> DataFrame:
    """The cut among .30, .32, ... .70 of the best accuracy (the first of equals); one aggregate for each cut in a single pass."""
    cuts = [round(0.30 + 0.02 * i, 2) for i in range(21)]
    m = F.col("p_mnar")
    hit = lambda t: F.avg((F.when(F.col("p_rest") >= t, F.when(m >= 0.5, 2).otherwise(1)).otherwise(0) == F.col("y_true")).cast("double"))
    wide = df.agg(*[hit(t).alias(f"t{i}") for i, t in enumerate(cuts)])
    long = wide.select(F.explode(F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(f"t{i}").alias("accuracy")) for i, t in enumerate(cuts)])).alias("x")).select("x.*")
    return long.agg(F.min_by("threshold", F.struct((-F.col("accuracy")).alias("a"), "threshold")).alias("threshold"), F.max("accuracy").alias("accuracy"))


def confidence_ensemble(first: DataFrame, second: DataFrame, threshold: float) -> DataFrame:
    """Second model's prediction where the first is not sure; sample_id, y_true, y_pred, switched, changed."""
    a = first.select("sample_id", "y_true", F.col("y_pred").alias("a"), F.greatest("p0", "p1", "p2").alias("sure"))
    j = a.join(second.select("sample_id", F.col("y_pred").alias("b")), "sample_id")
    switched = F.col("sure") < threshold
    return j.select("sample_id", "y_true", F.when(switched, F.col("b")).otherwise(F.col("a")).alias("y_pred"), switched.alias("switched"), (switched & (F.col("a") != F.col("b"))).alias("changed"))


# ---- label quality -----------------------------------------------------------------------------


def self_confidence(df: DataFrame, label: str = "y_true") -> DataFrame:
    return df.withColumn("self_confidence", F.when(F.col(label) == 0, F.col("p0")).when(F.col(label) == 1, F.col("p1")).otherwise(F.col("p2")))


def _confident(df: DataFrame) -> DataFrame:
    """df with self_confidence and ``likely``: the class of highest probability among those above their class's threshold."""
    s = self_confidence(df)
    cut = s.agg(*[F.avg(F.when(F.col("y_true") == c, F.col("self_confidence"))).alias(f"t{c}") for c in CLASSES])
    j = s.join(F.broadcast(cut))
    over = [F.when(F.col(f"p{c}") >= F.col(f"t{c}"), F.col(f"p{c}")).otherwise(-1.0) for c in CLASSES]
    top = F.greatest(*over)
    likely = F.when(top < 0, None).when(over[0] == top, 0).when(over[1] == top, 1).otherwise(2)
    return j.withColumn("likely", likely)


def confident_joint(df: DataFrame) -> DataFrame:
    """y_true, j0, j1, j2: counts of (given, confident class), scaled to the number of rows of each given class."""
    c = _confident(df)
    counts = c.groupBy("y_true").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("likely") == k).alias(f"c{k}") for k in CLASSES])
    total = F.col("c0") + F.col("c1") + F.col("c2")
    return counts.select("y_true", *[F.when(total > 0, F.col(f"c{k}") * F.col("n") / total).otherwise(0.0).alias(f"j{k}") for k in CLASSES])


def find_label_issues(df: DataFrame) -> DataFrame:
    """df with self_confidence, is_issue and issue_rank: for each given class the rows of lowest self-confidence, as many
    as the joint has off its diagonal (rounded)."""
    joint = confident_joint(df)
    off = sum((F.when(F.col("y_true") != k, F.col(f"j{k}")).otherwise(0.0) for k in CLASSES), start=F.lit(0.0))
    n = joint.select("y_true", F.floor(off + 0.5).alias("issues"))
    s = placed(self_confidence(df), ["y_true"], ["self_confidence", "sample_id"], "issue_place").join(F.broadcast(n), "y_true")
    marked = s.withColumn("is_issue", F.col("issue_place") <= F.col("issues"))
    return marked.withColumn("issue_rank", F.when(F.col("is_issue"), F.col("issue_place"))).drop("issues", "issue_place")


def quality_by_dataset(issues: DataFrame) -> DataFrame:
    """source_group, n, mean and least quality, share of issues, commonest given and predicted label, agreement."""
    counts = lambda c, k: F.count_if(F.col(c) == k)
    a = issues.groupBy("source_group").agg(
        F.count(F.lit(1)).alias("n_samples"), F.avg("self_confidence").alias("avg_quality"), F.min("self_confidence").alias("min_quality"),
        F.count_if("is_issue").alias("n_issues"), *[counts("y_true", k).alias(f"g{k}") for k in CLASSES], *[counts("y_pred", k).alias(f"q{k}") for k in CLASSES],
    )

    def modal(p: str) -> Column:
        top = F.greatest(f"{p}0", f"{p}1", f"{p}2")
        return F.when(F.col(f"{p}0") == top, 0).when(F.col(f"{p}1") == top, 1).otherwise(2)

    return a.select(
        "source_group", "n_samples", "avg_quality", "min_quality", "n_issues", (100.0 * F.col("n_issues") / F.col("n_samples")).alias("pct_issues"),
        modal("g").alias("original_label"), modal("q").alias("predicted_label"), (modal("g") == modal("q")).alias("label_agrees"),
    )


def clean_labels(issues: DataFrame, mode: str, share: float = 0.1) -> DataFrame:
    """prune: drops the lowest ``share`` of rows, at most the issues; weight: weight = clip(quality, .1, 1); relabel: issues get the likeliest class."""
    if mode == "weight":
        return issues.withColumn("weight", F.least(F.greatest("self_confidence", F.lit(0.1)), F.lit(1.0)))
    if mode == "relabel":
        top = F.greatest("p0", "p1", "p2")
        likely = F.when(F.col("p0") == top, 0).when(F.col("p1") == top, 1).otherwise(2)
        return issues.withColumn("label", F.when(F.col("is_issue"), likely).otherwise(F.col("y_true")))
    most = int(share * issues.count())
    found = issues.where("is_issue").select("sample_id", "self_confidence")
    gone = placed(found, [], ["self_confidence", "sample_id"], "place").where(F.col("place") <= most).select("sample_id")
    return issues.join(gone, "sample_id", "left_anti")
