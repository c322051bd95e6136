"""Relevance of features and simple classifiers on feature tables: long form (id, label, var, value) throughout."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .kernels import corr


def long_features(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    parts = F.array(*[F.struct(F.lit(c).alias("var"), F.col(c).cast("double").alias("value")) for c in columns])
    return df.select(*keys, F.explode(parts).alias("x")).select(*keys, "x.var", "x.value")


def variance_profile(long: DataFrame) -> DataFrame:
    """var, mean, std, min, max, distinct values, share of zeros and of the commonest value, coefficient of variation, low_variance."""
    counts = long.where("value is not null").groupBy("var", "value").agg(F.count(F.lit(1)).alias("k"))
    top = counts.groupBy("var").agg(F.max("k").alias("k"), F.count(F.lit(1)).alias("n_distinct"))
    a = long.groupBy("var").agg(
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"),
        F.avg((F.col("value") == 0).cast("double")).alias("zero_share"), F.count("value").alias("n"),
    )
    out = a.join(top, "var").withColumn("modal_share", F.col("k") / F.col("n")).withColumn("cv", F.when(F.abs("mean") > 1e-12, F.col("std") / F.abs("mean")))
    return out.select("var", "mean", "std", "min", "max", "n_distinct", "zero_share", "modal_share", "cv", ((F.col("std") < 0.01) | (F.col("modal_share") > 0.95)).alias("low_variance"))


def anova_f(long: DataFrame, label: str = "label") -> DataFrame:
    """var, f, df_between, df_within: one-way F of each feature over the labels, from grouped sums around the overall mean."""
    mean = long.groupBy("var").agg(F.avg("value").alias("m"))
    c = long.join(F.broadcast(mean), "var").select("var", label, (F.col("value") - F.col("m")).alias("d")).where("d is not null")
    g = c.groupBy("var", label).agg(F.count(F.lit(1)).alias("n"), F.sum("d").alias("s"), F.sum(F.col("d") * F.col("d")).alias("q"))
    t = g.groupBy("var").agg(
        F.sum(F.col("s") * F.col("s") / F.col("n")).alias("b0"), F.sum("q").alias("q"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.count(F.lit(1)).alias("k")
    )
    between = F.col("b0") - F.col("s") * F.col("s") / F.col("n")
    within = F.col("q") - F.col("b0")
    f = F.when((F.col("n") > F.col("k")) & (within > 1e-12) & (F.col("k") > 1), (between / (F.col("k") - 1)) / (within / (F.col("n") - F.col("k"))))
    return t.select("var", f.alias("f"), (F.col("k") - 1).alias("df_between"), (F.col("n") - F.col("k")).alias("df_within"))


def select_k_best(long: DataFrame, label: str = "label", keep: int | None = None) -> DataFrame:
    """anova_f with rank and ``kept``: the best max(5, n / 10) of the features (n rows), all if there are no more."""
    f = anova_f(long, label)
    rank = F.row_number().over(W.orderBy(F.desc(F.coalesce("f", F.lit(-1.0))), "var"))  # one row for each feature
    n = F.greatest(F.lit(5), F.floor((F.col("df_between") + F.col("df_within") + 1) / 10)) if keep is None else F.lit(keep)
    return f.withColumn("rank", rank.cast("long")).withColumn("kept", F.col("rank") <= n)


def standardize(long: DataFrame, by: list[str] | None = None) -> DataFrame:
    """value as z-score of the training rows' mean and population deviation (0 where that is 0)."""
    by = by or []
    s = long.groupBy("var", *by).agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"))
    j = long.join(F.broadcast(s), ["var", *by])
    return j.withColumn("value", F.when(F.col("s") > 1e-12, (F.col("value") - F.col("m")) / F.col("s")).otherwise(0.0)).drop("m", "s")


def correlations(df: DataFrame, columns: list[str], cut: float = 0.9) -> DataFrame:
    """var_a, var_b, r of every pair of features, and ``high`` where |r| > cut; all pairs of columns in one aggregation."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    wide = df.agg(*[corr(a, b).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    parts = F.array(*[F.struct(F.lit(a).alias("var_a"), F.lit(b).alias("var_b"), F.col(f"r{i}").alias("r")) for i, (a, b) in enumerate(pairs)])
    return wide.select(F.explode(parts).alias("x")).select("x.*").withColumn("high", F.abs("r") > cut)


def class_profile(long: DataFrame, label: str = "label") -> DataFrame:
    """var, mean by label 0..2 and Spearman's rho of feature and label, from counts of equal values."""
    means = long.groupBy("var").agg(*[F.avg(F.when(F.col(label) == k, F.col("value"))).alias(f"mean_{k}") for k in range(3)])
    c = long.where("value is not null").groupBy("var", "value").agg(*[F.count_if(F.col(label) == k).alias(f"c{k}") for k in range(3)])
    t = F.col("c0") + F.col("c1") + F.col("c2")
    w, whole = W.partitionBy("var").orderBy("value"), W.partitionBy("var")
    r = c.select("var", "c0", "c1", "c2", t.alias("t"), (F.sum(t).over(w) - t + (t + 1) / 2.0).alias("rank"), *[F.sum(f"c{k}").over(whole).alias(f"n{k}") for k in range(3)])
    n0, n1, n2 = (F.col(f"n{k}") for k in range(3))
    n = n0 + n1 + n2
    label_rank = ((n0 + 1) / 2.0, n0 + (n1 + 1) / 2.0, n0 + n1 + (n2 + 1) / 2.0)
    mean = (n + 1) / 2.0
    cross = sum(((F.col(f"c{k}") * (F.col("rank") - mean) * (label_rank[k] - mean)) for k in range(3)), start=F.lit(0.0))
    a = r.groupBy("var", "n0", "n1", "n2").agg(F.sum(cross).alias("cross"), F.sum(F.col("t") * F.pow(F.col("rank") - mean, 2)).alias("sx"))
    sy = sum((F.col(f"n{k}") * F.pow(label_rank[k] - mean, 2) for k in range(3)), start=F.lit(0.0))
    rho = a.select("var", F.when((F.col("sx") > 0) & (sy > 0), F.col("cross") / F.sqrt(F.col("sx") * sy)).alias("rho"))
    return means.join(rho, "var", "left")


def removal_reasons(profile: DataFrame, f: DataFrame, pairs: DataFrame, low_f: float = 3.0) -> DataFrame:
    """var, reasons, n_reasons, keep: union of the criteria low variance, weak F and high correlation with a stronger feature."""
    low = profile.where("low_variance").select("var", F.lit("low variance").alias("reason"))
    weak = f.where(f"f is null or f < {low_f}").select("var", F.lit("weak F").alias("reason"))
    s = f.select("var", F.coalesce("f", F.lit(-1.0)).alias("f"))
    hp = pairs.where("high").join(s.select(F.col("var").alias("var_a"), F.col("f").alias("fa")), "var_a").join(s.select(F.col("var").alias("var_b"), F.col("f").alias("fb")), "var_b")
    twin = hp.select(F.when(F.col("fa") < F.col("fb"), F.col("var_a")).otherwise(F.col("var_b")).alias("var"), F.lit("correlated").alias("reason"))
    why = low.union(weak).union(twin).distinct().groupBy("var").agg(F.array_join(F.array_sort(F.collect_list("reason")), "; ").alias("reasons"), F.count(F.lit(1)).alias("n_reasons"))
    return profile.select("var").join(why, "var", "left").select("var", F.coalesce("reasons", F.lit("")).alias("reasons"), F.coalesce("n_reasons", F.lit(0)).alias("n_reasons"), F.col("n_reasons").isNull().alias("keep"))


def gaussian_nb(train: DataFrame, test: DataFrame, label: str = "label", smoothing: float = 1e-9) -> DataFrame:
    """id, y_pred, p0, p1, p2 of Gaussian naive Bayes; both tables long: id, label, var, value (train may have ``weight``).

    Class means and variances come from one aggregation; variances get ``smoothing`` times the largest variance of a feature.
    """
    w = F.col("weight") if "weight" in train.columns else F.lit(1.0)
    mean = train.groupBy(label, "var").agg((F.sum(w * F.col("value")) / F.sum(w)).alias("m"), F.sum(w).alias("w"))  # few rows: classes x features
    d = train.join(F.broadcast(mean), [label, "var"])
    var = d.groupBy(label, "var", "m", "w").agg((F.sum(w * F.pow(F.col("value") - F.col("m"), 2)) / F.first("w")).alias("v"))
    widest = train.groupBy("var").agg(F.var_pop("value").alias("v")).agg(F.max("v").alias("widest"))
    total = mean.groupBy("var").agg(F.sum("w").alias("total"))
    model = var.join(F.broadcast(widest)).join(total, "var").select(label, "var", "m", (F.col("v") + smoothing * F.col("widest")).alias("v"), F.log(F.col("w") / F.col("total")).alias("prior"))
    j = test.select("id", "var", "value").join(F.broadcast(model), "var")
    ll = -0.5 * (F.log(2 * math.pi * F.col("v")) + F.pow(F.col("value") - F.col("m"), 2) / F.col("v"))
    s = j.groupBy("id", label).agg((F.sum(ll) + F.max("prior")).alias("s")).groupBy("id").pivot(label, [0, 1, 2]).agg(F.first("s"))
    c = [F.coalesce(F.col(str(k)), F.lit(float("-inf"))) for k in range(3)]
    top = F.greatest(*c)
    e: list[Column] = [F.exp(x - top) for x in c]
    p = s.select("id", *[(x / (e[0] + e[1] + e[2])).alias(f"p{k}") for k, x in enumerate(e)])
    best = F.greatest("p0", "p1", "p2")
    return p.select("id", F.when(F.col("p0") == best, 0).when(F.col("p1") == best, 1).otherwise(2).alias("y_pred"), "p0", "p1", "p2")


def nb_cross_validate(long: DataFrame, by: list[str] | None = None, smoothing: float = 1e-9) -> DataFrame:
    """by, id, fold, label, y_pred: Gaussian naive Bayes of every fold in one job; long: by, id, fold, label, var, value.

    Sums by (fold, label, feature) are taken once; a fold's model is what the totals leave without its own sums.
    """
    by = by or []
    mean = long.groupBy("var").agg(F.avg("value").alias("m0"))  # a row for each feature
    d = long.join(F.broadcast(mean), "var").withColumn("d", F.col("value") - F.col("m0"))
    own = d.groupBy(*by, "fold", "label", "var").agg(F.count(F.lit(1)).alias("n"), F.sum("d").alias("s"), F.sum(F.col("d") * F.col("d")).alias("q"))
    total = own.groupBy(*by, "label", "var").agg(*[F.sum(c).alias(f"t{c}") for c in "nsq"])
    folds = own.select(*by, "fold").distinct()
    left = total.join(folds, by) if by else total.crossJoin(F.broadcast(folds))
    left = left.join(own, [*by, "fold", "label", "var"], "left").select(*by, "fold", "label", "var", *[(F.col(f"t{c}") - F.coalesce(c, F.lit(0))).alias(c) for c in "nsq"]).where("n > 0")
    spread = left.groupBy(*by, "fold", "var").agg((F.sum("q") / F.sum("n") - F.pow(F.sum("s") / F.sum("n"), 2)).alias("v"), F.sum("n").alias("all"))
    widest = spread.groupBy(*by, "fold").agg(F.max("v").alias("widest"), F.max("all").alias("all"))
    m = F.col("s") / F.col("n")
    v = F.greatest(F.col("q") / F.col("n") - m * m, F.lit(0.0)) + smoothing * F.col("widest")
    model = left.join(widest, [*by, "fold"]).select(*by, "fold", F.col("label").alias("class"), "var", m.alias("m"), v.alias("v"), F.log(F.col("n") / F.col("all")).alias("prior"))
    j = d.select(*by, "id", "fold", "label", "var", "d").join(model, [*by, "fold", "var"])
    ll = -0.5 * (F.log(2 * math.pi * F.col("v")) + F.pow(F.col("d") - F.col("m"), 2) / F.col("v"))
    s = j.groupBy(*by, "id", "fold", "label", "class").agg((F.sum(ll) + F.max("prior")).alias("s"))
    return s.groupBy(*by, "id", "fold", "label").agg(F.max_by("class", F.struct(F.round("s", 6).alias("s"), (-F.col("class")).alias("c"))).alias("y_pred"))


def feature_set_ablation(long: DataFrame, sets: dict[str, list[str]]) -> DataFrame:
    """config, n_features, accuracy, macro_recall and recall of each class over the folds of ``nb_cross_validate``, for named sets of features."""
    spark = long.sparkSession
    named = spark.createDataFrame([(k, v) for k, own in sets.items() for v in own], "config string, var string")  # a few rows
    p = nb_cross_validate(long.join(F.broadcast(named), "var"), ["config"])
    hit = (F.col("label") == F.col("y_pred")).cast("double")
    g = p.groupBy("config").agg(F.avg(hit).alias("accuracy"), *[F.coalesce(F.avg(F.when(F.col("label") == k, hit)), F.lit(0.0)).alias(f"recall_{k}") for k in range(3)])
    n = named.groupBy("config").agg(F.count(F.lit(1)).alias("n_features"))
    return g.join(F.broadcast(n), "config").select("config", "n_features", "accuracy", ((F.col("recall_0") + F.col("recall_1") + F.col("recall_2")) / 3).alias("macro_recall"), "recall_0", "recall_1", "recall_2")


def scenario_ablation(df: DataFrame, columns: list[str], suspect: str, folds: dict[str, str]) -> DataFrame:
    """cv, full, without, only: accuracy with all columns, without ``suspect`` and with it alone, under every scheme of folds (name: column
    of df), the differences of the first to the others, and of each scheme's accuracy to that of the first scheme."""
    schemes = F.explode(F.array(*[F.struct(F.lit(k).alias("cv"), F.col(c).cast("string").alias("fold")) for k, c in folds.items()]))
    long = long_features(df.withColumn("scheme", schemes).select("id", "label", "scheme.*", *columns), ["id", "label", "cv", "fold"], columns)
    scenario = F.array(F.lit("full"), F.when(F.col("var") == suspect, F.lit("only")).otherwise(F.lit("without")))
    p = nb_cross_validate(long.withColumn("scenario", F.explode(scenario)), ["scenario", "cv"])
    wide = p.groupBy("cv").pivot("scenario", ["full", "without", "only"]).agg(F.avg((F.col("label") == F.col("y_pred")).cast("double")))
    first = wide.where(F.col("cv") == next(iter(folds))).select(F.col("full").alias("first"))
    return wide.join(F.broadcast(first)).select(
        "cv", "full", "without", "only", (F.col("full") - F.col("without")).alias("full_minus_without"), (F.col("full") - F.col("only")).alias("full_minus_only"), (F.col("first") - F.col("full")).alias("first_minus_own")
    )
