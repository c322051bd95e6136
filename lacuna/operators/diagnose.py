"""From test results to a mechanism: votes, score vectors, rules, kernel-density posteriors, calibration.

Scores: dataset_id, true_label (MCAR, MAR, MNAR), p-values little_p, pklm_p, levene_p (null: test not valid), auc_obs, auc_p, auc_z,
mi_max, caafe_auc_self_delta, caafe_kl_density, caafe_kurt_excess, caafe_cond_entropy.
Reference points are met in blocks; cross-validation and the search for a bandwidth use a calibration of bounded size.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lacuna.sources.stage import materialize

from .ranks import placed

DS = ["dataset_id"]
LABELS = ("MCAR", "MAR", "MNAR")
TESTS = ("little_p", "pklm_p", "levene_p")
#: Thresholds of the rules (fixed values).
DEFAULT_THRESHOLDS = {"auc_mar": 0.65, "auc_p": 0.05, "mi_max_mar": 0.05, "auc_self_delta": 0.05, "kl_density": 0.10, "kurt_abs": 0.50, "cond_entropy": 0.05}
VECTOR = ("auc_obs", "auc_z", "mi_max", "caafe_auc_self_delta", "caafe_kl_density", "caafe_kurt_excess", "caafe_cond_entropy")
#: Which score calibrates which threshold, for which class, and whether high values speak for it.
CALIBRATED = (
    ("little_p", None, ("MAR", "MNAR"), False), ("pklm_p", None, ("MAR", "MNAR"), False), ("levene_p", None, ("MAR", "MNAR"), False),
    ("auc_obs", "auc_mar", ("MAR",), True), ("mi_max", "mi_max_mar", ("MAR",), True), ("caafe_auc_self_delta", "auc_self_delta", ("MNAR",), True),
    ("caafe_kl_density", "kl_density", ("MNAR",), True), ("caafe_kurt_excess_abs", "kurt_abs", ("MNAR",), True), ("caafe_cond_entropy", "cond_entropy", ("MNAR",), True),
)


def mcar_vote(scores: DataFrame) -> DataFrame:
    """scores with n_tests_reject, n_tests_valid and rejects_mcar: two of at least two valid tests, or the only one."""
    rejects = sum((F.when(F.col(t) < 0.05, 1).otherwise(0) for t in TESTS), start=F.lit(0))
    valid = sum((F.when(F.col(t).isNotNull(), 1).otherwise(0) for t in TESTS), start=F.lit(0))
    out = scores.withColumns({"n_tests_reject": rejects, "n_tests_valid": valid})
    needed = F.when(F.col("n_tests_valid") >= 2, 2).otherwise(1)
    return out.withColumn("rejects_mcar", F.col("n_tests_reject") >= needed)


def score_vector(scores: DataFrame) -> DataFrame:
    """scores with ``vec``: three log10 p-values (floor 1e-10, null is 0), then the plain scores."""
    logs = [F.when(t.isNull(), 0.0).otherwise(F.log10(F.greatest(t, F.lit(1e-10)))) for t in map(F.col, TESTS)]
    return scores.withColumn("vec", F.array(*logs, *[F.col(c).cast("double") for c in VECTOR]))


def diagnose_rules(voted: DataFrame, thresholds: dict[str, float] | None = None) -> DataFrame:
    """dataset_id, prediction, confidence, rationale by the decision list."""
    th = DEFAULT_THRESHOLDS | (thresholds or {})
    c = F.col
    mar = ((c("auc_obs") > th["auc_mar"]) & (c("auc_p") < th["auc_p"])) | (c("mi_max") > th["mi_max_mar"])
    signs = (
        c("caafe_auc_self_delta") > th["auc_self_delta"], c("caafe_kl_density") > th["kl_density"], F.abs("caafe_kurt_excess") > th["kurt_abs"], c("caafe_cond_entropy") > th["cond_entropy"],
    )
    count = sum((F.when(s, 1).otherwise(0) for s in signs), start=F.lit(0))
    d = voted.withColumns({"mar": F.coalesce(mar, F.lit(False)), "k": count})
    m, k = c("mar"), c("k")
    cases = (
        (~c("rejects_mcar"), "MCAR", 0.7, "too few tests reject"),
        (m & (k <= 1), "MAR", 0.6, "the mask follows the predictors"),
        ((k >= 3) & ~m, "MNAR", 0.6, "the mask follows the target alone"),
        (m & (k >= 2), "MAR", 0.4, "mixed evidence, the predictors prevail"),
        (k >= 2, "MNAR", 0.4, "some signs of the target"),
        (F.lit(True), "MAR", 0.3, "rejected without clear signs"),
    )

    def pick(i: int) -> Column:
        out = F.lit(cases[-1][i])
        for case in reversed(cases[:-1]):
            out = F.when(case[0], case[i]).otherwise(out)
        return out

    why = F.concat(pick(3), F.lit(" ("), c("n_tests_reject").cast("string"), F.lit("/"), c("n_tests_valid").cast("string"), F.lit(" tests, "), k.cast("string"), F.lit("/4 signs)"))
    return d.select(*DS, pick(1).alias("prediction"), pick(2).alias("confidence"), why.alias("rationale"))


def _distance(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, x: acc + x)


def _log_norm(bandwidth: float, dimensions: int) -> float:
    return dimensions * (math.log(bandwidth) + 0.5 * math.log(2 * math.pi))


def calibration(points: DataFrame) -> DataFrame:
    """label, ref: the reference points of a calibration, all of them."""
    return points.select("label", F.col("vec").alias("ref"))


def _key(label: str, block: Column) -> Column:
    return F.struct(F.lit(label).alias("label"), block.cast("int").alias("block"))


#: Reference points that a vector meets together.
TOGETHER = 512


def _densities(points: DataFrame, reference: DataFrame, widths: list[float], dimensions: int, together: int, own_label: bool = False) -> DataFrame:
    """dataset_id, label, logliks: log densities of each vector under the reference vectors of each label (of its own one only), one for each width.

    Reference points are put in numbered blocks, vectors meet blocks by an equality join, and each meeting gives one row (least squared
    distance, a scaled sum for each width, points); these are merged for each dataset and label.  No sample, and no row for a pair.
    With a fold in both tables, points of the vector's own fold are left out.
    """
    by_fold = "fold" in reference.columns
    numbered = materialize(reference.select("label", "ref", *["fold"] * by_fold).withColumn("ref_id", F.monotonically_increasing_id()))
    blocks = placed(numbered, ["label"], ["ref_id"], "place").groupBy("label", F.floor((F.col("place") - 1) / together).cast("int").alias("block"))
    blocks = materialize(blocks.agg(F.collect_list(F.struct("ref", *[F.col("fold").alias("of")] * by_fold)).alias("refs")))
    counts = blocks.groupBy("label").agg(F.count(F.lit(1)).alias("blocks")).collect()  # a row for each label
    keys = [F.transform(F.sequence(F.lit(0), F.lit(n - 1)), (lambda label: lambda i: _key(label, i))(label)) for label, n in counts]
    if not keys:
        return points.select(*DS, F.lit(None).cast("string").alias("label"), F.lit(None).cast("array<double>").alias("logliks")).limit(0)
    met = F.filter(F.concat(*keys), lambda k: k.label == F.col("label")) if own_label else F.concat(*keys)
    of = ["vec", *["fold"] * by_fold]
    each = points.select(*DS, *of, F.explode(met).alias("key")).select(*DS, *of, "key.label", "key.block").join(blocks, ["label", "block"])
    others = F.filter("refs", lambda r: r.of != F.col("fold")) if by_fold else F.col("refs")
    each = each.select(*DS, "label", "vec", others.alias("others")).where(F.size("others") > 0)
    each = each.select(*DS, "label", F.transform("others", lambda r: _distance("vec", r.ref)).alias("d")).select(*DS, "label", "d", F.array_min("d").alias("near"))
    scaled = lambda w: F.aggregate("d", F.lit(0.0), lambda a, x: a + F.exp((F.col("near") - x) / (2 * w * w)))
    each = each.select(*DS, "label", "near", F.size("d").alias("n"), F.array(*map(scaled, widths)).alias("s"))
    rows = F.collect_list(F.struct("near", "s"))  # one for each block
    g = each.groupBy(*DS, "label").agg(F.min("near").alias("near"), F.sum("n").alias("n"), rows.alias("rows"))

    def loglik(k: int, w: float) -> Column:
        total = F.aggregate("rows", F.lit(0.0), lambda a, x: a + x.s[k] * F.exp((F.col("near") - x.near) / (2 * w * w)))
        return F.log(total) - F.col("near") / (2 * w * w) - F.log(F.col("n").cast("double")) - _log_norm(w, dimensions)

    return g.select(*DS, "label", F.array(*[loglik(k, w) for k, w in enumerate(widths)]).alias("logliks"))


def kde_loglik(points: DataFrame, reference: DataFrame, bandwidth: float, dimensions: int = 10, together: int = TOGETHER) -> DataFrame:
    """dataset_id, label, loglik: Gaussian kernel density of each vector under the reference vectors of each label.

    points: dataset_id, vec; reference: label, ref, any number of them (met in blocks, see ``_densities``).
    """
    return _densities(points.select(*DS, "vec"), reference.select("label", "ref"), [bandwidth], dimensions, together).select(*DS, "label", F.col("logliks")[0].alias("loglik"))


def diagnose_bayes(loglik: DataFrame, prior: dict[str, float] | None = None) -> DataFrame:
    """dataset_id, prediction, confidence, p_mcar, p_mar, p_mnar, ambiguous (confidence below .4)."""
    prior = prior or dict.fromkeys(LABELS, 1 / 3)
    wide = loglik.groupBy(*DS).pivot("label", list(LABELS)).agg(F.first("loglik"))
    top = F.greatest(*LABELS)
    raw = {m: F.coalesce(F.exp(F.col(m) - top), F.lit(0.0)) * prior[m] for m in LABELS}
    total = raw["MCAR"] + raw["MAR"] + raw["MNAR"]
    p = wide.select(*DS, *[(raw[m] / total).alias(f"p_{m.lower()}") for m in LABELS])
    a, b, c = F.col("p_mcar"), F.col("p_mar"), F.col("p_mnar")
    best = F.greatest(a, b, c)
    second = a + b + c - best - F.least(a, b, c)
    return p.select(
        *DS, F.when(a == best, "MCAR").when(b == best, "MAR").otherwise("MNAR").alias("prediction"), (best - second).alias("confidence"),
        "p_mcar", "p_mar", "p_mnar", (best - second < 0.4).alias("ambiguous"),
    )


def _by_fold(points: DataFrame) -> tuple[DataFrame, DataFrame]:
    kept = materialize(points.select(*DS, "label", "fold", "vec"))
    return kept, kept.select("label", F.col("vec").alias("ref"), "fold")


def bayes_cv(points: DataFrame, bandwidth: float, dimensions: int = 10, together: int = TOGETHER) -> DataFrame:
    """dataset_id, label, loglik: log densities under all points of other folds; points: dataset_id, label, fold, vec."""
    kept, reference = _by_fold(points)
    return _densities(kept.drop("label"), reference, [bandwidth], dimensions, together).select(*DS, "label", F.col("logliks")[0].alias("loglik"))


def select_bandwidth(points: DataFrame, count: int = 20, dimensions: int = 10, together: int = TOGETHER) -> DataFrame:
    """bandwidth, loglik: held-out log likelihood (own label, all points of other folds) of log-spaced bandwidths from .1 to 10, best first
    marked by ``best``.  Distances are made once and meet all bandwidths."""
    widths = [10 ** (-1 + 2 * i / (count - 1)) for i in range(count)]
    kept, reference = _by_fold(points)
    each = _densities(kept, reference, widths, dimensions, together, own_label=True)
    total = each.agg(*[F.sum(F.col("logliks")[k]).alias(f"l{k}") for k in range(count)])
    long = total.select(F.explode(F.array(*[F.struct(F.lit(w).alias("bandwidth"), F.col(f"l{k}").alias("loglik")) for k, w in enumerate(widths)])).alias("x")).select("x.*")
    return long.select("*", (F.row_number().over(W.orderBy(F.desc("loglik"), "bandwidth")) == 1).alias("best"))


# ---- calibration --------------------------------------------------------------------------------


def long_scores(scores: DataFrame) -> DataFrame:
    """score, positive, value (turned so that high speaks for positive): one row for each dataset and calibrated score."""
    parts = []
    for name, _, labels, high in CALIBRATED:
        value = F.abs("caafe_kurt_excess") if name == "caafe_kurt_excess_abs" else F.col(name)
        parts.append(F.struct(F.lit(name).alias("score"), F.col("true_label").isin(*labels).cast("int").alias("positive"), (value if high else -value).alias("value")))
    return scores.select(F.explode(F.array(*parts)).alias("x")).select("x.*").where("value is not null")


def youden_threshold(long: DataFrame) -> DataFrame:
    """score, threshold, youden_j, auc: the cut of greatest TPR - FPR (the highest of equals) and the area under the curve.

    Equal values collapse first; cuts run from the highest value down.  Fewer than ten values or one class: null, 0, 0.5.
    """
    v = long.groupBy("score", "value").agg(F.sum("positive").alias("p"), F.sum(1 - F.col("positive")).alias("n"))
    down, whole = W.partitionBy("score").orderBy(F.desc("value")), W.partitionBy("score")
    c = v.select("score", "value", "p", "n", F.sum("p").over(down).alias("tp"), F.sum("n").over(down).alias("fp"), F.sum("p").over(whole).alias("pos"), F.sum("n").over(whole).alias("neg"))
    j = F.col("tp") / F.col("pos") - F.col("fp") / F.col("neg")
    area = (F.col("n") / F.col("neg")) * (2 * F.col("tp") - F.col("p")) / (2.0 * F.col("pos"))
    a = c.groupBy("score").agg(
        F.max("pos").alias("pos"), F.max("neg").alias("neg"), F.max_by("value", F.struct(F.round(j, 9).alias("j"), "value")).alias("threshold"), F.max(j).alias("j"), F.sum(area).alias("auc")
    )
    off = (F.col("pos") + F.col("neg") < 10) | (F.col("pos") == 0) | (F.col("neg") == 0)
    none = off | (F.col("j") <= 0)
    return a.select("score", F.when(~none, F.col("threshold")).alias("threshold"), F.when(none, 0.0).otherwise(F.col("j")).alias("youden_j"), F.when(off, 0.5).otherwise(F.col("auc")).alias("auc"))


def calibrate_thresholds(scores: DataFrame) -> DataFrame:
    """name, threshold, youden_j, auc: calibrated thresholds over the defaults (p-values turned back)."""
    got = youden_threshold(long_scores(scores))
    turned = F.col("threshold") * F.when(F.col("score").isin(*[c[0] for c in CALIBRATED if not c[3]]), -1).otherwise(1)
    name = F.col("score")
    for score, target, _, _ in CALIBRATED:
        name = F.when(F.col("score") == score, target or score).otherwise(name)
    default = F.lit(None).cast("double")
    for key, value in DEFAULT_THRESHOLDS.items():
        default = F.when(F.col("name") == key, value).otherwise(default)
    return got.select(name.alias("name"), turned.alias("t"), "youden_j", "auc").select("name", F.coalesce("t", default).alias("threshold"), "youden_j", "auc")


def evaluate_protocol(predictions: DataFrame) -> DataFrame:
    """mode, accuracy and recall of each label; predictions: mode, true_label, prediction."""
    right = (F.col("true_label") == F.col("prediction")).cast("double")
    return predictions.groupBy("mode").agg(
        F.avg(right).alias("accuracy"), *[F.coalesce(F.avg(F.when(F.col("true_label") == m, right)), F.lit(0.0)).alias(f"recall_{m.lower()}") for m in LABELS], F.count(F.lit(1)).alias("n")
    )


# ---- simpler protocols --------------------------------------------------------------------------


def label_agreement(predictions: DataFrame) -> DataFrame:
    """true_label, prediction, n with margins ('all'): the crosstab of given and found labels."""
    return predictions.cube("true_label", "prediction").agg(F.count(F.lit(1)).alias("n")).select(
        F.coalesce("true_label", F.lit("all")).alias("true_label"),
        F.coalesce("prediction", F.lit("all")).alias("prediction"), "n",
    )


def diagnose_v1(tests: DataFrame) -> DataFrame:
    """dataset_id, recommended, diagnosis, consistent from little_p, mar_sig and ks_p (null: test failed) and the given label.

    A failed Little test counts as not speaking for MCAR in the MAR and MNAR branches, before the inconclusive one.
    """
    c = F.col
    ok = c("little_p") > 0.05
    ks = F.coalesce(c("ks_p") < 0.05, F.lit(False))
    against = ~F.coalesce(ok, F.lit(False))
    sig = c("mar_sig")
    cases = (
        (F.coalesce(ok, F.lit(False)) & ~sig & ~ks, F.lit("MCAR"), "MCAR confirmed"),
        (against & sig, F.lit("MAR"), "MAR: rejects MCAR, mask follows a predictor"),
        (against & ks & ~sig, F.lit("MNAR"), "possibly MNAR: rejects MCAR, observed values shifted"),
        (ok.isNull(), c("true_label"), "inconclusive: Little's test failed"),
        (F.lit(True), c("true_label"), "ambiguous: tests disagree"),
    )
    rec, text = cases[-1][1], F.lit(cases[-1][2])
    for when, r_, t in reversed(cases[:-1]):
        rec, text = F.when(when, r_).otherwise(rec), F.when(when, t).otherwise(text)
    return tests.select(*DS, rec.alias("recommended"), text.alias("diagnosis"), (rec == c("true_label")).alias("consistent"))


def pklm_classify(tests: DataFrame, untested: str = "MCAR") -> DataFrame:
    """MCAR unless pklm_p < .05; then MAR where the mask follows X1 (|r| > .1), else MNAR.

    Datasets without a pklm_p (too few rows on a side) are ``untested``; "shift" classes them by the correlation, as rejected ones.
    """
    kept = ~(F.col("pklm_p") < 0.05)
    shifted = F.when(F.abs("corr_x1") > 0.1, "MAR").otherwise("MNAR")
    none = shifted if untested == "shift" else F.lit(untested)
    return tests.select(*DS, F.when(kept, "MCAR").when(F.col("pklm_p").isNull(), none).otherwise(shifted).alias("prediction"))


def rejection_rates(tests: DataFrame, p: str = "pklm_p") -> DataFrame:
    """true_label, n, rejection rate at .05 (type I error for MCAR, power for the others), mean and deviation of p; 'non-MCAR' pools two."""
    both = tests.select("true_label", p).union(tests.where("true_label <> 'MCAR'").select(F.lit("non-MCAR"), p))
    return both.groupBy("true_label").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col(p) < 0.05).cast("double")).alias("rejection_rate"), F.avg(p).alias("mean_p"), F.stddev_samp(p).alias("std_p"))


def mechdetect_rule(aucs: DataFrame, cs: float = 0.05, ce: float = 0.03) -> DataFrame:
    """MCAR if the complete task beats the shuffled one by less than cs or the fold test says so; MAR if it beats the one without X0 by less than ce."""
    d_cs, d_ce = F.col("auc_complete") - F.col("auc_shuffled"), F.col("auc_complete") - F.col("auc_excluded")
    return aucs.withColumn("prediction", F.when((d_cs < cs) | (F.col("mwu_p") > 0.05), "MCAR").when(d_ce < ce, "MAR").otherwise("MNAR"))


def threshold_grid_search(aucs: DataFrame, cs_grid: list[float], ce_grid: list[float]) -> DataFrame:
    """cs, ce, accuracy of every pair of thresholds, and ``best`` for the highest (the smallest pair of equals).

    The grid is an array beside each row, so a single pass makes all accuracies.
    """
    grid = F.array(*[F.struct(F.lit(a).alias("cs"), F.lit(b).alias("ce")) for a in cs_grid for b in ce_grid])
    each = aucs.select("*", F.explode(grid).alias("g"))
    d_cs, d_ce = F.col("auc_complete") - F.col("auc_shuffled"), F.col("auc_complete") - F.col("auc_excluded")
    pred = F.when((d_cs < F.col("g.cs")) | (F.col("mwu_p") > 0.05), "MCAR").when(d_ce < F.col("g.ce"), "MAR").otherwise("MNAR")
    acc = each.groupBy("g.cs", "g.ce").agg(F.avg((pred == F.col("true_label")).cast("double")).alias("accuracy"))
    return acc.withColumn("best", F.row_number().over(W.orderBy(F.desc(F.round("accuracy", 9)), "cs", "ce")) == 1)
