"""Profiles of datasets and combination of judgements about them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .kernels import corr, runs, with_mask

DS = ["dataset_id"]
MECHANISMS = ("MCAR", "MAR", "MNAR")
#: Scores of the mechanisms in combined judgements (fixed values).
MECHANISM_SCORE = {"MCAR": 0.0, "MAR": 0.5, "MNAR": 1.0}


def x0_stats(panel: DataFrame) -> DataFrame:
    """Moments and percentiles of the observed X0, rounded; datasets with fewer than two observed rows are left out."""
    ps = [0.05, 0.25, 0.5, 0.75, 0.95]
    a = panel.groupBy(*DS).agg(
        F.avg("x0").alias("mean"), F.stddev_samp("x0").alias("std"), F.min("x0").alias("min"), F.max("x0").alias("max"),
        F.percentile("x0", F.array(*map(F.lit, ps))).alias("q"), F.skewness("x0").alias("skew"), F.kurtosis("x0").alias("kurt"),
        F.count(F.lit(1)).alias("n_total"), F.count("x0").alias("n_observed"),
    ).where("n_observed >= 2")
    six = lambda c: F.round(c, 6) + F.lit(0.0)
    q = F.col("q")
    return a.select(
        *DS, six(F.col("mean")).alias("X0_mean"), six(F.col("std")).alias("X0_std"), six(F.col("min")).alias("X0_min"), six(F.col("max")).alias("X0_max"),
        six(q[2]).alias("X0_median"), six(F.col("skew")).alias("X0_skew"), six(F.col("kurt")).alias("X0_kurtosis"), six(q[0]).alias("X0_p5"), six(q[1]).alias("X0_p25"),
        six(q[3]).alias("X0_p75"), six(q[4]).alias("X0_p95"), "n_total", (F.col("n_total") - F.col("n_observed")).alias("n_missing"), "n_observed",
        F.round((F.col("n_total") - F.col("n_observed")) / F.col("n_total"), 4).alias("missing_rate"),
    )


def preferred(raw: DataFrame, scaled: DataFrame) -> DataFrame:
    """Statistics of the raw table where there are some, else those of the scaled one."""
    columns = [c for c in raw.columns if c not in DS]
    return raw.alias("r").join(scaled.alias("s"), DS, "full").select(
        *DS, *[F.when(F.col("r.n_total").isNotNull(), F.col(f"r.{c}")).otherwise(F.col(f"s.{c}")).alias(c) for c in columns],
        F.when(F.col("r.n_total").isNotNull(), "raw").otherwise("scaled").alias("origin"),
    )


def burst_profile(panel: DataFrame) -> DataFrame:
    """Bursts of missing rows in order: number, mean size, runs over the runs that chance gives."""
    df = panel.select(*DS, "row_id", F.when(F.col("x0").isNull(), 1).otherwise(0).alias("mask"))
    each = runs(df, DS, "row_id", "mask")
    got = each.groupBy(*DS).agg(
        F.count(F.lit(1)).alias("runs"), F.count_if(F.col("value") == 1).alias("n_bursts"), F.avg(F.when(F.col("value") == 1, F.col("length"))).alias("size"),
        F.sum("length").alias("n"), F.coalesce(F.sum(F.when(F.col("value") == 1, F.col("length"))), F.lit(0)).alias("m"),
    )
    expected = 2 * F.col("m") * (F.col("n") - F.col("m")) / F.col("n") + 1
    return got.where("m > 0 and m < n").select(*DS, "n_bursts", F.col("size").alias("avg_burst_size"), (F.col("runs") / expected).alias("runs_ratio"))


def evidence_scores(panel: DataFrame) -> DataFrame:
    """First-order figures and combined evidence for MAR and MNAR, conflict, anomaly, agreement of signs."""
    df = panel.withColumn("mask", F.when(F.col("x0").isNull(), 1).otherwise(0))
    a = df.groupBy(*DS).agg(
        F.count(F.lit(1)).alias("n_total"), F.sum("mask").alias("n_missing"), corr("mask", "x1").alias("r"),
        (F.avg(F.when(F.col("mask") == 1, F.col("x1"))) - F.avg(F.when(F.col("mask") == 0, F.col("x1")))).alias("shift"),
        F.skewness("x0").alias("skew"), F.percentile("x0", 0.5).alias("median"), F.avg("x0").alias("mean"), (F.max("x0") - F.min("x0")).alias("range"), F.count("x0").alias("n_obs"),
    )
    four = lambda c: F.round(c, 4) + F.lit(0.0)
    r = F.coalesce(F.when(~F.isnan("r"), four(F.col("r"))), F.lit(0.0))
    shift = F.coalesce(four(F.col("shift")), F.lit(0.0))
    deviation = F.when(F.col("n_obs") > 10, four((F.col("median") - F.col("mean")) / F.greatest("range", F.lit(0.01)))).otherwise(0.0)
    skew = F.when(F.col("n_obs") > 1, four(F.coalesce("skew", F.lit(0.0)))).otherwise(0.0)
    b = a.select(*DS, "n_total", "n_missing", r.alias("corr_X1_mask"), shift.alias("X1_mean_diff"), deviation.alias("X0_mean_deviation"), skew.alias("X0_obs_skew"))
    mar = F.abs("corr_X1_mask") * 5 + F.abs("X1_mean_diff") * 5
    mnar = F.abs("X0_mean_deviation") * 5 + F.abs("X0_obs_skew") * 2
    d, s = F.col("X0_mean_deviation"), F.col("X0_obs_skew")
    return b.select(
        "*", four(F.least(mar, F.lit(1.0))).alias("mar_combined_evidence"), four(F.least(mnar, F.lit(1.0))).alias("mnar_combined_evidence"),
        four(mar * mnar).alias("evidence_conflict_score"), four(F.abs("X0_mean_deviation") * 10 + F.abs("X0_obs_skew")).alias("anomaly_score"),
        F.when((d != 0) & (s != 0), F.when(F.signum(d) == F.signum(s), 1.0).otherwise(0.0)).otherwise(0.5).alias("mnar_internal_consistency"),
    )


def quartile_rates(df: DataFrame, value: str, prefix: str, empty: Column | None = None) -> DataFrame:
    """Missing rate in each quarter of ``value`` (a quarter holds its lower cut), rounded; df has mask."""
    cuts = df.groupBy(*DS).agg(F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    x, q = F.col(value), F.col("q")
    part = F.when(x < q[0], 1).when(x < q[1], 2).when(x < q[2], 3).otherwise(4)
    rate = lambda k: F.round(F.avg(F.when(part == k, F.col("mask"))), 4)
    return df.join(cuts, DS).groupBy(*DS).agg(*[(rate(k) if empty is None else F.coalesce(rate(k), empty)).alias(f"{prefix}{k}") for k in range(1, 5)])


def quartile_missing_rates(panel: DataFrame) -> DataFrame:
    return quartile_rates(with_mask(panel), "x0f", "Q")


def x1_quartile_missing_rates(panel: DataFrame) -> DataFrame:
    return quartile_rates(with_mask(panel), "x1", "x1_q", F.lit(0.0))


def mask_correlations(panel: DataFrame) -> DataFrame:
    """Pearson correlation of the mask with each predictor, rounded; null for a constant one."""
    df = panel.withColumn("mask", F.when(F.col("x0").isNull(), 1.0).otherwise(0.0))
    value = lambda x: F.when(~F.isnan(corr("mask", x)), F.round(corr("mask", x), 4) + F.lit(0.0))
    return df.groupBy(*DS).agg(*[value(f"x{k}").alias(f"corr_mask_x{k}") for k in range(1, 5)])


def profile_text(panel: DataFrame) -> DataFrame:
    """A dataset's profile as one sentence."""
    df = panel.withColumn("mask", F.when(F.col("x0").isNull(), 1).otherwise(0))
    a = df.groupBy(*DS).agg(
        F.count(F.lit(1)).alias("n"), F.sum("mask").alias("m"), F.avg("x0").alias("mean"), F.min("x0").alias("lo"), F.max("x0").alias("hi")
    )
    whole = lambda c: F.floor(c + F.lit(0.5)).cast("long").cast("string")
    text = F.concat_ws(
        " ", F.lit("Dataset of"), F.col("n").cast("string"), F.lit("rows;"), F.col("m").cast("string"), F.lit("values of X0 are missing"),
        F.concat(F.lit("("), whole(F.col("m") * 1000.0 / F.col("n")), F.lit(" per mille).")),
        F.lit("Observed X0: mean"), F.coalesce(whole(F.col("mean")), F.lit("unknown")), F.lit("from"), F.coalesce(whole(F.col("lo")), F.lit("unknown")),
        F.lit("to"), F.concat(F.coalesce(whole(F.col("hi")), F.lit("unknown")), F.lit(".")),
    )
    return a.select(*DS, text.alias("profile"))


def weighted_vote(judgements: DataFrame, order: str | None = None) -> DataFrame:
    """Vote shares weighted by confidence, winner, agreement and means of the auxiliary scores, for each dataset.

    Judgements: dataset_id, mechanism, confidence, consistency, surprise.  Without any confidence the shares are a third each;
    among equal shares the order MCAR, MAR, MNAR decides.  Sums of doubles depend on their order, and with them near ties: with ``order`` (a column
    that tells a dataset's judgements apart) they are added in it, one after the other, however the rows are dealt.
    """
    known = F.col("mechanism").isin(*MECHANISMS)
    added = {m: F.when(F.col("mechanism") == m, F.col("confidence")).otherwise(0.0) for m in MECHANISMS}
    added |= {"total": F.when(known, F.col("confidence")).otherwise(0.0), "consistency": F.col("consistency"), "surprise": F.col("surprise")}
    counts = [F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("mechanism") == m).alias(f"n_{m}") for m in MECHANISMS], *[F.count(c).alias(f"n_{c}") for c in ("consistency", "surprise")]]
    if order is None:
        a = judgements.groupBy(*DS).agg(*[F.sum(x).alias(k) for k, x in added.items()], *counts)
    else:
        upto = W.partitionBy(*DS).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)  # running sums spill, lists would not
        run = judgements.select(*DS, order, "mechanism", "consistency", "surprise", F.struct(*[F.sum(x).over(upto).alias(k) for k, x in added.items()]).alias("run"))
        a = run.groupBy(*DS).agg(F.max_by("run", order).alias("run"), *counts)
        a = a.select(*DS, "run.*", *[c for c in a.columns if c.startswith("n")])
    share = {m: F.when(F.col("total") > 0, F.col(m) / F.col("total")).otherwise(1 / 3) for m in MECHANISMS}
    top = F.greatest(*share.values())
    winner = F.when(share["MCAR"] == top, "MCAR").when(share["MAR"] == top, "MAR").otherwise("MNAR")
    agree = F.when(winner == "MCAR", F.col("n_MCAR")).when(winner == "MAR", F.col("n_MAR")).otherwise(F.col("n_MNAR")) / F.col("n")
    four = lambda c: F.round(c, 4)
    mean = lambda c: four(F.try_divide(F.col(c), F.col(f"n_{c}")))
    return a.select(
        *DS, winner.alias("winner"), four(top).alias("confidence"), four(agree).alias("agreement"),
        *[four(share[m]).alias(f"vote_{m.lower()}") for m in MECHANISMS], mean("consistency").alias("consistency"), mean("surprise").alias("surprise"),
    )


def combine_judgements(prior: DataFrame, counter: DataFrame) -> DataFrame:
    """Scores from a first judgement and the one after counter-arguments, joined by dataset."""
    score = lambda c: F.when(c == "MCAR", 0.0).when(c == "MAR", 0.5).when(c == "MNAR", 1.0).otherwise(0.5)
    j = prior.alias("p").join(counter.alias("c"), DS)
    return j.select(
        *DS, score(F.col("p.mechanism")).alias("domain_prior"), F.col("p.confidence").alias("domain_confidence"), F.col("p.consistency").alias("stats_consistency"),
        F.col("p.surprise").alias("surprise"), F.round(F.abs(F.col("c.confidence") - F.col("p.confidence")), 4).alias("confidence_delta"),
        F.round(F.least(F.col("p.n_causes") / F.lit(5.0), F.lit(1.0)), 4).alias("n_causes"),
    )
