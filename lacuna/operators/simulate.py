"""Simulated missingness with known truth: twelve ways to null X0 of complete panels.

Each way takes a panel, a rate (a number or a column that is constant within a dataset) and a seed.
If no row of a dataset is hit, the row of highest probability (a random one where rows are equal) is.
Dataset-wide figures come from aggregations that combine inside tasks and are joined back; ranks come from
ranges of (dataset, value), so that no dataset is one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.functions.rng import STRIDE, normal, row_number_sql, uniform
from lacuna.sources.panels import checked
from lacuna.sources.stage import materialize

from .ranks import placed

VARIANTS = {
    "mcar_uniform": "MCAR", "mcar_fixed": "MCAR", "mcar_block": "MCAR",
    "mar_logistic": "MAR", "mar_threshold": "MAR", "mar_rank": "MAR", "mar_quantile_group": "MAR", "mar_multi_predictor": "MAR",
    "mnar_self_logistic": "MNAR", "mnar_quantile_threshold": "MNAR", "mnar_tail_censoring": "MNAR", "mnar_self_noisy": "MNAR",
}
_LOGISTIC = {"mar_logistic", "mar_multi_predictor", "mnar_self_logistic", "mnar_self_noisy"}
_NUMBER = row_number_sql()


def _sigmoid(z: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-z))


def _z(variant: str, seed: int) -> Column:
    """The standardised driver of a logistic way; spreads are of the population but for two ways."""
    c = F.col
    if variant == "mar_logistic":
        return (c("x1") - c("m1")) / (c("p1") + 1e-9)
    if variant == "mar_multi_predictor":
        return 0.7 * (c("x1") - c("m1")) / (c("s1") + 1e-9) + 0.3 * (c("x2") - c("m2")) / (c("s2") + 1e-9)
    if variant == "mnar_self_logistic":
        return (c("x0") - c("m0")) / (c("p0") + 1e-9)
    return (c("x0") + 0.1 * normal(seed + 3, _NUMBER) - c("m0")) / (c("p0") + 1e-9)


def _figures(panel: DataFrame, variants: list[str]) -> DataFrame:
    """One row for each dataset: its way and rate, size, moments and quartiles, as far as the ways need them."""
    made = [F.max("way").alias("way"), F.max("rate").alias("rate"), F.count(F.lit(1)).alias("n")]
    if _LOGISTIC & set(variants):
        for k in "012":
            made += [F.avg(f"x{k}").alias(f"m{k}"), F.stddev_pop(f"x{k}").alias(f"p{k}"), F.stddev_samp(f"x{k}").alias(f"s{k}")]
    if "mar_quantile_group" in variants:
        grouped = F.when(F.col("way") == "mar_quantile_group", F.col("x1"))
        made.append(F.percentile(grouped, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q1"))
    return panel.groupBy("dataset_id").agg(*made).withColumn("n_miss", F.greatest(F.lit(1), F.floor(F.col("rate") * F.col("n"))).cast("long"))


def _blocks(panel: DataFrame, seed: int) -> DataFrame:
    """dataset_id, row_id of rows inside the random blocks: a few, of equal size, together at most n_miss rows."""
    sizes = panel.groupBy("dataset_id", "dataset_no").agg(F.max("n").alias("n"), F.max("n_miss").alias("n_miss"))
    most = F.greatest(F.lit(2), F.floor(F.col("n_miss") / 5)).cast("long")
    sizes = sizes.withColumn("blocks", 1 + F.floor(uniform(seed + 11, f"dataset_no * {STRIDE}") * most))
    sizes = sizes.withColumn("size", F.greatest(F.lit(1), F.floor(F.col("n_miss") / F.col("blocks"))).cast("long"))
    each = sizes.withColumn("block", F.explode(F.sequence(F.lit(1).cast("long"), F.col("blocks").cast("long"))))
    start = F.floor(uniform(seed + 12, f"dataset_no * {STRIDE} + block") * F.greatest(F.lit(1), F.col("n") - F.col("size")))
    each = each.withColumn("start", start.cast("long"))
    rows = F.explode(F.sequence(F.col("start") + 1, F.col("start") + F.col("size")))
    return each.select("dataset_id", rows.alias("row_id")).distinct()


def _ranked(rows: DataFrame, ways: list[str]) -> DataFrame:
    """dataset_id, dataset_no, row_id, p, hit of the rows of ways that go by places or by the linear 1 - rate quantile of ``rank_key``.

    Places come from ranges of (dataset, key), whichever size a dataset has; equal values are ranked by row from either end.
    """
    kept = ["dataset_id", "dataset_no", "row_id", F.lit(None).cast("double").alias("p")]
    ends = materialize(placed(rows.where(F.col("way").isin(*ways)).drop("raw", "p"), ["dataset_id"], [F.desc("rank_key"), "row_id"], "down"))
    top = ends.where(F.col("way").isin("mcar_fixed", "mar_rank")).select(*kept, (F.col("down") <= F.col("n_miss")).alias("hit"))
    if "mnar_tail_censoring" in ways:
        low = F.floor(F.col("n_miss") / 2)
        tails = placed(ends.where("way = 'mnar_tail_censoring'"), ["dataset_id"], ["rank_key", "row_id"], "up")
        top = top.union(tails.select(*kept, ((F.col("up") <= low) | (F.col("down") <= F.col("n_miss") - low)).alias("hit")))
    cut = [w for w in ("mar_threshold", "mnar_quantile_threshold") if w in ways]
    if cut:
        h = (F.col("n") - 1) * (1 - F.col("rate"))
        low, high = F.floor(h), F.ceil(h)
        at = lambda j: F.max(F.when(F.col("n") - F.col("down") == j, F.col("rank_key")))
        over = ends.where(F.col("way").isin(*cut))
        two = over.withColumns({"h": h, "low": low, "high": high})
        two = two.where((F.col("n") - F.col("down")).between(F.col("low"), F.col("high"))).groupBy("dataset_id").agg(
            at(F.col("low")).alias("a"), at(F.col("high")).alias("b"), F.max(F.col("h") - F.col("low")).alias("part")
        )
        two = two.select("dataset_id", (F.col("a") + F.col("part") * (F.col("b") - F.col("a"))).alias("cut"))
        top = top.union(over.join(two, "dataset_id", "left").select(*kept, (F.col("rank_key") >= F.col("cut")).alias("hit")))
    return top


def simulate(panel: DataFrame, variant: str | Column, rate: float | Column, seed: int) -> DataFrame:
    """The panel with x0 nulled in the given way (a name, or a column of names constant within datasets).

    What each row needs is written once, narrow; every way marks its own rows of that table, and only those that are hit are joined to the panel.
    """
    which = [variant] if isinstance(variant, str) else list(VARIANTS)
    columns = panel.columns
    if "mcar_block" in which:
        checked(panel)  # blocks are drawn as ranges of row numbers
    df = panel.withColumns({"rate": F.lit(rate) if isinstance(rate, float) else rate, "way": F.lit(variant) if isinstance(variant, str) else variant})
    figures = materialize(_figures(df, which))
    df = df.select("dataset_id", "dataset_no", "row_id", "x0", "x1", "x2").join(figures, "dataset_id")
    # what a way ranks a dataset's rows by, from the top
    u = uniform(seed, _NUMBER)
    keys = {"mcar_fixed": -u, "mar_threshold": F.col("x1"), "mar_rank": F.col("x1"), "mnar_quantile_threshold": F.col("x0"), "mnar_tail_censoring": F.col("x0")}
    raw = p = key = F.lit(None).cast("double")
    for w in which:
        own = F.col("way") == w
        if w in _LOGISTIC:
            raw = F.when(own, _sigmoid(_z(w, seed))).otherwise(raw)
        if w in keys:
            key = F.when(own, keys[w]).otherwise(key)
        if w == "mar_quantile_group":
            x1, q, r = F.col("x1"), F.col("q1"), F.col("rate")
            steps = F.when(x1 <= q[0], r * 0.2).when(x1 <= q[1], r * 0.6).when(x1 <= q[2], r * 1.4).otherwise(r * 2.0)
            p = F.when(own, F.least(steps, F.lit(1.0)))
    rows = materialize(df.select("dataset_id", "dataset_no", "row_id", "way", "rate", "n", "n_miss", raw.alias("raw"), p.alias("p"), key.alias("rank_key")))
    parts = []
    mark = lambda rows, hit: parts.append(rows.select("dataset_id", "dataset_no", "row_id", "p", hit.alias("hit")))
    if logistic := [w for w in which if w in _LOGISTIC]:
        some = rows.where(F.col("way").isin(*logistic))
        some = some.join(some.groupBy("dataset_id").agg(F.avg("raw").alias("mean_raw")), "dataset_id")
        scaled = F.least(F.greatest(F.col("raw") * (F.col("rate") / (F.col("mean_raw") + 1e-12)), F.lit(0.0)), F.lit(1.0))
        mark(some.withColumn("p", scaled), u < F.col("p"))
    if "mar_quantile_group" in which:
        mark(rows.where("way = 'mar_quantile_group'"), u < F.col("p"))
    if "mcar_uniform" in which:
        mark(rows.where("way = 'mcar_uniform'"), u < F.col("rate"))
    if "mcar_block" in which:
        some = rows.where("way = 'mcar_block'")
        some = some.join(_blocks(some, seed).withColumn("in_block", F.lit(True)), ["dataset_id", "row_id"], "left")
        mark(some, F.coalesce(F.col("in_block"), F.lit(False)))
    if ranked := [w for w in which if w in keys]:
        parts.append(_ranked(rows, ranked))
    marked = materialize(reduce(DataFrame.union, parts))
    # none hit: the likeliest row, else the one of the lowest draw
    rank = F.struct(F.coalesce(F.col("p"), 1 - u).alias("p"), (-F.col("row_id")).alias("r"))
    forced = marked.groupBy("dataset_id").agg(F.max("hit").alias("any_hit"), F.max_by("row_id", rank).alias("row_id")).where("not any_hit")
    gone = marked.where("hit").select("dataset_id", "row_id").union(forced.select("dataset_id", "row_id")).distinct().withColumn("gone", F.lit(True))
    out = panel.join(gone, ["dataset_id", "row_id"], "left")
    return out.withColumn("x0", F.when(F.col("gone"), None).otherwise(F.col("x0"))).select(*columns)


def variant_of(dataset_no: str = "dataset_no") -> Column:
    """Ways in turn by dataset number."""
    return F.element_at(F.array(*[F.lit(v) for v in VARIANTS]), (F.col(dataset_no) % len(VARIANTS) + 1).cast("int"))


def mechanism_of(variant: Column) -> Column:
    return F.upper(F.substring_index(variant, "_", 1))


def generate_benchmark(panel: DataFrame, seed: int = 42) -> DataFrame:
    """Every dataset masked in its way, at 1..10 percent; variant, mechanism and label (0 MCAR, 1 MAR, 2 MNAR)
    beside the panel's columns; datasets in which nothing is missing are dropped."""
    rate = (1 + F.col("dataset_no") % 10) / F.lit(100.0)
    masked = materialize(simulate(panel, variant_of(), rate, seed))
    whole = materialize(masked.groupBy("dataset_id").agg(F.count_if(F.col("x0").isNull()).alias("n_null")).where("n_null = 0").select("dataset_id"))  # few or none
    kind = mechanism_of(F.col("variant"))
    return masked.join(whole, "dataset_id", "left_anti").withColumn("variant", variant_of()).withColumns(
        {"mechanism": kind, "label": F.when(kind == "MCAR", 0).when(kind == "MAR", 1).otherwise(2)}
    )


def base_values(keys: DataFrame, seed: int = 42) -> DataFrame:
    """Complete synthetic values x0..x4 in [0, 1] for rows of (dataset_id, dataset_no, source_group, row_id): uniform, clipped normal,
    clipped exponential and Beta(2, 5) datasets in turn."""
    made = {}
    for k in range(5):
        s = seed + 31 * k
        u = uniform(s, _NUMBER)
        clip = lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))
        beta = F.array_sort(F.array(*[uniform(s + 200 + j, _NUMBER) for j in range(6)]))[1]
        made[f"x{k}"] = (
            F.when(F.col("dataset_no") % 4 == 0, u)
            .when(F.col("dataset_no") % 4 == 1, clip(0.5 + 0.15 * normal(s, _NUMBER)))
            .when(F.col("dataset_no") % 4 == 2, clip(-0.3 * F.log(1 - u)))
            .otherwise(beta)
        )
    return keys.select("dataset_id", "dataset_no", "source_group", "row_id", *[v.alias(k) for k, v in made.items()])


def base_panel(spark: SparkSession, datasets: int, rows: int, seed: int = 42) -> DataFrame:
    """``datasets`` complete synthetic panels of ``rows`` rows."""
    ids = spark.range(datasets * rows).select((F.col("id") / rows).cast("long").alias("dataset_no"), (F.col("id") % rows + 1).alias("row_id"))
    return base_values(ids.select(F.concat(F.lit("B"), F.col("dataset_no").cast("string")).alias("dataset_id"), "dataset_no", F.lit("base").alias("source_group"), "row_id"), seed)
