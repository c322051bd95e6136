"""Mutual information by nearest neighbours (Ross, 2014), in one dimension: neighbours are neighbours in order of value."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.functions.digamma import digamma_sql
from lacuna.functions.rng import normal, row_number_sql
from lacuna.sources.panels import PREDICTORS
from lacuna.sources.stage import finished, materialize

from .kernels import unpivoted, with_mask
from .ranks import placed, with_near

DS = ["dataset_id"]
NEIGHBOURS = 3
#: Relative size of the draw that tells equal values apart.
JITTER = 1e-6
#: What of the distance to the last neighbour counts as closer.
INSIDE = 1 - 1e-9


def mutual_information(long: DataFrame, by: list[str], number: str, label: str, seed: int = 51) -> DataFrame:
    """by, mi: mutual information (nats, at least 0) of value and label in each group; long has by, value, the label and a whole number.

    For each row the distance to its third neighbour of the same label is met with the number of all rows closer than that.  Values are
    scaled by their deviation, and equal ones told apart by a tiny draw of the row's number.  Neighbours and running counts are found by ranges
    and blocks, so no group is one task.
    """

    def neighbours() -> DataFrame:
        clean = long.where("value is not null and not isnan(value)")
        s = clean.groupBy(*by).agg(F.stddev_pop("value").alias("s"), F.avg(F.abs("value")).alias("m"))
        scale = F.when(F.col("s") > 0, F.col("s")).otherwise(1.0)
        v = F.col("value") / scale + JITTER * F.greatest(F.lit(1.0), F.col("m") / scale) * normal(seed, number)
        rows = materialize(clean.join(s, by).select(*by, F.expr(number).alias("id"), F.col(label).alias("label"), v.alias("v")))
        sizes = rows.groupBy(*by, "label").agg(F.count(F.lit(1)).alias("same"))
        ordered = placed(rows, [*by, "label"], ["v", "id"], "place")
        gaps = {f"before{k}": (lambda w, k=k: F.col("v") - F.lag("v", k).over(w)) for k in range(1, NEIGHBOURS + 1)}
        gaps |= {f"after{k}": (lambda w, k=k: F.lead("v", k).over(w) - F.col("v")) for k in range(1, NEIGHBOURS + 1)}
        near = with_near(ordered, [*by, "label"], "place", NEIGHBOURS, gaps).join(sizes.where("same > 1"), [*by, "label"])
        near = near.withColumn("k", F.least(F.lit(NEIGHBOURS), F.col("same") - 1).cast("int"))
        closest = F.array_sort(F.array_compact(F.array(*gaps)))
        return near.withColumn("r", INSIDE * closest[F.col("k") - 1]).select(*by, "id", "label", "v", "r", "k", "same")  # the neighbour itself lies outside

    near = finished(long.sparkSession, neighbours)
    # how many rows lie inside (v - r, v + r): running counts at both ends, ends before or after equal values
    event = lambda value, kind: F.struct(value.alias("at"), F.lit(kind).alias("kind"))
    events = near.select(*by, "id", F.explode(F.array(event(F.col("v"), 1), event(F.col("v") + F.col("r"), 0), event(F.col("v") - F.col("r"), 2))).alias("e"))
    counted = placed(events.select(*by, "id", "e.at", "e.kind"), by, ["at", "kind", "id"], "event_no", {"upto": (F.col("kind") == 1).cast("long")})
    inside = counted.where("kind <> 1").groupBy(*by, "id").agg(
        (F.max(F.when(F.col("kind") == 0, F.col("upto"))) - F.max(F.when(F.col("kind") == 2, F.col("upto")))).alias("inside")
    )
    psi = lambda x: F.expr(digamma_sql(x))
    each = near.select(*by, "id", psi("k").alias("pk"), psi("same").alias("ps")).join(inside.select(*by, "id", psi("greatest(inside, 1)").alias("pi")), [*by, "id"])
    n = each.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("pk") - F.col("ps") - F.col("pi")).alias("rest"))
    return n.select(*by, F.greatest(psi("n") + F.col("rest"), F.lit(0.0)).alias("mi"))


def mask_mutual_info(panel: DataFrame) -> DataFrame:
    """dataset_id, mi_max, mi_mean over the predictors; 0 with fewer than five rows on a side."""
    df = with_mask(panel)
    keep = ("dataset_id", "dataset_no", "row_id", "mask")
    # a predictor at a time: what is shuffled for one is gone before the next one
    each = [finished(panel.sparkSession, lambda x=x: mutual_information(unpivoted(df, (x,), keep), [*DS, "var"], row_number_sql(), "mask")) for x in PREDICTORS]
    mi = reduce(DataFrame.union, each).groupBy(*DS).agg(F.max("mi").alias("a"), F.avg("mi").alias("b"))
    side = df.groupBy(*DS).agg(F.least(F.sum("mask"), F.sum(1 - F.col("mask"))).alias("side"))
    value = lambda c: F.when(F.col("side") >= 5, F.coalesce(F.col(c), F.lit(0.0))).otherwise(0.0)
    return side.join(mi, DS, "left").select(*DS, value("a").alias("mi_max"), value("b").alias("mi_mean"))


def feature_mutual_info(long: DataFrame, label: str = "label", low: float = 0.01) -> DataFrame:
    """var, mi, low: mutual information of each feature and the label; long: id, label, var, value."""
    return mutual_information(long, ["var"], "id", label).withColumn("low", F.col("mi") < low)
