"""Places, running sums and neighbours of rows in groups of any size: work by ranges and blocks, no group is one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lacuna.sources.stage import materialize

#: Rows of a group that are looked at together.
BLOCK = 50_000


def placed(df: DataFrame, by: list[str], order: list, name: str, sums: dict[str, Column] | None = None) -> DataFrame:
    """df with ``name``: the place (1, 2, ...) of each row in its group; and with running sums, the row's own value included.

    Rows are dealt by ranges of (group, order), each range is numbered and summed, and what a group has in earlier ranges is added.
    Order (columns, or expressions such as ``F.desc``) must tell rows apart; groups are not null.
    """
    dealt = materialize(df.repartitionByRange(*by, *order).withColumn("range_no", F.spark_partition_id()))
    own = W.partitionBy("range_no", *by).orderBy(*order)
    parts = {name: F.lit(1).cast("long"), **(sums or {})}
    sizes = dealt.groupBy("range_no", *by).agg(*[F.sum(x).alias(f"own_{k}") for k, x in parts.items()])  # a row for each range and group
    before = W.partitionBy(*by).orderBy("range_no").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("range_no", *by, *[F.coalesce(F.sum(f"own_{k}").over(before), F.lit(0)).alias(f"before_{k}") for k in parts])
    upto = own.rowsBetween(W.unboundedPreceding, 0)
    within = dealt.withColumns({f"within_{k}": F.row_number().over(own) if k == name else F.sum(x).over(upto) for k, x in parts.items()})
    out = within.join(offsets, ["range_no", *by])
    total = {k: F.col(f"within_{k}") + F.col(f"before_{k}") for k in parts}
    return out.select(*df.columns, *[(v.cast("long") if k == name else v).alias(k) for k, v in total.items()])


def with_near(df: DataFrame, by: list[str], place: str, reach: int, columns: dict, block: int = BLOCK) -> DataFrame:
    """df with columns made over the rows at most ``reach`` places away: name -> function of a window in order of place.

    Groups are cut into blocks of places, each with the ``reach`` rows before and after it.
    """
    at = F.floor((F.col(place) - 1) / block)
    inside = (F.col(place) - 1) % block
    also = F.array_compact(F.array(at, F.when((inside < reach) & (at > 0), at - 1), F.when(inside >= block - reach, at + 1)))
    each = df.withColumn("near_block", F.explode(also))
    window = W.partitionBy(*by, "near_block").orderBy(place)
    made = each.withColumns({k: f(window) for k, f in columns.items()})
    return made.where(F.col("near_block") == at).drop("near_block")
