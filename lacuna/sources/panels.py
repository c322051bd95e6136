"""Panels: one long table for many datasets, X0 the target and X1..X4 the predictors.

Columns: dataset_id, dataset_no (whole number), source_group, row_id (1, 2, ... in the dataset), x0..x4.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PREDICTORS = ("x1", "x2", "x3", "x4")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def numbered(df: DataFrame, dataset: str, order: list[str]) -> DataFrame:
    return df.withColumn("row_id", F.row_number().over(W.partitionBy(dataset).orderBy(*order)).cast("long"))


def lineitem_panel(spark: SparkSession, sf_dir: str, correlated: bool = False) -> DataFrame:
    """One dataset for each supplier; the five-column order is unique within a supplier."""
    li = read(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").cast("long").alias("dataset_no"), "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax"
    )
    li = numbered(li, "dataset_no", ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice"])
    x0 = F.col("l_extendedprice") + (2000 * F.col("l_quantity") if correlated else 0)
    return li.select(
        F.concat(F.lit("S"), F.col("dataset_no").cast("string")).alias("dataset_id"), "dataset_no",
        F.concat(F.lit("g"), (F.col("dataset_no") % 20).cast("string")).alias("source_group"), "row_id",
        x0.cast("double").alias("x0"), F.col("l_quantity").cast("double").alias("x1"), F.col("l_discount").cast("double").alias("x2"),
        F.col("l_tax").cast("double").alias("x3"), F.col("l_linenumber").cast("double").alias("x4"),
    )


def events_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One dataset for each user of the event stream, in order of time; X1 is the hour, X2..X4 are pads."""
    from lacuna.functions.rng import row_number_sql, uniform

    ev = read(spark, sf_dir, "events").select(F.col("user_id").cast("long").alias("dataset_no"), "ts", "event_id", F.col("value").cast("double").alias("x0"))
    ev = numbered(ev, "dataset_no", ["ts", "event_id"])
    n = row_number_sql()
    return ev.select(
        F.concat(F.lit("U"), F.col("dataset_no").cast("string")).alias("dataset_id"), "dataset_no", F.lit("events").alias("source_group"), "row_id",
        "x0", F.hour("ts").cast("double").alias("x1"), *[uniform(100 + k, n).alias(f"x{k}") for k in (2, 3, 4)],
    )


def checked(panel: DataFrame) -> DataFrame:
    """``panel``, if the rows of every dataset are numbered 1, 2, ..., n below ``STRIDE``, as operators that draw row numbers need; else an error.

    One aggregation over two columns.
    """
    from lacuna.functions.rng import STRIDE

    one = panel.groupBy("dataset_id").agg(
        F.min("row_id").alias("low"), F.max("row_id").alias("high"), F.count("row_id").alias("n"), F.count(F.lit(1)).alias("rows"),
        F.sum(F.col("row_id").cast("decimal(38,0)")).alias("total"), F.min("dataset_no").alias("no"), F.max("dataset_no").alias("other_no"),
    )
    n = F.col("n").cast("decimal(38,0)")
    odd = (F.col("low") != 1) | (F.col("high") != F.col("n")) | (F.col("n") != F.col("rows")) | (2 * F.col("total") != n * (n + 1)) | F.col("no").isNull() | (F.col("no") != F.col("other_no"))
    if bad := one.where(odd).select("dataset_id").head(1):
        raise ValueError(f"rows of dataset {bad[0][0]} are not numbered 1 to n under one dataset_no")
    if bad := one.where(F.col("high") >= STRIDE).select("dataset_id").head(1):
        raise ValueError(f"dataset {bad[0][0]} has {STRIDE} rows or more: draws would repeat those of the next dataset")
    return panel
