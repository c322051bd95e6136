"""Reading and writing trees of dataset files, and the tables that runs leave behind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lacuna.operators.ranks import placed

from .stage import materialize

_VALUES = ("x0", "x1", "x2", "x3", "x4")
FILE_SCHEMA = ", ".join(f"{c} double" for c in _VALUES)
MECHANISMS = ("MCAR", "MAR", "MNAR")


def parse_dataset_name(name: Column) -> dict[str, Column]:
    """mechanism, variant_key, seed, missing_rate and boot_id of a file name such as MAR_logistic_seed42_mr5.txt."""
    stem = F.regexp_replace(name, r"\.txt$", "")
    number = lambda p: F.nullif(F.regexp_extract(stem, p, 1), F.lit("")).try_cast("int")
    body = F.regexp_replace(F.regexp_replace(stem, r"^(MCAR|MAR|MNAR)_", ""), r"_?(seed|mr|boot)\d+", "")
    return {
        "mechanism": F.nullif(F.regexp_extract(stem, "^(MCAR|MAR|MNAR)(_|$)", 1), F.lit("")), "variant_key": body,
        "seed": number(r"seed(\d+)"), "missing_rate": number(r"mr(\d+)"), "boot_id": number(r"boot(\d+)"),
    }


def source_group(name: Column) -> Column:
    """The name without resample number or extension."""
    return F.regexp_replace(name, r"(_boot\d+)?(\.txt)?$", "")


def write_datasets(panel: DataFrame, path: str) -> None:
    """A folder of tab-separated part files for each dataset, below one for each mechanism; parts in order of name hold the rows in order.

    Rows are dealt by ranges of (dataset, row): a large dataset is written by several tasks.
    """
    rows = panel.repartitionByRange("mechanism", "dataset_id", "row_id").sortWithinPartitions("mechanism", "dataset_id", "row_id")
    rows = rows.select("mechanism", "dataset_id", *[F.coalesce(F.col(c).cast("string"), F.lit("NaN")).alias(c) for c in _VALUES])
    rows.write.option("sep", "\t").option("header", True).partitionBy("mechanism", "dataset_id").csv(path)


def read_datasets(spark: SparkSession, *folders: str) -> DataFrame:
    """All datasets below the folders as one panel that every operator takes: dataset_id, dataset_no, source_group, mechanism, label, row_id, x0..x4.

    A dataset is a file below its mechanism's folder, or a folder of part files there, read in order of name.  The mechanism is the
    folder's name (its part after ``=``, as partitioned writers name it); label is 0, 1, 2 for MCAR, MAR, MNAR and null for other folders.  NaN and
    empty fields become null.  Row numbers run 1, 2, ... through each dataset in the order of its files; datasets are numbered 1, 2, ... in
    order of their paths.  Where two datasets have one name, their mechanism is put before it, then (if that is not enough) their number.

    Two passes: the first writes each row with its split and its place there (splits are bounded by spark.sql.files.maxPartitionBytes), the second
    adds up the rows of earlier splits.  No dataset is sorted and none is one task.
    """
    df = spark.read.schema(FILE_SCHEMA).option("sep", "\t").option("header", True).option("nullValue", "").option("recursiveFileLookup", True).csv(list(folders))
    file, start = F.col("_metadata.file_path"), F.col("_metadata.file_block_start")
    clean = [F.nullif(F.nanvl(F.col(c), F.lit(None).cast("double")), F.lit(None)).alias(c) for c in _VALUES]
    # numbers rise along a split, whose rows follow each other in one partition
    rows = materialize(df.select(file.alias("file"), start.alias("split"), F.monotonically_increasing_id().alias("at"), *clean))
    splits = rows.groupBy("file", "split").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    parts = F.split("file", "/")
    folder = F.element_at(parts, -1).rlike(r"^part-\d+")
    plain = lambda c: F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))  # noqa: E731  paths come as URIs
    named = lambda at: F.substring_index(plain(F.element_at(parts, at)), "=", -1)
    escaped = lambda at: plain(named(at))  # noqa: E731  partitioned writers escape values once more
    splits = splits.select(
        "*", F.when(folder, F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/")).otherwise(F.col("file")).alias("place"),
        F.when(folder, escaped(-3)).otherwise(named(-2)).alias("mechanism"), F.when(folder, escaped(-2)).otherwise(F.regexp_replace(named(-1), r"\.txt$", "")).alias("name"),
    )
    before = W.partitionBy("place").orderBy("file", "split").rowsBetween(W.unboundedPreceding, -1)  # a row for each split
    offsets = materialize(splits.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first") + 1))
    sets = offsets.select("place", "mechanism", "name").distinct().withColumn("all", F.lit(1))
    sets = materialize(placed(sets, ["all"], ["place"], "dataset_no").drop("all"))
    alike = lambda *keys: F.count(F.lit(1)).over(W.partitionBy(*keys))
    both = F.concat_ws("/", "mechanism", "name")
    sets = sets.withColumns({"same_name": alike("name"), "same_both": alike("mechanism", "name")}).select(
        "place", "dataset_no",
        F.when(F.col("same_both") > 1, F.concat_ws("#", both, F.col("dataset_no").cast("string"))).when(F.col("same_name") > 1, both).otherwise(F.col("name")).alias("dataset_id"),
    )
    where = offsets.join(sets, "place").select("file", "split", "before", "dataset_id", "dataset_no", "mechanism", source_group(F.col("name")).alias("source_group"))
    label = F.when(F.col("mechanism") == "MCAR", 0).when(F.col("mechanism") == "MAR", 1).when(F.col("mechanism") == "MNAR", 2)
    return rows.join(where, ["file", "split"]).select(
        "dataset_id", "dataset_no", "source_group", "mechanism", label.alias("label"), (F.col("at") + F.col("before")).cast("long").alias("row_id"), *_VALUES
    )


def include_datasets(df: DataFrame, listed: DataFrame) -> DataFrame:
    """Rows whose source_group is in the list (column value; '#' comments and blank lines do not count)."""
    names = listed.select(F.trim(F.regexp_replace("value", "#.*$", "")).alias("source_group")).where("source_group <> ''").distinct()
    return df.join(names, "source_group", "left_semi")


def resume_unprocessed(df: DataFrame, done: DataFrame, keys: tuple[str, ...] = ("mechanism", "dataset_id")) -> DataFrame:
    """Rows of datasets that earlier results lack."""
    return df.join(done.select(*keys).distinct(), list(keys), "left_anti")


def write_features(features: DataFrame, path: str) -> None:
    features.write.mode("overwrite").partitionBy("mechanism").parquet(path)


def merge_feature_parts(parts: list[DataFrame], columns: list[str]) -> DataFrame:
    """Partial feature tables as one, with gaps of the columns filled by overall medians."""
    from lacuna.operators.prepare import median_impute

    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return median_impute(out, columns)


def write_calibration(thresholds: DataFrame, points: DataFrame, path: str) -> None:
    thresholds.write.mode("overwrite").parquet(f"{path}/thresholds")
    points.write.mode("overwrite").parquet(f"{path}/points")


def read_calibration(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Thresholds and reference points; every class must be there."""
    thresholds, points = spark.read.parquet(f"{path}/thresholds"), spark.read.parquet(f"{path}/points")
    have = {r[0] for r in points.select("label").distinct().limit(10).collect()}
    if missing := set(MECHANISMS) - have:
        raise ValueError(f"calibration lacks {sorted(missing)}")
    return thresholds, points


__all__ = [
    "include_datasets", "materialize", "merge_feature_parts", "parse_dataset_name", "read_calibration", "read_datasets",
    "resume_unprocessed", "source_group", "write_calibration", "write_datasets", "write_features",
]
