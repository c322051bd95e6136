"""Preparation of columns with missing values: selection, scaling, capping, hot-deck filling, resampling.

Every draw is a function of a seed and the row's number; rows drawn from a dataset are met by an
equality join on (dataset, place), never by copying a dataset.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lacuna.functions.rng import normal, row_number_sql, uniform
from lacuna.sources.panels import checked
from lacuna.sources.stage import materialize

from .ranks import placed

DS = ["dataset_id"]
PREDICTORS = ("x1", "x2", "x3", "x4")
_NUMBER = row_number_sql()


def select_panel(df: DataFrame, target: str, predictors: list[str], keys: list[str], number: str, seed: int = 1) -> DataFrame:
    """keys, x0 (the target) and x1..x4: up to four predictors, absent ones padded with uniform draws by ``number``."""
    cols = [F.col(target).cast("double").alias("x0")]
    for k in range(1, 5):
        cols.append((F.col(predictors[k - 1]).cast("double") if k <= len(predictors) else uniform(seed + k, number)).alias(f"x{k}"))
    return df.select(*keys, *cols)


def column_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, place, missing_rate, n_distinct of each column, from one aggregation."""
    made = []
    for c in columns:
        made += [F.avg(F.col(c).isNull().cast("double")).alias(f"m_{c}"), F.count_distinct(F.col(c)).alias(f"d_{c}")]
    wide = df.agg(*made)
    parts = [F.struct(F.lit(c).alias("column"), F.lit(i).alias("place"), F.col(f"m_{c}").alias("missing_rate"), F.col(f"d_{c}").alias("n_distinct")) for i, c in enumerate(columns)]
    return wide.select(F.explode(F.array(*parts)).alias("x")).select("x.*")


def auto_predictors(df: DataFrame, columns: list[str], count: int = 4) -> DataFrame:
    """The columns of the lowest missing rate (in their order where equal), with their rank."""
    p = column_profile(df, columns)
    return p.orderBy("missing_rate", "place").limit(count).select("column", "missing_rate", "n_distinct", F.row_number().over(W.orderBy("missing_rate", "place")).cast("long").alias("rank"))


def usable_predictors(df: DataFrame, columns: list[str], count: int = 4) -> DataFrame:
    """The first columns below 10 % missing with more than three values."""
    return column_profile(df, columns).where("missing_rate < 0.1 and n_distinct > 3").orderBy("place").limit(count)


def sentinel_to_null(df: DataFrame, column: str, sentinel: float = 0.0) -> DataFrame:
    return df.withColumn(column, F.nullif(F.col(column), F.lit(sentinel)))


def null_when(df: DataFrame, column: str, predicate: Column) -> DataFrame:
    return df.withColumn(column, F.when(~F.coalesce(predicate, F.lit(False)), F.col(column)))


def indicator(predicate: Column) -> Column:
    return F.coalesce(predicate, F.lit(False)).cast("double")


def drop_incomplete(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.dropna(subset=columns)


def coerce_numeric(column: Column) -> Column:
    """Numbers as doubles; '?' and other text as null."""
    return column.try_cast("double")


def minmax_scale(panel: DataFrame, columns: tuple[str, ...] = ("x0", *PREDICTORS)) -> DataFrame:
    """Each column to [0, 1] within its dataset; 0.5 where it is constant; nulls stay."""
    made = [f(c).alias(f"{n}_{c}") for c in columns for f, n in ((F.min, "lo"), (F.max, "hi"))]
    j = panel.join(panel.groupBy(*DS).agg(*made), DS)
    scaled = {}
    for c in columns:
        lo, hi, x = F.col(f"lo_{c}"), F.col(f"hi_{c}"), F.col(c)
        scaled[c] = F.when(hi - lo > 1e-12, (x - lo) / (hi - lo)).when(x.isNotNull(), 0.5)
    return j.withColumns(scaled).select(*panel.columns)


def hotdeck_impute(panel: DataFrame, column: str, seed: int = 3, only: Column | None = None) -> DataFrame:
    """Nulls of a column (those where ``only`` holds) become draws from the dataset's observed values."""
    donors = panel.where(F.col(column).isNotNull()).select(*DS, F.col(column).alias("donor"), (F.row_number().over(W.partitionBy(*DS).orderBy("row_id")) - 1).alias("place"))
    n = panel.groupBy(*DS).agg(F.count(column).alias("n_obs"))
    need = F.col(column).isNull() & (only if only is not None else F.lit(True)) & (F.col("n_obs") > 0)
    at = F.when(need, F.floor(uniform(seed, _NUMBER) * F.col("n_obs")))
    j = panel.join(n, DS).withColumn("place", at.cast("int"))
    j = j.join(donors, [*DS, "place"], "left")
    return j.withColumn(column, F.coalesce(column, "donor")).select(*panel.columns)


def cap_missing_rate(panel: DataFrame, target: float = 0.10, seed: int = 4) -> DataFrame:
    """Above the target rate a random max(1, int(target n)) of the nulls of x0 stay; the rest is filled by hot deck."""
    totals = panel.groupBy(*DS).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("x0").isNull()).alias("m"))
    rank = F.row_number().over(W.partitionBy(*DS).orderBy(uniform(seed, _NUMBER), "row_id"))
    nulls = panel.where(F.col("x0").isNull()).select(*DS, "row_id", rank.alias("rank")).join(totals, DS)
    keep = F.greatest(F.lit(1), F.floor(F.lit(target) * F.col("n")))
    fill = nulls.where((F.col("m") / F.col("n") > target) & (F.col("rank") > keep)).select(*DS, "row_id", F.lit(True).alias("fill"))
    marked = panel.join(fill, [*DS, "row_id"], "left")
    return hotdeck_impute(marked, "x0", seed + 1, F.coalesce("fill", F.lit(False))).select(*panel.columns)


def median_impute(panel: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """Nulls (and infinities) become the median of the column, within ``by`` or overall."""
    clean = panel.withColumns({c: F.when(F.abs(c) < float("inf"), F.col(c)) for c in columns})
    med = clean.groupBy(*(by or [])).agg(*[F.percentile(c, 0.5).alias(f"med_{c}") for c in columns])
    j = clean.join(med, by) if by else clean.join(F.broadcast(med))
    return j.withColumns({c: F.coalesce(c, f"med_{c}") for c in columns}).select(*panel.columns)


def jitter(panel: DataFrame, columns: list[str], scale: float = 0.02, seed: int = 8) -> DataFrame:
    """Normal noise on non-null values, clipped to [0, 1]."""
    noisy = {c: F.when(F.col(c).isNotNull(), F.least(F.greatest(F.col(c) + scale * normal(seed + i, _NUMBER), F.lit(0.0)), F.lit(1.0))) for i, c in enumerate(columns)}
    return panel.withColumns(noisy)


def prepare_dataset(panel: DataFrame, order: str = "jittered") -> DataFrame:
    """Two published orders: 'jittered' (predictors filled, cap, scale, jitter of x1) and 'filled' (datasets with gaps only: cap, scale, predictors filled)."""
    # each step reads its input more than once: written between, it is not made anew each time
    if order == "jittered":
        for i, c in enumerate(PREDICTORS):
            panel = materialize(hotdeck_impute(panel, c, 40 + i))
        return jitter(minmax_scale(materialize(cap_missing_rate(panel))), ["x1"])
    some = panel.where(F.col("x0").isNull()).select(*DS).distinct()
    panel = materialize(cap_missing_rate(materialize(panel.join(some, DS, "left_semi"))))
    panel = materialize(minmax_scale(panel))
    for i, c in enumerate(PREDICTORS):
        panel = materialize(hotdeck_impute(panel, c, 40 + i))
    return panel


def bootstrap_datasets(panel: DataFrame, resamples: int = 50, size: int = 100, least_rate: float = 0.01, seed: int = 13) -> DataFrame:
    """dataset_id, boot_id, draw, x0..x4: resamples with replacement of min(size, n) rows; those below the least missing rate go.

    Draws are exploded from one row for each dataset and meet the rows by (dataset, row_id), which must be 1, 2, ..., n (checked).
    """
    panel = checked(panel)
    n = panel.groupBy(*DS).agg(F.max("dataset_no").alias("dataset_no"), F.count(F.lit(1)).alias("n"))
    draws = n.withColumn("boot_id", F.explode(F.sequence(F.lit(1), F.lit(resamples)))).withColumn("draw", F.explode(F.sequence(F.lit(1), F.least(F.lit(size), F.col("n")).cast("int"))))
    number = f"dataset_no * 1000003 + boot_id * {size} + draw"
    draws = draws.withColumn("row_id", (1 + F.floor(uniform(seed, number) * F.col("n"))).cast("long"))
    rows = draws.select(*DS, "boot_id", "draw", "row_id").join(panel.select(*DS, "row_id", "x0", *PREDICTORS), [*DS, "row_id"])
    rate = F.avg(F.col("x0").isNull().cast("double")).over(W.partitionBy(*DS, "boot_id"))  # at most ``size`` rows
    return rows.withColumn("rate", rate).where(F.col("rate") >= least_rate).drop("rate", "row_id")


def sample_rows(df: DataFrame, n: int, number: str, seed: int = 14) -> DataFrame:
    """n rows without replacement, by the order of a draw."""
    return df.withColumn("u", uniform(seed, number)).orderBy("u", number).limit(n).drop("u")


def sample_datasets_per_class(datasets: DataFrame, n: int, seed: int = 15) -> DataFrame:
    """n datasets of each mechanism; datasets: one row each with dataset_no and mechanism."""
    u = uniform(seed, "dataset_no")
    ranked = placed(datasets.withColumn("class_draw", u), ["mechanism"], ["class_draw", "dataset_no"], "class_place")
    return ranked.where(F.col("class_place") <= n).select(*datasets.columns)


def dataset_summary(panel: DataFrame) -> DataFrame:
    """rows, percent of x0 missing, distinct x0, complete predictors of each dataset."""
    full = sum((F.when(F.count(c) == F.count(F.lit(1)), 1).otherwise(0) for c in PREDICTORS), start=F.lit(0))
    return panel.groupBy(*DS).agg(
        F.count(F.lit(1)).alias("rows"), (100 * F.avg(F.col("x0").isNull().cast("double"))).alias("pct_missing"), F.count_distinct("x0").alias("x0_distinct"), full.alias("complete_predictors")
    )


def dedupe_by_profile(profiles: DataFrame, columns: list[str]) -> DataFrame:
    """profiles with ``profile_hash`` and ``first_id``: the least dataset with the same profile."""
    h = profiles.withColumn("profile_hash", F.md5(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])))
    first = h.groupBy("profile_hash").agg(F.min("dataset_id").alias("first_id"))
    return h.join(first, "profile_hash")
