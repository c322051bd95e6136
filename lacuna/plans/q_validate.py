"""Queries of the layered protocol (TS1, TS4, TS6-8, TS13, TS20, FT22) and of files, calibrations and streams (IO1, IO6, IO9)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lacuna.operators import diagnose as dg
from lacuna.operators import features as ft
from lacuna.operators import forest, nearest, patterns, prepare, simulate, validate
from lacuna.sources import io
from lacuna.sources.stage import derived, shared_dir
from lacuna.streaming.resume import process_new_files

from . import q_diagnose, q_prepare
from .q_features import MOM, complete, masked, rounded
from .q_features import QUERIES as QUERIES_OF_FEATURES
from .sqltests import LEVENE, LITTLE, LONG, MASK_MI
from .sqltext import P1_PLAIN, on_panel, r, simulated

QUERIES: dict = {}


def on_masked(name, fn, sql=None):
    QUERIES[name] = (lambda s, d: rounded(fn(masked(s, d))), on_panel(sql) if sql else None)


on_masked(
    "ts1_little_mcar", patterns.little_mcar,
    f", {MOM}, {LITTLE} SELECT dataset_id, {r('stat')} AS little_stat, CAST(4 AS BIGINT) AS little_df, {r('p')} AS little_p FROM little",
)
on_masked("ts4_pklm", forest.pklm)
on_masked("ts6_mask_auc_permutation", forest.mask_auc_permutation)
on_masked("ts7_mask_mutual_info", nearest.mask_mutual_info, f", {MOM}, {LONG}, {MASK_MI} SELECT dataset_id, {r('mi_max')} AS mi_max, {r('mi_mean')} AS mi_mean FROM mask_mi")
on_masked("ft22_auc_self_delta", forest.auc_self_delta)
on_masked("ts8_mnar_scores", validate.mnar_scores)
on_masked("ts20_boosted_tasks", lambda m: dg.mechdetect_rule(forest.boosted_tasks(m)))


def report(s, d):
    return derived(s, d, "report", lambda: validate.validate_datasets(masked(s, d)))


QUERIES["ts13_validate_datasets"] = (lambda s, d: rounded(report(s, d)), None)


# ---- files, calibrations, streams ---------------------------------------------------------------


def _fresh(s):
    return f"{shared_dir(s)}/lacuna-{s.sparkContext.applicationId}/{uuid.uuid4().hex}"


def _read(s, d, build, name):
    """A panel written as a tree of dataset files and read back."""
    path = _fresh(s)

    def read():
        io.write_datasets(build(s, d), path)
        return io.read_datasets(s, path)

    return derived(s, d, name, read)


def files(s, d):
    return _read(s, d, masked, "p1_files")


def complete_files(s, d):
    return _read(s, d, lambda s, d: complete(s, d).withColumn("mechanism", F.lit("MCAR")), "p1_complete_files")


_VALUES = [f"x{k}" for k in range(5)]
_NUMBERED = "dense_rank() OVER (ORDER BY mechanism, dataset_id)"
QUERIES["io1_read_datasets"] = (
    lambda s, d: rounded(files(s, d).groupBy("dataset_id", "dataset_no", "mechanism", "label").agg(
        F.count(F.lit(1)).alias("n"), F.count("x0").alias("n_observed"), F.max("row_id").alias("last_row"), F.count_distinct("row_id").alias("rows"),
        *[F.sum(F.col("row_id") * F.col(v)).alias(f"sum_{v}") for v in _VALUES]), 3),
    on_panel(f"""SELECT dataset_id, dataset_no, mechanism, label, count(*) AS n, count(x0) AS n_observed, max(row_id) AS last_row, count(DISTINCT row_id) AS rows,
  {', '.join(f'{r(f"sum(row_id * {v})", 3)} AS sum_{v}' for v in _VALUES)} FROM (SELECT * REPLACE ({_NUMBERED} AS dataset_no) FROM panel) GROUP BY ALL"""),
)
QUERIES["io1_mask_entropy"] = (lambda s, d: rounded(ft.mask_entropy(files(s, d))), QUERIES_OF_FEATURES["ft13_mask_entropy"][1])
QUERIES["io1_bootstrap_datasets"] = (
    lambda s, d: prepare.bootstrap_datasets(files(s, d)), q_prepare.bootstrap_sql(_NUMBERED),
)
QUERIES["io1_block_masking"] = (
    lambda s, d: simulate.simulate(complete_files(s, d), "mcar_block", 0.1, 42).select("dataset_id", "row_id", "x0"),
    f"WITH {P1_PLAIN}, numbered AS (SELECT * REPLACE (dense_rank() OVER (ORDER BY dataset_id) AS dataset_no) FROM p1), {simulated('numbered', 'masked', repr('mcar_block'), 'CAST(0.1 AS DOUBLE)', 42)} SELECT dataset_id, row_id, x0 FROM masked",
)
# the protocol on files as read; of its figures those that SQL can recompute
QUERIES["io1_validate_datasets"] = (
    lambda s, d: rounded(validate.validate_datasets(files(s, d), permutations=20).select("dataset_id", "missing_rate", "little_p", "levene_p", "caafe_kl_density"), 5),
    on_panel(f""", {MOM}, {LONG}, {LITTLE}, {LEVENE}, {q_diagnose.KL} SELECT dataset_id, mr.missing_rate, {r('little.p', 5)} AS little_p, {r('levene.p', 5)} AS levene_p, {r('kl', 5)} AS caafe_kl_density
  FROM (SELECT dataset_id, {r('avg(CASE WHEN x0 IS NULL THEN 1.0::DOUBLE ELSE 0.0 END)', 4)} AS missing_rate FROM panel GROUP BY dataset_id) mr JOIN little USING (dataset_id) LEFT JOIN levene USING (dataset_id) JOIN kld USING (dataset_id)"""),
)


def _stream(s, d):
    """Panels that arrive in two lots, each file worked on once: rows and gaps of every dataset, with the number of times it was met."""
    folder, out, checkpoint = _fresh(s), _fresh(s), _fresh(s)
    work = lambda df: df.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("x0").isNull()).alias("n_missing"))
    m = masked(s, d).select("dataset_id", "dataset_no", "row_id", "x0")
    for lot in (0, 1):
        m.where(F.col("dataset_no") % 2 == lot).write.mode("append").parquet(folder)
        process_new_files(s, folder, m.schema, work, out, checkpoint)
    process_new_files(s, folder, m.schema, work, out, checkpoint)  # nothing new: nothing happens
    return s.read.parquet(out).groupBy("dataset_id").agg(F.sum("n").alias("n"), F.sum("n_missing").alias("n_missing"), F.count_distinct("batch").alias("batches"))


QUERIES["io6_resume_stream"] = (_stream, on_panel("SELECT dataset_id, CAST(count(*) AS BIGINT) AS n, CAST(sum(mask) AS BIGINT) AS n_missing, CAST(1 AS BIGINT) AS batches FROM panel GROUP BY dataset_id"))


def _calibration(s, d):
    path = _fresh(s)
    io.write_calibration(dg.calibrate_thresholds(q_diagnose.scores(s, d)), dg.calibration(q_diagnose.points(s, d)), path)
    return io.read_calibration(s, path)


QUERIES["io9_calibration_thresholds"] = (lambda s, d: rounded(_calibration(s, d)[0]), q_diagnose.QUERIES["ts24_calibrate_thresholds"][1])
QUERIES["io9_calibration_points"] = (
    lambda s, d: _calibration(s, d)[1].groupBy("label").agg(F.count(F.lit(1)).alias("points")),
    f"WITH {q_diagnose.SCORES} SELECT true_label AS label, count(*) AS points FROM scores GROUP BY true_label",
)
