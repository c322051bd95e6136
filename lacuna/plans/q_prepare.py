"""Queries of sources (IO) and preparation (PR), with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from lacuna.functions.rng import normal_sql, row_number_sql, uniform_sql
from lacuna.operators import prepare as pr
from lacuna.operators import profiles as pf
from lacuna.operators import simulate as sim
from lacuna.sources import io, panels
from lacuna.sources.stage import derived

from .q_features import _PF1, CENTRED, MOM, complete, masked, rounded
from .sqltext import P1_PLAIN, on_panel, r, simulated

QUERIES: dict = {}
_N = row_number_sql()


def add(name, fn, sql):
    QUERIES[name] = (lambda s, d: rounded(fn(s, d)), sql)


# ---- names and files -----------------------------------------------------------------------------

_NAME = "CASE o_orderkey % 3 WHEN 0 THEN 'MCAR_uniform_seed' || o_custkey || '_mr' || (o_orderkey % 10 + 1) || '.txt' WHEN 1 THEN 'MAR_titanic_age_boot' || (o_orderkey % 50) || '.txt' ELSE 'MNAR_self_noisy.txt' END"


def names(s, d):
    return panels.read(s, d, "orders").select("o_orderkey", F.expr(_NAME).alias("name"))


_NAMES = f"names AS (SELECT o_orderkey, {_NAME} AS name FROM orders)"
add(
    "io2_parse_dataset_name", lambda s, d: names(s, d).select("o_orderkey", *[v.alias(k) for k, v in io.parse_dataset_name(F.col("name")).items()]),
    f"""WITH {_NAMES} SELECT o_orderkey, split_part(name, '_', 1) AS mechanism, CASE o_orderkey % 3 WHEN 0 THEN 'uniform' WHEN 1 THEN 'titanic_age' ELSE 'self_noisy' END AS variant_key,
  TRY_CAST(nullif(regexp_extract(name, 'seed(\\d+)', 1), '') AS INT) AS seed, TRY_CAST(nullif(regexp_extract(name, 'mr(\\d+)', 1), '') AS INT) AS missing_rate, TRY_CAST(nullif(regexp_extract(name, 'boot(\\d+)', 1), '') AS INT) AS boot_id FROM names""",
)
add("io3_source_group", lambda s, d: names(s, d).select("o_orderkey", io.source_group(F.col("name")).alias("source_group")), f"WITH {_NAMES} SELECT o_orderkey, regexp_replace(regexp_replace(name, '_boot\\d+\\.txt$', ''), '\\.txt$', '') AS source_group FROM names")
_RAW = "CASE o_orderkey % 5 WHEN 0 THEN '?' WHEN 1 THEN 'n/a' ELSE CAST(o_custkey AS VARCHAR(20)) END"
add(
    "io4_coerce_numeric", lambda s, d: panels.read(s, d, "orders").select("o_orderkey", pr.coerce_numeric(F.expr(_RAW)).alias("value")),
    f"SELECT o_orderkey, TRY_CAST({_RAW} AS DOUBLE) AS value FROM orders",
)
add(
    "io5_include_datasets",
    lambda s, d: io.include_datasets(complete(s, d), panels.read(s, d, "supplier").where("s_suppkey % 20 < 7").select(F.concat(F.lit("g"), (F.col("s_suppkey") % 20).cast("string"), F.lit(" # kept")).alias("value"))).groupBy("source_group").agg(F.count(F.lit(1)).alias("n")),
    f"WITH {P1_PLAIN} SELECT source_group, count(*) AS n FROM p1 WHERE dataset_no % 20 IN (SELECT s_suppkey % 20 FROM supplier WHERE s_suppkey % 20 < 7) GROUP BY source_group",
)
add(
    "io6_resume_unprocessed", lambda s, d: io.resume_unprocessed(masked(s, d).groupBy("mechanism", "dataset_id").agg(F.count(F.lit(1)).alias("n")), masked(s, d).where("dataset_no % 3 = 0").select("mechanism", "dataset_id")),
    on_panel("SELECT mechanism, dataset_id, count(*) AS n FROM panel WHERE dataset_no % 3 <> 0 GROUP BY mechanism, dataset_id"),
)


def _parts(s, d):
    m = masked(s, d).groupBy("dataset_id").agg(F.max("dataset_no").alias("no"), F.avg("x0").alias("a"), F.avg("x1").alias("b"))
    return [m.where("no % 2 = 0").select("dataset_id", "a", "b"), m.where("no % 2 = 1").select("dataset_id", "a")]


add(
    "io8_merge_feature_parts", lambda s, d: io.merge_feature_parts(_parts(s, d), ["a", "b"]),
    on_panel(f", m AS (SELECT dataset_id, any_value(dataset_no) AS no, avg(x0) AS a, avg(x1) AS b FROM panel GROUP BY dataset_id), u AS (SELECT dataset_id, a, CASE WHEN no % 2 = 0 THEN b END AS b FROM m) SELECT dataset_id, {r('coalesce(a, (SELECT median(a) FROM u))')} AS a, {r('coalesce(b, (SELECT median(b) FROM u))')} AS b FROM u"),
)


def _round_trip(s, d):
    """Features written by mechanism, read back."""
    from lacuna.operators.features import moments
    from lacuna.sources.stage import shared_dir

    m = masked(s, d)
    path = f"{shared_dir(s)}/lacuna-features-{s.sparkContext.applicationId}-{abs(hash(d))}"
    io.write_features(moments(m).join(m.select("dataset_id", "mechanism").distinct(), "dataset_id"), path)
    return s.read.parquet(path).select("dataset_id", "mechanism", "X0_missing_rate")


add("io7_write_features", _round_trip, on_panel(f"SELECT dataset_id, any_value(mechanism) AS mechanism, {r('avg(mask)')} AS \"X0_missing_rate\" FROM panel GROUP BY dataset_id"))

# ---- preparation -----------------------------------------------------------------------------------

add(
    "pr1_select_panel", lambda s, d: pr.select_panel(panels.read(s, d, "orders"), "o_totalprice", ["o_custkey"], ["o_orderkey"], "o_orderkey"),
    f"SELECT o_orderkey, {r('o_totalprice')} AS x0, {r('CAST(o_custkey AS DOUBLE)')} AS x1, {', '.join(f'{r(uniform_sql(1 + k, 'o_orderkey'))} AS x{k}' for k in (2, 3, 4))} FROM orders",
)
_GAPS = {"a": ("o_totalprice", 7), "b": ("o_custkey", 3), "c": ("o_orderkey", 11), "e": ("o_custkey % 3", 13), "f": ("o_totalprice * 2", 5)}
_GAP_SQL = ", ".join(f"CASE WHEN o_orderkey % {m} <> 0 THEN CAST({e} AS DOUBLE) END AS {k}" for k, (e, m) in _GAPS.items())


def gaps(s, d):
    return panels.read(s, d, "orders").selectExpr("o_orderkey", *[x for x in (f"CASE WHEN o_orderkey % {m} <> 0 THEN CAST({e} AS DOUBLE) END AS {k}" for k, (e, m) in _GAPS.items())])


_G = f"gaps AS (SELECT o_orderkey, {_GAP_SQL} FROM orders), prof AS (" + " UNION ALL ".join(f"SELECT '{k}' AS col, {i} AS place, avg(CASE WHEN {k} IS NULL THEN 1.0::DOUBLE ELSE 0.0 END) AS mr, count(DISTINCT {k}) AS nd FROM gaps" for i, k in enumerate(_GAPS)) + ")"
add("pr2_auto_predictors", lambda s, d: pr.auto_predictors(gaps(s, d), list(_GAPS)), f'WITH {_G} SELECT col AS "column", {r("mr")} AS missing_rate, nd AS n_distinct, row_number() OVER (ORDER BY mr, place) AS rank FROM prof ORDER BY mr, place LIMIT 4')
add("pr2_usable_predictors", lambda s, d: pr.usable_predictors(gaps(s, d), list(_GAPS)), f'WITH {_G} SELECT col AS "column", place, {r("mr")} AS missing_rate, nd AS n_distinct FROM prof WHERE mr < 0.1 AND nd > 3 ORDER BY place LIMIT 4')
add("pr3_sentinel_to_null", lambda s, d: pr.sentinel_to_null(panels.read(s, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_discount"), "l_discount"), f"SELECT l_orderkey, l_partkey, l_suppkey, {r('nullif(l_discount, 0)')} AS l_discount FROM lineitem")
add(
    "pr4_null_when", lambda s, d: pr.null_when(panels.read(s, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus", pr.indicator(F.col("o_orderstatus") == "O").alias("is_open")), "o_totalprice", F.col("o_orderstatus") == "F"),
    f"SELECT o_orderkey, CASE WHEN o_orderstatus <> 'F' THEN {r('o_totalprice')} END AS o_totalprice, o_orderstatus, CASE WHEN o_orderstatus = 'O' THEN 1.0::DOUBLE ELSE 0.0 END AS is_open FROM orders",
)
add("pr5_drop_incomplete", lambda s, d: pr.drop_incomplete(gaps(s, d), ["a", "b"]).select("o_orderkey", "a", "b"), f"WITH {_G} SELECT o_orderkey, {r('a')} AS a, {r('b')} AS b FROM gaps WHERE a IS NOT NULL AND b IS NOT NULL")


def gappy(s, d):
    """The panel with a fifth of x0 and a seventh of x1 gone."""

    def build():
        m = sim.simulate(complete(s, d), "mcar_uniform", 0.2, 77)
        return m.withColumn("x1", F.when(F.col("row_id") % 7 != 0, F.col("x1")))

    return derived(s, d, "gappy", build)


GAPPY = f"{P1_PLAIN}, {simulated('p1', 'g0', repr('mcar_uniform'), 'CAST(0.2 AS DOUBLE)', 77)}, gappy AS (SELECT * REPLACE (CASE WHEN row_id % 7 <> 0 THEN x1 END AS x1) FROM g0)"


def scaled_cte(source: str, out: str) -> str:
    s = ", ".join(f"CASE WHEN max({c}) OVER w - min({c}) OVER w > 1e-12 THEN ({c} - min({c}) OVER w) / (max({c}) OVER w - min({c}) OVER w) WHEN {c} IS NOT NULL THEN 0.5 END AS {c}" for c in ("x0", "x1", "x2", "x3", "x4"))
    return f"{out} AS (SELECT dataset_id, dataset_no, row_id, {s} FROM {source} WINDOW w AS (PARTITION BY dataset_id))"


def deck_cte(source: str, out: str, column: str, seed: int, only: str = "true") -> str:
    return f"""{out}_d AS (SELECT dataset_id, {column} AS donor, row_number() OVER (PARTITION BY dataset_id ORDER BY row_id) - 1 AS place FROM {source} WHERE {column} IS NOT NULL),
  {out}_n AS (SELECT dataset_id, count({column}) AS n_obs FROM {source} GROUP BY dataset_id),
  {out} AS (SELECT s.* REPLACE (coalesce(s.{column}, q.donor) AS {column}) FROM {source} s JOIN {out}_n USING (dataset_id)
    LEFT JOIN {out}_d q ON q.dataset_id = s.dataset_id AND s.{column} IS NULL AND {only} AND q.place = CAST(floor({uniform_sql(seed, _N)} * n_obs) AS BIGINT))"""


def cap_cte(source: str, out: str, seed: int = 4) -> str:
    ranked = f"SELECT *, count(*) OVER (PARTITION BY dataset_id) AS n, count(*) FILTER (x0 IS NULL) OVER (PARTITION BY dataset_id) AS m, row_number() OVER (PARTITION BY dataset_id, x0 IS NULL ORDER BY {uniform_sql(seed, _N)}, row_id) AS rk FROM {source}"
    return f"{out}_r AS (SELECT * EXCLUDE (n, m, rk), m / CAST(n AS DOUBLE) > 0.1 AND x0 IS NULL AND rk > greatest(1, floor(0.1 * n)) AS fill FROM ({ranked})), {deck_cte(f'{out}_r', f'{out}_f', 'x0', seed + 1, 's.fill')}, {out} AS (SELECT * EXCLUDE (fill) FROM {out}_f)"


_X = ", ".join(f"{r(c)} AS {c}" for c in ("x0", "x1", "x2", "x3", "x4"))
_ids = lambda df: df.select("dataset_id", "row_id", "x0", "x1", "x2", "x3", "x4")
add("pr6_minmax_scale", lambda s, d: _ids(pr.minmax_scale(gappy(s, d))), f"WITH {GAPPY}, {scaled_cte('gappy', 'sc')} SELECT dataset_id, row_id, {_X} FROM sc")
add("pr7_hotdeck_impute", lambda s, d: _ids(pr.hotdeck_impute(gappy(s, d), "x1")), f"WITH {GAPPY}, {deck_cte('gappy', 'hd', 'x1', 3)} SELECT dataset_id, row_id, {_X} FROM hd")
add("pr8_cap_missing_rate", lambda s, d: _ids(pr.cap_missing_rate(gappy(s, d))), f"WITH {GAPPY}, {cap_cte('gappy', 'cp')} SELECT dataset_id, row_id, {_X} FROM cp")
add("pr9_median_impute", lambda s, d: _ids(pr.median_impute(gappy(s, d), ["x0", "x1"], ["dataset_id"])), f"WITH {GAPPY}, md AS (SELECT * REPLACE (coalesce(x0, median(x0) OVER w) AS x0, coalesce(x1, median(x1) OVER w) AS x1) FROM gappy WINDOW w AS (PARTITION BY dataset_id)) SELECT dataset_id, row_id, {_X} FROM md")
_JIT = lambda c, k: f"CASE WHEN {c} IS NOT NULL THEN least(greatest({c} + 0.02 * {normal_sql(8 + k, _N)}, 0.0), 1.0) END AS {c}"
add("pr10_jitter", lambda s, d: _ids(pr.jitter(pr.minmax_scale(gappy(s, d)), ["x1", "x2"])), f"WITH {GAPPY}, {scaled_cte('gappy', 'sc')}, jt AS (SELECT * REPLACE ({_JIT('x1', 0)}, {_JIT('x2', 1)}) FROM sc) SELECT dataset_id, row_id, {_X} FROM jt")
add(
    "pr11_prepare_dataset", lambda s, d: _ids(pr.prepare_dataset(gappy(s, d))),
    f"WITH {GAPPY}, {deck_cte('gappy', 'h1', 'x1', 40)}, {cap_cte('h1', 'cp')}, {scaled_cte('cp', 'sc')}, jt AS (SELECT * REPLACE ({_JIT('x1', 0)}) FROM sc) SELECT dataset_id, row_id, {_X} FROM jt",
)
add(
    "pr11_prepare_dataset_filled", lambda s, d: _ids(pr.prepare_dataset(gappy(s, d), "filled")),
    f"WITH {GAPPY}, {cap_cte('gappy', 'cp')}, {scaled_cte('cp', 'sc')}, {deck_cte('sc', 'h1', 'x1', 40)} SELECT dataset_id, row_id, {_X} FROM h1",
)
_B = "dr.dataset_no * 1000003 + boot_id * 100 + draw"


def bootstrap_sql(number: str = "dataset_no") -> str:
    """The resamples of the masked panel, its datasets numbered in the given way."""
    return on_panel(f""", nn AS (SELECT dataset_id, any_value(dataset_no) AS dataset_no, count(*) AS n FROM (SELECT * REPLACE ({number} AS dataset_no) FROM panel) GROUP BY dataset_id),
  b AS (SELECT *, unnest(range(1, 51)) AS boot_id FROM nn), dr AS (SELECT *, unnest(range(1, least(100, n) + 1)) AS draw FROM b),
  j AS (SELECT dr.dataset_id, CAST(boot_id AS INT) AS boot_id, CAST(draw AS INT) AS draw, x0, x1, x2, x3, x4, avg(CASE WHEN x0 IS NULL THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY dr.dataset_id, boot_id) AS rate
    FROM dr JOIN panel p ON p.dataset_id = dr.dataset_id AND p.row_id = 1 + CAST(floor({uniform_sql(13, _B)} * n) AS BIGINT))
  SELECT dataset_id, boot_id, draw, {_X} FROM j WHERE rate >= 0.01""")


add("pr12_bootstrap_datasets", lambda s, d: pr.bootstrap_datasets(masked(s, d)), bootstrap_sql())
add("pr13_sample_rows", lambda s, d: pr.sample_rows(panels.read(s, d, "orders").select("o_orderkey", "o_custkey"), 500, "o_orderkey"), f"SELECT o_orderkey, o_custkey FROM orders ORDER BY {uniform_sql(14, 'o_orderkey')}, o_orderkey LIMIT 500")
add(
    "pr14_sample_datasets_per_class", lambda s, d: pr.sample_datasets_per_class(masked(s, d).select("dataset_id", "dataset_no", "mechanism").distinct(), 10),
    on_panel(f"SELECT dataset_id, dataset_no, mechanism FROM (SELECT *, row_number() OVER (PARTITION BY mechanism ORDER BY {uniform_sql(15, 'dataset_no')}, dataset_no) AS k FROM (SELECT DISTINCT dataset_id, dataset_no, mechanism FROM panel)) WHERE k <= 10"),
)
add(
    "pr15_dataset_summary", lambda s, d: pr.dataset_summary(gappy(s, d)),
    f"WITH {GAPPY} SELECT dataset_id, count(*) AS rows, {r('100 * avg(CASE WHEN x0 IS NULL THEN 1.0::DOUBLE ELSE 0.0 END)')} AS pct_missing, count(DISTINCT x0) AS x0_distinct, "
    + " + ".join(f"CASE WHEN count(x{k}) = count(*) THEN 1 ELSE 0 END" for k in range(1, 5)) + " AS complete_predictors FROM gappy GROUP BY dataset_id",
)
add(
    "pr16_dedupe_by_profile",
    lambda s, d: pr.dedupe_by_profile(masked(s, d).groupBy("dataset_id").agg(F.count_if(F.col("x0").isNull()).alias("m")), ["m"]),
    on_panel(", c AS (SELECT dataset_id, count(*) FILTER (x0 IS NULL) AS m FROM panel GROUP BY dataset_id) SELECT dataset_id, m, md5(CAST(m AS VARCHAR)) AS profile_hash, min(dataset_id) OVER (PARTITION BY m) AS first_id FROM c"),
)
add(
    "pf1_preferred_profile",
    lambda s, d: pf.preferred(pf.x0_stats(masked(s, d).where("dataset_no % 4 <> 0")), pf.x0_stats(masked(s, d))),
    on_panel(f", {MOM}{CENTRED} SELECT dataset_id, {_PF1}, CASE WHEN any_value(dataset_no) % 4 <> 0 THEN 'raw' ELSE 'scaled' END AS origin FROM c GROUP BY dataset_id HAVING count(x0) >= 2"),
)
