"""Queries of simulation (SIM), features (FT) and profiles (PF) with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from lacuna.functions.rng import normal_sql, row_number_sql, uniform_sql
from lacuna.operators import features as ft
from lacuna.operators import profiles as pf
from lacuna.operators import residuals as rs
from lacuna.operators import simulate as sim
from lacuna.operators.kernels import zero_safe
from lacuna.sources import panels
from lacuna.sources.stage import derived

from .sqltests import least_squares
from .sqltext import P1_CORRELATED, P1_PLAIN, P2, on_panel, r, simulated

QUERIES: dict = {}
_NUM = row_number_sql()


def rounded(df, digits: int = 6):
    """Doubles rounded for comparison."""
    return df.select(*[zero_safe(F.col(c), digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def complete(spark, sf_dir):
    """The line items' panel, without gaps."""
    return derived(spark, sf_dir, "p1", lambda: panels.lineitem_panel(spark, sf_dir))


def masked(spark, sf_dir):
    """The same with every dataset masked in its way, and its label."""
    return derived(spark, sf_dir, "p1_masked", lambda: sim.generate_benchmark(complete(spark, sf_dir)))


def on_masked(name: str, fn, sql: str) -> None:
    QUERIES[name] = (lambda s, d: rounded(fn(masked(s, d))), on_panel(sql))


# ---- simulation ----------------------------------------------------------------------------

for _i, _way in enumerate(sim.VARIANTS):
    QUERIES[f"sim{_i + 2}_{_way}"] = (
        lambda s, d, w=_way: sim.simulate(complete(s, d), w, 0.1, 42).select("dataset_id", "row_id", "x0"),
        f"WITH {P1_PLAIN}, {simulated('p1', 'masked', repr(_way), 'CAST(0.1 AS DOUBLE)', 42)} SELECT dataset_id, row_id, x0 FROM masked",
    )
QUERIES["sim14_generate_benchmark"] = (
    lambda s, d: masked(s, d).select("dataset_id", "row_id", "x0", "variant", "mechanism", "label"),
    on_panel("SELECT dataset_id, row_id, x0, variant, mechanism, label FROM panel"),
)

_B = lambda k, s: f"""CASE WHEN dataset_no % 4 = 0 THEN {uniform_sql(s, _NUM)} WHEN dataset_no % 4 = 1 THEN least(greatest(0.5 + 0.15 * {normal_sql(s, _NUM)}, 0.0), 1.0)
    WHEN dataset_no % 4 = 2 THEN least(greatest(-0.3 * ln(1 - {uniform_sql(s, _NUM)}), 0.0), 1.0) ELSE list_sort([{', '.join(uniform_sql(s + 200 + j, _NUM) for j in range(6))}])[2] END"""  # noqa: E731
QUERIES["sim1_base_panel"] = (
    lambda s, d: rounded(sim.base_values(complete(s, d)).select("dataset_id", "row_id", *[f"x{k}" for k in range(5)])),
    f"WITH {P1_PLAIN} SELECT dataset_id, row_id, {', '.join(f'{r(_B(k, 42 + 31 * k))} AS x{k}' for k in range(5))} FROM p1",
)

# ---- features ------------------------------------------------------------------------------

MOM = """d AS (SELECT *, coalesce(x0, median(x0) OVER (PARTITION BY dataset_id)) AS x0f FROM panel)"""
SKEW = lambda x: f"(avg(power({x}, 3)) - 3 * avg({x}) * avg(power({x}, 2)) + 2 * power(avg({x}), 3)) / power(stddev_pop({x}), 3)"
# central moments need a second look at the mean to stay exact
CENTRED = """, c AS (SELECT *, x0 - avg(x0) OVER w AS co, x0f - avg(x0f) OVER w AS cf FROM d WINDOW w AS (PARTITION BY dataset_id))"""
_SK = lambda x: f"avg(power({x}, 3)) / power(avg({x} * {x}), 1.5)"
_SH = lambda x: f"(avg(CASE WHEN mask = 1 THEN {x} END) - avg(CASE WHEN mask = 0 THEN {x} END))"
on_masked(
    "ft1_4_8_15_24_moments", ft.moments,
    f""", {MOM}{CENTRED} SELECT dataset_id, {r('avg(mask)')} AS "X0_missing_rate", {r('avg(x0) / avg(x0f)')} AS "X0_obs_vs_full_ratio",
  {r('(quantile_cont(x0, 0.75) - quantile_cont(x0, 0.25)) / (quantile_cont(x0f, 0.75) - quantile_cont(x0f, 0.25))')} AS "X0_iqr_ratio",
  {r(f"{_SK('co')} - {_SK('cf')}")} AS "X0_obs_skew_diff", {r(_SH('x1'))} AS "X1_mean_diff",
  {r('(' + ' + '.join(f'abs({_SH(x)})' for x in ft.PREDICTORS) + ') / 4')} AS "X0_mean_shift_X1_to_X4",
  {r('avg(power(co, 4)) / power(avg(co * co), 2) - 3')} AS caafe_kurtosis_excess FROM c GROUP BY dataset_id""",
)
_LONG = """long AS (SELECT dataset_id, mask, 'x1' AS var, x1 AS value FROM d UNION ALL SELECT dataset_id, mask, 'x2', x2 FROM d
  UNION ALL SELECT dataset_id, mask, 'x3', x3 FROM d UNION ALL SELECT dataset_id, mask, 'x4', x4 FROM d)"""


def _ks(source: str, by: str, value: str, a: str, b: str) -> str:
    """CTE ``k``: by, ks, na, nb."""
    return f"""k AS (SELECT {by}, max(abs(ca / na - cb / nb)) AS ks, max(na) AS na, max(nb) AS nb FROM (
  SELECT {by}, sum(a) OVER w AS ca, sum(b) OVER w AS cb, CAST(sum(a) OVER (PARTITION BY {by}) AS DOUBLE) AS na, CAST(sum(b) OVER (PARTITION BY {by}) AS DOUBLE) AS nb
  FROM (SELECT {by}, {value} AS v, sum({a}) AS a, sum({b}) AS b FROM {source} GROUP BY {by}, {value}) WINDOW w AS (PARTITION BY {by} ORDER BY v)) GROUP BY {by})"""


on_masked(
    "ft10_little_proxy_score", ft.little_proxy_score,
    f", {MOM}, {_LONG}, {_ks('long', 'dataset_id, var', 'value', 'mask', '1 - mask')} SELECT dataset_id, {r('sum(ks) / 4')} AS little_proxy_score FROM k GROUP BY dataset_id",
)
on_masked(
    "ft11_ks_obs_vs_imputed", ft.ks_obs_vs_imputed,
    f", {MOM}, {_ks('d', 'dataset_id', 'x0f', '1 - mask', '1')} SELECT dataset_id, {r('ks')} AS \"X0_ks_obs_vs_imputed\" FROM k",
)
on_masked(
    "ft12_tail_missing_ratio", ft.tail_missing_ratio,
    f""", {MOM}, q AS (SELECT dataset_id, quantile_cont(x0f, 0.25) AS a, quantile_cont(x0f, 0.5) AS b, quantile_cont(x0f, 0.75) AS c FROM d GROUP BY dataset_id),
  t AS (SELECT dataset_id, avg(CASE WHEN x0f >= a AND x0f < b THEN mask END) AS r2, avg(CASE WHEN x0f >= c THEN mask END) AS r4 FROM d JOIN q USING (dataset_id) GROUP BY dataset_id)
  SELECT dataset_id, {r('CASE WHEN r2 > 1e-10 THEN r4 / r2 WHEN r2 IS NOT NULL AND r4 > 0 THEN r4 * 10 ELSE 1.0 END')} AS "X0_tail_missing_ratio" FROM t""",
)
RUNS = """s AS (SELECT dataset_id, row_id, mask, CASE WHEN lag(mask) OVER w = mask THEN 0 ELSE 1 END AS new FROM {source} WINDOW w AS (PARTITION BY dataset_id ORDER BY row_id)),
  g AS (SELECT *, sum(new) OVER (PARTITION BY dataset_id ORDER BY row_id) AS run FROM s),
  runs AS (SELECT dataset_id, run, any_value(mask) AS mask, count(*) AS len FROM g GROUP BY dataset_id, run)"""
on_masked(
    "ft13_mask_entropy", ft.mask_entropy,
    f""", {RUNS.format(source='panel')}, n AS (SELECT *, len / CAST(sum(len) OVER (PARTITION BY dataset_id) AS DOUBLE) AS p FROM runs)
  SELECT dataset_id, {r('sum(-p * log2(p + 1e-10))')} AS mask_entropy FROM n GROUP BY dataset_id""",
)
on_masked(
    "ft14_censoring_score", ft.censoring_score,
    f""", {MOM}, k AS (SELECT dataset_id, mask, rank() OVER (PARTITION BY dataset_id ORDER BY x0f) + (count(*) OVER (PARTITION BY dataset_id, x0f) - 1) / 2.0 AS rk FROM d)
  SELECT dataset_id, {r('abs(corr(rk, mask))')} AS "X0_censoring_score" FROM k GROUP BY dataset_id""",
)
on_masked(
    "ft23_kl_density", ft.kl_density,
    f""", {MOM}, e AS (SELECT *, min(x0f) OVER w AS lo, max(x0f) OVER w AS hi, sum(mask) OVER w AS m, sum(1 - mask) OVER w AS o FROM d WINDOW w AS (PARTITION BY dataset_id)),
  b AS (SELECT *, CAST(least(floor((x0f - lo) / (hi + 1e-10 - lo) * 20), 19) AS INT) AS bin FROM e),
  grid AS (SELECT dataset_id, bin, any_value(m) AS m, any_value(o) AS o FROM (SELECT DISTINCT dataset_id, m, o FROM b), (SELECT unnest(range(20)) AS bin) GROUP BY dataset_id, bin),
  h AS (SELECT g.dataset_id, (coalesce(c.hm, 0) + 1e-10) / (g.m + 2e-9) AS pm, (coalesce(c.ho, 0) + 1e-10) / (g.o + 2e-9) AS po, g.m, g.o FROM grid g
    LEFT JOIN (SELECT dataset_id, bin, sum(mask) AS hm, sum(1 - mask) AS ho FROM b GROUP BY dataset_id, bin) c USING (dataset_id, bin))
  SELECT dataset_id, {r('CASE WHEN min(m) < 5 OR min(o) < 5 THEN 0.0 ELSE sum(po * ln(po / pm)) END')} AS caafe_kl_density FROM h GROUP BY dataset_id""",
)
_H = lambda p: f"CASE WHEN {p} > 0 AND {p} < 1 THEN -{p} * log2({p}) - (1 - {p}) * log2(1 - {p}) ELSE 0.0 END"
on_masked(
    "ft25_cond_entropy", ft.cond_entropy,
    f""", {MOM}, e AS (SELECT dataset_id, min(x0f) AS lo, max(x0f) AS hi, least(5, count(DISTINCT x0f)) AS bins, count(*) AS n, avg(mask) AS p FROM d GROUP BY dataset_id),
  b AS (SELECT dataset_id, n, p, CASE WHEN hi > lo THEN least(floor((x0f - lo) / (hi - lo) * bins), bins - 1) ELSE 0 END AS bin, count(*) AS k, avg(mask) AS pb FROM d JOIN e USING (dataset_id) GROUP BY ALL),
  s AS (SELECT dataset_id, n, p, sum(k / CAST(n AS DOUBLE) * {_H('pb')}) AS rest FROM b GROUP BY ALL)
  SELECT dataset_id, {r(f"CASE WHEN n > 10 AND {_H('p')} > 1e-10 THEN ({_H('p')} - rest) / ({_H('p')}) ELSE 0.0 END")} AS "caafe_cond_entropy_X0_mask" FROM s""",
)
on_masked(
    "ft31_32_density_ratio", ft.density_ratio,
    f""", {MOM}, s AS (SELECT dataset_id, quantile_cont(x0, [0.05, 0.15, 0.25, 0.35, 0.45, 0.55, 0.65, 0.75, 0.85, 0.95]) AS pts, count(x0) AS no, count(*) AS nf,
    stddev_samp(x0) * power(count(x0), -0.2) AS bo, stddev_samp(x0f) * power(count(*), -0.2) AS bf, sum(mask) AS m FROM d GROUP BY dataset_id),
  pts_ AS (SELECT dataset_id, no, nf, bo, bf, unnest(range(1, 11)) AS k, unnest(pts) AS pt FROM s WHERE m >= 10 AND no >= 10 AND len(list_distinct(pts)) >= 3),
  q AS (SELECT dataset_id, k, 0.3989422804014327 * sum(exp(-power((pt - x0) / bo, 2) / 2) / bo) / any_value(no) AS do_, 0.3989422804014327 * sum(exp(-power((pt - x0f) / bf, 2) / 2) / bf) / any_value(nf) AS df FROM pts_ JOIN d USING (dataset_id) GROUP BY dataset_id, k),
  t AS (SELECT dataset_id, k, do_ / greatest(df, 1e-10) AS rr FROM q),
  u AS (SELECT dataset_id, max(rr) - min(rr) AS ra, arg_max(rr, k) AS top, arg_min(rr, k) AS low FROM t GROUP BY dataset_id)
  SELECT s.dataset_id, {r('coalesce(least(ra, 10.0), 0.0)')} AS adv_density_ratio_range, {r('coalesce(least(greatest(top / greatest(low, 1e-10), 0.01), 100.0), 1.0)')} AS adv_density_ratio_tail_asym
  FROM s LEFT JOIN u USING (dataset_id)""",
)

QUERIES["ft29_30_residual_dependence"] = (
    lambda s, d: rounded(rs.residual_dependence(masked(s, d)), 4),
    on_panel(f""", {MOM}, {least_squares('ls', 'd', {'x': 'x0f', 'm': 'mask'})},
  re AS (SELECT d.dataset_id, mask, round(x0f - (base_x + x1 * b1_x + x2 * b2_x + x3 * b3_x + x4 * b4_x), 6) AS a, round(mask - (base_m + x1 * b1_m + x2 * b2_m + x3 * b3_m + x4 * b4_m), 9) AS b FROM d JOIN ls USING (dataset_id)),
  rr AS (SELECT *, rank() OVER (PARTITION BY dataset_id ORDER BY a) + (count(*) OVER (PARTITION BY dataset_id, a) - 1) / 2.0::DOUBLE AS ra, rank() OVER (PARTITION BY dataset_id ORDER BY b) + (count(*) OVER (PARTITION BY dataset_id, b) - 1) / 2.0::DOUBLE AS rb FROM re)
  , pr AS (SELECT p.dataset_id, p.row AS i, abs(p.a - q.a) AS x, abs(p.b - q.b) AS y FROM (SELECT *, row_number() OVER () AS row FROM re) p JOIN re q USING (dataset_id)),
  ps AS (SELECT dataset_id, i, sum(x) AS sx, sum(y) AS sy, sum(x * y) AS sxy, sum(x * x) AS sxx, sum(y * y) AS syy, CAST(count(*) AS DOUBLE) AS n FROM pr GROUP BY dataset_id, i),
  pd AS (SELECT dataset_id, sum(sxy) / any_value(n * n) + sum(sx) * sum(sy) / any_value(n * n * n * n) - 2 * sum(sx * sy) / any_value(n * n * n) AS cov,
    sum(sxx) / any_value(n * n) + sum(sx) * sum(sx) / any_value(n * n * n * n) - 2 * sum(sx * sx) / any_value(n * n * n) AS va, sum(syy) / any_value(n * n) + sum(sy) * sum(sy) / any_value(n * n * n * n) - 2 * sum(sy * sy) / any_value(n * n * n) AS vb FROM ps GROUP BY dataset_id),
  cs AS (SELECT dataset_id, count(*) >= 20 AND sum(mask) >= 5 AS ok, abs(corr(a, b)) AS pearson, abs(corr(ra, rb)) AS spearman FROM rr GROUP BY dataset_id)
  SELECT dataset_id, {r('CASE WHEN ok THEN sqrt(greatest(cov, 0.0) / sqrt(va * vb)) ELSE 0.0 END', 4)} AS "adv_partial_dcor_X0_mask", {r('CASE WHEN ok THEN spearman ELSE 0.0 END', 4)} AS "adv_residual_spearman_X0_mask",
    {r('CASE WHEN ok THEN pearson ELSE 0.0 END', 4)} AS "adv_residual_pearson_X0_mask" FROM cs JOIN pd USING (dataset_id)"""),
)
QUERIES["ft26_28_imputation_divergence"] = (lambda s, d: rounded(rs.imputation_divergence(correlated(s, d))), None)
_CORRELATED = f"WITH {P1_CORRELATED}, {simulated('p1', 'masked', repr('mnar_self_logistic'), 'CAST(0.2 AS DOUBLE)', 9)}, panel AS (SELECT *, CASE WHEN x0 IS NULL THEN 1 ELSE 0 END AS mask FROM masked)"


def correlated(spark, sf_dir):
    """The panel whose X0 follows a predictor, a fifth of it missing by its own value."""
    return derived(spark, sf_dir, "p1c_masked", lambda: sim.simulate(panels.lineitem_panel(spark, sf_dir, correlated=True), "mnar_self_logistic", 0.2, 9))


QUERIES["pf6_regression_quartile_rates"] = (
    lambda s, d: rounded(rs.regression_quartile_rates(correlated(s, d)), 4),
    f"""{_CORRELATED}, {MOM}, ob AS (SELECT * FROM d WHERE x0 IS NOT NULL), {least_squares('ls', 'ob', {'x': 'x0'})},
  es AS (SELECT d.dataset_id, mask, r2_x, coalesce(x0, base_x + x1 * b1_x + x2 * b2_x + x3 * b3_x + x4 * b4_x) AS e FROM d JOIN ls USING (dataset_id)),
  q AS (SELECT dataset_id, quantile_cont(e, 0.25) AS a, quantile_cont(e, 0.5) AS b, quantile_cont(e, 0.75) AS c, avg(mask) AS rate, CASE WHEN sum(mask) > 0 THEN round(max(r2_x), 4) ELSE 0.0 END AS r2 FROM es GROUP BY dataset_id),
  pt AS (SELECT es.dataset_id, mask, rate, r2, CASE WHEN e < a THEN 1 WHEN e < b THEN 2 WHEN e < c THEN 3 ELSE 4 END AS part FROM es JOIN q USING (dataset_id))
  SELECT dataset_id, {r('any_value(r2)', 4)} AS x0_imputation_r2, {', '.join(f"{r(f'CASE WHEN any_value(r2) >= 0.1 THEN coalesce(avg(CASE WHEN part = {k} THEN mask END), 0.0) ELSE any_value(rate) END', 4)} AS q{k}_rate" for k in range(1, 5))} FROM pt GROUP BY dataset_id""",
)

R6A = r('avg(len) FILTER (mask = 1)')
R6B = r('count(*) / (2 * sum(len) FILTER (mask = 1) * (sum(len) - sum(len) FILTER (mask = 1)) / CAST(sum(len) AS DOUBLE) + 1)')

# ---- profiles ------------------------------------------------------------------------------

_R4 = lambda e: r(e, 4)
_PF1 = f"""{r('avg(x0)')} AS "X0_mean", {r('stddev_samp(x0)')} AS "X0_std", {r('min(x0)')} AS "X0_min", {r('max(x0)')} AS "X0_max", {r('median(x0)')} AS "X0_median",
  {r(_SK('co'))} AS "X0_skew", {r('avg(power(co, 4)) / power(avg(co * co), 2) - 3')} AS "X0_kurtosis", {r('quantile_cont(x0, 0.05)')} AS "X0_p5", {r('quantile_cont(x0, 0.25)')} AS "X0_p25",
  {r('quantile_cont(x0, 0.75)')} AS "X0_p75", {r('quantile_cont(x0, 0.95)')} AS "X0_p95", count(*) AS n_total, count(*) - count(x0) AS n_missing, count(x0) AS n_observed, round(avg(mask), 4) AS missing_rate"""
on_masked("pf1_x0_stats", pf.x0_stats, f", {MOM}{CENTRED} SELECT dataset_id, {_PF1} FROM c GROUP BY dataset_id HAVING count(x0) >= 2")
on_masked(
    "pf2_burst_profile", pf.burst_profile,
    f""", {RUNS.format(source='panel')} SELECT dataset_id, count(*) FILTER (mask = 1) AS n_bursts, {R6A} AS avg_burst_size,
  {R6B} AS runs_ratio
  FROM runs GROUP BY dataset_id HAVING count(DISTINCT mask) = 2""",
)
QUERIES["pf2_burst_profile_events"] = (
    lambda s, d: rounded(pf.burst_profile(sim.simulate(derived(s, d, "p2", lambda: panels.events_panel(s, d)), "mcar_block", 0.2, 7))),
    f"""WITH {P2}, {simulated('p2', 'masked', "'mcar_block'", 'CAST(0.2 AS DOUBLE)', 7)}, panel AS (SELECT *, CASE WHEN x0 IS NULL THEN 1 ELSE 0 END AS mask FROM masked), {RUNS.format(source='panel')}
  SELECT dataset_id, count(*) FILTER (mask = 1) AS n_bursts, {R6A} AS avg_burst_size,
  {R6B} AS runs_ratio
  FROM runs GROUP BY dataset_id HAVING count(DISTINCT mask) = 2""",
)
on_masked(
    "pf3_evidence_scores", pf.evidence_scores,
    f""", {MOM}{CENTRED}, a AS (SELECT dataset_id, count(*) AS n_total, CAST(sum(mask) AS BIGINT) AS n_missing, {_R4('corr(mask, x1)')} AS "corr_X1_mask", {_R4(_SH('x1'))} AS "X1_mean_diff",
    {_R4('(median(x0) - avg(x0)) / greatest(max(x0) - min(x0), 0.01)')} AS "X0_mean_deviation", {_R4(_SK('co'))} AS "X0_obs_skew" FROM c GROUP BY dataset_id),
  b AS (SELECT *, abs("corr_X1_mask") * 5 + abs("X1_mean_diff") * 5 AS mar, abs("X0_mean_deviation") * 5 + abs("X0_obs_skew") * 2 AS mnar FROM a)
  SELECT * EXCLUDE (mar, mnar), {_R4('least(mar, 1.0)')} AS mar_combined_evidence, {_R4('least(mnar, 1.0)')} AS mnar_combined_evidence, {_R4('mar * mnar')} AS evidence_conflict_score,
    {_R4('abs("X0_mean_deviation") * 10 + abs("X0_obs_skew")')} AS anomaly_score,
    CASE WHEN "X0_mean_deviation" <> 0 AND "X0_obs_skew" <> 0 THEN CASE WHEN sign("X0_mean_deviation") = sign("X0_obs_skew") THEN 1.0 ELSE 0.0 END ELSE 0.5 END::DOUBLE AS mnar_internal_consistency FROM b""",
)
_QR = lambda v, p, d: f"""SELECT dataset_id, {', '.join(f"{d.format(f'round(avg(CASE WHEN part = {k} THEN mask END), 4)')} AS {p}{k}" for k in (1, 2, 3, 4))} FROM (
  SELECT d.dataset_id, mask, CASE WHEN {v} < qa THEN 1 WHEN {v} < qb THEN 2 WHEN {v} < qc THEN 3 ELSE 4 END AS part FROM d JOIN (
    SELECT dataset_id, quantile_cont({v}, 0.25) AS qa, quantile_cont({v}, 0.5) AS qb, quantile_cont({v}, 0.75) AS qc FROM d GROUP BY dataset_id) q ON d.dataset_id = q.dataset_id) GROUP BY dataset_id"""  # noqa: E731
on_masked("pf4_quartile_missing_rates", pf.quartile_missing_rates, f", {MOM} {_QR('x0f', 'Q', '{}')}")
on_masked("pf5_x1_quartile_missing_rates", pf.x1_quartile_missing_rates, f", {MOM} {_QR('x1', 'x1_q', 'coalesce({}, 0.0)')}")
on_masked("pf7_mask_correlations", pf.mask_correlations, "SELECT dataset_id, " + ", ".join(f"{_R4(f'corr(mask, x{k})')} AS corr_mask_x{k}" for k in range(1, 5)) + " FROM panel GROUP BY dataset_id")
_I = lambda e: f"CAST(CAST(floor({e} + 0.5) AS BIGINT) AS VARCHAR)"
on_masked(
    "pf9_profile_text", pf.profile_text,
    f"""SELECT dataset_id, 'Dataset of ' || count(*) || ' rows; ' || CAST(sum(mask) AS BIGINT) || ' values of X0 are missing (' || {_I('sum(mask) * 1000.0 / count(*)')} || ' per mille). Observed X0: mean '
  || {_I('avg(x0)')} || ' from ' || {_I('min(x0)')} || ' to ' || {_I('max(x0)')} || '.' AS profile FROM panel GROUP BY dataset_id""",
)


def judgements(spark, sf_dir):
    """Three judgements of each order customer's payment habits, made from the orders themselves."""
    o = panels.read(spark, sf_dir, "orders")
    mech = F.element_at(F.array(F.lit("MCAR"), F.lit("MAR"), F.lit("MNAR")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    return o.select(
        F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("dataset_id"), mech.alias("mechanism"), ((F.col("o_orderkey") % 10) / 10.0).alias("confidence"),
        ((F.col("o_orderkey") % 7) / 7.0).alias("consistency"), ((F.col("o_orderkey") % 5) / 5.0).alias("surprise"), "o_orderkey",
    )


_J = """j AS (SELECT 'C' || o_custkey AS dataset_id, ['MCAR', 'MAR', 'MNAR'][o_orderkey % 3 + 1] AS mechanism, (o_orderkey % 10) / 10.0::DOUBLE AS confidence,
  (o_orderkey % 7) / 7.0::DOUBLE AS consistency, (o_orderkey % 5) / 5.0::DOUBLE AS surprise, o_orderkey FROM orders)"""
_V = lambda m: f"CASE WHEN sum(confidence) > 0 THEN sum(CASE WHEN mechanism = '{m}' THEN confidence ELSE 0 END) / sum(confidence) ELSE 1 / 3.0::DOUBLE END"
QUERIES["pf10_weighted_vote"] = (
    lambda s, d: pf.weighted_vote(judgements(s, d), "o_orderkey"),
    f"""WITH {_J}, v AS (SELECT dataset_id, {_V('MCAR')} AS a, {_V('MAR')} AS b, {_V('MNAR')} AS c, count(*) AS n, count(*) FILTER (mechanism = 'MCAR') AS na, count(*) FILTER (mechanism = 'MAR') AS nb,
    count(*) FILTER (mechanism = 'MNAR') AS nc, avg(consistency) AS consistency, avg(surprise) AS surprise FROM j GROUP BY dataset_id),
  w AS (SELECT *, CASE WHEN a = greatest(a, b, c) THEN 'MCAR' WHEN b = greatest(a, b, c) THEN 'MAR' ELSE 'MNAR' END AS winner FROM v)
  SELECT dataset_id, winner, round(greatest(a, b, c), 4) AS confidence, round(CASE winner WHEN 'MCAR' THEN na WHEN 'MAR' THEN nb ELSE nc END / CAST(n AS DOUBLE), 4) AS agreement,
    round(a, 4) AS vote_mcar, round(b, 4) AS vote_mar, round(c, 4) AS vote_mnar, round(consistency, 4) AS consistency, round(surprise, 4) AS surprise FROM w""",
)


def _first_and_last(s, d):
    j = judgements(s, d).withColumn("n_causes", (F.col("o_orderkey") % 8).cast("long"))
    pick = lambda f: j.groupBy("dataset_id").agg(*[f(c, "o_orderkey").alias(c) for c in ("mechanism", "confidence", "consistency", "surprise", "n_causes")])
    return pf.combine_judgements(pick(F.min_by), pick(F.max_by))


QUERIES["pf11_combine_judgements"] = (
    lambda s, d: rounded(_first_and_last(s, d)),
    f"""WITH {_J} SELECT dataset_id, CASE arg_min(mechanism, o_orderkey) WHEN 'MCAR' THEN 0.0 WHEN 'MAR' THEN 0.5 ELSE 1.0 END::DOUBLE AS domain_prior, {r('arg_min(confidence, o_orderkey)')} AS domain_confidence,
    {r('arg_min(consistency, o_orderkey)')} AS stats_consistency, {r('arg_min(surprise, o_orderkey)')} AS surprise,
    {r('round(abs(arg_max(confidence, o_orderkey) - arg_min(confidence, o_orderkey)), 4)')} AS confidence_delta, {r('round(least(min(o_orderkey) % 8 / 5.0, 1.0), 4)')}::DOUBLE AS n_causes FROM j GROUP BY dataset_id""",
)
