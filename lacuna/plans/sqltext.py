"""SQL texts of the panels, for the oracles."""

from __future__ import annotations

from lacuna.functions.rng import STRIDE, normal_sql, row_number_sql, uniform_sql
from lacuna.operators.simulate import VARIANTS


def r(e: str, digits: int = 6) -> str:
    """Rounded, with -0.0 made 0.0."""
    return f"(round({e}, {digits}) + 0.0)"


P1 = """p1 AS (
  SELECT 'S' || l_suppkey AS dataset_id, l_suppkey AS dataset_no, 'g' || (l_suppkey % 20) AS source_group,
    row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) AS row_id,
    {x0} AS x0, CAST(l_quantity AS DOUBLE) AS x1, CAST(l_discount AS DOUBLE) AS x2, CAST(l_tax AS DOUBLE) AS x3, CAST(l_linenumber AS DOUBLE) AS x4
  FROM lineitem)"""
P1_PLAIN = P1.format(x0="CAST(l_extendedprice AS DOUBLE)")
P1_CORRELATED = P1.format(x0="CAST(l_extendedprice + 2000 * l_quantity AS DOUBLE)")
P2 = """p2 AS (
  SELECT 'U' || user_id AS dataset_id, user_id AS dataset_no, 'events' AS source_group, row_id, x0, x1, """ + ", ".join(
    f"{uniform_sql(100 + k, row_number_sql('user_id'))} AS x{k}" for k in (2, 3, 4)
) + """
  FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS row_id, CAST(value AS DOUBLE) AS x0, CAST(hour(ts) AS DOUBLE) AS x1 FROM events))"""

_N = row_number_sql()
_Z = {
    "mar_logistic": "(x1 - m1) / (p1_ + 1e-9)",
    "mar_multi_predictor": "0.7 * (x1 - m1) / (s1 + 1e-9) + 0.3 * (x2 - m2) / (s2 + 1e-9)",
    "mnar_self_logistic": "(x0 - m0) / (p0 + 1e-9)",
}


def simulated(source: str, out: str, way: str, rate: str, seed: int) -> str:
    """CTEs that end in ``out``: ``source`` with x0 nulled; way and rate are SQL expressions."""
    z = {**_Z, "mnar_self_noisy": f"(x0 + 0.1 * {normal_sql(seed + 3, _N)} - m0) / (p0 + 1e-9)"}
    raw = " ".join(f"WHEN '{w}' THEN 1.0 / (1.0 + exp(-({e})))" for w, e in z.items())
    o = out
    return f"""{o}_f AS (
  SELECT *, CAST(greatest(1, floor(rate * n)) AS BIGINT) AS n_miss, {uniform_sql(seed, _N)} AS u FROM (
    SELECT *, {rate} AS rate, {way} AS way, count(*) OVER d AS n,
      avg(x0) OVER d AS m0, stddev_pop(x0) OVER d AS p0, avg(x1) OVER d AS m1, stddev_pop(x1) OVER d AS p1_, stddev_samp(x1) OVER d AS s1,
      avg(x2) OVER d AS m2, stddev_samp(x2) OVER d AS s2,
      quantile_cont(x1, 0.25) OVER d AS qa, quantile_cont(x1, 0.5) OVER d AS qb, quantile_cont(x1, 0.75) OVER d AS qc
    FROM {source} WINDOW d AS (PARTITION BY dataset_id))),
{o}_g AS (
  SELECT *, CASE way {raw} END AS raw,
    row_number() OVER (PARTITION BY dataset_id ORDER BY u, row_id) AS by_u,
    row_number() OVER (PARTITION BY dataset_id ORDER BY x1 DESC, row_id) AS x1_down,
    row_number() OVER (PARTITION BY dataset_id ORDER BY x0 DESC, row_id) AS x0_down,
    row_number() OVER (PARTITION BY dataset_id ORDER BY x0, row_id) AS x0_up
  FROM {o}_f),
{o}_b AS (
  SELECT dataset_id, start + 1 AS lo, start + size AS hi FROM (
    SELECT *, CAST(floor({uniform_sql(seed + 12, f'dataset_no * {STRIDE} + block')} * greatest(1, n - size)) AS BIGINT) AS start FROM (
      SELECT *, unnest(range(1, blocks + 1)) AS block, greatest(1, n_miss // blocks) AS size FROM (
        SELECT DISTINCT dataset_id, dataset_no, n, n_miss,
          1 + CAST(floor({uniform_sql(seed + 11, f'dataset_no * {STRIDE}')} * greatest(2, n_miss // 5)) AS BIGINT) AS blocks
        FROM {o}_f WHERE way = 'mcar_block')))),
{o}_c AS (
  SELECT dataset_id, avg(raw) AS mean_raw,
    max(CASE WHEN n - x1_down = floor((n - 1) * (1 - rate)) THEN x1 END) AS x1a, max(CASE WHEN n - x1_down = ceil((n - 1) * (1 - rate)) THEN x1 END) AS x1b,
    max(CASE WHEN n - x0_down = floor((n - 1) * (1 - rate)) THEN x0 END) AS x0a, max(CASE WHEN n - x0_down = ceil((n - 1) * (1 - rate)) THEN x0 END) AS x0b,
    max((n - 1) * (1 - rate) - floor((n - 1) * (1 - rate))) AS part
  FROM {o}_g GROUP BY dataset_id),
{o}_p AS (
  SELECT g.*, c.x1a + c.part * (c.x1b - c.x1a) AS cut1, c.x0a + c.part * (c.x0b - c.x0a) AS cut0,
    CASE WHEN way = 'mar_quantile_group' THEN least(1.0, rate * CASE WHEN x1 <= qa THEN 0.2 WHEN x1 <= qb THEN 0.6 WHEN x1 <= qc THEN 1.4 ELSE 2.0 END)
      ELSE least(greatest(raw * (rate / (mean_raw + 1e-12)), 0.0), 1.0) END AS p
  FROM {o}_g g JOIN {o}_c c USING (dataset_id)),
{o}_h AS (
  SELECT *, CASE way
    WHEN 'mcar_uniform' THEN u < rate WHEN 'mcar_fixed' THEN by_u <= n_miss
    WHEN 'mcar_block' THEN EXISTS (SELECT 1 FROM {o}_b b WHERE b.dataset_id = p.dataset_id AND p.row_id BETWEEN b.lo AND b.hi)
    WHEN 'mar_threshold' THEN x1 >= cut1 WHEN 'mar_rank' THEN x1_down <= n_miss
    WHEN 'mnar_quantile_threshold' THEN x0 >= cut0
    WHEN 'mnar_tail_censoring' THEN x0_up <= n_miss // 2 OR x0_down <= n_miss - n_miss // 2
    ELSE u < p END AS hit,
    CASE WHEN way IN ('mcar_uniform', 'mcar_fixed', 'mcar_block', 'mar_threshold', 'mar_rank', 'mnar_quantile_threshold', 'mnar_tail_censoring') THEN 1 - u ELSE p END AS w
  FROM {o}_p p),
{out} AS (
  SELECT dataset_id, dataset_no, source_group, row_id,
    CASE WHEN hit OR (NOT bool_or(hit) OVER (PARTITION BY dataset_id) AND row_number() OVER (PARTITION BY dataset_id ORDER BY w DESC, row_id) = 1) THEN NULL ELSE x0 END AS x0,
    x1, x2, x3, x4 FROM {o}_h)"""


WAY = "CASE dataset_no % 12 " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(VARIANTS)) + " END"
RATE = "(1 + dataset_no % 10) / 100.0"
#: ``panel``: the line items' panel with every dataset masked in its way, and its label.
PANEL = f"""{P1_PLAIN}, {simulated('p1', 'masked', WAY, f'CAST({RATE} AS DOUBLE)', 42)},
panel AS (
  SELECT *, CASE WHEN x0 IS NULL THEN 1 ELSE 0 END AS mask, {WAY} AS variant, upper(split_part({WAY}, '_', 1)) AS mechanism,
    CASE upper(split_part({WAY}, '_', 1)) WHEN 'MCAR' THEN 0 WHEN 'MAR' THEN 1 ELSE 2 END AS label
  FROM masked WHERE dataset_id IN (SELECT dataset_id FROM masked WHERE x0 IS NULL))"""


def on_panel(rest: str) -> str:
    """A query on ``panel``; a text that starts with a comma goes on with the list of CTEs."""
    return f"WITH {PANEL}{rest}" if rest.lstrip().startswith(",") else f"WITH {PANEL}\n{rest}"
