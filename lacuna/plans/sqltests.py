"""SQL texts of tests of the mask and of their tails, for the oracles: ``panel`` (and ``d``, the panel with filled X0) come before them."""

from __future__ import annotations

from lacuna.functions.digamma import digamma_sql
from lacuna.functions.rng import normal_sql, row_number_sql
from lacuna.operators.nearest import INSIDE, JITTER, NEIGHBOURS


def _simpson(f: str, a: str, b: str, steps: int) -> str:
    """The integral of f (of the variable u) from a to b."""
    u = f"({a} + i * ({b} - {a}) / {float(steps)})"
    weight = f"CASE WHEN i = 0 OR i = {steps} THEN 1.0::DOUBLE WHEN i % 2 = 1 THEN 4.0::DOUBLE ELSE 2.0::DOUBLE END"
    return f"(({b} - {a}) / {3.0 * steps} * list_sum(list_transform(range(0, {steps + 1}), lambda i: ({weight}) * {f.format(u=u)})))"


def normal_two_sided(z: str) -> str:
    return f"least(1.0, sqrt(2.0 / pi()) * {_simpson('exp(-power({u}, 2) / 2)', f'abs({z})', f'(abs({z}) + 9.0)', 600)})"


def t_two_sided(t: str, df: str) -> str:
    """By the angle whose tangent is t / sqrt(df)."""
    low = f"atan(abs({t}) / sqrt({df}))"
    area = _simpson(f"power(greatest(cos({{u}}), 0.0), {df} - 1)", low, "(pi() / 2)", 4000)
    return f"least(1.0, 2.0 / sqrt(pi()) * exp(lgamma(({df} + 1) / 2.0) - lgamma({df} / 2.0)) * {area})"


def chi2_even(x: str, terms: str) -> str:
    """Upper tail for 2 x terms degrees of freedom."""
    return f"least(1.0, exp(-({x}) / 2) * list_sum(list_transform(range(0, {terms}), lambda i: power(({x}) / 2, i) / gamma(i + 1))))"


def kolmogorov(d: str, n: str) -> str:
    z = f"({d} * (sqrt({n}) + 0.12 + 0.11 / sqrt({n})))"
    return f"CASE WHEN {z} < 0.2 THEN 1.0 ELSE least(1.0, greatest(0.0, 2 * list_sum(list_transform(range(1, 101), lambda i: CASE WHEN i % 2 = 1 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END * exp(-2.0 * i * i * {z} * {z}))))) END"


def two_sample_ks(out: str, source: str) -> str:
    """CTEs that end in ``out`` (dataset_id, p): the exact chance of a difference of ks or more between samples of na and nb different values.

    Chances of the paths inside the band go from one diagonal to the next; what falls outside is summed up."""
    return f"""{out}_0 AS (SELECT dataset_id, CAST(na AS BIGINT) AS m, CAST(nb AS BIGINT) AS n, CAST(round(ks * na * nb) AS BIGINT) AS h FROM {source} WHERE ks IS NOT NULL),
  {out}_w AS (WITH RECURSIVE walk AS (
    SELECT dataset_id, m, n, h, CAST(0 AS BIGINT) AS t, CAST(0 AS BIGINT) AS low, [1.0::DOUBLE] AS mass, 0.0::DOUBLE AS gone FROM {out}_0 WHERE h > 0
    UNION ALL
    SELECT dataset_id, m, n, h, t + 1, f, b[f - low + 1 : e - low], list_sum(b) - coalesce(list_sum(b[f - low + 1 : e - low]), 0.0) FROM (
      SELECT *, least(CAST(ceil(((t + 1) * m + h) / (m + n)) AS BIGINT), low + len(b)) AS e FROM (
        SELECT *, greatest(CAST(floor(((t + 1) * m - h) / (m + n)) AS BIGINT) + 1, low) AS f,
          list_transform(range(low, low + len(mass) + 1), lambda i: coalesce(mass[i - low + 1], 0.0) * (n - t + i) / (m + n - t) + CASE WHEN i > low THEN mass[i - low] * (m - i + 1) / (m + n - t) ELSE 0.0 END) AS b
        FROM walk WHERE t < m + n AND len(mass) > 0)))
    SELECT dataset_id, sum(gone) AS p FROM walk GROUP BY dataset_id),
  {out} AS (SELECT dataset_id, CASE WHEN h > 0 THEN least(1.0, p) ELSE 1.0 END AS p FROM {out}_0 LEFT JOIN {out}_w USING (dataset_id))"""


LONG = "long AS (" + " UNION ALL ".join(f"SELECT dataset_id, dataset_no, row_id, mask, '{v}' AS var, {v} AS value FROM d" for v in ("x1", "x2", "x3", "x4")) + ")"

# ---- Welch, Levene ----------------------------------------------------------------------------

WELCH = f"""wg AS (SELECT dataset_id, var, count(*) FILTER (mask = 1) AS n1, count(*) FILTER (mask = 0) AS n0, avg(value) FILTER (mask = 1) AS m1, avg(value) FILTER (mask = 0) AS m0,
    var_samp(value) FILTER (mask = 1) AS v1, var_samp(value) FILTER (mask = 0) AS v0 FROM long GROUP BY dataset_id, var),
  wt AS (SELECT dataset_id, var, (m1 - m0) / sqrt(v1 / n1 + v0 / n0) AS t, round(power(v1 / n1 + v0 / n0, 2) / (power(v1 / n1, 2) / (n1 - 1) + power(v0 / n0, 2) / (n0 - 1)), 4) AS df FROM wg WHERE n1 >= 3 AND n0 >= 3 AND v1 / n1 + v0 / n0 > 0),
  wp AS (SELECT dataset_id, greatest({t_two_sided('t', 'df')}, 1e-300) AS p FROM wt),
  ws AS (SELECT dataset_id, count(*) AS tests, -2 * sum(ln(p)) AS x FROM wp GROUP BY dataset_id),
  welch AS (SELECT dataset_id, tests, {chi2_even('x', 'tests')} AS p FROM ws)"""

LEVENE = f"""lev_a AS (SELECT dataset_id, var, mask, abs(value - median(value) OVER (PARTITION BY dataset_id, var, mask)) AS z FROM long),
  lev_g AS (SELECT dataset_id, var, mask, count(*) AS n, avg(z) AS m, var_pop(z) * count(*) AS q FROM lev_a GROUP BY dataset_id, var, mask),
  lev_t AS (SELECT dataset_id, var, sum(n) AS n, min(n) AS least_n, sum(n * m) / sum(n) AS mm, sum(q) AS q, count(*) AS k FROM lev_g GROUP BY dataset_id, var),
  lev_b AS (SELECT dataset_id, var, sum(lev_g.n * power(lev_g.m - lev_t.mm, 2)) AS b FROM lev_g JOIN lev_t USING (dataset_id, var) GROUP BY dataset_id, var),
  lev_f AS (SELECT dataset_id, b / (q / (n - 2)) AS f, CAST(n - 2 AS DOUBLE) AS df FROM lev_t JOIN lev_b USING (dataset_id, var) WHERE k = 2 AND least_n >= 5 AND q > 1e-12),
  levene AS (SELECT dataset_id, count(*) AS tests, least(min({t_two_sided('sqrt(f)', 'df')}) * count(*), 1.0) AS p FROM lev_f GROUP BY dataset_id)"""

# ---- 4 x 4 systems --------------------------------------------------------------------------------


def cholesky(out: str, source: str, keep: str, targets: tuple[str, ...]) -> str:
    """CTEs that end in ``out``: source (s11, s12, ..., s44 and right sides g1_T..g4_T for each target T) with z1_T..z4_T = L^-1 g and slopes b1_T..b4_T."""
    parts, before = [], source
    for k in range(1, 5):
        own = [f"l{k}{m}" for m in range(1, k)]
        pivot = f"sqrt(s{k}{k}{''.join(f' - {x} * {x}' for x in own)})"
        step = f"{out}_{k}"
        parts.append(f"{step}_ AS (SELECT *, {pivot} AS l{k}{k} FROM {before})")
        lower = [f"(s{k}{j}{''.join(f' - l{j}{m} * l{k}{m}' for m in range(1, k))}) / l{k}{k} AS l{j}{k}" for j in range(k + 1, 5)]
        z = [f"(g{k}_{t}{''.join(f' - l{k}{m} * z{m}_{t}' for m in range(1, k))}) / l{k}{k} AS z{k}_{t}" for t in targets]
        parts.append(f"{step} AS (SELECT *, {', '.join(lower + z)} FROM {step}_)")
        before = step
    for k in range(4, 0, -1):
        b = [f"(z{k}_{t}{''.join(f' - l{j}{k} * b{j}_{t}' for j in range(k + 1, 5))}) / l{k}{k} AS b{k}_{t}" for t in targets]
        parts.append(f"{out if k == 1 else f'{out}_b{k}'} AS (SELECT *, {', '.join(b)} FROM {before})")
        before = f"{out}_b{k}"
    return ", ".join(parts)


_S = ", ".join(f"covar_pop(x{i}, x{j}) AS s{i}{j}" for i in range(1, 5) for j in range(i, 5))

#: Only X0 has gaps: with d the difference of the sides' means and S the covariance of all rows the statistic is n1 n0 / n times d S^-1 d.
LITTLE = f"""lm AS (SELECT dataset_id, count(*) FILTER (mask = 1) AS n1, count(*) FILTER (mask = 0) AS n0, {_S},
    {', '.join(f'avg(x{k}) FILTER (mask = 1) - avg(x{k}) FILTER (mask = 0) AS g{k}_d' for k in range(1, 5))} FROM d GROUP BY dataset_id),
  {cholesky('lc', 'lm', 'dataset_id', ('d',))},
  ls AS (SELECT dataset_id, n1 * n0 / CAST(n1 + n0 AS DOUBLE) * (z1_d * z1_d + z2_d * z2_d + z3_d * z3_d + z4_d * z4_d) AS x FROM lc WHERE n1 > 0 AND n0 > 0),
  little AS (SELECT dataset_id, x AS stat, exp(-x / 2) * (1 + x / 2) AS p FROM ls)"""


def least_squares(out: str, rows: str, targets: dict[str, str]) -> str:
    """CTEs that end in ``out`` (dataset_id, means, slopes b1_T.., base_T, r2_T) of targets on x1..x4 over ``rows``."""
    g = ", ".join(f"covar_pop(x{k}, {e}) AS g{k}_{t}" for t, e in targets.items() for k in range(1, 5))
    m = ", ".join(f"avg(x{k}) AS m{k}" for k in range(1, 5))
    t = ", ".join(f"avg({e}) AS mean_{t}, var_pop({e}) AS v_{t}" for t, e in targets.items())
    base = ", ".join(f"mean_{t} - ({' + '.join(f'b{k}_{t} * m{k}' for k in range(1, 5))}) AS base_{t}" for t in targets)
    r2 = ", ".join(f"CASE WHEN v_{t} > 1e-12 THEN least(1.0, greatest(0.0, ({' + '.join(f'b{k}_{t} * g{k}_{t}' for k in range(1, 5))}) / v_{t})) ELSE 0.0 END AS r2_{t}" for t in targets)
    return f"""{out}_m AS (SELECT dataset_id, count(*) AS n, {_S}, {g}, {m}, {t} FROM {rows} GROUP BY dataset_id), {cholesky(f'{out}_c', f'{out}_m', 'dataset_id', tuple(targets))},
  {out} AS (SELECT *, {base}, {r2} FROM {out}_c)"""


# ---- mutual information ------------------------------------------------------------------------------


def mutual_information(out: str, rows: str, by: str, number: str, label: str) -> str:
    """CTEs that end in ``out`` (by, mi): rows has by, value, the label and a whole number."""
    scale = "CASE WHEN s > 0 THEN s ELSE 1.0 END"
    own = f"WINDOW w AS (PARTITION BY {by}, label ORDER BY v, id)"
    gaps = ", ".join([f"v - lag(v, {k}) OVER w" for k in range(1, NEIGHBOURS + 1)] + [f"lead(v, {k}) OVER w - v" for k in range(1, NEIGHBOURS + 1)])
    return f"""{out}_s AS (SELECT {by}, stddev_pop(value) AS s, avg(abs(value)) AS m FROM {rows} GROUP BY {by}),
  {out}_v AS (SELECT {by}, {number} AS id, {label} AS label, value / {scale} + {JITTER!r} * greatest(1.0, m / {scale}) * {normal_sql(51, number)} AS v FROM {rows} JOIN {out}_s USING ({by})),
  {out}_g AS (SELECT {by}, id, label, v, list_sort(list_filter([{gaps}], lambda x: x IS NOT NULL)) AS gaps, count(*) OVER (PARTITION BY {by}, label) AS same FROM {out}_v {own}),
  {out}_n AS (SELECT *, least({NEIGHBOURS}, same - 1) AS k, {INSIDE!r} * gaps[least({NEIGHBOURS}, same - 1)] AS rad FROM {out}_g WHERE same > 1),
  {out}_e AS (SELECT {by}, id, v AS pos, 1 AS kind FROM {out}_n UNION ALL SELECT {by}, id, v + rad, 0 FROM {out}_n UNION ALL SELECT {by}, id, v - rad, 2 FROM {out}_n),
  {out}_u AS (SELECT {by}, id, kind, sum(CASE WHEN kind = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY {by} ORDER BY pos, kind ROWS UNBOUNDED PRECEDING) AS upto FROM {out}_e),
  {out}_i AS (SELECT {by}, id, greatest(max(upto) FILTER (kind = 0) - max(upto) FILTER (kind = 2), 1) AS inside FROM {out}_u GROUP BY {by}, id),
  {out}_t AS (SELECT {by}, count(*) AS n, avg({digamma_sql('k')} - {digamma_sql('same')} - {digamma_sql('inside')}) AS rest FROM {out}_n JOIN {out}_i USING ({by}, id) GROUP BY {by}),
  {out} AS (SELECT {by}, greatest({digamma_sql('n')} + rest, 0.0) AS mi FROM {out}_t)"""


MASK_MI = f"""{mutual_information('mi', 'long', 'dataset_id, var', row_number_sql(), 'mask')},
  mi_side AS (SELECT dataset_id, least(sum(mask), sum(1 - mask)) AS side FROM d GROUP BY dataset_id),
  mask_mi AS (SELECT dataset_id, CASE WHEN side >= 5 THEN coalesce(mi_max, 0.0) ELSE 0.0 END AS mi_max, CASE WHEN side >= 5 THEN coalesce(mi_mean, 0.0) ELSE 0.0 END AS mi_mean
    FROM mi_side LEFT JOIN (SELECT dataset_id, max(mi) AS mi_max, avg(mi) AS mi_mean FROM mi GROUP BY dataset_id) USING (dataset_id))"""
