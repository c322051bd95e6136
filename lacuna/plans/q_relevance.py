"""Queries of feature relevance (FR), selection and naive Bayes (ML), and plain test statistics (TS, FT), with their oracles.

The feature table is made of orders: price, customer draw, month and day as features, order key modulo three as label.
"""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from lacuna.functions.rng import uniform_sql
from lacuna.operators import relevance as fr
from lacuna.operators import tests as ts
from lacuna.sources import panels
from lacuna.sources.stage import derived

from .q_features import _LONG, MOM, _ks, masked, rounded
from .sqltests import LEVENE, LONG, WELCH, kolmogorov, mutual_information, normal_two_sided, t_two_sided, two_sample_ks
from .sqltext import on_panel, r

QUERIES: dict = {}
_F = {
    "price": "round(o_totalprice / 1000.0, 3) + (o_orderkey % 3) * 20",
    "draw": f"round({uniform_sql(81, 'o_orderkey')}, 4) + (o_orderkey % 3) * 0.05",
    "customer": "CAST(o_custkey % 97 AS DOUBLE)",
    "twin": "CAST(o_custkey % 97 AS DOUBLE) * 2 + CAST(o_orderkey % 2 AS DOUBLE)",
    "flat": "CASE WHEN o_orderkey % 50 = 0 THEN 1.0 ELSE 0.0 END",
}
_COLUMNS = list(_F)
#: The same for Spark, whose round() goes by decimal digits: SQL scales, rounds to a whole number and scales back, which parts from it at halves.
_HALVES = {"round(o_totalprice / 1000.0, 3)": "round(o_totalprice / 1000.0 * 1000.0D) / 1000.0D"}


def features(s, d):
    def spelled(e: str) -> str:
        for sql, own in _HALVES.items():
            e = e.replace(sql, own)
        return f"CAST({e} AS DOUBLE)"

    return derived(s, d, "order_features", lambda: panels.read(s, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 3).cast("int").alias("label"), *[F.expr(spelled(e)).alias(k) for k, e in _F.items()]))


def long(s, d):
    return fr.long_features(features(s, d), ["id", "label"], _COLUMNS)


FEATURES = f"feat AS (SELECT o_orderkey AS id, CAST(o_orderkey % 3 AS INT) AS label, {', '.join(f'CAST({e} AS DOUBLE) AS {k}' for k, e in _F.items())} FROM orders)"
LONGF = f"{FEATURES}, lf AS ({' UNION ALL '.join(f'SELECT id, label, {chr(39)}{c}{chr(39)} AS var, {c} AS value FROM feat' for c in _COLUMNS)})"


def add(name, fn, sql):
    QUERIES[name] = (lambda s, d: rounded(fn(s, d)), f"WITH {LONGF}{sql}" if sql.lstrip().startswith(",") else f"WITH {LONGF}\n{sql}")


PROFILE = """pc AS (SELECT var, max(k) AS k, count(*) AS nd FROM (SELECT var, value, count(*) AS k FROM lf GROUP BY var, value) GROUP BY var),
  profile AS (SELECT lf.var, avg(value) AS mean, stddev_samp(value) AS std, min(value) AS mn, max(value) AS mx, any_value(nd) AS nd, avg(CASE WHEN value = 0 THEN 1.0::DOUBLE ELSE 0.0 END) AS zs, any_value(k) / CAST(count(value) AS DOUBLE) AS ms FROM lf JOIN pc ON lf.var = pc.var GROUP BY lf.var)"""
_LOW = "std < 0.01 OR ms > 0.95"
add(
    "fr1_variance_profile", lambda s, d: fr.variance_profile(long(s, d)),
    f', {PROFILE} SELECT var, {r("mean")} AS mean, {r("std")} AS std, {r("mn")} AS "min", {r("mx")} AS "max", nd AS n_distinct, {r("zs")} AS zero_share, {r("ms")} AS modal_share, {r("CASE WHEN abs(mean) > 1e-12 THEN std / abs(mean) END")} AS cv, {_LOW} AS low_variance FROM profile',
)
ANOVA = """an AS (SELECT var, label, count(*) AS n, sum(dv) AS s, sum(dv * dv) AS q FROM (SELECT var, label, value - avg(value) OVER (PARTITION BY var) AS dv FROM lf) GROUP BY var, label),
  atot AS (SELECT var, sum(s * s / n) AS b0, sum(q) AS q, sum(n) AS n, sum(s) AS s, count(*) AS k FROM an GROUP BY var),
  anova AS (SELECT var, CASE WHEN n > k AND q - b0 > 1e-12 AND k > 1 THEN ((b0 - s * s / n) / (k - 1)) / ((q - b0) / (n - k)) END AS f, CAST(k - 1 AS BIGINT) AS dfb, CAST(n - k AS BIGINT) AS dfw FROM atot)"""
add("fr4_anova_f", lambda s, d: fr.anova_f(long(s, d)), f", {ANOVA} SELECT var, {r('f')} AS f, dfb AS df_between, dfw AS df_within FROM anova")
add(
    "ml1_select_k_best", lambda s, d: fr.select_k_best(long(s, d), keep=3),
    f", {ANOVA} SELECT var, {r('anova.f')} AS f, dfb AS df_between, dfw AS df_within, row_number() OVER (ORDER BY coalesce(anova.f, -1) DESC, var) AS rank, row_number() OVER (ORDER BY coalesce(anova.f, -1) DESC, var) <= 3 AS kept FROM anova",
)
add(
    "ml2_standardize", lambda s, d: fr.standardize(long(s, d)).select("id", "var", "value"),
    f", z AS (SELECT id, var, CASE WHEN stddev_pop(value) OVER w > 1e-12 THEN (value - avg(value) OVER w) / stddev_pop(value) OVER w ELSE 0.0 END AS z FROM lf WINDOW w AS (PARTITION BY var)) SELECT id, var, {r('z')} AS value FROM z",
)
_PAIRS = [(a, b) for i, a in enumerate(_COLUMNS) for b in _COLUMNS[i + 1 :]]
PAIRS = "prs AS (" + " UNION ALL ".join(f"SELECT '{a}' AS var_a, '{b}' AS var_b, corr({a}, {b}) AS r FROM feat" for a, b in _PAIRS) + ")"
add("fr6_high_correlation_pairs", lambda s, d: fr.correlations(features(s, d), _COLUMNS), f", {PAIRS} SELECT var_a, var_b, {r('r')} AS r, abs(prs.r) > 0.9 AS high FROM prs")
add(
    "fr7_class_profile", lambda s, d: fr.class_profile(long(s, d)),
    f""", rk AS (SELECT var, rank() OVER (PARTITION BY var ORDER BY value) + (count(*) OVER (PARTITION BY var, value) - 1) / 2.0::DOUBLE AS a, rank() OVER (PARTITION BY var ORDER BY label) + (count(*) OVER (PARTITION BY var, label) - 1) / 2.0::DOUBLE AS b FROM lf),
  rh AS (SELECT var, corr(a, b) AS rho FROM rk GROUP BY var)
  SELECT lf.var, {', '.join(f'{r(f"avg(value) FILTER (label = {k})")} AS mean_{k}' for k in range(3))}, {r('any_value(rho)')} AS rho FROM lf JOIN rh ON lf.var = rh.var GROUP BY lf.var""",
)
add(
    "fr8_removal_reasons", lambda s, d: fr.removal_reasons(fr.variance_profile(long(s, d)), fr.anova_f(long(s, d)), fr.correlations(features(s, d), _COLUMNS)),
    f""", {PROFILE}, {ANOVA}, {PAIRS}, why AS (SELECT var, 'low variance' AS reason FROM profile WHERE {_LOW} UNION SELECT var, 'weak F' FROM anova WHERE f IS NULL OR f < 3.0
    UNION SELECT CASE WHEN coalesce(fa.f, -1) < coalesce(fb.f, -1) THEN var_a ELSE var_b END, 'correlated' FROM prs JOIN anova fa ON fa.var = var_a JOIN anova fb ON fb.var = var_b WHERE abs(r) > 0.9),
  g AS (SELECT var, string_agg(reason, '; ' ORDER BY reason) AS reasons, count(*) AS n FROM why GROUP BY var)
  SELECT p.var, coalesce(reasons, '') AS reasons, coalesce(n, 0) AS n_reasons, n IS NULL AS keep FROM profile p LEFT JOIN g ON p.var = g.var""",
)
_NB = ("price", "draw", "customer")
add(
    "ml4_gaussian_nb", lambda s, d: fr.gaussian_nb(long(s, d).where(F.col("var").isin(*_NB) & (F.col("id") % 5 != 0)), long(s, d).where(F.col("var").isin(*_NB) & (F.col("id") % 5 == 0))),
    f""", tr AS (SELECT * FROM lf WHERE var IN ('price', 'draw', 'customer') AND id % 5 <> 0), wd AS (SELECT max(v) AS widest FROM (SELECT var_pop(value) AS v FROM tr GROUP BY var)),
  md AS (SELECT label, var, avg(value) AS m, var_pop(value) + 1e-9 * (SELECT widest FROM wd) AS v, ln(count(*) / CAST((SELECT count(*) FROM tr WHERE var = 'price') AS DOUBLE)) AS prior FROM tr GROUP BY label, var),
  sc AS (SELECT id, md.label, sum(-0.5 * (ln({2 * math.pi!r} * v) + power(value - m, 2) / v)) + max(prior) AS s FROM lf JOIN md ON lf.var = md.var WHERE id % 5 = 0 GROUP BY id, md.label),
  ex AS (SELECT id, label, exp(s - max(s) OVER (PARTITION BY id)) AS e FROM sc), pp AS (SELECT id, label, e / sum(e) OVER (PARTITION BY id) AS p FROM ex)
  SELECT id, CAST(arg_max(label, {{'p': p, 'l': -label}}) AS INT) AS y_pred, {', '.join(f'{r(f"max(p) FILTER (label = {k})")} AS p{k}' for k in range(3))} FROM pp GROUP BY id""",
)


# ---- statistics of tests, before their tails -------------------------------------------------------


def on_masked(name, fn, sql):
    QUERIES[name] = (lambda s, d: rounded(fn(masked(s, d))), on_panel(sql))


on_masked(
    "ts2_welch_statistics", ts.welch_statistics,
    f""", {MOM}, {_LONG}, g AS (SELECT dataset_id, var, count(*) FILTER (mask = 1) AS n1, count(*) FILTER (mask = 0) AS n0, avg(value) FILTER (mask = 1) AS m1, avg(value) FILTER (mask = 0) AS m0,
    var_samp(value) FILTER (mask = 1) AS v1, var_samp(value) FILTER (mask = 0) AS v0 FROM long GROUP BY dataset_id, var)
  SELECT dataset_id, var, n1, n0, {r('(m1 - m0) / sqrt(v1 / n1 + v0 / n0)')} AS t, {r('power(v1 / n1 + v0 / n0, 2) / (power(v1 / n1, 2) / (n1 - 1) + power(v0 / n0, 2) / (n0 - 1))', 4)} AS df FROM g WHERE n1 >= 3 AND n0 >= 3 AND v1 / n1 + v0 / n0 > 0""",
)
on_masked(
    "ts3_levene_statistics", ts.levene_statistics,
    f""", {MOM}, {_LONG}, a AS (SELECT dataset_id, var, mask, abs(value - median(value) OVER (PARTITION BY dataset_id, var, mask)) AS z FROM long),
  g AS (SELECT dataset_id, var, mask, count(*) AS n, avg(z) AS m, var_pop(z) * count(*) AS q FROM a GROUP BY dataset_id, var, mask),
  t AS (SELECT dataset_id, var, sum(n) AS n, min(n) AS least, sum(n * m) / sum(n) AS mm, sum(q) AS q, count(*) AS k FROM g GROUP BY dataset_id, var),
  b AS (SELECT dataset_id, var, sum(g.n * power(g.m - t.mm, 2)) AS b FROM g JOIN t USING (dataset_id, var) GROUP BY dataset_id, var)
  SELECT dataset_id, var, {r('b / (q / (n - 2))')} AS f, CAST(n - 2 AS BIGINT) AS df FROM t JOIN b USING (dataset_id, var) WHERE k = 2 AND least >= 5 AND q > 1e-12""",
)
on_masked(
    "ft9_mannwhitney_statistics", ts.mannwhitney_statistics,
    f""", k AS (SELECT dataset_id, mask, rank() OVER (PARTITION BY dataset_id ORDER BY x1) + (count(*) OVER (PARTITION BY dataset_id, x1) - 1) / 2.0::DOUBLE AS rk FROM panel)
  SELECT dataset_id, CAST(sum(mask) AS BIGINT) AS n1, CAST(sum(1 - mask) AS BIGINT) AS n0, {r('sum(rk) FILTER (mask = 1) - sum(mask) * (sum(mask) + 1) / 2.0::DOUBLE')} AS u FROM k GROUP BY dataset_id""",
)
on_masked(
    "ts15_max_mask_correlation", ts.max_mask_correlation,
    f""", {MOM}, {_LONG}, c AS (SELECT dataset_id, var, corr(value, mask) AS cr FROM long GROUP BY dataset_id, var)
  SELECT dataset_id, arg_max(var, {{'r': round(abs(cr), 9), 'v': var}}) AS var, {r('max(abs(cr))')} AS r FROM c WHERE NOT isnan(cr) GROUP BY dataset_id""",
)
on_masked("ts2_little_proxy", ts.little_proxy, f", {MOM}, {LONG}, {WELCH} SELECT dataset_id, tests, {r('p')} AS p FROM welch")
on_masked("ts3_levene_bonferroni", ts.levene_bonferroni, f", {MOM}, {LONG}, {LEVENE} SELECT dataset_id, tests, {r('p')} AS p FROM levene")
on_masked(
    "ft7_log_pval_x1_mask", ts.log_pval_x1,
    f""", c AS (SELECT dataset_id, corr(mask, x1) AS cr, CAST(count(*) - 2 AS DOUBLE) AS df FROM panel GROUP BY dataset_id), t AS (SELECT *, abs(cr) * sqrt(df / greatest(1 - cr * cr, 1e-300)) AS t FROM c)
  SELECT dataset_id, {r(f"CASE WHEN isnan(cr) THEN 0.0 ELSE -log10(greatest({t_two_sided('t', 'df')}, 1e-100)) END")} AS "log_pval_X1_mask" FROM t""",
)
on_masked(
    "ft9_mannwhitney_pval", ts.mannwhitney_pval,
    f""", k AS (SELECT dataset_id, mask, rank() OVER (PARTITION BY dataset_id ORDER BY x1) + (count(*) OVER (PARTITION BY dataset_id, x1) - 1) / 2.0::DOUBLE AS rk, count(*) OVER (PARTITION BY dataset_id, x1) AS t FROM panel),
  u AS (SELECT dataset_id, CAST(sum(mask) AS DOUBLE) AS n1, CAST(sum(1 - mask) AS DOUBLE) AS n0, sum(rk) FILTER (mask = 1) - sum(mask) * (sum(mask) + 1) / 2.0::DOUBLE AS u, CAST(sum(t * t - 1) AS DOUBLE) AS ties FROM k GROUP BY dataset_id),
  z AS (SELECT dataset_id, greatest(abs(u - n1 * n0 / 2) - 0.5, 0.0) / sqrt(n1 * n0 / 12.0 * ((n1 + n0 + 1) - ties / ((n1 + n0) * (n1 + n0 - 1)))) AS z FROM u)
  SELECT dataset_id, {r(f"coalesce({normal_two_sided('z')}, 1.0)")} AS "X1_mannwhitney_pval" FROM z""",
)
on_masked(
    "ts16_mnar_ks_test", ts.mnar_ks_test,
    f""", {MOM}, {_ks('d', 'dataset_id', 'x0f', '1 - mask', '1')}, e AS (SELECT dataset_id, CASE WHEN na >= 10 AND nb - na >= 3 THEN ks END AS ks, na, nb FROM k), {two_sample_ks('x', 'e')}
  SELECT dataset_id, {r('ks')} AS ks, {r('x.p')} AS p FROM e LEFT JOIN x USING (dataset_id)""",
)
on_masked(
    "pf8_normality_ks", ts.normality_ks,
    f""", o AS (SELECT dataset_id, x0, avg(x0) OVER w AS m, greatest(stddev_pop(x0) OVER w, 1e-10) AS s, count(*) OVER w AS n FROM panel WHERE x0 IS NOT NULL WINDOW w AS (PARTITION BY dataset_id)),
  v AS (SELECT dataset_id, x0, any_value((x0 - m) / s) AS z, any_value(n) AS n, count(*) AS k FROM o WHERE n > 20 GROUP BY dataset_id, x0),
  c AS (SELECT *, sum(k) OVER (PARTITION BY dataset_id ORDER BY x0) AS upto, CASE WHEN z > 0 THEN 1 - {normal_two_sided('z')} / 2 ELSE {normal_two_sided('z')} / 2 END AS cdf FROM v),
  g AS (SELECT dataset_id, CAST(any_value(n) AS DOUBLE) AS n, max(greatest(upto / CAST(n AS DOUBLE) - cdf, cdf - (upto - k) / CAST(n AS DOUBLE))) AS ks FROM c GROUP BY dataset_id)
  SELECT dataset_id, {r('ks')} AS ks, {r(kolmogorov('ks', 'n'))} AS p FROM g""",
)


def _linear(s, d):
    from lacuna.operators import linear

    return rounded(linear.mechdetect_features(masked(s, d)))


QUERIES["ft5_6_16_21_mask_models"] = (_linear, None)


def _diffuse(s, d):
    from lacuna.operators import linear

    return rounded(linear.focused_or_diffuse(masked(s, d).where("label = 2")))


QUERIES["ts22_mnar_focused_vs_diffuse"] = (_diffuse, None)


def _split(s, d):
    df = features(s, d)
    return df.where("id % 5 <> 0"), df.where("id % 5 = 0")


def _classify(kind):
    def query(s, d):
        from lacuna.operators import classify

        train, test = _split(s, d)
        return rounded(classify.fit_predict(train, test, _COLUMNS, kind))

    return query


for _i, _kind in ((6, "forest"), (7, "logistic"), (8, "perceptron"), (9, "boosting"), (10, "linear_svm"), (10, "rbf_svm")):
    QUERIES[f"ml{_i}_{_kind}"] = (_classify(_kind), None)


def _ml(name, *more):
    def query(s, d):
        from lacuna.operators import classify

        return rounded(getattr(classify, name)(features(s, d), _COLUMNS, *more))

    return query


QUERIES["ml3_pca_95"] = (_ml("pca_share"), None)
QUERIES["ml25_feature_importance"] = (_ml("feature_importance"), None)


def _cv(s, d):
    from lacuna.operators import classify, evaluate

    folds = evaluate.stratified_kfold(features(s, d), "label", "id", 3)
    return rounded(classify.cross_validate(folds, ["draw", "customer"], "logistic", 3))


QUERIES["ml15_cross_validate"] = (_cv, None)


def _hierarchical(s, d):
    from lacuna.operators import classify, evaluate

    train, test = _split(s, d)
    return rounded(evaluate.route(classify.hierarchical(train, test, _COLUMNS), "soft3zone"))


QUERIES["ml18_hierarchical_classify"] = (_hierarchical, None)


def _weighted(s, d):
    from lacuna.operators import classify

    train, test = _split(s, d)
    train = train.withColumn("row_weight", F.when(F.col("id") % 2 == 0, 1.0).otherwise(0.5))
    return rounded(classify.predict(classify.fit(train, _COLUMNS, "logistic", "row_weight"), test))


QUERIES["ml22_weighted_fit"] = (_weighted, None)


def _out_of_sample(s, d):
    """Probabilities of every order by models that have not seen its customer."""
    from lacuna.operators import classify, evaluate

    groups = panels.read(s, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 25).alias("grp"))
    df = evaluate.group_kfold(features(s, d).join(groups, "id"), "grp", 3)
    return rounded(classify.cross_validate(df, _COLUMNS, "logistic", 3))


QUERIES["lq1_out_of_sample_probs"] = (_out_of_sample, None)


def feature_matrix(s, d):
    """The features of every masked dataset, with its label and a number as id."""

    def build():
        from lacuna.operators import features as ft

        ids = masked(s, d).groupBy("dataset_id").agg(F.max("dataset_no").alias("id"))
        return ft.extract_features(masked(s, d)).join(ids, "dataset_id")

    return derived(s, d, "feature_matrix", build)


def _names(df):
    return [c for c, t in df.dtypes if t == "double"]


QUERIES["ft33_extract_features"] = (lambda s, d: rounded(feature_matrix(s, d).drop("id")), None)

# ---- neighbours, balancing, calibration, search ----------------------------------------------------

_KNN_TRAIN = f"tr AS (SELECT * FROM feat WHERE id % 5 <> 0), st AS (SELECT {', '.join(f'avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}' for c in _COLUMNS)} FROM tr)"
_Z = ", ".join(f"CASE WHEN s_{c} > 1e-12 THEN ({c} - m_{c}) / s_{c} ELSE 0.0 END AS {c}" for c in _COLUMNS)


def _knn(s, d):
    from lacuna.operators import classify

    train, test = _split(s, d)
    return classify.knn_classify(train, test, _COLUMNS)


add(
    "ml5_knn_classify", _knn,
    f""", {_KNN_TRAIN}, rf AS (SELECT id, label, {_Z} FROM tr, st), te AS (SELECT id, label, {_Z} FROM feat, st WHERE id % 5 = 0),
  pr AS (SELECT te.id, te.label, rf.label AS near, row_number() OVER (PARTITION BY te.id ORDER BY round({' + '.join(f'power(te.{c} - rf.{c}, 2)' for c in _COLUMNS)}, 9), rf.id) AS k FROM te, rf),
  vo AS (SELECT id, any_value(label) AS label, {', '.join(f'count(*) FILTER (near = {k}) AS v{k}' for k in range(3))} FROM pr WHERE k <= 5 GROUP BY id)
  SELECT id, label, CASE WHEN v0 >= v1 AND v0 >= v2 THEN 0 WHEN v1 >= v2 THEN 1 ELSE 2 END AS y_pred FROM vo""",
)


def priorities(s, d):
    """Order features with the order's priority as an uneven label: urgent, high, others."""
    urgency = F.when(F.col("o_orderpriority").startswith("1"), 2).when(F.col("o_orderpriority").startswith("2"), 1).otherwise(0)
    label = panels.read(s, d, "orders").select(F.col("o_orderkey").alias("id"), urgency.alias("label"))
    return features(s, d).drop("label").join(label, "id")


def _balanced(method):
    def query(s, d):
        from lacuna.operators import classify

        df = priorities(s, d)
        return rounded({"smote": lambda: classify.smote(df, _COLUMNS), "borderline": lambda: classify.smote(df, _COLUMNS, borderline=True)}.get(method, lambda: classify.smote_clean(df, _COLUMNS, method))())

    return query


for _name, _method in (("ml16_smote", "smote"), ("ml17_smote_borderline", "borderline"), ("ml17_smote_enn", "enn"), ("ml17_smote_tomek", "tomek")):
    QUERIES[_name] = (_balanced(_method), None)
_PRIORITY = "pri AS (SELECT o_orderkey AS id, CAST(CASE WHEN o_orderpriority LIKE '1%' THEN 2 WHEN o_orderpriority LIKE '2%' THEN 1 ELSE 0 END AS INT) AS label FROM orders)"
QUERIES["ml17_undersample"] = (
    lambda s, d: _balanced("under")(s, d).select("id", "label"),
    f"WITH {_PRIORITY}, k AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {uniform_sql(74, 'id')}, id) AS place FROM pri) SELECT id, label FROM k WHERE place <= (SELECT min(n) FROM (SELECT count(*) AS n FROM pri GROUP BY label))",
)


def _platt(s, d):
    from lacuna.operators import classify, evaluate

    train, test = _split(s, d)
    return rounded(classify.platt_calibrate(evaluate.stratified_kfold(train, "label", "id", 3), test, ["price", "draw"], "forest", 3))


def _search(s, d):
    from lacuna.operators import classify, evaluate

    df = feature_matrix(s, d)
    return rounded(classify.hyperparameter_search(evaluate.group_kfold(df, "source_group", 3), _names(df), trials=6))


QUERIES["ml21_platt_calibrate"] = (_platt, None)
QUERIES["ml23_hyperparameter_search"] = (_search, None)

# ---- relevance by models, ablations -----------------------------------------------------------------


def _permutation(s, d):
    from lacuna.operators import classify

    train, test = _split(s, d)
    return rounded(classify.permutation_importance(classify.fit(train, _COLUMNS, "forest"), test, _COLUMNS))


def _rfe(s, d):
    from lacuna.operators import classify

    df = feature_matrix(s, d)
    return classify.recursive_elimination(df, _names(df))


def _shapley(s, d):
    """Attributions of the test rows, held against the forest: their sum and the base are its probability."""
    from lacuna.operators import attribution, classify

    train, test = _split(s, d)
    model = classify.fit(train, _COLUMNS, "forest")
    each = attribution.attributed(model, test, _COLUMNS).join(classify.predict(model, test), "id")
    of = lambda c: F.element_at("base", c + 1) + F.aggregate("values", F.lit(0.0), lambda a, v: a + F.element_at(v, c + 1))
    off = F.greatest(*[F.abs(of(c) - F.col(f"p{c}")) for c in range(3)])
    names = F.element_at(F.array(*[F.lit(c) for c in _COLUMNS]), F.col("at") + 1)
    return each.select("id", off.alias("off"), F.posexplode("values").alias("at", "own")).select("id", names.alias("var"), (F.col("off") < 1e-6).alias("adds_up"))


def _shift(s, d):
    from lacuna.operators import classify

    train, test = _split(s, d)
    return rounded(classify.level_importance_shift(train, test, _COLUMNS))


QUERIES["fr2_permutation_importance"] = (_permutation, None)
QUERIES["fr5_recursive_elimination"] = (_rfe, None)
QUERIES["fr9_level_importance_shift"] = (_shift, None)
QUERIES["fr9_shapley_values"] = (
    _shapley, f"SELECT o_orderkey AS id, var, true AS adds_up FROM orders, (SELECT unnest([{', '.join(repr(c) for c in _COLUMNS)}]) AS var) WHERE o_orderkey % 5 = 0",
)


def _feature_mi(s, d):
    from lacuna.operators import nearest

    return nearest.feature_mutual_info(long(s, d))


add("fr3_mutual_information", _feature_mi, f", {mutual_information('fm', 'lf', 'var', 'id', 'label')} SELECT var, {r('mi')} AS mi, fm.mi < 0.01 AS low FROM fm")


def folded(s, d):
    """Order features with folds of their own and of whole customer groups."""
    groups = panels.read(s, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 25).alias("own_group"), (F.col("o_custkey") % 5).alias("five"))
    return features(s, d).join(groups, "id")


def _nb(out: str, rows: str, by: str) -> str:
    """CTEs that end in ``out`` (by, id, fold, label, y_pred); rows: by, id, fold, label, var, value."""
    b, on = (f"{by}, ", lambda x, y, keys: " AND ".join(f"{x}.{k.strip()} = {y}.{k.strip()}" for k in keys.split(",")))
    return f"""{out}_0 AS (SELECT var, avg(value) AS m0 FROM {rows} GROUP BY var), {out}_d AS (SELECT {rows}.*, value - m0 AS dv FROM {rows} JOIN {out}_0 USING (var)),
  {out}_o AS (SELECT {b}fold, label, var, count(*) AS n, sum(dv) AS s, sum(dv * dv) AS q FROM {out}_d GROUP BY {b}fold, label, var),
  {out}_t AS (SELECT {b}label, var, sum(n) AS n, sum(s) AS s, sum(q) AS q FROM {out}_o GROUP BY {b}label, var), {out}_f AS (SELECT DISTINCT {b}fold FROM {out}_o),
  {out}_l AS (SELECT {', '.join(f't.{k.strip()}' for k in by.split(','))}, f.fold, t.label, t.var, CAST(t.n - coalesce(o.n, 0) AS DOUBLE) AS n, t.s - coalesce(o.s, 0) AS s, t.q - coalesce(o.q, 0) AS q FROM {out}_t t JOIN {out}_f f ON {on('t', 'f', by)}
    LEFT JOIN {out}_o o ON {on('t', 'o', by + ', label, var')} AND o.fold = f.fold WHERE t.n - coalesce(o.n, 0) > 0),
  {out}_s AS (SELECT {b}fold, max(v) AS widest, max(alln) AS alln FROM (SELECT {b}fold, var, sum(q) / sum(n) - power(sum(s) / sum(n), 2) AS v, sum(n) AS alln FROM {out}_l GROUP BY {b}fold, var) GROUP BY {b}fold),
  {out}_m AS (SELECT {out}_l.*, s / n AS m, greatest(q / n - (s / n) * (s / n), 0.0) + 1e-9 * widest AS v, ln(n / alln) AS prior FROM {out}_l JOIN {out}_s USING ({b}fold)),
  {out}_e AS (SELECT {', '.join(f'd.{k.strip()}' for k in by.split(','))}, d.id, d.fold, d.label, m.label AS class, sum(-0.5 * (ln({2 * math.pi!r} * v) + power(dv - m, 2) / v)) + max(prior) AS s FROM {out}_d d JOIN {out}_m m ON {on('d', 'm', by + ', fold, var')} GROUP BY ALL),
  {out} AS (SELECT {b}id, fold, label, arg_max(class, {{'s': round(s, 6), 'c': -class}}) AS y_pred FROM {out}_e GROUP BY {b}id, fold, label)"""


_SETS = {"E1": ["price"], "E2": ["price", "draw"], "E3": ["price", "draw", "customer"], "E4": list(_COLUMNS)}
_HIT = "CASE WHEN label = y_pred THEN 1.0::DOUBLE ELSE 0.0 END"
_RECALL = lambda k: f"coalesce(avg({_HIT}) FILTER (label = {k}), 0.0)"
add(
    "ev8_feature_set_ablation",
    lambda s, d: fr.feature_set_ablation(fr.long_features(folded(s, d).withColumnRenamed("five", "fold"), ["id", "label", "fold"], _COLUMNS), _SETS),
    f""", sets(config, var) AS (VALUES {', '.join(f"('{k}', '{v}')" for k, own in _SETS.items() for v in own)}), ab AS (SELECT config, lf.id, o_custkey % 5 AS fold, label, lf.var, value FROM lf JOIN orders ON o_orderkey = lf.id JOIN sets ON sets.var = lf.var),
  {_nb('nb', 'ab', 'config')}, n AS (SELECT config, count(*) AS n_features FROM sets GROUP BY config)
  SELECT nb.config, any_value(n_features) AS n_features, {r(f'avg({_HIT})')} AS accuracy, {r(f'({" + ".join(map(_RECALL, range(3)))}) / 3')} AS macro_recall, {', '.join(f'{r(_RECALL(k))} AS recall_{k}' for k in range(3))} FROM nb JOIN n ON n.config = nb.config GROUP BY nb.config""",
)
add(
    "ev9_scenario_ablation", lambda s, d: fr.scenario_ablation(folded(s, d), _COLUMNS, "price", {"group5": "five", "leave_one_group_out": "own_group"}),
    f""", sl AS (SELECT cv, scenario, lf.id, CASE cv WHEN 'group5' THEN o_custkey % 5 ELSE o_custkey % 25 END AS fold, label, var, value FROM lf JOIN orders ON o_orderkey = lf.id, (SELECT unnest(['group5', 'leave_one_group_out']) AS cv), (SELECT unnest(['full', 'without', 'only']) AS scenario)
    WHERE scenario = 'full' OR (scenario = 'only') = (var = 'price')), {_nb('nb', 'sl', 'scenario, cv')},
  w AS (SELECT cv, {', '.join(f"avg({_HIT}) FILTER (scenario = '{x}') AS a_{x}" for x in ('full', 'without', 'only'))} FROM nb GROUP BY cv)
  SELECT cv, {', '.join(f'{r(f"a_{x}")} AS "{x}"' for x in ('full', 'without', 'only'))}, {r('a_full - a_without')} AS full_minus_without, {r('a_full - a_only')} AS full_minus_only, {r("(SELECT a_full FROM w WHERE cv = 'group5') - a_full")} AS first_minus_own FROM w""",
)
