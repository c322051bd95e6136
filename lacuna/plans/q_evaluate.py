"""Queries of evaluation (EV), splits and routing (ML), label quality (LQ), with their oracles.

Predictions are derived from ``orders``: every order is a sample, its customer the group, and draws decide what
four models under two configurations say of it.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lacuna.functions.draws import REACH, STEPS
from lacuna.functions.rng import uniform_sql
from lacuna.operators import evaluate as ev
from lacuna.sources import panels
from lacuna.sources.stage import derived

from .q_features import rounded
from .sqltests import normal_two_sided
from .sqltext import r

QUERIES: dict = {}
_MODELS = ("bayes", "forest", "knn", "logit")
_CONFIGS = ("base", "full")
_NO = "(o_orderkey * 8 + model_no * 2 + config_no)"
_RIGHT = f"({uniform_sql(21, _NO)} < 0.45 + 0.05 * model_no + 0.04 * config_no)"
_PRED = f"(CASE WHEN {_RIGHT} THEN o_orderkey % 3 ELSE (o_orderkey + 1 + CAST(floor({uniform_sql(22, _NO)} * 2) AS BIGINT)) % 3 END)"
_W = [f"(0.05 + {uniform_sql(30 + k, _NO)} + CASE WHEN {_PRED} = {k} THEN 1.0 ELSE 0.0 END)" for k in range(3)]


def predictions(spark, sf_dir):
    def build():
        o = panels.read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
        o = o.withColumn("model_no", F.explode(F.sequence(F.lit(0), F.lit(3)))).withColumn("config_no", F.explode(F.sequence(F.lit(0), F.lit(1))))
        name = lambda names, i: F.element_at(F.array(*map(F.lit, names)), (F.col(i) + 1).cast("int"))
        o = o.withColumns({f"w{k}": F.expr(w) for k, w in enumerate(_W)} | {"y_pred": F.expr(_PRED)})
        total = F.col("w0") + F.col("w1") + F.col("w2")
        return o.select(
            F.col("o_orderkey").alias("sample_id"), F.concat(F.lit("g"), (F.col("o_custkey") % 25).cast("string")).alias("source_group"), name(_CONFIGS, "config_no").alias("config"),
            name(_MODELS, "model_no").alias("model"), (F.col("o_orderkey") % 5).cast("int").alias("fold"), (F.col("o_orderkey") % 3).cast("int").alias("y_true"),
            F.col("y_pred").cast("int").alias("y_pred"), *[(F.col(f"w{k}") / total).alias(f"p{k}") for k in range(3)],
        )

    return derived(spark, sf_dir, "predictions", build)


PREDICTIONS = f"""predictions AS (
  SELECT o_orderkey AS sample_id, 'g' || (o_custkey % 25) AS source_group, {list(_CONFIGS)}[config_no + 1] AS config, {list(_MODELS)}[model_no + 1] AS model, CAST(o_orderkey % 5 AS INT) AS fold,
    CAST(o_orderkey % 3 AS INT) AS y_true, CAST(y_pred AS INT) AS y_pred, w0 / (w0 + w1 + w2) AS p0, w1 / (w0 + w1 + w2) AS p1, w2 / (w0 + w1 + w2) AS p2
  FROM (SELECT *, {', '.join(f'{w} AS w{k}' for k, w in enumerate(_W))}, {_PRED} AS y_pred
    FROM orders, (SELECT unnest(range(4)) AS model_no), (SELECT unnest(range(2)) AS config_no)))"""


def add(name, fn, sql):
    QUERIES[name] = (lambda s, d: rounded(fn(s, d)), f"WITH {PREDICTIONS}{sql}" if sql.lstrip().startswith(",") else f"WITH {PREDICTIONS}\n{sql}")


_COUNTS = ", ".join(f"count(*) FILTER (y_pred = {c}) AS n_pred_{c}" for c in range(3))
add("ev1_confusion_matrix", lambda s, d: ev.confusion_matrix(predictions(s, d)), f"SELECT config, model, y_true, {_COUNTS} FROM predictions GROUP BY config, model, y_true")
REPORT = """m AS (SELECT config, model, c AS class, count(*) FILTER (y_true = c AND y_pred = c) AS hit, count(*) FILTER (y_pred = c) AS predicted, count(*) FILTER (y_true = c) AS support,
    count(*) FILTER (y_true = y_pred) AS right_, count(*) AS n FROM predictions, (SELECT unnest([0, 1, 2]) AS c) GROUP BY config, model, c),
  q AS (SELECT *, CASE WHEN predicted > 0 THEN hit / CAST(predicted AS DOUBLE) ELSE 0.0 END AS precision, CASE WHEN support > 0 THEN hit / CAST(support AS DOUBLE) ELSE 0.0 END AS recall FROM m),
  report AS (SELECT *, f1_ AS f1, avg(f1_) OVER (PARTITION BY config, model) AS macro_f1, right_ / CAST(n AS DOUBLE) AS accuracy FROM (
    SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1_ FROM q))"""
add(
    "ev2_classification_report", lambda s, d: ev.classification_report(predictions(s, d)),
    f", {REPORT} SELECT config, model, CAST(class AS INT) AS class, {r('precision')} AS precision, {r('recall')} AS recall, {r('f1')} AS f1, support, {r('accuracy')} AS accuracy, {r('macro_f1')} AS macro_f1 FROM report",
)
_MODE = lambda c: f"CASE WHEN count(*) FILTER ({c} = 0) >= greatest(count(*) FILTER ({c} = 1), count(*) FILTER ({c} = 2)) THEN 0 WHEN count(*) FILTER ({c} = 1) >= count(*) FILTER ({c} = 2) THEN 1 ELSE 2 END"
add(
    "ev3_accuracy_by_group", lambda s, d: ev.accuracy_by_group(predictions(s, d)),
    f", a AS (SELECT source_group, config, model, count(*) AS n, avg(CASE WHEN y_true = y_pred THEN 1.0 ELSE 0.0 END) AS acc, {_MODE('y_true')} AS label FROM predictions GROUP BY ALL)"
    f" SELECT source_group, config, model, n, {r('acc')} AS accuracy, label, row_number() OVER (PARTITION BY config, model ORDER BY acc, source_group) AS place FROM a",
)
_F1 = " + ".join(f"CASE WHEN {s} > 0 THEN 2.0 * v{4 * k} / {s} ELSE 0.0 END" for k in range(3) for s in [f"({' + '.join(f'v{3 * k + j} + v{3 * j + k}' for j in range(3))})"])


def _drawn(k: int) -> str:
    """The CTE of cell k: the least count whose chances add up to more than the draw. The reduction takes chances off the draw until it is
    below zero and one for each count after that; ``rest`` and ``of`` are the rows and counts of the cells not yet drawn."""
    x, p = f"v{k}", f"(c{k} / CAST(of AS DOUBLE))"
    reach = f"({REACH} * sqrt(rest * {p} * (1 - {p})) + {STEPS})"
    chance = f"exp(lgamma(rest + 1) - lgamma(i + 1) - lgamma(rest - i + 1) + i * ln({p}) + (rest - i) * ln(1 - {p}))"
    low, high = f"greatest(0, CAST(floor(rest * {p} - {reach}) AS BIGINT))", f"least(rest, CAST(ceil(rest * {p} + {reach}) AS BIGINT))"
    chances = f"list_transform(range({low}, {high} + 1), lambda i: {chance})"
    left = f"list_reduce(list_prepend({uniform_sql(11, ev.draw_number(str(k)))}, {chances}), lambda a, b: CASE WHEN a < 0 THEN a - 1 ELSE a - b END)"
    inner = f"{high} - greatest(0, CAST(floor(-({left})) AS BIGINT))"
    return f"""d{k} AS (SELECT * EXCLUDE (rest, of), rest - {x} AS rest, of - c{k} AS of FROM (
    SELECT *, CASE WHEN rest <= 0 OR c{k} = 0 THEN 0 WHEN c{k} = of THEN rest ELSE {inner} END AS {x} FROM {f'd{k - 1}' if k else 'b'}))"""


_CELLS = ", ".join(f"count(*) FILTER (y_true = {k // 3} AND y_pred = {k % 3}) AS c{k}" for k in range(9))
add(
    "ev4_bootstrap_ci", lambda s, d: ev.bootstrap_ci(predictions(s, d)),
    f""", a AS (SELECT config, model, {_CELLS}, count(*) AS rest, count(*) AS of FROM predictions GROUP BY config, model), b AS (SELECT *, unnest(range(1, 1001)) AS replicate FROM a),
  {', '.join(_drawn(k) for k in range(9))}, m AS (SELECT config, model, (v0 + v4 + v8) / CAST({' + '.join(f'v{k}' for k in range(9))} AS DOUBLE) AS acc, ({_F1}) / 3 AS f1 FROM d8)
  SELECT config, model, {', '.join(f'{r(f"quantile_cont({x}, {q})")} AS {name}_{end}' for x, name in (('acc', 'accuracy'), ('f1', 'macro_f1')) for end, q in (('low', 0.025), ('high', 0.975)))} FROM m GROUP BY config, model""",
)
_PAIR = "SELECT a.model, a.y_true = a.y_pred AS a, b.y_true = b.y_pred AS b FROM predictions a JOIN predictions b ON a.sample_id = b.sample_id AND a.model = b.model WHERE a.config = 'base' AND b.config = 'full'"
add(
    "ev5_mcnemar", lambda s, d: ev.mcnemar(predictions(s, d), "base", "full"),
    f", p AS ({_PAIR}), n AS (SELECT model, count(*) FILTER (a AND NOT b) AS b, count(*) FILTER (NOT a AND b) AS c FROM p GROUP BY model)"
    f", x AS (SELECT *, CASE WHEN b + c > 0 THEN power(abs(b - c) - 1, 2) / (b + c) ELSE 0.0 END AS x2 FROM n) SELECT model, b, c, {r('x2')} AS chi2, {r(normal_two_sided('sqrt(x2)'))} AS p FROM x",
)
SCORES = "scores AS (SELECT config, model, fold, avg(CASE WHEN y_true = y_pred THEN 1.0::DOUBLE ELSE 0.0 END) AS score FROM predictions GROUP BY config, model, fold)"
add(
    "ev6_wilcoxon", lambda s, d: ev.wilcoxon(ev.fold_scores(predictions(s, d)), "full", "base"),
    f""", {SCORES}, d AS (SELECT a.model, round(a.score - b.score, 9) AS d FROM scores a JOIN scores b USING (model, fold) WHERE a.config = 'full' AND b.config = 'base'),
  k AS (SELECT *, rank() OVER (PARTITION BY model ORDER BY abs(d)) + (count(*) OVER (PARTITION BY model, abs(d)) - 1) / 2.0::DOUBLE AS rk FROM d WHERE d <> 0),
  w AS (SELECT model, count(*) AS n, least(sum(CASE WHEN d > 0 THEN rk ELSE 0 END), sum(CASE WHEN d < 0 THEN rk ELSE 0 END)) AS w FROM k GROUP BY model),
  i AS (SELECT model, rk, row_number() OVER (PARTITION BY model ORDER BY rk) AS i FROM k),
  signs AS (SELECT model, any_value(w) AS w, any_value(n) AS n, s, sum(CASE WHEN (s >> (i - 1)) & 1 = 1 THEN rk ELSE 0 END) AS total FROM (SELECT *, unnest(range(CAST(power(2, n) AS BIGINT))) AS s FROM w) JOIN i USING (model) GROUP BY model, s)
  SELECT model, any_value(n) AS n, {r('any_value(w)')} AS w, {r('least(1.0, 2 * count(*) FILTER (total <= w) / power(2, any_value(n)))')} AS p FROM signs GROUP BY model""",
)
add(
    "ev7_friedman", lambda s, d: ev.friedman(ev.fold_scores(predictions(s, d))),
    f""", {SCORES}, s AS (SELECT config, fold, model, round(score, 9) AS score FROM scores),
  k AS (SELECT *, rank() OVER (PARTITION BY config, fold ORDER BY score) + (count(*) OVER (PARTITION BY config, fold, score) - 1) / 2.0::DOUBLE AS rk FROM s),
  t AS (SELECT CAST(sum(t * t * t - t) AS DOUBLE) AS ties FROM (SELECT count(*) AS t FROM s GROUP BY config, fold, score)),
  m AS (SELECT count(*) AS k, max(n) AS n, sum(rs * rs) AS sq FROM (SELECT model, sum(rk) AS rs, count(*) AS n FROM k GROUP BY model)),
  x AS (SELECT k, n, (12.0 / (n * k * (k + 1)) * sq - 3 * n * (k + 1)) / (1 - ties / (n * k * (k * k - 1))) AS x FROM m, t)
  SELECT k, n AS blocks, {r('x')} AS statistic, {r(f"{normal_two_sided('sqrt(x.x)')} + sqrt(2 * x.x / pi()) * exp(-x.x / 2)")} AS p FROM x""",
)
_ACC = lambda c: f"avg(CASE WHEN y_true = y_pred THEN 1.0::DOUBLE ELSE 0.0 END) FILTER (config = '{c}')"
add(
    "ev10_compare_configs", lambda s, d: ev.long_form(rounded(ev.compare_configs(predictions(s, d), "base", ["full"])), "model", ["base", "full", "delta_full"]),
    f", w AS (SELECT model, {_ACC('base')} AS base, {_ACC('full')} AS full_ FROM predictions GROUP BY model)"
    f" SELECT model, 'base' AS config, {r('base')} AS accuracy FROM w UNION ALL SELECT model, 'full', {r('full_')} FROM w UNION ALL SELECT model, 'delta_full', {r('full_ - base')} FROM w",
)
_MA = "acc AS (SELECT config, model, avg(CASE WHEN y_true = y_pred THEN 1.0::DOUBLE ELSE 0.0 END) AS a FROM predictions GROUP BY config, model)"
add(
    "ev11_summary_by_variant", lambda s, d: ev.summary_by_variant(predictions(s, d)),
    f", {_MA}, b AS (SELECT config, model, row_number() OVER (PARTITION BY config ORDER BY a DESC, model) AS k FROM acc)"
    f" SELECT acc.config, {r('avg(a)')} AS mean_accuracy, {r('stddev_samp(a)')} AS std_accuracy, {r('max(a)')} AS max_accuracy, any_value(b.model) AS best_model FROM acc JOIN b ON acc.config = b.config AND b.k = 1 GROUP BY acc.config",
)
add(
    "ev12_cv_gap", lambda s, d: ev.cv_gap(ev.fold_scores(predictions(s, d)).where("config = 'base'"), ev.accuracy_by_group(predictions(s, d)).where("config = 'base'").select("model", F.col("accuracy").alias("score"))),
    f""", {SCORES}, a AS (SELECT model, avg(score) AS f FROM scores WHERE config = 'base' GROUP BY model),
  b AS (SELECT model, avg(g) AS s FROM (SELECT model, source_group, avg(CASE WHEN y_true = y_pred THEN 1.0::DOUBLE ELSE 0.0 END) AS g FROM predictions WHERE config = 'base' GROUP BY model, source_group) GROUP BY model)
  SELECT model, {r('f')} AS first, {r('s')} AS second, {r('s - f')} AS gap FROM a JOIN b USING (model)""",
)
OVERVIEW = f"""{REPORT}, {SCORES}, overview AS (SELECT config, max(accuracy) AS best_accuracy, max(recall) FILTER (class = 2) AS best_mnar_recall, avg(recall) FILTER (class = 2) AS mean_mnar_recall,
    any_value(cv_mean) AS cv_mean, any_value(cv_std) AS cv_std, any_value(cv_std) / any_value(cv_mean) AS cv_spread FROM report JOIN (SELECT config, avg(score) AS cv_mean, stddev_samp(score) AS cv_std FROM scores GROUP BY config) USING (config) GROUP BY config)"""
_OV = ("best_accuracy", "best_mnar_recall", "mean_mnar_recall", "cv_mean", "cv_std", "cv_spread")
add("ev13_experiment_overview", lambda s, d: ev.experiment_overview(predictions(s, d)), f", {OVERVIEW} SELECT config, {', '.join(f'{r(c)} AS {c}' for c in _OV)} FROM overview")
add(
    "ev14_seed_stability", lambda s, d: ev.seed_stability(ev.fold_scores(predictions(s, d)).where("config = 'full'").select("model", F.col("fold").alias("seed"), "score")),
    f", {SCORES} SELECT model, count(*) AS seeds, {r('avg(score)')} AS mean, {r('stddev_samp(score)')} AS std, {r('max(score) - min(score)')} AS \"range\", stddev_samp(score) < 0.05 * avg(score) AS stable FROM scores WHERE config = 'full' GROUP BY model",
)
add(
    "ev15_target_check", lambda s, d: ev.target_check(ev.experiment_overview(predictions(s, d))),
    f", {OVERVIEW} " + " UNION ALL ".join(f"SELECT config, '{m}' AS metric, {r(m)} AS value, {t}::DOUBLE AS target, {m} {rel} {t} AS met FROM overview" for m, rel, t in ev.TARGETS),
)

# ---- splits, routing, ensembles ----------------------------------------------------------------


def one(s, d, model="forest", config="full"):
    return predictions(s, d).where((F.col("model") == model) & (F.col("config") == config))


_ONE = "one AS (SELECT * FROM predictions WHERE model = 'forest' AND config = 'full')"
add(
    "ml11_group_shuffle_split", lambda s, d: ev.group_shuffle_split(one(s, d).withColumn("g", F.substring("source_group", 2, 9).cast("long")), "source_group", "g").select("sample_id", "source_group", "test"),
    f""", {_ONE}, g AS (SELECT source_group, {uniform_sql(5, 'CAST(substr(source_group, 2) AS BIGINT)')} AS u FROM one GROUP BY source_group),
  k AS (SELECT source_group, row_number() OVER (ORDER BY u, source_group) <= ceil(0.25 * count(*) OVER ()) AS test FROM g) SELECT sample_id, source_group, test FROM one JOIN k USING (source_group)""",
)
add(
    "ml12_stratified_kfold", lambda s, d: ev.stratified_kfold(one(s, d).drop("fold"), "y_true", "sample_id").select("sample_id", "y_true", "fold"),
    f", {_ONE} SELECT sample_id, y_true, CAST((row_number() OVER (PARTITION BY y_true ORDER BY {uniform_sql(6, 'sample_id')}, sample_id) - 1) % 5 AS INT) AS fold FROM one",
)
add(
    "ml14_leave_one_group_out", lambda s, d: ev.fold_sizes(ev.leave_one_group_out(one(s, d).drop("fold"), "source_group")),
    f", {_ONE}, f AS (SELECT DISTINCT source_group AS fd FROM one) SELECT fd AS fold, count(*) FILTER (source_group = fd) AS n_test, count(*) FILTER (source_group <> fd) AS n_train, count(DISTINCT source_group) FILTER (source_group <> fd) AS train_groups FROM one, f GROUP BY fd",
)
add(
    "ml12_repeated_kfold", lambda s, d: ev.stratified_kfold(one(s, d).drop("fold"), "y_true", "sample_id", repeats=3).select("sample_id", "repeat", "fold"),
    ", " + _ONE + " " + " UNION ALL ".join(f"SELECT sample_id, {k} AS repeat, CAST((row_number() OVER (PARTITION BY y_true ORDER BY {uniform_sql(6 + 101 * k, 'sample_id')}, sample_id) - 1) % 5 AS INT) AS fold FROM one" for k in range(3)),
)
add("ml12_leave_one_out", lambda s, d: ev.leave_one_out(one(s, d).drop("fold"), "sample_id").select("sample_id", "fold"), f", {_ONE} SELECT sample_id, sample_id AS fold FROM one")
add(
    "ml13_group_kfold", lambda s, d: ev.group_kfold(one(s, d).drop("fold"), "source_group").select("sample_id", "source_group", "fold"),
    f""", {_ONE}, g AS (SELECT source_group, count(*) AS size, row_number() OVER (ORDER BY count(*) DESC, source_group) AS k FROM one GROUP BY source_group),
  dealing AS (SELECT CAST(0 AS BIGINT) AS k, [0, 0, 0, 0, 0]::BIGINT[] AS loads, CAST(0 AS BIGINT) AS fold
    UNION ALL SELECT g.k, list_transform(loads, lambda x, i: CASE WHEN i = list_position(loads, list_min(loads)) THEN x + g.size ELSE x END), list_position(loads, list_min(loads)) FROM dealing JOIN g ON g.k = dealing.k + 1)
  SELECT sample_id, source_group, CAST(dealing.fold - 1 AS INT) AS fold FROM one JOIN g USING (source_group) JOIN dealing USING (k)""",
)
QUERIES["ml13_group_kfold"] = (QUERIES["ml13_group_kfold"][0], QUERIES["ml13_group_kfold"][1].replace("WITH ", "WITH RECURSIVE ", 1))


def two_level(s, d):
    return one(s, d).select("sample_id", "y_true", (1 - F.col("p0")).alias("p_rest"), (F.col("p2") / (F.col("p1") + F.col("p2"))).alias("p_mnar"))


_TWO = f"{_ONE}, two AS (SELECT sample_id, y_true, 1 - p0 AS p, p2 / (p1 + p2) AS m FROM one)"
_SECOND = "CASE WHEN m >= 0.5 THEN 2 ELSE 1 END"
_BLEND = "CASE WHEN 1 - p >= p * (1 - m) AND 1 - p >= p * m THEN 0 WHEN p * (1 - m) >= p * m THEN 1 ELSE 2 END"
for _kind, _sql in {
    "hard": f"CASE WHEN p >= 0.5 THEN {_SECOND} ELSE 0 END", "threshold": f"CASE WHEN p >= 0.45 THEN {_SECOND} ELSE 0 END",
    "soft3zone": f"CASE WHEN p < 0.35 THEN 0 WHEN p > 0.65 THEN {_SECOND} ELSE {_BLEND} END", "fullprob": _BLEND,
}.items():
    add(
        f"ml19_route_{_kind}", lambda s, d, k=_kind: ev.route(two_level(s, d), k, 0.45 if k == "threshold" else 0.5).select("sample_id", "y_true", "y_pred"),
        f", {_TWO} SELECT sample_id, y_true, {_sql} AS y_pred FROM two",
    )
add(
    "ml20_tune_route_threshold", lambda s, d: ev.tune_route_threshold(two_level(s, d)),
    f""", {_TWO}, t AS (SELECT round(0.30 + 0.02 * i, 2)::DOUBLE AS threshold FROM (SELECT unnest(range(21)) AS i)),
  a AS (SELECT threshold, avg(CASE WHEN (CASE WHEN p >= threshold THEN {_SECOND} ELSE 0 END) = y_true THEN 1.0::DOUBLE ELSE 0.0 END) AS accuracy FROM two, t GROUP BY threshold)
  SELECT {r('threshold')} AS threshold, {r('accuracy')} AS accuracy FROM a ORDER BY a.accuracy DESC, a.threshold LIMIT 1""",
)
add(
    "ml24_confidence_ensemble", lambda s, d: ev.confidence_ensemble(one(s, d, "bayes"), one(s, d), 0.55),
    """, a AS (SELECT sample_id, y_true, y_pred, greatest(p0, p1, p2) AS sure FROM predictions WHERE model = 'bayes' AND config = 'full'), b AS (SELECT sample_id, y_pred FROM predictions WHERE model = 'forest' AND config = 'full')
  SELECT a.sample_id, y_true, CASE WHEN sure < 0.55 THEN b.y_pred ELSE a.y_pred END AS y_pred, sure < 0.55 AS switched, sure < 0.55 AND a.y_pred <> b.y_pred AS changed FROM a JOIN b ON a.sample_id = b.sample_id""",
)

# ---- label quality -------------------------------------------------------------------------------

_SELF = "CASE y_true WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END"
add("lq2_self_confidence", lambda s, d: ev.self_confidence(one(s, d)).select("sample_id", "self_confidence"), f", {_ONE} SELECT sample_id, {r(_SELF)} AS self_confidence FROM one")
JOINT = f"""{_ONE}, s AS (SELECT *, {_SELF} AS sc FROM one), t AS (SELECT avg(sc) FILTER (y_true = 0) AS t0, avg(sc) FILTER (y_true = 1) AS t1, avg(sc) FILTER (y_true = 2) AS t2 FROM s),
  o AS (SELECT s.*, CASE WHEN p0 >= t0 THEN p0 ELSE -1 END AS a, CASE WHEN p1 >= t1 THEN p1 ELSE -1 END AS b, CASE WHEN p2 >= t2 THEN p2 ELSE -1 END AS c FROM s, t),
  l AS (SELECT *, CASE WHEN greatest(a, b, c) < 0 THEN NULL WHEN a = greatest(a, b, c) THEN 0 WHEN b = greatest(a, b, c) THEN 1 ELSE 2 END AS likely FROM o),
  joint AS (SELECT y_true, {', '.join(f'CASE WHEN count(likely) > 0 THEN count(*) FILTER (likely = {k}) * count(*) / CAST(count(likely) AS DOUBLE) ELSE 0.0 END AS j{k}' for k in range(3))} FROM l GROUP BY y_true)"""
add("lq3_confident_joint", lambda s, d: ev.confident_joint(one(s, d)), f", {JOINT} SELECT y_true, {', '.join(f'{r(f"j{k}")} AS j{k}' for k in range(3))} FROM joint")
ISSUES = f"""{JOINT}, n AS (SELECT y_true, floor(j0 + j1 + j2 - CASE y_true WHEN 0 THEN j0 WHEN 1 THEN j1 ELSE j2 END + 0.5) AS issues FROM joint),
  i AS (SELECT s.*, row_number() OVER (PARTITION BY s.y_true ORDER BY sc, sample_id) <= issues AS is_issue FROM s JOIN n ON s.y_true = n.y_true),
  issues AS (SELECT *, CASE WHEN is_issue THEN row_number() OVER (PARTITION BY y_true, is_issue ORDER BY sc, sample_id) END AS issue_rank FROM i)"""
add(
    "lq4_find_label_issues", lambda s, d: ev.find_label_issues(one(s, d)).select("sample_id", "y_true", "self_confidence", "is_issue", "issue_rank"),
    f", {ISSUES} SELECT sample_id, y_true, {r('sc')} AS self_confidence, is_issue, issue_rank FROM issues",
)
add(
    "lq5_quality_by_dataset", lambda s, d: ev.quality_by_dataset(ev.find_label_issues(one(s, d))),
    f", {ISSUES} SELECT source_group, count(*) AS n_samples, {r('avg(sc)')} AS avg_quality, {r('min(sc)')} AS min_quality, count(*) FILTER (is_issue) AS n_issues, {r('100.0 * count(*) FILTER (is_issue) / count(*)')} AS pct_issues,"
    f" {_MODE('y_true')} AS original_label, {_MODE('y_pred')} AS predicted_label, ({_MODE('y_true')}) = ({_MODE('y_pred')}) AS label_agrees FROM issues GROUP BY source_group",
)
_LIKELY = "CASE WHEN p0 = greatest(p0, p1, p2) THEN 0 WHEN p1 = greatest(p0, p1, p2) THEN 1 ELSE 2 END"
for _mode, _sel, _cols in (
    ("prune", "SELECT sample_id FROM issues WHERE NOT is_issue OR sample_id NOT IN (SELECT sample_id FROM issues WHERE is_issue ORDER BY sc, sample_id LIMIT (SELECT CAST(floor(0.1 * count(*)) AS BIGINT) FROM issues))", ["sample_id"]),
    ("weight", f"SELECT sample_id, {r('least(greatest(sc, 0.1), 1.0)')} AS weight FROM issues", ["sample_id", "weight"]),
    ("relabel", f"SELECT sample_id, CASE WHEN is_issue THEN {_LIKELY} ELSE y_true END AS label FROM issues", ["sample_id", "label"]),
):
    add(f"lq6_clean_labels_{_mode}", lambda s, d, m=_mode, c=_cols: ev.clean_labels(ev.find_label_issues(one(s, d)), m).select(*c), f", {ISSUES} {_sel}")
