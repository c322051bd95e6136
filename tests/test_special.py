"""Distribution tails against tabulated critical values."""

import math

import pytest

from lacuna.functions import special


@pytest.mark.parametrize(
    ("name", "args", "want"),
    [
        ("t_two_sided", (2.228, 10.0), 0.05), ("t_two_sided", (12.706, 1.0), 0.05), ("t_two_sided", (-1.96, 1e6), 0.05), ("f_upper", (161.45, 1.0, 1.0), 0.05),
        ("f_upper", (3.4928, 2.0, 20.0), 0.05), ("chi2_upper", (5.991, 2.0), 0.05), ("chi2_upper", (3.841, 1.0), 0.05), ("chi2_upper", (7.815, 3.0), 0.05),
        ("chi2_upper", (11.070, 5.0), 0.05), ("normal_two_sided", (1.95996,), 0.05), ("normal_cdf", (0.0,), 0.5), ("chi2_upper", (0.0, 4.0), 1.0),
    ],
)
def test_critical_values(name, args, want):
    assert getattr(special, name)(*args)[0] == pytest.approx(want, abs=2e-4)


def test_unknown_statistics_stay_unknown():
    assert math.isnan(special.t_two_sided(float("nan"), 5.0)[0])
    assert special.kolmogorov_upper(1.0, 1000.0)[0] < 1e-12 and special.kolmogorov_upper(0.0, 10.0)[0] == 1.0


def test_mar_panels_are_told_from_mcar(spark):
    from pyspark.sql import functions as F

    from lacuna.operators import simulate
    from lacuna.operators import tests as ts

    base = simulate.base_panel(spark, 8, 400)
    p = {w: simulate.simulate(base, w, 0.1, 3) for w in ("mcar_uniform", "mar_rank")}
    for f, column in ((ts.little_proxy, "p"), (ts.mannwhitney_pval, "X1_mannwhitney_pval")):
        got = {w: f(df).agg(F.count_if(F.col(column) < 0.01)).first()[0] for w, df in p.items()}
        assert got["mar_rank"] == 8 and got["mcar_uniform"] <= 2
    assert ts.log_pval_x1(p["mar_rank"]).agg(F.min("log_pval_X1_mask")).first()[0] > 5
    for f in (ts.levene_bonferroni, ts.mnar_ks_test, ts.normality_ks):
        assert all(0 <= r["p"] <= 1 for r in f(p["mar_rank"]).collect() if r["p"] is not None)
    assert ts.max_mask_correlation(p["mar_rank"]).where("var = 'x1'").count() == 8
