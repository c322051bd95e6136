"""Exact p-values of rank tests against all ways to deal ranks or signs."""

import math
import random
from itertools import combinations, product

import pytest

from lacuna.functions import exact, special


def _two_sided(at, sums):
    return min(1.0, 2 * min(sum(x <= at for x in sums), sum(x >= at for x in sums)) / len(sums))


@pytest.mark.parametrize("seed", range(12))
def test_rank_tests_count_all_ways(seed):
    dice = random.Random(seed)
    m, n = dice.randint(1, 5), dice.randint(1, 6)
    values = sorted(dice.randint(0, 3) for _ in range(m + n)) if seed % 2 else list(range(m + n))
    ranks = exact.doubled_ranks([values.count(v) for v in sorted(set(values))])
    sums = [sum(c) for c in combinations(ranks, m)]
    for s in set(sums):
        assert exact.rank_sum(ranks, m, s / 2) == pytest.approx(_two_sided(s, sums), abs=1e-12)
        if seed % 2 == 0:
            assert exact.untied_u(s / 2 - m * (m + 1) / 2, m, n) == pytest.approx(_two_sided(s, sums), abs=1e-12)
    signed = [sum(r for r, plus in zip(ranks, signs, strict=True) if plus) for signs in product((0, 1), repeat=m + n)]
    for s in {x for x in signed if 2 * x <= sum(ranks)}:
        assert exact.signed_rank(ranks, s / 2) == pytest.approx(min(1.0, 2 * sum(x <= s for x in signed) / len(signed)), abs=1e-12)


@pytest.mark.parametrize(("m", "n"), [(1, 1), (2, 5), (5, 3), (4, 4), (6, 5)])
def test_two_samples_count_all_orders(m, n):
    gaps = []
    for first in combinations(range(m + n), m):
        i = j = gap = 0
        for k in range(m + n):
            i, j = i + (k in first), j + (k not in first)
            gap = max(gap, abs(i * n - j * m))
        gaps.append(gap)
    for g in {0, *gaps}:
        assert exact.two_sample_ks(g / (m * n), m, n) == pytest.approx(sum(x >= g for x in gaps) / len(gaps), abs=1e-12)


def test_tables_meet_their_limits():
    assert exact.two_sample_ks(0.05, 3000, 4000) == pytest.approx(special.kolmogorov_upper(0.05, 12e6 / 7e3)[0], rel=0.05)
    assert 0 < exact.two_sample_ks(0.9, 400, 500) < 1e-100
    z = (3000 - 4000) / math.sqrt(8 * 1000 * 1009 / 12)
    assert exact.untied_u(3000, 8, 1000) == pytest.approx(math.erfc(-z / math.sqrt(2)), rel=0.05)
    assert exact.rank_sum([1, 3], 0, 0.0) == exact.untied_u(0, 0, 5) == exact.two_sample_ks(0.0, 3, 4) == 1.0


def _panel(spark, rows):
    return spark.createDataFrame(rows, "dataset_id string, dataset_no long, row_id long, x0 double, x1 double, x2 double, x3 double, x4 double")


def test_mannwhitney_of_small_ties_and_few_missing(spark):
    from lacuna.operators import tests as ts

    dice = random.Random(4)
    small = [("small", 0, i, None if i % 3 == 0 else 1.0, float(dice.randint(0, 2)), 0.0, 0.0, 0.0) for i in range(10)]
    few = [("few", 1, i, None if i in (1, 5) else 1.0, float((i * 37) % 101), 0.0, 0.0, 0.0) for i in range(101)]
    whole = [("whole", 2, i, 1.0, float(i), 0.0, 0.0, 0.0) for i in range(5)]
    got = {r[0]: r[1] for r in ts.mannwhitney_pval(_panel(spark, small + few + whole)).collect()}
    for name, rows in (("small", small), ("few", few)):
        values = sorted(r[4] for r in rows)
        rank = {v: 2 * values.index(v) + values.count(v) + 1 for v in values}
        missing = [rank[r[4]] for r in rows if r[3] is None]
        assert got[name] == pytest.approx(_two_sided(sum(missing), [sum(c) for c in combinations([rank[r[4]] for r in rows], len(missing))]), abs=1e-12)
    assert got["whole"] == 1.0


def test_wilcoxon_of_ties_and_of_many_folds(spark):
    from lacuna.operators import evaluate as ev

    gains = {"tied": [0.1, 0.1, -0.1, 0.2, 0.3, 0.0, -0.2], "long": [((i * 29) % 61 - 27) / 100 for i in range(61)]}
    rows = [(m, c, i, 0.5 + g * (c == "full")) for m, gs in gains.items() for i, g in enumerate(gs) for c in ("full", "base")]
    got = {r["model"]: r for r in ev.wilcoxon(spark.createDataFrame(rows, "model string, config string, fold int, score double"), "full", "base").collect()}
    sizes = sorted(round(abs(g), 9) for g in gains["tied"] if g)
    rank = {s: sizes.index(s) + (sizes.count(s) + 1) / 2 for s in sizes}
    signed = [sum(rank[s] for s, plus in zip(sizes, signs, strict=True) if plus) for signs in product((0, 1), repeat=len(sizes))]
    assert got["tied"]["n"] == 6 and got["tied"]["w"] == rank[0.1] + rank[0.2]
    assert got["tied"]["p"] == pytest.approx(min(1.0, 2 * sum(x <= got["tied"]["w"] for x in signed) / len(signed)))
    assert got["long"]["n"] == 60 and 0 < got["long"]["p"] < 1
