"""Binomial and multinomial draws against their distributions."""

import math

import numpy as np
import pytest

from lacuna.functions import draws


def _quantile(n, p, u):
    upto = 0.0
    for k in range(n + 1):
        upto += math.comb(n, k) * p**k * (1 - p) ** (n - k)
        if u < upto:
            return k
    return n


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 40])
@pytest.mark.parametrize("p", [0.05, 1 / 3, 0.5, 0.98])
def test_cells_of_few_rows(n, p):
    u = (np.arange(2000) + 1 / math.e) / 2000  # no draw lies on a step of the distributions
    got = draws.binomial(np.full(2000, n), np.full(2000, p), u)
    assert got.tolist() == [_quantile(n, p, x) for x in u]


def test_sure_and_empty_cells():
    n, p, u = np.array([0, 7, 7, 3]), np.array([0.5, 0.0, 1.0, 0.5]), np.array([0.3, 0.3, 0.3, 0.0])
    assert draws.binomial(n, p, u).tolist() == [0, 0, 7, 0]
    assert draws.multinomial(np.array([[0, 0], [0, 4]]), np.full((2, 2), 0.7)).tolist() == [[0, 0], [0, 4]]


@pytest.mark.parametrize(("n", "p"), [(40_000_000, 0.5), (2_000_000_000, 0.0049), (100_000_000, 0.89)])
def test_wide_cells_are_within_one_count(n, p):
    assert n * p * (1 - p) <= draws.TABLE_VARIANCE
    u = np.concatenate([(np.arange(999) + 0.5) / 999, [1e-6, 1 - 1e-6]])
    table, near = draws._from_table(n, p, u), draws._expanded(np.full(len(u), n), np.full(len(u), p), u)
    assert np.abs(table - near).max() <= 1


def test_resamples_keep_their_rows_and_spread_as_they_should():
    dice = np.random.default_rng(3)
    counts = np.array([5, 1, 0, 2, 12, 3, 1, 0, 6])
    got = draws.multinomial(np.tile(counts, (20_000, 1)), dice.random((20_000, 9)))
    n, share = counts.sum(), counts / counts.sum()
    assert (got.sum(axis=1) == n).all() and (got[:, counts == 0] == 0).all()
    assert np.allclose(got.mean(axis=0), counts, atol=0.08)
    assert np.allclose(np.cov(got.T), n * (np.diag(share) - np.outer(share, share)), atol=0.25)


def test_intervals_of_few_predictions(spark):
    from lacuna.operators import evaluate as ev

    rows = [("c", "five", t, p) for t, p in ((0, 0), (0, 0), (1, 0), (2, 2), (1, 1))] + [("c", "one", 2, 1), ("c", "sure", 0, 0), ("c", "sure", 1, 1)]
    got = {r["model"]: r for r in ev.bootstrap_ci(spark.createDataFrame(rows, "config string, model string, y_true int, y_pred int")).collect()}
    assert got["one"]["accuracy_low"] == got["one"]["accuracy_high"] == 0.0 and got["sure"]["accuracy_low"] == got["sure"]["accuracy_high"] == 1.0
    # four of five are right: at most one right has a chance of 0.0067, at most two of 0.058
    assert got["five"]["accuracy_low"] == pytest.approx(0.4) and got["five"]["accuracy_high"] == 1.0
