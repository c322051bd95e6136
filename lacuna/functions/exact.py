"""Exact null distributions of rank statistics, as counting tables of numpy arrays (one call for each dataset).

Ranks are doubled, so that the mean ranks of ties are whole numbers. What is counted are all ways to deal the given ranks to two sides
(or signs to them), so ties need no correction.
"""

from __future__ import annotations

import math

import numpy as np


def doubled_ranks(tied: list[int]) -> list[int]:
    """Twice the mean rank of each row, from the numbers of equal rows in order of value."""
    out, before = [], 0
    for t in map(int, tied):
        out += [2 * before + t + 1] * t
        before += t
    return out


def signed_rank(doubled: list[int], w: float) -> float:
    """Two-sided p-value of the lesser sum of signed ranks: all signs of the given (doubled) ranks are equally likely."""
    ways = np.zeros(int(sum(doubled)) + 1)
    ways[0] = 1
    for r in map(int, doubled):
        ways[r:] = ways[r:] + ways[: len(ways) - r]
    return min(1.0, 2 * float(ways[: round(2 * w) + 1].sum()) / 2.0 ** len(doubled))


def rank_sum(doubled: list[int], n1: int, total: float) -> float:
    """Two-sided p-value (twice the lesser tail) of the rank sum of n1 rows: all choices of n1 of the given (doubled) ranks are equally likely."""
    if n1 <= 0 or n1 >= len(doubled):
        return 1.0
    at = round(2 * total)
    if 2 * n1 > len(doubled):  # the sums of the other side are as likely, and fewer
        n1, at = len(doubled) - n1, sum(doubled) - at
    ways = np.zeros((n1 + 1, sum(sorted(doubled)[-n1:]) + 1))
    ways[0, 0] = 1
    for r in doubled:
        ways[1:, r:] = ways[1:, r:] + ways[:-1, : ways.shape[1] - r]
    of = ways[n1]
    return min(1.0, 2 * float(min(of[: at + 1].sum(), of[at:].sum())) / float(math.comb(len(doubled), n1)))


def untied_u(u: float, n1: int, n0: int) -> float:
    """Two-sided p-value of U without ties: the coefficients of the Gaussian binomial, in whole numbers of any length."""
    few, many = sorted((int(n1), int(n0)))
    if few == 0:
        return 1.0
    ways = np.zeros(few * many + 1, dtype=object)
    ways[0] = 1
    for k in range(1, few + 1):
        if k + many < len(ways):  # times 1 - q^(many + k); the right side is taken before anything changes
            ways[k + many :] = ways[k + many :] - ways[: -(k + many)]
        for start in range(k):  # over 1 - q^k: running sums at steps of k
            ways[start::k] = np.add.accumulate(ways[start::k])
    low = math.floor(min(u, few * many - u))
    return min(1.0, 2 * int(ways[: low + 1].sum()) / math.comb(few + many, few))


def two_sample_ks(d: float, m: int, n: int) -> float:
    """The chance that two samples of m and n different values from one distribution differ by d or more.

    A path from (0, 0) to (m, n) takes the values in order. The chances of its points are carried from diagonal to diagonal, and
    what leaves the band of smaller differences is summed up: all terms are positive, so small tails keep their digits.
    """
    bound = round(d * m * n)
    if bound <= 0:
        return 1.0
    inside, low, left = np.ones(1), 0, 0.0
    for t in range(m + n):
        i = np.arange(low, low + len(inside))
        after = np.zeros(len(inside) + 1)
        after[:-1] = inside * (n - t + i) / (m + n - t)
        after[1:] += inside * (m - i) / (m + n - t)
        first = max(((t + 1) * m - bound) // (m + n) + 1, low)
        end = max(min(-((-(t + 1) * m - bound) // (m + n)), low + len(after)), first)
        left += float(after[: first - low].sum() + after[end - low :].sum())
        inside, low = after[first - low : end - low], first
        if not len(inside):
            break
    return min(1.0, left)
