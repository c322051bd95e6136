"""Binomial and multinomial draws by inverse distribution: pure functions of uniform draws, as numpy arrays."""

from __future__ import annotations

from statistics import NormalDist

import numpy as np

#: A table reaches so many standard deviations (and steps) from the mean; what lies beyond has a chance below 1e-14.
REACH, STEPS = 8.0, 12
#: Above this variance a quantile is expanded about the normal one (Cornish and Fisher), within one count of the table's.
TABLE_VARIANCE = 1e7


def _from_table(n: int, p: float, draws: np.ndarray) -> np.ndarray:
    """Quantiles of one binomial: its distribution by the ratios of neighbouring chances, outwards from the mode."""
    width = REACH * (n * p * (1 - p)) ** 0.5 + STEPS
    low, high, mode = max(0, int(n * p - width)), min(n, int(n * p + width) + 1), min(n, int((n + 1) * p))
    up, down = np.arange(mode, high, dtype="float64"), np.arange(mode, low, -1, dtype="float64")
    odds = p / (1 - p)
    chances = np.concatenate([np.cumprod(down / (n - down + 1) / odds)[::-1], [1.0], np.cumprod((n - up) / (up + 1) * odds)])
    upto = np.cumsum(chances)
    return low + np.minimum(np.searchsorted(upto, draws * upto[-1], side="right"), high - low)


def _expanded(n: np.ndarray, p: np.ndarray, draws: np.ndarray) -> np.ndarray:
    z = np.array([NormalDist().inv_cdf(min(max(u, 1e-15), 1 - 1e-15)) for u in draws])
    q, spread = 1 - p, np.sqrt(n * p * (1 - p))
    near = n * p + spread * z + (q - p) * (z * z - 1) / 6 + ((1 - 6 * p * q) * (z**3 - 3 * z) / 24 - (q - p) ** 2 * (2 * z**3 - 5 * z) / 36) / spread
    return np.clip(np.floor(near + 0.5), 0, n).astype("int64")


def binomial(n: np.ndarray, p: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """The least k with a chance of k or fewer above the draw, for each (n, p, draw); equal (n, p) share a table."""
    out = np.where(p >= 1, n, 0).astype("int64")
    inner = (n > 0) & (p > 0) & (p < 1)
    wide = inner & (n * p * (1 - p) > TABLE_VARIANCE)
    out[wide] = _expanded(n[wide], p[wide], draws[wide])
    at = np.flatnonzero(inner & ~wide)
    at = at[np.lexsort((p[at], n[at]))]
    for part in np.split(at, np.flatnonzero((np.diff(n[at]) != 0) | (np.diff(p[at]) != 0)) + 1):
        if len(part):
            out[part] = _from_table(int(n[part[0]]), float(p[part[0]]), draws[part])
    return out


def multinomial(counts: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """Counts of as many rows drawn with replacement, for each row of ``counts``: each cell takes a binomial share of what is left."""
    out = np.zeros(counts.shape, dtype="int64")
    rest, of = counts.sum(axis=1), counts.sum(axis=1)
    for k in range(counts.shape[1]):
        out[:, k] = binomial(rest, np.divide(counts[:, k], of, out=np.zeros(len(of)), where=of > 0), draws[:, k])
        rest, of = rest - out[:, k], of - counts[:, k]
    return out
