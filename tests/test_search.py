"""Proposals of a search on a fixed surface, against draws at random."""

import math
import random

import pytest

from lacuna.functions import search

SPACE = {"one": {"n": (1, 100), "rate": (1e-4, 1.0, "log")}, "two": {"m": (0, 9), "way": ["a", "b", "c"]}}


def surface(s):
    if s["kind"] == "two":
        return 0.4 + 0.02 * s["m"] + 0.1 * (s["way"] == "b")
    return 1 - ((s["n"] - 70) / 100) ** 2 - (math.log10(s["rate"]) + 2.5) ** 2 / 16


def best(seed, trials, guided):
    rng, done = random.Random(seed), []
    for _ in range(trials):
        s = search.proposed(SPACE, done, rng, 8) if guided else search.drawn(SPACE, rng)
        done.append((s, surface(s)))
    return max(x for _, x in done), done


def test_guided_trials_beat_random_ones():
    guided, at_random = ([best(seed, 40, g)[0] for seed in range(60)] for g in (True, False))
    assert sum(g > r for g, r in zip(guided, at_random, strict=True)) > 36
    assert 1 - sum(guided) / 60 < 0.5 * (1 - sum(at_random) / 60)


def test_settings_stay_in_their_ranges():
    for s, _ in best(3, 80, True)[1]:
        if s["kind"] == "one":
            assert set(s) == {"kind", "n", "rate"} and 1 <= s["n"] <= 100 and 1e-4 <= s["rate"] <= 1.0
        else:
            assert set(s) == {"kind", "m", "way"} and 0 <= s["m"] <= 9 and s["way"] in "abc"
    assert best(5, 30, True) == best(5, 30, True)


@pytest.mark.parametrize("spec", [(1, 100), (0, 0), (1e-4, 1.0, "log"), ["a", "b", "c"]])
def test_places_and_settings_agree(spec):
    for u in (0.0, 0.3, 0.7, 1.0):
        value = search._out(spec, u)
        assert search._out(spec, search._in(spec, value)) == (pytest.approx(value) if isinstance(value, float) else value)
