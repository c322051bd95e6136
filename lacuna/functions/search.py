"""Proposals of the next trial of a search from the trials so far, by Parzen estimators of good and other trials (a few numbers, worked on where the search is driven).

A space has for each kind of model its settings: (low, high) whole numbers, (low, high, "log") positive numbers on a logarithmic scale, or a list of choices.
"""

from __future__ import annotations

import math
import random

#: Share of trials that count as good, candidates that are weighed against each other, and weight of the flat part of each estimate.
GOOD, CANDIDATES, FLAT = 0.25, 24, 1.0

Space = dict[str, dict[str, object]]


def drawn(space: Space, rng: random.Random) -> dict:
    """Settings at random."""
    kind = rng.choice(sorted(space))
    return {"kind": kind, **{k: _out(v, rng.random()) for k, v in space[kind].items()}}


def _out(spec, u: float):
    """The setting at place u (0 to 1) of its range."""
    if isinstance(spec, list):
        return spec[min(int(u * len(spec)), len(spec) - 1)]
    if len(spec) == 3:
        return math.exp(math.log(spec[0]) + u * (math.log(spec[1]) - math.log(spec[0])))
    return min(spec[0] + int(u * (spec[1] - spec[0] + 1)), spec[1])


def _in(spec, value) -> float:
    """The place of a setting in its range."""
    if isinstance(spec, list):
        return (spec.index(value) + 0.5) / len(spec)
    if len(spec) == 3:
        return (math.log(value) - math.log(spec[0])) / (math.log(spec[1]) - math.log(spec[0]))
    return (value - spec[0] + 0.5) / (spec[1] - spec[0] + 1)


class _Parzen:
    """A density on [0, 1]: normal kernels at the trials, as wide as the gaps beside them, and a flat part; for choices, counts."""

    def __init__(self, places: list[float], choices: int = 0):
        self.places, self.choices = sorted(places), choices
        least, n = 1.0 / min(100, 1 + len(places)), len(self.places)
        ends = [0.0, *self.places, 1.0]
        self.widths = [max(least, ends[i + 1] - ends[i], ends[i + 2] - ends[i + 1]) for i in range(n)]

    def density(self, x: float) -> float:
        total = FLAT
        for p, w in zip(self.places, self.widths, strict=True):
            if self.choices:
                total += self.choices * (int(p * self.choices) == int(min(x, 1 - 1e-9) * self.choices))
            else:
                inside = 0.5 * (math.erf((1 - p) / (w * math.sqrt(2))) - math.erf(-p / (w * math.sqrt(2))))
                total += math.exp(-0.5 * ((x - p) / w) ** 2) / (w * math.sqrt(2 * math.pi) * inside)
        return total / (FLAT + len(self.places))

    def draw(self, rng: random.Random) -> float:
        if rng.random() * (FLAT + len(self.places)) < FLAT:
            return rng.random()
        k = rng.randrange(len(self.places))
        while self.choices == 0 and not 0 <= (x := rng.gauss(self.places[k], self.widths[k])) <= 1:
            pass
        return self.places[k] if self.choices else x


def proposed(space: Space, trials: list[tuple[dict, float]], rng: random.Random, start: int = 5) -> dict:
    """Settings for the next trial: of candidates drawn like the good trials, the one that the good trials make likeliest against the others.

    trials: (settings, score), the greater the better.  The first ``start`` are at random.
    """
    if len(trials) < start:
        return drawn(space, rng)
    ranked = sorted(trials, key=lambda t: -t[1])
    cut = max(2, math.ceil(GOOD * len(ranked)))
    good, rest = [t[0] for t in ranked[:cut]], [t[0] for t in ranked[cut:]]
    kinds = sorted(space)
    place = lambda s: (kinds.index(s["kind"]) + 0.5) / len(kinds)
    both = lambda of, choices=0: (_Parzen([of(s) for s in good_of], choices), _Parzen([of(s) for s in rest_of], choices))
    good_of, rest_of = good, rest
    by_kind = both(place, len(kinds))
    best, chosen = -math.inf, None
    for _ in range(CANDIDATES):
        u = by_kind[0].draw(rng)
        kind = kinds[min(int(u * len(kinds)), len(kinds) - 1)]
        gain, settings = math.log(by_kind[0].density(u) / by_kind[1].density(u)), {"kind": kind}
        good_of, rest_of = ([s for s in own if s["kind"] == kind] for own in (good, rest))
        for name, spec in space[kind].items():
            one, other = both(lambda s, name=name, spec=spec: _in(spec, s[name]), len(spec) if isinstance(spec, list) else 0)
            x = one.draw(rng)
            settings[name] = _out(spec, x)
            gain += math.log(one.density(x) / other.density(x))
        if gain > best:
            best, chosen = gain, settings
    return chosen
