"""Hyper-parameter search by racing: points spread evenly over mixed ranges, rated fold by fold; points below the median stop.

Points come from a Halton sequence with a seeded shift, so the first n points of a search are those of any longer one. All
points that are still running are rated on a fold together, by one call.
"""

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from math import exp, floor, log
from random import Random
from statistics import mean, median


@dataclass(frozen=True)
class Log:
    """A positive number, evenly spread on a logarithmic scale."""

    low: float
    high: float

    def at(self, u: float) -> float:
        return exp(log(self.low) + u * (log(self.high) - log(self.low)))


@dataclass(frozen=True)
class Linear:
    low: float
    high: float

    def at(self, u: float) -> float:
        return self.low + u * (self.high - self.low)


@dataclass(frozen=True)
class Whole:
    """An integer, both ends included."""

    low: int
    high: int

    def at(self, u: float) -> int:
        return self.low + min(floor(u * (self.high - self.low + 1)), self.high - self.low)


@dataclass(frozen=True)
class Choice:
    values: tuple

    def at(self, u: float):
        return self.values[min(floor(u * len(self.values)), len(self.values) - 1)]


@dataclass
class Trial:
    """A point, its AUC on each fold that it ran, and the fold after which it stopped (None: it ran all)."""

    point: dict
    folds: list[float] = field(default_factory=list)
    stopped: int | None = None

    @property
    def mean(self) -> float:
        return mean(self.folds)


def _primes(n: int) -> list[int]:
    found: list[int] = []
    x = 2
    while len(found) < n:
        if all(x % p for p in found):
            found.append(x)
        x += 1
    return found


def _radical_inverse(i: int, base: int) -> float:
    out, scale = 0.0, 1.0
    while i:
        scale /= base
        i, digit = divmod(i, base)
        out += digit * scale
    return out


def points(space: dict, n: int, seed: int = 42) -> list[dict]:
    """n points of the space ({name: range}), low-discrepancy in all ranges together."""
    rng = Random(seed)
    shifts = [rng.random() for _ in space]
    bases = _primes(len(space))
    return [{name: r.at((_radical_inverse(i, b) + s) % 1.0) for (name, r), b, s in zip(space.items(), bases, shifts, strict=True)} for i in range(1, n + 1)]


def race(candidates: Sequence[dict], k: int, rate: Callable[[list[dict], int], list[float]], warm_up: int = 1) -> list[Trial]:
    """Rate the points fold by fold with `rate(points, fold)`. After each fold but the last, from the `warm_up`-th on, points whose mean so
    far is below the median of the points that ran this fold stop."""
    trials = [Trial(p) for p in candidates]
    running = list(trials)
    for fold in range(k):
        for t, a in zip(running, rate([t.point for t in running], fold), strict=True):
            t.folds.append(a)
        if fold == k - 1 or fold + 1 < warm_up:
            continue
        bar = median(t.mean for t in running)
        for t in running:
            if t.mean < bar:
                t.stopped = fold
        running = [t for t in running if t.stopped is None]
    return trials


def best(trials: Sequence[Trial]) -> Trial:
    """The best mean among the points that ran all folds; the earlier point of equals."""
    return max((t for t in trials if t.stopped is None), key=lambda t: t.mean)
