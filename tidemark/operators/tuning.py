"""Search for settings: a tree-structured Parzen estimator proposes them, trials that fall behind the median of a fold are cut short.

Only settings and scores are here, a few numbers for each trial; whoever calls gives a function that scores settings on a fold, as a Spark job.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np


@dataclass(frozen=True)
class Range:
    """Numbers from low to high, both included; `log`: even on a logarithmic scale; `whole`: integers."""

    low: float
    high: float
    log: bool = False
    whole: bool = False

    def value(self, u: float) -> float:
        low, high = (self.low - 0.5, self.high + 0.5) if self.whole else (self.low, self.high)
        x = math.exp(math.log(low) + u * (math.log(high) - math.log(low))) if self.log else low + u * (high - low)
        x = min(max(round(x) if self.whole else x, self.low), self.high)
        return int(x) if self.whole else float(x)

    def place(self, x: float) -> float:
        low, high = (self.low - 0.5, self.high + 0.5) if self.whole else (self.low, self.high)
        if high <= low:
            return 0.5
        return (math.log(x) - math.log(low)) / (math.log(high) - math.log(low)) if self.log else (x - low) / (high - low)


@dataclass(frozen=True)
class Choice:
    values: tuple


Space = Mapping[str, Range | Choice]


@dataclass
class Trial:
    settings: dict
    scores: list[float] = field(default_factory=list)
    cut: bool = False

    @property
    def mean(self) -> float:
        return sum(self.scores) / len(self.scores) if self.scores else -math.inf


def _normal(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.vectorize(math.erf)(x / math.sqrt(2)))


class Mixture:
    """Gaussians cut to [0, 1], one at each observation, as wide as the larger gap beside it, and a wide one in the middle."""

    def __init__(self, seen: Sequence[float]):
        at = np.sort(np.append(np.asarray(seen, float), 0.5))
        around = np.concatenate([[0.0], at, [1.0]])
        width = np.maximum(around[1:-1] - around[:-2], around[2:] - around[1:-1])
        self.at, self.width = at, np.clip(width, 1 / min(100, len(at) + 1), 1.0)
        self.width[np.searchsorted(at, 0.5)] = 1.0
        self.inside = _normal((1 - self.at) / self.width) - _normal(-self.at / self.width)

    def draw(self, rng: np.random.Generator, count: int) -> np.ndarray:
        out = []
        while len(out) < count:
            k = rng.integers(len(self.at))
            x = rng.normal(self.at[k], self.width[k])
            if 0 <= x <= 1:
                out.append(x)
        return np.array(out)

    def log_density(self, x: np.ndarray) -> np.ndarray:
        z = (x[:, None] - self.at) / self.width
        return np.log((np.exp(-0.5 * z * z) / (self.width * math.sqrt(2 * math.pi) * self.inside)).mean(1) + 1e-300)


@dataclass
class Parzen:
    """Proposes settings: at random for the first `start` trials, then those likeliest among the best `share` of trials and least likely among the rest."""

    space: Space
    seed: int = 7
    start: int = 10
    share: float = 0.25
    candidates: int = 24

    def next(self, trials: Sequence[Trial]) -> dict:
        rng = np.random.default_rng([self.seed, len(trials)])
        if len(trials) < self.start:
            return {name: s.values[rng.integers(len(s.values))] if isinstance(s, Choice) else s.value(rng.random()) for name, s in self.space.items()}
        # trials that were cut are worse than all others, the later they were cut the better
        order = sorted(trials, key=lambda t: (t.cut, -len(t.scores) if t.cut else 0, -t.mean))
        most = max(1, math.ceil(self.share * len(trials)))
        return {name: self._pick(rng, s, [t.settings[name] for t in order[:most]], [t.settings[name] for t in order[most:]]) for name, s in self.space.items()}

    def _pick(self, rng: np.random.Generator, s: Range | Choice, good: list, bad: list):
        if isinstance(s, Choice):
            weight = lambda seen: np.array([1 + sum(x == v for x in seen) for v in s.values]) / (len(seen) + len(s.values))
            a, b = weight(good), weight(bad)
            drawn = rng.choice(len(s.values), self.candidates, p=a)
            return s.values[max(drawn, key=lambda k: (a[k] / b[k], -k))]
        a, b = Mixture([s.place(x) for x in good]), Mixture([s.place(x) for x in bad])
        drawn = a.draw(rng, self.candidates)
        return s.value(float(drawn[np.argmax(a.log_density(drawn) - b.log_density(drawn))]))


def behind(trial: Trial, others: Sequence[Trial], start: int) -> bool:
    """Whether the trial's mean so far is below the median of what at least `start` earlier trials had after as many folds."""
    n = len(trial.scores)
    means = [sum(t.scores[:n]) / n for t in others if len(t.scores) >= n]
    return len(means) >= start and trial.mean < float(np.median(means))


def optimise(space: Space, score: Callable[[dict, int], float], folds: int, trials: int, seed: int = 7, start: int = 10, patience: int | None = None, prune_after: int = 5) -> list[Trial]:
    """All trials, in order; a score is of settings on a fold, and higher is better. The search ends early when `patience` trials in a row weren't better.

    The same seed and scores give the same trials. A trial that was cut has fewer scores than folds and is never the best; settings that were tried before keep their scores.
    """
    done: list[Trial] = []
    sampler, best = Parzen(space, seed, start), -1
    for _ in range(trials):
        trial = Trial(sampler.next(done))
        same = next((t for t in done if t.settings == trial.settings), None)
        if same is not None:
            trial.scores, trial.cut = list(same.scores), same.cut
        else:
            for k in range(folds):
                trial.scores.append(score(trial.settings, k))
                if k < folds - 1 and behind(trial, done, prune_after):
                    trial.cut = True
                    break
        done.append(trial)
        if not trial.cut and (best < 0 or trial.mean > done[best].mean):
            best = len(done) - 1
        if patience is not None and best >= 0 and len(done) - 1 - best >= patience:
            break
    return done


def best(trials: Sequence[Trial]) -> Trial:
    """The trial with the highest mean over all folds, the first of equals."""
    return max((t for t in trials if not t.cut), key=lambda t: t.mean)
