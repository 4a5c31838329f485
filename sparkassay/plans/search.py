"""Hyperparameter search: trials are proposed on the driver, evaluated as Spark jobs on folds of one table.

The first trials are random; later ones sample around good trials (a simple tree-structured estimator: candidates are
drawn near the best quarter, and the one most likelier there than among the rest is tried).  Equal parameter sets are
evaluated once.
"""

from __future__ import annotations

import dataclasses
import hashlib
import json
import math
import random
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkassay.operators import validate
from sparkassay.operators.metrics import CLASSIFICATION, REGRESSION, all_scores
from sparkassay.operators.models import CLASSIFIERS, SEARCH, Estimator
from sparkassay.operators.split import k_folds
from sparkassay.plans import descriptors
from sparkassay.plans.config import Build, Optimization
from sparkassay.plans.pipeline import with_descriptor


class NoTrials(RuntimeError):
    pass


@dataclass
class Trial:
    number: int
    algorithm: str
    params: dict
    scores: list[float] = field(default_factory=list)
    descriptor: dict | None = None
    found: list[dict] = field(default_factory=list)  # every metric of each fold

    @property
    def value(self) -> float:
        return sum(self.scores) / len(self.scores)

    @property
    def spread(self) -> float:
        return math.sqrt(sum((s - self.value) ** 2 for s in self.scores) / len(self.scores)) if math.isfinite(self.value) else math.inf


def propose(space: dict, rng: random.Random, good: list[dict], rest: list[dict]) -> dict:
    out = {}
    for name, choice in space.items():
        if isinstance(choice, list):
            out[name] = rng.choice([g[name] for g in good if name in g] or choice) if rng.random() < 0.7 else rng.choice(choice)
            continue
        low, high = choice
        scale = math.log if low > 0 and high / low > 100 else (lambda x: x)
        back = math.exp if scale is math.log else (lambda x: x)
        a, b = scale(low), scale(high)
        draws = [rng.uniform(a, b) for _ in range(8)]
        if good:
            width = (b - a) / 5 or 1.0
            draws += [min(b, max(a, rng.gauss(scale(rng.choice(good)[name]), width))) for _ in range(16)]
            density = lambda x, of, w=width, s=scale, n=name: sum(math.exp(-(((x - s(p[n])) / w) ** 2) / 2) for p in of) / max(1, len(of)) + 1e-9
            at = max(draws, key=lambda x: density(x, good) / density(x, rest))
        else:
            at = draws[0]
        value = back(at)
        out[name] = round(value) if isinstance(low, int) and isinstance(high, int) else min(high, max(low, value))
    return out


def evaluate(rows: DataFrame, algorithm: str, params: dict, folds: int) -> list[dict]:
    """All scores of each fold; ``rows`` carry _fold."""
    out = []
    for i in range(folds):
        model = Estimator(algorithm, params).fit(rows.filter(F.col("_fold") != i))
        scored = model.transform(rows.filter(F.col("_fold") == i)).persist()
        out.append(all_scores(scored, algorithm in CLASSIFIERS).first().asDict())
        scored.unpersist()
    return out


def scorer(classification: bool, name: str | None) -> str:
    """The metric that a search goes by; unless one is named, the area under the curve or the negative squared error."""
    name = name or ("roc_auc" if classification else "neg_mean_squared_error")
    if name not in (CLASSIFICATION if classification else REGRESSION):
        raise ValueError(f"no score of this kind is called {name}")
    return name


def optimize(rows: DataFrame, config: Optimization) -> list[Trial]:
    """All trials; ``rows`` have key, y and features, unless descriptors are to choose from.

    Features of a descriptor are computed once and kept.  A descriptor that gives no vectors ends its trials with the
    worst score; what fails for want of data in a fold does not end the search.
    """
    s = config.settings
    rng = random.Random(s.random_seed)
    folds = max(2, s.cross_validation)
    name = scorer(config.classification, s.scoring)
    dealt = k_folds(rows.filter(F.col("_split") == "train"), "key", folds, s.random_seed or 0).persist()
    kept: dict[str, DataFrame] = {}
    sign = 1 if s.direction == "maximize" else -1
    trials, seen = [], set()
    try:
        for number in range(s.n_trials):
            algorithm = rng.choice(config.algorithms)
            descriptor = rng.choice(config.descriptors) if config.descriptors else None
            own = sorted((t for t in trials if t.algorithm == algorithm), key=lambda t: -sign * t.value)
            cut = max(1, len(own) // 4) if number >= s.n_startup_trials else 0
            params = propose(config.spaces.get(algorithm) or SEARCH.get(algorithm, {}), rng, [t.params for t in own[:cut]], [t.params for t in own[cut:]])
            mark = json.dumps([algorithm, params, descriptor], sort_keys=True)
            if mark in seen:
                continue
            seen.add(mark)
            which = descriptors.mark(descriptor) if descriptor else ""
            try:
                if which not in kept:
                    kept[which] = validate.with_features(with_descriptor(dealt, descriptor, config.data.aux_column)).persist()
            except descriptors.NoVectors:
                trials.append(Trial(number, algorithm, params, [-sign * math.inf] * folds, descriptor))
                continue
            found = evaluate(kept[which], algorithm, params, folds)
            scores = [-sign * math.inf if f[name] is None or math.isnan(f[name]) else f[name] for f in found]
            trials.append(Trial(number, algorithm, params, scores, descriptor, found))
    finally:
        for df in (dealt, *kept.values()):
            df.unpersist()
    if not trials:
        raise NoTrials("no trial was evaluated")
    return trials


def best(trials: list[Trial], direction: str = "maximize", minimise_std_dev: bool = False) -> Trial:
    """Best value; with two objectives the first of the trials that no other dominates in value and spread."""
    sign = 1 if direction == "maximize" else -1
    if not minimise_std_dev:
        return max(trials, key=lambda t: (sign * t.value, -t.number))
    front = [t for t in trials if not any(sign * o.value >= sign * t.value and o.spread <= t.spread and (sign * o.value > sign * t.value or o.spread < t.spread) for o in trials)]
    return min(front, key=lambda t: t.number)


def build_config(config: Optimization, trial: Trial) -> Build:
    return Build(config.data, trial.algorithm, trial.params, trial.descriptor)


def trial_rows(spark, trials: list[Trial]) -> DataFrame:
    """Trial log as a table: one row per trial, parameters as JSON (each name with the mark of its algorithm), scores per fold."""
    rows = [(t.number, t.algorithm, json.dumps({f"{k}__{algorithm_mark(t.algorithm)}": v for k, v in t.params.items()}, sort_keys=True), json.dumps(t.descriptor, sort_keys=True), t.scores, t.value, t.spread) for t in trials]
    return spark.createDataFrame(rows, "number int, algorithm string, params string, descriptor string, scores array<double>, value double, spread double")


def metric_rows(spark, trials: list[Trial]) -> DataFrame:
    """(number, metric, fold, value): every metric of every fold, for a tracking table; names cut to 100 characters."""
    rows = [(t.number, k[:100], fold, float(v)) for t in trials for fold, scores in enumerate(t.found) for k, v in scores.items() if v is not None]
    return spark.createDataFrame(rows, "number int, metric string, fold int, value double")


def algorithm_mark(algorithm: str) -> str:
    return hashlib.md5(algorithm.encode()).hexdigest()


def merged_trials(studies: list[list[Trial]]) -> list[Trial]:
    """The trials of several studies as one, numbered on; an equal choice counts once."""
    out, seen = [], set()
    for t in [t for s in studies for t in s]:
        mark = json.dumps([t.algorithm, t.params, t.descriptor], sort_keys=True)
        if mark not in seen:
            seen.add(mark)
            out.append(dataclasses.replace(t, number=len(out)))
    return out
