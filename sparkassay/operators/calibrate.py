"""Calibrated probabilities, conformal intervals and explanations."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkassay.functions.ranking import quantile
from sparkassay.operators import select
from sparkassay.operators.models import FITTERS, Estimator, Fitted
from sparkassay.operators.split import class_folds, k_folds


class TooFew(ValueError):
    pass


def require_members(df: DataFrame, label: str, folds: int) -> None:
    least = df.groupBy(label).count().agg(F.min("count")).first()[0]
    if (least or 0) < folds:
        raise TooFew(f"a class has fewer than {folds} rows")


class Isotonic:
    """A fitted isotonic calibrator: DataFrame -> DataFrame with ``calibrated``."""

    def __init__(self, model) -> None:
        self.model = model

    def __call__(self, df: DataFrame) -> DataFrame:
        return self.model.transform(df)


def isotonic(df: DataFrame, score: str = "score", label: str = "y") -> Isotonic:
    return Isotonic(IsotonicRegression(featuresCol=score, labelCol=label, predictionCol="calibrated").fit(df.withColumn(label, F.col(label).cast("double"))))


class Sigmoid:
    """A logistic curve of the score: DataFrame -> DataFrame with ``calibrated``."""

    def __init__(self, slope: float, start: float, score: str = "score") -> None:
        self.slope, self.start, self.score = slope, start, score

    def __call__(self, df: DataFrame) -> DataFrame:
        return df.withColumn("calibrated", 1 / (1 + F.exp(-(F.col(self.score) * F.lit(self.slope) + F.lit(self.start)))))


def sigmoid(df: DataFrame, score: str = "score", label: str = "y") -> Sigmoid:
    """Platt scaling with its smoothed targets, both classes weighted in."""
    n = df.agg(F.sum(F.col(label).cast("long")).alias("p"), F.count("*").alias("n")).first()
    high, low = (n["p"] + 1) / (n["p"] + 2), 1 / (n["n"] - n["p"] + 2)
    target = F.when(F.col(label) == 1, F.lit(high)).otherwise(F.lit(low))
    vec = array_to_vector(F.array(F.col(score).cast("double")))
    rows = df.select(vec.alias("__x"), target.alias("__t")).withColumn("__c", F.explode(F.array(F.lit(0.0), F.lit(1.0)))).withColumn("__w", F.when(F.col("__c") == 1, F.col("__t")).otherwise(1 - F.col("__t")))
    m = LogisticRegression(featuresCol="__x", labelCol="__c", weightCol="__w").fit(rows)
    return Sigmoid(float(m.coefficients[0]), float(m.intercept), score)


class VennAbers:
    """Inductive Venn-ABERS: two isotonic fits per score, one with the new point in each class.

    ``fit`` aggregates by exact score; one row per distinct score comes to the driver.
    """

    def __init__(self) -> None:
        self.scores: list[float] = []
        self.low: list[float] = []
        self.high: list[float] = []

    def fit(self, df: DataFrame, score: str = "score", label: str = "y") -> VennAbers:
        rows = df.groupBy(F.col(score).cast("double").alias("s")).agg(F.count("*").alias("n"), F.sum(F.col(label).cast("double")).alias("p")).orderBy("s").collect()
        self.scores = [r["s"] for r in rows]
        n, p = [r["n"] for r in rows], [r["p"] for r in rows]
        self.low, self.high = self._with(n, p, 0.0), self._with(n, p, 1.0)
        return self

    @staticmethod
    def _pools(n: list, p: list, rising: bool) -> list[tuple]:
        """For each point, the last pool of the isotonic fit up to it: (where the pool before it ends, weight, sum)."""
        out: list[tuple] = []
        for i in range(len(n)):
            before, weight, total = i - 1, n[i], p[i]
            while before >= 0:
                end, w, t = out[before]
                if (t * weight < total * w) if rising else (t * weight > total * w):
                    break
                before, weight, total = end, weight + w, total + t
            out.append((before, weight, total))
        return out

    @classmethod
    def _with(cls, n: list, p: list, label: float) -> list[float]:
        """Isotonic value at each point with one more observation of ``label`` there: its pool takes in violating neighbours."""
        left, back = cls._pools(n, p, True), cls._pools(n[::-1], p[::-1], False)
        last, out = len(n) - 1, []
        for i in range(len(n)):
            weight, total, a, b = n[i] + 1, p[i] + label, i - 1, last - i - 1  # b counts from the end
            while True:
                if a >= 0 and left[a][2] * weight >= total * left[a][1]:
                    a, weight, total = left[a][0], weight + left[a][1], total + left[a][2]
                elif b >= 0 and back[b][2] * weight <= total * back[b][1]:
                    b, weight, total = back[b][0], weight + back[b][1], total + back[b][2]
                else:
                    break
            out.append(total / weight)
        return out

    def transform(self, df: DataFrame, score: str = "score") -> DataFrame:
        """Adds p0, p1, calibrated and uncertainty."""
        scores, low, high = self.scores, self.low, self.high

        @F.pandas_udf("p0 double, p1 double")
        def look(s: pd.Series) -> pd.DataFrame:
            at = [max(0, bisect_right(scores, x) - 1) for x in s]
            return pd.DataFrame({"p0": [low[i] for i in at], "p1": [high[i] for i in at]})

        out = df.withColumn("__va", look(F.col(score).cast("double")))
        return venn_abers_probability(out.select(*df.columns, "__va.p0", "__va.p1"))

    __call__ = transform


def venn_abers_probability(df: DataFrame) -> DataFrame:
    return df.withColumn("calibrated", F.col("p1") / (1 - F.col("p0") + F.col("p1"))).withColumn("uncertainty", F.col("p1") - F.col("p0"))


CALIBRATORS = {"isotonic": isotonic, "sigmoid": sigmoid, "vennabers": lambda df: VennAbers().fit(df)}


def _marked(df: DataFrame, features: str, label: str) -> DataFrame:
    """Folds are dealt by the row's content, so that no key need be known."""
    return df.withColumn("__key", F.md5(F.concat_ws("|", F.col(features).cast("string"), F.col(label).cast("string"))))


@dataclass
class Calibrated:
    """Classifiers with the calibrators of their scores; their means are the answer."""

    parts: list[tuple[Fitted, Callable[[DataFrame], DataFrame]]]
    features: str
    classification: bool = True
    width: int = 0

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds prediction, probability and, where the calibrators give it, uncertainty."""
        total, doubt, n = F.lit(0.0), F.lit(0.0), len(self.parts)
        out, unsure = df, False
        for i, (model, calibrator) in enumerate(self.parts):
            out = calibrator(model.transform(out).withColumn("score", F.col("probability")).drop("prediction", "probability"))
            out = out.withColumnRenamed("calibrated", f"__c{i}").drop("score", "p0", "p1")
            total = total + F.col(f"__c{i}")
            if isinstance(calibrator, VennAbers):
                out, unsure = out.withColumnRenamed("uncertainty", f"__u{i}"), True
                doubt = doubt + F.col(f"__u{i}")
        out = out.withColumn("probability", total / n).withColumn("prediction", (F.col("probability") > 0.5).cast("double"))
        return out.select(*df.columns, "prediction", "probability", *([(doubt / n).alias("uncertainty")] if unsure else []))


def calibrated_cv(df: DataFrame, estimator: Estimator, features: str = "features", label: str = "y", method: str = "isotonic", folds: int = 5, ensemble: bool = True) -> Calibrated:
    """Fit per fold and calibrate on the rest, or one calibrator on all out-of-fold scores and a refit on everything."""
    require_members(df, label, folds)
    dealt = class_folds(_marked(df, features, label), "__key", label, folds)
    parts, held = [], []
    for i in range(folds):
        model = estimator.fit(dealt.filter(F.col("_fold") != i), features, label)
        scored = model.transform(dealt.filter(F.col("_fold") == i)).select(label, F.col("probability").alias("score"))
        if ensemble:
            parts.append((model, CALIBRATORS[method](scored)))
        held.append(scored)
    if not ensemble:
        parts = [(estimator.fit(df, features, label), CALIBRATORS[method](select.union_all(held)))]
    return Calibrated(parts, features)


def conformal_width(residuals: DataFrame, residual: str = "residual", alpha: float = 0.05) -> DataFrame:
    """One row: width of the split-conformal interval, twice the (1 - alpha) quantile of absolute residuals."""
    level = quantile(residuals, F.abs(F.col(residual)), 1 - alpha)
    return residuals.sparkSession.range(1).select((2 * F.lit(level).cast("double")).alias("width"))


@dataclass
class Conformal:
    """A regressor whose answers carry the width of their interval."""

    model: Fitted
    interval: float
    features: str
    classification: bool = False
    width: int = 0

    def transform(self, df: DataFrame) -> DataFrame:
        return self.model.transform(df).withColumn("uncertainty", F.when(F.col("prediction").isNotNull(), F.lit(float(self.interval))))


def cross_conformal(df: DataFrame, estimator: Estimator, features: str = "features", label: str = "y", folds: int = 5, alpha: float = 0.05) -> Conformal:
    """A fitted model with interval widths from out-of-fold residuals."""
    dealt = k_folds(_marked(df, features, label), "__key", folds, 42)
    held = []
    for i in range(folds):
        scored = estimator.fit(dealt.filter(F.col("_fold") != i), features, label).transform(dealt.filter(F.col("_fold") == i))
        held.append(scored.select((F.col(label) - F.col("prediction")).alias("residual")))
    return Conformal(estimator.fit(df, features, label), conformal_width(select.union_all(held), alpha=alpha).first()["width"], features)


def _calibrated(df, features, response, estimator=None, method="sigmoid", n_folds=5, ensemble=True, **_):
    return calibrated_cv(df.drop("__x"), Estimator(**estimator), features, response, method, n_folds, ensemble)


def _conformal(df, features, response, estimator=None, mapie_alpha=0.05, **_):
    return cross_conformal(df.drop("__x"), Estimator(**estimator), features, response, alpha=mapie_alpha)


FITTERS |= {"CalibratedClassifierCVWithVA": _calibrated, "Mapie": _conformal}


def linear_explanation(df: DataFrame, features: str, weights: list[float], means: list[float] | None = None) -> DataFrame:
    """(feature, shap_value): mean absolute exact contribution of each feature of a linear model, largest first."""
    rows = df.select(F.posexplode(features).alias("feature", "x"))
    w = F.element_at(F.array(*map(F.lit, weights)), F.col("feature") + 1)
    centre = rows.groupBy("feature").agg(F.avg("x").alias("m")) if means is None else None
    rows = rows.join(centre, "feature") if centre is not None else rows.withColumn("m", F.element_at(F.array(*map(F.lit, means)), F.col("feature") + 1))
    return rows.groupBy("feature").agg(F.avg(F.abs(w * (F.col("x") - F.col("m")))).alias("shap_value")).orderBy(F.desc("shap_value"), "feature")


def permutation_importance(model, df: DataFrame, features: str, label: str, width: int, seed: int = 42) -> DataFrame:
    """(feature, importance): growth of mean squared error when one feature comes from another row.

    The donor value is the feature of the next row in a hashed order, attached by a hash-keyed join of ranks.
    """
    from sparkassay.functions.ranking import hash_bucket, ranked

    rows = ranked(df.withColumn("__h", F.md5(F.concat_ws(",", F.col(features).cast("string"), F.lit(str(seed))))), hash_bucket(F.col("__h")), [F.col("__h"), F.col(label)], "__r")
    n = rows.count()
    donors = rows.select((F.col("__r") % n + 1).alias("__r"), F.col(features).alias("__donor"))
    both = rows.join(donors, "__r")
    error = lambda x: x.agg(F.avg(F.pow(F.col(label) - F.col("prediction"), F.lit(2)))).first()[0]
    base = error(model.transform(df))
    out = []
    for i in range(width):
        mixed = F.concat(F.slice(features, 1, i) if i else F.array().cast("array<double>"), F.slice("__donor", i + 1, 1), F.slice(features, i + 2, width) if i + 1 < width else F.array().cast("array<double>"))
        out.append((i, error(model.transform(both.withColumn(features, mixed))) - base))
    return df.sparkSession.createDataFrame(out, "feature int, importance double").orderBy(F.desc("importance"))


def feature_sources(widths: list[tuple[str, int]]) -> Column:
    """Which descriptor, and which of its bits, a position of a composite vector comes from: struct of a column feature."""
    at, out = 0, F.lit(None)
    starts = []
    for name, width in widths:
        starts.append((name, at, width))
        at += width
    for name, start, width in reversed(starts):
        out = F.when(F.col("feature") < start + width, F.struct(F.lit(name).alias("descriptor"), (F.col("feature") - start).alias("bit"))).otherwise(out)
    return out
