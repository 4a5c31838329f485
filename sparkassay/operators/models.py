"""Estimators on Spark ML, and those it lacks, over a feature array column.

Names map to builders so that a configuration can choose them; parameters carry the defaults of the search space.
Fitting reads the data in distributed passes; only coefficients and small cross-product matrices come to the driver.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml import Model, PipelineModel
from pyspark.ml import classification as C
from pyspark.ml import regression as R
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEED = 42


def _vectors(df: DataFrame, features: str) -> DataFrame:
    return df.withColumn("__x", array_to_vector(F.col(features).cast("array<double>")))


@dataclass
class Fitted:
    """Adds ``prediction`` (and ``probability`` of class 1 for classifiers) to a table with the feature column."""

    model: Model | None
    features: str
    classification: bool
    weights: list | None = None  # of a linear formula, its constant last, where there is no model
    width: int = 0

    def transform(self, df: DataFrame) -> DataFrame:
        """Rows without features, or with as many as the model was not fitted on, get null predictions; one pass."""
        given = F.size(self.features) == self.width
        rows = df.withColumn("__known", F.coalesce(given, F.lit(False)))
        own = F.when(F.col("__known"), F.col(self.features).cast("array<double>")).otherwise(F.array_repeat(F.lit(0.0), self.width))
        if self.weights is not None:
            out = rows.withColumn("prediction", dot(own, self.weights[:-1]) + F.lit(float(self.weights[-1])))
        else:
            out = self.model.transform(rows.withColumn("__x", array_to_vector(own)))
        extra = ["uncertainty"] if "uncertainty" in out.columns and "uncertainty" not in df.columns else []
        if self.classification:
            at = "probability" if "probability" in out.columns else "rawPrediction"
            p = F.element_at(vector_to_array(at), 2)
            out = out.withColumn("__p", p if at == "probability" else 1 / (1 + F.exp(-p)))
        seen = lambda c: F.when(F.col("__known"), F.col(c))
        return out.select(*df.columns, seen("prediction").alias("prediction"), *([seen("__p").alias("probability")] if self.classification else []), *[seen(c).alias(c) for c in extra])


@dataclass
class Estimator:
    name: str
    params: dict = field(default_factory=dict)

    def fit(self, df: DataFrame, features: str = "features", response: str = "y") -> Fitted:
        first = df.filter(F.col(features).isNotNull()).select(F.size(features)).first()
        if first is None:
            raise ValueError("no row with features to fit on")
        out = FITTERS[self.name](_vectors(df, features), features, response, **self.params)
        out.width = first[0]
        return out


def balanced(df: DataFrame, response: str) -> DataFrame:
    """Adds ``__w``: weights inverse to class frequency."""
    counts = {r[0]: r[1] for r in df.groupBy(response).count().collect()}  # one row per class
    n = sum(counts.values())
    return df.withColumn("__w", F.element_at(F.create_map(*[F.lit(v) for k, c in counts.items() for v in (k, n / (len(counts) * c))]), F.col(response)))


def _linear(df, features, response, alpha=1.0, mix=0.0, **_):
    """Ridge penalties are per row here, so alpha is divided by the row count; Lasso's already is per row."""
    if mix:
        reg, solver = alpha, "auto"
    else:
        # The solver divides a squared penalty by the response's deviation; undo that.
        x = df.agg(F.count("*").alias("n"), F.stddev_pop(response).alias("s")).first()
        reg, solver = alpha / max(1, x["n"]) * (x["s"] or 1.0), "normal"
    m = R.LinearRegression(featuresCol="__x", labelCol=response, regParam=reg, elasticNetParam=mix, standardization=False, solver=solver, maxIter=300).fit(df)
    return Fitted(m, features, False)


def _logistic(df, features, response, C_=1.0, **_):
    df = balanced(df, response)
    total = df.agg(F.sum("__w")).first()[0]
    return Fitted(C.LogisticRegression(featuresCol="__x", labelCol=response, weightCol="__w", regParam=1 / (C_ * total), standardization=False, maxIter=100).fit(df), features, True)


def _depth(max_depth: int) -> int:
    """Trees of Spark ML are at most 30 deep; the two depths of the search range beyond that mean 30."""
    if max_depth > 32:
        raise ValueError(f"max_depth of {max_depth}: at most 32")
    return min(30, int(max_depth))


def _forest(kind):
    def fit(df, features, response, max_depth=5, n_estimators=20, max_features="auto", **_):
        common = {"featuresCol": "__x", "labelCol": response, "maxDepth": _depth(max_depth), "numTrees": n_estimators, "featureSubsetStrategy": {"auto": "all"}.get(max_features, max_features), "seed": SEED}
        if kind == "c":
            return Fitted(C.RandomForestClassifier(weightCol="__w", **common).fit(balanced(df, response)), features, True)
        return Fitted(R.RandomForestRegressor(**common).fit(df), features, False)

    return fit


def _boosted(df, features, response, max_depth=3, n_estimators=20, learning_rate=0.1, **_):
    return Fitted(R.GBTRegressor(featuresCol="__x", labelCol=response, maxDepth=_depth(max_depth), maxIter=n_estimators, stepSize=learning_rate, seed=SEED).fit(df), features, False)


def _probabilistic_forest(df, features, response, max_depth=5, n_estimators=20, min_rows=1, **_):
    """Labels are probabilities: every row counts for both classes, weighted by p and 1 - p."""
    both = df.withColumn("__c", F.explode(F.array(F.lit(0.0), F.lit(1.0)))).withColumn("__w", F.when(F.col("__c") == 1, F.col(response)).otherwise(1 - F.col(response)))
    m = C.RandomForestClassifier(featuresCol="__x", labelCol="__c", weightCol="__w", maxDepth=_depth(max_depth), numTrees=n_estimators, minInstancesPerNode=min_rows, seed=SEED).fit(both.filter("__w > 0"))
    return Fitted(m, features, True)


def _ada(df, features, response, n_estimators=10, learning_rate=1.0, **_):
    """SAMME over stumps: each round re-weights rows by an expression, so rounds add projections, not copies."""
    df = df.select("__x", F.col(response).cast("double").alias(response)).persist()
    n = df.count()
    rows = df.withColumn("__w", F.lit(1.0 / n))
    stages = []
    for _i in range(n_estimators):
        tree = C.DecisionTreeClassifier(featuresCol="__x", labelCol=response, weightCol="__w", maxDepth=1, predictionCol="__t", rawPredictionCol="__r", probabilityCol="__q", seed=SEED).fit(rows)
        scored = tree.transform(rows).drop("__r", "__q")
        wrong = scored.agg((F.sum(F.when(F.col("__t") != F.col(response), F.col("__w"))) / F.sum("__w")).alias("e")).first()["e"] or 0.0
        if wrong >= 0.5:
            break
        weight = learning_rate * float(np.log((1 - wrong) / max(wrong, 1e-10)))
        stages.append((tree, weight))
        if wrong <= 1e-10:
            break
        rows = scored.withColumn("__w", F.col("__w") * F.exp(F.lit(weight) * (F.col("__t") != F.col(response)).cast("double"))).drop("__t")
    df.unpersist()
    return Fitted(Ensemble(stages), features, True)


class Ensemble:
    """Weighted vote of stumps."""

    def __init__(self, stages) -> None:
        self.stages = stages

    def transform(self, df: DataFrame) -> DataFrame:
        vote = F.lit(0.0)
        total = sum(w for _, w in self.stages) or 1.0
        for i, (tree, w) in enumerate(self.stages):
            df = tree.transform(df).drop("__r", "__q").withColumnRenamed("__t", f"__t{i}")
            vote = vote + F.col(f"__t{i}") * F.lit(w / total)
        return df.withColumn("probability", F.array(1 - vote, vote)).withColumn("probability", array_to_vector("probability")).withColumn("prediction", (vote > 0.5).cast("double"))


def _pls(df, features, response, n_components=2, **_):
    """Partial least squares from the cross products X'X and X'y, which one aggregate gives; components on the driver."""
    y = F.col(response).cast("double")
    from pyspark.ml.stat import Summarizer

    mean = df.agg(Summarizer.mean(F.col("__x")).alias("m"), F.avg(y).alias("y")).first()
    m, ym = np.array(mean["m"].toArray()), mean["y"]
    d = len(m)
    both = products(df.select(F.concat(F.col(features).cast("array<double>"), F.array(y)).alias("v")), np.append(m, ym))
    xx, xy = both[:d, :d], both[:d, d]
    rotations, loadings, scores = [], [], []
    r, a = xy.copy(), xx
    for _i in range(min(n_components, d)):
        w = r / np.linalg.norm(r)
        for p, q in zip(loadings, rotations, strict=True):
            w = w - (p @ w) * q
        t2 = w @ a @ w
        if t2 <= 1e-12:
            break
        p, c = a @ w / t2, xy @ w / t2
        rotations.append(w)
        loadings.append(p)
        scores.append(c)
        r = r - t2 * p * c
    beta = sum(c * w for c, w in zip(scores, rotations, strict=True)) if rotations else np.zeros(d)
    start = float(ym - m @ beta)
    return Fitted(None, features, False, [*beta.tolist(), start])


def products(df: DataFrame, centre: np.ndarray) -> np.ndarray:
    """Sums of products of every two dimensions of the arrays in column v, ``centre`` taken off first.

    One pass: each task adds up its rows' outer products, the matrices are summed row by row.
    """
    from pyspark.ml.stat import Summarizer

    def part(batches):
        total = np.zeros((len(centre), len(centre)))
        for batch in batches:
            if len(batch):
                x = np.stack(batch["v"].to_numpy()) - centre
                total += x.T @ x
        yield pd.DataFrame({"i": range(len(centre)), "r": list(total)})

    sums = df.mapInPandas(part, "i int, r array<double>").groupBy("i").agg(Summarizer.sum(array_to_vector("r")).alias("s")).orderBy("i").collect()
    return np.array([r["s"].toArray() for r in sums])


def dot(v: Column, weights) -> Column:
    return F.aggregate(F.zip_with(v, F.array(*[F.lit(float(b)) for b in weights]), lambda a, b: a * b), F.lit(0.0), lambda s, t: s + t)


def _fourier(d: int, gamma: float, count: int = 128):
    """Random Fourier features that approximate the radial kernel."""
    rng = np.random.default_rng(SEED)
    w, b = rng.normal(0, np.sqrt(2 * gamma), (count, d)), rng.uniform(0, 2 * np.pi, count)

    @F.pandas_udf("array<double>")
    def lift(v: pd.Series) -> pd.Series:
        if not len(v):
            return pd.Series([], dtype=object)
        return pd.Series(list(np.cos(np.stack(v.to_list()) @ w.T + b) * np.sqrt(2 / count)))

    return lift


class Lifted:
    """A linear model over random Fourier features, which follow from width and gamma."""

    def __init__(self, model, width: int, gamma: float) -> None:
        self.model, self.width, self.gamma, self.lift = model, width, gamma, _fourier(width, gamma)

    def transform(self, df: DataFrame) -> DataFrame:
        return self.model.transform(df.withColumn("__x", array_to_vector(self.lift(vector_to_array("__x")))))


def _svc(df, features, response, gamma=0.1, C_=1.0, **_):
    width = len(df.select(features).first()[0])
    lift = _fourier(width, gamma)
    rows = balanced(df.withColumn("__x", array_to_vector(lift(F.col(features).cast("array<double>")))), response).persist()
    m = C.LinearSVC(featuresCol="__x", labelCol=response, weightCol="__w", regParam=1 / (C_ * rows.count())).fit(rows)
    rows.unpersist()
    return Fitted(Lifted(m, width, gamma), features, True)


def _svr(df, features, response, gamma=0.1, C_=1.0, **_):
    """Robust (Huber) loss on lifted features stands for the insensitive tube."""
    width = len(df.select(features).first()[0])
    lift = _fourier(width, gamma)
    rows = df.withColumn("__x", array_to_vector(lift(F.col(features).cast("array<double>")))).persist()
    m = R.LinearRegression(featuresCol="__x", labelCol=response, loss="huber", regParam=1 / (C_ * rows.count()), maxIter=200).fit(rows)
    rows.unpersist()
    return Fitted(Lifted(m, width, gamma), features, False)


class Neighbours:
    """Votes or means of the nearest training rows; the training rows are the model."""

    def __init__(self, train: DataFrame, params: dict, classification: bool) -> None:
        self.train, self.params, self.classification = train, params, classification

    def transform(self, df: DataFrame) -> DataFrame:
        from sparkassay.operators.neighbours import predicted

        rows = df.withColumn("__v", vector_to_array("__x"))
        found = predicted(rows, self.train, "__v", "y", classification=self.classification, **self.params)
        out = rows.join(found, "__v").drop("__v")
        return out.withColumn("probability", array_to_vector(F.array(1 - F.col("share"), F.col("share")))) if self.classification else out


def _neighbours(classification: bool):
    def fit(df, features, response, n_neighbors=5, metric="minkowski", weights="uniform", **_):
        train = df.select(F.col(features).cast("array<double>").alias("__v"), F.col(response).cast("double").alias("y")).filter(F.col("__v").isNotNull())
        return Fitted(Neighbours(train, {"k": int(n_neighbors), "metric": metric, "weights": weights}, classification), features, classification)

    return fit


def _custom(df, features, response, path="", classification=False, **_):
    """A stored Spark ML pipeline model, used as it is."""
    return Fitted(PipelineModel.load(path), features, classification)


#: What a name in a configuration builds; calibrate adds the wrapping ones.
FITTERS = {
    "Lasso": lambda df, f, r, alpha=1.0, **k: _linear(df, f, r, alpha=alpha, mix=1.0),
    "Ridge": lambda df, f, r, alpha=1.0, **k: _linear(df, f, r, alpha=alpha),
    "OLS": lambda df, f, r, **k: _linear(df, f, r, alpha=0.0),
    "PLSRegression": _pls,
    "RandomForestRegressor": _forest("r"),
    "XGBRegressor": _boosted,
    "SVR": _svr,
    "LogisticRegression": _logistic,
    "RandomForestClassifier": _forest("c"),
    "AdaBoostClassifier": _ada,
    "SVC": _svc,
    "PRFClassifier": _probabilistic_forest,
    "CustomModel": _custom,
    "KNeighborsClassifier": _neighbours(True),
    "KNeighborsRegressor": _neighbours(False),
}
CLASSIFIERS = {"LogisticRegression", "RandomForestClassifier", "AdaBoostClassifier", "SVC", "PRFClassifier", "KNeighborsClassifier", "CalibratedClassifierCVWithVA"}
# Default search ranges; tuples of numbers are (low, high), lists are choices.
SEARCH = {
    "Lasso": {"alpha": (0.0, 2.0)},
    "Ridge": {"alpha": (0.0, 2.0)},
    "PLSRegression": {"n_components": (2, 5)},
    "RandomForestRegressor": {"max_depth": (2, 32), "n_estimators": (10, 250), "max_features": ["auto"]},
    "RandomForestClassifier": {"max_depth": (2, 32), "n_estimators": (10, 250), "max_features": ["auto"]},
    "XGBRegressor": {"max_depth": (2, 32), "n_estimators": (10, 250), "learning_rate": (0.1, 0.1)},
    "LogisticRegression": {"C_": (1.0, 1.0)},
    "AdaBoostClassifier": {"n_estimators": (3, 100), "learning_rate": (1.0, 1.0)},
    "SVC": {"gamma": (1e-4, 1e2), "C_": (1e-10, 1e2)},
    "SVR": {"gamma": (1e-4, 1e2), "C_": (1e-10, 1e2)},
    "KNeighborsClassifier": {"n_neighbors": (1, 10), "metric": ["minkowski", "euclidean", "manhattan"], "weights": ["uniform", "distance"]},
    "KNeighborsRegressor": {"n_neighbors": (1, 10), "metric": ["minkowski", "euclidean", "manhattan"], "weights": ["uniform", "distance"]},
    "PRFClassifier": {"max_depth": (2, 32), "n_estimators": (10, 250), "min_rows": (1, 5)},
}
