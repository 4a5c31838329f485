"""Prepare, build and predict: one logical plan from source to scored rows."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkassay.functions.mathx import vector, without_reaction_arrow
from sparkassay.functions.ranking import ranked, value_bucket
from sparkassay.operators import calibrate, dedup, features, joins, metrics, select, split, transform, validate  # noqa: F401 - calibrate registers estimators
from sparkassay.operators.models import CLASSIFIERS, Estimator, Fitted
from sparkassay.plans import descriptors
from sparkassay.plans.config import Build, Dataset
from sparkassay.sources.readers import numbered, read_table


def transforms(data: Dataset) -> tuple[transform.Log | None, transform.Threshold | None]:
    log = transform.Log(transform.Base(data.log.get("base", "log10")), data.log.get("negate", False), data.log.get("conversion") or 0) if data.log else None
    return log, transform.Threshold(**data.threshold) if data.threshold else None


def _split(rows: DataFrame, data: Dataset) -> DataFrame:
    """Rows in ``_line`` order are in order of time."""
    own, kind = dict(data.split_params), data.split
    if kind == "NoSplitting":
        return split.no_split(rows)
    if kind == "Random":
        return split.random_split(rows, "key", **own)
    if kind == "Temporal":
        n = rows.count()
        order = ranked(rows, value_bucket(rows, F.col("_line")), [F.col("_line")], "__rank")
        return order.withColumn("_split", F.when(F.col("__rank") <= math.floor(n * (1 - own.get("fraction", 0.2)) + 1e-9), "train").otherwise("test")).drop("__rank")
    if kind == "Stratified":
        return split.stratified_split(rows, "key", "y", binned=not data.classification, **own)
    if kind == "Predefined":
        return split.predefined_split(rows, own["column_name"])
    if kind == "KFold":
        return split.k_folds(rows, "key", own.get("n_splits", 5), own.get("seed", 1)).withColumn("_split", F.when(F.col("_fold") == 0, "test").otherwise("train")).drop("_fold")
    if kind == "ScaffoldSplit":
        generic, cluster = own.get("make_scaffold_generic", True), own.get("butina_cluster", 0.4)
        rows = features.featurised(rows, "key", lambda k: features.scaffold(k, generic), "__core")
        bits = None
        if cluster > 0:
            rows = features.featurised(rows, "__core", lambda k: features.ecfp(k, 2, 2048), "__fp")
            rows, bits = rows.withColumn("__bits", features.packed(F.col("__fp"))).drop("__fp"), "__bits"
        return split.scaffold_split(rows, "key", "y", "__core", data.classification, cluster, bits, own.get("bins", "fd_merge"), seed=own.get("random_state") or 42).drop("__core", "__bits")
    raise KeyError(f"no split is called {kind}")


def prepared(spark: SparkSession, data: Dataset, train: DataFrame | None = None, test: DataFrame | None = None) -> DataFrame:
    """key, y, auxiliary, features and _split: read, drop missing, collapse (train only), split, merge, transform."""
    train = train if train is not None else read_table(spark, data.training_dataset_file)
    test = test if test is not None else read_table(spark, data.test_dataset_file) if data.test_dataset_file else None
    wanted = [c for c in (data.input_column, data.response_column, data.aux_column, data.vector_column) if c]

    def clean(df: DataFrame) -> DataFrame:
        flags = [c for c in [data.split_params.get("column_name")] if c and c in df.columns and c not in wanted]
        names = wanted
        df = df.select(*wanted, *flags)
        df = validate.drop_missing(numbered(df), names)
        df = validate.read_response(df, data.response_column, data.classification, "_line")
        key = F.col(data.input_column).cast("string")
        if data.reactions:
            key = without_reaction_arrow(key)
        df = df.withColumns({"_read": key, "y": F.col(data.response_column)})
        if data.molecules:  # rows whose molecule cannot be read go; others are compared by their canonical form
            df = df.filter(features.valid(F.col("_read")))
        return df.withColumn("key", features.canonical(F.col("_read")) if data.molecules else F.col("_read"))

    rows = clean(train)
    keys = ["key", *([data.aux_column] if data.aux_column else [])]
    flag = data.split_params.get("column_name") if data.split == "Predefined" else None
    extra = list(dict.fromkeys([*([data.vector_column] if data.vector_column else []), *([flag] if flag else [])]))
    keeps = data.deduplication in ("KeepFirst", "KeepLast", "KeepRandom", "KeepAllNoDeduplication")
    if data.deduplication == "KeepAllNoDeduplication":
        rows = rows.select(*keys, "_read", "y", "_line", *extra)
    elif keeps:
        rows = dedup.STRATEGIES[data.deduplication](rows.select(*keys, "_read", "y", "_line", *extra), keys, ["_line"])
    else:
        first = rows.groupBy(*keys).agg(F.min("_line").alias("_line"), *[F.min_by(c, "_line").alias(c) for c in ("_read", *extra)])
        kept = dedup.STRATEGIES[data.deduplication](rows, keys, "y")
        if data.classification and data.deduplication in ("KeepAvg", "KeepMedian"):
            kept = kept.withColumn("y", (F.col("y") >= 0.5).cast("double"))
        rows = kept.join(first, keys)
    rows = _split(rows, data).withColumn("key", select.representative_key(F.col("_read"), F.col("key"), keeps))
    if test is not None:
        extra = [c for c in extra if c in test.columns]
        rows = rows.unionByName(clean(test).select(*keys, "y", *extra).withColumn("_split", F.lit("test")), allowMissingColumns=True)
    rows = rows.drop("_line", "_read")
    log, threshold = transforms(data)
    if log or threshold:
        rows = validate.finite(rows.withColumn("y", transform.forward(F.col("y"), log, threshold)), "y")
    if data.vector_column:
        kind = dict(rows.dtypes)[data.vector_column]
        rows = rows.withColumn("features", vector(F.col(data.vector_column)) if kind == "string" else F.col(data.vector_column).cast("array<double>"))
    return rows


def with_descriptor(rows: DataFrame, descriptor: dict | None, auxiliary: str | None = None) -> DataFrame:
    """Rows with features: those of the descriptor (or those that they have), an auxiliary value on their right."""
    if descriptor:
        train = rows.filter(F.col("_split") == "train") if "_split" in rows.columns else None
        rows = descriptors.featurised(rows, descriptor, "key", train)
    if auxiliary:
        kind = dict(rows.dtypes)[auxiliary]
        own = F.col(auxiliary).cast("array<double>") if kind.startswith("array") else F.array(F.col(auxiliary).cast("double"))
        rows = rows.withColumn("features", features.with_auxiliary(F.col("features").cast("array<double>"), own))
    return rows


@dataclass
class Built:
    """A fitted model with what it needs to answer on the original scale."""

    model: Fitted
    data: Dataset
    scores: dict
    descriptor: dict | None = None
    scale: list | None = None  # mean and deviation per dimension of a scaled descriptor

    def predict(self, df: DataFrame) -> DataFrame:
        """Predictions (probability of class 1 for classifiers), null where features are; responses and their uncertainty
        go back through the transforms in reverse order."""
        out = self.model.transform(df)
        if self.model.classification:
            return out
        back = lambda c: transform.inverse(F.col(c), *transforms(self.data))
        return out.withColumns({c: back(c) for c in ("prediction", "uncertainty") if c in out.columns})

    def predict_keys(self, df: DataFrame, key: str) -> DataFrame:
        """Every row of ``df`` with its prediction; null where the key is missing, cannot be read or has no features."""
        own = F.col(key).cast("string")
        rows = df.withColumn("key", features.canonical(own) if self.data.molecules else own)
        if self.descriptor:
            rows = _unscaled(rows, self.descriptor)
            if self.scale:
                rows = joins.scaled(rows, "features", df.sparkSession.createDataFrame([(i, m, s) for i, (m, s) in enumerate(self.scale)], "dim int, mean double, std double"))
        rows = with_descriptor(rows, None, self.data.aux_column)
        return self.predict(rows).drop(*[c for c in ("key", "features") if c not in df.columns])


def _inner(descriptor: dict) -> dict | None:
    """What a scaled descriptor scales; None for others."""
    if descriptor["name"] == "ScaledDescriptor":
        return descriptor["parameters"]["descriptor"]
    if descriptor["name"] in descriptors.SCALED:
        return {"name": descriptors.SCALED[descriptor["name"]], "parameters": descriptor.get("parameters", {})}
    return None


def _unscaled(rows: DataFrame, descriptor: dict) -> DataFrame:
    return descriptors.featurised(rows, _inner(descriptor) or descriptor)


def build(rows: DataFrame, config: Build, merge: bool = False) -> Built:
    """Featurise, drop what has no features, fit on the training rows (or, merged, on all) and score train and test."""
    scale = None
    if config.descriptor:
        rows = _unscaled(rows, config.descriptor)
        if _inner(config.descriptor):
            fitted = joins.scaler(rows.filter((F.col("_split") == "train") & F.col("features").isNotNull()), "features")
            scale = [(r["mean"], r["std"]) for r in fitted.orderBy("dim").collect()]  # one row per dimension
            rows = joins.scaled(rows, "features", fitted)
    rows = validate.with_features(with_descriptor(rows, None, config.data.aux_column)).persist()
    train = rows if merge else rows.filter(F.col("_split") == "train")
    model = Estimator(config.algorithm, config.params).fit(train)
    scored = model.transform(rows).persist()
    classification = config.algorithm in CLASSIFIERS
    found = {}
    for part in ("train", "test"):
        own = scored.filter(F.col("_split") == part)
        if not own.isEmpty():
            found[part] = metrics.all_scores(own, classification).first().asDict()
    scored.unpersist()
    rows.unpersist()
    return Built(model, config.data, found, config.descriptor, scale)


def uncertain(built: Built, pool: DataFrame, key: str, rows: DataFrame | None = None, config: Build | None = None, quantile: float = 0.5) -> DataFrame:
    """Candidates for measurement: rows of the pool above the quantile of uncertainty, most uncertain first.

    A model that gives no uncertainty is wrapped in one that does, fitted anew on ``rows``.
    """
    out = built.predict_keys(pool, key)
    if "uncertainty" not in out.columns:
        inner = {"name": config.algorithm, "params": config.params}
        wrapped = ("CalibratedClassifierCVWithVA", {"estimator": inner, "method": "vennabers"}) if built.model.classification else ("Mapie", {"estimator": inner})
        out = build(rows, Build(config.data, *wrapped, config.descriptor), merge=True).predict_keys(pool, key)
    return validate.select_uncertain(out, "uncertainty", quantile)
