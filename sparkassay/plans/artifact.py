"""Models in a folder: what a fitted model consists of, each part in its own format, and a JSON that names the parts."""

from __future__ import annotations

import dataclasses
import importlib

from pyspark.sql import SparkSession

from sparkassay.operators import calibrate, models
from sparkassay.plans.config import Dataset, strict
from sparkassay.plans.pipeline import Built
from sparkassay.sources.sinks import read_json, write_json


def _save_ml(model, path: str) -> str:
    model.write().overwrite().save(path)
    return f"{type(model).__module__}.{type(model).__name__}"


def _load_ml(name: str, path: str):
    module, _, kind = name.rpartition(".")
    if not module.startswith("pyspark.ml"):
        raise ValueError(f"no Spark ML model: {name}")
    return getattr(importlib.import_module(module), kind).load(path)


def _save(model, path: str) -> dict:
    """Writes the parts below ``path`` and returns their description."""
    if isinstance(model, calibrate.Calibrated):
        parts = [{"model": _save(m, f"{path}/part{i}"), "calibrator": _save_calibrator(c, f"{path}/calibrator{i}")} for i, (m, c) in enumerate(model.parts)]
        return {"kind": "calibrated", "parts": parts, "features": model.features, "width": model.width}
    if isinstance(model, calibrate.Conformal):
        return {"kind": "conformal", "model": _save(model.model, f"{path}/model"), "interval": model.interval, "features": model.features, "width": model.width}
    out = {"kind": "fitted", "features": model.features, "classification": model.classification, "width": model.width, "weights": model.weights}
    inner = model.model
    if isinstance(inner, models.Neighbours):
        inner.train.write.mode("overwrite").parquet(f"{path}/rows")
        out["neighbours"] = inner.params
    elif isinstance(inner, models.Ensemble):
        out["stages"] = [[_save_ml(tree, f"{path}/stage{i}"), weight] for i, (tree, weight) in enumerate(inner.stages)]
    elif isinstance(inner, models.Lifted):
        out |= {"lifted": _save_ml(inner.model, f"{path}/model"), "gamma": inner.gamma, "inner": inner.width}
    elif inner is not None:
        out["ml"] = _save_ml(inner, f"{path}/model")
    return out


def _save_calibrator(c, path: str) -> dict:
    if isinstance(c, calibrate.Isotonic):
        return {"isotonic": _save_ml(c.model, path)}
    if isinstance(c, calibrate.Sigmoid):
        return {"sigmoid": [c.slope, c.start]}
    SparkSession.active().createDataFrame(list(zip(c.scores, c.low, c.high, strict=True)), "s double, low double, high double").write.mode("overwrite").parquet(path)
    return {"vennabers": True}


def _load(x: dict, path: str, spark: SparkSession):
    if x["kind"] == "calibrated":
        parts = [(_load(p["model"], f"{path}/part{i}", spark), _load_calibrator(p["calibrator"], f"{path}/calibrator{i}", spark)) for i, p in enumerate(x["parts"])]
        return calibrate.Calibrated(parts, x["features"], width=x["width"])
    if x["kind"] == "conformal":
        return calibrate.Conformal(_load(x["model"], f"{path}/model", spark), x["interval"], x["features"], width=x["width"])
    inner = None
    if "neighbours" in x:
        inner = models.Neighbours(spark.read.parquet(f"{path}/rows"), x["neighbours"], x["classification"])
    elif "stages" in x:
        inner = models.Ensemble([(_load_ml(name, f"{path}/stage{i}"), weight) for i, (name, weight) in enumerate(x["stages"])])
    elif "lifted" in x:
        inner = models.Lifted(_load_ml(x["lifted"], f"{path}/model"), x["inner"], x["gamma"])
    elif "ml" in x:
        inner = _load_ml(x["ml"], f"{path}/model")
    return models.Fitted(inner, x["features"], x["classification"], x["weights"], x["width"])


def _load_calibrator(x: dict, path: str, spark: SparkSession):
    if "isotonic" in x:
        return calibrate.Isotonic(_load_ml(x["isotonic"], path))
    if "sigmoid" in x:
        return calibrate.Sigmoid(*x["sigmoid"])
    out = calibrate.VennAbers()
    rows = spark.read.parquet(path).orderBy("s").collect()  # a row per distinct score, as fitted
    out.scores, out.low, out.high = ([r[c] for r in rows] for c in ("s", "low", "high"))
    return out


def save(built: Built, path: str) -> None:
    x = {"model": _save(built.model, f"{path}/parts"), "data": dataclasses.asdict(built.data), "scores": built.scores, "descriptor": built.descriptor, "scale": built.scale}
    write_json(x, f"{path}/built")


def load(spark: SparkSession, path: str) -> Built:
    x = read_json(f"{path}/built")
    return Built(_load(x["model"], f"{path}/parts", spark), strict(Dataset, x["data"]), x["scores"], x["descriptor"], x["scale"])


def converted(path: str, features: str, classification: bool, width: int, data: Dataset, descriptor: dict | None = None) -> Built:
    """A stored Spark ML pipeline of other making as a model of ours."""
    fitted = models.Fitted(models.PipelineModel.load(path), features, classification, width=width)
    return Built(fitted, data, {}, descriptor)
