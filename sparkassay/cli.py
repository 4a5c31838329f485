"""Command line: ``python -m sparkassay.cli optimize|build|predict|convert|schemagen|metadata|automl``."""

from __future__ import annotations

import argparse
import dataclasses
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkassay.plans import artifact, config, pipeline, search
from sparkassay.sources import readers, sinks
from sparkassay.streaming import incremental


def _read(path: str):
    return config.read(SparkSession.active().read.text(path, wholetext=True).first()[0])


def optimize(spark: SparkSession, given: config.Optimization, best_model: str | None = None, merged_model: str | None = None, best_config: str | None = None, trials: str | None = None) -> config.Build:
    """Search, choose the best trial, and write what is asked for: its configuration, its model, the model on all rows."""
    rows = pipeline.prepared(spark, given.data).persist()
    found = search.optimize(rows, given)
    chosen = search.build_config(given, search.best(found, given.settings.direction, given.settings.minimise_std_dev))
    if trials:
        sinks.append_trials(search.trial_rows(spark, found), trials)
    if best_config:
        sinks.write_json(dataclasses.asdict(chosen), best_config)
    _models(rows, chosen, best_model, merged_model)
    rows.unpersist()
    return chosen


def build(spark: SparkSession, given: config.Build, best_model: str | None = None, merged_model: str | None = None, pool: str | None = None, pool_out: str | None = None) -> None:
    """Fit as configured; with a pool also list the rows worth measuring next."""
    rows = pipeline.prepared(spark, given.data).persist()
    built = _models(rows, given, best_model, merged_model)
    if pool:
        candidates = readers.read_table(spark, pool)
        sinks.write_csv(pipeline.uncertain(built or pipeline.build(rows, given), candidates, given.data.input_column, rows, given), pool_out)
    rows.unpersist()


def _models(rows: DataFrame, given: config.Build, best_model: str | None, merged_model: str | None) -> pipeline.Built | None:
    built = None
    if best_model:
        built = pipeline.build(rows, given)
        artifact.save(built, best_model)
    if merged_model:
        artifact.save(pipeline.build(rows, given, merge=True), merged_model)
    return built


def predict(spark: SparkSession, model: str, rows: DataFrame, key: str, quantile: float | None = None) -> DataFrame:
    """Every row with its prediction; with a quantile only rows of more uncertainty, most uncertain first."""
    built = artifact.load(spark, model)
    if (aux := built.data.aux_column) and aux not in rows.columns:
        raise readers.MissingColumns([aux])
    out = built.predict_keys(rows, key)
    if quantile is None:
        return out
    from sparkassay.operators.validate import select_uncertain

    if "uncertainty" not in out.columns:
        raise ValueError("this model gives no uncertainty")
    return select_uncertain(out, "uncertainty", quantile)


def automl(spark: SparkSession, source: str, history: incremental.History, given: config.Optimization, folder: str, quorum: int = 25, threads: int = 4) -> dict[str, str]:
    """Take the waiting buckets in, then search and build anew for each task that has data enough; task -> state."""
    if quorum < 25:
        raise ValueError("a quorum of at least 25 is needed")
    incremental.run(spark, source, history, f"{folder}/checkpoint")

    def work(task: str) -> str:
        rows = history.read().filter(F.col(history.task) == task).select(history.key, history.value)
        own = pipeline.prepared(spark, given.data, rows)
        chosen = search.build_config(given, search.best(search.optimize(own, given), given.settings.direction, given.settings.minimise_std_dev))
        artifact.save(pipeline.build(own, chosen, merge=True), f"{folder}/models/{task}")
        return "processed"

    met = {r[history.task]: r["met"] for r in history.ready(quorum).collect()}  # one row per task
    states = {t: "skipped" for t, ok in met.items() if not ok}
    return states | incremental.fan_out([t for t, ok in met.items() if ok], work, threads)


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="sparkassay")
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("optimize", help="search, or build if the configuration is of a build")
    a.add_argument("--config", required=True)
    for name in ("best-model", "merged-model", "best-config", "trials", "pool", "pool-out"):
        a.add_argument(f"--{name}")
    b = sub.add_parser("build")
    b.add_argument("--config", required=True)
    for name in ("best-model", "merged-model", "pool", "pool-out"):
        b.add_argument(f"--{name}")
    c = sub.add_parser("predict")
    c.add_argument("--model", required=True)
    c.add_argument("--input-file")
    c.add_argument("--input-column", default="key")
    c.add_argument("--output", help="folder of CSV files; without it rows are printed")
    c.add_argument("--uncertainty-quantile", type=float)
    c.add_argument("keys", nargs="*", help="keys to predict, if no file is given")
    d = sub.add_parser("schemagen")
    d.add_argument("--kind", choices=["Optimization", "Build"], default="Optimization")
    e = sub.add_parser("metadata")
    e.add_argument("--model", required=True)
    f = sub.add_parser("convert")
    for name in ("pipeline", "output", "input-column", "response-column"):
        f.add_argument(f"--{name}", required=True)
    f.add_argument("--width", type=int, required=True)
    f.add_argument("--descriptor", help="JSON")
    f.add_argument("--classification", action="store_true")
    g = sub.add_parser("automl")
    for name in ("source", "folder", "config", "task", "key", "value"):
        g.add_argument(f"--{name}", required=True)
    g.add_argument("--quorum", type=int, default=25)
    x = p.parse_args(args)
    if x.command == "schemagen":
        print(json.dumps(config.json_schema(getattr(config, x.kind)), indent=1))
        return 0
    spark = SparkSession.builder.appName(f"sparkassay {x.command}").getOrCreate()
    if x.command in ("optimize", "build"):
        given = _read(x.config)
        if isinstance(given, config.Optimization):
            optimize(spark, given, x.best_model, x.merged_model, getattr(x, "best_config", None), getattr(x, "trials", None))
        else:
            build(spark, given, x.best_model, x.merged_model, x.pool, x.pool_out)
    elif x.command == "predict":
        rows = readers.read_table(spark, x.input_file) if x.input_file else readers.inline(spark, x.keys, x.input_column)
        out = predict(spark, x.model, rows, x.input_column, x.uncertainty_quantile)
        if x.output:
            sinks.write_csv(out, x.output)
        else:
            for r in out.toLocalIterator():
                print(",".join("" if v is None else f"{v:g}" if isinstance(v, float) else str(v) for v in r))
    elif x.command == "metadata":
        print(json.dumps(sinks.read_json(f"{x.model}/built"), indent=1))
    elif x.command == "convert":
        data = config.Dataset(x.input_column, x.response_column, classification=x.classification)
        artifact.save(artifact.converted(x.pipeline, "features", x.classification, x.width, data, json.loads(x.descriptor) if x.descriptor else None), x.output)
    else:
        history = incremental.History(spark, f"{x.folder}/history", x.task, x.key, x.value)
        print(json.dumps(automl(spark, x.source, history, _read(x.config), x.folder, x.quorum)))
    return 0


if __name__ == "__main__":
    sys.exit(main())
