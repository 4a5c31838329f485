"""Descriptors by name, as a configuration gives them: ``{"name": ..., "parameters": {...}}``."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkassay.operators import features as feats
from sparkassay.operators import joins
from sparkassay.sources import readers


class NoVectors(ValueError):
    """A descriptor that gives no numbers, for an algorithm that needs them."""


#: From the key alone: parameters -> column expression.
OF_KEY: dict[str, Callable[..., Callable[[Column], Column]]] = {
    "ECFP": lambda radius=3, nBits=2048, **_: lambda k: feats.ecfp(k, radius, nBits),
    "ECFP_counts": lambda radius=3, nBits=2048, **_: lambda k: feats.ecfp(k, radius, nBits, counts=True),
    "PathFP": lambda maxPath=3, fpSize=2048, **_: lambda k: feats.path_fingerprint(k, maxPath, fpSize),
    "MAPC": lambda maxRadius=2, nPermutations=2048, **_: lambda k: feats.minhash_fingerprint(k, maxRadius, nPermutations),
    "UnscaledPhyschemDescriptors": lambda **_: feats.physchem,
    "UnscaledMAPC": lambda maxRadius=2, nPermutations=2048, **_: lambda k: feats.minhash_fingerprint(k, maxRadius, nPermutations),
    "UnscaledZScales": lambda **_: feats.z_scale_features,
}
#: Scaled by the rows they are fitted on.
SCALED = {"PhyschemDescriptors": "UnscaledPhyschemDescriptors", "MAPC_scaled": "UnscaledMAPC", "ZScales": "UnscaledZScales"}
WITHOUT_VECTORS = {"SmilesFromFile", "SmilesAndSideInfoFromFile"}


def mark(descriptor: dict) -> str:
    """The descriptor as canonical JSON: the category that a search chooses, and the key of its cache."""
    return json.dumps(descriptor, sort_keys=True)


def featurised(rows: DataFrame, descriptor: dict, key: str = "key", train: DataFrame | None = None, name: str = "features") -> DataFrame:
    """``rows`` with ``name``; null where a key has no features.

    Features are computed once per distinct key.  Scaled descriptors take mean and deviation from ``train`` (all rows,
    if none is given).
    """
    kind, own = descriptor["name"], dict(descriptor.get("parameters", {}))
    if kind in WITHOUT_VECTORS:
        raise NoVectors(kind)
    if kind in OF_KEY:
        return feats.featurised(rows, key, OF_KEY[kind](**own), name)
    if kind in SCALED or kind == "ScaledDescriptor":
        inner = own["descriptor"] if kind == "ScaledDescriptor" else {"name": SCALED[kind], "parameters": own}
        out = featurised(rows, inner, key, None, name)
        base = featurised(train, inner, key, None, name) if train is not None else out
        return joins.scaled(out, name, joins.scaler(base.filter(F.col(name).isNotNull()), name))
    if kind == "CompositeDescriptor":
        parts = own["descriptors"]
        for i, part in enumerate(parts):
            rows = featurised(rows, part, key, train, f"__f{i}")
        return rows.withColumn(name, feats.composite(*[F.col(f"__f{i}") for i in range(len(parts))])).drop(*[f"__f{i}" for i in range(len(parts))])
    if kind == "PrecomputedDescriptorFromFile":
        file = readers.read_table(rows.sparkSession, own["file"])
        table = readers.vector_file(file, own["input_column"], own["response_column"], feats.canonical(F.col(own["input_column"])))
        return rows.join(table.select(F.col("key").alias(key), F.col("features").alias(name)), key, "left")
    raise KeyError(f"no descriptor is called {kind}")
