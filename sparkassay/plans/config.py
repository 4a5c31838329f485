"""The declarative pipeline: configurations as data classes, read strictly from JSON."""

from __future__ import annotations

import dataclasses
import json
from dataclasses import dataclass, field
from typing import Any


class UnknownKeys(ValueError):
    pass


@dataclass(frozen=True)
class Dataset:
    """What to read and how to prepare it."""

    input_column: str
    response_column: str
    training_dataset_file: str | None = None
    test_dataset_file: str | None = None
    aux_column: str | None = None
    classification: bool = False
    deduplication: str = "KeepMedian"
    split: str = "NoSplitting"
    split_params: dict = field(default_factory=dict)
    log: dict | None = None
    threshold: dict | None = None
    vector_column: str | None = None
    molecules: bool = False
    reactions: bool = False


@dataclass(frozen=True)
class Settings:
    """Defaults of a search."""

    cross_validation: int = 5
    direction: str = "maximize"
    minimise_std_dev: bool = False
    n_trials: int = 300
    n_startup_trials: int = 50
    random_seed: int | None = None
    scoring: str | None = None


@dataclass(frozen=True)
class Optimization:
    data: Dataset
    algorithms: list[str]
    settings: Settings = field(default_factory=Settings)
    spaces: dict[str, dict] = field(default_factory=dict)
    descriptors: list[dict] = field(default_factory=list)

    @property
    def classification(self) -> bool:
        """What kind of task it is follows from the algorithms, which must agree."""
        from sparkassay.operators.models import CLASSIFIERS

        kinds = {a in CLASSIFIERS for a in self.algorithms}
        if len(kinds) != 1:
            raise ValueError("algorithms of one kind are needed, classifiers or regressors")
        return kinds.pop()


@dataclass(frozen=True)
class Build:
    data: Dataset
    algorithm: str
    params: dict = field(default_factory=dict)
    descriptor: dict | None = None


def strict(kind: type, values: dict[str, Any]):
    """An instance from a dictionary; unknown keys are an error, not ignored."""
    names = {f.name for f in dataclasses.fields(kind)}
    if unknown := sorted(set(values) - names):
        raise UnknownKeys(f"{kind.__name__}: {', '.join(unknown)}")
    return kind(**values)


def read(text: str) -> Optimization | Build:
    x = json.loads(text)
    x["data"] = strict(Dataset, x["data"])
    if "algorithms" in x:
        x["settings"] = strict(Settings, x.get("settings", {}))
        return strict(Optimization, x)
    return strict(Build, x)


def write(config: Optimization | Build) -> str:
    return json.dumps(dataclasses.asdict(config), indent=1)


def json_schema(kind: type) -> dict:
    """JSON Schema (2019-09) of a configuration class, unknown properties refused."""
    types = {"str": "string", "int": "integer", "float": "number", "bool": "boolean"}

    def of(name: str) -> dict:
        for other in (Dataset, Settings):
            if name == other.__name__:
                return json_schema(other)
        parts = [p.strip() for p in name.split("|")]
        known = [types.get(p, "object" if p.startswith("dict") else "array" if p.startswith("list") else "null") for p in parts]
        return {"type": known[0] if len(known) == 1 else known}

    fields = dataclasses.fields(kind)
    required = [f.name for f in fields if f.default is dataclasses.MISSING and f.default_factory is dataclasses.MISSING]
    return {"$schema": "https://json-schema.org/draft/2019-09/schema", "title": kind.__name__, "type": "object", "properties": {f.name: of(str(f.type)) for f in fields}, "required": required, "additionalProperties": False}
