"""Feature vectors: by join, by arithmetic on arrays, and by vectorised functions over molecule strings.

A feature column is an array of doubles; null means that it could not be computed.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkassay.functions import chem
from sparkassay.operators.transform import z_scales


def composite(*parts: Column) -> Column:
    """Concatenated vectors; null if any is."""
    return F.concat(*parts)


def with_auxiliary(features: Column, auxiliary: Column) -> Column:
    """Features with an auxiliary number or vector appended on the right."""
    return F.concat(features, auxiliary)


def from_strings(calculate: Callable[[str], list[float] | None]) -> Callable[[Column], Column]:
    """A vectorised function over strings from one that takes a string; failures give null."""

    @F.pandas_udf("array<double>")
    def run(keys: pd.Series) -> pd.Series:
        seen: dict = {}
        out = []
        for k in keys:
            if k not in seen:
                try:
                    seen[k] = calculate(k) if k is not None else None
                except (ValueError, KeyError, IndexError):
                    seen[k] = None
            out.append(seen[k])
        return pd.Series(out)

    return run


def ecfp(key: Column, radius: int = 3, bits: int = 2048, counts: bool = False) -> Column:
    """Circular fingerprint (or its counts) of a SMILES string."""
    return from_strings(lambda s: [float(x) for x in chem.circular(chem.parse(s), radius, bits, counts)])(key)


def path_fingerprint(key: Column, longest: int = 3, bits: int = 2048) -> Column:
    return from_strings(lambda s: [float(x) for x in chem.paths(chem.parse(s), longest, bits)])(key)


def minhash_fingerprint(key: Column, radius: int = 2, permutations: int = 2048) -> Column:
    """MinHash of atom-pair environments."""
    return from_strings(lambda s: [float(x) for x in chem.atom_pair_minhash(chem.parse(s), radius, permutations)])(key)


def physchem(key: Column) -> Column:
    """Counts and sums that follow from the graph: see chem.PROPERTIES."""
    return from_strings(lambda s: chem.properties(chem.parse(s)))(key)


def packed(bits: Column) -> Column:
    """A 0/1 vector as an array of longs of 63 bits each."""
    count = F.ceil(F.size(bits) / F.lit(63)).cast("int")
    word = lambda i: F.aggregate(F.slice(bits, i * 63 + 1, F.lit(63)), F.lit(0).cast("long"), lambda a, x: F.shiftleft(a, 1) + x.cast("long"))
    return F.when(bits.isNotNull(), F.transform(F.sequence(F.lit(0), count - 1), word))


def valid(key: Column) -> Column:
    @F.pandas_udf("boolean")
    def run(keys: pd.Series) -> pd.Series:
        return keys.map(lambda s: chem.is_valid(s))

    return run(key)


def canonical(key: Column) -> Column:
    return _strings(lambda s: chem.canonical(chem.parse(s)))(key)


def scaffold(key: Column, generic: bool = False) -> Column:
    return _strings(lambda s: chem.canonical(chem.scaffold(chem.parse(s), generic)))(key)


def _strings(f: Callable[[str], str]) -> Callable[[Column], Column]:
    @F.pandas_udf("string")
    def run(keys: pd.Series) -> pd.Series:
        def one(s):
            try:
                return f(s) if s is not None else None
            except (ValueError, KeyError, IndexError):
                return None

        return keys.map(one)

    return run


def z_scale_features(sequence: Column) -> Column:
    return z_scales(sequence)


def featurised(df: DataFrame, key: str, descriptor: Callable[[Column], Column], name: str = "features") -> DataFrame:
    """Features per distinct key, computed once and joined back."""
    made = df.select(key).distinct().withColumn(name, descriptor(F.col(key)))
    return df.join(made, key, "left")
