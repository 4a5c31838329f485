"""Invertible response transforms and auxiliary transforms."""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkassay.functions.mathx import normal_cdf, normal_quantile


class Base(Enum):
    LOG = "log"
    LOG2 = "log2"
    LOG10 = "log10"


@dataclass(frozen=True)
class Log:
    """y / 10^conversion, logarithm, optional negation; what has no logarithm is null, zero too unless ``limits`` gives it its
    limit, minus infinity, which has an inverse."""

    base: Base = Base.LOG10
    negate: bool = False
    conversion: int = 0
    limits: bool = False

    def forward(self, y: Column) -> Column:
        y = y / F.lit(float(10**self.conversion)) if self.conversion else y
        log = {Base.LOG: F.ln, Base.LOG2: F.log2, Base.LOG10: F.log10}[self.base]
        out = F.when(y > 0, log(y))
        if self.limits:
            out = out.when(y == 0, F.lit(float("-inf")))
        return -out if self.negate else out

    def inverse(self, y: Column) -> Column:
        y = -y if self.negate else y
        out = F.exp(y) if self.base is Base.LOG else F.pow(F.lit(2.0 if self.base is Base.LOG2 else 10.0), y)
        return out * F.lit(float(10**self.conversion)) if self.conversion else out


@dataclass(frozen=True)
class Threshold:
    """Probability that the true response exceeds a threshold, given a normal error of known size."""

    threshold: float
    std: float

    def forward(self, y: Column) -> Column:
        return normal_cdf((F.greatest(y, F.lit(1e-16)) - F.lit(float(self.threshold))) / F.lit(float(self.std)))

    def inverse(self, p: Column) -> Column:
        p = F.least(F.greatest(p, F.lit(1e-16)), F.lit(1 - 1e-16))
        return normal_quantile(p) * F.lit(float(self.std)) + F.lit(float(self.threshold))

    def after(self, log: Log | None) -> Threshold:
        """Threshold and error on the scale of a logarithm applied before."""
        import math

        if log is None:
            return self
        f = {Base.LOG: math.log, Base.LOG2: math.log2, Base.LOG10: math.log10}[log.base]
        sign = -1 if log.negate else 1
        return Threshold(*(sign * f(x / 10**log.conversion) for x in (self.threshold, self.std)))


def forward(y: Column, log: Log | None = None, threshold: Threshold | None = None) -> Column:
    y = log.forward(y) if log else y
    return threshold.after(log).forward(y) if threshold else y


def inverse(y: Column, log: Log | None = None, threshold: Threshold | None = None) -> Column:
    y = threshold.after(log).inverse(y) if threshold else y
    return log.inverse(y) if log else y


# The five z-scales of the twenty standard amino acids.
Z_SCALES = {
    "A": (0.24, -2.32, 0.60, -0.14, 1.30), "R": (3.52, 2.50, -3.50, 1.99, -0.17), "N": (3.05, 1.62, 1.04, -1.15, 1.61), "D": (3.98, 0.93, 1.93, -2.46, 0.75), "C": (0.84, -1.67, 3.71, 0.18, -2.65),
    "Q": (1.75, 0.50, -1.44, -1.34, 0.66), "E": (3.11, 0.26, -0.11, -3.04, -0.25), "G": (2.05, -4.06, 0.36, -0.82, -0.38), "H": (2.47, 1.95, 0.26, 3.90, 0.09), "I": (-3.89, -1.73, -1.71, -0.84, 0.26),
    "L": (-4.28, -1.30, -1.49, -0.72, 0.84), "K": (2.29, 0.89, -2.49, 1.49, 0.31), "M": (-2.85, -0.22, 0.47, 1.94, -0.98), "F": (-4.22, 1.94, 1.06, 0.54, -0.62), "P": (-1.66, 0.27, 1.84, 0.70, 2.00),
    "S": (2.39, -1.07, 1.15, -1.39, 0.67), "T": (0.75, -2.18, -1.12, -1.46, -0.40), "W": (-4.36, 3.94, 0.59, 3.44, -1.59), "Y": (-2.54, 2.44, 0.43, 0.04, -1.47), "V": (-2.59, -2.64, -1.54, -0.85, -0.02),
}


def z_scales(sequence: Column) -> Column:
    """Mean of each z-scale over a peptide's residues; null if a residue is unknown or there is none."""
    table = F.create_map(*[x for k, v in Z_SCALES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    rows = F.transform(F.split(F.upper(sequence), ""), lambda r: F.element_at(table, r))
    mean = lambda i: F.aggregate(rows, F.lit(0.0), lambda a, r: a + F.element_at(r, i)) / F.size(rows)
    return F.when((F.length(sequence) > 0) & ~F.exists(rows, lambda r: r.isNull()), F.array(*[mean(i) for i in range(1, 6)]))
