"""Scores as plain aggregates.  Each function returns one row, or one per group; metrics of one kind share one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkassay.functions.ranking import running, value_bucket
from sparkassay.operators import select


def regression(y: str = "y", p: str = "p") -> list[Column]:
    """Aggregates for ``groupBy(...).agg(*regression())``."""
    a, b = F.col(y).cast("double"), F.col(p).cast("double")
    e = a - b
    zero = F.lit(0.0)
    return [
        (1 - F.var_pop(e) / F.nullif(F.var_pop(a), zero)).alias("explained_variance"),
        F.max(F.abs(e)).alias("max_error"),
        (-F.avg(F.abs(e))).alias("neg_mean_absolute_error"),
        (-F.avg(e * e)).alias("neg_mean_squared_error"),
        (-F.median(F.abs(e))).alias("neg_median_absolute_error"),
        (1 - F.sum(e * e) / F.nullif(F.var_pop(a) * F.count(a), zero)).alias("r2"),
    ]


def confusion(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """All label metrics of 0/1 truth and prediction, from one aggregate of four counts."""
    c = lambda a, b: F.count_if((F.col(y) == a) & (F.col(p) == b)).cast("double")
    x = df.agg(c(1, 1).alias("tp"), c(0, 1).alias("fp"), c(1, 0).alias("fn"), c(0, 0).alias("tn"))
    tp, fp, fn, tn = (F.col(n) for n in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn

    def share(top: Column, below: Column) -> Column:
        return F.when(below > 0, top / below).otherwise(0.0)

    def three(top: Column, rest: Column) -> Column:
        return share(2 * top, 2 * top + rest)

    out = {"accuracy": share(tp + tn, n), "balanced_accuracy": (share(tp, tp + fn) + share(tn, tn + fp)) / 2}
    per = {"precision": (share(tp, tp + fp), share(tn, tn + fn)), "recall": (share(tp, tp + fn), share(tn, tn + fp)), "f1": (three(tp, fp + fn), three(tn, fp + fn)), "jaccard": (share(tp, tp + fp + fn), share(tn, tn + fp + fn))}
    for name, (one, zero) in per.items():
        out[name] = one
        out[f"{name}_macro"] = (one + zero) / 2
        out[f"{name}_micro"] = share(tp + tn, n + fp + fn) if name == "jaccard" else share(tp + tn, n)
        out[f"{name}_weighted"] = share(one * (tp + fn) + zero * (tn + fp), n)
    return x.select(*[v.alias(k) for k, v in out.items()])


def neg_brier(y: str = "y", score: str = "score") -> Column:
    return (-F.avg(F.pow(F.col(score) - F.col(y), F.lit(2)))).alias("neg_brier_score")


def _by_score(df: DataFrame, y: str, score: str) -> DataFrame:
    """Per distinct score: positives, all, and both added up from the highest score down."""
    rows = df.groupBy(F.col(score).cast("double").alias("s")).agg(F.sum(F.col(y).cast("long")).alias("pos"), F.count("*").alias("n"))
    down = rows.withColumn("d", -F.col("s"))
    return running(down, value_bucket(down, F.col("d")), [F.col("d")], {"tp": F.col("pos"), "all": F.col("n")})


def _totals(df: DataFrame, y: str) -> tuple[int, int]:
    x = df.agg(F.sum(F.col(y).cast("long")).alias("p"), F.count("*").alias("n")).first()
    return x["p"] or 0, x["n"]


def binary(df: DataFrame, y: str = "y") -> bool:
    """Labels are 0 and 1, both present."""
    x = df.agg(F.count_distinct(y).alias("k"), F.min(y).alias("a"), F.max(y).alias("b")).first()
    return x["k"] == 2 and x["a"] == 0 and x["b"] == 1


def ranking(df: DataFrame, y: str = "y", score: str = "score", pi_zero: float = 0.1) -> DataFrame:
    """roc_auc, average_precision, auc_pr_cal and concordance_index in one row; null unless labels are 0 and 1."""
    p, n = _totals(df, y)
    if not binary(df, y):
        return df.sparkSession.range(1).select(*[F.lit(None).cast("double").alias(c) for c in ("roc_auc", "average_precision", "auc_pr_cal", "concordance_index")])
    steps = _by_score(df, y, score)
    q = n - p
    # A positive beats all negatives below it and half of those tied with it.
    tied = F.col("n") - F.col("pos")
    below = F.lit(q) - (F.col("all") - F.col("tp"))
    wins = F.sum(F.col("pos") * (below + tied * 0.5))
    precision = F.col("tp") / F.col("all")
    c = _calibration_ratio(p / n, pi_zero)
    adjusted = F.when(F.col("tp") > 0, F.col("tp") / (F.col("tp") + (F.col("all") - F.col("tp")) * F.lit(c))).otherwise(0.0)
    earlier = F.col("tp") - F.col("pos")
    gone = F.col("all") - F.col("n") - earlier
    adjusted_before = F.when(earlier > 0, earlier / (earlier + gone * F.lit(c))).otherwise(F.when(F.col("all") == F.col("n"), F.lit(1.0)).otherwise(0.0))
    return steps.agg(
        (wins / F.lit(float(p) * q)).alias("roc_auc"),
        F.sum(F.col("pos") / F.lit(float(p)) * precision).alias("average_precision"),
        F.sum(F.col("pos") / F.lit(float(p)) * (adjusted + adjusted_before) / 2).alias("auc_pr_cal"),
        (wins / F.lit(float(p) * q)).alias("concordance_index"),
    )


def _calibration_ratio(pi: float, pi_zero: float) -> float:
    pi = min(max(pi, 0.0), 0.99)
    return pi * (1 - pi_zero) / (pi_zero * (1 - pi))


def bedroc(df: DataFrame, y: str = "y", score: str = "score", tie: str = "id", alpha: float = 20.0) -> DataFrame:
    """Boltzmann-enhanced discrimination from the ranks of positives, best score first, ties by ``tie``; null unless labels
    are 0 and 1."""
    p, n = _totals(df, y)
    if not binary(df, y):
        return df.sparkSession.range(1).select(F.lit(None).cast("double").alias("bedroc"))
    ranks = running(df.withColumn("__d", -F.col(score).cast("double")), value_bucket(df, -F.col(score).cast("double")), [F.col("__d"), F.col(tie)], {"r": F.lit(1).cast("long")})
    import math

    ra = p / n
    total = F.sum(F.exp(F.lit(-alpha) * F.col("r") / F.lit(float(n))))
    random_sum = ra * (1 - math.exp(-alpha)) / (math.exp(alpha / n) - 1)
    factor = ra * math.sinh(alpha / 2) / (math.cosh(alpha / 2) - math.cosh(alpha / 2 - alpha * ra))
    return ranks.filter(F.col(y) == 1).agg((total * F.lit(factor / random_sum) + F.lit(1 / (1 - math.exp(alpha * (1 - ra))))).alias("bedroc"))


def calibration_curve(df: DataFrame, y: str = "y", score: str = "score", bins: int = 15) -> DataFrame:
    """Per uniform bin of [0, 1]: mean score and share of positives; empty bins are left out."""
    at = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("int")
    return df.groupBy(at.alias("bin")).agg(F.avg(score).alias("mean_score"), F.avg(F.col(y).cast("double")).alias("share"), F.count("*").alias("n"))


def cumulative_curve(df: DataFrame, y: str = "y", p: str = "p", bins: int = 15) -> DataFrame:
    """Calibration of continuous responses: per uniform bin of the truth's range (bin, edge, share_true, share_predicted), the
    shares of all rows up to the bin's end.  Predictions outside the range are in no bin; no rows give no bins."""
    x = df.agg(F.min(y).cast("double").alias("a"), F.max(y).cast("double").alias("b"), F.count(y).alias("n")).first()
    if not x["n"]:
        return df.sparkSession.createDataFrame([], "bin int, edge double, share_true double, share_predicted double")
    low, high = (x["a"], x["b"]) if x["a"] < x["b"] else (x["a"] - 0.5, x["b"] + 0.5)
    edges = [low + (high - low) * i / bins for i in range(bins)] + [high]
    both = select.histogram(df, y, edges).select("bin", F.col("low").alias("edge"), F.col("n").alias("t")).join(select.histogram(df, p, edges).select("bin", F.col("n").alias("q")), "bin")
    upto = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)  # over one row per bin
    return both.select("bin", "edge", *[(F.sum(c).over(upto) / F.lit(x["n"])).alias(n) for c, n in (("t", "share_true"), ("q", "share_predicted"))])


def calibration_points(df: DataFrame, y: str = "y", p: str = "p", bins: int = 15) -> DataFrame:
    """(bin, edge, share_true, share_predicted): the curve of probabilities where labels are 0 and 1 and predictions within
    0 and 1, else the cumulative one."""
    inside = df.agg(F.min(p).alias("a"), F.max(p).alias("b")).first()
    if inside["a"] is not None and 0 <= inside["a"] and inside["b"] <= 1 and binary(df, y):
        return calibration_curve(df, y, p, bins).select("bin", F.col("mean_score").alias("edge"), F.col("share").alias("share_true"), F.col("mean_score").alias("share_predicted"))
    return cumulative_curve(df, y, p, bins)


REGRESSION = ("explained_variance", "max_error", "neg_mean_absolute_error", "neg_mean_squared_error", "neg_median_absolute_error", "r2")
LABELS = tuple(f"{n}{x}" for n in ("precision", "recall", "f1", "jaccard") for x in ("", "_macro", "_micro", "_weighted"))
CLASSIFICATION = ("accuracy", "balanced_accuracy", *LABELS, "neg_brier_score", "roc_auc", "average_precision", "auc_pr_cal", "bedroc", "concordance_index")


def all_scores(df: DataFrame, classification: bool, y: str = "y", p: str = "prediction", score: str = "probability", tie: str = "key") -> DataFrame:
    """One row with every metric of the kind; rows without a prediction do not count."""
    df = df.filter(F.col(p).isNotNull())
    if not classification:
        return df.agg(*regression(y, p))
    parts = [confusion(df, y, p), df.agg(neg_brier(y, score)), ranking(df, y, score), bedroc(df, y, score, tie)]
    out = parts[0]
    for part in parts[1:]:
        out = out.crossJoin(part)  # of one row each
    return out
