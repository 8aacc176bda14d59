"""Sizes of a validation sample for given precisions, from a distribution of scores."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions.parse import logit, sigmoid

Z = 1.96


def intercept_shift(df: DataFrame, rate: float, steps: int = 60) -> float:
    """What to add to logit(p) so that the mean score is ``rate``: Newton steps inside a bracket, one aggregate each."""
    if not 0 < rate < 1:
        raise ValueError("the rate must lie between 0 and 1")
    lp = df.filter(F.col("p").isNotNull()).select(logit(F.col("p")).alias("lp"))
    low, high, at = -30.0, 30.0, 0.0
    for _ in range(steps):
        q = sigmoid(F.col("lp") + F.lit(at))
        r = lp.agg(F.avg(q).alias("m"), F.avg(q * (1 - q)).alias("d")).first()
        if r["m"] is None:
            raise ValueError("no scores")
        low, high = (low, at) if r["m"] > rate else (at, high)
        ahead = at - (r["m"] - rate) / max(r["d"], 1e-300)
        ahead = ahead if low < ahead < high else (low + high) / 2
        if abs(ahead - at) < 1e-12:
            break
        at = ahead
    return at


def auroc_width(n: int, rate: float, auc: float) -> float:
    """Width of the 95 % interval of an AUROC for n rows, by the variance for exponential scores."""
    pos = max(2, round(n * rate))
    neg = n - pos
    a, b = auc / (2 - auc), 2 * auc * auc / (1 + auc)
    return 2 * Z * math.sqrt((auc * (1 - auc) + (pos - 1) * (a - auc * auc) + (neg - 1) * (b - auc * auc)) / (pos * neg))


def precision_plan(df: DataFrame, rate: float = 0.12, threshold: float = 0.15, slope_width: float = 0.20, auc: float = 0.70, auc_width: float = 0.05) -> list[tuple[str, int, float | None]]:
    """(target, required n, width): rows needed for the calibration slope, O/E within 0.9 to 1.1 and the AUROC, and the width of
    the net benefit's interval at the largest of them. Scores are shifted to the assumed event rate first."""
    shift = intercept_shift(df, rate)
    rows = df.filter(F.col("p").isNotNull()).select(logit(F.col("p")).alias("lp")).withColumn("q", sigmoid(F.col("lp") + F.lit(shift)))
    v, odds = F.col("q") * (1 - F.col("q")), threshold / (1 - threshold)
    alert = (F.col("q") >= threshold).cast("double")
    gain = alert * (F.col("q") - (1 - F.col("q")) * odds)
    m = rows.agg(F.avg(v).alias("a"), F.avg(v * F.col("lp")).alias("b"), F.avg(v * F.col("lp") * F.col("lp")).alias("c"), F.avg(alert * v * (1 + odds) ** 2).alias("within"), F.var_samp(gain).alias("between")).first()
    inverse = np.linalg.pinv(np.array([[m["a"], m["b"]], [m["b"], m["c"]]]))
    slope_n = math.ceil((2 * Z * math.sqrt(max(inverse[1, 1], 0.0)) / slope_width) ** 2)
    oe_n = math.ceil(math.ceil(max((Z / math.log(1.1)) ** 2, (Z / math.log(0.9)) ** 2)) / rate)
    # Rounding of the classes makes the width fall unevenly, so sizes are tried one by one.
    auc_n = next(n for n in range(200, 10_000_000) if auroc_width(n, rate, auc) <= auc_width)
    most = max(slope_n, oe_n, auc_n)
    width = 2 * Z * math.sqrt(((m["within"] or 0.0) + (m["between"] or 0.0)) / most)
    return [("calibration_slope", slope_n, None), ("observed_to_expected", oe_n, None), ("auroc", auc_n, None), ("largest", most, None), ("net_benefit_width_at_largest", most, round(width, 6))]
