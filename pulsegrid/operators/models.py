"""Frozen models as documents: written, read, held against their contract, and proved by stored rows."""

from __future__ import annotations

import json
import math
from pathlib import Path

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.functions.parse import sigmoid
from pulsegrid.operators import metrics, score
from pulsegrid.operators.fit import Fit


def to_dict(fit: Fit, l2: float) -> dict:
    """A fit as a document, on the scale of its features."""
    return {
        "family": "binomial", "link": "logit", "penalty": "ridge", "l2": float(l2), "intercept": float(fit.intercept), "coefficients": dict(zip(fit.features, map(float, fit.coefficients), strict=True)),
        "feature_order": list(fit.features), "converged": bool(fit.converged), "steps": int(fit.steps), "loss": float(fit.loss),
    }


def bundle(study: str, primary: str, models: dict[str, dict], medians: dict[str, dict[str, float]], deviations: dict[str, dict[str, float]], thresholds: dict[str, float]) -> dict:
    return {"study_id": study, "primary_model": primary, "models": models, "medians": medians, "deviations": deviations, "thresholds": thresholds}


def check_bundle(b: dict, study: str | None = None) -> None:
    """Raises ValueError unless the study fits, the primary model is there, and of each model the feature order is non-empty and
    unique, coefficients, medians and deviations have its names and are finite, deviations are positive; thresholds lie in (0, 1)."""
    if not b.get("study_id") or (study is not None and b["study_id"] != study):
        raise ValueError(f"the bundle is of study {b.get('study_id')}, not {study}")
    if not b.get("models") or b.get("primary_model") not in b["models"]:
        raise ValueError("the bundle lacks its primary model")
    for name, m in b["models"].items():
        order = list(m.get("feature_order", []))
        if not order or len(set(order)) != len(order):
            raise ValueError(f"{name}: the feature order is empty or repeats a feature")
        parts = {"coefficients": m.get("coefficients", {}), "medians": b.get("medians", {}).get(name, {}), "deviations": b.get("deviations", {}).get(name, {})}
        for part, values in parts.items():
            if set(values) != set(order):
                raise ValueError(f"{name}: {part} are not those of the feature order")
            if not all(isinstance(v, (int, float)) and math.isfinite(v) for v in values.values()):
                raise ValueError(f"{name}: {part} are not all finite")
        if not math.isfinite(m.get("intercept", math.nan)):
            raise ValueError(f"{name}: the intercept is not finite")
        if min(parts["deviations"].values()) <= 0:
            raise ValueError(f"{name}: a deviation is not positive")
    if any(not 0 < t < 1 for t in b.get("thresholds", {}).values()):
        raise ValueError("a threshold is outside (0, 1)")


def save(b: dict, path: str) -> None:
    check_bundle(b)
    Path(path).write_text(json.dumps(b, indent=1, sort_keys=True), encoding="utf-8")


def load(path: str, study: str | None = None) -> dict:
    b = json.loads(Path(path).read_text(encoding="utf-8"))
    check_bundle(b, study)
    return b


def predict(df: DataFrame, b: dict, model: str | None = None, out: str = "p") -> DataFrame:
    """``df`` with the probability of a model of the bundle after imputation by its medians; features keep their values."""
    name = model or b["primary_model"]
    m = b["models"][name]
    filled = score.impute(df.select("*", *[F.col(f).alias(f"_{f}") for f in m["feature_order"]]), {f"_{f}": b["medians"][name][f] for f in m["feature_order"]})
    z = score.linear_predictor({f"_{f}": m["coefficients"][f] for f in m["feature_order"]}, m["intercept"])
    return filled.withColumn(out, sigmoid(z)).drop(*[f"_{f}" for f in m["feature_order"]])


def make_vectors(df: DataFrame, b: dict, rows: int = 120, tie: str = "case_id") -> DataFrame:
    """``rows`` rows at even distances in order of risk (all, if there are fewer), with their probability: the test vectors of a model.

    Ranks come from running counts of the distinct scores and an order within equal ones.
    """
    p = predict(df, b)
    counts = p.filter("p is not null").groupBy("p").agg(F.count("*").cast("double").alias("c"))
    runs = metrics.running(counts, [], ["c"]).select(F.col("p").alias("_p"), (F.col("c_run") - F.col("c")).alias("_before"))
    n = p.agg(F.count("p").alias("_n"))
    ranked = p.join(runs, F.col("p") == F.col("_p")).withColumn("_at", F.col("_before") + F.row_number().over(Window.partitionBy("p").orderBy(tie)) - 1).crossJoin(F.broadcast(n))  # one row
    wanted = lambda r: F.floor(r * (F.lit(rows) - 1) / F.greatest(F.col("_n") - 1, F.lit(1)))
    # A rank is taken where an evenly spaced position falls on it or between it and the next.
    keep = (F.col("_n") <= rows) | (F.col("_at") == 0) | (wanted(F.col("_at")) > wanted(F.col("_at") - 1))
    return ranked.filter(keep).select(tie, *b["models"][b["primary_model"]]["feature_order"], "p")


def verify_vectors(vectors: DataFrame, b: dict, tolerance: float = 1e-12) -> float:
    """The largest distance between stored and new probabilities; over ``tolerance``, without rows or with a value outside [0, 1] it raises."""
    r = predict(vectors, b, out="_again").agg(F.count("*").alias("n"), F.max(F.abs(F.col("_again") - F.col("p"))).alias("most"), F.count_if(~F.coalesce(F.col("p").between(0, 1) & F.col("_again").between(0, 1), F.lit(False))).alias("bad")).first()
    if not r["n"] or r["bad"] or r["most"] > tolerance:
        raise ValueError(f"test vectors: {r['n']} rows, {r['bad']} outside [0, 1], largest distance {r['most']}")
    return float(r["most"])
