"""Imputation with frozen medians and scores of frozen logistic models, as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions.parse import sigmoid
from pulsegrid.operators.landmark import FEATURES
from pulsegrid.operators.metrics import quantiles
from pulsegrid.sources.tables import require_columns

# The frozen 18-feature model on the raw scale.
INTERCEPT = -20.759969012587476
COEFFICIENTS = {
    "age_years": -0.004412889319427417,
    "male": 0.09706734394275121,
    "bmi": -0.005088694069944814,
    "asa": 0.1375030632594083,
    "t0_map": 0.629576516838327,
    "t0_map_squared": -0.004845294345153534,
    "t0_arterial_source": 0.4987603593786726,
    "anesthesia_start_to_t0_min": -0.013873345440989672,
    "pre10_map_record_count": -0.1562701856133274,
    "pre10_last_measurement_gap_min": 0.05286543549587977,
    "pre10_last_map": -0.032917424796947294,
    "pre10_mean_map": 0.027298224006694523,
    "pre10_map_ols_slope_per_min": 0.10288632576995345,
    "recovered_by_5min": -0.4489066191515083,
    "early_auc65_0_5_mmhg_min": 0.04479466547873413,
    "early_min_map_0_5": 0.05144664737905256,
    "early_mean_map_0_5": -0.06167727991218687,
    "early_map_record_count_0_5": 0.0,
}
# The medians that fill missing features.
MEDIANS = {
    "age_years": 60.0,
    "male": 0.0,
    "bmi": 23.437499999999996,
    "asa": 2.0,
    "t0_map": 62.0,
    "t0_map_squared": 3844.0,
    "t0_arterial_source": 0.0,
    "anesthesia_start_to_t0_min": 10.0,
    "pre10_map_record_count": 2.0,
    "pre10_last_measurement_gap_min": 5.0,
    "pre10_last_map": 77.0,
    "pre10_mean_map": 81.5,
    "pre10_map_ols_slope_per_min": -1.6,
    "recovered_by_5min": 1.0,
    "early_auc65_0_5_mmhg_min": 15.0,
    "early_min_map_0_5": 60.0,
    "early_mean_map_0_5": 64.0,
    "early_map_record_count_0_5": 2.0,
}


def medians(df: DataFrame, features: tuple[str, ...] = FEATURES) -> DataFrame:
    """feature, median (exact, from running counts) of each; a feature without any value has NULL."""
    names = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features])).alias("r")
    got = quantiles(df.select(names).select("r.feature", "r.value"), ["feature"], "value", [0.5]).select("feature", F.col("q")[0].alias("median"))
    every = df.sparkSession.createDataFrame([(f,) for f in features], "feature string")
    return every.join(got, "feature", "left")


def require_some_values(df: DataFrame, features: tuple[str, ...] = FEATURES) -> None:
    """Raises ValueError naming the features that ``df`` lacks, or else those that are missing in every row."""
    require_columns(df, list(features), "the features")
    one = df.agg(*[F.count(F.nanvl(F.col(f).cast("double"), F.lit(None).cast("double"))).alias(f) for f in features]).first()
    empty = [f for f in features if not one[f]]
    if empty:
        raise ValueError(f"features without any value: {', '.join(empty)}")


def impute(df: DataFrame, values: dict[str, float] = MEDIANS, *, enforce: bool = False) -> DataFrame:
    """``df`` with NULL and NaN features filled from given medians; with ``enforce`` a feature that is absent or missing in every row
    raises, as do medians that aren't finite."""
    if not all(map(math.isfinite, values.values())):
        raise ValueError("all medians must be finite")
    if enforce:
        require_some_values(df, tuple(values))
    return df.withColumns({f: F.coalesce(F.nanvl(F.col(f).cast("double"), F.lit(None).cast("double")), F.lit(float(v))) for f, v in values.items() if f in df.columns})


def linear_predictor(coefficients: dict[str, float] = COEFFICIENTS, intercept: float = INTERCEPT) -> Column:
    if not all(map(math.isfinite, [intercept, *coefficients.values()])):
        raise ValueError("all parameters of a model must be finite")
    z = F.lit(float(intercept))
    for f, b in coefficients.items():
        z = z + F.lit(float(b)) * F.col(f)
    return z


def score(df: DataFrame, coefficients: dict[str, float] = COEFFICIENTS, intercept: float = INTERCEPT, values: dict[str, float] = MEDIANS) -> DataFrame:
    """``df`` with ``p``, the probability of the frozen model after imputation; the features of ``df`` keep their values."""
    filled = impute(df.select("*", *[F.col(f).alias(f"_{f}") for f in coefficients]), {f"_{f}": values[f] for f in coefficients})
    return filled.withColumn("p", sigmoid(linear_predictor({f"_{f}": b for f, b in coefficients.items()}, intercept))).drop(*[f"_{f}" for f in coefficients])


# Three one-feature models, as intercept and coefficient.
SIMPLE_MODELS = {
    "recovered_by_5min": (-0.6831801388214819, -1.3697796012686165),
    "early_mean_map_0_5": (7.460668540870777, -0.13818258642947592),
    "t0_map": (-0.9862779732352228, -0.00655384911698674),
}


def score_models(df: DataFrame) -> DataFrame:
    """``df`` once for each frozen model: columns ``model`` and ``p`` added; the rows are scored where they lie."""
    p = {"common18": linear_predictor({f"_{f}": b for f, b in COEFFICIENTS.items()})}
    p |= {f"simple_{f}": linear_predictor({f"_{f}": b}, a) for f, (a, b) in SIMPLE_MODELS.items()}
    filled = impute(df.select("*", *[F.col(f).alias(f"_{f}") for f in COEFFICIENTS]), {f"_{f}": MEDIANS[f] for f in COEFFICIENTS})
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), sigmoid(z).alias("p")) for m, z in p.items()]))
    return filled.withColumn("_m", each).select(*df.columns, "_m.model", "_m.p")
