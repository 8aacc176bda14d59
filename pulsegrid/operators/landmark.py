"""Index events on harmonised series, and windows of features and outcomes around them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Windows:
    """Times in minutes: search (after, until], features from pre before to landmark after t0, outcome until horizon after t0."""

    threshold: float = 65.0
    search_after: float = 3.0
    search_until: float = 30.0
    pre: float = 10.0
    landmark: float = 5.0
    horizon: float = 30.0
    alert_auc: float = 50.0
    persistent_after: float = 10.0
    high_burden_auc: float = 75.0
    grid: float | None = 5.0  # expected distance of points; None: any points count
    least_points: int = 5
    largest_gap: float = 10.0


FINE = Windows(grid=None, least_points=2, largest_gap=5.0)

FEATURES = (
    "age_years", "male", "bmi", "asa", "t0_map", "t0_map_squared", "t0_arterial_source", "anesthesia_start_to_t0_min", "pre10_map_record_count",
    "pre10_last_measurement_gap_min", "pre10_last_map", "pre10_mean_map", "pre10_map_ols_slope_per_min", "recovered_by_5min",
    "early_auc65_0_5_mmhg_min", "early_min_map_0_5", "early_mean_map_0_5", "early_map_record_count_0_5",
)


def find_t0(series: DataFrame, w: Windows = Windows()) -> DataFrame:
    """case_id, t0, t0_map, t0_source: the first point below the threshold in the search window. Cases without one are absent."""
    low = series.filter((F.col("time_min") > w.search_after) & (F.col("time_min") <= w.search_until) & (F.col("map") < w.threshold))
    return low.groupBy("case_id").agg(F.min("time_min").alias("t0"), F.min_by("map", "time_min").alias("t0_map"), F.min_by("source", "time_min").alias("t0_source"))


def _near(x: Column, y: float) -> Column:
    return F.abs(x - y) <= 1e-9


def windows(series: DataFrame, t0: DataFrame | None = None, w: Windows = Windows()) -> DataFrame:
    """One row per case with an index event: features before and shortly after it, the early alert and the later outcome.

    With ``t0`` (case_id, t0) the windows lie around given events, and every event has a row even if the series has no point;
    else the event is found in the series itself. All windows come from one aggregate over points sorted within their
    case: neighbours of a point inside a window are its neighbours in the series, so adjacent pairs need no second pass. The
    only shuffle is by case, and a case holds no more rows than cells. Nothing after the landmark enters the
    features. Outcomes and alerts are NULL where they can't be evaluated.
    """
    if t0 is None:
        hit = (F.col("time_min") > w.search_after) & (F.col("time_min") <= w.search_until) & (F.col("map") < w.threshold)
        s = series.withColumn("t0", F.min(F.when(hit, F.col("time_min"))).over(Window.partitionBy("case_id"))).filter(F.col("t0").isNotNull())
    else:
        s = t0.select("case_id", "t0").join(series, "case_id", "left")
    rel = F.col("time_min") - F.col("t0")
    inside = rel.between(-w.pre - 1e-9, w.horizon + 1e-9)
    s = s.withColumn("rel", rel)
    s = s.filter(inside) if t0 is None else s.withColumn("map", F.when(inside, F.col("map"))).withColumn("rel", F.when(inside, F.col("rel")))
    later = F.col("rel") >= w.landmark - 1e-9
    expected = F.lit(True) if w.grid is None else F.abs(F.col("rel") - w.grid * F.round(F.col("rel") / w.grid)) <= 1e-9
    # Points off the expected grid take no part in the outcome; NULL keys drop out of lag with IGNORE NULLS.
    s = s.withColumn("out_rel", F.when(later & expected, F.col("rel"))).withColumn("deficit", F.greatest(F.lit(w.threshold) - F.col("map"), F.lit(0.0)))
    s = s.withColumn("out_point", F.when(F.col("out_rel").isNotNull(), F.struct("out_rel", "deficit"))).withColumn("early_point", F.when(F.col("rel").between(-1e-9, w.landmark + 1e-9), F.struct("rel", "deficit")))
    order = "over (partition by case_id order by rel)"
    s = s.withColumn("out_last", F.expr(f"lag(out_point) ignore nulls {order}")).withColumn("early_last", F.expr(f"lag(early_point) ignore nulls {order}"))
    out_width, early_width = F.col("out_rel") - F.col("out_last.out_rel"), F.col("rel") - F.col("early_last.rel")
    s = s.withColumn("out_gap", out_width).withColumn("out_area", out_width * (F.col("deficit") + F.col("out_last.deficit")) / 2)
    s = s.withColumn("early_area", F.when(F.col("early_point").isNotNull(), early_width * (F.col("deficit") + F.col("early_last.deficit")) / 2))
    pre = (F.col("rel") >= -w.pre - 1e-9) & (F.col("rel") < -1e-9)
    early, high, at0 = F.col("early_point").isNotNull(), F.col("map") >= w.threshold, _near(F.col("rel"), 0.0)
    after = early & (F.col("rel") > 1e-9)
    pick = lambda c, x: F.when(c, F.col(x))
    row = s.groupBy("case_id", "t0").agg(
        F.max(pick(at0, "map")).alias("t0_map"),
        F.max(F.when(at0, (F.col("source") == "ART").cast("double"))).alias("t0_arterial_source"),
        F.count(pick(pre, "map")).cast("double").alias("pre10_map_record_count"),
        F.max(pick(pre, "rel")).alias("last_rel"),
        F.max_by("map", pick(pre, "rel")).alias("pre10_last_map"),
        F.avg(pick(pre, "map")).alias("pre10_mean_map"),
        F.when(F.min(pick(pre, "rel")) < F.max(pick(pre, "rel")), F.regr_slope(pick(pre, "map"), pick(pre, "rel"))).alias("pre10_map_ols_slope_per_min"),
        F.max(F.when(after, high.cast("double"))).alias("recovered_by_5min"),
        F.min(F.when(after & high, F.col("rel"))).alias("first_high"),
        F.max(F.when(after & ~high, F.col("rel"))).alias("last_low"),
        F.sum("early_area").alias("early_auc65_0_5_mmhg_min"),
        F.min(pick(early, "map")).alias("early_min_map_0_5"),
        F.avg(pick(early, "map")).alias("early_mean_map_0_5"),
        F.count(pick(early, "map")).cast("double").alias("early_map_record_count_0_5"),
        F.max(pick(_near(F.col("rel"), w.landmark), "map")).alias("landmark_map"),
        F.max(pick(_near(F.col("rel"), w.horizon), "map")).alias("horizon_map"),
        F.count("out_rel").alias("outcome_points"),
        F.max("out_gap").alias("outcome_max_gap_min"),
        F.sum("out_area").alias("outcome_auc"),
        F.min(F.when(F.col("out_rel").isNotNull() & (F.col("rel") > w.landmark + 1e-9) & high, F.col("rel") - w.landmark)).alias("recovery_min"),
    )
    has0, has_landmark, has_end = F.col("t0_map").isNotNull(), F.col("landmark_map").isNotNull(), F.col("horizon_map").isNotNull()
    known = has0 & has_landmark
    enough, close = F.col("outcome_points") >= w.least_points, F.coalesce(F.col("outcome_max_gap_min") <= w.largest_gap + 1e-9, F.lit(False))
    judged = has_landmark & has_end & enough & close
    recurrence = F.coalesce(F.col("last_low") > F.col("first_high"), F.lit(False))
    heavy = F.coalesce(F.col("early_auc65_0_5_mmhg_min") >= w.alert_auc, F.lit(False))
    persistent = F.col("recovery_min").isNull() | (F.col("recovery_min") > w.persistent_after)
    burden = F.coalesce(F.col("outcome_auc") >= w.high_burden_auc, F.lit(False))
    num = lambda c, x: F.when(c, x.cast("int"))
    return row.select(
        "case_id", "t0", "t0_map", (F.col("t0_map") * F.col("t0_map")).alias("t0_map_squared"), "t0_arterial_source", F.col("t0").alias("anesthesia_start_to_t0_min"),
        "pre10_map_record_count", (-F.col("last_rel")).alias("pre10_last_measurement_gap_min"), "pre10_last_map", "pre10_mean_map", "pre10_map_ols_slope_per_min",
        "recovered_by_5min", "early_auc65_0_5_mmhg_min", "early_min_map_0_5", "early_mean_map_0_5", "early_map_record_count_0_5", "landmark_map",
        known.cast("int").alias("feature_evaluable"),
        num(known, recurrence).alias("early_recurrence"), num(known, recurrence | heavy).alias("stage1_alert"), num(known, ~(recurrence | heavy)).alias("stage2"),
        F.col("outcome_points").cast("bigint").alias("outcome_points"), "outcome_max_gap_min",
        judged.cast("int").alias("outcome_evaluable"),
        F.when(judged, F.col("recovery_min")).alias("recovery_min"), F.when(judged, F.col("outcome_auc")).alias("outcome_auc"),
        num(judged, persistent).alias("persistent"), num(judged, burden).alias("high_burden"), num(judged, persistent | burden).alias("outcome"),
        F.concat_ws(";", F.when(~has0, "missing_t0_observation"), F.when(~has_landmark, "missing_t0_plus_5_observation")).alias("feature_reason"),
        F.concat_ws(";", F.when(~has_landmark, "missing_landmark_anchor"), F.when(~has_end, "missing_horizon_anchor"), F.when(~enough, "too_few_points"), F.when(~close, "gap_too_large")).alias("outcome_reason"),
    )


def observation_cells(coarse: DataFrame, fine: DataFrame, cases: DataFrame, w: Windows = Windows()) -> DataFrame:
    """case_id, cell and outcome columns of the four pairs of feature and outcome process, for cases complete on the coarse grid.

    Cases and their t0 are those of the coarse grid with evaluable features and outcome and no early alert; the fine grid is
    seen around the same events. A case that the fine grid can't judge keeps its rows with the flag 0.
    """
    base = windows(coarse, None, w).join(cases.select("case_id"), "case_id", "left_semi").filter("feature_evaluable = 1 and outcome_evaluable = 1 and stage2 = 1")
    columns = ["case_id", "t0", "feature_evaluable", "early_auc65_0_5_mmhg_min", "outcome_evaluable", "outcome_auc", "outcome"]
    h = base.select(*columns)
    r = windows(fine, h.select("case_id", "t0"), FINE).select(*columns)
    parts = []
    for f_name, f in (("coarse", h), ("fine", r)):
        for o_name, o in (("coarse", h), ("fine", r)):
            left = f.select("case_id", F.col("feature_evaluable"), F.col("early_auc65_0_5_mmhg_min"))
            right = o.select("case_id", "outcome_evaluable", "outcome_auc", "outcome")
            parts.append(left.join(right, "case_id").select("case_id", F.lit(f"{f_name}_input_{o_name}_outcome").alias("cell"), "feature_evaluable", "early_auc65_0_5_mmhg_min", "outcome_evaluable", "outcome_auc", "outcome"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
