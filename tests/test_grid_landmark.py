import dataclasses

import pytest

from pulsegrid.operators.grid import checked_sources, harmonize, published_grid
from pulsegrid.operators.landmark import FINE, Windows, find_t0, observation_cells, windows

RAW = "case_id string, t double, map double, source string"
GRID = "case_id string, time_min double, map double, source string"


def h(spark, rows, *a, **kw):
    df = spark.createDataFrame([("a", float(t), None if m is None else float(m), s) for t, m, s in rows], RAW)
    return sorted((r.time_min, r.map, r.source, r.n_raw_records, r.n_raw_records_all_sources) for r in harmonize(df, *a, **kw).collect())


def series(spark, points, case="a", source="ART"):
    return spark.createDataFrame([(case, float(t), float(m), source) for t, m in points.items()], GRID)


def one(spark, points, t0=None, w=Windows()):
    event = spark.createDataFrame([("a", float(t0))], "case_id string, t0 double") if t0 is not None else None
    rows = windows(series(spark, points), event, w).collect()
    return rows[0].asDict() if rows else None


def test_boundaries_and_range(spark):
    rows = [(0, 60, "ART"), (0.1, 19.9, "ART"), (1, 20, "ART"), (2, 200, "ART"), (5, 70, "ART"), (5.0001, 80, "ART"), (6, 200.1, "ART"), (7, None, "ART"), (8, float("nan"), "ART")]
    assert [(t, m) for t, m, *_ in h(spark, rows)] == [(5, 70), (10, 80)]


def test_the_first_source_wins_by_its_median(spark):
    rows = [(1, 50, "ART"), (2, 70, "ART"), (3, 90, "ART"), (4, 120, "NIBP"), (4.5, 140, "NIBP")]
    assert h(spark, rows) == [(5, 70, "ART", 3, 5)]
    assert h(spark, rows, priority=("NIBP", "ART")) == [(5, 130, "NIBP", 2, 5)]
    assert h(spark, [(1, 80, "NIBP"), (4, 100, "NIBP")]) == [(5, 90, "NIBP", 2, 2)]


def test_phase_and_width(spark):
    rows = [(-0.5, 20, "ART"), (0.5, 60, "ART"), (4, 70, "ART"), (4.1, 80, "ART")]
    assert [t for t, *_ in h(spark, rows)] == [5]
    assert [(t, m) for t, m, *_ in h(spark, rows, 5.0, 4.0)] == [(4, 65), (9, 80)]
    assert [(t, m) for t, m, *_ in h(spark, [(0.2, 60, "NIBP"), (1, 70, "NIBP"), (1.001, 80, "NIBP")], 1.0)] == [(1, 65), (2, 80)]
    for width, phase in ((0, 0), (5, 5), (5, -1), (float("inf"), 0)):
        with pytest.raises(ValueError):
            h(spark, rows, width, phase)


def test_variants(spark):
    rows = [(0, 40, "ART"), (1, 50, "ART"), (4, 70, "ART"), (4, 90, "ART"), (5, 100, "ART")]
    assert h(spark, rows, interval="left_closed") == [(5, 60, "ART", 4, 4), (10, 100, "ART", 1, 1)]
    assert h(spark, rows[:4], statistic="nearest_right_boundary") == [(5, 80, "ART", 2, 3)]


def test_published_grid_keeps_its_times(spark):
    df = spark.createDataFrame([("a", 0.0, 70.0, "NIBP"), ("a", 7.25, 60.0, "ART"), ("a", 7.25, 100.0, "NIBP")], RAW)
    assert sorted((r.time_min, r.map, r.source) for r in published_grid(df).collect()) == [(0, 70, "NIBP"), (7.25, 60, "ART")]


def test_unknown_source_fails(spark):
    df = spark.createDataFrame([("a", 1.0, 70.0, "mystery")], RAW)
    with pytest.raises(Exception, match="unmapped source mystery"):
        checked_sources(df).collect()


def test_first_event(spark):
    def t0(points):
        return [(r.t0, r.t0_map) for r in find_t0(series(spark, points)).collect()]

    assert t0({5: 70, 10: 61, 15: 50}) == [(10, 61)] and t0({5: 52.5}) == [(5, 52.5)]
    assert t0({3: 50, 35: 50, 10: 65}) == []


def test_features(spark):
    f = one(spark, {5: 80, 10: 70, 15: 60, 20: 70, 25: 200}, 15)
    assert (f["t0_map"], f["t0_map_squared"], f["t0_arterial_source"]) == (60, 3600, 1)
    assert (f["pre10_map_record_count"], f["pre10_last_measurement_gap_min"], f["pre10_last_map"], f["pre10_mean_map"]) == (2, 5, 70, 75)
    assert abs(f["pre10_map_ols_slope_per_min"] + 2) < 1e-12 and f["recovered_by_5min"] == 1
    assert (f["early_auc65_0_5_mmhg_min"], f["early_min_map_0_5"], f["early_mean_map_0_5"], f["early_map_record_count_0_5"]) == (12.5, 60, 65, 2)


def test_slope_needs_two_points_and_a_landmark(spark):
    assert one(spark, {5: 80, 10: 60, 15: 70}, 10)["pre10_map_ols_slope_per_min"] is None
    f = one(spark, {5: 70, 10: 60, 20: 80}, 10)
    assert (f["feature_evaluable"], f["feature_reason"], f["stage1_alert"]) == (0, "missing_t0_plus_5_observation", None)


def test_nothing_after_the_landmark_is_read(spark):
    a = one(spark, {5: 80, 10: 60, 15: 70, 20: 50, 30: 90}, 10)
    b = one(spark, {5: 80, 10: 60, 15: 70, 20: 190, 40: 20}, 10)
    assert all(a[k] == b[k] for k in a if k.startswith(("pre10", "early", "t0", "recovered", "stage1")))


def test_early_alert(spark):
    f = one(spark, {10: 60, 11: 66, 12: 64, 13: 70, 14: 70, 15: 70}, 10, FINE)
    assert (f["recovered_by_5min"], f["early_recurrence"], f["stage1_alert"], f["stage2"]) == (1, 1, 1, 0)
    f = one(spark, {10: 55, 15: 55}, 10)
    assert (f["early_auc65_0_5_mmhg_min"], f["early_recurrence"], f["stage1_alert"]) == (50, 0, 1)


@pytest.mark.parametrize(
    ("points", "points_n", "gap", "evaluable", "recovery", "auc", "persistent", "burden"),
    [
        ({15: 60, 20: 60, 30: 66, 35: 70, 40: 70}, 5, 10, 1, 15, 50, 1, 0),
        ({15: 60, 20: 60, 30: 66, 40: 70}, 4, 10, 0, None, None, None, None),
        ({15: 60, 20: 60, 25: 66, 30: 70, 35: 70, 40: 70}, 6, 5, 1, 10, 37.5, 0, 0),
        ({15: 60, 20: 60, 25: 60, 30: 60, 35: 60, 40: 60}, 6, 5, 1, None, 125, 1, 1),
        ({15: 70, 20: 60, 25: 60, 30: 60, 35: 60, 40: 60}, 6, 5, 1, None, 112.5, 1, 1),
    ],
)
def test_outcomes(spark, points, points_n, gap, evaluable, recovery, auc, persistent, burden):
    f = one(spark, {10: 60, **points}, 10)
    assert (f["outcome_points"], f["outcome_max_gap_min"], f["outcome_evaluable"]) == (points_n, gap, evaluable)
    assert (f["recovery_min"], f["outcome_auc"], f["persistent"], f["high_burden"]) == (recovery, auc, persistent, burden)
    assert f["outcome"] == (None if not evaluable else int(persistent or burden))


def test_fine_points_need_small_gaps(spark):
    f = one(spark, {10: 60, 15: 60, 21: 60, 26: 60, 31: 60, 36: 60, 40: 60}, 10, FINE)
    assert (f["outcome_max_gap_min"], f["outcome_evaluable"]) == (6, 0) and "gap_too_large" in f["outcome_reason"]


def test_points_off_the_expected_grid_take_no_part(spark):
    f = one(spark, {10: 60, 15: 60, 17: 90, 20: 60, 25: 60, 30: 60, 35: 60, 40: 60}, 10)
    assert (f["outcome_points"], f["outcome_auc"], f["recovery_min"]) == (6, 125, None)


def test_events_without_points_keep_a_row(spark):
    t0 = spark.createDataFrame([("a", 10.0), ("b", 10.0)], "case_id string, t0 double")
    rows = {r.case_id: r for r in windows(series(spark, {10: 60, 15: 60}), t0).collect()}
    assert rows["b"].feature_evaluable == 0 and rows["b"].outcome_points == 0 and rows["b"].t0_map is None
    assert windows(series(spark, {10: 60}).limit(0)).count() == 0


def test_cells(spark):
    coarse = {10: 60, 15: 70, 20: 60, 25: 60, 30: 60, 35: 60, 40: 60}
    fine = {t: 70 for t in range(15, 41)} | {10: 60, 11: 66}
    cases = spark.createDataFrame([("a",)], "case_id string")
    cells = {r.cell: r for r in observation_cells(series(spark, coarse), series(spark, fine), cases).collect()}
    assert len(cells) == 4 and cells["coarse_input_coarse_outcome"].outcome == 1 and cells["coarse_input_fine_outcome"].outcome == 0
    sparse = {r.cell: r for r in observation_cells(series(spark, coarse), series(spark, {10: 60}), cases).collect()}
    assert sparse["coarse_input_fine_outcome"].outcome_evaluable == 0 and sparse["fine_input_coarse_outcome"].feature_evaluable == 0


def test_order_of_rows_and_thresholds(spark):
    points = {5: 80, 10: 62, 15: 66, 20: 66, 25: 66, 30: 66, 35: 66, 40: 66}
    back = dict(reversed(points.items()))
    assert one(spark, points) == one(spark, back)
    assert one(spark, points, w=dataclasses.replace(Windows(), threshold=60.0)) is None
