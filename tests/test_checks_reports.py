"""Checks, performance tables, medication events, report tables, model documents, delimited sources and readings of a source."""

import datetime
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import checks, fit, map_rows, medications, metrics, models, performance, reports, resample, score
from pulsegrid.plans import evaluation
from pulsegrid.sources import delimited

T0 = datetime.datetime(2024, 1, 1, 8)


def passed(df):
    return {r["name"]: (r["violations"], r["passed"]) for r in df.collect()}


def sample(spark, n=240, seed=4, models_=("a", "b")):
    rng = np.random.default_rng(seed)
    rows = []
    for m in models_:
        p = np.round(rng.uniform(0.02, 0.98, n), 2)
        y = (np.random.default_rng(seed + 1).uniform(0, 1, n) < 0.1 + 0.7 * p).astype(int)
        rows += [(m, f"P{k}", int(y[k]), float(p[k]), float(1 + k % 3)) for k in range(n)]
    return spark.createDataFrame(rows, "model string, patient_id string, y int, p double, w double")


def test_metric_input(spark):
    df = spark.createDataFrame([(0, 0.5, 1.0, "a"), (2, 1.7, -1.0, None), (None, None, float("nan"), "b"), (1, float("nan"), float("inf"), "c")], "y int, p double, w double, patient_id string")
    got = passed(checks.metric_input(df, weight="w", patient="patient_id"))
    assert got == {"y_is_0_or_1": (2, 0), "p_in_0_to_1": (3, 0), "some_rows": (0, 1), "w_finite_not_negative": (3, 0), "w_has_weight": (0, 1), "patient_present": (1, 0)}
    with pytest.raises(ValueError, match="p_in_0_to_1"):
        checks.require(checks.metric_input(df), "here")
    empty = passed(checks.metric_input(df.limit(0), weight="w"))
    assert empty["some_rows"] == (1, 0) and empty["w_has_weight"] == (1, 0)
    one = passed(checks.predictions(spark.createDataFrame([(1, 0.5), (1, 0.5)], "y int, p double")))
    assert one["both_classes"] == (1, 0) and one["logit_varies"] == (1, 0)


def test_series_events_and_stages(spark):
    s = spark.createDataFrame([("a", 5.0, 70.0, "ART"), ("a", 5.0, 71.0, "NIBP"), (None, 5.0, 300.0, "X")], "case_id string, time_min double, map double, source string")
    assert passed(checks.series(s)) == {"keys_present": (1, 0), "values_in_range": (1, 0), "sources_known": (1, 0), "one_row_per_case_and_time": (1, 0)}
    t = spark.createDataFrame([("a", 5.0), ("a", 31.0), (None, None)], "case_id string, t0 double")
    assert passed(checks.events(t)) == {"keys_present": (1, 0), "t0_in_search_window": (2, 0), "one_row_per_case": (1, 0)}
    every = spark.createDataFrame([("a", 1, 0), ("b", 0, 1), ("c", 0, 0), ("e", 1, 1)], "case_id string, stage1_alert int, y int")
    second = spark.createDataFrame([("b", 0), ("d", 1), ("e", 1)], "case_id string, y int")
    assert passed(checks.stage_join(every, second)) == {"unscored_without_alert": (1, 0), "scored_but_unknown": (1, 0), "scored_alerts": (1, 0), "labels_differ": (1, 0), "repeated_keys": (0, 1)}


def test_intervals_gates_thresholds_and_inventories(spark):
    df = spark.createDataFrame([(0.1, 0.2, 0.5, 0.4), (None, 1.0, 1.0, 2.0)], "lower double, upper double, slope_lower double, slope_upper double")
    assert passed(checks.interval_order(df)) == {"lower_not_above_upper": (0, 1), "slope_lower_not_above_slope_upper": (1, 0)} and checks.interval_order(df.select("lower")).count() == 0
    g = spark.createDataFrame([("a", 0.1, "ppv", 50), ("a", 0.2, "ppv", 50), ("a", 0.1, "auroc", 96)], "model string, threshold double, metric string, n_valid bigint")
    a = spark.createDataFrame([("a", 0.1, 0.0), ("a", 0.2, 3.0)], "model string, threshold double, alerts double")
    assert sorted((r.threshold, r.metric, r.exempt, r.passed) for r in checks.replicate_gate(g, ["model", "threshold"], 100, alerts=a).collect()) == [(0.1, "auroc", 0, 1), (0.1, "ppv", 1, 1), (0.2, "ppv", 0, 0)]
    t = spark.createDataFrame([("x", 0.1, "clinical", "protocol"), ("x", 1.2, "capacity", "validation"), ("z", 0.5, "clinical", "old")], "name string, threshold double, kind string, source string")
    assert passed(checks.thresholds(t, forbidden=(0.5,))) == {"inside_0_to_1": (1, 0), "not_forbidden": (1, 0), "capacity_from_its_source": (1, 0), "names_unique": (1, 0)}
    names = {r["name"]: r.state for r in checks.expected_names(spark.createDataFrame([("a",), ("a",), ("c",)], "g string"), "g", ["a", "b"]).collect()}
    assert names == {"a": "repeated", "b": "missing", "c": "unexpected"}


def test_identifiers_and_lineage(spark):
    df = spark.createDataFrame([("mrn: 12", "x"), ('{"case_id" : 1}', None), ("nothing", "patient-id=3")], "note string, more string").withColumn("inner", F.struct(F.lit(1).alias("Patient ID"), F.lit(2).alias("n")))
    assert checks.identifying_columns({"t": df}) == [("t", "inner.Patient ID")]
    assert {r["column"]: r["rows"] for r in checks.identifying_text(df, ["note", "more"]).collect()} == {"note": 2, "more": 1}
    manifest = spark.createDataFrame([("a.csv", 3, "ff")], "relative_path string, size_bytes bigint, sha256 string")
    assert sorted((r.output, r.source, r.sha256) for r in checks.lineage(spark, {"o": ["a.csv", "b.csv"]}, manifest).collect()) == [("o", "a.csv", "ff"), ("o", "b.csv", None)]


def test_calibration_by_groups_agrees_with_single_fits(spark):
    df = sample(spark)
    got = {r.model: r for r in performance.calibration(df, ["model"]).collect()}
    for m in "ab":
        one = df.filter(F.col("model") == m)
        slope, c = fit.calibration_slope(one)[0], fit.calibration_in_the_large(one)
        assert abs(got[m].slope - slope.coefficients[0]) < 1e-8 and abs(got[m].intercept - slope.intercept) < 1e-8 and abs(got[m].citl - c.intercept) < 1e-8
        assert abs(got[m].slope_se - slope.covariance[1, 1] ** 0.5) < 1e-6 and abs(got[m].citl_se - c.covariance[0, 0] ** 0.5) < 1e-6
    edge = spark.createDataFrame([("none", 0, 0.2), ("none", 0, 0.4), ("all", 1, 0.3), ("flat", 1, 0.5), ("flat", 0, 0.5)], "model string, y int, p double")
    r = {x.model: x for x in performance.calibration(edge, ["model"]).collect()}
    assert r["none"].citl == -math.inf and r["all"].citl == math.inf and r["flat"].slope is None and abs(r["flat"].citl) < 1e-9
    assert performance.calibration(edge.limit(0), ["model"]).count() == 0


def test_point_performance_and_weights_are_repeated_rows(spark):
    df = sample(spark, 120, models_=("a",))
    more = df.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("w").cast("int"))))
    a, b = performance.point_performance(df, ["model"], "w").first().asDict(), performance.point_performance(more, ["model"]).first().asDict()
    for m in ("auroc", "auprc", "brier", "scaled_brier", "log_loss", "oe_ratio", "citl", "intercept", "slope"):
        assert abs(a[m] - b[m]) < 1e-8, m


def test_two_stage_by_hand(spark):
    df = spark.createDataFrame([(1, 1, None), (0, 0, 0.8), (1, 0, 0.6), (0, 0, 0.1)], "y int, stage1_alert int, p double")
    r = performance.two_stage(df, [0.5, 0.9], utility=[0.5]).orderBy("threshold").collect()
    assert (r[0].alerts, r[0].net_benefit, r[0].avoided_per_100, r[0].true_alerts_per_1000) == (3, 0.25, 25.0, 500.0) and r[1].net_benefit is None and r[1].alerts == 1
    with pytest.raises(ValueError, match="score_or_first_alert"):
        performance.two_stage(df.withColumn("stage1_alert", F.lit(0)), [0.5])


def test_paired_validation(spark):
    df = sample(spark, 150)
    knots, grid = np.array([-2.0, -0.7, 0.7, 2.0]), np.array([0.2, 0.5, 0.8])
    rows = {(r.model, r.versus, r.threshold, r.metric): r for r in resample.paired_validation(df, "model", "a", [0.2, 0.5], [0.5], replicates=60, curve=(knots, grid)).collect()}
    own = {m: rows[m, None, None, "auroc"].estimate for m in "ab"}
    delta = rows["a", "b", None, "auroc"]
    assert abs(delta.estimate - (own["a"] - own["b"])) < 1e-12 and delta.lower <= delta.upper
    assert ("a", None, 0.5, "net_benefit") in rows and ("a", None, 0.2, "net_benefit") not in rows
    one = df.filter("model = 'a'")
    w = metrics.workload(one, [0.5], patient=None).first()
    assert abs(rows["a", None, 0.5, "ppv"].estimate - w.ppv) < 1e-12 and abs(rows["a", None, 0.5, "net_benefit"].estimate - w.net_benefit) < 1e-12
    # The curve of the sample is that of a fit of the spline.
    lp = F.log(F.col("p")) - F.log1p(-F.col("p"))
    f = fit.ridge_logistic(one.select("y", *[c.alias(n) for c, n in zip(fit.spline_columns(lp, knots.tolist()), ("s0", "s1", "s2"))]), ["s0", "s1", "s2"], 0.0)
    x = resample._spline(np.log(grid) - np.log1p(-grid), knots)
    want = 1 / (1 + np.exp(-(f.intercept + x[:, 1:] @ f.coefficients)))
    assert np.allclose([rows["a", None, float(g), "curve"].estimate for g in grid], want, atol=1e-6)
    with pytest.raises(ValueError, match="more than one row"):
        resample.paired_validation(df.unionByName(df), "model", "a", [0.5], [0.5], 10)


def test_replicates_give_what_follows_from_them(spark):
    df = sample(spark, 200, models_=("a",))
    reps = resample.threshold_replicates(df, [0.3], 40)
    got = {r.metric: r for r in resample.derived(reps).collect()}
    want = {r.metric: r for r in resample.bootstrap_thresholds(df, [0.3], 40, names=tuple(resample.THRESHOLD)).collect()}
    for m in ("true_alerts_per_1000", "false_alerts_per_1000", "specificity", "avoided_per_100"):
        assert abs(got[m].lower - want[m].lower) < 1e-9 and abs(got[m].upper - want[m].upper) < 1e-9, m
    assert got["prevalence"].n_valid == 40


MEDS = "LOG_ID string, DISPLAY_NAME string, MEDICATION_NM string, RECORD_TYPE string, MAR_ACTION_NM string, MED_ACTION_TIME string, MED_ROUTE_NM string"


def test_medication_events(spark):
    rows = [
        ("a", "Norepinephrine drip", None, None, "Rate Change", "2024-01-01 08:12:00", "Intravenous"), ("a", "phenylephrine / norepinephrine", None, None, "Given", "2024-01-01 08:10:00", "IV"), ("b", None, "ephedrine 5 mg", None, "Rate verify", "2024-01-01 08:15:00", "IV push"),
        ("b", "vasopressin", None, None, "Stopped", "2024-01-01 08:12:00", "IV"), ("c", "lidocaine with epinephrine", None, None, "Given", "2024-01-01 08:12:00", "IV"), ("c", "Levophed", None, None, "New Bag", "2024-01-01 08:16:00", "IV"),
        ("c", "dopamine", None, None, "Given", "soon", "IV"), ("z", "dopamine", None, None, "Given", "2024-01-01 08:12:00", "IV"), ("a", "epinephrine", None, None, "Given", "2024-01-01 08:12:00", "Oral"), (None, None, None, None, None, None, None),
    ]
    meds = spark.createDataFrame(rows, MEDS)
    cases = spark.createDataFrame([(c, T0, 10.0, y) for c, y in (("a", 1), ("b", 0), ("c", 1), ("d", 0))], "case_id string, start timestamp, t0 double, y int")
    found = medications.candidates(meds, cases)
    assert sorted((r.case_id, r.agent, r.action, r.since_t0) for r in found.collect() if r.since_t0 is not None) == [
        ("a", "norepinephrine", "rate_change", 2.0), ("a", "phenylephrine", "new_or_bolus_administration", 0.0), ("b", "ephedrine", "rate_verify_only", 5.0), ("c", "norepinephrine", "new_or_bolus_administration", 6.0),
    ]
    near = medications.early(found)
    assert {r.case_id: r.stratum for r in medications.strata(cases, near).collect()} == {"a": "confirmed", "b": "rate_verify_only", "c": "none_recorded", "d": "none_recorded"}
    counts = {r.stratum: (r.n, r.events, r.estimable) for r in medications.stratum_counts(medications.strata(cases, near), 1).collect()}
    assert counts == {"confirmed": (1, 1, 0), "rate_verify_only": (1, 0, 0), "none_recorded": (2, 1, 1)}
    assert {r.agent: (r.rows, r.cases) for r in medications.audit(near, "agent").collect()} == {"norepinephrine": (1, 1), "phenylephrine": (1, 1), "ephedrine": (1, 1)}
    assert medications.mapping_audit(meds, found, near).first().asDict() == {"rows_scanned": 10, "candidates": 5, "unreadable_times": 1, "missing_starts": 0, "early_rows": 3, "confirmed_rows": 2, "confirmed_cases": 1}
    assert medications.candidates(meds.limit(0), cases).count() == 0


def test_case_mix_by_hand(spark):
    df = spark.createDataFrame([("L", 50.0, 1, 0), ("L", 60.0, 0, 1), ("L", None, None, 1), ("R", 70.0, 1, 0), ("R", 90.0, 1, 0)], "d string, age double, male int, emergency int")
    lines = [reports.Row("S", "Age", "years", "age"), reports.Row("S", "Sex", "Male", "male", True), reports.Row("S", "Emergency", "Yes", "emergency", True, unavailable_in="R")]
    got = {r.characteristic: r for r in reports.case_mix(df, "d", "L", "R", lines).collect()}
    a, b, c = got["Age"], got["Sex"], got["Emergency"]
    assert (a.left_value, a.left_n, a.left_missing_pct, a.right_value) == ("55.0 (7.1)", 2, 33.3, "80.0 (14.1)") and a.absolute_smd == "2.236"
    assert (b.left_value, b.right_value, b.absolute_smd) == ("1 (50.0%)", "2 (100.0%)", "1.414") and (c.left_value, c.right_value, c.absolute_smd) == ("2 (66.7%)", "not available", "not estimable")


def test_report_tables(spark):
    point = spark.createDataFrame([("a", "auroc", 0.7)], "model string, metric string, value double")
    i = spark.createDataFrame([("a", None, "auroc", 0.7, 0.65, 0.75), ("a", "b", "auroc", -0.0001, None, 0.2)], "model string, versus string, metric string, estimate double, lower double, upper double")
    assert {r.column: r.shown for r in reports.performance_table(point, i, "model", "a").collect()} == {"a": "0.700 (0.650 to 0.750)", "a - b": "not estimable"}
    with pytest.raises(ValueError, match="a auroc"):
        reports.performance_table(point.withColumn("value", F.lit(0.8)), i, "model", "a")
    flow = spark.createDataFrame([(0, "x", 10), (1, "side", 3), (2, "z", 7)], "step_no int, step string, n bigint")
    assert [(r.step, r.excluded_from_previous, r.branch) for r in reports.flow_figure(flow, ["x", "z"]).orderBy("step_no").collect()] == [("x", None, "screening"), ("side", None, "branch"), ("z", 3, "screening")]
    assert [r.display_label for r in reports.labelled(flow, "step", {"x": "First"}).orderBy("step_no").collect()] == ["First", "side", "z"]
    assert reports.source_manifest({"f": flow, "g": flow.limit(0)}).orderBy("figure").first().rows == 3


def test_published_anchor_and_bundle(spark, tmp_path):
    """The published synthetic row: all features at their medians."""
    df = spark.createDataFrame([tuple(map(float, score.MEDIANS.values()))], ", ".join(f"{f} double" for f in score.MEDIANS))
    assert abs(score.score(df).first().p - 0.14685236317048397) < 1e-12
    assert abs(df.select(score.linear_predictor().alias("z")).first().z + 1.7595048621082618) < 1e-12
    b = evaluation.frozen_bundle()
    models.save(b, f"{tmp_path}/b.json")
    assert models.load(f"{tmp_path}/b.json", "landmark") == json.loads(json.dumps(b))
    for broken in ({"study_id": None}, {"primary_model": "x"}, {"thresholds": {"t": 1.0}}, {"deviations": {"common18": dict.fromkeys(score.MEDIANS, 0.0)}}, {"medians": {"common18": {**score.MEDIANS, "bmi": math.nan}}}):
        with pytest.raises(ValueError):
            models.check_bundle({**b, **broken})
    with pytest.raises(ValueError, match="study"):
        models.check_bundle(b, "another")


def test_vectors(spark):
    b = evaluation.frozen_bundle()
    rows = [(f"c{k:03d}", *[float(v) + (k % 7) * 0.01 for v in score.MEDIANS.values()]) for k in range(40)]
    df = spark.createDataFrame(rows, "case_id string, " + ", ".join(f"{f} double" for f in score.MEDIANS))
    v = models.make_vectors(df, b, 9)
    ranked = sorted((r.p, r.case_id) for r in models.predict(df, b).collect())
    wanted = [0] + [k for k in range(1, 40) if math.floor(k * 8 / 39) > math.floor((k - 1) * 8 / 39)]
    assert sorted((r.p, r.case_id) for r in v.collect()) == [ranked[k] for k in wanted] and len(wanted) == 9
    assert models.verify_vectors(v, b) == 0.0
    with pytest.raises(ValueError, match="test vectors"):
        models.verify_vectors(v.withColumn("p", F.col("p") + 1e-9), b)


def test_delimited(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text('op_id,subject_id,chart_time,item_name,value,extra\n1,9,5.0,ART_MBP,70,x\n1,9,,nibp_mbp,"7,0",y\n')
    v = delimited.scan(spark, str(tmp_path / "in"), delimited.VITALS)
    assert [(r.chart_time, r.value, r.part) for r in v.orderBy("item_name").collect()] == [(5.0, 70.0, "a.csv"), (None, None, "a.csv")]
    with pytest.raises(ValueError, match="lacks"):
        delimited.scan(spark, str(tmp_path / "in"), delimited.MEDICATIONS)
    told = delimited.sink_with_audit(v, str(tmp_path / "out"), str(tmp_path / "audit"), "vitals")
    assert [(r.label, r.part, r.rows) for r in told.collect()] == [("vitals", "a.csv", 2)]
    with pytest.raises(Exception, match="(?i)exist"):
        delimited.sink(v, str(tmp_path / "out"))
    v.write.parquet(f"{tmp_path}/stage.parquet")
    assert delimited.stage(spark, str(tmp_path), "stage", {"op_id": "string", "value": "double"}, ["item_name"]).columns == ["op_id", "value"]
    for schema, key in (({"op_id": "bigint"}, ["item_name"]), ({"op_id": "string"}, ["op_id"]), ({"op_id": "string"}, ["value"])):
        with pytest.raises(ValueError):
            delimited.stage(spark, str(tmp_path), "stage", schema, key)
    m = spark.createDataFrame([("a", "1"), ("b", "2"), ("secret_x", "3")], "relative_path string, sha256 string")
    p = spark.createDataFrame([("a", "1"), ("b", "9"), ("c", "4")], "relative_path string, sha256 string")
    got = {r.relative_path: (r.state, r.gate) for r in delimited.gate(m, p, ("secret",)).collect()}
    assert got == {"a": ("same", "RED"), "b": ("changed", "RED"), "c": ("missing", "RED"), "secret_x": ("forbidden", "RED")} and delimited.gate(m.limit(1), p.limit(1)).first().gate == "GREEN"


def test_rows_of_a_source(spark):
    at = lambda m: (T0 + datetime.timedelta(minutes=m)).strftime("%Y-%m-%d %H:%M:%S")
    flo = [(1, "E1", "Arterial line MAP", None, at(5), "60"), (2, "E1", "NIBP mean blood pressure", None, at(10), "70 mmHg"), (3, "E1", "MAP", "MAP", at(60), "80"), (4, "E1", "MAP", None, at(61), "80"), (5, "E1", "MAP goal", None, at(5), "65"), (6, "E1", "MAP", None, at(0), "120/80"), (7, "E2", "MAP", None, at(5), "80"), (8, "E1", "MAP", None, "x", "80"), (9, "E1", "MAP", None, at(0), "201"), (10, None, None, None, None, None)]
    f = spark.createDataFrame(flo, "flow_id int, log_id string, flo_name string, flo_display_name string, recorded_time string, meas_value string")
    cases = spark.createDataFrame([("E1", "P1", T0, T0 + datetime.timedelta(minutes=60)), ("E1", "P1", T0 + datetime.timedelta(days=1), T0), (None, "P2", T0, T0)], "encounter_id string, patient_id string, start timestamp, end timestamp")
    assert sorted((r.flow_id, r.map_source, r.minute_from_anesthesia_start, r.map_value) for r in map_rows.from_flowsheet(f, cases).collect()) == [(1, "ART", 5.0, 60.0), (2, "NIBP", 10.0, 70.0), (3, "DIRECT", 60.0, 80.0)]
    v = spark.createDataFrame([(401, 105.0, " ART_mbp", 20.0), (401, 110.0, "nibp_mbp", 200.0), (401, 110.0, "art_mbp", 201.0), (401, 95.0, "art_mbp", 60.0), (401, 105.0, "hr", 60.0), (402, 105.0, "art_mbp", 60.0), (None, None, None, None)], "op_id int, chart_time double, item_name string, value double")
    own = spark.createDataFrame([("401", "P", 100.0, 160.0)], "encounter_id string, patient_id string, start double, end double")
    got = map_rows.from_vitals(v, own)
    assert sorted((r.minute_from_anesthesia_start, r.map_value, r.map_source) for r in got.collect()) == [(5.0, 20.0, "ART"), (10.0, 200.0, "NIBP")]
    raw = got.select(F.col("encounter_id").alias("case_id"), F.col("minute_from_anesthesia_start").alias("t"), F.col("map_value").alias("map"), F.col("map_source").alias("source"))
    assert set(map_rows.processes(raw, "irregular")) == {"coarse", "fine"} and map_rows.processes(raw, "published")["coarse"].count() == 2
    with pytest.raises(ValueError, match="formal"):
        map_rows.processes(raw.withColumn("source", F.lit("DIRECT")), "irregular")


def test_extract_shards_and_gates(spark, tmp_path):
    from pulsegrid.sources import archives

    f = spark.createDataFrame([(1, "E1", "MAP", None, "2024-01-01 08:05:00", "60", "p1"), (2, "E1", "HR", None, "2024-01-01 08:05:00", "60", "p1"), (3, "E1", "HR", None, "2024-01-01 08:05:00", "60", "p2")], "flow_id int, log_id string, flo_name string, flo_display_name string, recorded_time string, meas_value string, part_file string")
    cases = spark.createDataFrame([("E1", "P1", T0, T0 + datetime.timedelta(minutes=60))], "encounter_id string, patient_id string, start timestamp, end timestamp")
    rows, told = map_rows.extract(f, cases, "part_file")
    assert rows.count() == 1 and {r.part: (r.raw_rows, r.retained_rows, r.retained_pct) for r in told.collect()} == {"p1": (2, 1, 50.0), "p2": (1, 0, 0.0)}
    one = lambda n: spark.range(n).withColumn("v", F.col("id") * 2)
    assert archives.write_shards({"a": one(3), "b/c": one(4)}, f"{tmp_path}/s", {"v": "1"}).groupBy("shard").count().count() == 2
    assert archives.write_shards({"a": one(9), "b/c": one(9)}, f"{tmp_path}/s", {"v": "1"}).count() == 7
    (note,) = (tmp_path / "s" / "a.sums").glob("part-*")
    for crc in (tmp_path / "s" / "a.sums").glob(".part-*"):
        crc.unlink()
    note.write_text('{"hash": 1, "rows": 3}')
    with pytest.raises(ValueError, match="shard a"):
        archives.write_shards({"a": one(3)}, f"{tmp_path}/s", {"v": "1"})
    with pytest.raises(ValueError, match="lacks"):
        score.impute(f, {"bmi": 20.0}, enforce=True)
    with pytest.raises(ValueError, match="bmi"):
        score.impute(f.withColumn("bmi", F.lit(float("nan"))), {"bmi": 20.0}, enforce=True)
    with pytest.raises(ValueError, match="finite"):
        score.impute(f, {"bmi": math.inf})
    b = spark.createDataFrame([(0.0, None), (1.0, 1), (2.0, 0)], "x double, y int")
    assert passed(checks.binary_columns(b, ["x", "y"])) == {"x_is_0_or_1": (1, 0), "y_is_0_or_1": (1, 0)} and passed(checks.binary_columns(b, ["y"], nullable=True)) == {"y_is_0_or_1": (0, 1)}


def test_subgroups_that_can_be_estimated(spark):
    from pulsegrid.operators import secondary

    df = spark.range(240).select((F.col("id") % 4 == 0).cast("int").alias("y"), F.col("id").alias("k"))
    got = {r.subgroup: (r.n, r.events, r.estimable) for r in secondary.subgroups(df, {"big": F.col("k") < 120, "few_events": F.col("k") < 76, "none": F.col("k") > 500}).collect()}
    assert got == {"big": (120, 30, 1), "few_events": (76, 19, 0)}
