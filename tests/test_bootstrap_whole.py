"""All metrics and replicates of the patient bootstrap."""

import inspect

import numpy as np

from pulsegrid.operators import fit, metrics, resample
from pulsegrid.plans import reference


def sample(spark, n=300):
    rng = np.random.default_rng(4)
    p = np.round(rng.uniform(0.02, 0.98, n), 2)
    y = (rng.uniform(0, 1, n) < 0.1 + 0.7 * p).astype(int)
    return y, p, spark.createDataFrame([(f"P{k // 2}", int(y[k]), float(p[k])) for k in range(n)], "patient_id string, y int, p double")


def test_nine_metrics_agree_with_their_operators(spark):
    _, _, df = sample(spark)
    rows = {r.metric: r for r in resample.bootstrap(df, [], 120, metrics=resample.PAIRED).collect()}
    o = metrics.overall(df).first()
    want = {"auroc": metrics.auroc(df).first().auroc, "auprc": metrics.auprc(df).first().auprc, "brier": o.brier, "scaled_brier": o.scaled_brier, "log_loss": o.log_loss, "observed_expected_ratio": o.oe_ratio}
    want |= {"ici": metrics.ici(df).first().ici, "calibration_slope": float(fit.calibration_slope(df)[0].coefficients[0]), "calibration_in_the_large": fit.calibration_in_the_large(df).intercept}
    assert set(rows) == set(want)
    for m, v in want.items():
        assert abs(rows[m].estimate - v) < 1e-8 and rows[m].n_valid == 120 and rows[m].lower < rows[m].upper and rows[m].sd > 0, m


def test_weights_are_repeated_rows():
    rng = np.random.default_rng(1)
    p, w = np.sort(np.round(rng.uniform(0.05, 0.95, 80), 1)), resample.draws(rng.integers(-(2**62), 2**62, 80), np.arange(1, 4))
    y = (rng.uniform(0, 1, 80) < p).astype(float)
    got = resample.weighted_metrics(y, p, w, resample.PAIRED)
    for k in range(3):
        i = np.repeat(np.arange(80), w[:, k].astype(int))
        one = resample.weighted_metrics(y[i], p[i], np.ones((len(i), 1)), resample.PAIRED)
        assert all(abs(got[m][k] - one[m][0]) < 1e-8 for m in resample.PAIRED)


def test_counts_are_poisson_and_shared():
    key = np.random.default_rng(2).integers(-(2**62), 2**62, 4000)
    w = resample.draws(key, np.arange(0, 60))
    assert (w[:, 0] == 1).all() and abs(w[:, 1:].mean() - 1) < 0.01 and abs(w[:, 1:].var() - 1) < 0.02
    assert np.abs(np.corrcoef(w[:, 1:].T) - np.eye(59)).max() < 0.1 and (resample.draws(key[:5], np.arange(0, 60)) == w[:5]).all()


def test_queries_draw_as_often_as_the_reference():
    assert reference.REPLICATES >= 2000
    for f in (reference.bootstrap_ci, reference.factorial_2x2, reference.two_stage_boot):
        assert "replicates=REPLICATES" in inspect.getsource(f)


def test_replicates_do_not_depend_on_where_rows_lie(spark):
    y, p, df = sample(spark)
    a, b = (
        {(r.replicate, r.metric): r.value for r in resample._replicated(d, [], 40, 7, "patient_id", resample._metrics(resample.PAIRED)).collect()}
        for d in (df.repartition(1), df.repartition(7, "p"))
    )
    assert len(a) == 41 * 9 and a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-9 for k in a)


def test_intervals_stand_in_for_many_scores(spark, monkeypatch):
    """With fewer intervals than scores the metrics stay close to those of the rows, and thresholds are met exactly."""
    y, p, df = sample(spark, 2000)
    df = df.withColumn("p", df.p + (df.y * 0.001 + 0.0001))
    whole = {r.metric: r for r in resample.bootstrap(df, [], 30, metrics=resample.PAIRED).collect()}
    exact = {r.threshold: r.alert_rate for r in metrics.workload(df, [0.15, 0.333], patient=None).collect()}
    monkeypatch.setattr(resample, "INTERVALS", 64)
    some = {r.metric: r for r in resample.bootstrap(df, [], 30, metrics=resample.PAIRED).collect()}
    for m in ("auroc", "brier", "log_loss", "observed_expected_ratio", "calibration_slope"):
        assert abs(whole[m].estimate - some[m].estimate) < (0.03 if m == "calibration_slope" else 0.01), m
    got = {r.threshold: r.estimate for r in resample.bootstrap_thresholds(df, [0.15, 0.333], 20).collect() if r.metric == "alert_rate"}
    assert all(abs(got[t] - exact[t]) < 1e-12 for t in exact)
