import math

import numpy as np
import pytest

from pulsegrid.operators import fit, metrics, resample, score, secondary

SCHEMA = "patient_id string, y int, p double, w double, g string"


def frame(spark, y, p, w=None, g=None):
    n = len(y)
    return spark.createDataFrame([(f"P{k}", int(y[k]), float(p[k]), float(1 if w is None else w[k]), "g" if g is None else g[k]) for k in range(n)], SCHEMA)


def noisy(n=400, seed=0, ties=20):
    rng = np.random.default_rng(seed)
    p = np.round(rng.uniform(0, 1, n) * ties) / ties
    return (rng.uniform(0, 1, n) < 0.2 + 0.6 * p).astype(int), p, rng.integers(0, 4, n).astype(float)


def test_hand_values(spark):
    df = frame(spark, [0, 0, 1, 1], [0.1, 0.4, 0.35, 0.8])
    assert abs(metrics.auroc(df).first().auroc - 0.75) < 1e-12 and abs(metrics.auprc(df).first().auprc - 5 / 6) < 1e-12
    tie = frame(spark, [1, 0], [0.5, 0.5])
    assert metrics.auroc(tie).first().auroc == 0.5 and metrics.auprc(tie).first().auprc == 0.5
    assert metrics.auroc(frame(spark, [1, 1], [0.2, 0.5])).first().auroc is None


@pytest.mark.parametrize("weight", [None, "w"])
def test_ranks_agree_with_pairs(spark, weight):
    y, p, w = noisy()
    df, v = frame(spark, y, p, w), np.ones(len(y)) if weight is None else w
    pairs = v[y == 1][:, None] * v[y == 0][None, :]
    d = p[y == 1][:, None] - p[y == 0][None, :]
    assert abs(metrics.auroc(df, [], weight).first().auroc - (pairs * ((d > 0) + 0.5 * (d == 0))).sum() / pairs.sum()) < 1e-12
    order = sorted(set(p), reverse=True)
    ap = sum((v * y)[p == t].sum() * (v * y)[p >= t].sum() / max(v[p >= t].sum(), 1e-300) for t in order) / (v * y).sum()
    assert abs(metrics.auprc(df, [], weight).first().auprc - ap) < 1e-12


def test_groups_and_whole_weights_are_repeated_rows(spark):
    y, p, w = noisy(120, 3)
    w = w + 1
    k = np.repeat(np.arange(120), w.astype(int))
    a, b = frame(spark, y, p, w), frame(spark, y[k], p[k])
    for m in (metrics.auroc, metrics.auprc):
        assert abs(m(a, ["g"], "w").collect()[0][1] - m(b, ["g"]).collect()[0][1]) < 1e-12
    x, z = metrics.overall(a, [], "w").first(), metrics.overall(b).first()
    assert abs(x.brier - z.brier) < 1e-12 and abs(x.log_loss - z.log_loss) < 1e-12 and abs(x.oe_ratio - z.oe_ratio) < 1e-12


def test_calibrated(spark):
    y = [1] * 20 + [0] * 80 + [1] * 80 + [0] * 20
    df = frame(spark, y, [0.2] * 100 + [0.8] * 100)
    o = metrics.overall(df).first()
    assert abs(o.oe_ratio - 1) < 1e-12 and metrics.ici(df, [], 2).first().ici < 1e-12
    slope, _ = fit.calibration_slope(df)
    assert abs(slope.intercept) < 1e-8 and abs(slope.coefficients[0] - 1) < 1e-8 and abs(fit.calibration_in_the_large(df).intercept) < 1e-8
    none = metrics.overall(frame(spark, [0] * 20, [0.1] * 20)).first()
    assert none.oe_ratio == 0 and none.oe_lower == 0 and abs(none.oe_upper + math.log(0.025) / 2.0) < 1e-9


def test_bins_follow_distinct_quantiles(spark):
    y, p, _ = noisy(300, 5, 7)
    edges = np.unique(np.quantile(p, np.linspace(0, 1, 11)))
    which = np.searchsorted(edges[1:-1], p, side="right")
    got = {r.bin: r for r in metrics.calibration_bins(frame(spark, y, p)).collect()}
    assert {int(b): int((which == b).sum()) for b in set(which)} == {b: r.n for b, r in got.items()}
    rate = np.array([y[which == b].mean() for b in range(len(edges))  if (which == b).any()])
    want = sum(np.abs(y[which == b].mean() - p[which == b]).sum() for b in set(which)) / len(p)
    assert len(rate) == len(got) and abs(metrics.ici(frame(spark, y, p)).first().ici - want) < 1e-12


def test_thresholds(spark):
    r = metrics.workload(frame(spark, [1, 0, 1, 0], [0.9, 0.8, 0.2, 0.1]), [0.5]).first()
    assert (r.tp, r.fp, r.alerts, r.net_benefit, r.alerts_per_tp, r.patients_alerted, r.patients_captured) == (1, 1, 2, 0, 2, 2, 1)
    none = metrics.workload(frame(spark, [1, 0], [0.1, 0.1]), [0.5]).first()
    assert none.alerts_per_tp is None and none.ppv is None


def test_capacity_and_top(spark):
    y, p, _ = noisy(97, 8, 1000)
    df = frame(spark, y, p)
    got = {r.fraction: r.threshold for r in metrics.capacity_thresholds(df, [0.1, 0.2, 0.3]).collect()}
    assert all(abs(got[f] - np.quantile(p, 1 - f, method="higher")) < 1e-12 for f in got) and len(got) == 3
    assert metrics.top_k(df, 5, "patient_id").count() == 5


def test_ridge_agrees_with_newton_in_numpy(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(0, [1, 30], (500, 2)) + [0, 100]
    y = (rng.uniform(0, 1, 500) < 1 / (1 + np.exp(-(0.5 + x[:, 0] - 0.02 * (x[:, 1] - 100))))).astype(int)
    df = spark.createDataFrame([(*map(float, r), int(t)) for r, t in zip(x, y)], "a double, b double, y int")
    z = (x - x.mean(0)) / x.std(0)
    a = np.column_stack([np.ones(500), z])
    beta, pen = np.zeros(3), np.array([0, 0.05, 0.05])
    for _ in range(50):
        p = 1 / (1 + np.exp(-a @ beta))
        beta -= np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a / 500 + np.diag(pen), a.T @ (p - y) / 500 + pen * beta)
    r = fit.ridge_logistic(df, ["a", "b"], 0.05)
    assert r.converged and np.allclose(r.coefficients, beta[1:] / x.std(0), atol=1e-8) and abs(r.intercept - (beta[0] - (beta[1:] / x.std(0)) @ x.mean(0))) < 1e-7
    scaled = fit.ridge_logistic(df.selectExpr("a * 1000 as a", "b - 7 as b", "y"), ["a", "b"], 0.05)
    assert np.allclose(scaled.coefficients * [1000, 1], r.coefficients, rtol=1e-6)
    with pytest.raises(ValueError):
        fit.ridge_logistic(df.limit(0), ["a"], 0.1)


def test_folds_hold_whole_groups(spark):
    df = spark.createDataFrame([(f"P{k % 50}",) for k in range(230)], "patient_id string")
    folds = {r.patient_id: r.fold for r in fit.grouped_folds(df, "patient_id").collect()}
    assert len(folds) == 50 and set(folds.values()) == set(range(5))


def test_frozen_score_of_the_median_case(spark):
    row = spark.createDataFrame([tuple(None for _ in score.MEDIANS)], ", ".join(f"{f} double" for f in score.MEDIANS))
    assert abs(score.score(row).first().p - 0.14685236317048397) < 1e-12
    with pytest.raises(ValueError, match="without any value"):
        score.require_some_values(row)


def test_bootstrap_is_paired_and_covers(spark):
    y, p, _ = noisy(200, 9, 50)
    a = frame(spark, y, p, g=["a"] * 200).unionByName(frame(spark, y, p, g=["b"] * 200))
    rows = {(r.g, r.metric): r for r in resample.bootstrap(a, ["g"], 60).collect()}
    for m in ("auroc", "auprc", "brier", "log_loss"):
        one, two = rows["a", m], rows["b", m]
        assert one.lower < one.estimate < one.upper and (one.lower, one.upper) == (two.lower, two.upper) and one.n_valid == 60
    r = resample.bootstrap_callable(frame(spark, y, p), lambda f: np.average(f["y"], weights=f["w"]), ["y"], 20).collect()
    assert len({x.replicate for x in r}) == 20 and abs(np.mean([x.value for x in r]) - y.mean()) < 0.1


def test_agreement_shift_and_agents(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1, 1), (1, 0), (0, 0), (0, 0), (None, 1)], "a int, b int")
    r = secondary.agreement(df, "a", "b").first()
    assert (r.n, r.n11, r.n10, r.n00) == (4, 1, 1, 2) and abs(r.kappa - 0.5) < 1e-12
    s = secondary.prediction_shift(spark.createDataFrame([(0.1, 0.2), (0.1, 0.4), (0.5, 0.3), (0.9, 0.9)], "a double, b double"), "a", "b").first()
    ranks_a, ranks_b = [1.5, 1.5, 3, 4], [1, 3, 2, 4]
    assert abs(s.spearman - np.corrcoef(ranks_a, ranks_b)[0, 1]) < 1e-12
    names = ["Norepinephrine drip", "EPHEDRINE inj", "epinephrine", "lidocaine with epinephrine", "Levophed", "saline", None]
    got = [r.x for r in spark.createDataFrame([(n,) for n in names], "n string").select(secondary.agent(F.col("n")).alias("x")).collect()]
    assert got == ["norepinephrine", "ephedrine", "epinephrine", None, "norepinephrine", None, None]
    near = secondary.events_near(spark.createDataFrame([("a", 9.0), ("a", 12.0), ("a", 16.0), ("b", 1.0)], "case_id string, minute double"), spark.createDataFrame([("a", 10.0)], "case_id string, t0 double"))
    assert [r.since_t0 for r in near.collect()] == [2.0]


def test_planning(spark):
    from pulsegrid.operators import planning

    _, p, _ = noisy(300, 4, 1000)
    df = frame(spark, [0] * 300, np.clip(p, 0.01, 0.99))
    shift = planning.intercept_shift(df, 0.12)
    q = np.clip(p, 0.01, 0.99)
    assert abs(np.mean(1 / (1 + np.exp(-(np.log(q / (1 - q)) + shift)))) - 0.12) < 1e-9
    plan = {t: n for t, n, _ in planning.precision_plan(df)}
    first = next(n for n in range(200, 100_001) if planning.auroc_width(n, 0.12, 0.7) <= 0.05)
    assert plan["auroc"] == first and plan["observed_to_expected"] == math.ceil(math.ceil((1.96 / math.log(1.1)) ** 2) / 0.12)
    with pytest.raises(ValueError):
        planning.intercept_shift(df.limit(0), 0.12)


def test_contrasts_are_paired(spark):
    y, p, _ = noisy(150, 6, 50)
    df = frame(spark, y, p, g=["a"] * 150).unionByName(frame(spark, y, p, g=["b"] * 150))
    rows = resample.contrasts(df, "g", {"same": {"a": 1.0, "b": -1.0}, "sum": {"a": 1.0, "b": 1.0}}, 30).collect()
    same = [r for r in rows if r.effect == "same"]
    assert len(same) == 4 and all(abs(r.estimate) < 1e-12 and abs(r.upper) < 1e-12 and abs(r.lower) < 1e-12 for r in same)
    t = resample.bootstrap_thresholds(df.filter("g = 'a'"), [0.5], 30).collect()
    assert {r.metric for r in t} == {"alert_rate", "sensitivity", "ppv", "net_benefit"} and all(r.lower <= r.estimate <= r.upper for r in t)
