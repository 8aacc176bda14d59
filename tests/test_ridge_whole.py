"""Cross-validation over all features and penalties, and capacity from a rule's alerts."""

import numpy as np

from pulsegrid.operators import fit, landmark
from pulsegrid.plans import reference


def test_lockstep_agrees_with_single_fits(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(0, [1, 20, 1], (300, 3)) + [0, 90, 3]
    x[:, 2] = 2.0  # constant
    y = (rng.uniform(0, 1, 300) < 1 / (1 + np.exp(-(x[:, 0] + 0.05 * (x[:, 1] - 90))))).astype(int)
    df = spark.createDataFrame([(f"P{k % 120}", *map(float, r), int(t)) for k, (r, t) in enumerate(zip(x, y))], "patient_id string, a double, b double, c double, y int")
    rows, best = fit.ridge_cv(df, ["a", "b", "c"], [0.0, 0.03, 10.0], folds=3)
    data = df.join(fit.grouped_folds(df, "patient_id", 3), "patient_id").toPandas()
    for r in rows:
        losses = []
        for fold in range(3):
            one = fit.ridge_logistic(spark.createDataFrame(data[data.fold != fold]), ["a", "b", "c"], r["l2"])
            held = data[data.fold == fold]
            z = one.intercept + held[["a", "b", "c"]].to_numpy() @ one.coefficients
            losses.append(np.mean(np.logaddexp(0, z) - held["y"] * z))
        assert abs(r["mean_log_loss"] - np.mean(losses)) < 1e-9
    assert best == min(rows, key=lambda r: r["mean_log_loss"])["l2"]


def test_queries_use_every_feature_and_penalty(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(reference, "_design", lambda *_: "design")
    monkeypatch.setattr(fit, "ridge_cv", lambda df, features, grid: seen.append((list(features), list(grid))) or ([{"l2": 0.1, "mean_log_loss": 0.5}], 0.1))
    monkeypatch.setattr(fit, "ridge_logistic", lambda df, features, l2: seen.append((list(features), l2)) or fit.Fit(tuple(features), 0.0, np.zeros(len(features)), np.zeros((1, 1)), True, 1, 0.0))
    reference.ridge_cv(spark, "")
    assert reference.ridge_fit(spark, "").count() == 19
    grid = [0.0, 1e-6, 1e-5, 1e-4, 1e-3, 1e-2, 0.1, 1.0, 10.0, 100.0]
    assert seen == [(list(landmark.FEATURES), grid)] * 2 + [(list(landmark.FEATURES), 0.1)]


def test_capacity_follows_the_rule(spark, monkeypatch):
    rows = spark.createDataFrame([(f"c{k}", k % 2, k / 100, 60.0 if k < 33 else 70.0) for k in range(50)], "case_id string, y int, p double, landmark_map double")
    monkeypatch.setattr(reference, "scored", lambda *_: rows)
    r = reference.topk_capacity(spark, "").first()
    assert (r.k, r.events) == (33, 17)


def test_groups_are_dealt_largest_first():
    """Against the plain greedy rule, group by group."""
    import random

    from pulsegrid.operators.fit import deal

    rng = random.Random(3)
    for _ in range(30):
        histogram = [(s, rng.randrange(1, 40)) for s in rng.sample(range(1, 30), rng.randrange(1, 6))]
        rows, groups = [0] * 5, [0] * 5
        for size, m in sorted(histogram, reverse=True):
            for _ in range(m):
                f = min(range(5), key=lambda f: (rows[f], groups[f], f))
                rows[f] += size
                groups[f] += 1
        got = deal(histogram, 5)
        assert sorted(sum(s * c[f] for s, c in got.items()) for f in range(5)) == sorted(rows)
        assert all(sum(got[s]) == m for s, m in histogram)


def test_folds_hold_whole_groups_and_balance(spark):
    from pyspark.sql import functions as F

    from pulsegrid.operators.fit import grouped_folds

    df = spark.range(3000).select(F.concat(F.lit("P"), F.floor(F.sqrt("id"))).alias("patient_id"))
    folds = grouped_folds(df, "patient_id").collect()
    assert len(folds) == df.distinct().count() == len({r.patient_id for r in folds})
    n = {r.patient_id: r["count"] for r in df.groupBy("patient_id").count().collect()}
    loads = [sum(n[r.patient_id] for r in folds if r.fold == f) for f in range(5)]
    rows, groups = [0] * 5, [0] * 5
    for size in sorted(n.values(), reverse=True):
        f = min(range(5), key=lambda f: (rows[f], groups[f], f))
        rows[f] += size
        groups[f] += 1
    assert sorted(loads) == sorted(rows)
