"""Replicates of groups with more distinct scores than a task looks at at once: each score counts as itself."""

import numpy as np
from pyspark.sql import functions as F

from pulsegrid.operators import performance, reports, resample


def sample(spark, n=3000):
    """Patients with two rows each; a has n distinct scores, b two that nearly all rows have and a few others."""
    rng = np.random.default_rng(8)
    p = {"a": rng.uniform(0.02, 0.98, n), "b": np.where(np.arange(n) < 50, rng.uniform(0.02, 0.98, n), rng.choice([0.25, 0.75], n))}
    y = {m: (rng.uniform(0, 1, n) < 0.1 + 0.7 * v).astype(int) for m, v in p.items()}
    return spark.createDataFrame([(m, f"P{k // 2}", int(y[m][k]), float(p[m][k])) for m in p for k in range(n)], "model string, patient_id string, y int, p double")


def by_hand(y, p, w):
    """Of rows, each repeated as often as it was drawn."""
    i = np.repeat(np.arange(len(p)), w.astype(int))
    y, p = y[i], p[i]
    pos, neg, lp = np.sort(p[y == 1]), np.sort(p[y == 0]), np.log(p) - np.log1p(-p)
    below = (np.searchsorted(neg, pos) + np.searchsorted(neg, pos, side="right")) / 2
    scores, at = np.unique(p, return_inverse=True)
    hits, every = (np.bincount(at, v, len(scores))[::-1] for v in (y, np.ones(len(y))))
    edges = np.unique(np.quantile(p, np.arange(11) / 10))
    which = np.searchsorted(edges[1:-1], p, side="right")
    rate = np.bincount(which, y) / np.maximum(np.bincount(which), 1)
    brier = np.mean((y - p) ** 2)
    out = {"auroc": below.sum() / len(pos) / len(neg), "auprc": np.sum(hits * np.cumsum(hits) / np.cumsum(every)) / len(pos), "brier": brier, "scaled_brier": 1 - brier / np.mean(y) / (1 - np.mean(y))}
    out |= {"log_loss": -np.mean(y * np.log(p) + (1 - y) * np.log1p(-p)), "observed_expected_ratio": y.sum() / p.sum(), "ici": np.mean(np.abs(rate[which] - p))}
    for name, x in (("calibration_slope", np.column_stack([np.ones_like(lp), lp])), ("calibration_in_the_large", np.ones((len(lp), 1)))):
        beta, offset = np.zeros(x.shape[1]), lp * (name == "calibration_in_the_large")
        for _ in range(30):
            q = 1 / (1 + np.exp(-(x @ beta + offset)))
            beta -= np.linalg.solve((x * (q * (1 - q))[:, None]).T @ x, x.T @ (q - y))
        out[name] = beta[-1]
    return out


def test_every_score_counts_as_itself(spark, monkeypatch):
    df = sample(spark)
    rows = df.withColumn("key", F.xxhash64(F.lit(7), "patient_id")).toPandas()
    for held in (64_000_000, 7000):  # all replicates at once, and two
        monkeypatch.setattr(resample, "HELD", held, raising=False)
        got = {(r.model, r.replicate, r.metric): r.value for r in resample._replicated(df, ["model"], 5, 7, "patient_id", resample._metrics(resample.PAIRED)).collect()}
        assert len(got) == 2 * 6 * 9
        for model, own in rows.groupby("model"):
            w = resample.draws(own["key"].to_numpy(), np.arange(6))
            for k in range(6):
                for m, v in by_hand(own["y"].to_numpy(), own["p"].to_numpy(), w[:, k]).items():
                    assert abs(got[model, k, m] - v) < 1e-8, (model, k, m)


def test_many_groups(spark):
    """More groups than once were let through."""
    rows = spark.range(3 * 1200).select((F.col("id") % 1200).alias("g"), F.col("id").cast("string").alias("patient_id"), (F.col("id") % 2).cast("int").alias("y"), F.lit(0.5).alias("p"))
    assert resample.bootstrap(rows, ["g"], 2, metrics=("brier",)).filter("estimate = 0.25").count() == 1200


def test_report_of_many_scores(spark):
    df = sample(spark).withColumn("patient_id", F.concat("patient_id", F.monotonically_increasing_id().cast("string")))
    got = resample.paired_validation(df, "model", "a", [0.3], [0.3], replicates=20).filter("threshold is null")
    names = {"auroc": "auroc", "auprc": "auprc", "brier": "brier", "scaled_brier": "scaled_brier", "log_loss": "log_loss", "observed_expected_ratio": "oe_ratio", "calibration_slope": "slope", "calibration_in_the_large": "citl", "ici": "ici"}
    point = performance.point_performance(df, ["model"]).select("model", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(c).alias("value")) for m, c in names.items()])).alias("r")).select("model", "r.*")
    table = reports.performance_table(point, got, "model", "a", 1e-6)
    assert table.count() == 3 * 9 and table.filter("shown like '% (% to %)'").count() == 3 * 9
