"""Discrimination, calibration and utility of probabilities, as aggregates by any group columns, with optional weights.

Frames hold ``y`` (0 or 1), ``p`` in [0, 1] and where needed ``w`` and ``patient_id``; groups are any further columns. Ranks over all
scores are never taken in one task: distinct scores are parted into intervals of about equal numbers, each interval is ranked by itself,
and the totals of the intervals before it are added. Quantiles are read off the same running counts.
"""

from __future__ import annotations

import math
from functools import reduce
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

INTERVALS = 256  # into which the distinct values of a column are parted, whatever their distribution


def _w(df: DataFrame, weight: str | None) -> Column:
    return F.col(weight).cast("double") if weight else F.lit(1.0)


def by_score(df: DataFrame, groups: list[str], weight: str | None = None) -> DataFrame:
    """One row per group and distinct score: pos and neg, the weights of events and non-events."""
    w = _w(df, weight)
    return df.filter(F.col("p").isNotNull() & F.col("y").isNotNull()).groupBy(*groups, "p").agg(F.sum(F.when(F.col("y") == 1, w).otherwise(0.0)).alias("pos"), F.sum(F.when(F.col("y") == 0, w).otherwise(0.0)).alias("neg"))


def with_cut(df: DataFrame, column: str, out: str = "_cut") -> DataFrame:
    """``df`` (one row per distinct value, in any number of groups) with the interval its value lies in: intervals hold about as many rows each.

    Borders come from a bounded sketch of the column; they only say where intervals begin, so results stay exact.
    """
    at = F.array(*[F.lit(k / INTERVALS) for k in range(1, INTERVALS)])
    borders = df.agg(F.array_distinct(F.percentile_approx(column, at, F.lit(10 * INTERVALS))).alias("_borders"))
    return df.crossJoin(F.broadcast(borders)).withColumn(out, F.expr(f"coalesce(size(filter(_borders, x -> x < `{column}`)), 0)")).drop("_borders")  # one row of borders


def running(df: DataFrame, groups: list[str], columns: list[str], descending: bool = False, by: str = "p") -> DataFrame:
    """``df`` with ``<column>_run``, the sum up to and including the row in order of ``by`` within its group; one row per distinct value."""
    df = with_cut(df, by)
    order, cuts = (F.col(by).desc(), F.col("_cut").desc()) if descending else (F.col(by), F.col("_cut"))
    totals = df.groupBy(*groups, "_cut").agg(*[F.sum(c).alias(f"_t_{c}") for c in columns])
    before = Window.partitionBy(*(groups or [F.lit(0)])).orderBy(cuts).rowsBetween(Window.unboundedPreceding, -1)  # INTERVALS rows a group
    totals = totals.withColumns({f"_b_{c}": F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0.0)) for c in columns})
    totals = totals.select(*[F.col(g).alias(f"_g_{g}") for g in groups], F.col("_cut").alias("_c"), *[f"_b_{c}" for c in columns])
    within = Window.partitionBy(*groups, "_cut").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumns({f"_r_{c}": F.sum(c).over(within) for c in columns})
    same = reduce(Column.__and__, [F.col(g).eqNullSafe(F.col(f"_g_{g}")) for g in groups], F.col("_cut") == F.col("_c"))
    joined = df.join(totals, same)
    return joined.withColumns({f"{c}_run": F.col(f"_r_{c}") + F.col(f"_b_{c}") for c in columns}).select(*[c for c in df.columns if not c.startswith("_")], *[f"{c}_run" for c in columns])


def quantiles(df: DataFrame, groups: list[str], column: str, at: list[float]) -> DataFrame:
    """groups, n and ``q``, the exact quantiles of a column (linear between neighbours), read off running counts: no task holds a group's values.

    NULL and NaN are left out; a group of nothing else has no row.
    """
    v = F.col(column).cast("double")
    counts = df.filter(v.isNotNull() & ~F.isnan(v)).groupBy(*groups, v.alias("_v")).agg(F.count("*").cast("double").alias("c"))
    r = running(counts.withColumnRenamed("_v", "v"), groups, ["c"], by="v")
    n = counts.groupBy(*[F.col(g).alias(f"_n_{g}") for g in groups]).agg(F.sum("c").alias("_n"))
    same = reduce(Column.__and__, [F.col(g).eqNullSafe(F.col(f"_n_{g}")) for g in groups], F.lit(True))
    ends = r.join(F.broadcast(n) if not groups else n, same)
    low, high = [], []
    for q in at:
        rank = (F.col("_n") - 1) * F.lit(float(q))
        for side, k in ((low, F.floor(rank)), (high, F.ceil(rank))):
            side.append(F.max(F.when((F.col("c_run") - F.col("c") <= k) & (k < F.col("c_run")), F.col("v"))))
    share = lambda q: (F.col("_n") - 1) * F.lit(float(q)) - F.floor((F.col("_n") - 1) * F.lit(float(q)))
    agg = ends.groupBy(*groups).agg(F.max("_n").alias("_n"), *[c.alias(f"_l{k}") for k, c in enumerate(low)], *[c.alias(f"_h{k}") for k, c in enumerate(high)])
    return agg.select(*groups, F.col("_n").cast("bigint").alias("n"), F.array(*[F.col(f"_l{k}") + (F.col(f"_h{k}") - F.col(f"_l{k}")) * share(q) for k, q in enumerate(at)]).alias("q"))


def auroc(df: DataFrame, groups: list[str] = [], weight: str | None = None) -> DataFrame:
    """Exact area under the ROC curve; ties count half; NULL with one class only."""
    r = running(by_score(df, groups, weight), groups, ["neg"])
    agg = r.groupBy(*groups).agg(F.sum(F.col("pos") * (F.col("neg_run") - 0.5 * F.col("neg"))).alias("a"), F.sum("pos").alias("pp"), F.sum("neg").alias("nn"))
    return agg.select(*groups, F.try_divide(F.col("a"), F.col("pp") * F.col("nn")).alias("auroc"))


def auprc(df: DataFrame, groups: list[str] = [], weight: str | None = None) -> DataFrame:
    """Average precision in steps; equal scores are one step; NULL without events."""
    r = running(by_score(df, groups, weight), groups, ["pos", "neg"], descending=True)
    step = F.col("pos") * F.try_divide(F.col("pos_run"), F.col("pos_run") + F.col("neg_run"))
    return r.groupBy(*groups).agg(F.try_divide(F.sum(step), F.sum("pos")).alias("auprc"))


def pr_curve(df: DataFrame, groups: list[str] = [], weight: str | None = None) -> DataFrame:
    r = running(by_score(df, groups, weight), groups, ["pos", "neg"], descending=True)
    total = by_score(df, groups, weight).groupBy(*[F.col(g).alias(f"_g_{g}") for g in groups]).agg(F.sum("pos").alias("_all"))
    same = reduce(Column.__and__, [F.col(g).eqNullSafe(F.col(f"_g_{g}")) for g in groups], F.lit(True))
    return r.join(F.broadcast(total) if not groups else total, same).select(*groups, F.col("p").alias("threshold"), F.try_divide(F.col("pos_run"), F.col("pos_run") + F.col("neg_run")).alias("precision"), F.try_divide(F.col("pos_run"), F.col("_all")).alias("recall"))


def overall(df: DataFrame, groups: list[str] = [], weight: str | None = None, alpha: float = 0.05) -> DataFrame:
    """n, events, Brier score, its scaled form, log loss, observed/expected with a log-normal interval; one aggregate."""
    w, y = _w(df, weight), F.col("y").cast("double")
    q = F.greatest(F.least(F.col("p"), F.lit(1 - 1e-12)), F.lit(1e-12))
    agg = df.groupBy(*groups).agg(
        F.count("*").alias("n"), F.sum(F.when(F.col("y") == 1, 1).otherwise(0)).alias("events"), F.sum(w).alias("sw"), F.sum(w * y).alias("observed"), F.sum(w * F.col("p")).alias("expected"),
        F.sum(w * (y - F.col("p")) * (y - F.col("p"))).alias("sq"), F.sum(-w * (y * F.log(q) + (1 - y) * F.log1p(-q))).alias("ll"),
    )
    z = NormalDist().inv_cdf(1 - alpha / 2)
    prevalence = F.try_divide(F.col("observed"), F.col("sw"))
    brier, ratio = F.try_divide(F.col("sq"), F.col("sw")), F.try_divide(F.col("observed"), F.col("expected"))
    half = F.exp(z / F.sqrt(F.col("observed")))
    some = F.col("observed") > 0
    return agg.select(
        *groups, "n", F.col("events").cast("bigint").alias("events"), brier.alias("brier"), (1 - F.try_divide(brier, prevalence * (1 - prevalence))).alias("scaled_brier"), F.try_divide(F.col("ll"), F.col("sw")).alias("log_loss"),
        ratio.alias("oe_ratio"), F.when(some, F.try_divide(ratio, half)).when(F.col("observed") == 0, 0.0).alias("oe_lower"),
        F.when(some, ratio * half).otherwise(F.try_divide(F.lit(-math.log(alpha / 2)), F.col("expected"))).alias("oe_upper"),
    )


def bin_edges(df: DataFrame, groups: list[str], bins: int = 10) -> DataFrame:
    """Groups and ``edges``, the distinct interpolated quantiles of p (unweighted)."""
    return quantiles(df, groups, "p", [k / bins for k in range(bins + 1)]).select(*groups, F.array_distinct("q").alias("edges"))


def calibration_bins(df: DataFrame, groups: list[str] = [], bins: int = 10, weight: str | None = None) -> DataFrame:
    """Bins of about equal frequency: bin, n, weight, min_p, max_p, mean_p, observed, gap. The bin is the number of inner edges at or below p."""
    edges = bin_edges(df, groups, bins).select(*[F.col(g).alias(f"_g_{g}") for g in groups], "edges")
    same = reduce(Column.__and__, [F.col(g).eqNullSafe(F.col(f"_g_{g}")) for g in groups], F.lit(True))
    binned = df.join(F.broadcast(edges) if not groups else edges, same).withColumn("bin", F.expr("size(filter(slice(edges, 2, greatest(size(edges) - 2, 0)), e -> e <= p))"))
    w = _w(df, weight)
    agg = binned.groupBy(*groups, "bin").agg(
        F.count("*").alias("n"), F.sum(w).alias("weight"), F.min("p").alias("min_p"), F.max("p").alias("max_p"), F.try_divide(F.sum(w * F.col("p")), F.sum(w)).alias("mean_p"), F.try_divide(F.sum(w * F.col("y")), F.sum(w)).alias("observed")
    )
    return agg.withColumn("gap", F.abs(F.col("observed") - F.col("mean_p")))


def ici(df: DataFrame, groups: list[str] = [], bins: int = 10, weight: str | None = None) -> DataFrame:
    """The mean distance between each score and the observed rate of its bin."""
    b = calibration_bins(df, groups, bins, weight).select(*[F.col(g).alias(f"_h_{g}") for g in groups], F.col("min_p").alias("_lo"), F.col("max_p").alias("_hi"), F.col("observed").alias("_rate"))
    same = reduce(Column.__and__, [F.col(g).eqNullSafe(F.col(f"_h_{g}")) for g in groups], F.col("p").between(F.col("_lo"), F.col("_hi")))
    w = _w(df, weight)
    return df.join(F.broadcast(b) if not groups else b, same).groupBy(*groups).agg(F.try_divide(F.sum(w * F.abs(F.col("_rate") - F.col("p"))), F.sum(w)).alias("ici"))


def score_group_error(df: DataFrame, groups: list[str] = []) -> DataFrame:
    """The mean distance between each distinct score and its observed rate, weighted by rows."""
    g = by_score(df, groups)
    n = F.col("pos") + F.col("neg")
    return g.groupBy(*groups).agg(F.try_divide(F.sum(n * F.abs(F.col("pos") / n - F.col("p"))), F.sum(n)).alias("score_group_error"))


def workload(df: DataFrame, thresholds: list[float], groups: list[str] = [], weight: str | None = None, patient: str | None = "patient_id") -> DataFrame:
    """Per threshold: alerts, TP, FP, FN, TN, rates and net benefit; ratios without a denominator are NULL.

    A row is summed up under the number of thresholds at or below its score, so rows aren't multiplied by thresholds. A NULL score
    is no alert, a NULL label no event.
    """
    w = _w(df, weight)
    ts = sorted({float(x) for x in thresholds})
    # The number of thresholds at or below a score; a row is summed up once, under it, and meets the thresholds afterwards.
    rows = df.withColumn("_w", w).withColumn("_k", sum((F.coalesce(F.col("p") >= F.lit(t), F.lit(False)).cast("int") for t in ts), F.lit(0)))
    y = F.coalesce(F.col("y") == 1, F.lit(False))
    sums = rows.groupBy(*groups, "_k").agg(F.sum(F.when(y, F.col("_w")).otherwise(0.0)).alias("_p"), F.sum(F.when(y, F.lit(0.0)).otherwise(F.col("_w"))).alias("_q"))
    each = sums.withColumn("_t", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(t).alias("threshold")) for k, t in enumerate(ts)])))
    over = F.col("_k") > F.col("_t.k")
    a = each.groupBy(*groups, F.col("_t.threshold").alias("threshold")).agg(
        F.sum(F.col("_p") + F.col("_q")).alias("n"), *[F.sum(F.when(c, F.col(v)).otherwise(0.0)).alias(x) for x, v, c in (("tp", "_p", over), ("fp", "_q", over), ("fn", "_p", ~over), ("tn", "_q", ~over))]
    )
    if patient:
        # Per patient only the highest score counts, of all rows and of events.
        own = rows.groupBy(*groups, patient).agg(F.max("_k").alias("_all"), F.max(F.when(y, F.col("_k"))).alias("_hit")).filter(F.col(patient).isNotNull())
        told = own.withColumn("_t", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(t).alias("threshold")) for k, t in enumerate(ts)])))
        told = told.groupBy(*[F.col(g).alias(f"_g_{g}") for g in groups], F.col("_t.threshold").alias("_at")).agg(F.count_if(F.col("_all") > F.col("_t.k")).alias("patients_alerted"), F.count_if(F.col("_hit") > F.col("_t.k")).alias("patients_captured"))
        same = reduce(Column.__and__, [F.col(g).eqNullSafe(F.col(f"_g_{g}")) for g in groups], F.col("threshold") == F.col("_at"))
        a = a.join(told, same, "left").withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in ("patients_alerted", "patients_captured")})
    odds = F.col("threshold") / (1 - F.col("threshold"))
    alerts, nb = F.col("tp") + F.col("fp"), F.try_divide(F.col("tp") - F.col("fp") * odds, F.col("n"))
    every = F.try_divide(F.col("tp") + F.col("fn") - (F.col("fp") + F.col("tn")) * odds, F.col("n"))
    prevalence = F.try_divide(F.col("tp") + F.col("fn"), F.col("n"))
    return a.select(
        *groups, "threshold", "n", alerts.alias("alerts"), F.try_divide(alerts, F.col("n")).alias("alert_rate"), "tp", "fp", "fn", "tn",
        F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")).alias("sensitivity"), F.try_divide(F.col("tn"), F.col("tn") + F.col("fp")).alias("specificity"),
        F.try_divide(F.col("tp"), alerts).alias("ppv"), F.try_divide(F.col("tn"), F.col("tn") + F.col("fn")).alias("npv"), F.try_divide(alerts, F.col("tp")).alias("alerts_per_tp"),
        *(["patients_alerted", "patients_captured"] if patient else []),
        nb.alias("net_benefit"), every.alias("net_benefit_all"), F.try_divide(nb, prevalence).alias("standardised_net_benefit"), (100 * F.try_divide(nb - every, odds)).alias("avoided_per_100"),
    )


def top_k(df: DataFrame, k: int, tie: str) -> DataFrame:
    """The k rows with the highest scores, ties by ``tie``: a limit that is the feature, kept per partition before it is merged."""
    return df.orderBy(F.col("p").desc(), F.col(tie)).limit(k)


def capacity_thresholds(df: DataFrame, fractions: list[float]) -> DataFrame:
    """fraction, threshold: the score at index ceil((n - 1)(1 - fraction)) in ascending order, found from running counts."""
    counts = df.filter(F.col("p").isNotNull()).groupBy("p").agg(F.count("*").cast("double").alias("c"))
    r = running(counts, [], ["c"])
    n = df.agg(F.count("p").alias("_n"))
    f = F.explode(F.array(*[F.lit(float(x)) for x in fractions])).alias("fraction")
    wanted = n.select("_n", f).withColumn("_at", F.ceil(F.round((F.col("_n") - 1) * (1 - F.col("fraction")), 9)) + 1)
    return r.join(F.broadcast(wanted), (F.col("c_run") >= F.col("_at")) & (F.col("c_run") - F.col("c") < F.col("_at"))).select("fraction", F.col("p").alias("threshold"))
