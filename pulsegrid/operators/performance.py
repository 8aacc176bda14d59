"""All metrics of a model in one row, calibration by groups, threshold tables, and strategies of two stages."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions.parse import logit
from pulsegrid.operators import metrics
from pulsegrid.session import checkpointed


def _same(groups: list[str], prefix: str) -> Column:
    out = F.lit(True)
    for g in groups:
        out = out & F.col(g).eqNullSafe(F.col(f"{prefix}{g}"))
    return out


def _joined(left: DataFrame, right: DataFrame, groups: list[str]) -> DataFrame:
    named = right.select(*[F.col(g).alias(f"_j_{g}") for g in groups], *[c for c in right.columns if c not in groups])
    return left.join(named, _same(groups, "_j_"), "left").drop(*[f"_j_{g}" for g in groups])


def calibration(df: DataFrame, groups: list[str] = [], weight: str | None = None, steps: int = 40, tol: float = 1e-10, alpha: float = 0.05) -> DataFrame:
    """groups, citl, citl_se, citl_lower, citl_upper, intercept, slope, slope_se, slope_lower, slope_upper.

    In the large: the intercept with logit(p) as an offset; infinite with the sign of the class if there is one class only. Intercept
    and slope: an unpenalised logistic fit on logit(p); NULL for one class, a constant logit or a fit that doesn't converge.

    All groups take their Newton steps together: one aggregate a step over the distinct scores, which are written once; only
    the coefficients of each group pass through the driver.
    """
    points = checkpointed(metrics.by_score(df, groups, weight).select(*groups, logit(F.col("p")).alias("lp"), "pos", (F.col("pos") + F.col("neg")).alias("n")).filter("n > 0"))
    start = points.groupBy(*groups).agg(F.sum("pos").alias("pos"), F.sum("n").alias("n"), F.max("lp").alias("hi"), F.min("lp").alias("lo")).collect()
    state = {tuple(r[g] for g in groups): {"c": 0.0, "a": 0.0, "b": 1.0, "c_open": 0 < r["pos"] < r["n"], "open": 0 < r["pos"] < r["n"] and r["hi"] - r["lo"] > 1e-12, "row": r} for r in start}
    kinds = [f"`_g_{g}` {points.schema[g].dataType.simpleString()}" for g in groups]
    schema = ", ".join([*kinds, "c double, a double, b double"])

    def sums(live: list[tuple]) -> dict:
        params = df.sparkSession.createDataFrame([(*k, state[k]["c"], state[k]["a"], state[k]["b"]) for k in live], schema)
        j = points.join(F.broadcast(params), _same(groups, "_g_"))  # the groups
        q, r = 1 / (1 + F.exp(-(F.col("c") + F.col("lp")))), 1 / (1 + F.exp(-(F.col("a") + F.col("b") * F.col("lp"))))
        e, h, n, lp = F.col("n") * r - F.col("pos"), F.col("n") * r * (1 - r), F.col("n"), F.col("lp")
        got = j.groupBy(*groups).agg(F.sum(n * q - F.col("pos")).alias("gc"), F.sum(n * q * (1 - q)).alias("hc"), F.sum(e).alias("g0"), F.sum(e * lp).alias("g1"), F.sum(h).alias("h00"), F.sum(h * lp).alias("h01"), F.sum(h * lp * lp).alias("h11"))
        return {tuple(x[g] for g in groups): x for x in got.collect()}

    for _ in range(steps):
        live = [k for k, s in state.items() if s["c_open"] or s["open"]]
        if not live:
            break
        for k, x in sums(live).items():
            s, total = state[k], state[k]["row"]["n"]
            s["hc"], s["h"] = x["hc"], (x["h00"], x["h01"], x["h11"])
            if s["c_open"]:
                if abs(x["gc"]) / total < tol:
                    s["c_open"] = False
                else:
                    s["c"] -= max(-2.0, min(2.0, x["gc"] / max(x["hc"], 1e-300)))
            if s["open"]:
                det = x["h00"] * x["h11"] - x["h01"] ** 2
                if max(abs(x["g0"]), abs(x["g1"])) / total < tol:
                    s["open"], s["done"] = False, True
                elif det <= 1e-12 * x["h00"] * x["h11"]:
                    s["open"] = False
                else:
                    da, db = (x["h11"] * x["g0"] - x["h01"] * x["g1"]) / det, (x["h00"] * x["g1"] - x["h01"] * x["g0"]) / det
                    size = min(1.0, 2.0 / max(abs(da), abs(db), 1e-300))
                    s["a"], s["b"] = s["a"] - size * da, s["b"] - size * db
    z = NormalDist().inv_cdf(1 - alpha / 2)
    rows = []
    for k, s in state.items():
        r = s["row"]
        one = float("-inf") if r["pos"] <= 0 else float("inf") if r["pos"] >= r["n"] else None
        c, c_se = (one, None) if one is not None else (s["c"], s["hc"] ** -0.5) if not s["c_open"] else (None, None)
        a = b = se = None
        if s.get("done"):
            h00, h01, h11 = s["h"]
            a, b, se = s["a"], s["b"], (h00 / (h00 * h11 - h01 * h01)) ** 0.5
        rows.append((*k, c, c_se, None if c_se is None else c - z * c_se, None if c_se is None else c + z * c_se, a, b, se, None if se is None else b - z * se, None if se is None else b + z * se))
    kinds = [f"`{g}` {points.schema[g].dataType.simpleString()}" for g in groups]
    names = "citl citl_se citl_lower citl_upper intercept slope slope_se slope_lower slope_upper".split()
    return df.sparkSession.createDataFrame(rows, ", ".join([*kinds, *[f"{x} double" for x in names]]))


def metric_bundle(df: DataFrame, groups: list[str] = [], weight: str | None = None) -> DataFrame:
    """groups, n, events, auroc, auprc, brier, scaled_brier, log_loss: one row a group."""
    out = metrics.overall(df, groups, weight).select(*groups, "n", "events", "brier", "scaled_brier", "log_loss")
    for m in (metrics.auroc, metrics.auprc):
        out = _joined(out, m(df, groups, weight), groups)
    return out.select(*groups, "n", "events", "auroc", "auprc", "brier", "scaled_brier", "log_loss")


def point_performance(df: DataFrame, groups: list[str] = [], weight: str | None = None) -> DataFrame:
    """All metrics of each group in one row: the bundle, event rate, AUPRC over it, calibration, O/E with its interval, ICI."""
    o = metrics.overall(df, groups, weight).select(*groups, "oe_ratio", "oe_lower", "oe_upper")
    out = metric_bundle(df, groups, weight)
    for part in (o, calibration(df, groups, weight), metrics.ici(df, groups, weight=weight)):
        out = _joined(out, part, groups)
    rate = F.try_divide(F.col("events").cast("double"), F.col("n"))
    return out.withColumn("event_rate", rate).withColumn("auprc_over_event_rate", F.try_divide(F.col("auprc"), rate))


def threshold_table(df: DataFrame, thresholds: list[float], groups: list[str] = [], patient: str | None = "patient_id") -> DataFrame:
    """:func:`metrics.workload` with alerts, true and false alerts per 1,000 cases."""
    w = metrics.workload(df, thresholds, groups, patient=patient)
    per = lambda c: 1000 * F.try_divide(c, F.col("n"))
    return w.withColumns({"alerts_per_1000": per(F.col("alerts")), "true_alerts_per_1000": per(F.col("tp")), "false_alerts_per_1000": per(F.col("fp"))})


def two_stage(df: DataFrame, thresholds: list[float], stage1: str = "stage1_alert", utility: list[float] | None = None) -> DataFrame:
    """Per threshold the strategy that alerts on the first stage's alert or a score at the threshold or over.

    A case with a first-stage alert needs no score; any other without one raises. Net benefit only at the thresholds of
    ``utility`` (all by default): a mixed strategy has no curve.
    """
    from pulsegrid.operators.checks import check_rows, require

    alert = F.coalesce(F.col(stage1) == 1, F.lit(False))
    require(check_rows(df, {"score_or_first_alert": alert | (F.col("p").between(0, 1) & ~F.isnan("p"))}), "two_stage")
    t = threshold_table(df.withColumn("p", F.when(alert, 1.0).otherwise(F.col("p"))), thresholds, patient=None)
    some = F.lit(True) if utility is None else F.col("threshold").isin(*[float(x) for x in utility])
    return t.select(
        "threshold", "n", "alerts", "alert_rate", "alerts_per_1000", "true_alerts_per_1000", "false_alerts_per_1000", "sensitivity", "specificity", "ppv", "alerts_per_tp", F.try_divide(F.col("fp"), F.col("tp")).alias("false_alerts_per_tp"),
        *[F.when(some, F.col(c)).alias(c) for c in ("net_benefit", "net_benefit_all", "avoided_per_100")],
    )
