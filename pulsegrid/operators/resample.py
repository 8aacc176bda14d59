"""Patient bootstrap: whole patients drawn with replacement, the same draw for all models and metrics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.session import checkpointed

CORE = ("auroc", "auprc", "brier", "log_loss")
FACTORIAL = (*CORE, "calibration_slope", "calibration_in_the_large")
PAIRED = (*FACTORIAL, "scaled_brier", "observed_expected_ratio", "ici")
BLOCK = 100  # replicates that a task makes of one group
INTERVALS = 1024  # distinct scores looked at at once, in BLOCK replicates
CELLS = 200_000  # rows times replicates that are drawn at once
HELD = 64_000_000  # distinct scores times replicates whose counts a task holds at once; a byte each for events and for others, more where a count needs it
Pieces = list[tuple[np.ndarray, np.ndarray, np.ndarray]]  # ascending distinct scores, and the events and others of each (rows) in each replicate (columns)
_LIMITS = np.cumsum(np.exp(-1) / np.cumprod([1.0, *range(1, 12)]))  # of a Poisson count of mean 1


def draws(key: np.ndarray, replicates: np.ndarray) -> np.ndarray:
    """How often each patient, given by a 64-bit hash, is drawn in each replicate; ones for replicate 0, which is the sample itself.

    Each patient draws its own count from a Poisson distribution of mean 1 by mixing its hash with the replicate: the limit of
    drawing n of n with replacement, without a table of draws. All rows and all models of a patient get the same draw, so
    contrasts are paired.
    """
    with np.errstate(over="ignore"):
        x = key.astype(np.uint64)[:, None] + np.asarray(replicates, np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    w = np.searchsorted(_LIMITS, ((x >> np.uint64(11)).astype(float) + 0.5) / float(1 << 53)).astype(float)
    w[:, np.asarray(replicates) == 0] = 1.0
    return w


def _least(counts: np.ndarray) -> np.ndarray:
    """``counts`` in as few bytes as hold them."""
    return counts.astype(next((t for t in (np.uint8, np.uint16, np.uint32) if counts.max(initial=0) <= np.iinfo(t).max), float))


def _drawn(p: np.ndarray, y: np.ndarray, key: np.ndarray, starts: np.ndarray, replicates: np.ndarray, size: int) -> Pieces:
    """The draws of rows (by p, then y), added up by distinct score; ``starts``: where each score begins. Pieces have ``size`` scores."""
    out, ends = [], np.append(starts[1:], len(p))
    for k in range(0, len(starts), size):
        scores = starts[k : k + size]
        sums = np.zeros((2 * len(scores), len(replicates)))
        step = CELLS // len(replicates) + 1
        for a in range(scores[0], ends[k : k + size][-1], step):
            b = min(a + step, ends[k : k + size][-1])
            cell = (np.searchsorted(scores, np.arange(a, b), side="right") - 1) * 2 + (y[a:b] != 1)
            order = np.argsort(cell, kind="stable")
            first = np.flatnonzero(np.append(True, np.diff(cell[order]) != 0))
            sums[cell[order][first]] += np.add.reduceat(draws(key[a:b][order], replicates), first, axis=0)
        out.append((p[scores], _least(sums[::2]), _least(sums[1::2])))
    return out


def _newton(pieces: Pieces, some: np.ndarray, slope: bool, centre: float = 0.0, scale: float = 1.0) -> np.ndarray:
    """Coefficients (intercept, slope) of unpenalised logistic fits on (logit(p) - centre) / scale, one per replicate of ``some``; NaN where none exists."""

    def solve(pieces: Pieces, at: np.ndarray, start: np.ndarray) -> np.ndarray:
        lps = [(_logit(p) - centre) / scale for p, _, _ in pieces]
        events, total, turned = (np.zeros(len(at)) for _ in range(3))
        for lp, (_, pos, neg) in zip(lps, pieces, strict=True):
            events, total, turned = events + pos[:, at].sum(0, dtype=float), total + pos[:, at].sum(0, dtype=float) + neg[:, at].sum(0, dtype=float), turned + lp @ pos[:, at]
        beta, open_ = np.repeat(start[:, None], len(at), axis=1), np.arange(len(at))
        for _ in range(60):
            g0, g1, h00, h01, h11 = -events[open_], -turned[open_], *(np.zeros(len(open_)) for _ in range(3))
            for lp, (_, pos, neg) in zip(lps, pieces, strict=True):
                n = pos[:, at[open_]].astype(float)
                n += neg[:, at[open_]]
                q = lp[:, None] * -beta[1, open_]
                q -= beta[0, open_]
                np.exp(q, out=q)
                q += 1
                np.reciprocal(q, out=q)
                n *= q
                g0 += n.sum(0)
                g1 += lp @ n
                q -= 1
                n *= q  # weights of the Hessian, negative
                h00 -= n.sum(0)
                if slope:
                    h01 -= lp @ n
                    h11 -= (lp * lp) @ n
            if slope:
                det = h00 * h11 - h01 * h01
                step = np.array([h11 * g0 - h01 * g1, h00 * g1 - h01 * g0]) / det
                size = np.maximum(np.abs(g0), np.abs(g1)) / total[open_]
                step[:, det <= 1e-12 * h00 * h11] = np.nan
            else:
                step, size = np.array([g0 / h00, np.zeros(len(open_))]), np.abs(g0) / total[open_]
            done = size < 1e-10
            step *= np.minimum(1, 2 / np.maximum(np.abs(step).max(0), 1e-300))
            beta[:, open_] -= np.where(done, 0.0, step)
            lost = ~done & ~np.isfinite(beta[:, open_]).all(0)
            beta[:, open_[lost]] = np.nan
            open_ = open_[~done & ~lost]
            if not len(open_):
                return beta
        beta[:, open_] = np.nan
        return beta

    with np.errstate(all="ignore"):
        # All replicates together begin; each goes on from where they end.
        all_ = [(p, pos.sum(1, dtype=float)[:, None], neg.sum(1, dtype=float)[:, None]) for p, pos, neg in pieces]
        first = solve(all_, np.arange(1), np.array([0.0, 1.0]))[:, 0]
        return solve(pieces, np.flatnonzero(some), first if np.isfinite(first).all() else np.array([0.0, 1.0]))


def _logit(p: np.ndarray) -> np.ndarray:
    clipped = np.clip(p, 1e-12, 1 - 1e-12)
    return np.log(clipped) - np.log1p(-clipped)


def _ici(pieces: Pieces, bins: int = 10) -> np.ndarray:
    """As metrics.ici on rows repeated as they were drawn; the bins are those of each replicate."""
    total = sum(pos.sum(0, dtype=float) + neg.sum(0, dtype=float) for _, pos, neg in pieces)
    at = np.arange(bins + 1) / bins * (total[:, None] - 1)
    ranks = np.concatenate([np.floor(at), np.ceil(at)], axis=1)
    found, before = np.full(ranks.shape, np.nan), np.zeros(len(total))
    for p, pos, neg in pieces:
        run = (before + np.cumsum(pos + neg.astype(float), axis=0)).T
        here = (ranks >= before[:, None]) & (ranks < run[:, -1:])
        for k in np.flatnonzero(here.any(1)):
            found[k, here[k]] = p[np.searchsorted(run[k], ranks[k, here[k]], side="right")]
        before = run[:, -1].copy()
    low, high = found[:, : bins + 1], found[:, bins + 1 :]
    edges = low + (high - low) * (at - np.floor(at))
    inner = np.full((len(total), bins - 1), np.inf)
    for k in np.flatnonzero(total > 0):
        own = np.unique(edges[k])[1:-1]
        inner[k, : len(own)] = own
    each = np.arange(len(total))[:, None]
    sums = lambda c: np.concatenate([np.zeros((1, c.shape[1])), np.cumsum(c, axis=0)])

    def borders(p: np.ndarray) -> np.ndarray:
        cut = np.searchsorted(p, inner.ravel()).reshape(inner.shape)
        return np.column_stack([np.zeros(len(cut), int), cut, np.full(len(cut), len(p))])

    n, hit = (np.zeros((len(total), bins)) for _ in range(2))
    for p, pos, neg in pieces:
        b, a, c = borders(p), sums(pos.astype(float)), sums(neg.astype(float))
        n += a[b[:, 1:], each] - a[b[:, :-1], each] + c[b[:, 1:], each] - c[b[:, :-1], each]
        hit += a[b[:, 1:], each] - a[b[:, :-1], each]
    rate = hit / np.where(n > 0, n, 1)
    gap = np.zeros(len(total))
    for p, pos, neg in pieces:
        b, w = borders(p), pos + neg.astype(float)
        s, t = sums(w), sums(w * p[:, None])
        lo, hi = b[:, :-1], b[:, 1:]
        mid = np.clip(np.searchsorted(p, rate.ravel()).reshape(rate.shape), lo, hi)  # scores below the rate of their bin end here
        gap += (rate * (2 * s[mid, each] - s[lo, each] - s[hi, each]) - 2 * t[mid, each] + t[lo, each] + t[hi, each]).sum(1)
    with np.errstate(all="ignore"):
        return np.where(total > 0, gap / total, np.nan)


def _measures(pieces: Pieces, names: tuple[str, ...]) -> dict[str, np.ndarray]:
    """Each metric under each replicate; NaN where it isn't defined."""
    unknown = set(names) - set(PAIRED)
    if unknown:
        raise ValueError(f"unknown metric {min(unknown)}")
    events, others, area, steps, squares, loss, expected = (np.zeros(pieces[0][1].shape[1]) for _ in range(7))
    out: dict[str, np.ndarray] = {}
    with np.errstate(all="ignore"):
        for p, pos, neg in reversed(pieces):
            pos, neg = pos.astype(float), neg.astype(float)
            tp, fp = (run + np.cumsum(c[::-1], axis=0)[::-1] for run, c in ((events, pos), (others, neg)))
            if "auroc" in names:
                area += (neg * (tp - 0.5 * pos)).sum(0)
            if "auprc" in names:
                steps += np.where(pos > 0, pos * tp / (tp + fp), 0.0).sum(0)
            clipped = np.clip(p, 1e-12, 1 - 1e-12)
            squares += ((1 - p) ** 2) @ pos + (p**2) @ neg
            loss -= np.log(clipped) @ pos + np.log1p(-clipped) @ neg
            expected += p @ pos + p @ neg
            events, others = tp[0], fp[0]
        total, both = events + others, (events > 0) & (others > 0)
        brier, prevalence = squares / total, events / total
        for name in names:
            if name == "auroc":
                out[name] = area / (events * others)
            elif name == "auprc":
                out[name] = steps / events
            elif name == "brier":
                out[name] = brier
            elif name == "scaled_brier":
                out[name] = 1 - brier / (prevalence * (1 - prevalence))
            elif name == "log_loss":
                out[name] = loss / total
            elif name == "observed_expected_ratio":
                out[name] = events / expected
            elif name == "calibration_slope":
                out[name] = _slope(pieces, both)
            elif name == "calibration_in_the_large":
                out[name] = _in_the_large(pieces, both)
            elif name == "ici":
                out[name] = _ici(pieces)
    return out


def _slope(pieces: Pieces, some: np.ndarray) -> np.ndarray:
    out, lp = np.full(len(some), np.nan), [_logit(p) for p, _, _ in pieces]
    n = sum(map(len, lp))
    centre = sum(x.sum() for x in lp) / n
    scale = np.sqrt(sum(((x - centre) ** 2).sum() for x in lp) / n)
    if scale > 1e-12:
        out[some] = _newton(pieces, some, True, centre, scale)[1] / scale
    return out


def _in_the_large(pieces: Pieces, some: np.ndarray) -> np.ndarray:
    out = np.full(len(some), np.nan)
    out[some] = _newton(pieces, some, False)[0]
    return out


def _piece(y: np.ndarray, p: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    starts = np.flatnonzero(np.append(True, p[1:] != p[:-1]))
    return p[starts], *(np.add.reduceat(w * c[:, None], starts, axis=0) for c in (y, 1 - y))


def weighted_metrics(y: np.ndarray, p: np.ndarray, w: np.ndarray, names: tuple[str, ...]) -> dict[str, np.ndarray]:
    """Each metric of the rows (in order of p) under each column of weights; NaN where it isn't defined."""
    return _measures([_piece(y, p, w)], names)


def _replicated(df: DataFrame, groups: list[str], replicates: int, seed: int, patient: str, compute) -> DataFrame:
    """groups, replicate (0: the sample itself), threshold, metric, value of ``compute(pieces)``, which yields threshold, metric, values.

    Every distinct score counts as itself, however many there are. The rows of a group (score, outcome and hash of the patient: 17 bytes)
    go to one task for each block of replicates, so tasks are as many as groups and blocks. A task draws the counts of its rows and adds
    them up by distinct score, for as many replicates at once as HELD allows, and computes metrics piece by piece of the scores.
    """
    blocks, size, most = -(-(replicates + 1) // BLOCK), INTERVALS, HELD
    rows = df.filter(F.col("p").isNotNull() & F.col("y").isNotNull()).select(
        *groups, F.xxhash64(F.lit(seed), F.col(patient)).alias("_key"), (F.col("y") == 1).cast("tinyint").alias("_y"), F.col("p").cast("double").alias("_p"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_block")
    )
    kinds = "".join(f"`{g}` {rows.schema[g].dataType.simpleString()}, " for g in groups)

    def run(key: tuple, table: pa.Table) -> pa.Table:
        block = key[-1].as_py()
        wanted = np.arange(block * BLOCK, min((block + 1) * BLOCK, replicates + 1))
        p, y = table["_p"].to_numpy(), table["_y"].to_numpy()
        order = np.lexsort((y, p))
        p, y, hashed = p[order], y[order], table["_key"].to_numpy()[order]
        starts = np.flatnonzero(np.append(True, p[1:] != p[:-1]))
        at_once = int(min(len(wanted), max(1, most // len(starts))))
        out = []
        for k in range(0, len(wanted), at_once):
            some = wanted[k : k + at_once]
            made = compute(_drawn(p, y, hashed, starts, some, size * max(1, BLOCK // len(some))))
            each = lambda values, kind: pa.array([v for v in values for _ in some], kind)  # noqa: E731, B023
            columns = [pa.array(np.tile(some, len(made)), pa.int32()), each([t for t, _, _ in made], pa.float64()), each([m for _, m, _ in made], pa.string()), pa.array(np.concatenate([x for _, _, x in made]).astype(float))]
            out.append(pa.table([*[pa.array([v.as_py()] * len(columns[0]), v.type) for v in key[:-1]], *columns], names=[*groups, "replicate", "threshold", "metric", "value"]))
        return pa.concat_tables(out)

    # Stated, since the work lies in the replicates and not in the bytes by which partitions would be put together.
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4 * blocks)
    made = rows.repartition(parts, *groups, "_block").groupBy(*groups, "_block").applyInArrow(run, f"{kinds}replicate int, threshold double, metric string, value double")
    return made.withColumn("value", F.when(~F.isnan("value") & (F.abs("value") < float("inf")), F.col("value")))


def _intervals(reps: DataFrame, keys: list[str], replicates: int, alpha: float, min_valid: float) -> DataFrame:
    drawn = F.when(F.col("replicate") > 0, F.col("value"))
    q = reps.groupBy(*keys, "metric").agg(
        F.max(F.when(F.col("replicate") == 0, F.col("value"))).alias("estimate"), F.percentile(drawn, F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2))).alias("q"), F.stddev_samp(drawn).alias("sd"), F.count(drawn).alias("n_valid")
    )
    enough = F.col("n_valid") >= min_valid * replicates
    return q.select(*keys, "metric", "estimate", F.when(enough, F.col("q")[0]).alias("lower"), F.when(enough, F.col("q")[1]).alias("upper"), "sd", "n_valid")


def _metrics(names: tuple[str, ...]):
    def compute(pieces: Pieces) -> list:
        return [(None, m, v) for m, v in _measures(pieces, names).items()]

    return compute


def bootstrap(df: DataFrame, groups: list[str], replicates: int = 200, seed: int = 7, patient: str = "patient_id", alpha: float = 0.05, min_valid: float = 0.8, metrics: tuple[str, ...] = CORE) -> DataFrame:
    """groups, metric, estimate, lower, upper, sd, n_valid: percentile intervals of ``metrics`` (names of ``PAIRED``).

    A metric with fewer than ``min_valid`` of its replicates defined has NULL limits.
    """
    return _intervals(_replicated(df, groups, replicates, seed, patient, _metrics(metrics)), groups, replicates, alpha, min_valid)


def contrasts(df: DataFrame, group: str, effects: dict[str, dict[str, float]], replicates: int = 200, seed: int = 7, alpha: float = 0.05, min_valid: float = 0.95, metrics: tuple[str, ...] = CORE) -> DataFrame:
    """effect, metric, estimate, lower, upper, sd, n_valid: weighted sums of the metrics of groups, paired within each replicate.

    ``effects`` gives each effect's weight of each group. A replicate in which one of an effect's groups has no value doesn't count.
    """
    rows = [(e, g, float(w), len(ws)) for e, ws in effects.items() for g, w in ws.items()]
    weights = df.sparkSession.createDataFrame(rows, "effect string, _g string, _w double, _n int")
    reps = _replicated(df, [group], replicates, seed, "patient_id", _metrics(metrics))
    joined = reps.join(F.broadcast(weights), F.col(group) == F.col("_g"))  # the stated effects
    summed = joined.groupBy("effect", "replicate", "metric").agg(F.sum(F.col("value") * F.col("_w")).alias("value"), F.count("value").alias("_c"), F.max("_n").alias("_n")).filter("_c = _n")
    return _intervals(summed, ["effect"], replicates, alpha, min_valid)


# Metrics of a threshold, as functions of the sums of true and false alerts, events, others and the threshold's odds.
THRESHOLD = {
    "alert_rate": lambda tp, fp, e, o, odds: (tp + fp) / (e + o),
    "alerts_per_1000": lambda tp, fp, e, o, odds: 1000 * (tp + fp) / (e + o),
    "true_alerts_per_1000": lambda tp, fp, e, o, odds: 1000 * tp / (e + o),
    "false_alerts_per_1000": lambda tp, fp, e, o, odds: 1000 * fp / (e + o),
    "sensitivity": lambda tp, fp, e, o, odds: tp / e,
    "specificity": lambda tp, fp, e, o, odds: 1 - fp / o,
    "ppv": lambda tp, fp, e, o, odds: tp / (tp + fp),
    "alerts_per_tp": lambda tp, fp, e, o, odds: (tp + fp) / tp,
    "false_alerts_per_tp": lambda tp, fp, e, o, odds: fp / tp,
    "net_benefit": lambda tp, fp, e, o, odds: (tp - fp * odds) / (e + o),
    "net_benefit_all": lambda tp, fp, e, o, odds: (e - o * odds) / (e + o),
    "avoided_per_100": lambda tp, fp, e, o, odds: 100 * ((tp - fp * odds) - (e - o * odds)) / (e + o) / odds,
}
UTILITY = ("net_benefit", "net_benefit_all", "avoided_per_100")


def _at_thresholds(thresholds: list[float], utility: list[float], names: tuple[str, ...]):
    def compute(pieces: Pieces) -> list:
        out, events, others = [], *(sum(piece[k].sum(0, dtype=float) for piece in pieces) for k in (1, 2))
        with np.errstate(all="ignore"):
            for t in thresholds:
                tp, fp = (sum(piece[k][np.searchsorted(piece[0], t) :].sum(0, dtype=float) for piece in pieces) for k in (1, 2))
                sums = tp, fp, events, others, t / (1 - t)
                out += [(t, m, THRESHOLD[m](*sums)) for m in names if m not in UTILITY or t in utility]
        return out

    return compute


def bootstrap_thresholds(df: DataFrame, thresholds: list[float], replicates: int = 200, seed: int = 7, alpha: float = 0.05, groups: list[str] = [], utility: list[float] | None = None, names: tuple[str, ...] = ("alert_rate", "sensitivity", "ppv", "net_benefit")) -> DataFrame:
    """groups, threshold, metric, estimate, lower, upper, sd, n_valid of the metrics ``names`` (of THRESHOLD); those of utility only at the thresholds ``utility``."""
    ts = sorted({float(t) for t in thresholds})
    compute = _at_thresholds(ts, ts if utility is None else [float(t) for t in utility], names)
    return _intervals(_replicated(df, groups, replicates, seed, "patient_id", compute), [*groups, "threshold"], replicates, alpha, 0.8)


def _spline(lp: np.ndarray, knots: np.ndarray) -> np.ndarray:
    cube = lambda v: np.maximum(v, 0.0) ** 3
    a, last, before = knots[:-2], knots[-1], knots[-2]
    bent = [(cube(lp - k) - cube(lp - before) * (last - k) / (last - before) + cube(lp - last) * (before - k) / (last - before)) / (last - knots[0]) ** 2 for k in a]
    return np.column_stack([np.ones_like(lp), lp, *bent])


def _curves(pieces: Pieces, knots: np.ndarray, grid: np.ndarray) -> np.ndarray:
    """Observed probability on a grid of scores by a restricted cubic spline of logit(p), one column per replicate; NaN without a fit."""
    xs, at = [_spline(_logit(p), knots) for p, _, _ in pieces], _spline(_logit(grid), knots)
    scale = np.max([np.abs(x).max(0) for x in xs], axis=0)
    scale[scale == 0] = 1.0
    xs, at = [x / scale for x in xs], at / scale
    k, live = at.shape[1], np.arange(pieces[0][1].shape[1])
    beta = np.zeros((len(live), k))
    beta[:, 1] = scale[1]
    with np.errstate(all="ignore"):
        for _ in range(40):
            g, h, total = np.zeros((len(live), k)), np.zeros((len(live), k * k)), np.zeros(len(live))
            for x, (_, pos, neg) in zip(xs, pieces, strict=True):
                y = pos[:, live].astype(float)
                v = y + neg[:, live]
                q = 1 / (1 + np.exp(-(x @ beta[live].T)))
                g += (v * q - y).T @ x
                h += (v * q * (1 - q)).T @ (x[:, :, None] * x[:, None, :]).reshape(len(x), k * k)
                total += v.sum(0)
            h = h.reshape(len(live), k, k)
            ok = np.isfinite(h).all((1, 2)) & (np.linalg.matrix_rank(np.nan_to_num(h)) == k)
            beta[live[~ok]] = np.nan
            live, g, h, total = live[ok], g[ok], h[ok], total[ok]
            if not len(live):
                break
            step = np.linalg.solve(h, g[:, :, None])[:, :, 0]
            beta[live] -= step * np.minimum(1, 8 / np.maximum(np.abs(step).max(1), 1e-300))[:, None]
            live = live[np.abs(g).max(1) / total >= 1e-9]
            if not len(live):
                break
        beta[live] = np.nan
        return 1 / (1 + np.exp(-(at @ beta.T)))


def paired_validation(
    df: DataFrame, model: str, primary: str, thresholds: list[float], utility: list[float], replicates: int = 2000, seed: int = 7, alpha: float = 0.05, min_valid: float = 0.95, curve: tuple[np.ndarray, np.ndarray] | None = None
) -> DataFrame:
    """model, versus, threshold, metric, estimate, lower, upper, sd, n_valid: all metrics of all models under the same draws.

    Rows with ``versus`` are the difference of ``primary`` from that model, paired within each replicate. ``curve`` (knots on the logit
    scale, grid of scores) adds the calibration curve of each model as metric ``curve`` with the score as its threshold. Estimates with
    fewer than ``min_valid`` of their replicates defined have NULL limits; a patient must have one row per model.
    """
    repeated = df.groupBy(model, "patient_id").agg(F.count("*").alias("n")).filter("n > 1")
    if not repeated.isEmpty():
        raise ValueError("a patient has more than one row")
    ts = sorted({float(t) for t in thresholds})
    at = _at_thresholds(ts, [float(t) for t in utility], ("alert_rate", "sensitivity", "ppv", "alerts_per_tp", "false_alerts_per_tp", "net_benefit"))

    def compute(pieces: Pieces) -> list:
        out = [(None, m, v) for m, v in _measures(pieces, PAIRED).items()] + at(pieces)
        if curve is not None:
            out += [(float(x), "curve", v) for x, v in zip(curve[1], _curves(pieces, curve[0], curve[1]), strict=True)]
        return out

    # Models by themselves and against each other are read off the same replicates, which are made once.
    reps = checkpointed(_replicated(df, [model], replicates, seed, "patient_id", compute)).withColumnRenamed(model, "model")
    own = reps.select("model", F.lit(None).cast("string").alias("versus"), "threshold", "metric", "replicate", "value")
    first = reps.filter((F.col("model") == primary) & (F.col("metric") != "curve")).select(F.col("threshold").alias("_t"), F.col("metric").alias("_m"), F.col("replicate").alias("_r"), F.col("value").alias("_v"))
    other = reps.filter(F.col("model") != primary)
    same = F.col("threshold").eqNullSafe(F.col("_t")) & (F.col("metric") == F.col("_m")) & (F.col("replicate") == F.col("_r"))
    deltas = other.join(first, same).select(F.lit(primary).alias("model"), F.col("model").cast("string").alias("versus"), "threshold", "metric", "replicate", (F.col("_v") - F.col("value")).alias("value"))
    return _intervals(own.unionByName(deltas), ["model", "versus", "threshold"], replicates, alpha, min_valid)


def derived(reps: DataFrame) -> DataFrame:
    """From stored replicates (replicate, threshold, metric, value) with alert_rate, sensitivity and net_benefit, what follows from them without
    the rows: prevalence, true and false alerts per 1,000, specificity, avoided per 100, as mean, lower, upper, n_valid.

    Sensitivity and net benefit at one threshold give the prevalence: net benefit = tp - (alert rate - tp) odds, tp = sensitivity
    times prevalence. A replicate that leaves one of them undefined doesn't count.
    """
    wide = reps.filter("threshold is not null").groupBy("replicate", "threshold").agg(*[F.max(F.when(F.col("metric") == m, F.col("value"))).alias(m) for m in ("alert_rate", "sensitivity", "net_benefit")])
    odds = F.col("threshold") / (1 - F.col("threshold"))
    tp = (F.col("net_benefit") + F.col("alert_rate") * odds) / (1 + odds)
    prevalence = F.try_divide(tp, F.col("sensitivity"))
    fp = F.col("alert_rate") - tp
    values = {"prevalence": prevalence, "true_alerts_per_1000": 1000 * tp, "false_alerts_per_1000": 1000 * fp, "specificity": 1 - F.try_divide(fp, 1 - prevalence), "avoided_per_100": 100 * (F.col("net_benefit") - (prevalence - (1 - prevalence) * odds)) / odds}
    long = wide.filter("replicate > 0").select("replicate", "threshold", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), v.alias("value")) for m, v in values.items()])).alias("r")).select("replicate", "threshold", "r.*")
    q = F.percentile("value", F.array(F.lit(0.025), F.lit(0.975)))  # of the replicates
    return long.groupBy("threshold", "metric").agg(F.avg("value").alias("estimate"), q.alias("q"), F.count("value").alias("n_valid")).select("threshold", "metric", "estimate", F.col("q")[0].alias("lower"), F.col("q")[1].alias("upper"), "n_valid")


def threshold_replicates(df: DataFrame, thresholds: list[float], replicates: int, seed: int = 7) -> DataFrame:
    """replicate, threshold, metric, value of alert_rate, sensitivity and net_benefit: what :func:`derived` takes."""
    ts = sorted({float(t) for t in thresholds})
    return _replicated(df, [], replicates, seed, "patient_id", _at_thresholds(ts, ts, ("alert_rate", "sensitivity", "net_benefit")))


def bootstrap_callable(df: DataFrame, metric, columns: list[str], replicates: int = 200, seed: int = 7, most_rows: int = 1_000_000, blocks: int = 16) -> DataFrame:
    """replicate, value of any scalar function of a pandas frame with a weight column ``w``.

    For metrics that aggregates can't express. Each task holds the whole frame, so it must be small (``most_rows`` is
    checked); replicates are spread over tasks.
    """
    held = df.select(*columns, "patient_id").limit(most_rows + 1).toPandas()
    if len(held) > most_rows:
        raise ValueError(f"more than {most_rows} rows; use bootstrap() or a sample")
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(held)  # at most most_rows

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        data = shared.value
        codes, names = pd.factorize(data["patient_id"])
        for f in frames:
            out = []
            for r in f["id"]:
                draw = np.random.default_rng([seed, int(r)]).integers(0, max(len(names), 1), len(names))
                w = np.bincount(draw, minlength=len(names))[codes] if len(names) else np.empty(0)
                try:
                    out.append(float(metric(data.assign(w=w))))
                except (ValueError, ZeroDivisionError, FloatingPointError):
                    out.append(float("nan"))
            yield pd.DataFrame({"replicate": f["id"] + 1, "value": out})

    return spark.range(0, replicates, 1, min(blocks, max(replicates, 1))).mapInPandas(run, "replicate bigint, value double")
