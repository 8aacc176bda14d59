"""Ridge logistic regression on Spark sums, grouped cross-validation, and calibration by Newton steps.

Each iteration is one aggregate whose result has the size of the model, so the data stay where they lie; only sums reach the
driver. Partial sums are made in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.operators.metrics import quantiles


@dataclass(frozen=True)
class Fit:
    features: tuple[str, ...]
    intercept: float
    coefficients: np.ndarray
    covariance: np.ndarray
    converged: bool
    steps: int
    loss: float


def _sums(df: DataFrame, features: list[str], beta: np.ndarray, mean: np.ndarray, scale: np.ndarray, offset: bool, trials: list[np.ndarray]) -> dict[str, np.ndarray]:
    """Weight, loss at the trial points, gradient and Hessian at ``beta``, all as sums over rows."""
    k = len(features) + 1

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(1 + len(trials) + k + k * k)
        for f in frames:
            x = np.column_stack([np.ones(len(f)), (f[features].to_numpy(float) - mean) / scale]) if features else np.ones((len(f), 1))
            y, w, o = f["y"].to_numpy(float), f["w"].to_numpy(float), f["o"].to_numpy(float) if offset else 0.0
            z = x @ beta + o
            p = np.where(z >= 0, 1 / (1 + np.exp(-np.abs(z))), np.exp(-np.abs(z)) / (1 + np.exp(-np.abs(z))))
            total[0] += w.sum()
            for j, b in enumerate(trials):
                u = x @ b + o
                total[1 + j] += np.sum(w * (np.logaddexp(0, u) - y * u))
            at = 1 + len(trials)
            total[at : at + k] += x.T @ (w * (p - y))
            total[at + k :] += ((x * (w * p * (1 - p))[:, None]).T @ x).ravel()
        yield pd.DataFrame({"i": np.arange(len(total)), "v": total})

    rows = df.mapInPandas(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    flat = np.zeros(1 + len(trials) + k + k * k)
    for r in rows:
        flat[r["i"]] = r["v"]
    at = 1 + len(trials)
    return {"weight": flat[0], "losses": flat[1:at], "gradient": flat[at : at + k], "hessian": flat[at + k :].reshape(k, k)}


def ridge_logistic(df: DataFrame, features: list[str], l2: float = 0.0, *, y: str = "y", weight: str | None = None, offset: str | None = None, standardize: bool = True, max_steps: int = 50, tol: float = 1e-10) -> Fit:
    """Minimises the weighted mean log loss plus 0.5 l2 times the squares of the standardised coefficients; the intercept is free.

    Features are standardised by their weighted mean and population deviation (a constant one keeps the scale 1). Damped Newton
    with halved steps; a singular Hessian is solved by its pseudo-inverse. Rows with a NULL are left out. Raises ValueError without
    rows or weight.
    """
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    rows = df.select(*[F.col(f).cast("double").alias(f) for f in features], F.col(y).cast("double").alias("y"), w.alias("w"), *([F.col(offset).cast("double").alias("o")] if offset else [])).dropna()
    stats = rows.agg(F.sum("w").alias("sw"), *[F.sum(F.col("w") * F.col(f)).alias(f"a_{k}") for k, f in enumerate(features)]).first()
    if not stats["sw"] or stats["sw"] <= 0:
        raise ValueError("no rows of positive weight")
    k = len(features) + 1
    mean, scale = np.zeros(k - 1), np.ones(k - 1)
    if standardize and features:
        mean = np.array([stats[f"a_{j}"] / stats["sw"] for j in range(k - 1)])
        var = rows.agg(*[F.sum(F.col("w") * (F.col(f) - float(mean[j])) ** 2).alias(f"b_{j}") for j, f in enumerate(features)]).first()
        scale = np.sqrt(np.array([var[f"b_{j}"] / stats["sw"] for j in range(k - 1)]))
        scale = np.where(scale > 1e-12, scale, 1.0)
    penalty = np.full(k, l2)
    penalty[0] = 0.0
    beta, converged, step_no, loss = np.zeros(k), False, 0, np.inf
    sums = _sums(rows, features, beta, mean, scale, bool(offset), [beta])
    loss = sums["losses"][0] / sums["weight"]
    for step_no in range(1, max_steps + 1):
        g = sums["gradient"] / sums["weight"] + penalty * beta
        h = sums["hessian"] / sums["weight"] + np.diag(penalty)
        if np.max(np.abs(g)) < tol:
            converged = True
            break
        try:
            direction = np.linalg.solve(h, g)
        except np.linalg.LinAlgError:
            direction = np.linalg.pinv(h) @ g
        sizes = [1.0, 0.5, 0.25, 0.0625, 1 / 256, 1 / 65536]
        trials = [beta - s * direction for s in sizes]
        # One pass judges all step sizes; it also gives gradient and Hessian where the full step leads.
        ahead = _sums(rows, features, trials[0], mean, scale, bool(offset), trials)
        losses = ahead["losses"] / ahead["weight"] + 0.5 * np.array([np.sum(penalty * t * t) for t in trials])
        ok = [j for j in range(len(sizes)) if losses[j] <= loss - 1e-4 * sizes[j] * float(g @ direction) + 1e-15]
        if not ok:
            converged = bool(np.max(np.abs(g)) < 1e-6)
            break
        beta, now = trials[ok[0]], losses[ok[0]]
        sums = ahead if ok[0] == 0 else _sums(rows, features, beta, mean, scale, bool(offset), [beta])
        loss = now
    information = sums["hessian"] + np.diag(penalty) * sums["weight"]
    back = np.zeros((k, k))
    back[0, 0] = 1.0
    back[0, 1:] = -mean / scale
    back[1:, 1:] = np.diag(1 / scale)
    raw = back @ beta
    return Fit(tuple(features), float(raw[0]), raw[1:], back @ np.linalg.pinv(information) @ back.T, converged, step_no, float(loss))


def calibration_slope(df: DataFrame, weight: str | None = None) -> tuple[Fit, DataFrame]:
    """Unpenalised logistic fit of y on logit(p): intercept and slope."""
    from pulsegrid.functions.parse import logit

    rows = df.select("y", logit(F.col("p")).alias("lp"), *([weight] if weight else []))
    return ridge_logistic(rows, ["lp"], 0.0, weight=weight), rows


def calibration_in_the_large(df: DataFrame, weight: str | None = None) -> Fit:
    """The intercept that makes the mean score right, with logit(p) as an offset."""
    from pulsegrid.functions.parse import logit

    return ridge_logistic(df.select("y", logit(F.col("p")).alias("lp"), *([weight] if weight else [])), [], 0.0, weight=weight, offset="lp")


MOST_SIZES = 1_000_000


def deal(histogram: list[tuple[int, int]], folds: int) -> dict[int, list[int]]:
    """How many groups of each size go to each fold, if the largest come first and each goes to the fold with the fewest rows, then the
    fewest groups. Groups of one size are alike, so they are dealt by arithmetic: level the folds, then in turn."""
    rows, groups, out = [0] * folds, [0] * folds, {}
    for size, left in sorted(histogram, reverse=True):
        counts = [0] * folds

        def give(f: int, k: int) -> None:
            counts[f] += k
            rows[f] += k * size
            groups[f] += k

        level = [(max(rows) - r) // size for r in rows]
        if sum(level) <= left:
            for f, k in enumerate(level):
                give(f, k)
            left -= sum(level)
            for f in range(folds):
                give(f, left // folds)
            left %= folds
        for _ in range(left):
            give(min(range(folds), key=lambda f: (rows[f], groups[f], f)), 1)
        out[size] = counts
    return out


def grouped_folds(df: DataFrame, group: str, folds: int = 5) -> DataFrame:
    """group, fold: whole groups dealt to folds, the largest first, each to the fold with the fewest rows, then the fewest groups.

    The histogram of sizes decides how many groups of each size a fold gets (:func:`deal`; at most MOST_SIZES different sizes, checked); which
    ones they are follows from a hash of the group. Ranks within a size are taken in 64 parts of known counts, so no task ranks
    all groups. NULL groups are left out.
    """
    from pyspark.sql import Window

    sizes = df.filter(F.col(group).isNotNull()).groupBy(group).agg(F.count("*").alias("_n")).withColumn("_h", F.xxhash64(group)).withColumn("_part", F.pmod("_h", F.lit(64)))
    parts = sizes.groupBy("_n", "_part").agg(F.count("*").alias("_c"))
    histogram = [(r["_n"], r["m"]) for r in parts.groupBy("_n").agg(F.sum("_c").alias("m")).limit(MOST_SIZES + 1).collect()]
    if len(histogram) > MOST_SIZES:
        raise ValueError(f"more than {MOST_SIZES} different group sizes")
    rows = []
    for size, counts in deal(histogram, folds).items():
        at = 0
        for fold, k in enumerate(counts):
            rows.append((size, fold, at, at + k))
            at += k
    shares = df.sparkSession.createDataFrame(rows, "_s bigint, fold int, _from bigint, _to bigint")
    before = parts.select(F.col("_n").alias("_bn"), F.col("_part").alias("_bp"), (F.sum("_c").over(Window.partitionBy("_n").orderBy("_part")) - F.col("_c")).alias("_before"))
    ranked = sizes.withColumn("_r", F.row_number().over(Window.partitionBy("_n", "_part").orderBy("_h", group)) - 1)
    ranked = ranked.join(before, (F.col("_n") == F.col("_bn")) & (F.col("_part") == F.col("_bp"))).withColumn("_r", F.col("_r") + F.col("_before"))
    return ranked.join(F.broadcast(shares), (F.col("_n") == F.col("_s")) & (F.col("_r") >= F.col("_from")) & (F.col("_r") < F.col("_to"))).select(group, "fold")  # sizes times folds


def _fold_sums(df: DataFrame, features: list[str], folds: int, fits: list[tuple[int, np.ndarray]], mean: np.ndarray, scale: np.ndarray) -> list[tuple[float, np.ndarray, np.ndarray, float, np.ndarray]]:
    """Per (fold, beta): loss, gradient and Hessian over the rows outside the fold, and weight, log loss and squared error inside it; one pass for all."""
    k = len(features) + 1
    size = 4 + k + k * k

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((len(fits), size))
        for f in frames:
            raw, y, at = f[features].to_numpy(float), f["y"].to_numpy(float), f["fold"].to_numpy()
            for j, (fold, beta) in enumerate(fits):
                x = np.column_stack([np.ones(len(f)), (raw - mean[fold]) / scale[fold]])
                held = at == fold
                z = x @ beta
                losses = np.logaddexp(0, z) - y * z
                p = np.exp(-np.logaddexp(0, -z))
                t, e, h = x[~held], (p - y)[~held], (p * (1 - p))[~held]
                total[j, :4] += losses[~held].sum(), held.sum(), losses[held].sum(), ((p - y)[held] ** 2).sum()
                total[j, 4 : 4 + k] += t.T @ e
                total[j, 4 + k :] += ((t * h[:, None]).T @ t).ravel()
        yield pd.DataFrame({"i": np.arange(total.size), "v": total.ravel()})

    flat = np.zeros(len(fits) * size)
    for r in df.mapInPandas(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
        flat[r["i"]] = r["v"]
    return [(t[0], t[4 : 4 + k], t[4 + k :].reshape(k, k), t[1], t[2:4]) for t in flat.reshape(len(fits), size)]


def ridge_cv(df: DataFrame, features: list[str], grid: list[float], *, group: str = "patient_id", folds: int = 5, max_steps: int = 100, tol: float = 1e-10, scoring: str = "log_loss") -> tuple[list[dict], float]:
    """Mean and deviation of log loss and Brier score of each penalty over grouped folds, and the best penalty by ``scoring`` (the smallest within 1e-12).

    The fits of all folds and penalties advance together, one pass over the rows for a step of each, as
    :func:`ridge_logistic` does for one: damped Newton on features standardised by the fold's training rows.
    """
    data = df.join(grouped_folds(df, group, folds), group).select(*[F.col(f).cast("double").alias(f) for f in features], F.col("y").cast("double").alias("y"), "fold").dropna().persist()
    k = len(features) + 1
    try:
        counts = {r["fold"]: r for r in data.groupBy("fold").agg(F.count("*").alias("n"), *[F.sum(f).alias(f"a_{j}") for j, f in enumerate(features)]).collect()}
        out_of = lambda values, fold: sum((v for g, v in values.items() if g != fold), np.zeros(k - 1))
        n = {f: sum(r["n"] for g, r in counts.items() if g != f) for f in range(folds)}
        if not all(n.values()):
            raise ValueError("a fold leaves no rows to train on")
        sums = {g: np.array([r[f"a_{j}"] for j in range(k - 1)], float) for g, r in counts.items()}
        mean = np.array([out_of(sums, f) / n[f] for f in range(folds)])
        centre = sum(sums.values(), np.zeros(k - 1)) / sum(r["n"] for r in counts.values())
        squares = {r["fold"]: np.array([r[f"b_{j}"] for j in range(k - 1)], float) for r in data.groupBy("fold").agg(*[F.sum((F.col(f) - float(centre[j])) ** 2).alias(f"b_{j}") for j, f in enumerate(features)]).collect()}
        scale = np.sqrt(np.maximum(np.array([out_of(squares, f) / n[f] for f in range(folds)]) - (mean - centre) ** 2, 0))
        scale = np.where(scale > 1e-9 * np.maximum(1, np.abs(mean)), scale, 1.0)
        fits = [(fold, float(l2)) for l2 in grid for fold in range(folds)]
        penalty = [np.append(0.0, np.full(k - 1, l2)) for _, l2 in fits]
        beta = [np.zeros(k) for _ in fits]
        score, step, size = [np.inf] * len(fits), [np.zeros(k) for _ in fits], [1.0] * len(fits)
        held, open_ = [(0.0, np.zeros(2))] * len(fits), list(range(len(fits)))
        for _ in range(max_steps):
            if not open_:
                break
            # Every open fit is judged where its step leads: it goes on from there, or comes back by half.
            trial = {j: beta[j] - size[j] * step[j] for j in open_}
            left = []
            for j, (loss, g, h, weight, inside) in zip(open_, _fold_sums(data, features, folds, [(fits[j][0], trial[j]) for j in open_], mean, scale)):
                m = n[fits[j][0]]
                now = loss / m + 0.5 * float(np.sum(penalty[j] * trial[j] ** 2))
                if now > score[j] + 1e-13 and size[j] > 1e-6:
                    size[j] /= 2
                    left.append(j)
                    continue
                beta[j], score[j], size[j], held[j] = trial[j], now, 1.0, (weight, inside)
                g = g / m + penalty[j] * beta[j]
                if np.max(np.abs(g)) >= tol:
                    h = h / m + np.diag(penalty[j])
                    step[j] = np.linalg.lstsq(h, g, rcond=1e-13)[0]
                    left.append(j)
            open_ = left
    finally:
        data.unpersist()
    out = []
    for l2 in grid:
        row = {"l2": float(l2)}
        for j, name in enumerate(("log_loss", "brier")):
            values = [inside[j] / weight for (_, q), (weight, inside) in zip(fits, held) if q == float(l2) and weight]
            row |= {f"mean_{name}": float(np.mean(values)), f"sd_{name}": float(np.std(values, ddof=1)) if len(values) > 1 else None}
        out.append(row)
    least = min(r[f"mean_{scoring}"] for r in out)
    return out, min(r["l2"] for r in out if np.isclose(r[f"mean_{scoring}"], least, rtol=1e-12))


def spline_columns(x, knots: list[float]):
    """The columns of a restricted cubic spline on four knots: linear outside them."""
    last, before = knots[-1], knots[-2]
    cube = lambda v: F.pow(F.greatest(v, F.lit(0.0)), 3)
    out = [x]
    for k in knots[:-2]:
        out.append((cube(x - k) - cube(x - before) * ((last - k) / (last - before)) + cube(x - last) * ((before - k) / (last - before))) / (last - knots[0]) ** 2)
    return out


def calibration_curve(df: DataFrame, points: int = 101) -> list[tuple[float, float]]:
    """(predicted, observed) on a grid between the 1st and 99th percentile, by a restricted cubic spline of logit(p)."""
    from pulsegrid.functions.parse import logit

    rows = df.filter(F.col("p").isNotNull()).select("y", logit(F.col("p")).alias("lp"))
    q = quantiles(rows, [], "lp", [0.05, 0.35, 0.65, 0.95, 0.01, 0.99]).first()
    if q is None:
        return []
    q = q["q"]
    knots = [float(k) + 1e-8 * j for j, k in enumerate(q[:4])]
    names = ["s0", "s1", "s2"]
    fit = ridge_logistic(rows.select("y", *[c.alias(n) for c, n in zip(spline_columns(F.col("lp"), knots), names)]), names, 0.0)
    x = np.linspace(q[4], q[5], points)
    cube = lambda v: np.maximum(v, 0) ** 3
    basis = [x] + [(cube(x - k) - cube(x - knots[2]) * ((knots[3] - k) / (knots[3] - knots[2])) + cube(x - knots[3]) * ((knots[2] - k) / (knots[3] - knots[2]))) / (knots[3] - knots[0]) ** 2 for k in knots[:2]]
    z = fit.intercept + sum(b * v for b, v in zip(fit.coefficients, basis))
    return [(float(1 / (1 + np.exp(-a))), float(1 / (1 + np.exp(-b)))) for a, b in zip(x, z)]
