"""Comparisons of cohorts, labels, models and processes on top of scored cases."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.operators.metrics import quantiles, running


def long_features(df: DataFrame, features: tuple[str, ...]) -> DataFrame:
    """feature, value: one row per row and feature."""
    return df.select(F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features])).alias("r")).select("r.feature", "r.value")


def drift(a: DataFrame, b: DataFrame, features: tuple[str, ...]) -> DataFrame:
    """Per feature: means and deviations of both cohorts, their standardised difference, missing shares, share of b outside a's p01 to p99."""

    def summary(df: DataFrame, side: str) -> DataFrame:
        return long_features(df, features).groupBy("feature").agg(F.avg("value").alias(f"mean_{side}"), F.stddev_samp("value").alias(f"sd_{side}"), F.try_divide(100.0 * F.count_if(F.col("value").isNull()), F.count("*")).alias(f"missing_pct_{side}"))

    left, right = summary(a, "a"), summary(b, "b")
    q = quantiles(long_features(a, features), ["feature"], "value", [0.01, 0.99]).select("feature", "q")
    out = long_features(b, features).join(F.broadcast(q), "feature")  # one row per feature
    outside = out.filter(F.col("value").isNotNull()).groupBy("feature").agg(F.try_divide(100.0 * F.count_if((F.col("value") < F.col("q")[0]) | (F.col("value") > F.col("q")[1])), F.count("*")).alias("outside_pct"))
    pooled = F.sqrt((F.col("sd_a") * F.col("sd_a") + F.col("sd_b") * F.col("sd_b")) / 2)
    return left.join(right, "feature").join(outside, "feature", "left").select("feature", "mean_a", "sd_a", "mean_b", "sd_b", F.try_divide(F.col("mean_b") - F.col("mean_a"), F.when(pooled > 0, pooled)).alias("smd"), "missing_pct_a", "missing_pct_b", "outside_pct")


def subgroups(df: DataFrame, masks: dict[str, Column], least: int = 100, least_class: int = 20) -> DataFrame:
    """group, n, events, estimable: counts of overlapping subgroups and whether metrics can be estimated in them."""
    each = F.explode(F.array_compact(F.array(*[F.when(m, F.lit(g)) for g, m in masks.items()]))).alias("subgroup")
    agg = df.select(each, "y").groupBy("subgroup").agg(F.count("*").alias("n"), F.sum("y").cast("bigint").alias("events"))
    ok = (F.col("n") >= least) & (F.col("events") >= least_class) & (F.col("n") - F.col("events") >= least_class)
    return agg.withColumn("estimable", ok.cast("int"))


def agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """The 2x2 table of two binary labels (rows with a NULL are left out), agreements and Cohen's kappa; one aggregate."""
    rows = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    t = rows.agg(*[F.count_if((F.col(a) == i) & (F.col(b) == j)).alias(f"n{i}{j}") for i in (0, 1) for j in (0, 1)], F.count("*").alias("n"))
    n, po = F.col("n"), F.try_divide(F.col("n00") + F.col("n11"), F.col("n"))
    pe = F.try_divide((F.col("n10") + F.col("n11")) * (F.col("n01") + F.col("n11")) + (F.col("n00") + F.col("n01")) * (F.col("n00") + F.col("n10")), n * n)
    return t.select(
        "n", "n00", "n01", "n10", "n11", F.try_divide(2 * F.col("n11"), 2 * F.col("n11") + F.col("n01") + F.col("n10")).alias("positive_agreement"), F.try_divide(2 * F.col("n00"), 2 * F.col("n00") + F.col("n01") + F.col("n10")).alias("negative_agreement"),
        po.alias("overall_agreement"), F.try_divide(po - pe, 1 - pe).alias("kappa"),
    )


def average_rank(df: DataFrame, column: str, out: str) -> DataFrame:
    """``df`` with the average rank of a column, from running counts of its distinct values so that no task sees them all."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count("*").cast("double").alias("c"))
    ranks = running(counts, [], ["c"], by="v").select(F.col("v").alias("_v"), (F.col("c_run") - (F.col("c") - 1) / 2).alias(out))
    return df.join(ranks, F.col(column) == F.col("_v"), "left").drop("_v")


def prediction_shift(df: DataFrame, a: str, b: str) -> DataFrame:
    """Mean and mean absolute difference, Pearson and Spearman correlation of two scores of the same rows."""
    rows = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    ranked = average_rank(average_rank(rows, a, "_ra"), b, "_rb")
    return ranked.agg(F.count("*").alias("n"), F.avg(F.col(b) - F.col(a)).alias("mean_difference"), F.avg(F.abs(F.col(b) - F.col(a))).alias("mean_abs_difference"), F.corr(a, b).alias("pearson"), F.corr("_ra", "_rb").alias("spearman"))


def reclassification(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: how many rows both labels, only one, or neither call positive."""
    x, y = F.col(a) == 1, F.col(b) == 1
    return df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).agg(F.count("*").alias("n"), F.count_if(x & y).alias("both"), F.count_if(x & ~y).alias("only_first"), F.count_if(~x & y).alias("only_second"), F.count_if(~x & ~y).alias("neither"))


def overlap(a: DataFrame, b: DataFrame, entity: str, row: str) -> DataFrame:
    """One row: entities in both selections, with the same row, with another, and in one only."""
    left, right = a.select(F.col(entity).alias("_e"), F.col(row).alias("_a")), b.select(F.col(entity).alias("_f"), F.col(row).alias("_b"))
    j = left.join(right, F.col("_e") == F.col("_f"), "full_outer")
    both = F.col("_e").isNotNull() & F.col("_f").isNotNull()
    return j.agg(F.count_if(both).alias("shared"), F.count_if(both & (F.col("_a") == F.col("_b"))).alias("same_row"), F.count_if(both & (F.col("_a") != F.col("_b"))).alias("replaced"), F.count_if(F.col("_f").isNull()).alias("only_first"), F.count_if(F.col("_e").isNull()).alias("only_second"))


# Name patterns of drugs that raise blood pressure, and of routes that don't.
VASOPRESSOR = r"(?i)phenylephrine|neo[- ]?synephrine|ephedrine|norepinephrine|levophed|\bepinephrine\b|adrenaline|vasopressin|\bdopamine\b|\bdobutamine\b"
EXCLUDED = r"(?i)lidocaine|bupivacaine|ropivacaine|tumescent|nasal|topical|infiltration|subcutaneous|ophthalmic|nebul|local"
AGENTS = (("phenylephrine", r"(?i)phenylephrine|neo[- ]?synephrine"), ("ephedrine", r"(?i)ephedrine"), ("norepinephrine", r"(?i)norepinephrine|levophed"), ("epinephrine", r"(?i)\bepinephrine\b|adrenaline"), ("vasopressin", r"(?i)vasopressin"), ("dopamine", r"(?i)\bdopamine\b"), ("dobutamine", r"(?i)\bdobutamine\b"))


def agent(text: Column) -> Column:
    """The first agent in a fixed order whose pattern a drug text meets, unless it is excluded; else NULL."""
    out = F.lit(None).cast("string")
    for name, pattern in reversed(AGENTS):
        out = F.when(text.rlike(pattern), name).otherwise(out)
    return F.when(text.rlike(VASOPRESSOR) & ~text.rlike(EXCLUDED), out)


def events_near(events: DataFrame, t0: DataFrame, after: float = 5.0) -> DataFrame:
    """events (case_id, minute, ...) of cases with an index event, from it to ``after`` minutes later, with ``since_t0``."""
    j = events.join(t0.select("case_id", "t0"), "case_id").withColumn("since_t0", F.col("minute") - F.col("t0"))
    return j.filter(F.col("since_t0").between(0, after))


def weighted_balance(df: DataFrame, features: tuple[str, ...], selected: str, weight: str) -> DataFrame:
    """Per feature: standardised difference between selected rows and all, without and with weights on the selected."""
    rows = df.select(selected, weight, F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("v")) for f in features])).alias("r")).select(selected, weight, "r.feature", "r.v").filter("v is not null")
    s, w, v = F.col(selected) == 1, F.when(F.col(selected) == 1, F.col(weight)), F.col("v")
    a = rows.groupBy("feature").agg(F.avg(v).alias("all_mean"), F.stddev_samp(v).alias("all_sd"), F.avg(F.when(s, v)).alias("sel_mean"), F.try_divide(F.sum(w * v), F.sum(w)).alias("weighted_mean"))
    return a.select("feature", F.try_divide(F.col("sel_mean") - F.col("all_mean"), F.when(F.col("all_sd") > 0, F.col("all_sd"))).alias("smd_unweighted"), F.try_divide(F.col("weighted_mean") - F.col("all_mean"), F.when(F.col("all_sd") > 0, F.col("all_sd"))).alias("smd_weighted"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
