"""Tables for a report, made from case rows and interval tables: case mix, performance, thresholds, flow, figure data."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.functions.parse import estimate_text


@dataclass(frozen=True)
class Row:
    """A line of the case-mix table: a continuous measure, or the share of rows for which ``value`` is 1."""

    section: str
    characteristic: str
    level: str
    value: str  # a SQL expression
    binary: bool = False
    digits: int = 1
    unavailable_in: str = ""  # the cohort in which the field only holds a placeholder


def case_mix(df: DataFrame, cohort: str, left: str, right: str, rows: list[Row]) -> DataFrame:
    """order_no, section, characteristic, level, statistic, then n, value and missing share of both cohorts, and the absolute standardised difference.

    Means (SD) of measures, n (%) of shares, both over rows that have a value. The difference is that of means over the pooled
    deviation, or of proportions; ``not estimable`` without variance or values. A field that one cohort only holds as a placeholder
    is shown as unavailable there. All lines come from one aggregate by cohort.
    """
    value = lambda r: F.expr(r.value).cast("double")
    there = lambda r: F.when(F.col(cohort) == r.unavailable_in, None).otherwise(value(r)) if r.unavailable_in else value(r)
    agg = [a for k, r in enumerate(rows) for a in (F.count(there(r)).alias(f"n{k}"), F.avg(there(r)).alias(f"m{k}"), F.stddev_samp(there(r)).alias(f"s{k}"), F.sum(there(r)).alias(f"t{k}"))]
    by = df.filter(F.col(cohort).isin(left, right)).groupBy(F.col(cohort).alias("c")).agg(F.count("*").alias("all"), *agg)
    each = F.array(*[F.struct(F.lit(k + 1).alias("k"), *[F.lit(x).alias(n) for n, x in (("section", r.section), ("characteristic", r.characteristic), ("level", r.level))], F.lit(r.binary).alias("binary"), F.lit(r.digits).alias("digits"), F.lit(r.unavailable_in).alias("un"),
        F.col(f"n{k}").alias("n"), F.col(f"m{k}").alias("m"), F.col(f"s{k}").alias("s"), F.col(f"t{k}").cast("bigint").alias("t")) for k, r in enumerate(rows)])
    long = by.select("c", "all", F.explode(each).alias("r")).select("c", "all", "r.*")
    keys = ["k", "section", "characteristic", "level", "binary", "digits"]
    pick = lambda side, x: F.max(F.when(F.col("c") == side, F.col(x)))
    wide = long.groupBy(*keys).agg(F.max("un").alias("un"), *[pick(side, x).alias(f"{x}_{p}") for p, side in (("a", left), ("b", right)) for x in ("all", "n", "m", "s", "t")])
    fixed = lambda x: F.when(F.col("digits") == 2, F.format_string("%.2f", F.round(x, 2))).otherwise(F.format_string("%.1f", F.round(x, 1)))

    def shown(p: str, side: str) -> Column:
        n, m, s, t = (F.col(f"{x}_{p}") for x in ("n", "m", "s", "t"))
        share = F.concat(F.format_number(t, 0), F.lit(" ("), F.format_string("%.1f", F.round(100 * m, 1)), F.lit("%)"))
        text = F.when(F.col("binary"), share).otherwise(F.concat(fixed(m), F.lit(" ("), F.when(s.isNotNull(), fixed(s)).otherwise("not estimable"), F.lit(")")))
        return F.when(F.col("un") == side, "not available").when(F.coalesce(n, F.lit(0)) == 0, "not estimable").otherwise(text)

    ma, mb = F.col("m_a"), F.col("m_b")
    variance = F.when(F.col("binary"), (ma * (1 - ma) + mb * (1 - mb)) / 2).otherwise((F.col("s_a") * F.col("s_a") + F.col("s_b") * F.col("s_b")) / 2)
    smd = F.when(variance > 0, F.abs(ma - mb) / F.sqrt(variance)).when(F.col("binary") & (ma == mb), 0.0)
    missing = lambda p: F.round(100 * (1 - F.coalesce(F.col(f"n_{p}"), F.lit(0)) / F.col(f"all_{p}")), 1)
    return wide.select(
        F.col("k").alias("order_no"), "section", "characteristic", "level", F.when(F.col("binary"), "n (%)").otherwise("Mean (SD)").alias("statistic"), F.coalesce("n_a", F.lit(0)).alias("left_n"), shown("a", left).alias("left_value"), missing("a").alias("left_missing_pct"),
        F.coalesce("n_b", F.lit(0)).alias("right_n"), shown("b", right).alias("right_value"), missing("b").alias("right_missing_pct"), F.when(smd.isNotNull(), F.format_string("%.3f", F.round(smd, 3))).otherwise("not estimable").alias("absolute_smd"),
    )


def performance_table(point: DataFrame, intervals: DataFrame, model: str, primary: str, tolerance: float = 1e-9) -> DataFrame:
    """metric and one column of ``estimate (interval)`` per model, with the paired difference of ``primary`` from each other model.

    ``point`` (model, metric, value) are the estimates of all rows; ``intervals`` (model, versus, metric, estimate, lower, upper) the bootstrap's, with
    ``versus`` NULL for a model by itself. A bootstrap estimate further than ``tolerance`` from the point estimate raises.
    """
    own = intervals.filter("versus is null")
    off = own.join(point.withColumnRenamed("value", "_point"), ["model", "metric"]).filter(F.abs(F.col("estimate") - F.col("_point")) > tolerance).select("model", "metric").limit(5).collect()
    if off:
        raise ValueError("point and bootstrap estimates differ: " + ", ".join(f"{r['model']} {r['metric']}" for r in off))
    text = estimate_text(F.col("estimate"), F.col("lower"), F.col("upper"))
    label = F.when(F.col("versus").isNull(), F.col("model")).otherwise(F.concat(F.lit(f"{primary} - "), F.col("versus")))
    return intervals.select("metric", label.alias("column"), text.alias("shown"))


def threshold_table(stage2: DataFrame, two_stage: DataFrame, clinical: list[float]) -> DataFrame:
    """strategy, threshold, metric, estimate, lower, upper of both strategies; net benefit only at the clinical thresholds."""
    rows = [df.select(F.lit(name).alias("strategy"), "threshold", "metric", "estimate", "lower", "upper") for name, df in (("stage2", stage2), ("two_stage", two_stage))]
    useful = ~F.col("metric").isin("net_benefit", "net_benefit_all", "avoided_per_100") | F.col("threshold").isin(*[float(x) for x in clinical])
    return rows[0].unionByName(rows[1]).filter(useful)


def wide_by_threshold(rows: DataFrame, names: list[str]) -> DataFrame:
    """threshold, then estimate, lower and upper of each metric as columns."""
    return rows.groupBy("threshold").agg(*[F.max(F.when(F.col("metric") == m, F.col(c))).alias(m if c == "estimate" else f"{m}_{c}") for m in names for c in ("estimate", "lower", "upper")])


def flow_figure(flow: DataFrame, screening: list[str]) -> DataFrame:
    """``flow`` (step_no, step, n) with ``excluded_from_previous`` along the screening steps (NULL at the first and on the branches) and ``branch``."""
    inside = F.col("step").isin(*screening)
    before = F.lag(F.when(inside, F.col("n")), 1).over(Window.partitionBy(inside).orderBy("step_no"))  # the few steps
    return flow.withColumn("_b", before).select("step_no", "step", "n", F.when(inside, F.col("_b") - F.col("n")).alias("excluded_from_previous"), F.when(inside, "screening").otherwise("branch").alias("branch"))


def labelled(rows: DataFrame, column: str, labels: dict[str, str], out: str = "display_label") -> DataFrame:
    """``rows`` with the display label of a code; a code without one keeps itself."""
    if not labels:
        return rows.withColumn(out, F.col(column))
    told = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    return rows.withColumn(out, F.coalesce(F.try_element_at(told, F.col(column)), F.col(column)))


def source_manifest(figures: dict[str, DataFrame]) -> DataFrame:
    """figure, rows, columns and an order-free hash of the values of each figure's data."""
    parts = []
    for name, df in figures.items():
        text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns])
        part = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("bigint")
        parts.append(df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(part), F.lit(0)).alias("value_hash")).select(F.lit(name).alias("figure"), "rows", F.lit(len(df.columns)).alias("columns"), "value_hash"))
    return reduce(DataFrame.unionByName, parts)
