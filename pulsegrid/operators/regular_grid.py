"""Problem 2: irregular readings onto a regular grid, gaps filled within a limit or marked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.sources.tables import require_columns


def cell_label(minute: Column, width: float) -> Column:
    """The end of the right-closed cell that holds ``minute``: label L holds (L - width, L]."""
    return (F.ceil(minute / F.lit(float(width))) * F.lit(float(width))).cast("double")


def fill_grid(
    spans: DataFrame,
    readings: DataFrame,
    *,
    key: str = "encounter_id",
    duration: str = "anesthesia_duration_min",
    minute: str = "minute_from_anesthesia_start",
    value: str = "map_value",
    width_min: int = 5,
    gap_limit_min: float = 15.0,
) -> DataFrame:
    """One row per full grid cell of every source, with cells without a reading filled from both sides or marked.

    ``spans`` has one or more rows per source with its length in minutes (the longest counts; NULL keys and lengths are left
    out, a length under one cell or NaN gives no cell). ``readings`` has the irregular values: rows with a NULL or NaN key,
    minute or value don't count; repeated rows count once per row in n_readings and don't change min and max.

    A cell with readings gets their mean (status ``observed``). An empty cell whose last reading before and first reading
    after lie at most ``gap_limit_min`` apart gets the time-weighted linear value between them at the cell's end (``filled``);
    any other is ``gap``, or ``edge`` if there is no reading on one side, with a NULL value. Readings outside the span serve as
    neighbours only. Readings at the same minute: the neighbour is their mean.

    Readings are reduced to one row per source and cell before any window sees them, so a source holds no more rows than cells,
    whatever share of the readings it has; grid and readings meet in a union sorted by cell, an as-of merge of both sides.
    """
    require_columns(spans, [key, duration], "fill_grid: spans")
    require_columns(readings, [key, minute, value], "fill_grid: readings")
    width = float(width_min)
    full = F.floor(F.max(F.when(~F.isnan(F.col(duration).cast("double")), F.col(duration).cast("double"))) / F.lit(width)).cast("int")
    cells = (
        spans.filter(F.col(key).isNotNull())
        .groupBy(F.col(key).alias("k"))
        .agg(full.alias("n"))
        .filter(F.col("n") >= 1)
        .select("k", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("c"))
        .select("k", (F.col("c") * F.lit(width)).cast("double").alias("cell"), F.lit(True).alias("on_grid"))
    )
    m, v = F.col(minute).cast("double"), F.col(value).cast("double")
    at_minute = (
        readings.filter(F.col(key).isNotNull() & m.isNotNull() & v.isNotNull() & ~F.isnan(m) & ~F.isnan(v))
        .select(F.col(key).alias("k"), cell_label(m, width).alias("cell"), m.alias("m"), v.alias("v"))
    )
    by_cell = at_minute.groupBy("k", "cell").agg(
        F.count("*").alias("n_readings"),
        F.sum("v").alias("sum_v"),
        F.min(F.struct("m", "v")).alias("first"),
        F.max(F.struct("m", "v")).alias("last"),
    )
    nothing = "cast(null as {})".format
    point = by_cell.schema["first"].dataType.simpleString()
    merged = (
        cells.select("k", "cell", "on_grid", F.expr(nothing("bigint")).alias("n_readings"), F.expr(nothing("double")).alias("sum_v"), F.expr(nothing(point)).alias("first"), F.expr(nothing(point)).alias("last"))
        .unionByName(by_cell.withColumn("on_grid", F.lit(False)))
        .groupBy("k", "cell")
        .agg(F.max("on_grid").alias("on_grid"), F.max("n_readings").alias("n_readings"), F.max("sum_v").alias("sum_v"), F.max("first").alias("first"), F.max("last").alias("last"))
    )
    order = "over (partition by k order by cell)"
    sided = merged.withColumn("prev", F.expr(f"lag(last) ignore nulls {order}")).withColumn("next", F.expr(f"lead(first) ignore nulls {order}"))
    gap = F.col("next.m") - F.col("prev.m")
    between = F.col("prev.v") + F.try_divide((F.col("next.v") - F.col("prev.v")) * (F.col("cell") - F.col("prev.m")), gap)
    observed = F.col("n_readings") > 0
    status = (
        F.when(observed, "observed")
        .when(F.col("prev").isNull() | F.col("next").isNull(), "edge")
        .when(gap <= F.lit(float(gap_limit_min)), "filled")
        .otherwise("gap")
    )
    return (
        sided.filter("on_grid")
        .withColumn("status", status)
        .select(
            F.col("k").alias(key),
            F.col("cell").cast("int").alias("time_min"),
            F.when(observed, F.col("sum_v") / F.col("n_readings")).when(F.col("status") == "filled", between).alias("value"),
            "status",
            F.coalesce("n_readings", F.lit(0)).cast("bigint").alias("n_readings"),
            (F.col("cell") - F.col("prev.m")).alias("since_prev_min"),
            (F.col("next.m") - F.col("cell")).alias("until_next_min"),
        )
    )


def empty_cells(grid: DataFrame) -> DataFrame:
    """The cells of a grid made by :func:`fill_grid` in which no reading falls."""
    return grid.filter(F.col("status") != "observed")
