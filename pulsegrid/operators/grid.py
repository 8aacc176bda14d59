"""Irregular readings of several devices harmonised onto a right-closed grid, one value per cell and no fill."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.sources.tables import require_columns

LOW, HIGH = 20.0, 200.0
PRIORITY = ("ART", "NIBP")


def validate_phase(width: float, phase: float) -> None:
    if not (width > 0 and width < float("inf")):
        raise ValueError(f"the width must be positive and finite, not {width}")
    if not 0 <= phase < width:
        raise ValueError(f"the phase must lie in [0, {width}), not {phase}")


def checked_sources(raw: DataFrame, source: str = "source", known: tuple[str, ...] = PRIORITY) -> DataFrame:
    """``raw``, failing at run time on a source label that is in no list; NULL labels count as unknown."""
    label = F.col(source)
    return raw.withColumn(source, F.when(label.isin(*known), label).otherwise(F.raise_error(F.concat(F.lit("unmapped source "), F.coalesce(label, F.lit("NULL"))))))


def harmonize(raw: DataFrame, width: float = 5.0, phase: float = 0.0, *, interval: str = "right_closed", statistic: str = "median", priority: tuple[str, str] = PRIORITY, low: float = LOW, high: float = HIGH) -> DataFrame:
    """case_id, time_min, map, source, n_raw_records, n_raw_records_all_sources: one row per case and cell that holds a reading.

    ``raw``: case_id, t (minutes), map, source (only the two of ``priority``). Values outside [low, high], NULLs and NaN, and
    times at or before 0 are dropped (times before 0 where ``interval`` is left_closed). The first source of
    ``priority`` speaks if it has a reading in the cell, else the second. ``statistic`` is the ``median`` or
    ``nearest_right_boundary``, the last reading of the cell (readings at the same time: their median). A cell is labelled by its
    right end; cells begin at ``phase``. Nothing is interpolated or carried forward.
    """
    validate_phase(width, phase)
    require_columns(raw, ["case_id", "t", "map", "source"], "harmonize")
    t = F.col("t")
    good = raw.filter(F.col("case_id").isNotNull() & t.isNotNull() & ~F.isnan(t) & F.col("map").between(low, high) & ~F.isnan("map"))
    if interval == "right_closed":
        good, label = good.filter(t > 0), F.lit(phase) + F.ceil((t - phase) / width - 1e-12).cast("double") * width
    elif interval == "left_closed":
        good, label = good.filter(t >= 0), F.lit(phase) + (F.floor((t - phase) / width + 1e-12) + 1).cast("double") * width
    else:
        raise ValueError(f"unknown interval {interval}")
    cells = good.select("case_id", "t", "map", "source", label.alias("time_min"))
    main, other = (F.col("source") == s for s in priority)
    if statistic == "nearest_right_boundary":
        cells = cells.groupBy("case_id", "time_min", "source", "t").agg(F.median("map").alias("map"), F.count("*").alias("n"))
        values = [F.max_by("map", F.when(m, F.col("t"))) for m in (main, other)]
        at_end = [F.max_by("n", F.when(m, F.col("t"))) for m in (main, other)]
        counts, every = at_end, F.sum("n")
    elif statistic == "median":
        values = [F.median(F.when(m, F.col("map"))) for m in (main, other)]
        counts, every = [F.count(F.when(m, 1)) for m in (main, other)], F.count("*")
    else:
        raise ValueError(f"unknown statistic {statistic}")
    agg = cells.groupBy("case_id", "time_min").agg(values[0].alias("v0"), values[1].alias("v1"), counts[0].alias("n0"), counts[1].alias("n1"), every.alias("n_raw_records_all_sources"))
    first = F.col("v0").isNotNull()
    return agg.select(
        "case_id", "time_min", F.coalesce("v0", "v1").alias("map"), F.when(first, priority[0]).otherwise(priority[1]).alias("source"),
        F.when(first, F.col("n0")).otherwise(F.col("n1")).cast("bigint").alias("n_raw_records"), F.col("n_raw_records_all_sources").cast("bigint").alias("n_raw_records_all_sources"),
    )


def published_grid(raw: DataFrame, *, first: float = 0.0, last: float | None = None, low: float = LOW, high: float = HIGH) -> DataFrame:
    """As :func:`harmonize` on a series that is on a grid already: exact times are kept, without binning."""
    t = F.col("t")
    good = raw.filter(F.col("case_id").isNotNull() & (t >= first) & ~F.isnan(t) & F.col("map").between(low, high) & ~F.isnan("map"))
    good = good if last is None else good.filter(t <= last)
    art = F.col("source") == PRIORITY[0]
    agg = good.groupBy("case_id", F.col("t").alias("time_min")).agg(
        F.median(F.when(art, F.col("map"))).alias("v0"), F.median(F.when(~art, F.col("map"))).alias("v1"), F.count(F.when(art, 1)).alias("n0"), F.count("*").alias("n_raw_records_all_sources")
    )
    only = F.col("v0").isNotNull()
    return agg.select(
        "case_id", "time_min", F.coalesce("v0", "v1").alias("map"), F.when(only, PRIORITY[0]).otherwise(PRIORITY[1]).alias("source"),
        F.when(only, F.col("n0")).otherwise(F.col("n_raw_records_all_sources")).alias("n_raw_records"), "n_raw_records_all_sources",
    )
