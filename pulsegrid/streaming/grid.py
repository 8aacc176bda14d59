"""Extension: the grid of :mod:`pulsegrid.operators.grid` over a stream of readings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.operators.grid import HIGH, LOW, PRIORITY


def stream_cells(readings: DataFrame, *, width_min: float = 5.0, late: str = "30 minutes", low: float = LOW, high: float = HIGH) -> DataFrame:
    """case_id, time_min, cell_end, map, source, n_raw_records_all_sources for a stream of case_id, start, at, map, source.

    Cells are right-closed and counted from each case's ``start``, unlike Spark's own windows, which are left-closed and share one
    origin; so the cell's end is computed and is the event time that the watermark follows. A cell is final once the
    watermark passes its end. The median is exact over the readings of a cell.
    """
    minute = (F.unix_micros("at") - F.unix_micros("start")) / 6e7
    cell = (F.ceil(minute / width_min - 1e-12) * width_min).cast("double")
    good = readings.filter(F.col("case_id").isNotNull() & F.col("map").between(low, high) & F.col("source").isin(*PRIORITY)).withColumn("time_min", cell).filter("time_min > 0")
    ends = good.withColumn("cell_end", F.timestamp_micros(F.unix_micros("start") + (F.col("time_min") * 60_000_000).cast("bigint"))).withWatermark("cell_end", late)
    first = F.col("source") == PRIORITY[0]
    agg = ends.groupBy("case_id", "time_min", "cell_end").agg(F.median(F.when(first, F.col("map"))).alias("v0"), F.median(F.when(~first, F.col("map"))).alias("v1"), F.count("*").alias("n_raw_records_all_sources"))
    return agg.select("case_id", "time_min", "cell_end", F.coalesce("v0", "v1").alias("map"), F.when(F.col("v0").isNotNull(), PRIORITY[0]).otherwise(PRIORITY[1]).alias("source"), "n_raw_records_all_sources")
