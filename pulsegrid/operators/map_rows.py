"""Pressure readings taken from a source's own rows: label and value rules, the case's time window, and the processes on them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions import parse
from pulsegrid.operators import grid
from pulsegrid.sources.archives import collect_parts
from pulsegrid.sources.tables import require_columns


def in_window(rows: DataFrame, cases: DataFrame) -> DataFrame:
    """``rows`` (encounter_id, at, ...) of known cases (encounter_id, start, end) that lie in their window, both ends included, with
    ``patient_id`` and ``minute_from_anesthesia_start``. ``at``, start and end are minutes, or all timestamps.

    One row per encounter is taken from ``cases`` (the first by start and end). NULL times are in no window.
    """
    one = cases.filter(F.col("encounter_id").isNotNull()).groupBy(F.col("encounter_id").alias("_e")).agg(F.min(F.struct("start", "end", "patient_id")).alias("_c"))
    j = rows.join(one, F.col("encounter_id") == F.col("_e")).filter((F.col("at") >= F.col("_c.start")) & (F.col("at") <= F.col("_c.end")))
    times = dict(rows.dtypes)["at"].startswith("timestamp")
    minute = (F.unix_micros("at") - F.unix_micros("_c.start")) / 6e7 if times else F.col("at") - F.col("_c.start")
    return j.select(*rows.columns, F.col("_c.patient_id").alias("patient_id"), minute.alias("minute_from_anesthesia_start"))


def from_vitals(vitals: DataFrame, cases: DataFrame, low: float = grid.LOW, high: float = grid.HIGH, keep: tuple[str, ...] = ()) -> DataFrame:
    """Readings of the two mean-pressure items of a vitals table on a relative clock: encounter_id, at, map_value, map_source, raw_name,
    patient_id, minute_from_anesthesia_start, and the columns ``keep``."""
    require_columns(vitals, ["op_id", "chart_time", "item_name", "value"], "vitals")
    name, value = F.lower(F.trim("item_name")), F.col("value").cast("string").try_cast("double")
    source = F.when(name == "art_mbp", "ART").when(name == "nibp_mbp", "NIBP")
    rows = vitals.select(*keep, F.col("op_id").cast("string").alias("encounter_id"), F.col("chart_time").cast("string").try_cast("double").alias("at"), value.alias("map_value"), source.alias("map_source"), name.alias("raw_name"))
    return in_window(rows.filter(F.col("map_source").isNotNull() & F.col("map_value").between(low, high) & ~F.isnan("map_value") & F.col("at").isNotNull() & ~F.isnan("at")), cases)


def from_flowsheet(flowsheet: DataFrame, cases: DataFrame, low: float = grid.LOW, high: float = grid.HIGH) -> DataFrame:
    """Readings whose label means a mean pressure (not a summary of it), whose value is one number in range and whose time can be read:
    flow_id, encounter_id, at, map_value, map_source (ART, NIBP, else DIRECT), patient_id, minute_from_anesthesia_start."""
    require_columns(flowsheet, ["flow_id", "log_id", "flo_name", "flo_display_name", "recorded_time", "meas_value"], "flowsheet")
    text = parse.label(F.col("flo_name"), F.col("flo_display_name"))
    rows = flowsheet.filter(parse.is_map_label(text)).select(
        "flow_id", F.col("log_id").alias("encounter_id"), F.col("recorded_time").try_cast("timestamp").alias("at"), parse.single_numeric(F.col("meas_value")).alias("map_value"), parse.label_source(text).alias("map_source")
    )
    return in_window(rows.filter(F.col("map_value").between(low, high) & F.col("at").isNotNull()), cases)


def extract(flowsheet: DataFrame, cases: DataFrame, part: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The readings of a flowsheet, and by part (``part`` names its column; all rows are one part without it) the rows it delivered and those
    retained. Neither is computed before it is used."""
    own = flowsheet.withColumn("_part", F.col(part) if part else F.lit("all"))
    rows = from_flowsheet(flowsheet, cases)
    kept = own.select("flow_id", "_part").join(rows.select("flow_id"), "flow_id", "left_semi")
    return rows, collect_parts(own, kept, "_part").withColumnRenamed("_part", "part")


def processes(raw: DataFrame, kind: str) -> dict[str, DataFrame]:
    """The series made of readings (case_id, t, map, source): ``published`` keeps exact times, ``irregular`` gives coarse and fine grids.

    Only the formal sources enter. Raises ValueError if there is no formal reading, or for another kind.
    """
    formal = raw.filter(F.col("source").isin(*grid.PRIORITY))
    if kind not in ("published", "irregular"):
        raise ValueError(f"unknown kind of series {kind}")
    if formal.isEmpty():
        raise ValueError("no reading of a formal source")
    if kind == "published":
        return {"coarse": grid.published_grid(formal)}
    return {"coarse": grid.harmonize(formal, 5.0), "fine": grid.harmonize(formal, 1.0)}
