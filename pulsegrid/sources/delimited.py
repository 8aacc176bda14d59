"""Typed tables of delimited sources, and delimited sinks that appear whole or not at all."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

OPERATIONS = {
    "op_id": "string", "subject_id": "string", "age": "double", "sex": "string", "weight": "double", "height": "double", "asa": "double", "emop": "double", "department": "string", "antype": "string",
    "icd10_pcs": "string", "anstart_time": "double", "anend_time": "double", "cpbon_time": "double",
}
VITALS = {"op_id": "string", "subject_id": "string", "chart_time": "double", "item_name": "string", "value": "double"}
PATIENTS = {n: "string" for n in "LOG_ID MRN BIRTH_DATE HEIGHT WEIGHT SEX ASA_RATING_C PRIMARY_ANES_TYPE_NM PRIMARY_PROCEDURE_NM AN_START_DATETIME AN_STOP_DATETIME".split()}
FLOWSHEET = {n: "string" for n in "LOG_ID MRN FLO_NAME FLO_DISPLAY_NAME RECORD_TYPE RECORDED_TIME MEAS_VALUE UNITS".split()}
MEDICATIONS = {n: "string" for n in "LOG_ID DISPLAY_NAME MEDICATION_NM RECORD_TYPE MAR_ACTION_NM MED_ACTION_TIME MED_ROUTE_NM".split()}


def scan(spark: SparkSession, path: str | list[str], columns: dict[str, str]) -> DataFrame:
    """``columns`` of one or more CSV files (gzipped too) by name, in their types, with ``part`` (the file's name).

    All files are read as text, so that a value that is none of its type becomes NULL and not a guess; empty texts are NULL. A file
    that lacks a column raises. A gzipped file is one task: keep a Parquet copy of what is read often.
    """
    files = spark.read.option("header", True).option("multiLine", False).option("escape", '"').option("enforceSchema", False).csv(path)
    names = {c.lower(): c for c in files.columns}
    lacking = [c for c in columns if c.lower() not in names]
    if lacking:
        raise ValueError(f"{path} lacks the columns {', '.join(lacking)}")
    typed = [(F.nullif(F.trim(F.col(f"`{names[c.lower()]}`")), F.lit("")).try_cast(t) if t != "string" else F.nullif(F.col(f"`{names[c.lower()]}`"), F.lit(""))).alias(c) for c, t in columns.items()]
    return files.select(*typed, F.element_at(F.split(F.input_file_name(), "/"), -1).alias("part"))


def stage(spark: SparkSession, folder: str, name: str, schema: dict[str, str], key: list[str]) -> DataFrame:
    """A stage's Parquet table with the columns and types it must have and a key that may neither be NULL nor repeat; else ValueError."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    kinds = dict(df.dtypes)
    off = [c for c, t in schema.items() if kinds.get(c) != t]
    if off:
        raise ValueError(f"{name}: columns missing or of another type: {', '.join(off)}")
    null = F.lit(False)
    for k in key:
        null = null | F.col(k).isNull()
    if not df.filter(null).isEmpty() or not df.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
        raise ValueError(f"{name}: the key {', '.join(key)} is NULL or repeats")
    return df.select(*schema)


def sink(df: DataFrame, folder: str, compress: bool = True) -> None:
    """CSV parts with headers in ``folder``, which must not exist; the commit protocol makes them appear together or not at all."""
    df.write.mode("errorifexists").option("header", True).option("compression", "gzip" if compress else "none").option("escape", '"').csv(folder)


def sink_with_audit(df: DataFrame, folder: str, audit: str, label: str, part: str = "part") -> DataFrame:
    """As :func:`sink`; then label, part and rows per part of what was written, read back and written to ``audit`` as well."""
    sink(df, folder)
    written = df.sparkSession.read.option("header", True).option("escape", '"').csv(folder)
    told = written.groupBy(part).agg(F.count("*").alias("rows")).select(F.lit(label).alias("label"), part, "rows")
    sink(told.coalesce(1), audit, compress=False)
    return df.sparkSession.read.option("header", True).csv(audit).select("label", part, F.col("rows").cast("bigint").alias("rows"))


def gate(manifest: DataFrame, pinned: DataFrame, forbidden: tuple[str, ...] = ()) -> DataFrame:
    """relative_path, state and gate: each pinned file (relative_path, sha256) is ``same``, ``changed`` or ``missing``, others are
    ``unpinned``, or ``forbidden`` by their name; the gate of all is GREEN if every pinned file is the same and none is forbidden."""
    a, b = manifest.select("relative_path", F.col("sha256").alias("_a")), pinned.select("relative_path", F.col("sha256").alias("_b"))
    bad = F.lit(False)
    for name in forbidden:
        bad = bad | F.lower("relative_path").contains(name.lower())
    state = F.when(F.col("_a").isNull(), "missing").when(bad, "forbidden").when(F.col("_b").isNull(), "unpinned").when(F.col("_a") == F.col("_b"), "same").otherwise("changed")
    rows = a.join(b, "relative_path", "full_outer").select("relative_path", state.alias("state"))
    red = rows.agg(F.max(F.col("state").isin("missing", "changed", "forbidden")).alias("_red"))
    return rows.crossJoin(F.broadcast(red)).select("relative_path", "state", F.when(F.coalesce(F.col("_red"), F.lit(False)), "RED").otherwise("GREEN").alias("gate"))  # one row
