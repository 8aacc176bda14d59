"""Problem 1: delimited records that fail to parse, apart from those that load."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.sources.csv_states import Tokens
from pulsegrid.sources.tables import require_columns, spare_name

FLOWSHEET_FIELDS = ("LOG_ID", "MRN", "FLO_NAME", "FLO_DISPLAY_NAME", "RECORD_TYPE", "RECORDED_TIME", "MEAS_VALUE", "UNITS")

NUMBER = r"[+-]?(?:\d+(?:\.\d*)?|\.\d+)"
MEASURE = rf"(?i)^\s*(?:{NUMBER}\s*(?:mm ?hg|kpa|cmh2o)?|{NUMBER}\s*/\s*{NUMBER})\s*$"
ISO_TIME = r"^\s*(\d{4})-(\d{2})-(\d{2})[ T](\d{2}):(\d{2}):(\d{2})(\.\d+)?\s*(?:Z|[+-](\d{2}):?(\d{2})?)?\s*$"
US_TIME = r"(?i)^\s*(\d{1,2})/(\d{1,2})/(\d{4}) (\d{1,2}):(\d{2}) ?([AP]M)\s*$"


def is_measure(text: Column) -> Column:
    """One decimal number with or without a sign and a pressure unit, or two numbers a/b. NULL counts as none."""
    return F.coalesce(text.rlike(MEASURE), F.lit(False))


def recorded_instant(text: Column) -> Column:
    """The time a text states, or NULL if it is no real date and time of the two allowed notations. No zone means UTC."""

    def number(at: int, n: int) -> Column:
        return F.substring(t, at, n).try_cast("int")

    def part(k: int) -> Column:
        return F.regexp_extract(t, US_TIME, k).try_cast("int")

    t = F.when(text.rlike(r"^\s|\s$"), F.regexp_replace(text, r"^\s+|\s+$", "")).otherwise(text)
    # The notation fixes where each part stands, so one match settles the text and the parts are cut out by place.
    rest = F.substring(t, 20, 64)
    more = F.length(t) > 19
    fraction = F.when(more, F.regexp_extract(rest, r"^\.\d+", 0)).otherwise("")
    seconds = F.concat(F.substring(t, 18, 2), F.substring(fraction, 1, 7)).try_cast("decimal(16,6)")
    ahead = F.when(more, F.regexp_extract(rest, r"([+-]\d{2}:?(?:\d{2})?)$", 1)).otherwise("")
    zone_minutes = F.when(ahead == "", 0).otherwise(
        F.when(F.substring(ahead, 1, 1) == "-", -1).otherwise(1) * (F.substring(ahead, 2, 2).try_cast("int") * 60 + F.coalesce(F.regexp_extract(ahead, r"^.\d{2}:?(\d{2})$", 1).try_cast("int"), F.lit(0)))
    )
    legal = (number(12, 2) < 24) & (number(15, 2) < 60) & (number(18, 2) < 60) & (F.abs(zone_minutes) <= 18 * 60)
    from_iso = F.when(legal, F.try_make_timestamp_ltz(number(1, 4), number(6, 2), number(9, 2), number(12, 2), number(15, 2), seconds, F.lit("UTC")))
    from_iso = F.when(ahead == "", from_iso).otherwise(F.timestamp_micros(F.unix_micros(from_iso) - zone_minutes.cast("bigint") * 60_000_000))
    hour12 = part(4)
    hour = F.when(hour12.between(1, 12), hour12 % 12 + F.when(F.upper(F.regexp_extract(t, US_TIME, 6)) == "PM", 12).otherwise(0))
    from_us = F.when(part(5) < 60, F.try_make_timestamp_ltz(part(3), part(1), part(2), hour, part(5), F.lit(0).cast("decimal(16,6)"), F.lit("UTC")))
    return F.when(text.rlike(ISO_TIME), from_iso).when(text.rlike(US_TIME), from_us)


def _tokenizer(width: int, chunk: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(batch.num_columns - 1)
            raw = pa.concat_arrays([raw]) if raw.offset else raw  # an offset of 0
            lines = raw.cast(pa.large_binary()).fill_null(b"")
            offsets = np.frombuffer(lines.buffers()[1], np.int64)[: len(lines) + 1] if len(lines) else np.zeros(1, np.int64)
            data = np.frombuffer(lines.buffers()[2], np.uint8) if lines.buffers()[2] is not None else np.empty(0, np.uint8)
            tokens = Tokens(data, offsets, chunk)
            good = ~tokens.bad & (tokens.columns == width)
            content, ends = tokens.fields(good, width)
            values = pa.LargeStringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(content))
            row = np.cumsum(good) - 1
            columns = [
                values.take(pa.array(np.where(good, row * width + k, 0), mask=~good)).cast(pa.string()) if len(values) else pa.nulls(len(good), pa.string())
                for k in range(width)
            ]
            bad = pa.array(tokens.bad)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], raw, pa.array(tokens.columns.astype(np.int32)), bad, pa.array(tokens.error_offset.astype(np.int32)), *columns],
                names=[str(k) for k in range(batch.num_columns + 3 + width)],
            )

    return run


def parse_records(df: DataFrame, raw: str, fields: Sequence[str] = FLOWSHEET_FIELDS, chunk: int | None = None) -> DataFrame:
    """Every record of ``df`` with its fields, its kind and, if it is rejected, the reason and where.

    ``df`` has one row per record, whose text is in ``raw`` and may hold line breaks; its other columns stay (a name that
    equals one of the new ones gets the suffix ``_in``). New columns: ``kind`` (row, reject, header, blank), ``reason``
    (quoting, column_count, meas_value, recorded_time; the first that applies), ``error_offset`` (bytes into the record; 0 for
    a wrong number of fields and -1 for a wrong value), ``n_fields``, the fields as text in lower case (NULL unless the
    record has the right number of them), ``recorded_at`` and ``meas_number`` (the first number of a valid value).
    A NULL, empty or all-blank record is blank; a record of the fields' own names is a header; neither is rejected.
    Repeated rows are kept. There is no shuffle: records are tokenized in Arrow batches where they lie.
    """
    require_columns(df, [raw], "parse_records")
    names = [f.lower() for f in fields]
    new = {"kind", "reason", "error_offset", "n_fields", "recorded_at", "meas_number", *names}
    kept = [c for c in df.columns if c != raw]
    source = df.select(*[F.col(c).alias(f"{c}_in" if c.lower() in new else c) for c in kept], F.col(raw).alias(spare_name(df, "raw_text")))
    text = source.columns[-1]
    out = T.StructType(
        [*source.schema.fields, T.StructField("n_fields", T.IntegerType()), T.StructField("bad_quotes", T.BooleanType()), T.StructField("error_offset", T.IntegerType())]
        + [T.StructField(n, T.StringType()) for n in names]
    )
    tokens = source.mapInArrow(_tokenizer(len(names), chunk), out)
    blank = F.col(text).isNull() | F.col(text).rlike(r"^\s*$")
    header = F.lit(True)
    for n in names:
        header = header & F.coalesce(F.upper(F.trim(F.regexp_replace(F.col(n), "^﻿", ""))) == n.upper(), F.lit(False))
    instant = recorded_instant(F.col("recorded_time"))
    checked = tokens.withColumn("recorded_at", instant)
    reason = (
        F.when(blank | header, F.lit(None).cast("string"))
        .when(F.col("bad_quotes"), "quoting")
        .when(F.col("n_fields") != len(names), "column_count")
        .when(~is_measure(F.col("meas_value")), "meas_value")
        .when(F.col("recorded_at").isNull(), "recorded_time")
    )
    judged = checked.withColumn("reason", reason).withColumn("_blank", blank).withColumn("_header", header)
    kind = F.when(F.col("_blank"), "blank").when(F.col("_header"), "header").when(F.col("reason").isNotNull(), "reject").otherwise("row")
    # An array of one: a filter on the verdict stays above it, so that no record is judged a second time for the filter.
    verdict = F.explode(F.array(F.struct(kind.alias("kind"), "reason"))).alias("_verdict")
    told = judged.drop("reason", "_blank", "_header").columns
    out = judged.select(*told, verdict).select(*told, "_verdict.reason", "_verdict.kind")
    return (
        out.withColumn("error_offset", F.when(F.col("reason") == "quoting", F.col("error_offset")).when(F.col("reason") == "column_count", 0).when(F.col("reason").isNotNull(), -1))
        .withColumn("meas_number", F.when(F.col("kind") == "row", F.regexp_extract("meas_value", NUMBER, 0).try_cast("double")))
        .drop("bad_quotes", text)
    )


def rejected(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("kind") == "reject")


def loaded(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("kind") == "row")
