"""Problem 5: time texts of mixed notation, precision and zone as one UTC instant each."""

from __future__ import annotations

from zoneinfo import available_timezones

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.functions.zones import abbreviation_offsets, local_intervals

# Notations, as fixed patterns.
CANONICAL = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z$"
ISO = r"^\d{4}-\d{1,2}-\d{1,2}[T ]\d{1,2}:\d{2}(:\d{2}(\.\d+)?)?"
# No text is of two of them; the frequent ones stand first because they are tried in this order.
FORMS = (
    ("minutes", r"^[+-]?\d{1,8}(\.\d+)?( ?min)?$"),
    ("iso_zone", ISO + r" ?(Z|[+-]\d{2}(:?\d{2})?)$"),
    ("iso_local", ISO + r"$"),
    ("slashed", r"^\d{1,2}/\d{1,2}/\d{4},? \d{1,2}:\d{2}(:\d{2}(\.\d+)?)?( ?[AaPp][Mm])?( [A-Za-z]{2,5})?$"),
    ("epoch_s", r"^\d{9,10}(\.\d+)?$"),
    ("basic_zone", r"^\d{8}T\d{4}(\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})$"),
    ("month_name", r"^[A-Za-z]{3,9} \d{1,2}, \d{4},? \d{1,2}:\d{2}(:\d{2}(\.\d+)?)?( ?[AaPp][Mm])?( [A-Za-z]{2,5})?$"),
    ("epoch_ms", r"^\d{12,13}$"),
    ("dotted", r"^\d{1,2}\.\d{1,2}\.\d{4},? \d{1,2}:\d{2}(:\d{2}(\.\d+)?)?( ?[AaPp][Mm])?( [A-Za-z]{2,5})?$"),
    ("iso_named", ISO + r"\[[A-Za-z_]+(/[A-Za-z0-9_+-]+)*\]$"),
    ("iso_abbr", ISO + r" [A-Za-z]{2,5}$"),
    ("basic_local", r"^\d{8}T\d{4}(\d{2}(\.\d+)?)?$"),
    ("epoch_us", r"^\d{15,16}$"),
)
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()


def _form(text: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, pattern in reversed(FORMS):
        out = F.when(text.rlike(pattern), name).otherwise(out)
    return out


def _as_utc_micros(text: Column) -> Column:
    """Microseconds of a standard notation; without a zone, of the clock reading as if it were UTC."""
    return F.unix_micros(text.try_cast("timestamp"))


def _clock(parts: Column, at: int, afternoon: Column, year: Column, month: Column, day: Column) -> Column:
    """Clock micros of split parts, of which parts[at], [at + 1] and [at + 2] are hour, minute and second."""
    part = lambda k: F.try_element_at(parts, F.lit(k + 1))
    hour = part(at).try_cast("int")
    hour = F.when(afternoon == "P", hour % 12 + 12).when(afternoon == "A", hour % 12).otherwise(hour)
    second = F.when(part(at + 2).rlike(r"^\d"), part(at + 2)).otherwise("0")
    return _as_utc_micros(F.concat(year, F.lit("-"), month.cast("string"), F.lit("-"), day.cast("string"), F.lit(" "), hour.cast("string"), F.lit(":"), part(at + 1), F.lit(":"), F.lpad(F.substring_index(second, ".", 1), 2, "0"), F.when(second.contains("."), F.concat(F.lit("."), F.substring_index(second, ".", -1))).otherwise(""), F.lit("Z")))


def zone_table(sites: DataFrame, tz: str = "tz_name") -> tuple[DataFrame, dict[str, int]]:
    """The exploded offset intervals of the zones that ``sites`` names, and the offsets of their abbreviations.

    ``sites`` is a fixed table with one row per site; its distinct zone names (at most the few hundred of the zone database)
    are read at the driver. NULL and unknown names are left out.
    """
    known = available_timezones()
    names = sorted(r[0] for r in sites.select(tz).distinct().filter(F.col(tz).isNotNull()).collect() if r[0] in known)
    schema = "zone string, local_year int, local_from bigint, local_to bigint, offset bigint, other_offset bigint, kind string"
    return sites.sparkSession.createDataFrame(local_intervals(names), schema), abbreviation_offsets(names)


def _zone_ids() -> list[str]:
    """The zone names of the zone database, which texts may name themselves."""
    return sorted(available_timezones())


def resolve_instants(
    df: DataFrame,
    text: str,
    zones: tuple[DataFrame, dict[str, int]],
    *,
    zone: str,
    day_first: str,
    origin: str,
    expected: Column | None = None,
    prefix: str = "",
) -> DataFrame:
    """``df`` with the UTC instant that each time text states.

    Columns named by arguments: ``zone`` the wall clock's zone name (NULL: UTC), ``day_first`` the order in slashed dates
    (NULL: month first), ``origin`` the timestamp of minute zero of relative clocks. A name that is no zone gives NULL. ``expected`` are micros that other times of
    the row lead to, by which a clock reading that occurs twice is settled: the nearer of both counts, and the earlier if they
    are as near or there is nothing to go by. New columns: ``utc_us`` (NULL if the text is NULL or of no known notation, or
    lacks its origin), ``notation`` and ``clock`` (one, two, none, or NULL where no wall clock is involved). Readings in the
    gap of a clock set forward keep the offset before the gap and the mark ``none``. Rows are neither lost nor multiplied.

    Local times meet the zone's exploded offset intervals in an as-of join: the equal part is zone and local year, so that
    each reading is compared with about three intervals. The interval table is bounded by the zone database and broadcast.
    """
    intervals, short_names = zones
    u, n, c = f"{prefix}utc_us", f"{prefix}notation", f"{prefix}clock"
    t = F.trim(F.col(text))
    base = df.withColumn("_t", t).withColumn(n, _form(F.col("_t")))
    t, form = F.col("_t"), F.col(n)
    parts = F.split(t, r"[^A-Za-z0-9.]+")
    dots = F.split(t, r"[^A-Za-z0-9]+")
    part = lambda k: F.try_element_at(parts, F.lit(k + 1))
    dot = lambda k: F.try_element_at(dots, F.lit(k + 1))
    afternoon = F.upper(F.regexp_extract(t, r"\d ?([AaPp])[Mm]( |$)", 1))
    first = F.coalesce(F.col(day_first), F.lit(False))
    month = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower(F.substring(part(0), 1, 3)))
    day_text, clock_text = F.substring(t, 1, 8), F.substring_index(F.regexp_extract(t, r"T([\d.]+)", 1), ".", 1)
    basic = F.concat(
        F.substring(day_text, 1, 4), F.lit("-"), F.substring(day_text, 5, 2), F.lit("-"), F.substring(day_text, 7, 2), F.lit("T"),
        F.substring(clock_text, 1, 2), F.lit(":"), F.substring(clock_text, 3, 2), F.lit(":"), F.rpad(F.substring(clock_text, 5, 2), 2, "0"), F.regexp_extract(t, r"T\d+(\.\d+)", 1),
    )
    basic_zone = F.regexp_extract(t, r"(Z|[+-]\d{2}:?\d{2})$", 1)
    basic_zone = F.when(basic_zone.rlike(r"^[+-]\d{4}$"), F.concat(F.substring(basic_zone, 1, 3), F.lit(":"), F.substring(basic_zone, 4, 2))).otherwise(basic_zone)
    iso_zone = F.when(t.rlike(r"[+-]\d{4}$"), F.regexp_replace(t, r"(\d{2})$", ":$1")).otherwise(t)
    minutes = F.regexp_extract(t, r"^[+-]?\d+(\.\d+)?", 0).try_cast("decimal(18,6)")
    direct = (
        F.when(form == "iso_zone", _as_utc_micros(iso_zone))
        .when(form == "basic_zone", _as_utc_micros(F.concat(basic, basic_zone)))
        .when(form == "epoch_s", (t.try_cast("decimal(24,6)") * 1_000_000).cast("bigint"))
        .when(form == "epoch_ms", t.try_cast("bigint") * 1000)
        .when(form == "epoch_us", t.try_cast("bigint"))
        .when(form == "minutes", F.unix_micros(F.col(origin)) + (minutes * 60_000_000).cast("bigint"))
    )
    local = (
        F.when(form == "iso_local", _as_utc_micros(F.concat(t, F.lit("Z"))))
        .when(form == "iso_named", _as_utc_micros(F.concat(F.substring_index(t, "[", 1), F.lit("Z"))))
        .when(form == "iso_abbr", _as_utc_micros(F.concat(F.regexp_extract(t, ISO, 0), F.lit("Z"))))
        .when(form == "basic_local", _as_utc_micros(F.concat(basic, F.lit("Z"))))
        .when(form == "slashed", _clock(parts, 3, afternoon, part(2), F.when(first, part(1)).otherwise(part(0)), F.when(first, part(0)).otherwise(part(1))))
        .when(form == "dotted", _clock(F.slice(parts, 2, 9), 0, afternoon, dot(2), dot(1), dot(0)))
        .when(form == "month_name", _clock(parts, 3, afternoon, part(2), month, part(1)))
    )
    stated = F.when(form == "iso_named", F.regexp_extract(t, r"\[(.*)\]$", 1)).otherwise(F.col(zone))
    short = F.when(form.isin("iso_abbr", "slashed", "dotted", "month_name"), F.upper(F.regexp_extract(t, r" ([A-Za-z]{3,5})$", 1)))
    offsets = F.create_map(*[F.lit(x) for pair in short_names.items() for x in pair]) if short_names else F.lit(None).cast("map<string,bigint>")
    base = (
        base.withColumn("_direct", direct)
        .withColumn("_local", local)
        .withColumn("_zone", F.coalesce(stated, F.lit("UTC")))
        .withColumn("_short", F.try_element_at(offsets, F.concat_ws("|", F.col("_zone"), short)))
    )
    on_clock = F.col("_local").isNotNull() & F.col("_short").isNull()
    base = base.withColumn("_join", F.when(on_clock, F.col("_zone"))).withColumn("_year", F.when(on_clock, F.year(F.timestamp_micros(F.col("_local")))))
    right = intervals.select(F.col("zone").alias("_rz"), F.col("local_year").alias("_ry"), "local_from", "local_to", F.col("offset").alias("_offset"), F.col("other_offset").alias("_other"), F.col("kind").alias("_kind"))
    joined = base.withColumn("_expected", expected if expected is not None else F.lit(None).cast("bigint")).join(
        F.broadcast(right),
        (F.col("_join") == F.col("_rz")) & (F.col("_year") == F.col("_ry")) & (F.col("_local") >= F.col("local_from")) & (F.col("_local") < F.col("local_to")),
        "left",
    )
    own, other = F.col("_local") - F.col("_offset"), F.col("_local") - F.col("_other")
    nearer = F.abs(own - F.col("_expected")) < F.abs(other - F.col("_expected"))
    further = F.abs(own - F.col("_expected")) > F.abs(other - F.col("_expected"))
    keep = F.coalesce(F.col("_kind") != "two", F.lit(True)) | F.coalesce(F.when(nearer, True).when(further, False), own < other)
    # Zones that a text names itself and the interval table lacks; a name that is no zone leaves NULL.
    ids = ", ".join(f"'{x}'" for x in _zone_ids())
    real = F.expr(f"case when _zone in ({ids}) then _zone end")
    named = F.when(real.isNotNull(), F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(F.col("_local")), F.coalesce(real, F.lit("UTC")))))
    instant = (
        F.when(F.col("_direct").isNotNull(), F.col("_direct"))
        .when(F.col("_short").isNotNull(), F.col("_local") - F.col("_short"))
        .when(F.col("_offset").isNotNull(), own)
        .when(F.col("_zone") == "UTC", F.col("_local"))
        .when(F.col("_local").isNotNull(), named)
    )
    return joined.filter(keep).select(*df.columns, n, instant.alias(u), F.col("_kind").alias(c))


def cohort_instants(cohort: DataFrame, sites: DataFrame, zones: tuple[DataFrame, dict[str, int]] | None = None) -> DataFrame:
    """cohort's key columns with ``utc_us`` of anesthesia_start; a start read twice is settled by the end less the duration."""
    zones = zones or zone_table(sites)
    site = F.broadcast(sites.select(F.col("site_code").alias("_site"), F.col("tz_name").alias("zone"), "day_first").dropDuplicates(["_site"]))
    rows = cohort.select("cohort_id", "encounter_id", "site_code", "anesthesia_start", "anesthesia_end", "anesthesia_duration_min", "clock_origin")
    rows = rows.join(site, F.col("site_code") == F.col("_site"), "left").drop("_site")
    ends = resolve_instants(rows, "anesthesia_end", zones, zone="zone", day_first="day_first", origin="clock_origin", prefix="end_")
    settled = F.when(F.col("end_clock").isNull() | (F.col("end_clock") != "two"), F.col("end_utc_us") - (F.col("anesthesia_duration_min") * 60_000_000).cast("bigint"))
    return resolve_instants(ends, "anesthesia_start", zones, zone="zone", day_first="day_first", origin="clock_origin", expected=settled)


def encounter_clocks(starts: DataFrame) -> DataFrame:
    """One row per encounter: zone, order of dates, minute zero and start instant, from :func:`cohort_instants`.

    All four are of one delivered row, so no clock is mixed from several: the one with the earliest start (a start that can't be
    read comes last), then the lowest cohort_id.
    """
    one = F.min_by(F.struct("zone", "day_first", "clock_origin", F.col("utc_us").alias("start_us")), F.struct(F.col("utc_us").isNull(), F.col("utc_us"), F.col("cohort_id")))
    return starts.filter(F.col("encounter_id").isNotNull()).groupBy(F.col("encounter_id").alias("_enc")).agg(one.alias("c")).select("_enc", "c.*")


def reading_instants(readings: DataFrame, starts: DataFrame, zones: tuple[DataFrame, dict[str, int]]) -> DataFrame:
    """readings (obs_id, encounter_id, observed_time, minute_from_anesthesia_start, loaded_at) with ``utc_us``.

    A reading of the clock that occurs twice is settled by the encounter's start plus the row's minute, else by the time it was
    loaded. Readings of an encounter without a cohort row are plain UTC.
    """
    clocks = encounter_clocks(starts)
    rows = readings.join(clocks, F.col("encounter_id") == F.col("_enc"), "left").drop("_enc")
    expected = F.coalesce(F.col("start_us") + (F.col("minute_from_anesthesia_start") * 60_000_000).cast("bigint"), F.unix_micros(F.col("loaded_at")))
    return resolve_instants(rows, "observed_time", zones, zone="zone", day_first="day_first", origin="clock_origin", expected=expected)


def restated_instants(cohort: DataFrame, readings: DataFrame, sites: DataFrame) -> DataFrame:
    """src_table, row_id, utc_us of every time not yet written canonically; times that can't be read are left out."""
    zones = zone_table(sites)
    starts = cohort_instants(cohort, sites, zones)
    late = lambda c: F.col(c).isNotNull() & ~F.col(c).rlike(CANONICAL)
    a = starts.filter(late("anesthesia_start")).select(F.lit("cohort").alias("src_table"), F.col("cohort_id").alias("row_id"), "utc_us")
    rows = readings.filter(late("observed_time")).select("obs_id", "encounter_id", "observed_time", "minute_from_anesthesia_start", "loaded_at")
    b = reading_instants(rows, starts, zones).select(F.lit("map_observations").alias("src_table"), F.col("obs_id").alias("row_id"), "utc_us")
    return a.unionByName(b).filter(F.col("utc_us").isNotNull())
