from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

from conftest import SMALL
from pyspark.sql import functions as F

from pulsegrid.functions.zones import local_intervals
from pulsegrid.operators.instants import cohort_instants, reading_instants, resolve_instants, restated_instants, zone_table

SITES = "site_code string, tz_name string, day_first boolean"
ALL = [("A", "America/New_York", False), ("B", "Europe/Berlin", True), ("K", "Asia/Kolkata", True), ("Z", None, None), ("X", "No/Zone", False)]


def utc(*x):
    return int((datetime(*x, tzinfo=timezone.utc) - datetime(1970, 1, 1, tzinfo=timezone.utc)) / timedelta(microseconds=1))


def resolve_all(spark, rows):
    """rows: (text, zone, day_first, origin, expected)."""
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "id int, t string, z string, f boolean, o timestamp, e bigint")
    out = resolve_instants(df, "t", zone_table(spark.createDataFrame(ALL, SITES)), zone="z", day_first="f", origin="o", expected=F.col("e")).collect()
    assert sorted(r.id for r in out) == list(range(len(rows)))
    return [r for _, r in sorted((r.id, r) for r in out)]


def row(text, zone="America/New_York", day_first=False, origin=None, expected=None):
    return text, zone, day_first, origin, expected


NOTATIONS = [
        ("2024-01-05T10:00:00Z", utc(2024, 1, 5, 10)),
        ("2024-01-05 10:00:00", utc(2024, 1, 5, 15)),
        ("2024-01-05T10:00:00.250+05:30", utc(2024, 1, 5, 4, 30, 0, 250000)),
        ("20240105T100000.125-0800", utc(2024, 1, 5, 18, 0, 0, 125000)),
        ("20240105T1000", utc(2024, 1, 5, 15)),
        ("2024-07-05T10:00:00.000000[Europe/Berlin]", utc(2024, 7, 5, 8)),
        ("2024-07-05T10:00:00[Asia/Tokyo]", utc(2024, 7, 5, 1)),
        ("02/03/2024 10:15", utc(2024, 2, 3, 15, 15)),
        ("2/3/2024 12:15:09 AM", utc(2024, 2, 3, 5, 15, 9)),
        ("03.02.2024 10:15:00", utc(2024, 2, 3, 15, 15)),
        ("Jul 4, 2024 12:00:00 PM EDT", utc(2024, 7, 4, 16)),
        ("Nov 3, 2024 1:30:00 AM EST", utc(2024, 11, 3, 6, 30)),
        ("Nov 3, 2024 1:30:00 AM EDT", utc(2024, 11, 3, 5, 30)),
        ("1704448800", utc(2024, 1, 5, 10)),
        ("1704448800123", utc(2024, 1, 5, 10, 0, 0, 123000)),
        ("  2024-01-05 10:00:00 ", utc(2024, 1, 5, 15)),
        ("nonsense", None),
        ("", None),
        (None, None),
        ("2024-13-05 10:00:00", None),
        ("x" * 100_000, None),
    ]


def test_notations(spark):
    got = resolve_all(spark, [row(text) for text, _ in NOTATIONS])
    assert [(t[:50] if t else t, r.utc_us) for (t, _), r in zip(NOTATIONS, got)] == [(t[:50] if t else t, want) for t, want in NOTATIONS]


def test_day_first_zone_and_relative(spark):
    got = resolve_all(spark, [row("02/03/2024 10:15", "Europe/Berlin", True), row("02/03/2024 10:15", None), row("02/03/2024 10:15", "No/Zone"), row("90.5 min", origin=datetime(2024, 1, 1)), row("90.5 min")])
    assert [r.utc_us for r in got] == [utc(2024, 3, 2, 9, 15), utc(2024, 2, 3, 10, 15), None, utc(2024, 1, 1, 1, 30, 30), None]


def test_twice_and_never(spark):
    first, second = utc(2024, 11, 3, 5, 30), utc(2024, 11, 3, 6, 30)
    twice = "2024-11-03 01:30:00"
    got = resolve_all(spark, [row(twice), row(twice, expected=second + 1), row(twice, expected=first - 9), row(twice, expected=(first + second) // 2), row("2024-03-10 02:30:00")])
    assert [r.utc_us for r in got] == [first, second, first, first, utc(2024, 3, 10, 7, 30)]
    assert [r.clock for r in got] == ["two"] * 4 + ["none"]


def test_intervals_cover_every_local_time():
    rows = [r for r in local_intervals(["Australia/Adelaide"], 2021, 2023) if r[1] == 2022]
    zone = ZoneInfo("Australia/Adelaide")
    t = datetime(2022, 1, 1)
    while t < datetime(2023, 1, 1):
        us = int((t - datetime(1970, 1, 1)) / timedelta(microseconds=1))
        held = [r for r in rows if r[2] <= us < r[3]]
        offsets = {int(t.replace(tzinfo=zone, fold=f).utcoffset() / timedelta(microseconds=1)) for f in (0, 1)}
        exists = [o for o in offsets if datetime.fromtimestamp((us - o) / 1e6, zone).replace(tzinfo=None) == t]
        assert len(held) == max(1, len(exists)) and (held[0][6] == "none") == (not exists)
        if exists:
            assert {r[4] for r in held} == set(exists)
        t += timedelta(minutes=30)


def test_cohort_start_is_settled_by_the_end(spark):
    sites = spark.createDataFrame([("A", "America/New_York", False)], SITES)
    schema = "cohort_id bigint, encounter_id string, site_code string, anesthesia_start string, anesthesia_end string, anesthesia_duration_min double, clock_origin timestamp"
    rows = [(1, "e", "A", "2024-11-03 01:30:00", "2024-11-03 03:00:00", 90.0, None), (2, "f", "A", "2024-11-03 01:30:00", "2024-11-03 03:00:00", 150.0, None), (3, None, None, None, None, None, None)]
    got = {r.cohort_id: r.utc_us for r in cohort_instants(spark.createDataFrame(rows, schema), sites).collect()}
    assert got == {1: utc(2024, 11, 3, 6, 30), 2: utc(2024, 11, 3, 5, 30), 3: None}
    readings = spark.createDataFrame([(1, "f", "2024-11-03 01:40:00", 70.0, None), (2, "f", "2024-11-03 01:40:00", 10.0, None), (3, "none", "2024-11-03 01:40:00", None, None), (4, None, None, None, None)], "obs_id bigint, encounter_id string, observed_time string, minute_from_anesthesia_start double, loaded_at timestamp")
    zones = zone_table(sites)
    starts = cohort_instants(spark.createDataFrame(rows, schema), sites, zones)
    got = {r.obs_id: r.utc_us for r in reading_instants(readings, starts, zones).collect()}
    assert got == {1: utc(2024, 11, 3, 6, 40), 2: utc(2024, 11, 3, 5, 40), 3: utc(2024, 11, 3, 1, 40), 4: None}


def test_empty_and_whole_table(spark):
    from pulsegrid.sources.tables import table

    c, m, s = (table(spark, SMALL, n) for n in ("cohort", "map_observations", "sites"))
    assert restated_instants(c.limit(0), m.limit(0), s).count() == 0
    out = restated_instants(c, m.withColumn("zone", F.lit("x")).withColumn("_t", F.lit(1)), s)
    late = m.filter(F.col("observed_time").isNotNull() & ~F.col("observed_time").rlike("^.{10}T.{8}Z$")).count() + c.filter(F.col("anesthesia_start").isNotNull() & ~F.col("anesthesia_start").rlike("^.{10}T.{8}Z$")).count()
    assert out.count() == late == out.select("src_table", "row_id").distinct().count()
