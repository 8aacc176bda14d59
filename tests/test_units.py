import itertools

import numpy as np
from pyspark.sql import functions as F

from pulsegrid.functions.changepoints import segments
from pulsegrid.operators.units import cohort_sizes, foreign_units, reading_units

COHORT = "cohort_id bigint, site_code string, height_m string, weight_kg string, measure_note string, loaded_at timestamp"
SITES = "site_code string, default_height_unit string, default_weight_unit string"
ALL = [("I", "in", "oz"), ("C", "cm", "kg"), ("M", "m", "lb")]
READ = "obs_id bigint, dataset string, encounter_id string, map_source string, minute_from_anesthesia_start double, map_value double, raw_unit string, raw_display_name string, loaded_at timestamp"


def sizes(spark, rows):
    from datetime import datetime

    df = spark.createDataFrame([(k, *r, datetime(2024, 1, 1)) for k, r in enumerate(rows)], COHORT)
    return {(r.row_id, r.quantity): (r.unit_code, r.unit_from, None if r.value is None else round(r.value, 4)) for r in cohort_sizes(df, spark.createDataFrame(ALL, SITES)).collect()}


def test_segments_are_optimal():
    rng = np.random.default_rng(1)
    for _ in range(15):
        x = np.round(rng.normal(0, 1, 9) + 4 * (np.arange(9) > rng.integers(0, 9)), 2)
        best = min(
            (sum(((x[a:b] - x[a:b].mean()) ** 2).sum() for a, b in zip((0, *c), (*c, 9))) + 0.5 * len(c))
            for r in range(9) for c in itertools.combinations(range(1, 9), r)
        )
        cuts = [*segments(x, 0.5).tolist(), 9]
        assert abs(sum(((x[a:b] - x[a:b].mean()) ** 2).sum() for a, b in zip(cuts[:-1], cuts[1:])) + 0.5 * (len(cuts) - 2) - best) < 1e-9
    assert len(segments(np.empty(0), 1.0)) == 0


HEIGHTS = [
        ("181.8cm", "cm", 1.818), ("cm 170", "cm", 1.7), ("170 Centimetres", "cm", 1.7), ("1,503 metres", "m", 1.503), ("1.7 M", "m", 1.7), ("1700mm", "mm", 1.7),
        ("5' 10\"", "ft_in", 1.778), ("5′ 10″", "ft_in", 1.778), ("5'7", "ft_in", 1.7018), ("5 feet 7", "ft_in", 1.7018), ("5ft 7in", "ft_in", 1.7018), ("67 inch", "in", 1.7018), ("67.0 IN.", "in", 1.7018), ("67in", "in", 1.7018), ("tall", None, None),
    ]
WEIGHTS = [("kg 79,0", "kg", 79.0), ("178lb", "lb", 80.7394), ("178.0 lbs", "lb", 80.7394), ("2747oz", "oz", 77.8761), ("100,861 g", "g", 100.861), ("80000gm", "g", 80.0), ("11st 0lb", "st_lb", 69.8532), ("12 stone 6", "st_lb", 78.9251), ("80 KG", "kg", 80.0)]


def test_heights_and_weights(spark):
    got = sizes(spark, [("C", t, None, None) for t, *_ in HEIGHTS] + [("C", None, t, None) for t, *_ in WEIGHTS])
    n = len(HEIGHTS)
    assert [(t, got[k, "height"][0], got[k, "height"][2]) for k, (t, *_) in enumerate(HEIGHTS)] == HEIGHTS
    assert [(t, got[n + k, "weight"][0], got[n + k, "weight"][2]) for k, (t, *_) in enumerate(WEIGHTS)] == WEIGHTS


def test_notes_and_defaults(spark):
    got = sizes(spark, [
        ("C", "68", None, "height given in inches; wt in lbs"), ("C", None, "150", "wt in lbs"), ("C", None, "80", "lost 9 lb since spring per family"),
        ("I", "67.5", "2800", None), ("I", "1.7", "80", None), ("I", "172", None, "cuff 26 cm size"), ("C", "1,72", None, None), ("M", "61", "170", None), (None, "1.6", "70", None), ("C", "170", "80", "Stature is in CM here"),
    ])
    assert got[0, "height"][:2] == ("in", "note") and got[1, "weight"][:2] == ("lb", "note") and got[2, "weight"][:2] == ("kg", "history")
    assert got[3, "height"][0] == "in" and got[3, "weight"][0] == "oz"
    assert got[4, "height"][0] == "m" and got[4, "weight"][0] == "kg" and got[5, "height"][0] == "cm"
    assert got[6, "height"] == ("m", "history", 1.72) and got[7, "height"][0] == "in" and got[7, "weight"][0] == "lb"
    assert got[8, "height"][0] == "m" and got[9, "height"] == ("cm", "note", 1.7)


def test_a_default_that_fits_holds_next_to_a_shift(spark):
    rows = [("C", str(v), None, None) for v in [170, 168, 1.71, 1.69, 175, 66, 180]]
    got = sizes(spark, rows)
    assert [got[k, "height"][0] for k in range(7)] == ["cm", "cm", "m", "m", "cm", "in", "cm"]


def test_readings(spark):
    from datetime import datetime

    at = datetime(2024, 1, 1)
    rows, k = [], 0
    for e, unit, shown, level in [("a", None, "x", 80.0), ("b", None, "x", 10.5), ("c", "CMH2O", "x", 110.0), ("d", None, "Cuff MAP, hPa", 106.0), ("e", "kPa", "x", 10.0), ("f", "mm[Hg]", "x", 12.0)]:
        for j in range(9):
            rows.append((k, "D", e, "ART", float(j), level + j / 10, unit, shown, at))
            k += 1
    rows += [(k, "D", "e", "ART", 20.0, 11.0, None, None, at), (k + 1, "D", "e", None, 20.0, 70.0, None, None, None), (k + 2, "D", None, None, None, None, None, None, None), (k + 3, "D", "a", "ART", 3.0, -5.0, None, None, at), (k + 4, "D", "z", "ART", 3.0, 0.0, None, None, at)]
    df = spark.createDataFrame(rows, READ)
    got = {r.obs_id: r for r in reading_units(df).collect()}
    assert len(got) == k + 4
    assert [got[j * 9].unit_code for j in range(6)] == ["mmhg", "kpa", "cmh2o", "hpa", "kpa", "mmhg"]
    assert got[k].unit_code == "kpa" and got[k + 1].unit_code == "mmhg" and got[k + 3].unit_code == "mmhg" and got[k + 4].unit_code == "mmhg"
    assert abs(got[9].value_mmhg - 10.5 * 7.50061683) < 1e-9


def test_empty_and_clashing(spark):
    c, r, s = spark.createDataFrame([], COHORT), spark.createDataFrame([], READ), spark.createDataFrame(ALL, SITES)
    assert foreign_units(c, r, s).count() == 0
    wide = c.withColumn("text", F.lit(1)).withColumn("unit_code", F.lit(2)).withColumn("default_height_unit", F.lit("x"))
    assert foreign_units(wide, r.withColumn("u", F.lit(1)).withColumn("stated", F.lit(1)), s).count() == 0


BARE_ROWS = "row_id bigint, source string, at timestamp, level double, default_unit string"


def planted(spark, n=400, at_value=200):
    """Bare weights of one site in kg, from ``at_value`` on in pounds: each is an adult's size in both units."""
    from datetime import datetime, timedelta

    rng = np.random.default_rng(4)
    rows = [(k, "C", datetime(2024, 1, 1) + timedelta(hours=k), round(float(rng.normal(78, 6) * (1 / 0.45359237 if k >= at_value else 1)), 1), "kg") for k in range(n)]
    return spark.createDataFrame(rows, BARE_ROWS)


def test_a_lasting_shift_by_a_known_factor_changes_the_unit(spark):
    """Where the range rule can't tell, the segments do: without them (each value by itself) every value would stay in kg."""
    from pulsegrid.operators import units

    df = planted(spark)
    got = {r.row_id: r.unit_code for r in units.bare_units(df, "weight").collect()}
    assert [got[k] for k in range(400)] == ["kg"] * 200 + ["lb"] * 200
    apart = df.withColumn("source", F.col("row_id").cast("string"))
    assert {r.unit_code for r in units.bare_units(apart, "weight").collect()} == {"kg"}


def test_segments_depend_on_neither_partitions_nor_batches(spark):
    from pulsegrid.operators import units

    df, seen = planted(spark).unionByName(planted(spark).withColumn("row_id", F.col("row_id") + 1000).withColumn("source", F.lit("D"))), set()
    keys = ("spark.sql.shuffle.partitions", "spark.sql.execution.arrow.maxRecordsPerBatch")
    before = {k: spark.conf.get(k) for k in keys}
    try:
        for partitions, batch in (("2", "10000"), ("2", "50"), ("64", "10000"), ("64", "50")):
            spark.conf.set(keys[0], partitions)
            spark.conf.set(keys[1], batch)
            seen.add(tuple(sorted((r.row_id, r.unit_code, round(r.segment_level, 9)) for r in units.bare_units(df, "weight").collect())))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(seen) == 1 and len(next(iter(seen))) == 800
