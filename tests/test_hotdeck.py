from pulsegrid.operators.hotdeck import Field, filled_records, hot_deck

SCHEMA = "feature_id bigint, surgical_service string, site_code string, male double, age double, case_day date, bmi double, asa double, pre10_last_map double"


def rows(spark, data):
    from datetime import date

    return spark.createDataFrame([(i, s, c, m, a, date.fromisoformat(d) if d else None, *v) for i, s, c, m, a, d, *v in data], SCHEMA)


def fills(df, **kw):
    return {(r.feature_id, r.field_name): r for r in hot_deck(df, **kw).collect()}


def test_nearest_donor_on_either_side(spark):
    df = rows(spark, [
        (1, "u", "A", 1.0, 50.0, "2024-01-01", 20.0, 2.0, 70.0),
        (2, "u", "A", 1.0, 51.0, "2024-01-01", None, 9.0, 999.0),
        (3, "u", "A", 1.0, 51.5, "2024-01-01", 30.0, 3.0, 80.0),
        (4, "u", "A", 0.0, 51.0, "2024-01-01", 55.0, 4.0, 90.0),
    ])
    f = fills(df)
    assert set(f) == {(2, "bmi"), (2, "asa"), (2, "pre10_last_map")}
    assert (f[2, "bmi"].value, f[2, "bmi"].donor_id, f[2, "bmi"].level) == (30.0, 3, 1) and abs(f[2, "bmi"].distance - 0.5) < 1e-9


def test_ties_take_the_one_before_and_donors_cross_blocks(spark):
    df = rows(spark, [(1, "u", "A", 1.0, 30.0, "2024-01-01", 20.0, 1.0, 70.0), (2, "u", "A", 1.0, 40.0, "2024-01-01", None, 1.0, 70.0), (3, "u", "A", 1.0, 50.0, "2024-01-01", 30.0, 1.0, 70.0)])
    assert fills(df)[2, "bmi"].donor_id == 1


def test_levels(spark):
    df = rows(spark, [
        (1, "u", "A", 1.0, 30.0, "2024-01-01", None, 1.0, 70.0),
        (2, "u", "B", 1.0, 60.0, "2024-01-01", 33.0, 1.0, 70.0),
        (3, "v", "A", 0.0, 30.0, "2024-01-01", None, None, 70.0),
        (4, None, None, None, None, None, float("nan"), 5.0, 20.0),
    ])
    f = fills(df)
    assert (f[1, "bmi"].level, f[1, "bmi"].value) == (2, 33.0)
    assert (f[3, "bmi"].level, f[3, "bmi"].value) == (3, 33.0) and f[3, "asa"].level == 3
    assert f[4, "bmi"].level == 3 and (4, "asa") not in f and (4, "pre10_last_map") not in f


def test_nothing_observed_and_empty(spark):
    df = rows(spark, [(1, "u", "A", 1.0, 30.0, "2024-01-01", None, 1.0, 70.0)])
    assert (fills(df)[1, "bmi"].value, fills(df)[1, "bmi"].level) == (None, 0)
    assert hot_deck(df.limit(0)).count() == 0


def test_marks_and_clashing_columns(spark):
    from pyspark.sql import functions as F

    df = rows(spark, [(1, "u", "A", 1.0, 30.0, "2024-01-01", None, 1.0, 70.0), (2, "u", "A", 1.0, 30.0, "2024-01-01", 25.0, 1.0, 70.0)])
    df = df.withColumn("donor", F.lit("x")).withColumn("v", F.lit(1)).withColumn("field_name", F.lit("?"))
    out = {r.feature_id: r for r in filled_records(df, hot_deck(df)).collect()}
    assert out[1].bmi == 25.0 and out[1].bmi_filled and not out[2].bmi_filled and out[1].donor == "x"


def test_agrees_with_a_sequential_pass(spark):
    import random

    rng = random.Random(2)
    data = [(i, "u", "A", 1.0, float(rng.randrange(20, 80)), f"2024-0{rng.randrange(1, 7)}-1{rng.randrange(10)}", rng.choice([None, 20.0 + i]), 2.0, 70.0) for i in range(120)]
    from datetime import date

    f = fills(rows(spark, data), fields=(Field("bmi", 10, 800),))
    import math

    def key(r):
        d = (date.fromisoformat(r[5]) - date(1970, 1, 1)).days
        return (math.floor(r[4] * 4), d // 30, r[4], d, r[0])

    order = sorted(data, key=key)
    for k, r in enumerate(order):
        if r[6] is None:
            def away(o):
                return abs(o[4] - r[4]) + abs((date.fromisoformat(o[5]) - date.fromisoformat(r[5])).days) / 365.25

            before = next((o for o in reversed(order[:k]) if o[6] is not None), None)
            after = next((o for o in order[k + 1 :] if o[6] is not None), None)
            want = before if after is None or (before is not None and away(before) <= away(after)) else after
            assert f[r[0], "bmi"].donor_id == want[0]


def test_found_rows_come_through_the_windows(spark):
    """p3_found's rows depend on the donors: a fill that is no measurement, or none where a donor exists, isn't marked."""
    from pulsegrid.operators.hotdeck import marked

    df = spark.createDataFrame([(1, "bmi", 25.0, 7, 0.1, 1), (2, "bmi", 5.0, 7, 0.1, 1), (3, "asa", None, None, None, 0), (4, "asa", None, None, None, 1)], "feature_id int, field_name string, value double, donor_id int, distance double, level int")
    assert {r.feature_id for r in marked(df).collect()} == {1, 3}
