from pulsegrid.operators.regular_grid import empty_cells, fill_grid

SPAN = "encounter_id string, anesthesia_duration_min double"
READ = "encounter_id string, minute_from_anesthesia_start double, map_value double"


def grid(spark, spans, reads, **kw):
    out = fill_grid(spark.createDataFrame(spans, SPAN), spark.createDataFrame(reads, READ), **kw).collect()
    return {(r.encounter_id, r.time_min): r for r in out}


def test_cells_are_right_closed_and_filled_by_time(spark):
    g = grid(spark, [("a", 29.0)], [("a", 5.0, 60.0), ("a", 5.5, 80.0), ("a", 8.0, 90.0), ("a", 18.0, 70.0)])
    assert sorted(g) == [("a", t) for t in (5, 10, 15, 20, 25)]
    assert g["a", 5].value == 60 and g["a", 10].value == 85 and g["a", 10].n_readings == 2
    assert g["a", 15].status == "filled" and abs(g["a", 15].value - (90 - 20 * 7 / 10)) < 1e-9
    assert (g["a", 25].status, g["a", 25].value) == ("edge", None)


def test_a_gap_beyond_the_limit_is_marked(spark):
    g = grid(spark, [("a", 40.0)], [("a", 3.0, 60.0), ("a", 38.0, 80.0)])
    assert {g["a", t].status for t in range(10, 40, 5)} == {"gap"}
    assert grid(spark, [("a", 40.0)], [("a", 3.0, 60.0), ("a", 38.0, 80.0)], gap_limit_min=35.0)["a", 20].status == "filled"


def test_readings_outside_the_span_are_neighbours_only(spark):
    g = grid(spark, [("a", 10.0)], [("a", -2.0, 60.0), ("a", 7.0, 80.0), ("a", 11.0, 1.0)])
    assert sorted(g) == [("a", 5), ("a", 10)] and g["a", 5].status == "filled"


def test_edges(spark):
    nan = float("nan")
    g = grid(
        spark,
        [("a", 12.0), ("a", 12.0), ("b", None), (None, 20.0), ("c", 4.0), ("d", 10.0), ("n", nan)],
        [("a", 1.0, 50.0), ("a", 1.0, 50.0), ("a", None, 9.0), ("a", 7.0, None), ("a", 8.0, nan), (None, 1.0, 1.0), ("z", 1.0, 1.0)],
    )
    assert sorted(g) == [("a", 5), ("a", 10), ("d", 5), ("d", 10)]
    assert g["a", 5].n_readings == 2 and g["a", 10].status == "edge" and g["d", 5].status == "edge"


def test_empty_tables_and_extra_columns(spark):
    assert fill_grid(spark.createDataFrame([], SPAN), spark.createDataFrame([], READ)).count() == 0
    spans = spark.createDataFrame([("a", 5.0, "x", 1)], SPAN + ", cell string, k int")
    reads = spark.createDataFrame([("a", 2.0, 60.0, "x", 3)], READ + ", prev string, on_grid int")
    assert empty_cells(fill_grid(spans, reads)).count() == 0


def test_agrees_with_brute_force(spark):
    import random

    rng = random.Random(3)
    reads = [("a", round(rng.uniform(0, 200), 1), float(rng.randrange(40, 120))) for _ in range(35)]
    g = grid(spark, [("a", 200.0)], reads)
    for (_, t), row in g.items():
        inside = [v for _, m, v in reads if t - 5 < m <= t]
        before = max(((m, v) for _, m, v in reads if m <= t - 5), default=None)
        after = min(((m, -v) for _, m, v in reads if m > t), default=None)
        if inside:
            assert abs(row.value - sum(inside) / len(inside)) < 1e-9
        elif before is None or after is None:
            assert row.status == "edge"
        else:
            assert row.status == ("filled" if after[0] - before[0] <= 15 else "gap")
