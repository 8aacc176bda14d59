import csv
import io
import random

import numpy as np
import pytest

from pulsegrid.operators.rejects import FLOWSHEET_FIELDS, parse_records
from pulsegrid.sources.csv_states import CLASS_OF, NEXT, START, Tokens, starts, states_before, transitions

GOOD = "E1,P1,MAP,Mean,value,2024-01-02 03:04:05,72,mmHg"


def tokens_of(lines, chunk=None):
    data = [x.encode() for x in lines]
    return Tokens(np.frombuffer(b"".join(data), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in data])]).astype(np.int64), chunk)


def parse(spark, lines, **kw):
    df = spark.createDataFrame([(k, x) for k, x in enumerate(lines)], "line_id bigint, raw_line string")
    return {r.line_id: r for r in parse_records(df, "raw_line", **kw).collect()}


def test_states_do_not_depend_on_chunks():
    rng = random.Random(5)
    text = "".join(rng.choice('ab",\n') for _ in range(700)).encode()
    classes = CLASS_OF[np.frombuffer(text, np.uint8)]
    state, want = START, []
    for c in classes:
        want.append(state)
        state = NEXT[c, state]
    for chunk in (1, 3, 64, 699, 10_000):
        assert states_before(classes, chunk).tolist() == want
    # The states at the borders follow from the transitions of the chunks alone.
    chunks = classes.reshape(7, 100)
    assert starts(transitions(chunks)).tolist() == [want[k * 100] for k in range(7)]


def test_fields_agree_with_a_csv_reader():
    rng = random.Random(1)
    lines = []
    for _ in range(300):
        out = io.StringIO()
        csv.writer(out, lineterminator="").writerow(["".join(rng.choice('xy",\n\ré ') for _ in range(rng.randrange(6))) + "z" for _ in range(8)])
        lines.append(out.getvalue())
    for chunk in (None, 7):
        t = tokens_of(lines, chunk)
        assert not t.bad.any() and (t.columns == 8).all()
        content, ends = t.fields(np.ones(len(lines), bool), 8)
        got = [bytes(content[a:b]).decode() for a, b in zip(ends[:-1], ends[1:])]
        assert got == [f for line in lines for f in next(csv.reader(io.StringIO(line, newline="")))]


REASONS = [
        (GOOD, None, None),
        ('E1,P1,"a ""b"" c",Mean,value,2024-01-02T03:04:05.25+05:30,"120/80",', None, None),
        ('E1,P1,"two\r\nlines",Mean,value,2/29/2024 3:04 AM, +7.5 mm Hg ,x', None, None),
        ('E1,P1,a "b" c,Mean,value,2024-01-02 03:04:05,72,mmHg', "quoting", 8),
        ('E1,P1,"a"b,Mean,value,2024-01-02 03:04:05,72,mmHg', "quoting", 9),
        ('E1,P1,"a,Mean,value,2024-01-02 03:04:05,72,mmHg', "quoting", 6),
        ("E1,P1\nE2", "quoting", 5),
        (GOOD + ",", "column_count", 0),
        ("E1;P1;a", "column_count", 0),
        ("E1,P1,a,b,value,never,72x,", "meas_value", -1),
        ("E1,P1,a,b,value,2024-01-02 03:04:05,120/80/60,", "meas_value", -1),
        ("E1,P1,a,b,value,2024-01-02 03:04:05,,", "meas_value", -1),
        ("E1,P1,a,b,value,2023-02-29 03:04:05,72,", "recorded_time", -1),
        ("E1,P1,a,b,value,2024-01-02 24:04:05,72,", "recorded_time", -1),
        ("E1,P1,a,b,value,13/1/2024 3:04 AM,72,", "recorded_time", -1),
        ("E1,P1,a,b,value,1/1/2024 13:04 AM,72,", "recorded_time", -1),
    ]


def test_reasons(spark):
    got = parse(spark, [line for line, *_ in REASONS])
    assert [(got[k].reason, got[k].error_offset) for k in range(len(REASONS))] == [(reason, offset) for _, reason, offset in REASONS]
    assert [got[k].kind for k in range(len(REASONS))] == ["reject" if reason else "row" for _, reason, _ in REASONS]


def test_edges(spark):
    long = "x" * 300_000
    got = parse(spark, [None, "", "  \t", ",".join(FLOWSHEET_FIELDS), GOOD, GOOD, GOOD + "\r\n", GOOD.replace("Mean", f'"{long}, ""q"""')])
    assert [got[k].kind for k in range(8)] == ["blank", "blank", "blank", "header", "row", "row", "row", "row"]
    assert got[6].units == "mmHg" and got[4].meas_number == 72.0 and str(got[4].recorded_at) == "2024-01-02 03:04:05"
    assert got[7].flo_display_name == f'{long}, "q"'


def test_empty_table_and_clashing_names(spark):
    assert parse_records(spark.createDataFrame([], "raw_line string"), "raw_line").count() == 0
    df = spark.createDataFrame([(1, "x", "y", GOOD)], "line_id int, reason string, UNITS string, raw_line string")
    row = parse_records(df, "raw_line").first().asDict()
    assert row["reason"] is None and row["reason_in"] == "x" and row["UNITS_in"] == "y" and row["units"] == "mmHg"


def test_missing_column_is_named(spark):
    with pytest.raises(ValueError, match="raw_line"):
        parse_records(spark.range(1), "raw_line")
