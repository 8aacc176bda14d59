import gzip
import io
import tarfile
import zipfile
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from pulsegrid.functions import parse
from pulsegrid.operators import keyed
from pulsegrid.sources import archives


@pytest.fixture
def packed(tmp_path):
    rows = b'id,v,w\n1,"a,b",x\n2,,y\n'
    z = tmp_path / "a.zip"
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("in/vitals.csv.gz", gzip.compress(rows))
        f.writestr("in/ward_vitals.csv.gz", gzip.compress(rows))
    t = tmp_path / "b.tar"
    with tarfile.open(t, "w") as f:
        for k in range(3):
            info = tarfile.TarInfo(f"parts/p{k}.csv")
            info.size = len(rows)
            f.addfile(info, io.BytesIO(rows))
    return str(z), str(t)


def test_archives(spark, packed):
    z, t = packed
    member = archives.find_member(z, "vitals.csv.gz")
    got = archives.read_members(spark, [(z, member)], ["v", "id"]).collect()
    assert [(r.line_no, r.v, r.id) for r in got] == [(1, "a,b", "1"), (2, None, "2")]
    with pytest.raises(ValueError, match="0 members"):
        archives.find_member(z, "itals.csv.gz")
    assert archives.read_parts(spark, [t], ["id"], expected=3, suffix=".csv").count() == 6
    with pytest.raises(ValueError, match="3 parts instead of 19"):
        archives.read_parts(spark, t, ["id"], expected=19)
    with pytest.raises(Exception, match="lacks the columns nope"):
        archives.read_members(spark, [(z, member)], ["nope"]).collect()


def test_manifest_and_contract(spark, tmp_path):
    folder = tmp_path / "f"
    folder.mkdir()
    (folder / "a.txt").write_text("one")
    before = archives.file_manifest(spark, str(folder)).collect()
    assert before[0].relative_path == "a.txt" and before[0].sha256 == archives.fingerprint(str(folder / "a.txt"))["sha256"]
    old = spark.createDataFrame(before)
    (folder / "a.txt").write_text("two")
    (folder / "b.txt").write_text("x")
    assert {(r.relative_path, r.change) for r in archives.changed_files(old, archives.file_manifest(spark, str(folder))).collect()} == {("a.txt", "changed"), ("b.txt", "added")}
    out = str(tmp_path / "cache")
    assert archives.write_once(spark.range(3), out, {"v": "1"}).count() == 3
    assert archives.write_once(spark.range(9), out, {"v": "1"}).count() == 3
    with pytest.raises(ValueError, match="another contract"):
        archives.write_once(spark.range(9), out, {"v": "2"})


def test_keys(spark):
    df = spark.createDataFrame([("a", "p", 1, None), ("a", "p", 2, 5), ("b", "p", 3, 1), ("b", "q", 4, 1), (None, "p", 5, 1), ("c", None, 6, None), ("c", "r", 7, None)], "k string, v string, i int, x int")
    kept = keyed.drop_conflicts(df, "k", ["v"])
    assert {r.k for r in kept.collect()} == {"a", "c"}
    assert {(r.k, r.i) for r in keyed.most_complete(kept, "k", ["i"]).collect()} == {("a", 2), ("c", 7)}
    assert {(r.k, r.i) for r in keyed.first_per(df, "k", ["x", "i"]).collect()} == {("a", 2), ("b", 3), ("c", 6)}
    c = {r.field: r for r in keyed.coverage(df, ["k", "x"]).collect()}
    assert (c["k"].n, c["k"].n_present, c["k"].n_distinct, c["x"].n_present) == (7, 6, 3, 4)
    assert {r.side: r.n for r in keyed.key_audit(df.filter("k is not null"), df.filter("k in ('a')"), "k").collect()} == {"both": 1, "left_only": 2}
    assert {r.name: r.missing for r in keyed.referential(df.filter("k is not null"), {"x": df.filter("k = 'a'")}, "k").collect()} == {"x": 2}
    shuffled = df.orderBy(F.desc("i"))
    assert keyed.signature(df, ["k", "v"]).first() == keyed.signature(shuffled, ["k", "v"]).first()
    a = keyed.id_audit(spark.createDataFrame([("a",), ("a",), (" b",), ("NaN",), (None,)], "k string"), "k").first()
    assert (a.n, a.n_null, a.n_padded, a.n_placeholder, a.n_repeated) == (5, 1, 1, 1, 1)


def column(spark, values, f):
    return [r.x for r in spark.createDataFrame([(v,) for v in values], "v string").select(f(F.col("v")).alias("x")).collect()]


def test_parsing(spark):
    near = lambda got, want: all((a is None) == (b is None) and (a is None or abs(a - b) < 1e-3) for a, b in zip(got, want))
    assert near(column(spark, ["5' 10\"", "178 cm", "5' 7\"", "70", "1.7", "60 in", "x", None], parse.parse_height_m), [1.778, 1.78, 1.7018, 1.778, 1.7, 1.524, None, None])
    assert near(column(spark, ["2821.9176", "80 kg", "80", "2687.85", "80kg", "-4", None], parse.parse_weight_kg), [80.0, 80.0, None, 76.2, None, None, None])
    assert near(column(spark, ["80000"], lambda c: parse.parse_weight_kg(c, "g")), [80.0])
    with pytest.raises(ValueError):
        parse.parse_weight_kg(F.lit("1"), "lb")
    assert column(spark, ["72", " 72.5 mmHg", "120/80", "x", None], parse.single_numeric) == [72.0, 72.5, None, None, None]
    assert column(spark, ["m", " Female", "x", None], parse.norm_sex) == ["M", "F", None, None]
    assert column(spark, ["Yes", "1.0", "URGENT", None], parse.truthy) == [True, False, True, False]
    assert column(spark, ["1", "no", "TRUE", "2", None], parse.binary_parse) == [1.0, 0.0, 1.0, None, None]
    assert column(spark, ["A-line", "N.I.B.P.", "zz", None], parse.source_of_token) == ["ART", "NIBP", None, None]
    assert column(spark, ["Art Line MAP", "NIBP MAP", "MAP", "MAP goal"], parse.label_source) == ["ART", "NIBP", "DIRECT", "DIRECT"]
    assert column(spark, ["MAP", "MAP goal", "HR"], parse.is_map_label) == [True, False, False]
    assert column(spark, [" A-b  c!"], parse.field_norm) == ["a_b_c"]
    numbers = spark.createDataFrame([(1.005,), (-0.001,), (None,)], "v double").select(parse.fixed_number(F.col("v")).alias("x"))
    assert [r.x for r in numbers.collect()][1:] == ["0.00", "not estimable"]
    assert [r.x for r in spark.createDataFrame([(-800.0,), (0.0,), (800.0,)], "v double").select(parse.sigmoid(F.col("v")).alias("x")).collect()] == [0.0, 0.5, 1.0]
    with pytest.raises(ValueError, match="both sources"):
        parse.source_of_token(F.lit("x"), ("ART",), ("ART",))


def test_stream_of_cells(spark, tmp_path):
    from pulsegrid.streaming.grid import stream_cells

    t = datetime(2024, 1, 1)
    rows = [("a", t, t + timedelta(minutes=m), v, s) for m, v, s in [(0, 60.0, "ART"), (1, 50.0, "ART"), (5, 70.0, "ART"), (5.5, 80.0, "NIBP"), (6, 300.0, "ART")]]
    schema = "case_id string, start timestamp, at timestamp, map double, source string"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    stream = stream_cells(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("cells").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.time_min, r.map, r.source) for r in spark.table("cells").collect()) == [(5, 60, "ART"), (10, 80, "NIBP")]


def test_entry_points(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 60
    assert e.entry(spark).limit(1).count() == 1


def test_emergency_and_texts(spark):
    from pyspark.sql import functions as F

    from pulsegrid.functions import parse

    df = spark.createDataFrame([("Emergency dept", 12.345, 1.0, 1234, 2000), ("came by ED", -0.0001, None, 0, 0), ("edema clinic", float("inf"), 2.0, 1, 3), (None, None, None, None, None)], "c string, m double, s double, n int, of int")
    r = df.select(
        parse.emergency_flag(F.col("c")).alias("e"), parse.mean_sd_text(F.col("m"), F.col("s")).alias("a"), parse.n_percent_text(F.col("n"), F.col("of")).alias("b"), parse.estimate_text(F.col("m"), F.col("m"), F.col("m")).alias("d")
    ).collect()
    assert [x.e for x in r] == [True, True, False, False] and [x.b for x in r] == ["1,234 (61.7%)", "not estimable", "1 (33.3%)", "not estimable"]
    assert r[0].a == "12.3 (1.0)" and r[1].a == "0.0 (not estimable)" and [x.d for x in r] == ["12.345 (12.345 to 12.345)", "0.000 (0.000 to 0.000)", "not estimable", "not estimable"]


def test_contract_that_cannot_be_read_raises(spark, tmp_path):
    from pulsegrid.sources import archives

    out = f"{tmp_path}/kept"
    assert archives.write_once(spark.range(3), out, {"v": "1"}).count() == 3
    for f in tmp_path.glob("kept.contract/part-*"):
        f.write_text("{broken")
    for f in tmp_path.glob("kept.contract/.part-*"):
        f.unlink()
    with pytest.raises(ValueError):
        archives.write_once(spark.range(9), out, {"v": "1"})
