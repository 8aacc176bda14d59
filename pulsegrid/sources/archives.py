"""Delimited members of ZIP and TAR archives as Spark tables, and fingerprints of files."""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import os
import tarfile
import uuid
import zipfile
from collections.abc import Iterator
from functools import reduce
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def members(path: str) -> list[str]:
    if zipfile.is_zipfile(path):
        with zipfile.ZipFile(path) as z:
            return [n for n in z.namelist() if not n.endswith("/")]
    with tarfile.open(path) as t:
        return [m.name for m in t if m.isfile()]


def find_member(path: str, wanted: str) -> str:
    """The one member whose base name is ``wanted`` (``a_x.csv`` isn't ``x.csv``); none or several raise ValueError."""
    found = [m for m in members(path) if os.path.basename(m) == wanted]
    if len(found) != 1:
        raise ValueError(f"{path} has {len(found)} members named {wanted}, not one")
    return found[0]


class _Forward(io.RawIOBase):
    """Bytes of a stream that can only be read on."""

    def __init__(self, raw):
        self.raw = raw

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        got = self.raw.read(len(into))
        into[: len(got)] = got
        return len(got)


def _open(path: str, member: str) -> io.TextIOWrapper:
    """A member as text. A TAR is read forwards only, from a plain stream, so that it needs no seeking (a pipe or object store will do)."""
    if zipfile.is_zipfile(path):
        raw = zipfile.ZipFile(path).open(member)
    else:
        tar = tarfile.open(fileobj=open(path, "rb"), mode="r|*")  # noqa: SIM115 - closed with the member
        raw = next((tar.extractfile(m) for m in tar if m.name == member), None)
        if raw is None:
            raise ValueError(f"{path} lacks {member}")
        raw = io.BufferedReader(_Forward(raw), 1 << 20)
    return io.TextIOWrapper(gzip.GzipFile(fileobj=raw) if member.endswith(".gz") else raw, encoding="utf-8", newline="")


def read_members(spark: SparkSession, parts: list[tuple[str, str]], columns: list[str], rows_per_batch: int = 50_000) -> DataFrame:
    """``columns`` of CSV members as text, with ``part`` and ``line_no``: one task per (archive, member), read as a stream.

    An archive can't be split, so each member is one task that holds one batch at a time; repeated scans should read a
    Parquet copy. Paths must be readable by every executor. Missing columns raise ValueError; empty texts are NULL.
    """
    schema = "part string, line_no bigint, " + ", ".join(f"`{c}` string" for c in columns)
    if not parts:
        return spark.createDataFrame([], schema)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, member in zip(frame["path"], frame["member"]):
                at = 1
                with _open(path, member) as text:
                    for chunk in pd.read_csv(text, dtype=str, keep_default_na=False, na_values=[""], chunksize=rows_per_batch):
                        lacking = [c for c in columns if c not in chunk.columns]
                        if lacking:
                            raise ValueError(f"{member} lacks the columns {', '.join(lacking)}")
                        out = chunk[columns].reset_index(drop=True)
                        out.insert(0, "line_no", range(at, at + len(out)))
                        out.insert(0, "part", member)
                        at += len(out)
                        yield out

    listed = spark.createDataFrame(parts, "path string, member string").repartition(len(parts), "path", "member")
    return listed.mapInPandas(run, schema)


def read_parts(spark: SparkSession, paths: list[str] | str, columns: list[str], expected: int | None = None, suffix: str = ".csv") -> DataFrame:
    """All members ending with ``suffix`` of one or more archives; a number other than ``expected`` raises ValueError."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    if not paths:
        raise ValueError("no archive given")
    parts = [(p, m) for p in paths for m in members(p) if m.endswith((suffix, suffix + ".gz"))]
    if expected is not None and len(parts) != expected:
        raise ValueError(f"{len(parts)} parts instead of {expected}")
    return read_members(spark, parts, columns)


def fingerprint(path: str) -> dict[str, object]:
    """Name, size and SHA-256 of a file, read in blocks."""
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while block := f.read(1 << 20):
            h.update(block)
    return {"name": os.path.basename(path), "size_bytes": Path(path).stat().st_size, "sha256": h.hexdigest()}


def file_manifest(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """relative_path, size_bytes, sha256 of the files of a folder, hashed by the executors; for files that fit in memory."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    root = os.path.abspath(folder).rstrip("/") + "/"
    return files.select(F.regexp_replace(F.regexp_replace("path", "^file:/*", "/"), f"^{root}", "").alias("relative_path"), F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"))


def changed_files(before: DataFrame, after: DataFrame) -> DataFrame:
    """relative_path and change (added, removed, changed) between two manifests."""
    a, b = before.select("relative_path", F.col("sha256").alias("_a")), after.select("relative_path", F.col("sha256").alias("_b"))
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(F.col("_a") != F.col("_b"), "changed")
    return a.join(b, "relative_path", "full_outer").select("relative_path", change.alias("change")).filter("change is not null")


def _held_contract(spark: SparkSession, note: str) -> dict | None:
    """The contract written at ``note``, or None where nothing is; a note that can't be read raises."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(note)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(path):
        return None
    row = spark.read.text(note, wholetext=True).first()
    if row is None:
        raise ValueError(f"{note} is empty")
    return json.loads(row[0])


def write_once(df: DataFrame, folder: str, contract: dict[str, str]) -> DataFrame:
    """``df`` as Parquet in ``folder``, or what lies there if it was written under the same contract; another contract raises ValueError.

    The contract (fingerprints of sources and settings) is stored beside the data and written last, so an unfinished write is redone:
    each write goes to a folder of its own below ``folder``, whose name the note holds, and a folder that a note names is never
    overwritten. A note that can't be read raises.
    """
    spark = df.sparkSession
    note = f"{folder.rstrip('/')}.contract"
    held = _held_contract(spark, note)
    if held is not None and held["contract"] != contract:
        raise ValueError(f"{folder} was written under another contract")
    if held is None:
        held = {"contract": contract, "data": f"{folder.rstrip('/')}/{uuid.uuid4().hex}"}
        df.write.mode("error").parquet(held["data"])
        spark.createDataFrame([(json.dumps(held, sort_keys=True),)], "value string").coalesce(1).write.mode("error").text(note)
    return spark.read.parquet(held["data"])


def write_shards(shards: dict[str, DataFrame], folder: str, contract: dict[str, str]) -> DataFrame:
    """All shards as one table with ``shard``: each is written once under the contract and its name, so an interrupted run goes on where it
    stopped. What lies there already is read again and held against the rows and the order-free hash of its values that were noted
    when it was written; a difference raises ValueError.
    """
    parts = []
    for name, df in shards.items():
        safe = "".join(c if c.isalnum() or c in "-_." else "_" for c in name)
        if not safe.strip("."):
            raise ValueError(f"{name!r} is no name of a shard")
        got = write_once(df, f"{folder.rstrip('/')}/{safe}", {**contract, "shard": name})
        note = f"{folder.rstrip('/')}/{safe}.sums"
        text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in got.columns])
        now = got.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("bigint")), F.lit(0)).alias("h")).first()
        sums = {"rows": int(now["n"]), "hash": int(now["h"])}
        held = _held_contract(df.sparkSession, note)
        if held is None:
            df.sparkSession.createDataFrame([(json.dumps(sums, sort_keys=True),)], "value string").coalesce(1).write.mode("error").text(note)
        elif held != sums:
            raise ValueError(f"the shard {name} isn't what was written")
        parts.append(got.withColumn("shard", F.lit(name)))
    if not parts:
        raise ValueError("no shards")
    return reduce(DataFrame.unionByName, parts)


def collect_parts(rows: DataFrame, kept: DataFrame, part: str = "part") -> DataFrame:
    """part, raw_rows, retained_rows, retained_pct: what each part delivered and what is left of it; parts with nothing left count 0."""
    a = rows.groupBy(part).agg(F.count("*").alias("raw_rows"))
    b = kept.groupBy(F.col(part).alias("_of_kept")).agg(F.count("*").alias("_kept"))
    n = F.coalesce(F.col("_kept"), F.lit(0))
    return a.join(b, F.col(part).eqNullSafe(F.col("_of_kept")), "left").select(part, "raw_rows", n.cast("bigint").alias("retained_rows"), F.round(100 * F.try_divide(n, F.col("raw_rows")), 6).alias("retained_pct"))
