"""Reading the Parquet tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table ``name`` of ``folder``; columns and filters chosen later reach the Parquet scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def require_columns(df: DataFrame, names: list[str], where: str) -> None:
    """Raises ValueError naming every column of ``names`` that ``df`` lacks."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"{where} lacks the columns {', '.join(missing)}")


def spare_name(df: DataFrame, stem: str) -> str:
    """A column name starting with ``stem`` that ``df`` doesn't have, so that extra columns never clash."""
    taken, name = {c.lower() for c in df.columns}, stem
    while name.lower() in taken:
        name = "_" + name
    return name
