"""Rows of an entity: conflicts, most complete row, first row, coverage, keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def drop_conflicts(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Without every row of a key under which one of ``columns`` has more than one non-NULL value. NULL keys are dropped.

    The conflicting keys come from a partial aggregate and an anti join, so no key's rows gather in one task.
    """
    spread = df.filter(F.col(key).isNotNull()).groupBy(key).agg(*[(F.min(c) != F.max(c)).alias(f"_{k}") for k, c in enumerate(columns)])
    bad = spread.filter(reduce(Column.__or__, [F.coalesce(F.col(f"_{k}"), F.lit(False)) for k in range(len(columns))])).select(key)
    return df.filter(F.col(key).isNotNull()).join(bad, key, "left_anti")


def most_complete(df: DataFrame, key: str, tie: list[str]) -> DataFrame:
    """The row with the most non-NULL columns of each key; among equals the first by ``tie``. NULL keys are dropped."""
    filled = reduce(Column.__add__, [F.when(F.col(c).isNotNull(), 1).otherwise(0) for c in df.columns])
    w = Window.partitionBy(key).orderBy(filled.desc(), *[F.col(t).asc_nulls_last() for t in tie])
    return df.filter(F.col(key).isNotNull()).withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")


def first_per(df: DataFrame, entity: str, order: list[str]) -> DataFrame:
    """The first row of each entity by ``order`` (NULLs last; end it with a unique key). Spark limits ranks before the shuffle."""
    w = Window.partitionBy(entity).orderBy(*[F.col(o).asc_nulls_last() for o in order])
    return df.filter(F.col(entity).isNotNull()).withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")


def coverage(df: DataFrame, columns: list[str]) -> DataFrame:
    """field, n, n_present, present_pct, n_distinct of each column, from one aggregate."""
    one = df.agg(F.count("*").alias("n"), *[F.count(c).alias(f"p_{c}") for c in columns], *[F.count_distinct(c).alias(f"d_{c}") for c in columns])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col("n"), F.col(f"p_{c}").alias("n_present"), F.col(f"d_{c}").alias("n_distinct")) for c in columns]))
    return one.select(rows.alias("r")).select("r.field", "r.n", "r.n_present", F.round(100 * F.try_divide(F.col("r.n_present"), F.col("r.n")), 6).alias("present_pct"), "r.n_distinct")


def missingness(df: DataFrame, columns: list[str], scope: str) -> DataFrame:
    """scope, feature, n, missing_n, missing_pct, structurally_missing (no value at all)."""
    one = df.agg(F.count("*").alias("n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("missing_n")) for c in columns]))
    return one.select("n", rows.alias("r")).select(
        F.lit(scope).alias("scope"), "r.feature", "n", "r.missing_n", F.round(100 * F.try_divide(F.col("r.missing_n"), F.col("n")), 6).alias("missing_pct"), (F.col("r.missing_n") == F.col("n")).cast("int").alias("structurally_missing")
    )


def id_audit(df: DataFrame, column: str) -> DataFrame:
    """One row: n, nulls, padded or empty, placeholder texts, repeated ids."""
    t = F.col(column).cast("string")
    return df.agg(
        F.count("*").alias("n"), F.count_if(t.isNull()).alias("n_null"), F.count_if((t != F.trim(t)) | (t == "")).alias("n_padded"),
        F.count_if(F.lower(F.trim(t)).isin("nan", "none", "null", "<na>", "nat")).alias("n_placeholder"), (F.count(t) - F.count_distinct(t)).alias("n_repeated"),
    )


def referential(df: DataFrame, others: dict[str, DataFrame], key: str) -> DataFrame:
    """name, missing: how many keys of ``df`` each other table lacks."""
    parts = [df.select(key).distinct().join(o.select(key).distinct(), key, "left_anti").agg(F.count("*").alias("missing")).select(F.lit(name).alias("name"), "missing") for name, o in others.items()]
    return reduce(DataFrame.unionByName, parts)


def key_audit(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """side, n: keys on both sides and on one only."""
    left, right = a.select(key).distinct().withColumn("_a", F.lit(1)), b.select(key).distinct().withColumn("_b", F.lit(1))
    side = F.when(F.col("_a").isNull(), "right_only").when(F.col("_b").isNull(), "left_only").otherwise("both")
    return left.join(right, key, "full_outer").groupBy(side.alias("side")).agg(F.count("*").alias("n"))


def signature(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: an order-free signature of the rows' keys, as the count and two sums of 64-bit hashes."""
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    short = lambda at: F.conv(F.substring(F.sha2(text, 256), at, 8), 16, 10).cast("bigint")
    return df.agg(F.count("*").alias("n"), F.sum(short(1)).alias("sum_a"), F.sum(short(9)).alias("sum_b"))
