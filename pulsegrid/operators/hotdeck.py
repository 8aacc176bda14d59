"""Problem 3: missing values filled from similar records by sequential hot-deck, in SQL windows."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.session import checkpointed
from pulsegrid.sources.tables import require_columns


@dataclass(frozen=True)
class Field:
    """A numeric field and the range in which a number is a measurement at all."""

    name: str
    low: float
    high: float
    whole: bool = False


LANDMARK_FIELDS = (Field("bmi", 10, 80), Field("asa", 1, 5, True), Field("pre10_last_map", 20, 200))


def is_missing(field: Field) -> Column:
    """NULL, NaN or no measurement."""
    v = F.col(field.name).cast("double")
    return v.isNull() | F.isnan(v) | (v < field.low) | (v > field.high)


def _text(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("?"))


def hot_deck(
    df: DataFrame,
    fields: tuple[Field, ...] = LANDMARK_FIELDS,
    *,
    id_col: str = "feature_id",
    group_cols: tuple[str, ...] = ("surgical_service", "site_code"),
    class_col: str = "male",
    size_col: str = "age",
    day_col: str = "case_day",
) -> DataFrame:
    """One row per record and field that is missing: the value filled in, where it comes from and how far off the donor is.

    Records are sorted within their group (service and site) and class (sex) by age, then day, then id. A missing value takes
    that of the nearest observed record before or after it in this order: nearest by years of age plus years of time between
    them, the one before if both are as near. If the group's class has no donor, the service's class is sorted in the same way
    (level 2), else all records (level 3). NULL or NaN in a group, class or age column is a value
    of its own, sorted first; a NULL day is sorted first within its age. A field without any observed value stays NULL at level
    0. Repeated rows are records of their own and may be donors of each other.

    Columns: id, field_name, value, donor_id, distance (in years), level. A donor is never itself a filled value, so the result
    doesn't depend on the order of filling.

    A group may hold a third of all rows, so none is sorted in one task: windows run within blocks of equal age and month, and
    only the first and last donor of each block are carried between blocks in a second window over one row a block. The coarser
    levels are run only over records that are still without a donor, beside the donors of the blocks these lie in.
    """
    require_columns(df, [id_col, *group_cols, class_col, size_col, day_col, *(f.name for f in fields)], "hot_deck")
    age = F.col(size_col).cast("double")
    age = F.when(age.isNull() | F.isnan(age), -1.0).otherwise(age)
    day = F.coalesce(F.datediff(F.to_date(F.col(day_col)), F.lit("1970-01-01").cast("date")), F.lit(-100000))
    # Months of the calendar rise with the day, whole years with the age: blocks follow one another in the sorting order.
    long = df.select(
        F.col(id_col).alias("id"),
        *[_text(c).alias(f"g{k}") for k, c in enumerate(group_cols)],
        _text(class_col).alias("cls"),
        age.alias("age"),
        day.alias("day"),
        F.floor(age * 4).cast("int").alias("age_block"),
        F.explode(F.array(*[F.struct(F.lit(f.name).alias("field_name"), F.when(~is_missing(f), F.col(f.name).cast("double")).alias("v")) for f in fields])).alias("x"),
    ).select("*", "x.field_name", "x.v").drop("x")
    # Within a quarter of a year of age the order is by block of days first, which keeps blocks contiguous.
    long = long.withColumn("day_block", F.floor(F.col("day") / 30).cast("int"))
    point = F.struct(F.col("age_block"), F.col("day_block"), F.col("age"), F.col("day"), F.col("id"), F.col("v"))
    long = long.withColumn("donor", F.when(F.col("v").isNotNull(), point))
    groups = [f"g{k}" for k in range(len(group_cols))]
    levels = [["field_name", *groups, "cls"], ["field_name", *groups[:1], "cls"], ["field_name"]]
    found, open_ = [], None
    for level, by in enumerate(levels, 1):
        rows = long if open_ is None else open_.unionByName(_beside(long, open_, by))
        # Only missing values are written, once: what has no donor yet goes on to the next level.
        tried = checkpointed(_neighbours(rows, long, by))
        found.append(tried.filter("before is not null or after is not null").withColumn("level", F.lit(level)))
        rest = tried.filter("before is null and after is null")
        open_ = rest.select(*long.columns)
        if rest.isEmpty():
            break
    else:
        found.append(rest.withColumn("level", F.lit(0)))
    out = reduce(DataFrame.unionByName, found)
    away = lambda c: F.abs(F.col(f"{c}.age") - F.col("age")) + F.abs(F.col(f"{c}.day") - F.col("day")) / F.lit(365.25)
    out = out.withColumn("to_before", away("before")).withColumn("to_after", away("after"))
    use_before = F.col("after").isNull() | (F.col("before").isNotNull() & (F.col("to_before") <= F.col("to_after")))
    return out.withColumn("chosen", F.when(use_before, F.col("before")).otherwise(F.col("after"))).select(
        F.col("id").alias(id_col),
        "field_name",
        F.col("chosen.v").alias("value"),
        F.col("chosen.id").alias("donor_id"),
        F.when(use_before, F.col("to_before")).otherwise(F.col("to_after")).alias("distance"),
        "level",
    )


BLOCK = ["age_block", "day_block"]


def _beside(long: DataFrame, open_: DataFrame, by: list[str]) -> DataFrame:
    """The donors in the blocks of ``open_``."""
    return long.filter("donor is not null").join(open_.select(*by, *BLOCK).distinct(), [*by, *BLOCK], "left_semi").select(*long.columns)


def _neighbours(rows: DataFrame, all_rows: DataFrame, by: list[str]) -> DataFrame:
    """The missing rows of ``rows`` with the donors just before and after them within ``by``.

    ``rows`` has all donors of the blocks of its missing rows; donors of other blocks come from the first and last of each
    block of ``all_rows``.
    """
    order = f"over (partition by {', '.join(by)} order by age_block, day_block)"
    blocks = all_rows.groupBy(*by, *BLOCK).agg(F.min("donor").alias("first"), F.max("donor").alias("last"))
    carried = blocks.select(*by, *BLOCK, F.expr(f"lag(last) ignore nulls {order}").alias("p"), F.expr(f"lead(first) ignore nulls {order}").alias("n"))
    inner = f"over (partition by {', '.join(by)}, age_block, day_block order by age, day, id)"
    within = rows.withColumn("p0", F.expr(f"lag(donor) ignore nulls {inner}")).withColumn("n0", F.expr(f"lead(donor) ignore nulls {inner}")).filter("donor is null")
    return within.join(carried, [*by, *BLOCK], "left").select(*rows.columns, F.coalesce("p0", "p").alias("before"), F.coalesce("n0", "n").alias("after"))


def marked(fills: DataFrame, fields: tuple[Field, ...] = LANDMARK_FIELDS) -> DataFrame:
    """The rows of :func:`hot_deck` that hold: filled by a donor's measurement, or without any donor at all."""
    inside = F.lit(False)
    for f in fields:
        inside = inside | ((F.col("field_name") == f.name) & F.col("value").between(f.low, f.high))
    return fills.filter(F.when(F.col("level") > 0, inside & F.col("donor_id").isNotNull()).otherwise(F.col("value").isNull()))


def filled_records(df: DataFrame, fills: DataFrame, fields: tuple[Field, ...] = LANDMARK_FIELDS, id_col: str = "feature_id") -> DataFrame:
    """``df`` with the fields filled and a mark ``<field>_filled`` for each."""
    wide = fills.groupBy(F.col(id_col).alias("_id")).agg(
        *[F.max(F.when(F.col("field_name") == f.name, F.col("value"))).alias(f"_v_{f.name}") for f in fields],
        *[F.max(F.when(F.col("field_name") == f.name, F.lit(True))).alias(f"_m_{f.name}") for f in fields],
    )
    joined = df.join(wide, F.col(id_col) == F.col("_id"), "left")
    marks = {f"{f.name}_filled": F.coalesce(F.col(f"_m_{f.name}"), F.lit(False)) for f in fields}
    values = {f.name: F.when(F.col(f"_m_{f.name}"), F.col(f"_v_{f.name}")).otherwise(F.col(f.name).cast("double")) for f in fields}
    return joined.withColumns(marks).withColumns(values).select(*df.columns, *marks)
