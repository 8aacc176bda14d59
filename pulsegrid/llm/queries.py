"""Queries of this subpackage, with SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm import leakage, names, packing, repetition
from pulsegrid.sources.tables import table


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    reference = table(spark, folder, "label_reference")
    a = names.map_names(table(spark, folder, "flowsheet"), reference, "flo_name", "flow_id", "flo_name", "flo_display_name")
    readings = table(spark, folder, "map_observations").filter(F.col("map_source").isNotNull())
    b = names.map_names(readings, reference, "map_source", "obs_id", "map_source")
    return a.select(F.lit("flowsheet").alias("src_table"), "row_id", "ref_id").unionByName(b.select(F.lit("map_observations").alias("src_table"), "row_id", "ref_id"))


def p8_packed(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), table(spark, folder, "pack_capacities"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return leakage.find_leaks(table(spark, folder, "documents"), table(spark, folder, "eval_items")).filter("kind = 'verbatim'").select("doc_id", "item_id")


def p9_kinds(spark: SparkSession, folder: str) -> DataFrame:
    """With the items that documents carry under other numbers, names or units."""
    return leakage.find_leaks(table(spark, folder, "documents"), table(spark, folder, "eval_items"))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return repetition.measure(table(spark, folder, "documents"), everything=False).filter("mostly_repeated").select("doc_id")


def p10_shares(spark: SparkSession, folder: str) -> DataFrame:
    return repetition.measure(table(spark, folder, "documents")).select("doc_id", "n_words", F.round("repeated_share", 6).alias("repeated_share"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p7_found, p8_packed, p9_found, p9_kinds, p10_found, p10_shares)}

_SHARES = r"""
with w as (select doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') as w from documents),
g as (select doc_id, unnest(range(1, len(w) - 4)) as i, w from w where len(w) >= 6),
k as (select doc_id, i, hash(list_slice(w, i, i + 5)) as h from g),
again as (select doc_id, i from k qualify row_number() over (partition by doc_id, h order by i) > 1),
covered as (select doc_id, count(distinct i + o) as n from again, (select unnest(range(0, 6)) as o) group by 1),
shares as (select w.doc_id, len(w.w) as n_words, coalesce(c.n, 0) / greatest(len(w.w), 1)::double as share from w left join covered c using (doc_id))
"""

SQL: dict[str, str] = {
    "p10_found": _SHARES + "select doc_id from shares where share >= 0.3",
    "p10_shares": _SHARES + "select doc_id, cast(n_words as int) as n_words, round(share, 6) as repeated_share from shares",
}
