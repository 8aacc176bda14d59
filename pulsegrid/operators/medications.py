"""Recorded drug administrations around an index event: which agent, which action, when; strata and audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.operators.secondary import AGENTS, EXCLUDED, VASOPRESSOR
from pulsegrid.sources.tables import require_columns

COLUMNS = ["LOG_ID", "DISPLAY_NAME", "MEDICATION_NM", "MAR_ACTION_NM", "MED_ACTION_TIME", "MED_ROUTE_NM"]
# Routes and actions of a dose that was given into a vein, and classes of actions in the order they are tried.
ROUTE = r"(?i)intravenous|IV"
GIVEN = r"(?i)given|new bag|bolus|rate change|rate verify|restarted"
ACTIONS = (("rate_verify_only", r"(?i)rate verify"), ("rate_change", r"(?i)rate change"), ("new_or_bolus_administration", r"(?i)given|new bag|bolus|restarted"))
CONFIRMED = ("new_or_bolus_administration", "rate_change")


def _first(text: Column, options: tuple[tuple[str, str], ...], other: str) -> Column:
    out = F.lit(other)
    for name, pattern in reversed(options):
        out = F.when(text.rlike(pattern), name).otherwise(out)
    return out


def candidates(medications: DataFrame, cases: DataFrame) -> DataFrame:
    """Administrations of a drug that raises blood pressure into a vein, of the given cases (case_id, start timestamp, t0 minutes).

    case_id, agent, action, at, since_t0 (minutes; NULL where the time or the start can't be read). A text that names
    several agents has the first in a fixed order. NULL texts match nothing. Repeated rows come out each.
    """
    require_columns(medications, COLUMNS, "medications")
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    text = F.concat_ws(" ", blank("DISPLAY_NAME"), blank("MEDICATION_NM"))
    rows = medications.filter(text.rlike(VASOPRESSOR) & ~text.rlike(EXCLUDED) & blank("MED_ROUTE_NM").rlike(ROUTE) & blank("MAR_ACTION_NM").rlike(GIVEN))
    rows = rows.select(
        F.col("LOG_ID").cast("string").alias("_id"), _first(text, AGENTS, "unresolved_systemic_vasopressor").alias("agent"), _first(blank("MAR_ACTION_NM"), ACTIONS, "other_candidate_action").alias("action"),
        F.col("MED_ACTION_TIME").try_cast("timestamp").alias("at"),
    )
    own = cases.select("case_id", F.col("start").alias("_start"), F.col("t0").alias("_t0"))
    since = (F.unix_micros("at") - F.unix_micros("_start")) / 6e7 - F.col("_t0")
    return rows.join(own, F.col("_id") == F.col("case_id")).select("case_id", "agent", "action", "at", F.col("_start").alias("start"), since.alias("since_t0"))


def early(events: DataFrame, after: float = 5.0) -> DataFrame:
    """Those from the index event to ``after`` minutes later, both ends included."""
    return events.filter(F.col("since_t0").between(0, after))


def strata(cases: DataFrame, events: DataFrame) -> DataFrame:
    """case_id and stratum: a confirmed action, only a verified rate, or nothing recorded."""
    told = events.groupBy(F.col("case_id").alias("_id")).agg(F.max(F.col("action").isin(*CONFIRMED)).alias("_sure"), F.max(F.col("action") == "rate_verify_only").alias("_seen"))
    stratum = F.when(F.col("_sure"), "confirmed").when(F.col("_seen"), "rate_verify_only").otherwise("none_recorded")
    return cases.join(told, F.col("case_id") == F.col("_id"), "left").select(*cases.columns, stratum.alias("stratum"))


def stratum_counts(rows: DataFrame, least: int = 20) -> DataFrame:
    """stratum, n, events, estimable (``least`` events and as many others); ``rows`` has stratum and y."""
    a = rows.groupBy("stratum").agg(F.count("*").alias("n"), F.sum("y").cast("bigint").alias("events"))
    return a.withColumn("estimable", ((F.col("events") >= least) & (F.col("n") - F.col("events") >= least)).cast("int"))


def audit(events: DataFrame, by: str) -> DataFrame:
    """``by`` (action or agent), rows and distinct cases."""
    return events.groupBy(by).agg(F.count("*").alias("rows"), F.count_distinct("case_id").alias("cases"))


def mapping_audit(medications: DataFrame, found: DataFrame, within: DataFrame) -> DataFrame:
    """One row: rows scanned, candidates, those whose time or case start can't be read, early rows, confirmed rows and cases."""
    a = medications.agg(F.count("*").alias("rows_scanned"))
    b = found.agg(F.count("*").alias("candidates"), F.count_if(F.col("at").isNull()).alias("unreadable_times"), F.count_if(F.col("start").isNull()).alias("missing_starts"))
    sure = F.col("action").isin(*CONFIRMED)
    c = within.agg(F.count("*").alias("early_rows"), F.count_if(sure).alias("confirmed_rows"), F.count_distinct(F.when(sure, F.col("case_id"))).alias("confirmed_cases"))
    return a.crossJoin(b).crossJoin(c)  # one row each
