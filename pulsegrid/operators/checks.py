"""Checks of frames against contracts: each is one aggregate that names what it counted; none changes rows."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.functions.parse import logit

Checks = DataFrame  # name string, violations bigint, passed int


def check_rows(df: DataFrame, rules: dict[str, Column]) -> Checks:
    """name, violations, passed: how many rows break each rule; a rule that is NULL for a row is broken by it."""
    one = df.agg(*[F.count_if(~F.coalesce(rule, F.lit(False))).alias(f"c{k}") for k, rule in enumerate(rules.values())])
    return named(one, {name: F.col(f"c{k}") for k, name in enumerate(rules)})


def named(one: DataFrame, counts: dict[str, Column]) -> Checks:
    """A one-row frame of counts as one row per check."""
    each = F.array(*[F.struct(F.lit(n).alias("name"), F.coalesce(c, F.lit(0)).cast("bigint").alias("violations")) for n, c in counts.items()])
    return one.select(F.explode(each).alias("r")).select("r.*").withColumn("passed", (F.col("violations") == 0).cast("int"))


def require(checks: Checks, where: str) -> None:
    """Raises ValueError naming the checks that failed, with their counts."""
    bad = [f"{r['name']} ({r['violations']})" for r in checks.filter("passed = 0").limit(50).collect()]
    if bad:
        raise ValueError(f"{where}: {', '.join(bad)}")


def metric_input(df: DataFrame, y: str = "y", p: str = "p", weight: str | None = None, patient: str | None = None) -> Checks:
    """What metrics need: finite labels 0 or 1, finite scores in [0, 1], weights that are finite, not negative and not all 0, a patient."""
    v, q = F.col(y).cast("double"), F.col(p).cast("double")
    bad = lambda rule: F.count_if(~F.coalesce(rule, F.lit(False)))
    counts = {"y_is_0_or_1": bad(v.isin(0.0, 1.0)), "p_in_0_to_1": bad(q.between(0, 1) & ~F.isnan(q)), "some_rows": (F.count("*") == 0).cast("int")}
    if weight:
        w = F.col(weight).cast("double")
        counts |= {"w_finite_not_negative": bad((w >= 0) & (w < float("inf"))), "w_has_weight": (~F.coalesce(F.sum(F.when((w > 0) & (w < float("inf")), w)) > 0, F.lit(False))).cast("int")}
    if patient:
        counts["patient_present"] = F.count_if(F.col(patient).isNull())
    one = df.agg(*[c.alias(f"c{k}") for k, c in enumerate(counts.values())])
    return named(one, {n: F.col(f"c{k}") for k, n in enumerate(counts)})


def predictions(df: DataFrame, y: str = "y", p: str = "p") -> Checks:
    """As :func:`metric_input`, and both classes and a logit that varies (variance over 1e-12), which calibration needs."""
    v, q = F.col(y).cast("double"), F.col(p).cast("double")
    one = df.agg(F.count_if(v == 1).alias("a"), F.count_if(v == 0).alias("b"), F.var_pop(logit(q)).alias("v"))
    more = named(one, {"both_classes": ((F.col("a") == 0) | (F.col("b") == 0)).cast("int"), "logit_varies": (~F.coalesce(F.col("v") > 1e-12, F.lit(False))).cast("int")})
    return metric_input(df, y, p).unionByName(more)


def binary_columns(df: DataFrame, columns: list[str], nullable: bool = False) -> Checks:
    """Each column is exactly 0 or 1 (or NULL, where ``nullable``)."""
    return check_rows(df, {f"{c}_is_0_or_1": F.col(c).cast("double").isin(0.0, 1.0) | (F.col(c).isNull() if nullable else F.lit(False)) for c in columns})


def series(df: DataFrame, low: float = 20.0, high: float = 200.0, sources: tuple[str, ...] = ("ART", "NIBP")) -> Checks:
    """A gridded series: no NULL key, values in range, known sources, one row per case and time."""
    rows = check_rows(df, {"keys_present": F.col("case_id").isNotNull() & F.col("time_min").isNotNull(), "values_in_range": F.col("map").between(low, high) & ~F.isnan("map"), "sources_known": F.col("source").isin(*sources)})
    repeated = df.groupBy("case_id", "time_min").agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") > 1).alias("c"))
    return rows.unionByName(named(repeated, {"one_row_per_case_and_time": F.col("c")}))


def events(t0: DataFrame, after: float = 3.0, until: float = 30.0) -> Checks:
    """Index events: no NULL, within the search window, one row per case."""
    rows = check_rows(t0, {"keys_present": F.col("case_id").isNotNull() & F.col("t0").isNotNull(), "t0_in_search_window": (F.col("t0") > after) & (F.col("t0") <= until)})
    repeated = t0.groupBy("case_id").agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") > 1).alias("c"))
    return rows.unionByName(named(repeated, {"one_row_per_case": F.col("c")}))


def stage_join(everyone: DataFrame, second: DataFrame, key: str = "case_id", alert: str = "stage1_alert", label: str = "y") -> Checks:
    """A left join of all cases with those scored in the second stage: only first-stage alerts may lack a score, none of the scored
    may be unknown or an alert, labels must agree, and keys may not repeat."""
    a = everyone.select(F.col(key).alias("_k"), F.col(alert).alias("_alert"), F.col(label).alias("_y"))
    b = second.select(F.col(key).alias("_s"), F.col(label).alias("_z"))
    j = a.join(b, F.col("_k") == F.col("_s"), "full_outer")
    one = j.agg(
        F.count_if(F.col("_s").isNull() & ~F.coalesce(F.col("_alert") == 1, F.lit(False))).alias("a"), F.count_if(F.col("_k").isNull()).alias("b"),
        F.count_if(F.col("_s").isNotNull() & F.col("_k").isNotNull() & (F.col("_alert") == 1)).alias("c"), F.count_if(F.col("_s").isNotNull() & F.col("_k").isNotNull() & ~F.col("_y").eqNullSafe(F.col("_z"))).alias("d"),
        (F.count("_k") - F.count_distinct("_k") + F.count("_s") - F.count_distinct("_s")).alias("e"),
    )
    return named(one, {"unscored_without_alert": F.col("a"), "scored_but_unknown": F.col("b"), "scored_alerts": F.col("c"), "labels_differ": F.col("d"), "repeated_keys": F.col("e")})


def interval_order(df: DataFrame) -> Checks:
    """For every pair of columns named alike but for lower and upper: rows whose lower end lies above the upper one."""
    pairs = [(c, c.replace("lower", "upper")) for c in df.columns if "lower" in c and c.replace("lower", "upper") in df.columns]
    if not pairs:
        return df.sparkSession.createDataFrame([], "name string, violations bigint, passed int")
    return check_rows(df, {f"{a}_not_above_{b}": F.col(a).isNull() | F.col(b).isNull() | (F.col(a) <= F.col(b)) for a, b in pairs})


def replicate_gate(intervals: DataFrame, keys: list[str], requested: int, share: float = 0.95, alerts: DataFrame | None = None) -> DataFrame:
    """keys, metric, n_valid, valid_share, exempt, passed: whether enough replicates of each estimate were defined.

    Exempt are PPV and alerts per true positive of a threshold that has no alert at all in the sample (``alerts``: keys and ``alerts``),
    where no replicate can define them.
    """
    out = intervals.withColumn("valid_share", F.col("n_valid") / F.lit(float(requested)))
    exempt = F.lit(False)
    if alerts is not None:
        told = alerts.select(*[F.col(k).alias(f"_k{j}") for j, k in enumerate(keys)], F.col("alerts").alias("_alerts"))
        out = out.join(told, reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_k{j}")) for j, k in enumerate(keys)]), "left")
        exempt = F.coalesce(F.col("_alerts") == 0, F.lit(False)) & F.col("metric").isin("ppv", "alerts_per_tp", "false_alerts_per_tp")
    return out.select(*keys, "metric", "n_valid", "valid_share", exempt.cast("int").alias("exempt"), (exempt | (F.col("valid_share") >= share)).cast("int").alias("passed"))


def thresholds(df: DataFrame, forbidden: tuple[float, ...] = (), capacity_from: str = "development") -> Checks:
    """Named thresholds (name, threshold, kind, source): unique names, inside (0, 1), none of the forbidden values, and those of kind
    capacity taken from the stated source only."""
    t = F.col("threshold")
    rows = check_rows(df, {
        "inside_0_to_1": (t > 0) & (t < 1), "not_forbidden": ~t.isin(*forbidden) if forbidden else F.lit(True),
        "capacity_from_its_source": (F.col("kind") != "capacity") | (F.col("source") == capacity_from),
    })
    return rows.unionByName(named(df.agg((F.count("*") - F.count_distinct("name")).alias("c")), {"names_unique": F.col("c")}))


# Names of fields that identify a person or a stay.
IDENTIFIERS = ("patient_id", "case_id", "encounter_id", "subject_id", "op_id", "log_id", "mrn", "birth_date", "patient_name", "medical_record_number")


def normal_name(name: str) -> str:
    return re.sub(r"[^a-z0-9]+", "_", name.lower()).strip("_")


def identifying_columns(frames: dict[str, DataFrame]) -> list[tuple[str, str]]:
    """(frame, column path) of columns, nested ones as well, whose name is an identifier's. Only schemas are read."""

    def walk(prefix: str, kind) -> list[str]:
        out = []
        for f in getattr(kind, "fields", []):
            path = f"{prefix}.{f.name}" if prefix else f.name
            out += [path] if normal_name(f.name) in IDENTIFIERS else []
            inner = f.dataType
            while hasattr(inner, "elementType"):
                inner = inner.elementType
            out += walk(path, inner) + (walk(path, inner.valueType) if hasattr(inner, "valueType") else [])
        return out

    return [(name, path) for name, df in frames.items() for path in walk("", df.schema)]


def identifying_text(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, rows: how many texts hold an identifier's name as a key (``mrn: 1``, ``"case_id"=``); 0 for the others."""
    key = r"(?i)(^|[^a-z0-9_])(" + "|".join(x.replace("_", "[ _-]?") for x in IDENTIFIERS) + r")[\"']?\s*[:=]"
    one = df.agg(*[F.count_if(F.col(c).rlike(key)).alias(f"c{k}") for k, c in enumerate(columns)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"c{k}").alias("rows")) for k, c in enumerate(columns)])).alias("r")).select("r.*")


def lineage(spark: SparkSession, outputs: dict[str, list[str]], manifest: DataFrame) -> DataFrame:
    """output, source, size_bytes, sha256: the stated sources of each output with their fingerprints from a manifest; NULL where it has none."""
    stated = spark.createDataFrame([(o, s) for o, sources in outputs.items() for s in sources], "output string, source string")
    return stated.join(manifest.select(F.col("relative_path").alias("source"), "size_bytes", "sha256"), "source", "left").select("output", "source", "size_bytes", "sha256")


def expected_names(df: DataFrame, column: str, expected: list[str]) -> DataFrame:
    """name, state (present, missing, unexpected, repeated) of an inventory against the names it must have."""
    want = df.sparkSession.createDataFrame([(e,) for e in expected], "name string")
    have = df.groupBy(F.col(column).alias("_name")).agg(F.count("*").alias("_n"))
    state = F.when(F.col("_name").isNull(), "missing").when(F.col("name").isNull(), "unexpected").when(F.col("_n") > 1, "repeated").otherwise("present")
    return want.join(have, F.col("name") == F.col("_name"), "full_outer").select(F.coalesce("name", "_name").alias("name"), state.alias("state"))
