"""Queries of the checks, performance tables, sensitivity analyses and reports, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.operators import checks, grid, keyed, landmark, map_rows, metrics, models, performance, rejects, reports, resample, score, secondary
from pulsegrid.plans import prep
from pulsegrid.plans import reference as ref
from pulsegrid.plans.reference import CLINICAL, REPLICATES, Query, _round, rounded
from pulsegrid.session import checkpointed
from pulsegrid.sources import archives
from pulsegrid.sources.tables import table

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
query = ref.keeper(QUERIES, SQL)


def first_scored(spark: SparkSession, folder: str) -> DataFrame:
    """The first fully evaluable case of each patient in the second stage, with the frozen score; written once."""
    return checkpointed(score.score(ref._first(spark, folder).filter("stage2 = 1").withColumn("y", F.col("outcome"))))


_LINEAR = f"1 / (1 + exp(-({ref._linear()})))"
_MAIN = f"{ref._FIRST}, main as (select *, outcome as y, {_LINEAR} as p from first_of where stage2 = 1)"
_BUNDLE = """by_p as (select model, p, sum(w * y)::double as pos, sum(w * (1 - y))::double as neg from rated group by all),
runs as (select *, sum(neg) over (partition by model order by p) - neg / 2 as below, sum(pos) over (partition by model order by p desc) as tp, sum(neg) over (partition by model order by p desc) as fp from by_p),
disc as (select model, sum(pos * below) / nullif(sum(pos) * sum(neg), 0) as auroc, sum(pos * tp / (tp + fp)) / nullif(sum(pos), 0) as auprc from runs group by 1),
overall as (select model, count(*) as n, sum(y)::bigint as events, sum(w * (y - p) * (y - p)) / sum(w) as brier, 1 - sum(w * (y - p) * (y - p)) / sum(w) / nullif(sum(w * y) / sum(w) * (1 - sum(w * y) / sum(w)), 0) as scaled_brier,
  sum(-w * (y * ln(greatest(least(p, 1 - 1e-12), 1e-12)) + (1 - y) * ln(1 - greatest(least(p, 1 - 1e-12), 1e-12)))) / sum(w) as log_loss, sum(w * y) / sum(w * p) as oe_ratio from rated group by 1),
bundle as (select * from overall join disc using (model))"""
_RATED = "rated as (select model, y, p, 1.0 as w from models)"


# --- checks


@query(f"""with {ref._MODELS} select 'y_is_0_or_1' as name, count(*) filter (where coalesce(y not in (0, 1), true)) as violations, (count(*) filter (where coalesce(y not in (0, 1), true)) = 0)::int as passed from models
    union all select 'p_in_0_to_1', count(*) filter (where coalesce(p not between 0 and 1, true)), (count(*) filter (where coalesce(p not between 0 and 1, true)) = 0)::int from models
    union all select 'some_rows', (count(*) = 0)::bigint, (count(*) > 0)::int from models union all select 'patient_present', count(*) filter (where patient_id is null), (count(*) filter (where patient_id is null) = 0)::int from models""")
def metric_input(spark: SparkSession, folder: str) -> DataFrame:
    return checks.metric_input(ref.models(spark, folder), patient="patient_id")


_V = lambda name, n, source: f"select '{name}' as name, cast({n} as bigint) as violations, (({n}) = 0)::int as passed from {source}"


@query(f"""with {_MAIN} {_V("y_is_0_or_1", "count(*) filter (where coalesce(y not in (0, 1), true))", "main")} union all {_V("p_in_0_to_1", "count(*) filter (where coalesce(p not between 0 and 1, true))", "main")}
    union all {_V("some_rows", "(count(*) = 0)::int", "main")} union all {_V("both_classes", "(count(*) filter (where y = 1) = 0 or count(*) filter (where y = 0) = 0)::int", "main")} union all {_V("logit_varies", "(not coalesce(var_pop(ln(p) - ln(1 - p)) > 1e-12, false))::int", "main")}""")
def check_predictions(spark: SparkSession, folder: str) -> DataFrame:
    return checks.predictions(first_scored(spark, folder))


@query(f"""with {ref._H5}, rep as (select count(*) as c from (select case_id, time_min from h5 group by all having count(*) > 1)) {_V("keys_present", "count(*) filter (where case_id is null or time_min is null)", "h5")}
    union all {_V("values_in_range", "count(*) filter (where map not between 20 and 200)", "h5")} union all {_V("sources_known", "count(*) filter (where source not in ('ART', 'NIBP'))", "h5")} union all {_V("one_row_per_case_and_time", "max(c)", "rep")}""")
def series_check(spark: SparkSession, folder: str) -> DataFrame:
    return checks.series(ref.h5(spark, folder))


@query(f"""with {ref._H5}, {ref._t0_sql("ev", "h5")} {_V("keys_present", "count(*) filter (where case_id is null or t0 is null)", "ev")} union all {_V("t0_in_search_window", "count(*) filter (where not (t0 > 3 and t0 <= 30))", "ev")}
    union all {_V("one_row_per_case", "count(*) - count(distinct case_id)", "ev")}""")
def check_t0(spark: SparkSession, folder: str) -> DataFrame:
    return checks.events(landmark.find_t0(ref.h5(spark, folder)))


@query(f"""with {_MAIN}, j as (select f.case_id as k, f.stage1_alert as a, f.outcome as y, m.case_id as s, m.y as z from first_of f full join main m on f.case_id = m.case_id) {_V("unscored_without_alert", "count(*) filter (where s is null and not coalesce(a = 1, false))", "j")}
    union all {_V("scored_but_unknown", "count(*) filter (where k is null)", "j")} union all {_V("scored_alerts", "count(*) filter (where s is not null and k is not null and a = 1)", "j")}
    union all {_V("labels_differ", "count(*) filter (where s is not null and k is not null and y is distinct from z)", "j")} union all {_V("repeated_keys", "count(k) - count(distinct k) + count(s) - count(distinct s)", "j")}""")
def two_stage_join(spark: SparkSession, folder: str) -> DataFrame:
    return checks.stage_join(checkpointed(ref._first(spark, folder).withColumn("y", F.col("outcome"))), first_scored(spark, folder))


_SCANNED = ("cohort", "map_observations", "landmark_features", "flowsheet", "documents")


@query(f"select table_name as frame, column_name as \"column\" from information_schema.columns where table_name in {_SCANNED} and lower(column_name) in {checks.IDENTIFIERS}")
def privacy_scan(spark: SparkSession, folder: str) -> DataFrame:
    return spark.createDataFrame(checks.identifying_columns({n: table(spark, folder, n) for n in _SCANNED}), "frame string, column string")


@query(prep._LINES + """, parts as (select part_file as part, count(*) as raw_rows from flowsheet_lines group by 1), kept as (select part_file as part, count(*) as k from flowsheet_lines join judged using (line_id) where reason is null group by 1)
    select p.part, raw_rows, coalesce(k, 0) as retained_rows, round(100.0 * coalesce(k, 0) / raw_rows, 6) as retained_pct from parts p left join kept on p.part is not distinct from kept.part""")
def collect_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Rows each part file delivered and how many of them load."""
    lines = table(spark, folder, "flowsheet_lines").select("line_id", F.col("part_file").alias("part"), "raw_line")
    parsed = rejects.parse_records(lines, "raw_line")
    return archives.collect_parts(lines, rejects.loaded(parsed))


_ONE = "printf('%.1f', round({0}, 1))"


@query(f"""select cohort_id, round(case when try_cast(weight_kg as double) between 20 and 400 then try_cast(weight_kg as double) end, 6) as weight_plain, case when emergency is null then null when emergency then 1.0 else 0.0 end as emergency_number,
    coalesce(regexp_matches(surgical_service, '(?i)emergency|urgent|\\bed\\b'), false)::int as emergency_class, coalesce({_ONE.format("age")}, 'not estimable') as age_text, coalesce({_ONE.format("age")}, 'not estimable') || ' (' || coalesce({_ONE.format("asa")}, 'not estimable') || ')' as mean_sd_text,
    case when age > 0 then format('{{:,}}', cast(asa * 1000 as bigint)) || ' (' || {_ONE.format("100 * asa * 1000 / age")} || '%)' else 'not estimable' end as n_percent_text,
    case when age is not null and asa is not null then printf('%.3f', round(age, 3)) || ' (' || printf('%.3f', round(asa, 3)) || ' to ' || printf('%.3f', round(age, 3)) || ')' else 'not estimable' end as estimate_text from cohort""".replace("\\\\b", "\\b"))
def scalar_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Plain numbers and flags of texts, and numbers as they are printed."""
    age, asa = F.col("age"), F.col("asa")
    rows = table(spark, folder, "cohort").select(
        "cohort_id", ref.parse.weight_kg_plain(F.col("weight_kg")).alias("weight_plain"), ref.parse.binary_parse(F.col("emergency")).alias("emergency_number"), ref.parse.emergency_flag(F.col("surgical_service")).cast("int").alias("emergency_class"), ref.parse.fixed_number(age, 1).alias("age_text"),
        ref.parse.mean_sd_text(age, asa).alias("mean_sd_text"), F.when(asa.isNotNull() | ~F.coalesce(age > 0, F.lit(False)), ref.parse.n_percent_text(asa * 1000, age)).alias("n_percent_text"), ref.parse.estimate_text(age, asa, age).alias("estimate_text"),
    )
    return rounded(rows)


# --- readings of a source


_RELATIVE = """win as (select encounter_id, struct_extract(min({'a': anesthesia_duration_min, 'b': patient_id}), 'a') as d, struct_extract(min({'a': anesthesia_duration_min, 'b': patient_id}), 'b') as patient from cohort where encounter_id is not null and anesthesia_duration_min is not null group by 1)"""


@query(f"""with {_RELATIVE} select o.obs_id, patient as patient_id, o.minute_from_anesthesia_start, o.map_value, case when lower(trim(map_source)) = 'art' then 'ART' else 'NIBP' end as map_source
    from map_observations o join win using (encounter_id) where lower(trim(map_source)) in ('art', 'nibp') and map_value between 20 and 200 and minute_from_anesthesia_start between 0 and d""")
def norm_relative(spark: SparkSession, folder: str) -> DataFrame:
    """Readings of the two devices on the relative clock, in range and within their case's time, both ends included."""
    rows = table(spark, folder, "map_observations").select("obs_id", F.col("encounter_id").alias("op_id"), F.col("minute_from_anesthesia_start").alias("chart_time"), F.concat(F.lower(F.trim("map_source")), F.lit("_mbp")).alias("item_name"), F.col("map_value").alias("value"))
    cases = table(spark, folder, "cohort").filter("anesthesia_duration_min is not null").select("encounter_id", "patient_id", F.lit(0.0).alias("start"), F.col("anesthesia_duration_min").cast("double").alias("end"))
    return map_rows.from_vitals(rows, cases, keep=("obs_id",)).select("obs_id", "patient_id", "minute_from_anesthesia_start", "map_value", "map_source")


@query(prep._CLOCKS + """, win as (select encounter_id, min({'s': us, 'e': us + cast(anesthesia_duration_min as bigint) * 60000000, 'p': patient_id}) as c from starts join cohort using (cohort_id) where encounter_id is not null and us is not null and anesthesia_duration_min is not null group by 1),
    rows as (select *, epoch_us(try_strptime(recorded_time, '%Y-%m-%d %H:%M:%S')) as seen, try_cast(nullif(regexp_extract(meas_value, '""" + ref.parse.SINGLE_NUMBER + "', 1), '') as double) as v from flowsheet where regexp_matches(" + ref._LABEL + ", '" + ref.parse.MAP_LABEL + "') and not regexp_matches(" + ref._LABEL + ", '" + ref.parse.SUMMARY_LABEL + """'))
    select flow_id, c.p as patient_id, round((seen - c.s) / 6e7, 6) as minute_from_anesthesia_start, v as map_value, case when regexp_matches(""" + ref._LABEL + ", '" + ref.parse.ART_LABEL + "') then 'ART' when regexp_matches(" + ref._LABEL + ", '" + ref.parse.NIBP_LABEL + """') then 'NIBP' else 'DIRECT' end as map_source
    from rows join win on log_id = encounter_id where v between 20 and 200 and seen between c.s and c.e""")
def norm_flowsheet(spark: SparkSession, folder: str) -> DataFrame:
    """Mean pressures of the flowsheet within their case's time, whose start comes from texts of every notation."""
    return rounded(map_rows.from_flowsheet(table(spark, folder, "flowsheet"), ref.timed_cases(spark, folder)).select("flow_id", "patient_id", "minute_from_anesthesia_start", "map_value", "map_source"))


# --- performance


@query(f"with {ref._MODELS}, {_RATED}, {_BUNDLE} select model, n, events, {_round('auroc auprc brier scaled_brier log_loss')} from bundle")
def metric_bundle(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(performance.metric_bundle(checkpointed(ref.models(spark, folder)), ["model"]))


_POINT = ["auroc", "auprc", "brier", "scaled_brier", "log_loss", "oe_ratio", "citl", "citl_se", "intercept", "slope", "slope_se", "ici", "event_rate", "auprc_over_event_rate"]
_POINT_SQL = f"""{_RATED}, {_BUNDLE}, {ref._newton_sql("models")}, q as (select model, list_sort(list_distinct(quantile_cont(p, [0, .1, .2, .3, .4, .5, .6, .7, .8, .9, 1]))) as edges from models group by 1),
  binned as (select m.*, len(list_filter(list_slice(edges, 2, len(edges) - 1), lambda e: e <= p)) as bin from models m join q using (model)), icis as (select model, avg(abs(rate - p)) as ici from (select *, avg(y) over (partition by model, bin) as rate from binned) group by 1),
  point as (select b.*, c as citl, 1 / sqrt(hc) as citl_se, a as intercept, w.b as slope, sqrt(h00 / (h00 * h11 - h01 * h01)) as slope_se, ici, events / n as event_rate, auprc / (events / n) as auprc_over_event_rate from bundle b join newton w using (model) join icis using (model))"""


@query(f"with recursive {ref._MODELS}, {_POINT_SQL} select model, n, events, {_round(' '.join(_POINT))} from point")
def point_performance(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(performance.point_performance(checkpointed(ref.models(spark, folder)), ["model"]).select("model", "n", "events", *_POINT))


@query(
    f"""with {ref._FIRST}, pred as (select *, outcome as y, {_LINEAR} as p from first_of), ordered as (select *, row_number() over (partition by outcome order by sha256('7|' || patient_id), case_id) as rn, count(*) over (partition by outcome) as c from pred),
    models as (select case when rn <= floor(0.7 * c) then 'development' else 'holdout' end as model, y, p from ordered), {_RATED}, {_BUNDLE} select model as scope, n, events, {_round("auroc auprc brier scaled_brier log_loss")} from bundle"""
)
def performance_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The metric bundle of each side of the 70/30 split."""
    sides = ref.split_70_30(spark, folder).select(F.col("case_id").alias("_id"), F.when(F.col("development") == 1, "development").otherwise("holdout").alias("scope"))
    rows = score.score(ref._first(spark, folder).withColumn("y", F.col("outcome"))).join(sides, F.col("case_id") == F.col("_id"))
    return rounded(performance.metric_bundle(checkpointed(rows.select("scope", "y", "p")), ["scope"]))


@query(
    f"""with {ref._threshold_sql(CLINICAL)} select model, threshold, round(1000 * (tp + fp) / n, 6) as alerts_per_1000, round(1000 * tp / n, 6) as true_alerts_per_1000, round(1000 * fp / n, 6) as false_alerts_per_1000, patients_alerted, patients_captured from nb"""
)
def threshold_tables(spark: SparkSession, folder: str) -> DataFrame:
    w = performance.threshold_table(ref.models(spark, folder), CLINICAL, ["model"])
    return rounded(w.select("model", "threshold", "alerts_per_1000", "true_alerts_per_1000", "false_alerts_per_1000", "patients_alerted", "patients_captured"))


_FULL = [*CLINICAL, 0.3, 0.4]


@query(
    f"""with {ref._FIRST}, pred as (select *, outcome as y, {_LINEAR} as p from first_of), s as (select threshold, count(*)::double as n, count(*) filter (where a and y = 1)::double as tp, count(*) filter (where a and y = 0)::double as fp, sum(y)::double as e
      from (select threshold, y, (stage1_alert = 1 or p >= threshold) as a from pred, (select unnest([{", ".join(map(repr, _FULL))}])::double as threshold)) group by 1),
    x as (select *, tp + fp as alerts, threshold / (1 - threshold) as odds from s)
    select threshold, n, alerts, round(alerts / n, 6) as alert_rate, round(1000 * alerts / n, 6) as alerts_per_1000, round(1000 * tp / n, 6) as true_alerts_per_1000, round(1000 * fp / n, 6) as false_alerts_per_1000, round(tp / nullif(e, 0), 6) as sensitivity,
      round(1 - fp / nullif(n - e, 0), 6) as specificity, round(tp / nullif(alerts, 0), 6) as ppv, round(alerts / nullif(tp, 0), 6) as alerts_per_tp, round(fp / nullif(tp, 0), 6) as false_alerts_per_tp,
      case when threshold <= 0.25 then round((tp - fp * odds) / n, 6) end as net_benefit, case when threshold <= 0.25 then round((e - (n - e) * odds) / n, 6) end as net_benefit_all, case when threshold <= 0.25 then round(100 * ((tp - fp * odds) - (e - (n - e) * odds)) / n / odds, 6) end as avoided_per_100 from x"""
)
def two_stage_table(spark: SparkSession, folder: str) -> DataFrame:
    rows = score.score(ref._first(spark, folder).withColumn("y", F.col("outcome")))
    return rounded(performance.two_stage(checkpointed(rows.select("y", "p", "stage1_alert")), _FULL, utility=CLINICAL))


@query(
    f"""with {ref._SCORED}, rated as (select 'per_patient' as model, y, p, 1.0 / count(*) over (partition by patient_id) as w from pred where patient_id is not null), {_BUNDLE}
    select n, events, {_round("auroc auprc brier scaled_brier log_loss oe_ratio")} from bundle"""
)
def patient_weighted(spark: SparkSession, folder: str) -> DataFrame:
    """Metrics of all operations in which each patient weighs one, however many operations there are."""
    rows = ref.scored(spark, folder).filter("patient_id is not null").select("patient_id", "y", "p")
    sizes = rows.groupBy(F.col("patient_id").alias("_p")).agg((1 / F.count("*")).alias("w"))
    rows = checkpointed(rows.join(sizes, F.col("patient_id") == F.col("_p")).select("y", "p", "w"))
    return rounded(performance.metric_bundle(rows, [], "w").crossJoin(metrics.overall(rows, [], "w").select("oe_ratio")))  # one row each


@query(
    f"""with {_MAIN}, r as (select *, row_number() over (order by p, case_id) - 1 as rk, count(*) over () as n from main) select case_id, round(p, 6) as p from r
    where n <= 120 or rk = 0 or floor(rk * 119 / greatest(n - 1, 1)::double) > floor((rk - 1) * 119 / greatest(n - 1, 1)::double)"""
)
def make_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Test vectors of the frozen model: 120 rows at even distances in order of risk, proved by scoring them again."""
    frozen = frozen_bundle()
    vectors = checkpointed(models.make_vectors(first_scored(spark, folder).drop("p"), frozen))
    if not vectors.isEmpty():
        models.verify_vectors(vectors, frozen)
    return rounded(vectors.select("case_id", "p"))


def frozen_bundle() -> dict:
    model = {"feature_order": list(score.COEFFICIENTS), "coefficients": score.COEFFICIENTS, "intercept": score.INTERCEPT}
    return models.bundle("landmark", "common18", {"common18": model}, {"common18": score.MEDIANS}, {"common18": dict.fromkeys(score.MEDIANS, 1.0)}, {"clinical": 0.15})


# --- sensitivity


_SETTINGS: dict[tuple[str, str], dict] = {
    **{("phase", str(k)): dict(grid=dict(phase=float(k))) for k in range(5)},
    **{("buffer", f"{b}"): dict(windows=landmark.Windows(search_after=float(b))) for b in (5, 10)},
    ("variant", "nearest_right_boundary"): dict(grid=dict(statistic="nearest_right_boundary")),
    ("variant", "nibp_priority"): dict(grid=dict(priority=("NIBP", "ART"))),
    ("variant", "left_closed"): dict(grid=dict(interval="left_closed")),
    ("fine_redetected", "0"): dict(grid=dict(width=1.0), windows=landmark.FINE),
}
_STEPS = ["long_enough", "fully_evaluable", "first_per_patient", "stage1_alert", "stage2", "stage2_events"]
_SHOWN = ["n", "events", "auroc", "brier", "log_loss", "oe_ratio"]


def _setting(readings: DataFrame, cases: DataFrame, kw: dict) -> tuple[DataFrame, DataFrame]:
    """All evaluable cases under a grid and windows, and the cohort of second-stage first cases, scored."""
    w = kw.get("windows", landmark.Windows())
    series = grid.harmonize(readings, **kw.get("grid", {})).filter(F.col("time_min") <= w.search_until + w.horizon)
    found = checkpointed(landmark.windows(series, None, w).join(cases, "case_id").filter(F.col("duration_min") >= F.col("t0") + w.horizon))
    first = checkpointed(keyed.first_per(ref.evaluable(found), "patient_id", ["start_key", "case_id"]))
    return found, first


def _near_sql(name: str) -> str:
    return f"""{name}_t as (select case_id, ceil(t / 5.0 - 1e-12) * 5 as lab, source, t, median(map) as map, count(*) as n from good where t > 0 group by all),
{name}_l as (select case_id, lab, source, arg_max(map, t) as map from {name}_t group by all),
{name} as (select case_id, cast(lab as double) as time_min, coalesce(max(map) filter (where source = 'ART'), max(map) filter (where source = 'NIBP')) as map, case when count(*) filter (where source = 'ART') > 0 then 'ART' else 'NIBP' end as source from {name}_l group by 1, 2)"""


def _setting_sql(k: int, name: tuple[str, str], kw: dict) -> str:
    g, w = kw.get("grid", {}), kw.get("windows", landmark.Windows())
    if g.get("statistic") == "nearest_right_boundary":
        series = _near_sql(f"g{k}")
    elif g.get("interval") == "left_closed":
        series = ref._grid_sql(f"g{k}", 5, 0, "(floor(t / 5 + 1e-12) + 1) * 5", "t >= 0")
    else:
        series = ref._grid_sql(f"g{k}", int(g.get("width", 5)), int(g.get("phase", 0)), order=g.get("priority", ("ART", "NIBP")))
    return f"""{series}, {ref._t0_sql(f"e{k}", f"g{k}", w)}, {ref._windows_sql(f"w{k}", f"g{k}", f"e{k}", w)}, l{k} as (select * from w{k} join cases using (case_id) where duration_min >= t0 + 30),
f{k} as (select * from l{k} where feature_evaluable = 1 and outcome_evaluable = 1 and patient_id is not null qualify row_number() over (partition by patient_id order by start_key, case_id) = 1)"""


_GRID = f"{ref._RAW}, {ref._CASES}, " + ", ".join(_setting_sql(k, *s) for k, s in enumerate(_SETTINGS.items()))


@query(
    f"with {_GRID} "
    + " union all ".join(
        f"select '{a}' as analysis, '{s}' as setting, step_no, step, n from (select unnest([{{'step_no': 0, 'step': 'long_enough', 'n': (select count(*) from l{k})}}, {{'step_no': 1, 'step': 'fully_evaluable', 'n': (select count(*) from l{k} where feature_evaluable = 1 and outcome_evaluable = 1)}}, "
        f"{{'step_no': 2, 'step': 'first_per_patient', 'n': (select count(*) from f{k})}}, {{'step_no': 3, 'step': 'stage1_alert', 'n': (select count(*) from f{k} where stage1_alert = 1)}}, {{'step_no': 4, 'step': 'stage2', 'n': (select count(*) from f{k} where stage2 = 1)}}, "
        f"{{'step_no': 5, 'step': 'stage2_events', 'n': (select count(*) from f{k} where stage2 = 1 and outcome = 1)}}], recursive := true))"
        for k, (a, s) in enumerate(_SETTINGS)
    )
)
def sensitivity_grid(spark: SparkSession, folder: str) -> DataFrame:
    """The flow of the cohort selected anew under every phase, buffer, variant of the grid, and on the fine grid with its own events."""
    readings, cases, parts = checkpointed(ref.raw(spark, folder, 60.0)), checkpointed(ref.cases(spark, folder)), []
    for (a, s), kw in _SETTINGS.items():
        found, first = _setting(readings, cases, kw)
        counts = found.agg(F.count("*").alias("c0"), F.count_if((F.col("feature_evaluable") == 1) & (F.col("outcome_evaluable") == 1)).alias("c1")).crossJoin(
            first.agg(F.count("*").alias("c2"), F.count_if(F.col("stage1_alert") == 1).alias("c3"), F.count_if(F.col("stage2") == 1).alias("c4"), F.count_if((F.col("stage2") == 1) & (F.col("outcome") == 1)).alias("c5"))
        )  # one row each
        parts.append(counts.select(F.lit(a).alias("analysis"), F.lit(s).alias("setting"), F.explode(F.array(*[F.struct(F.lit(k).alias("step_no"), F.lit(step).alias("step"), F.col(f"c{k}").alias("n")) for k, step in enumerate(_STEPS)])).alias("r")).select("analysis", "setting", "r.*"))
    return secondary.union_all(parts)


@query(
    f"with {_GRID}, models as ("
    + " union all ".join(f"select '{a}|{s}' as model, outcome as y, {_LINEAR} as p from f{k} where stage2 = 1" for k, (a, s) in enumerate(_SETTINGS))
    + f"), {_RATED}, {_BUNDLE} select split_part(model, '|', 1) as analysis, split_part(model, '|', 2) as setting, n, events, {_round('auroc brier log_loss oe_ratio')} from bundle"
)
def sensitivity_performance(spark: SparkSession, folder: str) -> DataFrame:
    """The frozen model in each of those cohorts."""
    readings, cases = checkpointed(ref.raw(spark, folder, 60.0)), checkpointed(ref.cases(spark, folder))
    rows = [score.score(_setting(readings, cases, kw)[1].filter("stage2 = 1").withColumn("y", F.col("outcome"))).select(F.lit(a).alias("analysis"), F.lit(s).alias("setting"), "y", "p") for (a, s), kw in _SETTINGS.items()]
    return _shown(checkpointed(secondary.union_all(rows)), ["analysis", "setting"])


def _shown(rows: DataFrame, groups: list[str]) -> DataFrame:
    ratio = metrics.overall(rows, groups).select(*groups, "oe_ratio")
    return rounded(performance._joined(performance.metric_bundle(rows, groups), ratio, groups).select(*groups, *_SHOWN))


@query(
    f"with {_MAIN}, "
    + ", ".join(ref._windows_sql(f"s{k}", "h5", "(select case_id, t0 from main)", landmark.Windows(**kw)) for k, kw in enumerate(ref._SENS.values()))
    + ", models as ("
    + " union all ".join(f"select '{name}' as model, s{k}.outcome as y, p from main join s{k} using (case_id) where s{k}.outcome is not null" for k, name in enumerate(ref._SENS))
    + f"), {_RATED}, {_BUNDLE} select model as variant, {_round('auroc brier log_loss oe_ratio')}, n, events from bundle"
)
def endpoint_sensitivity(spark: SparkSession, folder: str) -> DataFrame:
    """The frozen model against other endpoints of the same cases, where they can be judged."""
    series, main = checkpointed(ref.h5(spark, folder, 60.0)), first_scored(spark, folder).select("case_id", "t0", "p")
    rows = []
    for name, kw in ref._SENS.items():
        other = landmark.windows(series, main.select("case_id", "t0"), landmark.Windows(**kw)).filter("outcome is not null").select(F.col("case_id").alias("_c"), F.col("outcome").alias("y"))
        rows.append(main.join(other, F.col("case_id") == F.col("_c")).select(F.lit(name).alias("variant"), "y", "p"))
    return _shown(checkpointed(secondary.union_all(rows)), ["variant"])


@query(
    f"""with {_MAIN}, pred as (select *, outcome as y, {_LINEAR} as p from lvl where feature_evaluable = 1 and outcome_evaluable = 1 and stage2 = 1), models as (select 'first' as model, patient_id, y, p from main union all select 'all', patient_id, y, p from pred), {_RATED}, {_BUNDLE},
    who as (select model, count(*) as patients, count(*) filter (where k > 1) as patients_with_more from (select model, patient_id, count(*) as k from models where patient_id is not null group by all) group by 1)
    select model as selection, n, events, {_round("auroc brier log_loss oe_ratio")}, coalesce(patients, 0) as patients, coalesce(patients_with_more, 0) as patients_with_more from bundle left join who using (model)"""
)
def operation_selection(spark: SparkSession, folder: str) -> DataFrame:
    """First against all evaluable second-stage operations."""
    every = score.score(ref.evaluable(ref.level(spark, folder)).filter("stage2 = 1").withColumn("y", F.col("outcome"))).select(F.lit("all").alias("selection"), "patient_id", "y", "p")
    rows = checkpointed(every.unionByName(first_scored(spark, folder).select(F.lit("first").alias("selection"), "patient_id", "y", "p")))
    per = rows.filter("patient_id is not null").groupBy("selection", "patient_id").agg(F.count("*").alias("k"))
    who = per.groupBy("selection").agg(F.count("*").alias("patients"), F.count_if(F.col("k") > 1).alias("patients_with_more"))
    return performance._joined(_shown(rows, ["selection"]), who, ["selection"]).withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in ("patients", "patients_with_more")})


_MASKED = " union all ".join(f"select '{g}' as model, y, p from pred where {m}" for g, m in ref._MASKS.items())


@query(
    f"""with {ref._SCORED}, every as ({_MASKED}), models as (select * from every where model in (select model from every group by 1 having count(*) >= 100 and sum(y) >= 20 and count(*) - sum(y) >= 20)), {_RATED}, {_BUNDLE}
    select model as subgroup, n, events, {_round("auroc brier log_loss oe_ratio")} from bundle"""
)
def subgroup_performance(spark: SparkSession, folder: str) -> DataFrame:
    """The frozen model in each subgroup of 100 cases or more with 20 events and 20 others; a case is in every group it belongs to."""
    each = F.explode(F.array_compact(F.array(*[F.when(F.expr(m), F.lit(g)) for g, m in ref._MASKS.items()]))).alias("subgroup")
    rows = checkpointed(ref.scored(spark, folder).select(each, "y", "p"))
    sizes = rows.groupBy(F.col("subgroup").alias("_g")).agg(F.count("*").alias("n"), F.sum("y").alias("e")).filter("n >= 100 and e >= 20 and n - e >= 20")
    return _shown(rows.join(F.broadcast(sizes.select("_g")), F.col("subgroup") == F.col("_g"), "left_semi"), ["subgroup"])  # one row a subgroup


@query(
    f"""with {ref._CELLS}, a as (select b.case_id, coalesce(f.feature_evaluable, 0) as fe, coalesce(f.outcome_evaluable, 0) as oe from base b left join fine f using (case_id))
    select count(*) as cases, count(*) filter (where fe = 1) as fine_features, count(*) filter (where oe = 1) as fine_outcome, count(*) filter (where fe = 1 and oe = 1) as complete from a"""
)
def cells_audit(spark: SparkSession, folder: str) -> DataFrame:
    """How many of the fixed cases the fine grid can judge: features, outcome, and both, which is the intersection of the four cells."""
    cells = ref.cells_2x2(spark, folder).groupBy("case_id").agg(
        F.max(F.when(F.col("cell") == "fine_input_coarse_outcome", F.col("feature_evaluable"))).alias("fe"), F.max(F.when(F.col("cell") == "coarse_input_fine_outcome", F.col("outcome_evaluable"))).alias("oe")
    )
    return cells.agg(F.count("*").alias("cases"), F.count_if(F.col("fe") == 1).alias("fine_features"), F.count_if(F.col("oe") == 1).alias("fine_outcome"), F.count_if((F.col("fe") == 1) & (F.col("oe") == 1)).alias("complete"))


# --- resampled, without SQL


def _first_models(spark: SparkSession, folder: str) -> DataFrame:
    return checkpointed(score.score_models(ref._first(spark, folder).filter("stage2 = 1").withColumn("y", F.col("outcome"))).select("model", "patient_id", "y", "p"))


def _paired(spark: SparkSession, folder: str, curve: bool = False, rows: DataFrame | None = None) -> DataFrame:
    rows = _first_models(spark, folder) if rows is None else rows
    at = None
    if curve:
        q = metrics.quantiles(rows.filter("model = 'common18'").withColumn("lp", ref.parse.logit(F.col("p"))), [], "lp", [0.05, 0.35, 0.65, 0.95, 0.01, 0.99]).first()
        if q is not None:
            import numpy as np

            knots = np.array(q["q"][:4]) + 1e-8 * np.arange(4)
            at = knots, 1 / (1 + np.exp(-np.linspace(q["q"][4], q["q"][5], 21)))
    return resample.paired_validation(rows, "model", "common18", CLINICAL, CLINICAL, replicates=REPLICATES, curve=at)


@query()
def paired_validation(spark: SparkSession, folder: str) -> DataFrame:
    """Nine metrics, threshold metrics, the calibration curve, and paired differences from the primary model, over 2,000 draws."""
    return _paired(spark, folder, curve=True)


_NAMES = {"auroc": "auroc", "auprc": "auprc", "brier": "brier", "scaled_brier": "scaled_brier", "log_loss": "log_loss", "observed_expected_ratio": "oe_ratio", "calibration_slope": "slope", "calibration_in_the_large": "citl", "ici": "ici"}
_FIRST_MODELS = f"{_MAIN}, models as (select 'common18' as model, patient_id, y, p from main union all " + " union all ".join(ref._simple(f).replace("from pred", "from main") for f in score.SIMPLE_MODELS).replace("case_id, patient_id", "patient_id") + ")"


@query(
    f"with recursive {_FIRST_MODELS}, {_POINT_SQL}, own as ("
    + " union all ".join(f"select model, null::varchar as versus, '{m}' as metric, {c} as estimate from point" for m, c in _NAMES.items())
    + ") select model, versus, metric, round(estimate, 6) as estimate from own union all select 'common18', b.model, b.metric, round(a.estimate - b.estimate, 6) from own a join own b using (metric) where a.model = 'common18' and b.model <> 'common18'"
)
def paired_estimates(spark: SparkSession, folder: str) -> DataFrame:
    """The estimates of the paired validation, which are those of the sample: they come through the same sums as its replicates."""
    got = resample.paired_validation(_first_models(spark, folder), "model", "common18", CLINICAL, CLINICAL, replicates=20)
    return rounded(got.filter("threshold is null").select("model", "versus", "metric", "estimate"))


@query(
    f"""with {ref._FIRST}, pred as (select *, outcome as y, {_LINEAR} as p from first_of), s as (select threshold, count(*)::double as n, count(*) filter (where a and y = 1)::double as tp, count(*) filter (where a and y = 0)::double as fp, sum(y)::double as e
      from (select threshold, y, (stage1_alert = 1 or p >= threshold) as a from pred, (select unnest([{", ".join(map(repr, CLINICAL))}])::double as threshold)) group by 1)
    select threshold, 'alert_rate' as metric, round((tp + fp) / n, 6) as estimate from s union all select threshold, 'sensitivity', round(tp / nullif(e, 0), 6) from s union all select threshold, 'ppv', round(tp / nullif(tp + fp, 0), 6) from s
    union all select threshold, 'net_benefit', round((tp - fp * threshold / (1 - threshold)) / n, 6) from s"""
)
def two_stage_estimates(spark: SparkSession, folder: str) -> DataFrame:
    """The estimates of the two-stage bootstrap, through the same sums as its replicates."""
    first = score.score(ref._first(spark, folder).withColumn("y", F.col("outcome"))).withColumn("p", F.when(F.col("stage1_alert") == 1, 1.0).otherwise(F.col("p")))
    return rounded(resample.bootstrap_thresholds(checkpointed(first.select("patient_id", "y", "p")), CLINICAL, replicates=20).select("threshold", "metric", "estimate"))


@query()
def replicate_algebra(spark: SparkSession, folder: str) -> DataFrame:
    rows = _first_models(spark, folder).filter("model = 'common18'")
    return resample.derived(resample.threshold_replicates(rows, CLINICAL, REPLICATES))


@query()
def bootstrap_gate(spark: SparkSession, folder: str) -> DataFrame:
    """Which estimates of the paired validation have too few defined replicates; thresholds without an alert are exempt."""
    rows = _first_models(spark, folder)
    got = resample.paired_validation(rows, "model", "common18", CLINICAL, CLINICAL, replicates=REPLICATES).filter("versus is null and threshold is not null")
    return checks.replicate_gate(got, ["model", "threshold"], REPLICATES, alerts=metrics.workload(rows, CLINICAL, ["model"], patient=None).select("model", "threshold", "alerts"))


@query("select 'lower_not_above_upper' as name, cast(0 as bigint) as violations, 1 as passed")
def ci_order(spark: SparkSession, folder: str) -> DataFrame:
    return checks.interval_order(_paired(spark, folder))


# --- reports


_MIX = [
    reports.Row("Cohort", "Primary outcome", "Present", "outcome", True), reports.Row("Demographics", "Age", "years", "age_years"), reports.Row("Demographics", "Sex", "Male", "male", True), reports.Row("Demographics", "Body mass index", "kg/m^2", "bmi"),
    *[reports.Row("Demographics", "ASA physical status", lv, f"case when asa is not null then cast(asa {c} as int) end", True) for lv, c in (("I", "= 1"), ("II", "= 2"), ("III", "= 3"), ("IV or higher", ">= 4"))],
    reports.Row("Operation", "Emergency operation", "Yes", "emergency", True, unavailable_in="MOVER_EPIC"), reports.Row("Operation", "Anaesthesia duration", "min", "duration_min"), reports.Row("Index hypotension", "Arterial-line MAP selected at t0", "Yes", "t0_arterial_source", True),
    reports.Row("Index hypotension", "Time from anaesthesia start to t0", "min", "anesthesia_start_to_t0_min"), reports.Row("Index hypotension", "MAP at t0", "mm Hg", "t0_map"), reports.Row("Pre-t0 MAP history", "MAP records in preceding 10 min", "count", "pre10_map_record_count"),
    reports.Row("Pre-t0 MAP history", "Gap from last MAP to t0", "min", "pre10_last_measurement_gap_min"), reports.Row("Pre-t0 MAP history", "Last MAP", "mm Hg", "pre10_last_map"), reports.Row("Pre-t0 MAP history", "Mean MAP", "mm Hg", "pre10_mean_map"),
    reports.Row("Pre-t0 MAP history", "OLS MAP slope", "mm Hg/min", "pre10_map_ols_slope_per_min", digits=2), reports.Row("Early response (0-5 min)", "Recovered by 5 min", "Yes", "recovered_by_5min", True), reports.Row("Early response (0-5 min)", "AUC below 65 mm Hg", "mm Hg x min", "early_auc65_0_5_mmhg_min"),
    reports.Row("Early response (0-5 min)", "Minimum MAP", "mm Hg", "early_min_map_0_5"), reports.Row("Early response (0-5 min)", "Mean MAP", "mm Hg", "early_mean_map_0_5"), reports.Row("Early response (0-5 min)", "MAP records", "count", "early_map_record_count_0_5"),
]


def _mix_sql() -> str:
    parts = []
    for k, r in enumerate(_MIX):
        v = f"case when dataset = '{r.unavailable_in}' then null else {r.value} end" if r.unavailable_in else r.value
        side = lambda d: f"(select count({v}) as n, avg({v}) as m, stddev_samp({v}) as s, sum({v}) as t, count(*) as every from main where dataset = '{d}')"  # noqa: E731, B023
        share = lambda x: f"format('{{:,}}', cast({x}.t as bigint)) || ' (' || printf('%.1f', round(100 * {x}.m, 1)) || '%)'"
        mean = lambda x: f"printf('%.{r.digits}f', round({x}.m, {r.digits})) || ' (' || coalesce(printf('%.{r.digits}f', round({x}.s, {r.digits})), 'not estimable') || ')'"  # noqa: E731, B023
        shown = lambda x, d: f"case when '{r.unavailable_in}' = '{d}' then 'not available' when {x}.n = 0 then 'not estimable' else {share(x) if r.binary else mean(x)} end"  # noqa: E731, B023
        variance = "(a.m * (1 - a.m) + b.m * (1 - b.m)) / 2" if r.binary else "(a.s * a.s + b.s * b.s) / 2"
        same = " when a.m = b.m then '0.000'" if r.binary else ""
        parts.append(
            f"select {k + 1} as order_no, '{r.section}' as section, '{r.characteristic}' as characteristic, '{r.level}' as level, '{'n (%)' if r.binary else 'Mean (SD)'}' as statistic, a.n as left_n, {shown('a', 'INSPIRE_1.4.2')} as left_value, round(100 * (1 - a.n / a.every), 1) as left_missing_pct, "
            f"b.n as right_n, {shown('b', 'MOVER_EPIC')} as right_value, round(100 * (1 - b.n / b.every), 1) as right_missing_pct, coalesce(case when {variance} > 0 then printf('%.3f', round(abs(a.m - b.m) / sqrt({variance}), 3)){same} end, 'not estimable') as absolute_smd from {side('INSPIRE_1.4.2')} a, {side('MOVER_EPIC')} b"
        )
    return f"with {_MAIN} " + " union all ".join(parts)


@query(_mix_sql())
def case_mix(spark: SparkSession, folder: str) -> DataFrame:
    """Characteristics of the second-stage cohort by database."""
    return reports.case_mix(checkpointed(ref._first(spark, folder).filter("stage2 = 1")), "dataset", "INSPIRE_1.4.2", "MOVER_EPIC", _MIX)


_SCREENING = ["cases", "with_event", "long_enough", "feature_evaluable", "fully_evaluable", "first_per_patient"]


@query(
    f"""with {ref._FLOW_COUNTS}, inside as (select *, lag(n) over (order by step_no) as before from flow where step in {tuple(_SCREENING)})
    select flow.step_no, flow.step, flow.n, before - flow.n as excluded_from_previous, case when inside.step is null then 'branch' else 'screening' end as branch from flow left join inside using (step_no)"""
)
def flow_figure(spark: SparkSession, folder: str) -> DataFrame:
    return reports.flow_figure(ref.cohort_flow(spark, folder), _SCREENING)


@query()
def performance_report(spark: SparkSession, folder: str) -> DataFrame:
    """Estimates with intervals of each model and paired differences, as they are printed; estimates must equal the point estimates."""
    rows = _first_models(spark, folder)
    got = _paired(spark, folder, rows=rows).filter("threshold is null")
    point = performance.point_performance(rows, ["model"])
    names = {"auroc": "auroc", "auprc": "auprc", "brier": "brier", "scaled_brier": "scaled_brier", "log_loss": "log_loss", "observed_expected_ratio": "oe_ratio", "calibration_slope": "slope", "calibration_in_the_large": "citl", "ici": "ici"}
    long = point.select("model", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(c).alias("value")) for m, c in names.items()])).alias("r")).select("model", "r.*")
    return reports.performance_table(long, got, "model", "common18", 1e-6)


def _threshold_intervals(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    first = checkpointed(score.score(ref._first(spark, folder).withColumn("y", F.col("outcome"))).select("patient_id", "y", "p", "stage1_alert", "stage2"))
    both = first.withColumn("p", F.when(F.col("stage1_alert") == 1, 1.0).otherwise(F.col("p")))
    run = lambda df: resample.bootstrap_thresholds(df.select("patient_id", "y", "p"), CLINICAL, replicates=REPLICATES, names=tuple(resample.THRESHOLD))
    return run(first.filter("stage2 = 1")), run(both)


@query()
def threshold_report(spark: SparkSession, folder: str) -> DataFrame:
    return reports.threshold_table(*_threshold_intervals(spark, folder), CLINICAL)


@query()
def trade_off(spark: SparkSession, folder: str) -> DataFrame:
    """One row per threshold of the two-stage strategy, metrics and their limits as columns."""
    return reports.wide_by_threshold(_threshold_intervals(spark, folder)[1], ["alerts_per_1000", "sensitivity", "ppv", "alerts_per_tp"])


@query()
def figure_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Rows, columns and value hash of the data of each figure."""
    figures = {"flow": flow_figure, "decision_curve": ref.dca_grid, "precision_recall": ref.pr_curve, "calibration_bins": ref.ici_bins, "agreement": ref.agreement, "endpoint_components": ref.endpoint_components, "drift": ref.drift, "subgroups": ref.subgroups}
    return reports.source_manifest({n: q(spark, folder) for n, q in figures.items()})
