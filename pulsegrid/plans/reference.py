"""Queries of the harmonise, landmark, score and evaluate operators over the readings and cohort tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.functions import parse
from pulsegrid.operators import fit, grid, instants, keyed, landmark, metrics, performance, planning, resample, score, secondary, units
from pulsegrid.plans import prep
from pulsegrid.session import checkpointed
from pulsegrid.sources.tables import table

FILLED = ["dataset", "age", "sex", "male", "height_m", "weight_kg", "asa", "emergency", "anesthesia_start", "anesthesia_end"]
DYNAMIC = landmark.FEATURES[4:]
CLINICAL = [0.10, 0.15, 0.20, 0.25]
PENALTIES = [0.0, 1e-6, 1e-5, 1e-4, 1e-3, 1e-2, 1e-1, 1.0, 10.0, 100.0]
REPLICATES = 2000
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def keeper(queries: dict[str, Query], texts: dict[str, str]):
    """A decorator that registers a query, with its SQL if it is given."""

    def query(sql: str | None = None):
        def keep(f: Query) -> Query:
            queries[f.__name__] = f
            if sql is not None:
                texts[f.__name__] = sql
            return f

        return keep

    return query


query = keeper(QUERIES, SQL)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# --- the chain in Spark


def cases(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "cohort").select("cohort_id", F.col("encounter_id").alias("case_id"), "patient_id", "anesthesia_duration_min", "loaded_at", *FILLED)
    one = keyed.most_complete(keyed.drop_conflicts(rows, "case_id", ["patient_id", "anesthesia_duration_min"]), "case_id", ["cohort_id"])
    return one.select(
        "case_id", "patient_id", F.col("age").alias("age_years"), parse.male_num(F.col("sex")).alias("male"), parse.bmi(parse.parse_weight_kg(F.col("weight_kg")), parse.parse_height_m(F.col("height_m"))).alias("bmi"),
        "asa", F.col("anesthesia_duration_min").alias("duration_min"), F.unix_micros("loaded_at").alias("start_key"), "dataset", F.col("emergency").cast("int").alias("emergency"),
    )


def raw(spark: SparkSession, folder: str, until: float | None = None) -> DataFrame:
    """Readings of the two devices in mmHg, whatever unit they were delivered in; devices are told by their label.

    Readings whose label means neither (:func:`unmapped_sources` counts them) take no part. With
    ``until`` only readings up to that minute, which are all that a cell with that label or a smaller one holds.
    """
    rows = units.reading_units(table(spark, folder, "map_observations")).withColumn("source", parse.device_of(F.col("map_source"))).filter(F.col("source").isNotNull())
    rows = rows if until is None else rows.filter(F.col("minute_from_anesthesia_start") <= until)
    return rows.select(F.col("encounter_id").alias("case_id"), F.col("minute_from_anesthesia_start").alias("t"), F.col("value_mmhg").alias("map"), "source")


def _grid(spark: SparkSession, folder: str, width: float, until: float | None) -> DataFrame:
    cells = grid.harmonize(raw(spark, folder, until), width)
    return cells if until is None else cells.filter(F.col("time_min") <= until)


def h5(spark: SparkSession, folder: str, until: float | None = None) -> DataFrame:
    return _grid(spark, folder, 5.0, until)


def r1(spark: SparkSession, folder: str, until: float | None = None) -> DataFrame:
    return _grid(spark, folder, 1.0, until)


def level(spark: SparkSession, folder: str, w: landmark.Windows = landmark.Windows(), series: DataFrame | None = None) -> DataFrame:
    """Cases with an index event, a row of covariates and enough time behind the event.

    One row per case, small beside the readings it comes from: it is written once, so that what follows neither runs the
    windows again nor drags their expressions along.
    """
    # No window looks beyond the last search time plus the horizon.
    series = h5(spark, folder, w.search_until + w.horizon) if series is None else series
    found = landmark.windows(series.filter(F.col("time_min") <= w.search_until + w.horizon), None, w)
    return checkpointed(found.join(cases(spark, folder), "case_id").filter(F.col("duration_min") >= F.col("t0") + w.horizon))


def timed_cases(spark: SparkSession, folder: str) -> DataFrame:
    """encounter_id, patient_id, start and end as instants; the end is the start and the whole minutes of the case."""
    starts = instants.cohort_instants(table(spark, folder, "cohort"), table(spark, folder, "sites")).select("cohort_id", "encounter_id", "utc_us", "anesthesia_duration_min")
    who = table(spark, folder, "cohort").select(F.col("cohort_id").alias("_c"), "patient_id")
    rows = starts.filter("utc_us is not null and anesthesia_duration_min is not null").join(who, F.col("cohort_id") == F.col("_c"))
    end = F.col("utc_us") + F.col("anesthesia_duration_min").cast("bigint") * 60_000_000
    return rows.select("encounter_id", "patient_id", F.timestamp_micros("utc_us").alias("start"), F.timestamp_micros(end).alias("end"))


def evaluable(df: DataFrame) -> DataFrame:
    return df.filter("feature_evaluable = 1 and outcome_evaluable = 1")


def scored(spark: SparkSession, folder: str) -> DataFrame:
    """case_id, patient_id, y, p and features of every fully evaluable case, by the frozen model."""
    return score.score(evaluable(level(spark, folder)).withColumn("y", F.col("outcome")))


# --- the same chain in SQL


def _cut(text: str) -> str:
    return f"try_cast(nullif(regexp_extract(replace({text}, ',', ''), '[+-]?(?:\\d+(?:\\.\\d*)?|\\.\\d+)'), '') as double)"


_H = "lower(trim(translate(height_m, '′″', '''\"')))"
_FT = r"'^(\d+(?:\.\d+)?)\s*(?:''|ft|feet)\s*(\d+(?:\.\d+)?)?'"
_HEIGHT = rf"""case when regexp_matches({_H}, {_FT}) then (try_cast(regexp_extract({_H}, {_FT}, 1) as double) * 12 + coalesce(try_cast(nullif(regexp_extract({_H}, {_FT}, 2), '') as double), 0)) * 0.0254
  when {_cut(_H)} is null then null
  when contains({_H}, 'cm') or ({_cut(_H)} between 120 and 230 and not regexp_matches({_H}, '\bin\b')) then {_cut(_H)} / 100
  when regexp_matches({_H}, '\b(?:in|inch|inches)\b') or {_cut(_H)} between 48 and 90 then {_cut(_H)} * 0.0254
  when contains(' ' || {_H}, ' m') or {_cut(_H)} between 1.2 and 2.3 then {_cut(_H)} end"""
_W = "lower(trim(weight_kg))"
_KG = rf"""{_cut(_W)} * case when regexp_matches({_W}, '\bkg\b|kilogram') then 1.0 when regexp_matches({_W}, '\blbs?\b|pound') then 0.45359237
  when regexp_matches({_W}, '\boz\b|ounce') then 0.028349523125 when regexp_matches({_W}, '\b(?:g|gm|grams?)\b') then 0.001 else 0.028349523125 end"""
_WEIGHT = f"case when {_cut(_W)} > 0 and {_KG} between 20 and 400 then {_KG} end"
_CASES = f"""conflict as (select encounter_id from cohort group by 1 having count(distinct patient_id) > 1 or count(distinct anesthesia_duration_min) > 1),
one as (select * from cohort where encounter_id is not null and encounter_id not in (select encounter_id from conflict where encounter_id is not null)
  qualify row_number() over (partition by encounter_id order by {" + ".join(f"({c} is not null)::int" for c in FILLED)} desc, cohort_id) = 1),
sized as (select *, {_HEIGHT} as hm, {_WEIGHT} as kg from one),
cases as (select encounter_id as case_id, patient_id, age as age_years, case when upper(trim(sex)) in ('M', 'MALE') then 1.0 when upper(trim(sex)) in ('F', 'FEMALE') then 0.0 end as male,
  case when kg / (hm * hm) between 10 and 80 then kg / (hm * hm) end as bmi, asa, anesthesia_duration_min as duration_min, epoch_us(loaded_at) as start_key, dataset, emergency::int as emergency from sized)"""
_IN = lambda names: ", ".join(f"'{n}'" for n in names)
_TOKEN = "upper(regexp_replace({}, '[^0-9A-Za-z]', '', 'g'))"
_SOURCE = f"case when {_TOKEN} in ({_IN(parse.ART_TOKENS)}) then 'ART' when {_TOKEN} in ({_IN(parse.NIBP_TOKENS)}) then 'NIBP' end".replace("{}", "{0}")
_DEVICE = f"coalesce({_SOURCE}, case when regexp_matches({{0}}, '{parse.ART_LABEL}') then 'ART' when regexp_matches({{0}}, '{parse.NIBP_LABEL}') then 'NIBP' end)"
_RAW = f"""{prep._UNIT_ROWS},
raw as (select e as case_id, m as t, {prep._MMHG} as map, {_DEVICE.format("sk")} as source from unit_of),
good as (select * from raw where source is not null and map between 20 and 200 and t is not null and case_id is not null)"""


def _grid_sql(name: str, width: int, phase: int = 0, label: str | None = None, keep: str = "t > 0", order: tuple[str, str] = ("ART", "NIBP")) -> str:
    label = label or f"{phase} + ceil((t - {phase}) / {width}.0 - 1e-12) * {width}"
    a, b = order
    return f"""{name} as (select case_id, cast(lab as double) as time_min, coalesce(ma, mb) as map, case when ma is not null then '{a}' else '{b}' end as source,
  case when ma is not null then na else nb end as n_raw_records, n as n_raw_records_all_sources
  from (select case_id, lab, median(map) filter (where source = '{a}') as ma, median(map) filter (where source = '{b}') as mb,
    count(*) filter (where source = '{a}') as na, count(*) filter (where source = '{b}') as nb, count(*) as n
    from (select *, {label} as lab from good where {keep}) group by 1, 2))"""


_SERIES = "case_id, time_min, round(map, 6) as map, source, n_raw_records, n_raw_records_all_sources"


def _windows_sql(name: str, series: str, events: str, w: landmark.Windows = landmark.Windows()) -> str:
    """Rows per event of ``events`` (case_id, t0)."""
    off = "true" if w.grid is None else f"abs((time_min - t0) - {w.grid} * round((time_min - t0) / {w.grid})) <= 1e-9"
    th = w.threshold
    return f"""{name}_j as (select e.case_id, e.t0, s.time_min, s.map, s.source, s.time_min - e.t0 as rel from {events} e left join {series} s on s.case_id = e.case_id and s.time_min between e.t0 - {w.pre} and e.t0 + {w.horizon}),
{name}_early as (select *, greatest({th} - map, 0) as d, lag(rel) over k as lr, lag(greatest({th} - map, 0)) over k as ld from {name}_j where rel between 0 and {w.landmark} window k as (partition by case_id order by rel)),
{name}_ea as (select case_id, sum((rel - lr) * (d + ld) / 2) as auc, min(map) as mn, avg(map) as mean, count(*) as n, max(case when rel > 0 then (map >= {th})::int end) as rec,
  min(case when rel > 0 and map >= {th} then rel end) as fh, max(case when rel > 0 and map < {th} then rel end) as ll from {name}_early group by 1),
{name}_late as (select *, greatest({th} - map, 0) as d, lag(rel) over k as lr, lag(greatest({th} - map, 0)) over k as ld from {name}_j where rel between {w.landmark} and {w.horizon} and {off} window k as (partition by case_id order by rel)),
{name}_la as (select case_id, count(*) as n, max(rel - lr) as gap, sum((rel - lr) * (d + ld) / 2) as auc, min(case when rel > {w.landmark} and map >= {th} then rel - {w.landmark} end) as rcv from {name}_late group by 1),
{name}_pre as (select case_id, count(*) as n, max(rel) as lr, arg_max(map, rel) as lm, avg(map) as mean, case when count(distinct rel) >= 2 then regr_slope(map, rel) end as slope from {name}_j where rel >= -{w.pre} and rel < 0 group by 1),
{name}_at as (select case_id, t0, max(case when rel = 0 then map end) as m0, max(case when rel = 0 then (source = 'ART')::int end)::double as art, max(case when rel = {w.landmark} then map end) as ml, max(case when rel = {w.horizon} then map end) as mh from {name}_j group by 1, 2),
{name}_x as (select a.*, e.auc as eauc, e.mn as emn, e.mean as emean, coalesce(e.n, 0)::double as en, e.rec::double as erec, coalesce(e.ll > e.fh, false) as recur, coalesce(l.n, 0) as ln, l.gap, l.auc as lauc, l.rcv,
  coalesce(p.n, 0)::double as pn, -p.lr as pgap, p.lm, p.mean as pmean, p.slope, (m0 is not null and ml is not null) as known,
  (ml is not null and mh is not null and coalesce(l.n, 0) >= {w.least_points} and coalesce(l.gap <= {w.largest_gap} + 1e-9, false)) as judged
  from {name}_at a left join {name}_ea e using (case_id) left join {name}_la l using (case_id) left join {name}_pre p using (case_id)),
{name} as (select case_id, t0, m0 as t0_map, m0 * m0 as t0_map_squared, art as t0_arterial_source, t0 as anesthesia_start_to_t0_min, pn as pre10_map_record_count, pgap as pre10_last_measurement_gap_min, lm as pre10_last_map,
  pmean as pre10_mean_map, slope as pre10_map_ols_slope_per_min, erec as recovered_by_5min, eauc as early_auc65_0_5_mmhg_min, emn as early_min_map_0_5, emean as early_mean_map_0_5, en as early_map_record_count_0_5, ml as landmark_map,
  known::int as feature_evaluable, case when known then recur::int end as early_recurrence, case when known then (recur or coalesce(eauc >= {w.alert_auc}, false))::int end as stage1_alert,
  case when known then (not (recur or coalesce(eauc >= {w.alert_auc}, false)))::int end as stage2, ln as outcome_points, gap as outcome_max_gap_min, judged::int as outcome_evaluable,
  case when judged then rcv end as recovery_min, case when judged then lauc end as outcome_auc, case when judged then (rcv is null or rcv > {w.persistent_after})::int end as persistent,
  case when judged then coalesce(lauc >= {w.high_burden_auc}, false)::int end as high_burden,
  case when judged then ((rcv is null or rcv > {w.persistent_after}) or coalesce(lauc >= {w.high_burden_auc}, false))::int end as outcome,
  concat_ws(';', case when m0 is null then 'missing_t0_observation' end, case when ml is null then 'missing_t0_plus_5_observation' end) as feature_reason,
  concat_ws(';', case when ml is null then 'missing_landmark_anchor' end, case when mh is null then 'missing_horizon_anchor' end, case when ln < {w.least_points} then 'too_few_points' end, case when not coalesce(gap <= {w.largest_gap} + 1e-9, false) then 'gap_too_large' end) as outcome_reason
  from {name}_x)"""


def _t0_sql(name: str, series: str, w: landmark.Windows = landmark.Windows()) -> str:
    return f"{name} as (select case_id, min(time_min) as t0 from {series} where time_min > {w.search_after} and time_min <= {w.search_until} and map < {w.threshold} group by 1)"


_H5 = f"{_RAW}, {_grid_sql('h5', 5)}"
_LEVEL = f"{_H5}, {_t0_sql('ev', 'h5')}, {_windows_sql('win', 'h5', 'ev')}, {_CASES}, lvl as (select * from win join cases using (case_id) where duration_min >= t0 + 30)"


def _linear(prefix: str = "") -> str:
    return f"{score.INTERCEPT!r}" + "".join(f" + ({b!r}) * coalesce({f}, {score.MEDIANS[f]!r})" for f, b in score.COEFFICIENTS.items())


_SCORED = f"{_LEVEL}, pred as (select *, outcome as y, 1 / (1 + exp(-({_linear()}))) as p from lvl where feature_evaluable = 1 and outcome_evaluable = 1)"


def _round(columns: str, digits: int = 6) -> str:
    return ", ".join(f"round({c}, {digits}) as {c}" for c in columns.split())


# --- harmonise


@query(f"with {_H5} select {_SERIES} from h5")
def harmonize_h5(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(h5(spark, folder))


@query(f"with {_RAW}, {_grid_sql('g', 1)} select {_SERIES} from g")
def harmonize_r1(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(r1(spark, folder))


@query(f"with {_RAW}, {_grid_sql('g', 5, 3)} select {_SERIES} from g")
def harmonize_phase3(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(grid.harmonize(raw(spark, folder), 5.0, 3.0))


@query(f"with {_RAW}, {_grid_sql('g', 1, 0, 't', 't >= 0')} select {_SERIES} from g")
def published_grid(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(grid.published_grid(raw(spark, folder)))


@query(f"with {_RAW}, {_grid_sql('g', 5, 0, '(floor(t / 5 + 1e-12) + 1) * 5', 't >= 0')} select {_SERIES} from g")
def h5_left_closed(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(grid.harmonize(raw(spark, folder), 5.0, interval="left_closed"))


@query(f"with {_RAW}, {_grid_sql('g', 5, order=('NIBP', 'ART'))} select {_SERIES} from g")
def h5_nibp_priority(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(grid.harmonize(raw(spark, folder), 5.0, priority=("NIBP", "ART")))


@query(
    f"""with {_RAW}, at_time as (select case_id, ceil(t / 5.0 - 1e-12) * 5 as lab, source, t, median(map) as map, count(*) as n from good where t > 0 group by all),
    last_of as (select case_id, lab, source, arg_max(map, t) as map, arg_max(n, t) as n, sum(n) as every from at_time group by all)
    select case_id, cast(lab as double) as time_min, round(coalesce(max(map) filter (where source = 'ART'), max(map) filter (where source = 'NIBP')), 6) as map,
      case when count(*) filter (where source = 'ART') > 0 then 'ART' else 'NIBP' end as source,
      cast(case when count(*) filter (where source = 'ART') > 0 then max(n) filter (where source = 'ART') else max(n) filter (where source = 'NIBP') end as bigint) as n_raw_records, cast(sum(every) as bigint) as n_raw_records_all_sources
    from last_of group by 1, 2"""
)
def h5_nearest_right(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(grid.harmonize(raw(spark, folder), 5.0, statistic="nearest_right_boundary"))


@query("select coalesce(map_source, 'NULL') as source, count(*) as n, count(map_value) as n_with_value, count(*) filter (where map_value between 20 and 200) as n_in_range from map_observations group by 1")
def source_audit(spark: SparkSession, folder: str) -> DataFrame:
    df = table(spark, folder, "map_observations")
    return df.groupBy(F.coalesce("map_source", F.lit("NULL")).alias("source")).agg(F.count("*").alias("n"), F.count("map_value").alias("n_with_value"), F.count_if(F.col("map_value").between(20, 200)).alias("n_in_range"))


@query(f"select map_source as label, count(*) as n, count(map_value) as n_with_value from map_observations where {_DEVICE.format('map_source')} is null group by 1")
def unmapped_sources(spark: SparkSession, folder: str) -> DataFrame:
    """Labels of neither device, NULL among them, with the rows they leave out of the series."""
    df = table(spark, folder, "map_observations").filter(parse.device_of(F.col("map_source")).isNull())
    return df.groupBy(F.col("map_source").alias("label")).agg(F.count("*").alias("n"), F.count("map_value").alias("n_with_value"))


# --- landmark


@query(f"with {_H5} select case_id, min(time_min) as t0, round(arg_min(map, time_min), 6) as t0_map, arg_min(source, time_min) as t0_source from h5 where time_min > 3 and time_min <= 30 and map < 65 group by 1")
def find_t0(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(landmark.find_t0(h5(spark, folder)))


_FEATURE_COLUMNS = " ".join(landmark.FEATURES)


@query(f"with {_LEVEL} select case_id, {_round(_FEATURE_COLUMNS)} from lvl where feature_evaluable = 1")
def features18(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(level(spark, folder).filter("feature_evaluable = 1").select("case_id", *landmark.FEATURES))


@query(f"with {_LEVEL} select case_id, t0, feature_evaluable, feature_reason from lvl")
def features18_audit(spark: SparkSession, folder: str) -> DataFrame:
    return level(spark, folder).select("case_id", "t0", "feature_evaluable", "feature_reason")


@query(f"with {_LEVEL} select case_id, t0, {_round('recovered_by_5min early_auc65_0_5_mmhg_min')}, early_recurrence, stage1_alert, stage2 from lvl")
def stage1(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(level(spark, folder).select("case_id", "t0", "recovered_by_5min", "early_auc65_0_5_mmhg_min", "early_recurrence", "stage1_alert", "stage2"))


_OUTCOME = "case_id, t0, outcome_points, round(outcome_max_gap_min, 6) as outcome_max_gap_min, outcome_evaluable, round(recovery_min, 6) as recovery_min, round(outcome_auc, 6) as outcome_auc, persistent, high_burden, outcome, outcome_reason"
_OUTCOME_COLUMNS = ["case_id", "t0", "outcome_points", "outcome_max_gap_min", "outcome_evaluable", "recovery_min", "outcome_auc", "persistent", "high_burden", "outcome", "outcome_reason"]


@query(f"with {_LEVEL} select {_OUTCOME} from lvl")
def outcome_h5(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(level(spark, folder).select(*_OUTCOME_COLUMNS))


@query(f"with {_H5}, {_grid_sql('r1', 1)}, {_t0_sql('ev', 'h5')}, {_windows_sql('win', 'r1', 'ev', landmark.FINE)} select {_OUTCOME} from win")
def outcome_r1(spark: SparkSession, folder: str) -> DataFrame:
    t0 = landmark.find_t0(h5(spark, folder)).select("case_id", "t0")
    return rounded(landmark.windows(r1(spark, folder, 60.0), t0, landmark.FINE).select(*_OUTCOME_COLUMNS))


_CELLS = f"""{_LEVEL}, {_grid_sql('r1', 1)}, base as (select * from win join (select case_id from cases) using (case_id) where feature_evaluable = 1 and outcome_evaluable = 1 and stage2 = 1),
{_windows_sql('fine', 'r1', '(select case_id, t0 from base)', landmark.FINE)}, procs as (select 'coarse' as pr, case_id, feature_evaluable, early_auc65_0_5_mmhg_min, outcome_evaluable, outcome_auc, outcome from base
  union all select 'fine', case_id, feature_evaluable, early_auc65_0_5_mmhg_min, outcome_evaluable, outcome_auc, outcome from fine),
cells as (select f.case_id, f.pr || '_input_' || o.pr || '_outcome' as cell, f.feature_evaluable, f.early_auc65_0_5_mmhg_min, o.outcome_evaluable, o.outcome_auc, o.outcome from procs f join procs o using (case_id))"""


@query(f"with {_CELLS} select case_id, cell, feature_evaluable, round(early_auc65_0_5_mmhg_min, 6) as early_auc65_0_5_mmhg_min, outcome_evaluable, round(outcome_auc, 6) as outcome_auc, outcome from cells")
def cells_2x2(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(landmark.observation_cells(h5(spark, folder, 60.0), r1(spark, folder, 60.0), cases(spark, folder)))


@query(f"with {_LEVEL} select case_id, patient_id, t0, feature_evaluable, outcome_evaluable, stage1_alert, stage2, outcome from lvl")
def case_level(spark: SparkSession, folder: str) -> DataFrame:
    return level(spark, folder).select("case_id", "patient_id", "t0", "feature_evaluable", "outcome_evaluable", "stage1_alert", "stage2", "outcome")


_FIRST = f"{_LEVEL}, first_of as (select * from lvl where feature_evaluable = 1 and outcome_evaluable = 1 and patient_id is not null qualify row_number() over (partition by patient_id order by start_key, case_id) = 1)"


def _first(spark: SparkSession, folder: str) -> DataFrame:
    return keyed.first_per(evaluable(level(spark, folder)), "patient_id", ["start_key", "case_id"])


@query(f"with {_FIRST} select patient_id, case_id, t0, stage2, outcome from first_of")
def first_evaluable(spark: SparkSession, folder: str) -> DataFrame:
    return _first(spark, folder).select("patient_id", "case_id", "t0", "stage2", "outcome")


_FLOW = ["cases", "with_event", "long_enough", "feature_evaluable", "outcome_evaluable", "fully_evaluable", "first_per_patient", "stage1_alert", "stage2", "stage2_events"]
_FLOW_COUNTS = f"""{_FIRST}, counts as (select (select count(*) from cases) as c0, (select count(*) from ev join cases using (case_id)) as c1, l.*, f.* from
    (select count(*) as c2, count(*) filter (where feature_evaluable = 1) as c3, count(*) filter (where outcome_evaluable = 1) as c4, count(*) filter (where feature_evaluable = 1 and outcome_evaluable = 1) as c5 from lvl) l,
    (select count(*) as c6, count(*) filter (where stage1_alert = 1) as c7, count(*) filter (where stage2 = 1) as c8, count(*) filter (where stage2 = 1 and outcome = 1) as c9 from first_of) f),
  flow as ({" union all ".join(f"select {k} as step_no, '{s}' as step, c{k} as n from counts" for k, s in enumerate(_FLOW))})"""


@query(f"with {_FLOW_COUNTS} select * from flow")
def cohort_flow(spark: SparkSession, folder: str) -> DataFrame:
    """Ten counts from all cases to second-stage events; from first_per_patient on they are of each patient's first fully evaluable case."""
    every = cases(spark, folder)
    # One row per case with an event, written once: counts of all of them and of first cases read it.
    found = checkpointed(landmark.windows(h5(spark, folder, 60.0)).join(every, "case_id").select("case_id", "patient_id", "start_key", "t0", "duration_min", "feature_evaluable", "outcome_evaluable", "stage1_alert", "stage2", "outcome"))
    long = F.col("duration_min") >= F.col("t0") + 30
    known, judged = F.col("feature_evaluable") == 1, F.col("outcome_evaluable") == 1
    a = found.agg(F.count("*").alias("c1"), F.count_if(long).alias("c2"), F.count_if(long & known).alias("c3"), F.count_if(long & judged).alias("c4"), F.count_if(long & known & judged).alias("c5"))
    first = keyed.first_per(found.filter(long & known & judged), "patient_id", ["start_key", "case_id"])
    b = first.agg(F.count("*").alias("c6"), F.count_if(F.col("stage1_alert") == 1).alias("c7"), F.count_if(F.col("stage2") == 1).alias("c8"), F.count_if((F.col("stage2") == 1) & (F.col("outcome") == 1)).alias("c9"))
    one = every.agg(F.count("*").alias("c0")).crossJoin(a).crossJoin(b)  # one row each
    return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("step_no"), F.lit(s).alias("step"), F.col(f"c{k}").alias("n")) for k, s in enumerate(_FLOW)])).alias("r")).select("r.*")


@query(f"with {_LEVEL} " + " union all ".join(f"select 'level' as scope, '{f}' as feature, count(*) as n, count(*) - count({f}) as missing_n, round(100.0 * (count(*) - count({f})) / nullif(count(*), 0), 6) as missing_pct, (count({f}) = 0)::int as structurally_missing from lvl" for f in landmark.FEATURES))
def feature_missingness(spark: SparkSession, folder: str) -> DataFrame:
    return keyed.missingness(level(spark, folder), list(landmark.FEATURES), "level")


_COVERED = ["cohort_id", "encounter_id", "patient_id", "age", "sex", "height_m", "weight_kg", "asa", "anesthesia_start", "time_scale"]


@query(" union all ".join(f"select '{c}' as field, count(*) as n, count({c}) as n_present, round(100.0 * count({c}) / nullif(count(*), 0), 6) as present_pct, count(distinct {c}) as n_distinct from cohort" for c in _COVERED))
def field_coverage(spark: SparkSession, folder: str) -> DataFrame:
    return keyed.coverage(table(spark, folder, "cohort"), _COVERED)


# --- keys and audits


@query(f"with {_CASES} select case_id, patient_id, age_years, male, round(bmi, 6) as bmi, asa, duration_min from cases")
def dedup_complete(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(cases(spark, folder).select("case_id", "patient_id", "age_years", "male", "bmi", "asa", "duration_min"))


_CHANGING = ["map_source", "raw_display_name"]


@query("select encounter_id, count(*) as n from map_observations where encounter_id in (select encounter_id from map_observations where encounter_id is not null group by 1 having count(distinct map_source) <= 1 and count(distinct raw_display_name) <= 1) group by 1")
def drop_conflicts(spark: SparkSession, folder: str) -> DataFrame:
    df = table(spark, folder, "map_observations").select("encounter_id", *_CHANGING)
    return keyed.drop_conflicts(df, "encounter_id", _CHANGING).groupBy("encounter_id").agg(F.count("*").alias("n"))


@query(
    """select count(*) as n, count(*) - count(encounter_id) as n_null, count(*) filter (where encounter_id <> trim(encounter_id) or encounter_id = '') as n_padded,
    count(*) filter (where lower(trim(encounter_id)) in ('nan', 'none', 'null', '<na>', 'nat')) as n_placeholder, count(encounter_id) - count(distinct encounter_id) as n_repeated from cohort"""
)
def strict_ids_audit(spark: SparkSession, folder: str) -> DataFrame:
    return keyed.id_audit(table(spark, folder, "cohort"), "encounter_id")


@query(
    f"""with {_FIRST} select 'cohort' as name, count(*) as missing from first_of where case_id not in (select encounter_id from cohort where encounter_id is not null)
    union all select 'series', count(*) from first_of where case_id not in (select case_id from h5) union all select 'landmark_features', count(*) from first_of where case_id not in (select encounter_id from landmark_features where encounter_id is not null)"""
)
def ref_integrity(spark: SparkSession, folder: str) -> DataFrame:
    others = {"cohort": table(spark, folder, "cohort").select(F.col("encounter_id").alias("case_id")), "series": h5(spark, folder), "landmark_features": table(spark, folder, "landmark_features").select(F.col("encounter_id").alias("case_id"))}
    return keyed.referential(_first(spark, folder), others, "case_id")


@query("select side, count(*) as n from (select case when a.e is null then 'right_only' when b.e is null then 'left_only' else 'both' end as side from (select distinct encounter_id as e from cohort) a full join (select distinct encounter_id as e from map_observations) b on a.e = b.e) group by 1")
def key_audit(spark: SparkSession, folder: str) -> DataFrame:
    return keyed.key_audit(table(spark, folder, "cohort"), table(spark, folder, "map_observations"), "encounter_id")


_SIGN = "concat_ws('|', coalesce(encounter_id, ''), coalesce(patient_id, ''))"


@query(f"select count(*) as n, cast(sum(cast('0x' || substr(sha256({_SIGN}), 1, 8) as bigint)) as bigint) as sum_a, cast(sum(cast('0x' || substr(sha256({_SIGN}), 9, 8) as bigint)) as bigint) as sum_b from cohort")
def cohort_signature(spark: SparkSession, folder: str) -> DataFrame:
    return keyed.signature(table(spark, folder, "cohort"), ["encounter_id", "patient_id"])


_RANGES = {
    "age_years": (18, 100, False), "bmi": (10, 80, True), "asa": (1, 6, True), "t0_map": (20, 65, False), "anesthesia_start_to_t0_min": (3, 30, False), "early_min_map_0_5": (20, 200, False), "early_mean_map_0_5": (20, 200, False),
}
_BINARY = ["male", "t0_arterial_source", "recovered_by_5min"]
_QA_SQL = {
    "values_in_range": "select count(*) from h5 where map not between 20 and 200", "sources_formal": "select count(*) from (select source from h5 union all select source from r1) where source not in ('ART', 'NIBP')",
    "t0_in_search_window": "select count(*) from ev where not (t0 > 3 and t0 <= 30)", "ids_complete": "select count(*) from main where patient_id is null or case_id is null",
    "one_row_per_patient": "select count(*) - count(distinct patient_id) from main", "one_row_per_case": "select count(*) - count(distinct case_id) from lvl",
    "features_without_values": "select " + " + ".join(f"(count({f}) = 0)::int" for f in landmark.FEATURES) + " from main", "binary_features": "select " + " + ".join(f"count(*) filter (where {f} not in (0, 1))" for f in _BINARY) + " from main",
    "features_plausible": "select count(*) from main where " + " or ".join(f"{c} not between {a} and {b}" if null else f"coalesce({c} not between {a} and {b}, true)" for c, (a, b, null) in _RANGES.items()),
    "coarse_labels_on_grid": "select count(*) from h5 where time_min % 5 <> 0", "fine_labels_on_grid": "select count(*) from r1 where time_min % 1 <> 0", "outcome_binary": "select count(*) from main where coalesce(outcome not in (0, 1), true)",
    "cases_in_events": "select count(*) from main where case_id not in (select case_id from ev)", "cases_in_coarse": "select count(*) from main where case_id not in (select case_id from h5)",
    "cases_in_fine": "select count(*) from main where case_id not in (select case_id from r1)", "keys_unchanged": "select 0",
}


@query(f"with {_FIRST}, {_grid_sql('r1', 1)}, main as (select * from first_of where stage2 = 1) " + " union all ".join(f"select '{n}' as name, cast(({q}) as bigint) as violations, (({q}) = 0)::int as passed" for n, q in _QA_SQL.items()))
def pre_model_qa(spark: SparkSession, folder: str) -> DataFrame:
    """Sixteen checks of the series, the events and the model's cases, before any model or event rate is looked at."""
    readings = checkpointed(raw(spark, folder))
    c, f = grid.harmonize(readings, 5.0), grid.harmonize(readings, 1.0)
    every = level(spark, folder, series=c)
    main = checkpointed(keyed.first_per(evaluable(every), "patient_id", ["start_key", "case_id"]).filter("stage2 = 1"))
    events = landmark.find_t0(c)
    count = lambda df, bad, name: df.agg(F.count_if(bad).alias("v")).select(F.lit(name).alias("name"), F.col("v").cast("bigint").alias("violations"))
    one = lambda df, value, name: df.agg(value.cast("bigint").alias("violations")).select(F.lit(name).alias("name"), F.coalesce("violations", F.lit(0)).alias("violations"))
    implausible = F.lit(False)
    for x, (a, b, null) in _RANGES.items():
        implausible = implausible | F.coalesce(~F.col(x).between(a, b), F.lit(not null))
    lacking = lambda other, name: main.select("case_id").join(other.select("case_id").distinct(), "case_id", "left_anti").agg(F.count("*").alias("violations")).select(F.lit(name).alias("name"), "violations")
    both = c.select("source").unionByName(f.select("source"))
    before = keyed.signature(main, ["case_id", "patient_id"]).first()
    parts = [
        count(c, ~F.col("map").between(20, 200), "values_in_range"), count(both, ~F.col("source").isin(*grid.PRIORITY), "sources_formal"), count(events, ~((F.col("t0") > 3) & (F.col("t0") <= 30)), "t0_in_search_window"),
        count(main, F.col("patient_id").isNull() | F.col("case_id").isNull(), "ids_complete"), one(main, F.count("*") - F.count_distinct("patient_id"), "one_row_per_patient"), one(every, F.count("*") - F.count_distinct("case_id"), "one_row_per_case"),
        one(main, sum(((F.count(x) == 0).cast("int") for x in landmark.FEATURES), F.lit(0)), "features_without_values"), one(main, sum((F.count_if(~F.col(x).isin(0.0, 1.0)) for x in _BINARY), F.lit(0)), "binary_features"),
        count(main, implausible, "features_plausible"), count(c, F.pmod(F.col("time_min"), F.lit(5.0)) != 0, "coarse_labels_on_grid"), count(f, F.pmod(F.col("time_min"), F.lit(1.0)) != 0, "fine_labels_on_grid"),
        count(main, F.coalesce(~F.col("outcome").isin(0, 1), F.lit(True)), "outcome_binary"), lacking(events, "cases_in_events"), lacking(c, "cases_in_coarse"), lacking(f, "cases_in_fine"),
        keyed.signature(main, ["case_id", "patient_id"]).select(F.lit("keys_unchanged").alias("name"), (~(F.col("sum_a").eqNullSafe(F.lit(before["sum_a"])) & F.col("n").eqNullSafe(F.lit(before["n"])))).cast("bigint").alias("violations")),
    ]
    return secondary.union_all(parts).withColumn("passed", (F.col("violations") == 0).cast("int"))


# --- scalars


@query(f"select cohort_id, round({_HEIGHT}, 6) as height_m from cohort")
def parse_height(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(table(spark, folder, "cohort").select("cohort_id", parse.parse_height_m(F.col("height_m")).alias("height_m")))


@query(f"select cohort_id, round({_WEIGHT}, 6) as weight_kg from cohort")
def parse_weight(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(table(spark, folder, "cohort").select("cohort_id", parse.parse_weight_kg(F.col("weight_kg")).alias("weight_kg")))


_LABEL = "concat_ws(' | ', coalesce(flo_name, ''), coalesce(flo_display_name, ''))"


@query(
    f"""select flow_id, (regexp_matches({_LABEL}, '{parse.MAP_LABEL}') and not regexp_matches({_LABEL}, '{parse.SUMMARY_LABEL}'))::int as is_map,
    case when regexp_matches({_LABEL}, '{parse.ART_LABEL}') then 'ART' when regexp_matches({_LABEL}, '{parse.NIBP_LABEL}') then 'NIBP' else 'DIRECT' end as source,
    round(try_cast(nullif(regexp_extract(meas_value, '{parse.SINGLE_NUMBER}', 1), '') as double), 6) as value from flowsheet"""
)
def map_label_source(spark: SparkSession, folder: str) -> DataFrame:
    text = parse.label(F.col("flo_name"), F.col("flo_display_name"))
    return rounded(table(spark, folder, "flowsheet").select("flow_id", parse.is_map_label(text).cast("int").alias("is_map"), parse.label_source(text).alias("source"), parse.single_numeric(F.col("meas_value")).alias("value")))


@query(f"select obs_id, {_SOURCE.format('map_source')} as source from map_observations")
def source_tokens(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "map_observations").select("obs_id", parse.source_of_token(F.col("map_source")).alias("source"))


@query(
    """select cohort_id, case when upper(trim(sex)) in ('M', 'MALE') then 'M' when upper(trim(sex)) in ('F', 'FEMALE') then 'F' end as sex, coalesce(lower(cast(emergency as varchar)) in ('1', 'true', 't', 'yes', 'y', 'emergency', 'urgent'), false)::int as emergency,
    sha256('study|case|' || encounter_id) as identifier, regexp_replace(regexp_replace(lower(surgery_type), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') as procedure_name from cohort"""
)
def scalar_rules(spark: SparkSession, folder: str) -> DataFrame:
    c = table(spark, folder, "cohort")
    return c.select("cohort_id", parse.norm_sex(F.col("sex")).alias("sex"), parse.truthy(F.col("emergency").cast("string")).cast("int").alias("emergency"), F.when(F.col("encounter_id").isNotNull(), parse.sha_identifier("study", "case", F.col("encounter_id"))).alias("identifier"), parse.field_norm(F.col("surgery_type")).alias("procedure_name"))


# --- impute, score, split


@query(f"with {_LEVEL} " + " union all ".join(f"select '{f}' as feature, round(median({f}), 6) as median from lvl where feature_evaluable = 1" for f in landmark.FEATURES))
def imputation_medians(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(score.medians(level(spark, folder).filter("feature_evaluable = 1")))


@query(f"with {_SCORED} select case_id, y, round(p, 6) as p from pred")
def score_frozen(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(scored(spark, folder).select("case_id", "y", "p"))


def _simple(f: str) -> str:
    a, b = score.SIMPLE_MODELS[f]
    return f"select 'simple_{f}' as model, case_id, patient_id, y, 1 / (1 + exp(-({a!r} + ({b!r}) * coalesce({f}, {score.MEDIANS[f]!r})))) as p from pred"


_MODELS = f"{_SCORED}, models as (select 'common18' as model, case_id, patient_id, y, p from pred union all {' union all '.join(_simple(f) for f in score.SIMPLE_MODELS)})"


def models(spark: SparkSession, folder: str) -> DataFrame:
    return score.score_models(evaluable(level(spark, folder)).withColumn("y", F.col("outcome"))).select("model", "case_id", "patient_id", "y", "p")




@query(f"with {_FIRST} select case_id, (cast('0x' || substr(sha256('study|update_split|' || patient_id), 1, 8) as bigint) % 2 = 0)::int as update_half from first_of")
def update_split(spark: SparkSession, folder: str) -> DataFrame:
    head = F.conv(F.substring(parse.sha_identifier("study", "update_split", F.col("patient_id")), 1, 8), 16, 10).cast("bigint")
    return _first(spark, folder).select("case_id", (F.pmod(head, F.lit(2)) == 0).cast("int").alias("update_half"))


@query(
    f"""with {_FIRST}, ordered as (select *, row_number() over (partition by outcome order by sha256('7|' || patient_id), case_id) as rn, count(*) over (partition by outcome) as n from first_of) select case_id, outcome, (rn <= floor(0.7 * n))::int as development from ordered"""
)
def split_70_30(spark: SparkSession, folder: str) -> DataFrame:
    # Ranked within classes by the hash: its first 12 bits part a class into pieces of known size, so that no task ranks a class.
    from pyspark.sql import Window

    rows = _first(spark, folder).select("case_id", "outcome", F.sha2(F.concat_ws("|", F.lit("7"), F.col("patient_id")), 256).alias("h")).withColumn("piece", F.substring("h", 1, 3))
    sizes = rows.groupBy("outcome", "piece").agg(F.count("*").alias("c"))
    w = Window.partitionBy("outcome").orderBy("piece")
    sizes = sizes.withColumn("before", F.sum("c").over(w) - F.col("c")).withColumn("n", F.sum("c").over(Window.partitionBy("outcome")))
    ranked = rows.withColumn("rn", F.row_number().over(Window.partitionBy("outcome", "piece").orderBy("h", "case_id"))).join(sizes, ["outcome", "piece"])
    return ranked.select("case_id", "outcome", (F.col("rn") + F.col("before") <= F.floor(0.7 * F.col("n"))).cast("int").alias("development"))


# --- metrics


_BY_P = "by_p as (select model, p, sum(y)::double as pos, sum(1 - y)::double as neg from models group by 1, 2)"


@query(f"with {_MODELS}, {_BY_P}, r as (select *, sum(neg) over (partition by model order by p) - neg / 2 as below from by_p) select model, round(sum(pos * below) / nullif(sum(pos) * sum(neg), 0), 6) as auroc from r group by 1")
def auroc(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(metrics.auroc(models(spark, folder), ["model"]))


_PR = f"{_MODELS}, {_BY_P}, r as (select *, sum(pos) over k as tp, sum(neg) over k as fp, sum(pos) over (partition by model) as total from by_p window k as (partition by model order by p desc))"


@query(f"with {_PR} select model, round(sum(pos * tp / (tp + fp)) / nullif(max(total), 0), 6) as auprc from r group by 1")
def auprc(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(metrics.auprc(models(spark, folder), ["model"]))


@query(f"with {_PR} select model, round(p, 6) as threshold, round(tp / (tp + fp), 6) as precision, round(tp / nullif(total, 0), 6) as recall from r")
def pr_curve(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(metrics.pr_curve(models(spark, folder), ["model"]))


_OVERALL = """select model, count(*) as n, sum(y)::bigint as events, avg((y - p) * (y - p)) as brier, 1 - avg((y - p) * (y - p)) / nullif(avg(y) * (1 - avg(y)), 0) as scaled_brier,
  avg(-(y * ln(greatest(least(p, 1 - 1e-12), 1e-12)) + (1 - y) * ln(1 - greatest(least(p, 1 - 1e-12), 1e-12)))) as log_loss, sum(y) / sum(p) as oe_ratio, sum(y) as o, sum(p) as e from models group by 1"""


@query(f"with {_MODELS}, m as ({_OVERALL}) select model, n, events, {_round('brier scaled_brier log_loss')} from m")
def brier_family(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(metrics.overall(models(spark, folder), ["model"]).select("model", "n", "events", "brier", "scaled_brier", "log_loss"))


@query(f"with {_MODELS}, m as ({_OVERALL}) select model, round(oe_ratio, 6) as oe_ratio, round(case when o > 0 then oe_ratio / exp(1.959963984540054 / sqrt(o)) else 0 end, 6) as oe_lower, round(case when o > 0 then oe_ratio * exp(1.959963984540054 / sqrt(o)) else 3.6888794541139363 / e end, 6) as oe_upper from m")
def oe_ratio(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(metrics.overall(models(spark, folder), ["model"]).select("model", "oe_ratio", "oe_lower", "oe_upper"))


_BINS = f"""{_MODELS}, q as (select model, list_sort(list_distinct(quantile_cont(p, [0, .1, .2, .3, .4, .5, .6, .7, .8, .9, 1]))) as edges from models group by 1),
binned as (select m.*, len(list_filter(list_slice(edges, 2, len(edges) - 1), lambda e: e <= p)) as bin from models m join q using (model))"""


@query(f"with {_BINS} select model, cast(bin as int) as bin, count(*) as n, count(*)::double as weight, round(min(p), 6) as min_p, round(max(p), 6) as max_p, round(avg(p), 6) as mean_p, round(avg(y), 6) as observed, round(abs(avg(y) - avg(p)), 6) as gap from binned group by 1, 2")
def ici_bins(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(metrics.calibration_bins(models(spark, folder), ["model"]))


@query(f"with {_BINS}, b as (select *, avg(y) over (partition by model, bin) as rate from binned) select model, round(avg(abs(rate - p)), 6) as ici from b group by 1")
def ici(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(metrics.ici(models(spark, folder), ["model"]))


@query(f"with {_MODELS}, {_BY_P} select model, round(sum((pos + neg) * abs(pos / (pos + neg) - p)) / sum(pos + neg), 6) as score_group_error from by_p group by 1")
def score_group_error(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(metrics.score_group_error(models(spark, folder), ["model"]))


def _threshold_sql(thresholds: list[float]) -> str:
    return f"""{_MODELS}, w as (select model, threshold, count(*)::double as n, count(*) filter (where p >= threshold and y = 1)::double as tp, count(*) filter (where p >= threshold and y = 0)::double as fp,
  count(*) filter (where p < threshold and y = 1)::double as fn, count(*) filter (where p < threshold and y = 0)::double as tn, count(distinct patient_id) filter (where p >= threshold) as patients_alerted,
  count(distinct patient_id) filter (where p >= threshold and y = 1) as patients_captured from models, (select unnest([{", ".join(map(repr, thresholds))}])::double as threshold) group by 1, 2),
nb as (select *, tp / n - fp / n * threshold / (1 - threshold) as net_benefit, (tp + fn) / n - (fp + tn) / n * threshold / (1 - threshold) as net_benefit_all from w)"""


@query(
    f"""with {_threshold_sql(CLINICAL)} select model, threshold, n, tp + fp as alerts, round((tp + fp) / n, 6) as alert_rate, tp, fp, fn, tn, round(tp / nullif(tp + fn, 0), 6) as sensitivity, round(tn / nullif(tn + fp, 0), 6) as specificity,
    round(tp / nullif(tp + fp, 0), 6) as ppv, round(tn / nullif(tn + fn, 0), 6) as npv, round((tp + fp) / nullif(tp, 0), 6) as alerts_per_tp, patients_alerted, patients_captured from nb"""
)
def workload(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(metrics.workload(models(spark, folder), CLINICAL, ["model"]).drop("net_benefit", "net_benefit_all", "standardised_net_benefit", "avoided_per_100"))


_DCA = "select model, threshold, round(net_benefit, 6) as net_benefit, round(net_benefit_all, 6) as net_benefit_all, round(net_benefit / nullif((tp + fn) / n, 0), 6) as standardised_net_benefit, round(100 * (net_benefit - net_benefit_all) / (threshold / (1 - threshold)), 6) as avoided_per_100 from nb"
_DCA_COLUMNS = ["model", "threshold", "net_benefit", "net_benefit_all", "standardised_net_benefit", "avoided_per_100"]


@query(f"with {_threshold_sql(CLINICAL)} {_DCA}")
def decision_curve(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(metrics.workload(models(spark, folder), CLINICAL, ["model"], patient=None).select(*_DCA_COLUMNS))


_FULL = [k / 100 for k in range(5, 51)]


@query(f"with {_threshold_sql(_FULL)} {_DCA}")
def dca_grid(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(metrics.workload(models(spark, folder), _FULL, ["model"], patient=None).select(*_DCA_COLUMNS))


@query(
    f"""with {_SCORED}, strat as (select threshold, y, (stage1_alert = 1 or p >= threshold) as a from pred, (select unnest([{", ".join(map(repr, CLINICAL))}])::double as threshold))
    select threshold, count(*) as n, count(*) filter (where a) as alerts, count(*) filter (where a and y = 1) as tp, round(count(*) filter (where a and y = 1) / count(*) - count(*) filter (where a and y = 0) / count(*) * threshold / (1 - threshold), 6) as net_benefit from strat group by 1"""
)
def two_stage_point(spark: SparkSession, folder: str) -> DataFrame:
    rows = scored(spark, folder).withColumn("p", F.when(F.col("stage1_alert") == 1, 1.0).otherwise(F.col("p")))
    w = metrics.workload(rows, CLINICAL, patient=None)
    return rounded(w.select("threshold", F.col("n").cast("bigint").alias("n"), F.col("alerts").cast("bigint").alias("alerts"), F.col("tp").cast("bigint").alias("tp"), "net_benefit"))


@query(f"with {_SCORED}, s as (select list_sort(list(p)) as ps, count(*) as n from pred) select fraction, round(ps[cast(ceil(round((n - 1) * (1 - fraction), 9)) as bigint) + 1], 6) as threshold from s, (select unnest([0.1, 0.2, 0.3])::double as fraction)")
def capacity_threshold(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(metrics.capacity_thresholds(scored(spark, folder), [0.1, 0.2, 0.3]))


@query(f"with {_SCORED}, top as (select * from pred qualify row_number() over (order by p desc, case_id) <= (select count(*) from pred where landmark_map < 65)) select count(*) as k, sum(y)::bigint as events from top")
def topk_capacity(spark: SparkSession, folder: str) -> DataFrame:
    """As many cases as the landmark rule alerts, those with the highest scores."""
    rows = checkpointed(scored(spark, folder).select("case_id", "y", "p", "landmark_map"))
    k = rows.filter(F.col("landmark_map") < 65).count()
    return metrics.top_k(rows, k, "case_id").agg(F.count("*").alias("k"), F.sum("y").cast("bigint").alias("events"))


# --- comparisons


_MASKS = {
    "younger_65": "age_years < 65", "from_65": "age_years >= 65", "female": "male = 0", "male": "male = 1", "asa_1_2": "asa <= 2", "asa_3_up": "asa >= 3", "bmi_below_25": "bmi < 25", "bmi_25_to_30": "bmi >= 25 and bmi < 30", "bmi_from_30": "bmi >= 30",
    "arterial": "t0_arterial_source = 1", "cuff": "t0_arterial_source = 0", "early_t0": "t0 <= 10", "late_t0": "t0 > 10", "bmi_known": "bmi is not null", "bmi_missing": "bmi is null",
}


@query(f"with {_SCORED} select * from (" + " union all ".join(f"select '{g}' as subgroup, count(*) as n, sum(y)::bigint as events, (count(*) >= 100 and sum(y) >= 20 and count(*) - sum(y) >= 20)::int as estimable from pred where {m}" for g, m in _MASKS.items()) + ") where n > 0")
def subgroups(spark: SparkSession, folder: str) -> DataFrame:
    return secondary.subgroups(scored(spark, folder), {g: F.expr(m) for g, m in _MASKS.items()})


def _drift_sql() -> str:
    parts = []
    for f in landmark.FEATURES:
        parts.append(
            f"""select '{f}' as feature, a.m as mean_a, a.s as sd_a, b.m as mean_b, b.s as sd_b, (b.m - a.m) / nullif(sqrt((a.s * a.s + b.s * b.s) / 2), 0) as smd, a.x as missing_pct_a, b.x as missing_pct_b,
            (select 100.0 * count(*) filter (where {f} < a.q[1] or {f} > a.q[2]) / nullif(count({f}), 0) from right_of) as outside_pct
            from (select avg({f}) as m, stddev_samp({f}) as s, 100.0 * (count(*) - count({f})) / count(*) as x, quantile_cont({f}, [0.01, 0.99]) as q from left_of) a, (select avg({f}) as m, stddev_samp({f}) as s, 100.0 * (count(*) - count({f})) / count(*) as x from right_of) b"""
        )
    return f"with {_LEVEL}, left_of as (select * from lvl where feature_evaluable = 1 and outcome_evaluable = 1), right_of as (select * from lvl where feature_evaluable = 1 and outcome_evaluable = 0), d as ({' union all '.join(parts)}) select feature, {_round('mean_a sd_a mean_b sd_b smd missing_pct_a missing_pct_b outside_pct')} from d"


@query(_drift_sql())
def drift(spark: SparkSession, folder: str) -> DataFrame:
    known = level(spark, folder).filter("feature_evaluable = 1")
    return rounded(secondary.drift(known.filter("outcome_evaluable = 1"), known.filter("outcome_evaluable = 0"), landmark.FEATURES))


_AGREE = f"{_CELLS}, pairs as (select b.case_id, b.outcome as a, f.outcome as b from base b join fine f using (case_id) where b.outcome is not null and f.outcome is not null), t as (select count(*) as n, count(*) filter (where a = 0 and b = 0) as n00, count(*) filter (where a = 0 and b = 1) as n01, count(*) filter (where a = 1 and b = 0) as n10, count(*) filter (where a = 1 and b = 1) as n11 from pairs)"


def _pairs(spark: SparkSession, folder: str) -> DataFrame:
    base = landmark.windows(h5(spark, folder, 60.0)).join(cases(spark, folder), "case_id").filter("feature_evaluable = 1 and outcome_evaluable = 1 and stage2 = 1")
    fine = landmark.windows(r1(spark, folder, 60.0), base.select("case_id", "t0"), landmark.FINE)
    return base.select("case_id", F.col("outcome").alias("a")).join(fine.select("case_id", F.col("outcome").alias("b")), "case_id")


@query(
    f"""with {_AGREE} select n, n00, n01, n10, n11, round(2 * n11 / nullif(2 * n11 + n01 + n10, 0), 6) as positive_agreement, round(2 * n00 / nullif(2 * n00 + n01 + n10, 0), 6) as negative_agreement, round((n00 + n11) / nullif(n, 0), 6) as overall_agreement,
    round(((n00 + n11) / nullif(n, 0) - ((n10 + n11) * (n01 + n11) + (n00 + n01) * (n00 + n10)) / nullif(n * n, 0)) / nullif(1 - ((n10 + n11) * (n01 + n11) + (n00 + n01) * (n00 + n10)) / nullif(n * n, 0), 0), 6) as kappa from t"""
)
def agreement(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(secondary.agreement(_pairs(spark, folder), "a", "b"))


@query(
    f"""with {_MODELS}, two as (select case_id, max(p) filter (where model = 'common18') as a, max(p) filter (where model = 'simple_early_mean_map_0_5') as b from models group by 1),
    ranked as (select *, rank() over (order by a) + (count(*) over (partition by a) - 1) / 2 as ra, rank() over (order by b) + (count(*) over (partition by b) - 1) / 2 as rb from two)
    select count(*) as n, round(avg(b - a), 6) as mean_difference, round(avg(abs(b - a)), 6) as mean_abs_difference, round(corr(a, b), 6) as pearson, round(corr(ra, rb), 6) as spearman from ranked"""
)
def prediction_shift(spark: SparkSession, folder: str) -> DataFrame:
    two = models(spark, folder).groupBy("case_id").pivot("model", ["common18", "simple_early_mean_map_0_5"]).agg(F.max("p"))
    return rounded(secondary.prediction_shift(two.select("case_id", F.col("common18").alias("a"), F.col("simple_early_mean_map_0_5").alias("b")), "a", "b"))


_SENS = {"persistent_15": dict(persistent_after=15.0), "auc_50": dict(high_burden_auc=50.0), "map_60": dict(threshold=60.0), "complete": dict(least_points=6, largest_gap=5.0)}


@query(
    f"with {_H5}, {_t0_sql('ev', 'h5')}, {_windows_sql('win', 'h5', 'ev')}, "
    + ", ".join(_windows_sql(f"s{k}", "h5", "ev", landmark.Windows(**kw)) for k, kw in enumerate(_SENS.values()))
    + " "
    + " union all ".join(
        f"select '{name}' as variant, count(*) as n, count(*) filter (where a.outcome = 1 and b.outcome = 1) as both, count(*) filter (where a.outcome = 1 and b.outcome = 0) as only_first, count(*) filter (where a.outcome = 0 and b.outcome = 1) as only_second, count(*) filter (where a.outcome = 0 and b.outcome = 0) as neither from win a join s{k} b using (case_id) where a.outcome is not null and b.outcome is not null"
        for k, name in enumerate(_SENS)
    )
)
def reclassification(spark: SparkSession, folder: str) -> DataFrame:
    series = h5(spark, folder, 60.0)
    base = landmark.windows(series)
    events = base.select("case_id", "t0")
    parts = []
    for name, kw in _SENS.items():
        other = landmark.windows(series, events, landmark.Windows(**kw)).select("case_id", F.col("outcome").alias("other"))
        parts.append(secondary.reclassification(base.join(other, "case_id"), "outcome", "other").select(F.lit(name).alias("variant"), "*"))
    return secondary.union_all(parts)


@query(f"with {_LEVEL} select count(*) as n, count(*) filter (where persistent = 1 and high_burden = 0) as persistent_only, count(*) filter (where persistent = 0 and high_burden = 1) as burden_only, count(*) filter (where persistent = 1 and high_burden = 1) as both, count(*) filter (where persistent = 0 and high_burden = 0) as neither from lvl where outcome_evaluable = 1")
def endpoint_components(spark: SparkSession, folder: str) -> DataFrame:
    p, b = F.col("persistent") == 1, F.col("high_burden") == 1
    return level(spark, folder).filter("outcome_evaluable = 1").agg(F.count("*").alias("n"), F.count_if(p & ~b).alias("persistent_only"), F.count_if(~p & b).alias("burden_only"), F.count_if(p & b).alias("both"), F.count_if(~p & ~b).alias("neither"))


@query(
    f"with {_RAW}, {_CASES}, "
    + ", ".join(f"{_grid_sql(f'g{k}', 5, k)}, {_t0_sql(f'e{k}', f'g{k}')}, {_windows_sql(f'w{k}', f'g{k}', f'e{k}')}" for k in range(5))
    + " "
    + " union all ".join(f"select {k} as phase, count(*) as n, count(*) filter (where outcome = 1) as events from w{k} join cases using (case_id) where duration_min >= t0 + 30 and feature_evaluable = 1 and outcome_evaluable = 1 and stage2 = 1" for k in range(5))
)
def sensitivity_flow(spark: SparkSession, folder: str) -> DataFrame:
    parts, readings = [], checkpointed(raw(spark, folder, 60.0))
    for k in range(5):
        rows = evaluable(level(spark, folder, series=grid.harmonize(readings, 5.0, float(k)))).filter("stage2 = 1")
        parts.append(rows.agg(F.count("*").alias("n"), F.count_if(F.col("outcome") == 1).alias("events")).select(F.lit(k).alias("phase"), "n", "events"))
    return secondary.union_all(parts)


@query(f"with {_LEVEL}, e as (select patient_id, count(*) as n from lvl where feature_evaluable = 1 and outcome_evaluable = 1 and patient_id is not null group by 1) select count(*) as patients, sum(n)::bigint as operations, count(*) filter (where n > 1) as patients_with_more from e")
def all_operations(spark: SparkSession, folder: str) -> DataFrame:
    per = evaluable(level(spark, folder)).filter("patient_id is not null").groupBy("patient_id").agg(F.count("*").alias("n"))
    return per.agg(F.count("*").alias("patients"), F.sum("n").alias("operations"), F.count_if(F.col("n") > 1).alias("patients_with_more"))


_TARGET = f"{_FIRST}, target as (select * from lvl where feature_evaluable = 1 and stage2 = 1 and patient_id is not null qualify row_number() over (partition by patient_id order by start_key, case_id) = 1)"


def _target(spark: SparkSession, folder: str) -> DataFrame:
    return keyed.first_per(level(spark, folder).filter("feature_evaluable = 1 and stage2 = 1"), "patient_id", ["start_key", "case_id"])


@query(f"with {_TARGET} select patient_id, case_id, outcome_evaluable from target")
def ipw_target(spark: SparkSession, folder: str) -> DataFrame:
    return _target(spark, folder).select("patient_id", "case_id", "outcome_evaluable")


@query(
    f"""with {_TARGET}, s2 as (select * from first_of where stage2 = 1) select count(*) filter (where a.patient_id is not null and b.patient_id is not null) as shared, count(*) filter (where a.case_id = b.case_id) as same_row,
    count(*) filter (where a.case_id <> b.case_id) as replaced, count(*) filter (where b.patient_id is null) as only_first, count(*) filter (where a.patient_id is null) as only_second from target a full join s2 b on a.patient_id = b.patient_id"""
)
def target_overlap(spark: SparkSession, folder: str) -> DataFrame:
    return secondary.overlap(_target(spark, folder), _first(spark, folder).filter("stage2 = 1"), "patient_id", "case_id")


@query(f"with {_SCORED} " + " union all ".join(f"select '{f}' as feature, y, count({f}) as n, count(*) - count({f}) as missing_n, round(avg({f}), 6) as mean, round(stddev_samp({f}), 6) as sd from pred group by y" for f in landmark.FEATURES))
def table1(spark: SparkSession, folder: str) -> DataFrame:
    rows = scored(spark, folder).select("y", F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("v")) for f in landmark.FEATURES])).alias("r")).select("y", "r.feature", "r.v")
    return rounded(rows.groupBy("feature", "y").agg(F.count("v").alias("n"), F.count_if(F.col("v").isNull()).alias("missing_n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("sd")))


@query(f"with {_SCORED} select count(*) as n, count(*) filter (where landmark_map < 65) as alerts, count(*) filter (where landmark_map < 65 and y = 1) as tp from pred")
def landmark_rule(spark: SparkSession, folder: str) -> DataFrame:
    a = F.col("landmark_map") < 65
    return scored(spark, folder).agg(F.count("*").alias("n"), F.count_if(a).alias("alerts"), F.count_if(a & (F.col("y") == 1)).alias("tp"))


# --- iterative and resampled, without SQL


def _design(spark: SparkSession, folder: str) -> DataFrame:
    df = evaluable(level(spark, folder)).withColumn("y", F.col("outcome"))
    return checkpointed(score.impute(df.select("case_id", "patient_id", "y", *landmark.FEATURES)))


@query()
def ridge_fit(spark: SparkSession, folder: str) -> DataFrame:
    """All features, at the penalty that cross-validation chooses."""
    features, design = list(landmark.FEATURES), _design(spark, folder)
    r = fit.ridge_logistic(design, features, fit.ridge_cv(design, features, PENALTIES)[1])
    rows = [("intercept", r.intercept)] + list(zip(features, map(float, r.coefficients)))
    return spark.createDataFrame([(n, round(float(v), 6)) for n, v in rows], "term string, coefficient double")


@query()
def ridge_cv(spark: SparkSession, folder: str) -> DataFrame:
    rows, best = fit.ridge_cv(_design(spark, folder), list(landmark.FEATURES), PENALTIES)
    return spark.createDataFrame([(r["l2"], r["mean_log_loss"], int(r["l2"] == best)) for r in rows], "l2 double, mean_log_loss double, chosen int")


def _newton_sql(rows: str, groups: str = "model") -> str:
    """newton: groups, c (in the large), a and b (intercept and slope), from Newton steps over distinct scores of ``rows``."""
    clip = "greatest(least(p, 1 - 1e-12), 1e-12)"
    cap = lambda x: f"greatest(-2.0, least(2.0, {x}))"
    return f"""pts as (select {groups}, ln({clip}) - ln(1 - {clip}) as lp, sum(y)::double as pos, count(*)::double as n from {rows} group by all),
steps as (select {groups}, 0 as k, 0.0::double as c, 0.0::double as a, 1.0::double as b, 1.0::double as hc, 1.0::double as h00, 0.0::double as h01, 1.0::double as h11 from (select distinct {groups} from pts)
  union all select {groups}, k + 1, c - {cap("gc / nullif(hc2, 0)")}, a - da * least(1.0, 2.0 / greatest(abs(da), abs(db), 1e-300)), b - db * least(1.0, 2.0 / greatest(abs(da), abs(db), 1e-300)), hc2, x00, x01, x11 from (
    select *, (x11 * g0 - x01 * g1) / nullif(x00 * x11 - x01 * x01, 0) as da, (x00 * g1 - x01 * g0) / nullif(x00 * x11 - x01 * x01, 0) as db from (
      select {groups}, k, c, a, b, sum(n * qc - pos) as gc, sum(n * qc * (1 - qc)) as hc2, sum(n * q - pos) as g0, sum((n * q - pos) * lp) as g1, sum(n * q * (1 - q)) as x00, sum(n * q * (1 - q) * lp) as x01, sum(n * q * (1 - q) * lp * lp) as x11
      from (select w.*, lp, pos, n, 1 / (1 + exp(-(w.c + lp))) as qc, 1 / (1 + exp(-(w.a + w.b * lp))) as q from steps w join pts using ({groups})) group by {groups}, k, c, a, b)) where k < 40),
newton as (select * from steps where k = 40)"""


@query(f"with recursive {_MODELS}, {_newton_sql('models')} select model, round(c, 6) as citl, round(1 / sqrt(hc), 6) as citl_se from newton")
def citl(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(performance.calibration(models(spark, folder), ["model"]).select("model", "citl", "citl_se"))


@query(f"with recursive {_MODELS}, {_newton_sql('models')} select model, round(a, 6) as intercept, round(b, 6) as slope, round(sqrt(h00 / (h00 * h11 - h01 * h01)), 6) as slope_se from newton")
def cal_slope(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(performance.calibration(models(spark, folder), ["model"]).select("model", "intercept", "slope", "slope_se"))


@query()
def rcs_curve(spark: SparkSession, folder: str) -> DataFrame:
    return spark.createDataFrame(fit.calibration_curve(checkpointed(scored(spark, folder).select("y", "p"))), "predicted double, observed double")


@query()
def bootstrap_ci(spark: SparkSession, folder: str) -> DataFrame:
    return resample.bootstrap(models(spark, folder).select("model", "patient_id", "y", "p"), ["model"], replicates=REPLICATES, metrics=resample.PAIRED)


_HALF = "(cast('0x' || substr(sha256('study|update_split|' || patient_id), 1, 8) as bigint) % 2 = 0)"
_LP = "(ln(greatest(least(p, 1 - 1e-12), 1e-12)) - ln(1 - greatest(least(p, 1 - 1e-12), 1e-12)))"


@query(
    f"""with recursive {_SCORED}, up as (select 'all' as model, y, p from pred where {_HALF}), held as (select * from pred where not {_HALF}), {_newton_sql("up")},
    models as (select 'none' as model, y, p from held union all select 'intercept', y, 1 / (1 + exp(-({_LP} + c))) from held, newton union all select 'intercept_slope', y, 1 / (1 + exp(-({_LP} * b + a))) from held, newton),
    m as ({_OVERALL}) select model as state, n, events, {_round("brier scaled_brier log_loss oe_ratio")} from m"""
)
def recalibrate(spark: SparkSession, folder: str) -> DataFrame:
    """Intercept, then intercept and slope, fitted on one half of the patients and evaluated on the other."""
    head = F.conv(F.substring(parse.sha_identifier("study", "update_split", F.col("patient_id")), 1, 8), 16, 10).cast("bigint")
    rows = checkpointed(scored(spark, folder).select("patient_id", "y", "p", (F.pmod(head, F.lit(2)) == 0).alias("half")))
    up, held = rows.filter("half"), rows.filter("not half")
    c = performance.calibration(up).first()
    if c is None or c["citl"] is None or c["slope"] is None:
        raise ValueError("the update half has no calibration: one class, one score or no convergence")
    lp = parse.logit(F.col("p"))
    both = [held.withColumn("state", F.lit("none")), held.withColumn("p", parse.sigmoid(lp + c["citl"])).withColumn("state", F.lit("intercept")), held.withColumn("p", parse.sigmoid(lp * c["slope"] + c["intercept"])).withColumn("state", F.lit("intercept_slope"))]
    return rounded(metrics.overall(secondary.union_all(both), ["state"]).select("state", "n", "events", "brier", "scaled_brier", "log_loss", "oe_ratio"))


def weighted_target(spark: SparkSession, folder: str) -> DataFrame:
    """The target cases with ``w``: the inverse of the modelled chance (kept within 0.01 to 0.99) to be evaluable, cut at its 1st and 99th percentile."""
    features = [f for f in landmark.FEATURES if f != "early_map_record_count_0_5"]
    target = _target(spark, folder)
    rows = checkpointed(score.score(score.impute(target.select("case_id", "patient_id", "outcome_evaluable", "outcome", *landmark.FEATURES))).withColumn("y", F.col("outcome_evaluable")))
    r = fit.ridge_logistic(rows, features, 0.1)
    z = F.lit(r.intercept)
    for f, b in zip(features, r.coefficients):
        z = z + F.lit(float(b)) * F.col(f)
    weighted = rows.withColumn("w", 1 / F.greatest(F.least(parse.sigmoid(z), F.lit(0.99)), F.lit(0.01)))
    q = metrics.quantiles(weighted.filter("y = 1"), [], "w", [0.01, 0.99]).first()
    low, high = q["q"] if q else (0.0, 1.0)
    return weighted.withColumn("w", F.greatest(F.least(F.col("w"), F.lit(high)), F.lit(low)))


@query()
def ipw_balance(spark: SparkSession, folder: str) -> DataFrame:
    """Standardised differences before and after weighting evaluable cases by the inverse of their modelled chance to be so."""
    features = tuple(f for f in landmark.FEATURES if f != "early_map_record_count_0_5")
    return secondary.weighted_balance(weighted_target(spark, folder), features, "y", "w")


@query()
def ipw_weights(spark: SparkSession, folder: str) -> DataFrame:
    """n, selected, the sum, least and largest weight of the selected, and their effective number (sum squared over sum of squares)."""
    s = F.col("y") == 1
    w = F.when(s, F.col("w"))
    return rounded(weighted_target(spark, folder).agg(F.count("*").alias("n"), F.count_if(s).alias("selected"), F.sum(w).alias("sum_w"), F.min(w).alias("min_w"), F.max(w).alias("max_w"), F.try_divide(F.sum(w) * F.sum(w), F.sum(w * w)).alias("effective_n")))


@query()
def weighted_performance(spark: SparkSession, folder: str) -> DataFrame:
    """All metrics of the evaluable target cases without and with the inverse weights."""
    rows = checkpointed(weighted_target(spark, folder).filter("y = 1").select(F.col("outcome").alias("y"), "p", "w"))
    one = performance.point_performance(rows).withColumn("weights", F.lit("none"))
    return rounded(one.unionByName(performance.point_performance(rows, weight="w").withColumn("weights", F.lit("inverse_chance"))))


_CELL = {(f, o): f"{f}_input_{o}_outcome" for f in ("coarse", "fine") for o in ("coarse", "fine")}


def _effects() -> dict[str, dict[str, float]]:
    """Differences of features at each outcome, of outcomes at each kind of features, their means, and the interaction."""
    c = _CELL
    at = {(f, o): {c[f, o]: 1.0} for f, o in c}
    minus = lambda x, y, w=1.0: {**{k: w * v for k, v in x.items()}, **{k: -w * v for k, v in y.items()}}
    out = {f"feature_at_{o}_outcome": minus(at["fine", o], at["coarse", o]) for o in ("coarse", "fine")}
    out |= {f"outcome_at_{f}_features": minus(at[f, "fine"], at[f, "coarse"]) for f in ("coarse", "fine")}
    for name in ("feature", "outcome"):
        out[f"marginal_{name}"] = {k: v / 2 for key, e in out.items() if key.startswith(f"{name}_at_") for k, v in e.items()}
    out["interaction"] = {c["fine", "fine"]: 1.0, c["coarse", "fine"]: -1.0, c["fine", "coarse"]: -1.0, c["coarse", "coarse"]: 1.0}
    return out


@query()
def factorial_2x2(spark: SparkSession, folder: str) -> DataFrame:
    """Effects of the grid of the features and of the outcome on each metric, over cases that are complete in all four cells."""
    readings = checkpointed(raw(spark, folder, 60.0))
    coarse, fine = (grid.harmonize(readings, width).filter("time_min <= 60") for width in (5.0, 1.0))
    base = checkpointed(landmark.windows(coarse).join(cases(spark, folder), "case_id").filter("feature_evaluable = 1 and outcome_evaluable = 1 and stage2 = 1"))
    other = checkpointed(landmark.windows(fine, base.select("case_id", "t0"), landmark.FINE).filter("feature_evaluable = 1 and outcome_evaluable = 1"))
    static = base.select("case_id", "patient_id", *landmark.FEATURES[:4])
    p = {"coarse": score.score(base).select("case_id", "patient_id", "p"), "fine": score.score(other.join(static, "case_id")).select("case_id", "patient_id", "p")}
    y = {"coarse": base.select("case_id", F.col("outcome").alias("y")).join(other.select("case_id"), "case_id", "left_semi"), "fine": other.select("case_id", F.col("outcome").alias("y"))}
    rows = checkpointed(secondary.union_all([p[f].join(y[o], "case_id").withColumn("cell", F.lit(_CELL[f, o])) for f, o in _CELL]))
    return resample.contrasts(rows, "cell", _effects(), replicates=REPLICATES, metrics=resample.FACTORIAL)


@query()
def two_stage_boot(spark: SparkSession, folder: str) -> DataFrame:
    rows = scored(spark, folder).withColumn("p", F.when(F.col("stage1_alert") == 1, 1.0).otherwise(F.col("p")))
    return resample.bootstrap_thresholds(rows.select("patient_id", "y", "p"), CLINICAL, replicates=REPLICATES, names=tuple(resample.THRESHOLD))


_PLAN = f"""with recursive {_SCORED}, lps as (select {_LP} as lp from pred), shifts as (select 0 as k, 0.0::double as a union all select k + 1, a - (m - 0.12) / d from (
    select k, a, avg(1 / (1 + exp(-(lp + a)))) as m, avg(1 / (1 + exp(-(lp + a))) * (1 - 1 / (1 + exp(-(lp + a))))) as d from shifts, lps group by k, a) where k < 50),
  rows as (select lp, 1 / (1 + exp(-(lp + a))) as q from lps, shifts where k = 50), odds as (select 0.15 / 0.85 as o),
  m as (select avg(q * (1 - q)) as a, avg(q * (1 - q) * lp) as b, avg(q * (1 - q) * lp * lp) as c, avg((q >= 0.15)::int * q * (1 - q) * (1 + o) * (1 + o)) as within_, coalesce(var_samp((q >= 0.15)::int * (q - (1 - q) * o)), 0) as between_ from rows, odds),
  widths as (select n, pos, n - pos as neg, 0.7 / 1.3 as x, 2 * 0.49 / 1.7 as y from (select n, greatest(2, round(n * 0.12)) as pos from range(200, 100000) t(n))),
  sizes as (select ceil(power(2 * 1.96 * sqrt(a / (a * c - b * b)) / 0.2, 2))::bigint as slope, ceil(ceil(greatest(power(1.96 / ln(1.1), 2), power(1.96 / ln(0.9), 2))) / 0.12)::bigint as oe,
    (select min(n) from widths where 2 * 1.96 * sqrt((0.21 + (pos - 1) * (x - 0.49) + (neg - 1) * (y - 0.49)) / (pos * neg)) <= 0.05) as auc, within_, between_ from m)
  select 'calibration_slope' as target, slope as required_n, null::double as width from sizes union all select 'observed_to_expected', oe, null from sizes union all select 'auroc', auc, null from sizes union all select 'largest', greatest(slope, oe, auc), null from sizes
  union all select 'net_benefit_width_at_largest', greatest(slope, oe, auc), round(2 * 1.96 * sqrt((within_ + between_) / greatest(slope, oe, auc)), 6) from sizes"""


@query(_PLAN)
def precision_plan(spark: SparkSession, folder: str) -> DataFrame:
    return spark.createDataFrame(planning.precision_plan(checkpointed(scored(spark, folder).select("p"))), "target string, required_n bigint, width double")
