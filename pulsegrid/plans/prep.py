"""Queries of the data-preparation operators of the core, with SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.operators import hotdeck, implausible, instants, regular_grid, rejects, units
from pulsegrid.sources.tables import table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    parsed = rejects.parse_records(table(spark, folder, "flowsheet_lines").select("line_id", "raw_line"), "raw_line")
    return rejects.rejected(parsed).select("line_id", "reason")


def p1_rows(spark: SparkSession, folder: str) -> DataFrame:
    parsed = rejects.parse_records(table(spark, folder, "flowsheet_lines").select("line_id", "raw_line"), "raw_line")
    return rejects.loaded(parsed).select("line_id", *[f.lower() for f in rejects.FLOWSHEET_FIELDS])


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    grid = regular_grid.fill_grid(table(spark, folder, "cohort"), table(spark, folder, "map_observations"))
    return regular_grid.empty_cells(grid).select("encounter_id", "time_min")


def p2_grid(spark: SparkSession, folder: str) -> DataFrame:
    readings = units.reading_units(table(spark, folder, "map_observations"))
    grid = regular_grid.fill_grid(table(spark, folder, "cohort"), readings, value="value_mmhg")
    return grid.select("encounter_id", "time_min", "status", "n_readings", F.round("value", 4).alias("value_mmhg"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return hotdeck.marked(hotdeck.hot_deck(table(spark, folder, "landmark_features"))).select("feature_id", "field_name")


def p3_filled(spark: SparkSession, folder: str) -> DataFrame:
    fills = hotdeck.hot_deck(table(spark, folder, "landmark_features"))
    return fills.select("feature_id", "field_name", "value", "donor_id", F.round("distance", 6).alias("distance"), F.col("level").cast("int").alias("level"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return implausible.flag_readings(table(spark, folder, "map_observations")).select("obs_id", "kind")


def p4_limits(spark: SparkSession, folder: str) -> DataFrame:
    """Those flags that rules of single values and runs decide, without the forest."""
    return p4_found(spark, folder).filter("kind <> 'spike'")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return instants.restated_instants(table(spark, folder, "cohort"), table(spark, folder, "map_observations"), table(spark, folder, "sites"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return units.foreign_units(table(spark, folder, "cohort"), table(spark, folder, "map_observations"), table(spark, folder, "sites"))


def p6_sizes(spark: SparkSession, folder: str) -> DataFrame:
    sizes = units.cohort_sizes(table(spark, folder, "cohort"), table(spark, folder, "sites"))
    return sizes.select("row_id", "quantity", "unit_code", "unit_from", F.round("value", 4).alias("value"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p1_found, p1_rows, p2_found, p2_grid, p3_found, p3_filled, p4_found, p4_limits, p5_found, p6_found, p6_sizes)}

_FIELD = r"""("(?:[^"]|"")*"|[^",\r\n]*)"""
_NUMBER = r"[+-]?(?:\d+(?:\.\d*)?|\.\d+)"
_LINES = rf"""
with raw as (select line_id, regexp_replace(coalesce(raw_line, ''), '\r?\n?$', '') as t from flowsheet_lines),
shaped as (
  select line_id, t, regexp_full_match(t, '{_FIELD}(?:,{_FIELD})*') as well,
    length(regexp_replace(t, '"(?:[^"]|"")*"', '', 'g')) - length(replace(regexp_replace(t, '"(?:[^"]|"")*"', '', 'g'), ',', '')) + 1 as n,
    regexp_extract(t, '^{",".join([_FIELD] * 8)}$', ['a1','a2','a3','a4','a5','a6','a7','a8']) as f
  from raw where not regexp_full_match(t, '\s*')
),
bare as (
  select line_id, well, n, [case when x like '"%' then replace(substr(x, 2, length(x) - 2), '""', '"') else x end for x in [f.a1, f.a2, f.a3, f.a4, f.a5, f.a6, f.a7, f.a8]] as v
  from shaped
),
timed as (
  select *, trim(v[6]) as ts from bare
  where not coalesce(n = 8 and upper(trim(v[1])) = 'LOG_ID' and upper(trim(v[2])) = 'MRN' and upper(trim(v[6])) = 'RECORDED_TIME' and upper(trim(v[7])) = 'MEAS_VALUE', false)
),
judged as (
  select line_id, v, case
    when not well then 'quoting'
    when n <> 8 then 'column_count'
    when not regexp_full_match(v[7], '(?i)\s*(?:{_NUMBER}\s*(?:mm ?hg|kpa|cmh2o)?|{_NUMBER}\s*/\s*{_NUMBER})\s*') then 'meas_value'
    when not coalesce(
      (regexp_full_match(ts, '\d{{4}}-\d{{2}}-\d{{2}}[ T]\d{{2}}:\d{{2}}:\d{{2}}(\.\d+)?\s*(Z|[+-]\d{{2}}:?(\d{{2}})?)?')
        and try_strptime(replace(substr(ts, 1, 19), 'T', ' '), '%Y-%m-%d %H:%M:%S') is not null)
      or (regexp_full_match(ts, '(?i)\d{{1,2}}/\d{{1,2}}/\d{{4}} \d{{1,2}}:\d{{2}} ?[AP]M')
        and try_strptime(upper(regexp_replace(ts, ' ?([AaPp][Mm])$', ' \1')), '%-m/%-d/%Y %-I:%M %p') is not null), false) then 'recorded_time'
    end as reason
  from timed
)
"""
_UNIT_ROWS = r"""stated as (
  select obs_id, encounter_id as e, coalesce(encounter_id, '') as ek, coalesce(map_source, '') as sk, minute_from_anesthesia_start as m, map_value as v, coalesce(
    case when regexp_matches(lower(raw_unit), 'mm ?\[?hg') then 'mmhg' when regexp_matches(lower(raw_unit), 'kpa|kilopascal') then 'kpa' when regexp_matches(lower(raw_unit), 'cm ?\[?h2o') then 'cmh2o' when regexp_matches(lower(raw_unit), 'hpa|hectopascal') then 'hpa' end,
    case when regexp_matches(lower(raw_display_name), 'mm ?\[?hg') then 'mmhg' when regexp_matches(lower(raw_display_name), '\bkpa\b|kilopascal') then 'kpa' when regexp_matches(lower(raw_display_name), 'cm ?\[?h2o') then 'cmh2o' when regexp_matches(lower(raw_display_name), '\bhpa\b|hectopascal') then 'hpa' end) as u
  from map_observations where map_value is not null and not isnan(map_value)
),
unit_of as (
  select obs_id, e, sk, m, v, coalesce(u, min(u) over s, case when median(case when v > 0 then v end) over s < 25 then 'kpa' else 'mmhg' end) as unit_code
  from stated window s as (partition by ek, sk)
)"""
_UNITS = f"\nwith {_UNIT_ROWS}\n"
_MMHG = "v * case unit_code when 'kpa' then 7.50061683 when 'cmh2o' then 0.73555924 when 'hpa' then 0.750061683 else 1.0 end"
_CELLS = "cells as (select encounter_id, unnest(range(5, 5 * cast(floor(max(anesthesia_duration_min) / 5) as int) + 1, 5)) as time_min from cohort where encounter_id is not null group by encounter_id)"
_MISSING = "\nunion all\n".join(
    f"select feature_id, '{f.name}' as field_name from landmark_features where {f.name} is null or isnan({f.name}) or {f.name} < {f.low} or {f.name} > {f.high}" for f in hotdeck.LANDMARK_FIELDS
)

_DECK_ROWS = " union all ".join(f"select *, '{f.name}' as field_name, case when not ({f.name} is null or isnan({f.name}) or {f.name} < {f.low} or {f.name} > {f.high}) then {f.name} end as v from keyed" for f in hotdeck.LANDMARK_FIELDS)
_DECK_ORDER = "order by age_block, day_block, age, day, id"
_DECK = f"""
with keyed as (select feature_id as id, coalesce(surgical_service, '?') as g0, coalesce(site_code, '?') as g1, coalesce(cast(male as varchar), '?') as cls, case when age is null or isnan(age) then -1.0 else age end as age,
    coalesce(datediff('day', date '1970-01-01', case_day), -100000) as day, bmi, asa, pre10_last_map from landmark_features),
blocked as (select *, floor(age * 4) as age_block, floor(day / 30.0) as day_block from keyed),
long as (select *, case when v is not null then struct_pack(a := age, d := day, i := id, v := v) end as donor from ({_DECK_ROWS.replace("from keyed", "from blocked")})),
sides as (select *,
    last_value(donor ignore nulls) over (partition by field_name, g0, g1, cls {_DECK_ORDER} rows between unbounded preceding and 1 preceding) as b1, first_value(donor ignore nulls) over (partition by field_name, g0, g1, cls {_DECK_ORDER} rows between 1 following and unbounded following) as a1,
    last_value(donor ignore nulls) over (partition by field_name, g0, cls {_DECK_ORDER} rows between unbounded preceding and 1 preceding) as b2, first_value(donor ignore nulls) over (partition by field_name, g0, cls {_DECK_ORDER} rows between 1 following and unbounded following) as a2,
    last_value(donor ignore nulls) over (partition by field_name {_DECK_ORDER} rows between unbounded preceding and 1 preceding) as b3, first_value(donor ignore nulls) over (partition by field_name {_DECK_ORDER} rows between 1 following and unbounded following) as a3
    from long),
leveled as (select *, case when b1 is not null or a1 is not null then 1 when b2 is not null or a2 is not null then 2 when b3 is not null or a3 is not null then 3 else 0 end as level from sides where v is null),
near as (select *, case level when 1 then b1 when 2 then b2 when 3 then b3 end as b, case level when 1 then a1 when 2 then a2 when 3 then a3 end as a from leveled),
far as (select *, abs(b.a - age) + abs(b.d - day) / 365.25 as tb, abs(a.a - age) + abs(a.d - day) / 365.25 as ta from near)
select id as feature_id, field_name, case when a is null or tb <= ta then b.v else a.v end as value, case when a is null or tb <= ta then b.i else a.i end as donor_id,
  round(case when a is null or tb <= ta then tb else ta end, 6) as distance, cast(level as int) as level from far
"""


def _sizes_sql(quantity: str, column: str, stated: list[tuple[str, str]], noted: list[tuple[str, str]], subject: str, bare: str, factors: str, pair: str, low: float, high: float) -> str:
    text = f"trim({column})"
    one = " ".join(f"when regexp_matches(lower({text}), '{p}') then '{u}'" for u, p in stated)
    two = " ".join(f"when len(list_filter(string_split(lower(measure_note), ';'), lambda x: regexp_matches(x, '\\b{subject}\\b') and regexp_matches(x, '\\b{p}\\b') and not regexp_matches(x, '[0-9]'))) > 0 then '{u}'" for u, p in noted)
    plain = f"case when regexp_matches({text}, '[0-9],[0-9]{{{{3}}}}(,[0-9]{{{{3}}}}|[.][0-9])') then replace({text}, ',', '') else replace({text}, ',', '.') end".replace("{{", "{").replace("}}", "}")
    number = "try_cast(regexp_extract(plain, '[0-9]+([.][0-9]+)?') as double)"
    return f"""select row_id, quantity, unit_code, unit_from, case when g between {low} and {high} and not coalesce(v between {low} and {high}, false) then g else v end as value from (
      select *, case when unit_code = '{pair.split()[0]}' then NUM * {pair.split()[1]} + coalesce(try_cast(regexp_extract_all(plain, '[0-9]+([.][0-9]+)?')[2] as double), 0) * {pair.split()[2]} else NUM * {factors} end as v, try_cast(replace(nullif(regexp_extract(x, '^[^0-9]*([0-9]+,[0-9]{{3}})([^0-9]|$)', 1), ''), ',', '') as double) * {factors} as g
      from (select *, case when NUM is not null then coalesce(stated, noted, bare) end as unit_code, case when NUM is null then 'none' when stated is not null then 'value' when noted is not null then 'note' when bare is not null then 'history' else 'none' end as unit_from
        from (select cohort_id as row_id, '{quantity}' as quantity, {text} as x, {plain} as plain, case {one} end as stated, case {two} end as noted, default_height_unit, default_weight_unit, {bare.replace("NUM", number.replace("plain", f"({plain})"))} as bare
          from cohort left join sites using (site_code) where {column} is not null and {text} <> '')))""".replace("NUM", number)


_SIZES = " union all ".join(
    [
        _sizes_sql(
            "height", "height_m",
            [("ft_in", r"\d\s*(ft|feet|foot|''|′)"), ("cm", r"(^|[\d\s.,])(cm|centimet)"), ("mm", r"(^|[\d\s.,])(mm|millimet)"), ("in", r"(^|[\d\s.,])(in|inch|inches)\b"), ("m", r"(^|[\d\s.,])(m|metres?)\b")],
            [("cm", r"(cms?|centimet(er|re)s?)"), ("in", r"(inch|inches)")], r"(ht|height|stature)",
            "case when NUM * case default_height_unit when 'cm' then 0.01 when 'in' then 0.0254 else 1.0 end between 1.2 and 2.3 then default_height_unit when NUM between 1.2 and 2.3 then 'm' when NUM between 120 and 230 then 'cm' when NUM between 1200 and 2300 then 'mm' when NUM between 47.3 and 90.5 then 'in' end",
            "case unit_code when 'm' then 1.0 when 'cm' then 0.01 when 'mm' then 0.001 when 'in' then 0.0254 when 'ft_in' then 0.3048 end", "ft_in 0.3048 0.0254", 1.2, 2.3,
        ),
        _sizes_sql(
            "weight", "weight_kg",
            [("st_lb", r"\d\s*(st|stone)\b"), ("kg", r"(^|[\d\s.,])(kg|kilogram)"), ("lb", r"(^|[\d\s.,])(lbs?|pounds?)\b"), ("oz", r"(^|[\d\s.,])(oz|ounces?)\b"), ("g", r"(^|[\d\s.,])(g|gm|grams?)\b")],
            [("kg", r"(kgs?|kilograms?)"), ("lb", r"(lbs?|pounds?)"), ("oz", r"(oz|ounces?)"), ("g", r"grams?")], r"(wt|weight)",
            "case when NUM * case default_weight_unit when 'lb' then 0.45359237 when 'oz' then 0.028349523125 when 'g' then 0.001 else 1.0 end between 25 and 300 then default_weight_unit when NUM between 25 and 300 then 'kg' end",
            "case unit_code when 'kg' then 1.0 when 'lb' then 0.45359237 when 'oz' then 0.028349523125 when 'g' then 0.001 when 'st_lb' then 6.35029318 end", "st_lb 6.35029318 0.45359237", 25.0, 300.0,
        ),
    ]
)

# Minutes from UTC of the zone abbreviations of the sites.
_ABBREVIATIONS = "(values ('PST', -480), ('PDT', -420), ('EST', -300), ('EDT', -240), ('CET', 60), ('CEST', 120), ('ACST', 570), ('ACDT', 630), ('IST', 330), ('KST', 540)) as v (short, ahead)"


def _instants_sql(name: str, rows: str) -> str:
    """``name``: id, us and twice (the clock reads it twice) of ``rows`` with id, t, tz, day_first, origin and expected (micros)."""
    return rf"""{name}_a as (select *, trim(t) as x, regexp_extract(trim(t), '\[(.*)\]$', 1) as named, regexp_extract(trim(t), ' ([A-Z]{{3,5}})$', 1) as short from ({rows}) where t is not null),
{name}_b as (select *, case when named <> '' then named else coalesce(tz, 'UTC') end as z, case
    when regexp_full_match(x, '\d{{4}}-\d{{2}}-\d{{2}}[T ].*') then try_cast(replace(regexp_replace(x, '(\[.*\]|Z|[+-]\d{{2}}:?\d{{2}})$', ''), 'T', ' ') as timestamp)
    when regexp_full_match(x, '\d{{8}}T\d{{6}}.*') then try_strptime(substr(x, 1, 15), '%Y%m%dT%H%M%S') + to_microseconds(cast(rpad(regexp_extract(x, 'T\d{{6}}\.(\d+)', 1), 6, '0') as bigint))
    when contains(x, '/') and coalesce(day_first, false) then try_strptime(x, ['%d/%m/%Y %I:%M:%S %p', '%d/%m/%Y %H:%M:%S', '%d/%m/%Y %H:%M'])
    when contains(x, '/') then try_strptime(x, ['%m/%d/%Y %I:%M:%S %p', '%m/%d/%Y %H:%M:%S', '%m/%d/%Y %H:%M'])
    when regexp_full_match(x, '\d{{1,2}}\.\d{{1,2}}\.\d{{4}} .*') then try_strptime(x, ['%d.%m.%Y %H:%M:%S', '%d.%m.%Y %H:%M'])
    when regexp_full_match(x, '[A-Z][a-z]{{2}} .*') then try_strptime(regexp_replace(x, ' [A-Z]{{3,5}}$', ''), ['%b %d, %Y %I:%M:%S %p', '%b %d, %Y %H:%M:%S']) end as l,
  case when regexp_full_match(x, '\d{{10}}') then cast(x as bigint) * 1000000 when regexp_full_match(x, '\d{{13}}') then cast(x as bigint) * 1000 when regexp_full_match(x, '\d{{16}}') then cast(x as bigint)
    when regexp_full_match(x, '[+-]?\d{{1,8}}(\.\d+)?( min)?') then epoch_us(origin) + cast(round(cast(regexp_extract(x, '^[+-]?[0-9.]+') as double) * 6e7) as bigint) end as direct,
  case when regexp_matches(x, '\d.*Z$') then 0 when regexp_matches(x, '\d{{2}}([+-]\d{{2}}):?(\d{{2}})$|\.\d+([+-]\d{{4}})$') then
    (case when contains(regexp_extract(x, '[+-]\d{{2}}:?\d{{2}}$'), '-') then -1 else 1 end) * (cast(substr(regexp_extract(x, '[+-]\d{{2}}:?\d{{2}}$'), 2, 2) as int) * 60 + cast(right(x, 2) as int)) end as ahead from {name}_a),
{name}_c as (select b.*, v.ahead as by_name, epoch_us(l) + epoch_us(timezone(z, l - interval 1 day)) - epoch_us(l - interval 1 day) as c1, epoch_us(l) + epoch_us(timezone(z, l + interval 1 day)) - epoch_us(l + interval 1 day) as c2 from {name}_b b left join {_ABBREVIATIONS} using (short)),
{name}_d as (select *, timezone(z, make_timestamptz(c1)) = l as ok1, timezone(z, make_timestamptz(c2)) = l as ok2 from {name}_c),
{name} as (select id, coalesce(ok1 and ok2 and c1 <> c2, false) and direct is null and by_name is null as twice, case when direct is not null then direct when by_name is not null then epoch_us(l) - by_name * 60000000::bigint
    when regexp_full_match(x, '\d{{4}}-?\d{{2}}-?\d{{2}}[T ].*') and named = '' and {name}_d.ahead is not null then epoch_us(l) - {name}_d.ahead * 60000000::bigint
    when ok1 and ok2 and c1 <> c2 then case when abs(c1 - expected) < abs(c2 - expected) then c1 when abs(c1 - expected) > abs(c2 - expected) then c2 else least(c1, c2) end when ok1 then c1 when ok2 then c2 else c1 end as us from {name}_d)"""


_SITED = "from cohort left join (select site_code, any_value(tz_name) as tz, any_value(day_first) as day_first from sites group by 1) using (site_code)"
_CLOCKS = f"""with {_instants_sql("ends", f"select cohort_id as id, anesthesia_end as t, tz, day_first, clock_origin as origin, cast(null as bigint) as expected {_SITED}")},
lasts as (select cohort_id, case when not twice then us end - cast(anesthesia_duration_min * 60000000 as bigint) as expected from cohort left join ends on id = cohort_id),
{_instants_sql("begins", f"select cohort_id as id, anesthesia_start as t, tz, day_first, clock_origin as origin, expected {_SITED} join lasts using (cohort_id)")},
starts as (select id as cohort_id, us from begins)"""
_READ = _instants_sql(
    "reads",
    r"""select obs_id as id, observed_time as t, c.tz, c.day_first, c.origin, coalesce(c.start_us + cast(minute_from_anesthesia_start * 60000000 as bigint), epoch_us(loaded_at)) as expected
    from map_observations left join (select encounter_id, struct_extract(m, 'z') as tz, struct_extract(m, 'f') as day_first, struct_extract(m, 'o') as origin, struct_extract(m, 's') as start_us
      from (select encounter_id, arg_min({'z': tz, 'f': day_first, 'o': clock_origin, 's': starts.us}, {'a': starts.us is null, 'b': starts.us, 'c': cohort.cohort_id}) as m """ + _SITED.replace("from cohort ", "from cohort left join starts using (cohort_id) ") + r""" where encounter_id is not null group by 1)) c using (encounter_id)
    where not regexp_full_match(observed_time, '\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z')""",
)
_CANONICAL = r"'\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z'"

SQL: dict[str, str] = {
    "p5_found": f"""{_CLOCKS}, {_READ} select 'cohort' as src_table, cohort_id as row_id, us as utc_us from starts join cohort using (cohort_id) where us is not null and not regexp_full_match(anesthesia_start, {_CANONICAL})
      union all select 'map_observations', id, us from reads where us is not null""",
    "p1_found": _LINES + "select line_id, reason from judged where reason is not null",
    "p1_rows": _LINES + "select line_id, " + ", ".join(f"v[{k + 1}] as {f.lower()}" for k, f in enumerate(rejects.FLOWSHEET_FIELDS)) + " from judged where reason is null",
    "p2_found": f"""with {_CELLS},
      full_cells as (select distinct encounter_id, cast(ceil(minute_from_anesthesia_start / 5) * 5 as int) as time_min from map_observations where minute_from_anesthesia_start is not null and map_value is not null)
      select encounter_id, cast(time_min as int) as time_min from cells anti join full_cells using (encounter_id, time_min)""",
    "p2_grid": _UNITS + f""", {_CELLS},
      r as (select e, m, {_MMHG} as v, cast(ceil(m / 5) * 5 as int) as c from unit_of where m is not null and e is not null),
      agg as (select e, c, count(*) as n, sum(v) as s from r group by all),
      firsts as (select e, c, m, max(v) as hi, min(v) as lo from r group by all),
      edges as (select e, c, max(m) as last_m, arg_max(hi, m) as last_v, min(m) as first_m, arg_min(lo, m) as first_v from firsts group by all),
      both_sides as (
        select g.encounter_id, g.time_min, a.n, a.s, p.last_m, p.last_v, q.first_m, q.first_v
        from cells g left join agg a on a.e = g.encounter_id and a.c = g.time_min
        asof left join edges p on p.e = g.encounter_id and p.c < g.time_min
        asof left join edges q on q.e = g.encounter_id and q.c > g.time_min
      ),
      said as (select *, case when n > 0 then 'observed' when last_m is null or first_m is null then 'edge' when first_m - last_m <= 15 then 'filled' else 'gap' end as status from both_sides)
      select encounter_id, cast(time_min as int) as time_min, status, cast(coalesce(n, 0) as bigint) as n_readings,
        round(case status when 'observed' then s / n when 'filled' then last_v + (first_v - last_v) * (time_min - last_m) / (first_m - last_m) end, 4) as value_mmhg
      from said""",
    "p3_found": _MISSING,
    "p3_filled": _DECK,
    "p4_limits": f"""with {_UNIT_ROWS}, k as (select obs_id, ek as e, sk as s, case when not isnan(m) then m end as m, v, case u when 'mmhg' then 1.0 when 'kpa' then 7.50061683 when 'cmh2o' then 0.73555924 when 'hpa' then 0.750061683 end as f from stated),
      once as (select e, s, m, v, max(f) as f from k group by all), scaled as (select *, v * coalesce(f, max(f) over w, case when median(case when v > 0 then v end) over w < 25 then 7.50061683 else 1.0 end) as x from once window w as (partition by e, s)),
      steps as (select *, (lag(x) over o is distinct from x)::int as step from scaled where x > 0 and x <= 300 and m is not null window o as (partition by e, s order by m, v)),
      runs as (select *, sum(step) over (partition by e, s order by m, v) as run from steps), long as (select *, count(*) over (partition by e, s, run) as n from runs),
      found as (select e, s, m, v, 'impossible' as kind from scaled where not (x > 0 and x <= 300) union all select e, s, m, v, 'stuck' from long where n >= 8)
      select obs_id, kind from k join found using (e, s, v) where k.m is not distinct from found.m""",
    "p6_sizes": f"select row_id, quantity, unit_code, unit_from, round(value, 4) as value from ({_SIZES})",
    "p6_found": _UNITS + f""", sizes as ({_SIZES})
      select 'cohort' as src_table, row_id, quantity, unit_code from sizes where unit_code not in ('m', 'kg')
      union all select 'map_observations', obs_id, 'map', unit_code from unit_of where unit_code <> 'mmhg'""",
}
