"""Problem 6: one quantity recorded in different units, converted to metres, kilograms and mmHg."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions.changepoints import segments
from pulsegrid.session import checkpointed

# The common unit in one of each unit.
FACTORS = {
    "height": {"m": 1.0, "cm": 0.01, "mm": 0.001, "in": 0.0254, "ft_in": 0.3048},
    "weight": {"kg": 1.0, "lb": 0.45359237, "oz": 0.028349523125, "g": 0.001, "st_lb": 6.35029318},
    "map": {"mmhg": 1.0, "kpa": 7.50061683, "cmh2o": 0.73555924, "hpa": 0.750061683},
}
COMMON = {"height": "m", "weight": "kg", "map": "mmhg"}
# Sizes an adult can have, in the common unit, and the middle of them.
PLAUSIBLE = {"height": (1.2, 2.3, 1.7), "weight": (25.0, 300.0, 80.0), "map": (25.0, 250.0, 80.0)}
# Units a number without any can turn out to be in. cmH2O and hPa lie within a third of each other and of mmHg, which is less
# than levels differ by between patients: a level can't tell them, only a statement can.
BARE = {"height": ("m", "cm", "mm", "in"), "weight": ("kg", "lb", "oz", "g"), "map": ("mmhg", "kpa")}
PENALTY = 0.5
SUSTAINED = 24  # values a segment must have to be compared with its neighbour
TOLERANCE = 0.08  # of the log of a level shift from that of a ratio of units
LONGEST = 2048  # values of a history that are searched together
SPREAD = 4  # parts of one source's month, each a history of its own


def pressure_unit(text: Column) -> Column:
    """The pressure unit a text names, or NULL."""
    t = F.lower(text)
    return (
        F.when(text.isin("mmHg", "mmhg"), "mmhg")
        .when(t.rlike(r"mm ?\[?hg|\btorr\b|millimet(er|re)s? of mercury"), "mmhg")
        .when(t.rlike(r"\bkpa\b|kilopascal"), "kpa")
        .when(t.rlike(r"cm ?\[?h2o|centimet(er|re)s? of water"), "cmh2o")
        .when(t.rlike(r"\bhpa\b|hectopascal|\bmbar\b|millibar"), "hpa")
    )


def size_unit(quantity: str, text: Column) -> Column:
    """The unit stated with a height or weight, or NULL."""
    t = F.lower(F.regexp_replace(F.regexp_replace(text, "[′’`]", "'"), "[″”“]", '"'))
    if quantity == "height":
        return (
            F.when(t.rlike(r"\d\s*(ft|feet|foot|')"), "ft_in")
            .when(t.rlike(r"(^|[\d\s.,])(cms?|centimet(er|re)s?)\b"), "cm")
            .when(t.rlike(r"(^|[\d\s.,])(mm|millimet(er|re)s?)\b"), "mm")
            .when(t.rlike(r"(^|[\d\s.,])(in|inch|inches)\b|\d\s*\""), "in")
            .when(t.rlike(r"(^|[\d\s.,])(m|met(er|re)s?)\b"), "m")
        )
    return (
        F.when(t.rlike(r"\d\s*(st|stones?)\b"), "st_lb")
        .when(t.rlike(r"(^|[\d\s.,])(kgs?|kilos?|kilograms?)\b"), "kg")
        .when(t.rlike(r"(^|[\d\s.,])(lbs?|pounds?|#)(\b|$)"), "lb")
        .when(t.rlike(r"(^|[\d\s.,])(ozs?|ounces?)\b"), "oz")
        .when(t.rlike(r"(^|[\d\s.,])(g|gms?|grams?|grammes?)\b"), "g")
    )


def note_unit(quantity: str, note: Column) -> Column:
    """The unit a note states for the quantity: a clause naming both and no number of its own. ``in`` is no unit there."""
    subject = r"(ht|height|stature|length)" if quantity == "height" else r"(wt|weight|mass)"
    units = (
        (("cm", r"(cms?|centimet(er|re)s?)"), ("mm", r"(mm|millimet(er|re)s?)"), ("in", r"(inch|inches)"), ("ft_in", r"(ft|feet)"), ("m", r"(m|met(er|re)s?)"))
        if quantity == "height"
        else (("kg", r"(kgs?|kilos?|kilograms?)"), ("lb", r"(lbs?|pounds?)"), ("oz", r"(oz|ounces?)"), ("st_lb", r"(st|stones?)"), ("g", r"(g|gms?|grams?)"))
    )
    out = F.lit(None).cast("string")
    for code, words in reversed(units):
        clause = rf"(?i)(^|;)(?=[^;0-9]*\b{subject}\b)(?=[^;0-9]*\b{words}\b)[^;0-9]*(;|$)"
        out = F.when(note.rlike(clause), code).otherwise(out)
    return out


def _numbers(text: Column) -> Column:
    """Numbers of a text as doubles: a comma before the last digits is a decimal comma unless three digits follow it twice over."""
    plain = F.regexp_replace(text, r"(\d),(\d{3})(?=,\d{3}|\.\d)", "$1$2")
    return F.transform(F.regexp_extract_all(F.regexp_replace(plain, ",", "."), F.lit(r"(\d+(?:\.\d+)?)"), 1), lambda x: x.try_cast("double"))


def _grouped(text: Column) -> Column:
    """The first number, with a comma before exactly three digits read as a separator of thousands."""
    return F.regexp_replace(F.regexp_extract(text, r"\d+,\d{3}(?!\d)", 0), ",", "").try_cast("double")


def _histories(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by history, passed on in whole histories: the last one of a frame waits for the next frame."""
    held: list[pd.DataFrame] = []
    for frame in frames:
        if not len(frame):
            continue
        key = frame["history"].to_numpy()
        if held and held[-1]["history"].iloc[-1] != key[0]:
            yield pd.concat(held, ignore_index=True)
            held = []
        change = np.flatnonzero(key[1:] != key[:-1])
        border = int(change[-1]) + 1 if len(change) else 0
        if border:
            yield pd.concat([*held, frame.iloc[:border]], ignore_index=True)
            held = []
        held.append(frame.iloc[border:])
    if held:
        yield pd.concat(held, ignore_index=True)


def segment_units(level: np.ndarray, size: np.ndarray, default: np.ndarray, quantity: str) -> np.ndarray:
    """The unit (its place in BARE) of each segment of one history: log level, number of values and default unit of each.

    A segment whose level is plausible in its default unit has it, any other the unit whose factor brings its level nearest to
    the middle of plausible sizes. Then level shifts between neighbouring segments of SUSTAINED or more values are compared with
    the ratios of units: a shift that equals one (within TOLERANCE of log) marks a change of unit, even where the level would be
    plausible either way. Of the two the side further from the middle of plausible sizes is reversed.
    """
    factors = np.log([1 / FACTORS[quantity][u] for u in BARE[quantity]])
    low, high, middle = PLAUSIBLE[quantity]
    common = level[:, None] - factors[None, :]
    fits = (common >= np.log(low)) & (common <= np.log(high))
    rows = np.arange(len(level))
    unit = np.where(fits[rows, default], default, np.argmin(np.abs(common - np.log(middle)), axis=1))
    def reversed_to(k: int, other: int) -> tuple[int, float] | None:
        """The unit that explains the level of segment k beside that of ``other``, with the distance from its ratio."""
        shift = level[k] - level[other]
        off = np.abs(shift - (factors - factors[unit[other]]))
        to = np.flatnonzero(fits[k] & (off <= TOLERANCE) & (np.arange(len(factors)) != unit[k]))
        return (int(to[np.argmin(off[to])]), float(abs(common[k, unit[k]] - np.log(middle)))) if len(to) else None

    long = np.flatnonzero(size >= SUSTAINED)
    for a, b in zip(long[:-1], long[1:], strict=True):
        if unit[a] == unit[b]:
            options = [(far, k, to) for k, other in ((b, a), (a, b)) if (found := reversed_to(k, other)) for to, far in [found]]
            if options:
                _, k, to = max(options)
                unit[k] = to
    return unit


def _segmented(quantity: str):
    factors = np.log([1 / FACTORS[quantity][u] for u in BARE[quantity]])
    names = np.array(BARE[quantity], object)
    low, high, middle = PLAUSIBLE[quantity]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in _histories(frames):
            key = frame["history"].to_numpy()
            x = np.log(frame["level"].to_numpy(float))
            default = np.array([list(BARE[quantity]).index(u) if u in BARE[quantity] else 0 for u in frame["default_unit"].fillna("")])
            level, chosen = np.empty(len(x)), np.empty(len(x), np.int64)
            ends = np.append(np.flatnonzero(key[1:] != key[:-1]) + 1, len(x))
            for a, b in zip(np.append(0, ends[:-1]), ends, strict=True):
                # A long history is searched piece by piece, so that the search stays linear in its length.
                cuts = np.concatenate([at - a + segments(x[at : min(at + LONGEST, b)], PENALTY) for at in range(a, b, LONGEST)])
                size = np.diff(np.append(cuts, b - a))
                of_segment = np.add.reduceat(x[a:b], cuts) / size
                level[a:b] = np.repeat(of_segment, size)
                chosen[a:b] = np.repeat(segment_units(of_segment, size, default[a:b][cuts], quantity), size)
            # The segment's unit holds for its values; one that no size could be in that unit is judged by itself.
            own = x[:, None] - factors[None, :]
            fits = (own >= np.log(low)) & (own <= np.log(high))
            rows = np.arange(len(x))
            alone = np.where(fits[rows, default], default, np.argmin(np.abs(own - np.log(middle)), axis=1))
            frame["unit_code"] = names[np.where(fits[rows, chosen], chosen, alone)]
            frame["segment_level"] = np.exp(level)
            yield frame[["row_id", "unit_code", "segment_level"]]

    return run


def bare_units(df: DataFrame, quantity: str) -> DataFrame:
    """Units of numbers that state none, from the levels of their source's history.

    ``df``: row_id, source, at (time), level (positive), default_unit. Each source's history, in blocks of a month that are split at
    fixed hashes into SPREAD parts, is cut by exact penalised changepoint search on log levels (in pieces of LONGEST values); the segments get their units
    by :func:`segment_units`. The rows of a block are those of its source, month and hash and no others, in order of time and
    id, however rows are partitioned or batched, so the result depends on neither. A source may hold a third of all rows: its
    months and hashes are spread over tasks. Rows without a positive level are left out; a NULL source is a source of its own.
    """
    kind = df.schema["row_id"].dataType.simpleString()
    part = F.pmod(F.xxhash64("row_id"), F.lit(SPREAD)) if SPREAD > 1 else F.lit(0)
    rows = df.filter(F.col("level") > 0).withColumn("history", F.xxhash64("source", F.date_trunc("month", F.col("at")), part))
    spread = rows.repartition("history").sortWithinPartitions("history", "at", "row_id").select("row_id", "history", "level", "default_unit")
    return spread.mapInPandas(_segmented(quantity), f"row_id {kind}, unit_code string, segment_level double")


def cohort_sizes(cohort: DataFrame, sites: DataFrame) -> DataFrame:
    """row_id, quantity, text, unit_code, unit_from (value, note, history) and value in the common unit, for heights and weights.

    NULL and empty texts are left out. A text without a number keeps a NULL unit and value (unit_from ``none``). A bare number
    at an unknown site has the common unit as its default.
    """
    site = F.broadcast(sites.dropDuplicates(["site_code"]).select(F.col("site_code").alias("_site"), "default_height_unit", "default_weight_unit"))
    rows = cohort.select("cohort_id", "site_code", "height_m", "weight_kg", "measure_note", "loaded_at").join(site, F.col("site_code") == F.col("_site"), "left")
    parts = []
    for quantity, column in (("height", "height_m"), ("weight", "weight_kg")):
        text = F.trim(F.col(column))
        stated, noted = size_unit(quantity, text), note_unit(quantity, F.col("measure_note"))
        base = (
            rows.filter(F.col(column).isNotNull() & (text != ""))
            .select(F.col("cohort_id").alias("row_id"), text.alias("text"), F.col("site_code").alias("source"), F.col("loaded_at").alias("at"), F.coalesce(F.lower(F.trim(F.col(f"default_{quantity}_unit"))), F.lit(COMMON[quantity])).alias("default_unit"), stated.alias("stated"), noted.alias("noted"))
            .withColumn("numbers", _numbers(F.col("text")))
        )
        first = F.try_element_at(F.col("numbers"), F.lit(1))
        bare = base.filter(F.col("stated").isNull() & F.col("noted").isNull() & (first > 0)).select("row_id", "source", "at", first.alias("level"), "default_unit")
        known = bare_units(bare, quantity).select(F.col("row_id").alias("_id"), F.col("unit_code").alias("history"))
        joined = base.join(known, F.col("row_id") == F.col("_id"), "left")
        unit = F.when(first.isNull(), None).otherwise(F.coalesce("stated", "noted", "history"))
        factor = F.create_map(*[F.lit(x) for pair in FACTORS[quantity].items() for x in pair])
        second = F.coalesce(F.try_element_at(F.col("numbers"), F.lit(2)), F.lit(0.0))
        value = first * F.try_element_at(factor, F.col("unit_code"))
        if quantity == "height":
            value = F.when(F.col("unit_code") == "ft_in", first * 0.3048 + second * 0.0254).otherwise(value)
        else:
            value = F.when(F.col("unit_code") == "st_lb", first * 6.35029318 + second * 0.45359237).otherwise(value)
        low, high, _ = PLAUSIBLE[quantity]
        thousands = _grouped(F.col("text")) * F.try_element_at(factor, F.col("unit_code"))
        value = F.when(thousands.between(low, high) & ~F.coalesce(value.between(low, high), F.lit(False)), thousands).otherwise(value)
        origin = F.when(first.isNull(), "none").when(F.col("stated").isNotNull(), "value").when(F.col("noted").isNotNull(), "note").when(F.col("history").isNotNull(), "history").otherwise("none")
        parts.append(joined.withColumn("unit_code", unit).select("row_id", F.lit(quantity).alias("quantity"), "text", "unit_code", origin.alias("unit_from"), value.alias("value")))
    return parts[0].unionByName(parts[1])


def reading_units(readings: DataFrame) -> DataFrame:
    """obs_id, encounter_id, map_source, minute_from_anesthesia_start, unit_code, value_mmhg of readings with a value.

    The unit is the one in raw_unit, else in raw_display_name, else one that other rows of the same encounter and device state
    (the first in the alphabet if they differ), else mmHg unless the level of the series shows another (see
    :func:`bare_units`; the level is the median of its positive values). NaN values are left out as NULL ones are.
    Only series with a row that states nothing are gathered, as one row each.
    """
    stated = F.coalesce(pressure_unit(F.col("raw_unit")), pressure_unit(F.col("raw_display_name")))
    rows = (
        readings.filter(F.col("map_value").isNotNull() & ~F.isnan(F.col("map_value")))
        .select("obs_id", "dataset", "encounter_id", "map_source", "minute_from_anesthesia_start", "map_value", "loaded_at", stated.alias("stated"))
        .withColumn("e", F.coalesce("encounter_id", F.lit(""))).withColumn("s", F.coalesce("map_source", F.lit("")))
    )
    # By value, repeated values are counted where they lie: a series that holds many rows holds few values.
    counts = rows.groupBy("e", "s", "map_value").agg(F.count("*").alias("n"), F.min("stated").alias("stated"), F.max(F.col("stated").isNull()).alias("silent"), F.min("dataset").alias("dataset"), F.min("loaded_at").alias("at"))
    series = (
        counts.groupBy("e", "s")
        .agg(F.expr("percentile(map_value, 0.5, n) filter (where map_value > 0)").alias("level"), F.min("stated").alias("stated"), F.max("silent").alias("silent"), F.min("dataset").alias("dataset"), F.min("at").alias("at"))
        .filter("silent")
        .withColumn("row_id", F.struct("e", "s"))
    )
    series = checkpointed(series)  # one row a silent series: read by both branches below, aggregated once
    bare = series.filter(F.col("stated").isNull()).select(F.to_json("row_id").alias("row_id"), F.concat_ws("|", "dataset", "s").alias("source"), "at", "level", F.lit("mmhg").alias("default_unit"))
    shown = bare_units(bare, "map").select(F.from_json("row_id", "e string, s string").alias("k"), F.col("unit_code").alias("u"))
    resolved = series.filter(F.col("stated").isNotNull()).select("e", "s", F.col("stated").alias("u")).unionByName(shown.select("k.e", "k.s", "u"))
    named = rows.filter(F.col("stated").isNotNull()).withColumn("unit_code", F.col("stated"))
    silent = rows.filter(F.col("stated").isNull()).join(resolved, ["e", "s"], "left").withColumn("unit_code", F.coalesce("u", F.lit("mmhg"))).drop("u")
    factor = F.create_map(*[F.lit(x) for pair in FACTORS["map"].items() for x in pair])
    out = named.unionByName(silent.select(*named.columns))
    return out.select("obs_id", "encounter_id", "map_source", "minute_from_anesthesia_start", "unit_code", (F.col("map_value") * F.try_element_at(factor, F.col("unit_code"))).alias("value_mmhg"))


def foreign_units(cohort: DataFrame, readings: DataFrame, sites: DataFrame) -> DataFrame:
    """src_table, row_id, quantity, unit_code of every value not given in the common unit."""
    sizes = cohort_sizes(cohort, sites).filter(~F.col("unit_code").isin("m", "kg"))
    a = sizes.select(F.lit("cohort").alias("src_table"), "row_id", "quantity", "unit_code")
    b = reading_units(readings).filter(F.col("unit_code") != "mmhg").select(F.lit("map_observations").alias("src_table"), F.col("obs_id").alias("row_id"), F.lit("map").alias("quantity"), "unit_code")
    return a.unionByName(b)
