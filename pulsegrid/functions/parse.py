"""Parsing and normalising of typed scalars, as Column expressions."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of names and labels.
MAP_LABEL = r"(?i)\bmap\b|mean arterial(?: pressure)?|mean blood pressure|\babp\s*(?:mean|m)\b|arterial (?:blood )?pressure mean"
SUMMARY_LABEL = r"(?i)\b(?:min(?:imum)?|max(?:imum)?|goal|target|alarm|limit|parameter)\b"
ART_LABEL = r"(?i)\b(?:art(?:erial)?[ _-]?(?:line|bp|map)|a[ _-]?line|abp|arterial(?: line)? (?:map|blood pressure)|invasive (?:map|blood pressure))\b"
NIBP_LABEL = r"(?i)\b(?:nibp|nbp|non[ -]?invasive(?: blood pressure)?|cuff(?: blood pressure)?)\b"
SINGLE_NUMBER = r"(?i)^\s*([+-]?(?:\d+(?:\.\d*)?|\.\d+))\s*(?:mm\s*hg|mmhg)?\s*$"
ART_TOKENS = ("ART", "ARTERIAL", "ARTMBP", "ABP", "ALINE", "INVASIVE")
NIBP_TOKENS = ("NIBP", "NIBPMBP", "NBP", "NONINVASIVE", "CUFF")
TRUE_WORDS = ("1", "true", "t", "yes", "y", "emergency", "urgent")


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x evaluated once, however often f names it: keeps nested rules from multiplying."""
    return F.element_at(F.transform(F.array(x), f), 1)


def norm_sex(c: Column) -> Column:
    t = F.upper(F.trim(c))
    return F.when(t.isin("M", "MALE"), "M").when(t.isin("F", "FEMALE"), "F")


def male_num(c: Column) -> Column:
    return F.when(norm_sex(c) == "M", 1.0).when(norm_sex(c) == "F", 0.0)


def truthy(c: Column) -> Column:
    """NULL and anything outside the list are false; the text 1.0 is outside it."""
    return F.coalesce(F.lower(F.trim(c)).isin(*TRUE_WORDS), F.lit(False))


def _number(c: Column, pattern: str = r"[+-]?(?:\d+(?:\.\d*)?|\.\d+)") -> Column:
    return F.nullif(F.regexp_extract(F.regexp_replace(c, ",", ""), pattern, 0), F.lit("")).try_cast("double")


def parse_height_m(c: Column) -> Column:
    """Metres: feet and inches; else cm if labelled or of 120 to 230; else inches if labelled or of 48 to 90; else metres."""
    t = F.lower(F.trim(F.translate(c, "′″", "'\"")))
    return let(t, _height_of)


def _height_of(t: Column) -> Column:
    feet = r"^(\d+(?:\.\d+)?)\s*(?:'|ft|feet)\s*(\d+(?:\.\d+)?)?"
    ft, inch = (F.nullif(F.regexp_extract(t, feet, k), F.lit("")).try_cast("double") for k in (1, 2))
    return let(_number(t), lambda v: _height_by_size(t, ft, inch, v))


def _height_by_size(t: Column, ft: Column, inch: Column, v: Column) -> Column:
    return (
        F.when(ft.isNotNull(), (ft * 12 + F.coalesce(inch, F.lit(0.0))) * 0.0254)
        .when(v.isNull(), None)
        .when(t.contains("cm") | (v.between(120, 230) & ~t.rlike(r"\bin\b")), v / 100)
        .when(t.rlike(r"\b(?:in|inch|inches)\b") | v.between(48, 90), v * 0.0254)
        .when(F.concat(F.lit(" "), t).contains(" m") | v.between(1.2, 2.3), v)
    )


def parse_weight_kg(c: Column, unlabelled: str = "oz") -> Column:
    """Kilograms within 20 to 400; a label counts only as a word of its own, a bare number has the unit ``unlabelled``."""
    factors = {"kg": 1.0, "oz": 0.028349523125, "g": 0.001}
    if unlabelled not in factors:
        raise ValueError(f"a number without a unit can be in kg, oz or g, not {unlabelled}")
    t, v = F.lower(F.trim(c)), _number(c)
    kg = v * (
        F.when(t.rlike(r"\bkg\b|kilogram"), 1.0)
        .when(t.rlike(r"\blbs?\b|pound"), 0.45359237)
        .when(t.rlike(r"\boz\b|ounce"), 0.028349523125)
        .when(t.rlike(r"\b(?:g|gm|grams?)\b"), 0.001)
        .otherwise(factors[unlabelled])
    )
    return let(kg, lambda k: F.when(k.between(20, 400), k))


def weight_kg_plain(c: Column) -> Column:
    v = c.try_cast("double")
    return F.when(v.between(20, 400), v)


def bmi(weight: Column, height: Column) -> Column:
    return let(height, lambda h: let(F.try_divide(weight, h * h), lambda v: F.when(v.between(10, 80), v)))


def single_numeric(c: Column) -> Column:
    """The number of a text that is one number, with mmHg or without; NULL for anything else."""
    return F.nullif(F.regexp_extract(c, SINGLE_NUMBER, 1), F.lit("")).try_cast("double")


def label(name: Column, display: Column) -> Column:
    return F.concat_ws(" | ", F.coalesce(name, F.lit("")), F.coalesce(display, F.lit("")))


def is_map_label(text: Column) -> Column:
    return text.rlike(MAP_LABEL) & ~text.rlike(SUMMARY_LABEL)


def label_source(text: Column) -> Column:
    return F.when(text.rlike(ART_LABEL), "ART").when(text.rlike(NIBP_LABEL), "NIBP").otherwise("DIRECT")


def source_token(c: Column) -> Column:
    return F.upper(F.regexp_replace(c, "[^0-9A-Za-z]", ""))


def source_of_token(c: Column, art: tuple[str, ...] = ART_TOKENS, nibp: tuple[str, ...] = NIBP_TOKENS) -> Column:
    """ART or NIBP for a known label, else NULL; a label in both lists is an error."""
    clash = set(art) & set(nibp)
    if clash:
        raise ValueError(f"labels of both sources: {', '.join(sorted(clash))}")
    t = source_token(c)
    return F.when(t.isin(*art), "ART").when(t.isin(*nibp), "NIBP")


def device_of(c: Column) -> Column:
    """ART or NIBP for a device label: by its token, else by the label patterns (ART first); NULL for any other and for NULL."""
    told = F.coalesce(source_of_token(c), F.when(c.rlike(ART_LABEL), "ART").when(c.rlike(NIBP_LABEL), "NIBP"))
    return F.when(c.isin("ART", "NIBP"), c).otherwise(told)  # most labels are written as they should be


def binary_parse(c: Column) -> Column:
    t = F.lower(F.trim(c.cast("string")))
    v = t.try_cast("double")
    return F.when(v.isin(0.0, 1.0), v).when(t.isin("true", "t", "yes", "y"), 1.0).when(t.isin("false", "f", "no", "n"), 0.0)


def sha_identifier(study: str, kind: str, value: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(study), F.lit(kind), value), 256)


def analysis_seed(text: str) -> int:
    return int(hashlib.sha256(text.encode()).hexdigest()[:8], 16)


def logit(p: Column) -> Column:
    q = F.greatest(F.least(p, F.lit(1 - 1e-12)), F.lit(1e-12))
    return F.log(q) - F.log1p(-q)


def sigmoid(z: Column) -> Column:
    """Stable at both ends in doubles: the exponential overflows to infinity, whose inverse is 0. ``z`` occurs once."""
    return 1 / (1 + F.exp(-z))


def field_norm(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def fixed_number(c: Column, digits: int = 2) -> Column:
    """A number with fixed digits, ``not estimable`` for NULL, and no minus before zero."""
    v = F.round(c, digits)
    return F.when(c.isNull(), "not estimable").otherwise(F.format_string(f"%.{digits}f", F.when(v == 0, F.lit(0.0)).otherwise(v)))


def emergency_flag(patient_class: Column) -> Column:
    """Whether a patient class names an emergency; NULL does not."""
    return F.coalesce(patient_class.rlike(r"(?i)emergency|urgent|\bed\b"), F.lit(False))


def mean_sd_text(mean: Column, sd: Column, digits: int = 1) -> Column:
    """``12.3 (4.5)``; a mean or deviation that is missing shows as not estimable."""
    return F.concat(fixed_number(mean, digits), F.lit(" ("), fixed_number(sd, digits), F.lit(")"))


def n_percent_text(n: Column, of: Column, digits: int = 1) -> Column:
    """``1,234 (56.7%)``; not estimable without anything to count."""
    share = fixed_number(100 * F.try_divide(n, of), digits)
    return F.when(of > 0, F.concat(F.format_number(n.cast("bigint"), 0), F.lit(" ("), share, F.lit("%)"))).otherwise("not estimable")


def estimate_text(estimate: Column, lower: Column, upper: Column, digits: int = 3) -> Column:
    """``0.714 (0.698 to 0.729)``; not estimable if one of the three is missing, NaN or infinite."""
    fine = F.lit(True)
    for c in (estimate, lower, upper):
        fine = fine & F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))
    return F.when(fine, F.concat(fixed_number(estimate, digits), F.lit(" ("), fixed_number(lower, digits), F.lit(" to "), fixed_number(upper, digits), F.lit(")"))).otherwise("not estimable")
