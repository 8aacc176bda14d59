import random

import pytest
from pyspark.sql import functions as F

from pulsegrid.llm.names import distance, map_names, matcher, resolve_row, shortens, typed, words

REFERENCE = [
    (1, "flo_name", "ARTERIAL LINE MAP", "Arterial line mean pressure"),
    (4, "flo_name", "CUFF MEAN PRESSURE", "Non-invasive cuff mean pressure"),
    (6, "flo_name", "CUFF DIASTOLIC PRESSURE", "Non-invasive cuff diastolic pressure"),
    (12, "flo_name", "HEART RATE", "Heart rate"),
    (14, "flo_name", "RESPIRATORY RATE", "Respiratory rate"),
    (19, "flo_name", "EXPIRED SEVOFLURANE", "End-expiratory sevoflurane"),
    (20, "flo_name", "EXPIRED DESFLURANE", "End-expiratory desflurane"),
    (101, "map_source", "ART", "Invasive arterial line"),
    (102, "map_source", "NIBP", "Non-invasive cuff"),
    (103, "map_source", "DIRECT", "Charted directly, device not stated"),
]
SCHEMA = "ref_id int, list_name string, canonical_name string, canonical_display string"


def test_distance_against_brute_force():
    def plain(a, b):
        if not a or not b:
            return len(a) + len(b)
        best = min(plain(a[1:], b) + 1, plain(a, b[1:]) + 1, plain(a[1:], b[1:]) + (a[0] != b[0]))
        if len(a) > 1 and len(b) > 1 and a[0] == b[1] and a[1] == b[0]:
            best = min(best, plain(a[2:], b[2:]) + 1)
        return best

    for a in ("", "ab", "rate", "raet", "tear"):
        for b in ("", "ba", "rate", "rat", "treat"):
            assert distance(a, b, 9) == plain(a, b) and distance(a, b, 1) == min(plain(a, b), 2)


def test_words_and_short_forms():
    main = lambda text: [t for t, aside in zip(typed(text).tokens, typed(text).aside) if not aside]
    assert main("MON2 - HEART RATE (R)") == ["heart", "rate"] == main("IF7: heart rate - auto") and words("??") == [] and words("c.o. N.I.B.P.") == ["co", "nibp"]
    assert shortens("prs", "pressure") and shortens("mn", "mean") and not shortens("rate", "rate") and not shortens("x", "xy")


@pytest.mark.parametrize(
    ("name", "display", "ref"),
    [
        ("Heart Rate", None, 12), ("HEART  RT", None, 12), ("RATE, HEART", None, 12), ("heatr-rate", None, 12), ("hr", None, 12), ("PHL: Hear tRate", None, 12),
        ("cuff mn prs", None, 4), ("CUFF_DIASTOL._PRES.", None, 6), ("Exaired Desflurane", None, 20), ("exp_sevofl", None, 19), ("A-LINE MEAN", None, 1),
        ("FLO_30009", "arterial line mean pressure", 1), ("R893", "Heart rate", 12), (None, "RATE, RESPIRATORY - auto", 14), ("", "heart rate", 12), ("   ", None, 0), ("R893", None, 0), (None, None, 0),
        ("Wound dressing intact", "Wound dressing intact", 0), ("Meal tray", None, 0), ("zz test row", None, 0), ("x" * 50_000, None, 0), ("hear trate " * 20_000, None, 12), ("".join(map(chr, (97 + k * k % 26 for k in range(60_000)))), None, 0), ("zz qq " * 20_000, "Heart rate", 12),
    ],
)
def test_entries(name, display, ref):
    assert resolve_row(matcher(REFERENCE, "flo_name"), name, display) == ref


@pytest.mark.parametrize(("name", "ref"), [("a ilne *", 101), ("radail art line", 101), ("invasive", 101), ("Non-nivasive", 102), ("nib pcuff", 102), ("N..IB.P.", 102), ("DIRCT", 103), ("charted direct", 103), ("room 4", 0), ("see note", 0), ("?", 0)])
def test_devices(name, ref):
    assert resolve_row(matcher(REFERENCE, "map_source"), name, None) == ref


def test_rows(spark):
    reference = spark.createDataFrame(REFERENCE, SCHEMA)
    df = spark.createDataFrame([(1, "HEART RATE", None), (2, "heart rate", None), (2, "heart rate", None), (3, None, "Heart rate"), (4, "meal tray", "Meal Tray"), (5, None, None)], "id bigint, n string, d string")
    df = df.withColumn("name", F.lit("x")).withColumn("ref_id", F.lit(9))
    got = sorted((r.row_id, r.ref_id) for r in map_names(df, reference, "flo_name", "id", "n", "d").collect())
    assert got == [(2, 12), (2, 12), (3, 12), (4, 0), (5, 0)]
    assert map_names(df.limit(0), reference, "flo_name", "id", "n").count() == 0
    none = map_names(df, reference.limit(0), "flo_name", "id", "n", "d").collect()
    assert {r.ref_id for r in none} == {0} and len(none) == 6
    with pytest.raises(ValueError, match="more than 3"):
        map_names(df, reference, "flo_name", "id", "n", most_entries=3)


def spellings(entry: str, rng: random.Random) -> str:
    """A spelling nobody has listed: case, order, separators, a misspelt letter, shortened words, an interface's additions."""
    ws = entry.split()
    long = [k for k, w in enumerate(ws) if len(w) >= 6]
    kind = rng.randrange(5)
    if kind == 0 and long:
        k = rng.choice(long)
        at = rng.randrange(1, len(ws[k]) - 1)
        ws[k] = rng.choice([ws[k][:at] + ws[k][at + 1 :], ws[k][:at] + ws[k][at + 1] + ws[k][at] + ws[k][at + 2 :], ws[k][:at] + "x" + ws[k][at + 1 :]])
    elif kind == 1 and long:
        k = rng.choice(long)
        ws[k] = ws[k][: rng.randrange(4, len(ws[k]))]
    elif kind == 2:
        ws = ws[-1:] + ws[:-1]
    text = rng.choice([" ", "_", "-", "  "]).join(ws)
    text = rng.choice([str.upper, str.lower, str.title])(text)
    return rng.choice(["{}", "BED12 - {}", "{} (unit)", "X: {}", "{} #4", "* {}"]).format(text)


LIST = "ARTERIAL LINE SYSTOLIC|CUFF DIASTOLIC PRESSURE|CENTRAL VENOUS PRESSURE|PULMONARY ARTERY PRESSURE|HEART RATE|RESPIRATORY RATE|BODY TEMPERATURE|SKIN TEMPERATURE|INSPIRED OXYGEN FRACTION|PEAK AIRWAY PRESSURE|PLATEAU AIRWAY PRESSURE|URINE OUTPUT|ESTIMATED BLOOD LOSS|STROKE VOLUME VARIATION|BLOOD GLUCOSE|SERUM POTASSIUM|GASTRIC RESIDUAL VOLUME|WOUND DRAINAGE|COUGH STRENGTH|PUPIL DIAMETER"


def test_accuracy_on_spellings_that_were_never_seen():
    """With neither aliases nor abbreviations, on entries of which a quarter are of no list the library was written for."""
    reference = [(k + 1, "flo_name", name, name.capitalize()) for k, name in enumerate(LIST.split("|"))]
    rng, m = random.Random(11), matcher(reference, "flo_name", lexicon={})
    cases = [(ref, spellings(name, rng)) for ref, _, name, _ in reference for _ in range(40)]
    right = sum(resolve_row(m, text, None) == ref for ref, text in cases)
    assert right >= 0.95 * len(cases), right / len(cases)
    others = ["visitor log", "meal tray given", "call bell in reach", "family updated", "bed alarm on", "isolation sign", "side rails up", "shoes off"]
    assert [resolve_row(m, t, None) for t in others] == [0] * len(others)


def test_abbreviations_need_the_lexicon_and_aliases_a_caller():
    assert resolve_row(matcher(REFERENCE, "flo_name", lexicon={}), "nibp m", None) == 0 and resolve_row(matcher(REFERENCE, "flo_name"), "nibp m", None) == 4
    assert resolve_row(matcher(REFERENCE, "flo_name"), "ticker", None) == 0 and resolve_row(matcher(REFERENCE, "flo_name", {"HEART RATE": ["ticker"]}), "ticker", None) == 12
