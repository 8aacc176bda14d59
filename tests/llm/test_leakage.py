import random

from pyspark.sql import functions as F

from pulsegrid.llm import leakage
from pulsegrid.llm.leakage import Index, Rule, find_leaks, plain

PASSAGE = (
    "At minute 3503 the talkative violin teacher shows subtle waveform damping. Earlier urgent parotidectomy was complicated by fleeting "
    "hypocapnia and newly found aortic stenosis. Losses total 3509 ml, fluids 460 ml, urine 33 ml. Some 24 minutes past incision: 91, then 62."
)
WORDS = PASSAGE.split()
PAD = "Nothing of note was charted by the night team before the relief arrived and the door was closed again."


def found(text, passage=PASSAGE):
    return {i for i, _, _ in Index([(1, passage)], Rule()).leaks(text, {})}


def changed(words, every, rng, first=0):
    out = list(words)
    for k in range(first, len(out), every):
        kind = rng.randrange(3)
        out[k] = "zzz" if kind == 0 else out[k] + " qqq" if kind == 1 else out[k][:-1] + "xq"
    return " ".join(out)


def test_whole_and_part():
    assert found(f"{PAD} {PASSAGE} {PAD}") == {1}
    for n, want in ((25, {1}), (26, {1}), (24, set()), (18, set())):
        for at in (0, 7, len(WORDS) - n):
            assert found(f"{PAD} {' '.join(WORDS[at : at + n])} {PAD}") == want, (n, at)


def test_a_misspelt_word_may_begin_or_end_a_stretch():
    held = WORDS[4:29]
    assert found(f"{PAD} {' '.join(held)} {PAD}") == {1}
    assert found(f"{PAD} {held[0][:-2] + 'x' + held[0][-1]} {' '.join(held[1:])} {PAD}") == {1}
    assert found(f"{PAD} {' '.join(held[1:])} {PAD}") == set()


def test_spacing_case_markup_and_punctuation_do_not_count():
    assert found(PASSAGE.upper().replace(" ", "\n   ").replace(".", " ;").replace(",", "&#44;")) == {1}
    assert found("<p><b>" + PASSAGE.replace("violin", "<i>violin</i>").replace(" ", "&nbsp; ") + "</b></p>") == {1}
    assert plain("A&amp;B<br/>C") == "a&b c"


def test_one_word_in_six():
    rng = random.Random(0)
    for _ in range(20):
        assert found(f"{PAD} {changed(WORDS, 7, rng, 3)} {PAD}") == {1}
        assert found(f"{PAD} {changed(WORDS[:30], 3, rng)} {PAD}") == set()


def test_an_inserted_sentence_ends_a_stretch():
    assert found(" ".join(WORDS[:20]) + f" {PAD} " + " ".join(WORDS[20:40])) == set()
    assert found(" ".join(WORDS[:26]) + f" {PAD} " + " ".join(WORDS[26:])) == {1}


def test_the_same_template_with_other_values_is_none():
    other = (
        PASSAGE.replace("3503", "17").replace("talkative violin teacher", "retired dock worker").replace("parotidectomy", "nephrectomy").replace("fleeting", "mild").replace("hypocapnia", "oliguria")
        .replace("aortic stenosis", "reflux").replace("3509", "1").replace("460", "2").replace("33 ml", "4 ml").replace("24", "8").replace("91", "5").replace("62", "6").replace("subtle", "marked").replace("urgent", "open")
    )
    assert found(other) == set() and found(PASSAGE, other) == set()


def test_rows(spark):
    docs = spark.createDataFrame([(1, PASSAGE), (1, PASSAGE), (2, None), (3, ""), (4, PAD * 3000 + PASSAGE), (5, PAD)], "doc_id bigint, text string").withColumn("item_id", F.lit("x"))
    items = spark.createDataFrame([(7, PASSAGE), (8, PASSAGE), (9, None), (10, "too short"), (None, PASSAGE)], "item_id int, passage string")
    want = sorted([(1, 7), (1, 8)] * 2 + [(4, 7), (4, 8)])
    assert sorted((r.doc_id, r.item_id) for r in find_leaks(docs, items).collect()) == want
    assert sorted((r.doc_id, r.item_id) for r in find_leaks(docs, items, block=1).collect()) == want
    assert find_leaks(docs.limit(0), items).count() == 0 and find_leaks(docs, items.limit(0)).count() == 0


QUESTION = (
    "The report by Keller says that 40 ml were given at minute 12 and that the pressure fell below 65 after another 40 ml; by minute 30 Keller had "
    "added 80 ml, written down 65 twice and called Osman, who came 5 minutes later and stopped it."
)
VALUES = {"Keller": "Brandt", "40": "25", "12": "7", "65": "58", "30": "44", "80": "120", "Osman": "Lindqvist", "5": "9", "ml": "mg"}


def with_values(values):
    return " ".join(values.get(w.strip(".,;"), w.strip(".,;")) + w[len(w.rstrip(".,;")) :] for w in QUESTION.split())


def kinds(text):
    return [(x[2], x[5]) for x in Index([(1, QUESTION)], Rule()).scan([f"{PAD} {text} {PAD}"])]


def test_other_values_in_the_slots_are_a_reparameterised_question(monkeypatch):
    assert kinds(QUESTION) == [("verbatim", 0)]
    # Names of the passage are known to be such; those of a text can't be, so names are kept here.
    numbers = with_values({k: v for k, v in VALUES.items() if k not in ("Keller", "Osman")})
    assert kinds(numbers) == [("reparameterised", 7)]
    # A passage value that stands for two values of the text is an edit for each further place.
    at = numbers.index("25", numbers.index("25") + 2)
    (one,) = Index([(1, QUESTION)], Rule()).scan([numbers])
    (two,) = Index([(1, QUESTION)], Rule()).scan([numbers[:at] + "26" + numbers[at + 2 :]])
    assert one[2:] == ("reparameterised", len(QUESTION.split()), 0, 7) and two[2] == "reparameterised" and two[4] == 1
    # Without the template nothing of it is found.
    monkeypatch.setattr(leakage, "template", lambda token, names: token)
    assert kinds(QUESTION) == [("verbatim", 0)] and kinds(numbers) == []


def test_a_fragment_before_a_stretch_does_not_hide_it():
    """An exact run of 22 words, then 30 words of the same part with one edit in six: both are walked."""
    rng = random.Random(1)
    assert found(f"{PAD} {' '.join(WORDS[2:24])} as noted again here before {changed(WORDS[:32], 7, rng, 3)} {PAD}") == {1}


def test_markup_of_any_length_does_not_count():
    for n in (50, 190, 230, 5000):
        tag = f'<span style="{"x" * n}">'
        assert found(f"{' '.join(WORDS[:14])} {tag} {' '.join(WORDS[14:28])}") == {1}
    assert plain("map < 65 and hr > 100") == "map < 65 and hr > 100"
