import dataclasses
import random
import re

from conftest import SMALL
from pyspark.sql import functions as F

from pulsegrid.llm.repetition import Settings, Words, features, fit, measure, repeated_share
from pulsegrid.sources.tables import table


def brute(text, n=6):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    seen, covered = set(), set()
    for i in range(len(w) - n + 1):
        g = tuple(w[i : i + n])
        if g in seen:
            covered |= set(range(i, i + n))
        seen.add(g)
    return len(covered) / len(w) if w else 0.0


def test_share_agrees_with_brute_force():
    rng = random.Random(3)
    texts = [None, "", "...", "one two", "a a a a a a a a a"]
    for _ in range(60):
        part = [rng.choice("abcdefgh") * rng.randrange(1, 3) for _ in range(rng.randrange(3, 40))]
        texts.append(", ".join(part * rng.randrange(1, 3)) + "! " + " ".join(rng.sample(part, 3)))
    got = repeated_share(Words(texts), 6)
    assert all(abs(a - brute(t)) < 1e-12 for a, t in zip(got, texts))


def test_case_punctuation_and_spacing_do_not_count():
    a = "The line was flushed and zeroed at once."
    assert abs(repeated_share(Words([a + "\n\n" + a.upper().replace(" ", " - ")]), 6)[0] - 0.5) < 1e-12


def test_model_ranks_repetition_high():
    rng = random.Random(0)
    plain = [" ".join(rng.choice("abcdefghijklmnopqrst") * rng.randrange(1, 4) for _ in range(rng.randrange(20, 200))) for _ in range(300)]
    m = fit(plain)
    held = [" ".join(rng.choice("abcdefghijklmnopqrst") * rng.randrange(1, 4) for _ in range(120)) for _ in range(40)]
    p = m.probability(features(held + [f"{t} {t}" for t in held], Words(held + [f"{t} {t}" for t in held]), Settings()))
    assert p[40:].min() > 0.5 > p[:40].max()


def test_rows(spark):
    once = "the flush system lost signal for nine minutes before the cart moved"
    docs = spark.createDataFrame([(1, f"{once}. {once}. {once}."), (1, f"{once}. {once}. {once}."), (2, None), (3, ""), (4, once), (5, f"{once} " * 20_000), (6, "?!")], "doc_id bigint, text string")
    docs = docs.withColumn("n_words", F.lit("x")).withColumn("probability", F.lit(0))
    rows = measure(docs).collect()
    assert len(rows) == 7 and sorted(r.doc_id for r in rows if r.mostly_repeated) == [1, 1, 5]
    assert {r.doc_id: r.n_words for r in rows}[6] == 0 and measure(docs.limit(0)).count() == 0


def test_nomination_loses_none(spark):
    rows = measure(table(spark, SMALL, "documents")).collect()
    over = [r for r in rows if r.repeated_share >= 0.3]
    assert over and sum(r.mostly_repeated for r in over) == len(over)


def test_long_texts_just_over_the_share_are_nominated(spark):
    """Words of real documents in random order, with a copy of a part: shares of 0.31 on, from 4,000 to 400,000 characters."""
    texts = [r.text for r in table(spark, SMALL, "documents").collect() if r.text]
    rng = random.Random(5)
    words = [w for t in texts for w in t.split()]
    model = fit(texts)
    for n in (500, 5_000, 50_000):
        for share in (0.31, 0.35, 0.5):
            base = [rng.choice(words) for _ in range(n)]
            text = " ".join(base + base[: int(n * share / (1 - share)) + 8])
            assert model.probability(features([text], Words([text]), Settings()))[0] >= 10 * Settings().nominate


def test_the_model_decides_what_is_measured(spark):
    """A model that finds nothing likely lists nothing, whatever the share; weights of single n-grams move the probability."""
    once = "the flush system lost signal for nine minutes before the cart moved"
    docs = spark.createDataFrame([(k, f"{once} {k}. {once} {k}.") for k in range(4)] + [(9, once)], "doc_id bigint, text string")
    model = fit([once, f"{once} {once}"] * 20)
    assert {r.doc_id for r in measure(docs, model=model, everything=False).collect() if r.mostly_repeated} == {0, 1, 2, 3}
    never = dataclasses.replace(model, shift=-1e6)
    rows = measure(docs, model=never, everything=False).collect()
    assert not any(r.mostly_repeated for r in rows) and all(r.repeated_share is None for r in rows)
    bare = dataclasses.replace(model, bag=model.bag * 0)
    g = features([once], Words([once]), Settings())
    assert len(model.bag) == 1 << 18 and abs(model.logit(g)[0] - bare.logit(g)[0]) > 0.01
