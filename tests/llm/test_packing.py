import itertools
import random

import numpy as np
import pytest
from conftest import SMALL

from pulsegrid.llm.packing import best_multiset, container_fill, pack, plan
from pulsegrid.llm.tokens import TOKENIZER, _parts, encoding
from pulsegrid.sources.tables import table

CAPS = "capacity_id int, capacity_tokens int"


def test_the_best_multiset_is_the_fullest_with_the_longest_item():
    rng = random.Random(4)
    for _ in range(60):
        lengths = sorted(rng.sample(range(2, 30), 5))
        counts = [rng.randrange(1, 4) for _ in lengths]
        capacity = rng.randrange(30, 60)
        chosen = best_multiset(np.array(lengths), np.array(counts), capacity)
        assert all(n <= counts[lengths.index(s)] for s, n in chosen.items()) and lengths[-1] in chosen
        best = max(
            t for n in itertools.product(*[range(c + 1) for c in counts]) if n[-1] >= 1 and (t := sum(a * b for a, b in zip(n, lengths))) <= capacity
        )
        assert sum(s * n for s, n in chosen.items()) == best


def test_a_plan_uses_every_item_once():
    rng = random.Random(5)
    lengths = sorted(rng.sample(range(1, 100), 30))
    counts = [rng.randrange(1, 5000) for _ in lengths]
    rounds = plan(lengths, counts, 100)
    used = {s: sum(t * c.get(s, 0) for _, t, c in rounds) for s in lengths}
    assert used == dict(zip(lengths, counts)) and len(rounds) < 200
    containers = rounds[-1][0] + rounds[-1][1]
    free, best_fit = [0] * 101, 0
    for size, n in sorted(zip(lengths, counts), reverse=True):
        for _ in range(n):
            room = next((r for r in range(size, 101) if free[r]), None)
            if room is None:
                best_fit, room = best_fit + 1, 100
            else:
                free[room] -= 1
            free[room - size] += 1
    assert containers <= best_fit
    assert plan([], [], 100) == []


def check(spark, texts, capacities, extra=""):
    df = spark.createDataFrame(texts, "doc_id bigint, text string")
    caps = spark.createDataFrame(capacities, CAPS)
    rows = pack(df, caps).collect()
    t = encoding(TOKENIZER)
    size = {}
    for d, x in texts:
        size.setdefault(d, []).append(len(t.encode_ordinary(x or "")))
    for cid, cap in {c for c in capacities if None not in c}:
        mine = [r for r in rows if r.capacity_id == cid]
        assert sum(r.tokens for r in mine) == sum(sum(v) for v in size.values())
        held = {}
        for r in mine:
            held.setdefault(r.container, []).append((r.start, r.start + r.tokens))
        for spans in held.values():
            spans.sort()
            assert spans[0][0] == 0 and spans[-1][1] <= cap and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
        assert set(held) == set(range(len(held)))
        for d, n in size.items():
            if len(n) == 1:
                pieces = sorted((r.piece, r.tokens) for r in mine if r.doc_id == d)
                assert [p for p, _ in pieces] == list(range(len(pieces))) and sum(k for _, k in pieces) == n[0]
                assert len(pieces) == -(-n[0] // cap)  # split only if longer than the capacity
    return rows


def test_pieces_containers_and_splits(spark):
    rng = random.Random(1)
    texts = [(k, " ".join(rng.choice(["map", "of", "the", "cuff"]) for _ in range(rng.choice([3, 3, 3, 8, 21, 70])))) for k in range(300)]
    check(spark, texts, [(1, 16), (2, 64), (3, 1000)])


def test_edges(spark):
    texts = [(1, None), (2, ""), (3, "one"), (3, "one"), (4, "a b " * 30_000), (5, "one")]
    rows = check(spark, texts, [(1, 512), (1, 512), (2, 8), (None, 4), (3, None)])
    assert {r.doc_id for r in rows} == {3, 4, 5}
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert pack(empty, spark.createDataFrame([(1, 5)], CAPS)).count() == 0
    assert pack(empty, spark.createDataFrame([], CAPS)).count() == 0
    with pytest.raises(ValueError, match="capacities"):
        pack(empty, spark.createDataFrame([(1, 0)], CAPS))


def test_counting_in_parts_is_counting_the_whole():
    t = encoding(TOKENIZER)
    text = "The mean pressure fell to 58 mmHg;  then rose.\n\nNext – x1.5 " * 900
    assert sum(len(t.encode_ordinary(p)) for p in _parts(text, 500)) == len(t.encode_ordinary(text))
    assert "".join(_parts(text, 500)) == text and _parts("x" * 2000, 500) == ["x" * 2000]


def test_whole_table_leaves_little_unused(spark):
    caps = table(spark, SMALL, "pack_capacities")
    fill = {r.capacity_id: r for r in container_fill(pack(table(spark, SMALL, "documents"), caps), caps).collect()}
    sizes = {r.capacity_id: r.capacity_tokens for r in caps.collect()}
    assert all(f.containers <= -(-f.tokens // sizes[c]) + 1 for c, f in fill.items())


def test_tables_of_all_capacities_are_bounded(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id bigint, text string")
    with pytest.raises(ValueError, match="in parts"):
        pack(docs, spark.createDataFrame([(k, 65_000) for k in range(10)], "capacity_id int, capacity_tokens int"))
