"""Problem 8: items of varying length packed into containers of fixed capacity with little unused space."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.tokens import TOKENIZER, token_counts
from pulsegrid.session import checkpointed


MOST_TABLE = 1 << 28  # bytes of first numbers by length and salt, of all capacities together, that go to every worker


def best_multiset(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> dict[int, int]:
    """A multiset of lengths, each used at most its count, whose sum is the largest that ``capacity`` allows (minimum bin slack).

    The sums that the lengths reach are bits of one integer. A count is split into powers of two, so that each power is one
    shift; the bits after every shift are kept for the way back, which subtracts what a sum first needed. The largest length
    is taken first, so that long items find a container while short ones are left to fill it.
    """
    mask = (1 << (capacity + 1)) - 1
    first = int(lengths[-1])
    reached, trail = 1 << first, []
    full = 1 << capacity
    for k in range(len(lengths) - 1, -1, -1):
        size = int(lengths[k])
        left = min(int(counts[k]) - (k == len(lengths) - 1), (capacity - first) // size)
        step = 1
        while left > 0:
            use = min(step, left)
            after = (reached | (reached << (use * size))) & mask
            if after != reached:
                trail.append((size, use, reached))
                reached = after
            left -= use
            step *= 2
        if reached & full:
            break
    total = reached.bit_length() - 1
    chosen = {first: 1}
    for size, use, before in reversed(trail):
        if not (before >> total) & 1:
            chosen[size] = chosen.get(size, 0) + use
            total -= use * size
    return chosen


def plan(lengths: list[int], counts: list[int], capacity: int) -> list[tuple[int, int, dict[int, int]]]:
    """(first container, number of containers, multiset) that use up a histogram of lengths, none over ``capacity``.

    Each multiset is the best for the longest length left and is repeated as often as the counts allow, so the plan has about as
    many rounds as there are different lengths, however many items there are.
    """
    lengths, counts = np.array(lengths, np.int64), np.array(counts, np.int64)
    order = np.argsort(lengths)
    lengths, counts = lengths[order], counts[order]
    out, at = [], 0
    while len(lengths):
        chosen = best_multiset(lengths, counts, capacity)
        where = {int(s): k for k, s in enumerate(lengths)}
        times = min(int(counts[where[s]]) // n for s, n in chosen.items())
        for s, n in chosen.items():
            counts[where[s]] -= n * times
        out.append((at, times, chosen))
        at += times
        live = counts > 0
        lengths, counts = lengths[live], counts[live]
    return out


def intervals(rounds: list[tuple[int, int, dict[int, int]]]) -> dict[int, np.ndarray]:
    """By length: rows (first rank, items per container, first container, offset of the first item of this length)."""
    used: dict[int, int] = {}
    out: dict[int, list] = {}
    for first, times, chosen in rounds:
        offset = 0
        for size in sorted(chosen, reverse=True):
            n = chosen[size]
            out.setdefault(size, []).append((used.get(size, 0), n, first, offset))
            used[size] = used.get(size, 0) + n * times
            offset += n * size
    return {size: np.array(rows, np.int64) for size, rows in out.items()}


def pack(documents: DataFrame, capacities: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, most_capacity: int = 1 << 16, salts: int = 64) -> DataFrame:
    """One row per capacity and piece of a document: capacity_id, doc_id, piece, tokens, container, start.

    A document longer than a capacity is split into full pieces and a rest, any other is one piece. Each capacity's
    containers are numbered from 0; ``start`` is where the piece begins in its container. Documents of no tokens (NULL or empty
    texts) fill nothing and are left out. Repeated rows are packed each. Ties among equal lengths are by id within a salt.

    Containers are planned from the histogram of lengths, which has at most ``capacity`` rows whatever the corpus holds
    (``most_capacity`` and the size of all capacities' tables, MOST_TABLE, are checked), by minimum bin slack; full pieces are containers of their own and take no part. Documents of one
    length may be a third of all: they are numbered within salted groups, whose sizes (at most salts for each length) give
    each group its first number. Only histogram and plan, both bounded by the capacity, pass through the driver.
    """
    wanted = [(int(r[0]), int(r[1])) for r in capacities.select("capacity_id", "capacity_tokens").distinct().limit(1001).collect() if r[0] is not None and r[1] is not None]
    if any(not 0 < c <= most_capacity for _, c in wanted) or len(wanted) > 1000:
        raise ValueError(f"capacities must be between 1 and {most_capacity}, and at most 1000")
    if sum(c for _, c in wanted) * salts * 16 > MOST_TABLE:
        raise ValueError(f"the capacities together need tables of more than {MOST_TABLE} bytes: pack in parts")
    sized = token_counts(documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "doc_id", "text", tokenizer).filter("tokens > 0")
    # One row per document and capacity: the rest after full pieces, with a salt that numbers equal lengths apart.
    sized = checkpointed(sized.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int")))
    each = F.array(*[F.struct(F.lit(i).alias("capacity_id"), F.lit(c).alias("capacity")) for i, c in wanted]) if wanted else F.expr("cast(array() as array<struct<capacity_id: int, capacity: int>>)")
    rests = (
        sized.select("doc_id", "tokens", "salt", F.explode(each).alias("c"))
        .select("doc_id", "salt", "c.capacity_id", "c.capacity", F.floor(F.col("tokens") / F.col("c.capacity")).cast("int").alias("full"), F.col("tokens"))
        .withColumn("rest", (F.col("tokens") - F.col("full") * F.col("capacity")).cast("int"))
        .drop("tokens")
    )
    groups = rests.groupBy("capacity_id", "rest", "salt").agg(F.count("*").alias("n"), F.sum("full").alias("full")).toArrow().to_pandas()
    groups = groups.sort_values(["capacity_id", "rest", "salt"]).reset_index(drop=True)
    groups["base"] = groups.groupby(["capacity_id", "rest"])["n"].cumsum() - groups["n"]
    groups["full_base"] = groups.groupby("capacity_id")["full"].cumsum() - groups["full"]
    plans: dict[int, tuple] = {}
    for capacity_id, capacity in wanted:
        own = groups[groups["capacity_id"] == capacity_id]
        histogram = own[own["rest"] > 0].groupby("rest")["n"].sum()
        rounds = plan([int(x) for x in histogram.index], [int(x) for x in histogram], capacity)
        bases = np.zeros((2, capacity, salts), np.int64)
        bases[0, own["rest"], own["salt"]] = own["base"]
        bases[1, own["rest"], own["salt"]] = own["full_base"]
        plans[capacity_id] = (intervals(rounds), rounds[-1][0] + rounds[-1][1] if rounds else 0, bases)
    numbered = rests.withColumn("rank", F.expr("row_number() over (partition by capacity_id, rest, salt order by doc_id)") - 1).withColumn(
        "fulls_before", F.expr("coalesce(sum(full) over (partition by capacity_id, rest, salt order by doc_id rows between unbounded preceding and 1 preceding), 0)")
    )
    shared = documents.sparkSession.sparkContext.broadcast(plans)  # bounded by capacities times salts
    kind = documents.schema[id_col].dataType.simpleString()

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        plans = shared.value
        for frame in frames:
            if not len(frame):
                continue
            out = []
            for (capacity_id, capacity, rest), part in frame.groupby(["capacity_id", "capacity", "rest"], sort=False):
                by_length, planned, bases = plans[int(capacity_id)]
                based = bases[:, int(rest), part["salt"].to_numpy()]
                full = part["full"].to_numpy(np.int64)
                ids = part["doc_id"].to_numpy()
                if full.any():
                    owner = np.repeat(np.arange(len(part)), full)
                    piece = np.arange(len(owner)) - np.repeat(np.cumsum(full) - full, full)
                    first = planned + based[1] + part["fulls_before"].to_numpy(np.int64)
                    out.append(pd.DataFrame({"capacity_id": capacity_id, "doc_id": ids[owner], "piece": piece, "tokens": int(capacity), "container": first[owner] + piece, "start": 0}))
                if rest > 0:
                    rows = by_length[int(rest)]
                    rank = based[0] + part["rank"].to_numpy(np.int64)
                    k = np.searchsorted(rows[:, 0], rank, side="right") - 1
                    into = rank - rows[k, 0]
                    per = rows[k, 1]
                    out.append(pd.DataFrame({"capacity_id": capacity_id, "doc_id": ids, "piece": full, "tokens": int(rest), "container": rows[k, 2] + into // per, "start": rows[k, 3] + into % per * int(rest)}))
            yield pd.concat(out).astype({"capacity_id": "int32", "piece": "int32", "tokens": "int32", "container": "int64", "start": "int32"})

    return numbered.mapInPandas(place, f"capacity_id int, doc_id {kind}, piece int, tokens int, container bigint, start int")


def container_fill(packed: DataFrame, capacities: DataFrame) -> DataFrame:
    """By capacity: containers, tokens and the share of space left unused (rounded to 6 places)."""
    per = packed.groupBy("capacity_id").agg((F.max("container") + 1).alias("containers"), F.sum("tokens").alias("tokens"))
    return per.join(F.broadcast(capacities.select("capacity_id", "capacity_tokens")), "capacity_id").select(
        "capacity_id", F.col("containers").cast("bigint").alias("containers"), F.col("tokens").cast("bigint").alias("tokens"), F.round(1 - F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")), 6).alias("unused_share")
    )
