"""Problem 9: passages of held-out test items inside documents, whole or in part."""

from __future__ import annotations

import html
import re
import uuid
from collections import Counter, namedtuple
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from difflib import SequenceMatcher
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TAG = re.compile(r"<[/!?a-zA-Z][^<>]*>")
WORD = re.compile(r"[^\W_]+")
# Units, which a template replaces as it does numbers.
UNITS = frozenset("ml l cm mm m kg g mg mcg grams gram percent mmhg kpa minutes minute min hours hour seconds units bpm mikrogramm minuten".split())


@dataclass(frozen=True)
class Rule:
    """What counts as a leak, in words of the passage."""

    words: int = 25  # in a row
    per_edit: int = 6  # at most one word in so many changed, added or misspelt
    per_edit_alike: int = 12  # the same for a stretch with other values in its slots
    window: int = 5  # words of a template window

    @property
    def edits(self) -> int:
        return self.words // self.per_edit


def plain(text: str) -> str:
    """Text without markup and character references, in lower case; soft hyphens and joins inside a word vanish."""
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = TAG.sub(" ", text)
    return text.replace("­", "").replace("​", "").lower()


def tokens(text: str) -> list[str]:
    return WORD.findall(plain(text))


def template(token: str, names: frozenset[str]) -> str:
    """The typed placeholder of a token that fills a slot, else the token."""
    if token[0].isdigit():
        return "0"
    if token in UNITS:
        return "u"
    return "n" if token in names else token


Block = namedtuple("Block", "a b size")
PLACES = 2_000_000  # places of template windows looked at together


class _Templates(dict):
    def __init__(self, templated):
        super().__init__()
        self.templated = templated

    def __missing__(self, token: str) -> str:
        self[token] = out = self.templated(token)
        return out


class _Ids(dict):
    """A number for each token; beside it the hashes of the token and of its template. Cleared when it has grown large."""

    def __init__(self, templated):
        super().__init__()
        self.templated, self.hashes, self.since = templated, ([], []), 0

    def __missing__(self, token: str) -> int:
        self[token] = n = len(self)
        self.hashes[0].append(hash(token))
        self.hashes[1].append(hash(self.templated(token)))
        return n

    def clear(self) -> None:
        super().clear()
        self.hashes = ([], [])
        self.since += 1


@dataclass
class Item:
    item_id: int
    tokens: list[str]
    templated: list[str]
    word_of: np.ndarray  # the passage's word that each token belongs to
    n_words: int
    ids: tuple[int, np.ndarray] | None = None  # numbers of the tokens, and since which clearing they hold


class Index:
    """Template windows of all passages, hashed, with the places where each occurs."""

    def __init__(self, items: list[tuple[int, str]], rule: Rule):
        self.rule, self.items = rule, []
        self.names = self._names([t for _, t in items])
        for item_id, passage in items:
            held, word_of = [], []
            pieces = plain(passage or "").split()
            w = 0
            for piece in pieces:
                found = WORD.findall(piece)
                held += found
                word_of += [w] * len(found)
                w += bool(found)
            self.items.append(Item(item_id, held, [self.templated(t) for t in held], np.array(word_of, np.int64), w))
        self.ids, self.known = _Ids(self.templated), _Templates(self.templated)
        # Windows of all passages, sorted by the key of their template: where each occurs, and the key of its own words.
        places = [(key, own, k, at) for k, item in enumerate(self.items) for at, (own, key) in enumerate(zip(*(x.tolist() for x in self._keys_of(item.tokens)[:2]), strict=True))]
        places.sort()
        self.template, self.own, self.item_of, self.at = (np.array([x[j] for x in places], np.int64) for j in range(4))
        self.keys, self.first = np.unique(self.template, return_index=True)
        self.times = np.diff(np.append(self.first, len(places)))
        self.bits = np.zeros(1 << 20, bool)
        self.bits[self.keys & (len(self.bits) - 1)] = True

    def _keys_of(self, found: Iterable[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The keys of all windows, by their words and by their template, and the numbers of the words."""
        ids = np.fromiter(map(self.ids.__getitem__, found), np.int64)
        own, templated = (np.array(h, np.int64)[ids] for h in self.ids.hashes) if len(ids) else (ids, ids)
        return self._keys(own), self._keys(templated), ids

    def _ids_of(self, item: Item) -> np.ndarray:
        if item.ids is None or item.ids[0] != self.ids.since:
            item.ids = self.ids.since, np.fromiter(map(self.ids.__getitem__, item.tokens), np.int64)
        return item.ids[1]

    def templated(self, token: str) -> str:
        return template(token, self.names)

    @staticmethod
    def _names(passages: list[str]) -> frozenset[str]:
        """Words that passages only write with a capital inside a sentence."""
        inner, small = set(), set()
        for p in passages:
            for sentence in re.split(r"[.!?]\s+", p or ""):
                found = re.findall(r"[^\W\d_]+", sentence)
                inner |= {w.lower() for w in found[1:] if w[0].isupper()}
                small |= {w for w in found if w[0].islower()}
        return frozenset(inner - small)

    def _keys(self, marks: np.ndarray) -> np.ndarray:
        n = len(marks) - self.rule.window + 1
        if n <= 0:
            return np.empty(0, np.int64)
        key = np.zeros(n, np.uint64)
        with np.errstate(over="ignore"):
            for k in range(self.rule.window):
                key = (key ^ (key >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + marks[k : k + n].astype(np.uint64)
            key ^= key >> np.uint64(32)
        return key.view(np.int64)

    def scan(self, texts: list[str]) -> list[tuple[int, int, str, int, int, int]]:
        """(text, item_id, kind, words, edits, slots) for each item that a text carries; see :func:`find_leaks`.

        Windows of all texts are hashed in one array and looked up at once; only texts with a window of some passage's template
        are looked at further.
        """
        found = [tokens(t) for t in texts]
        sizes = np.array([len(f) for f in found], np.int64)
        doc = np.repeat(np.arange(len(found)), sizes)
        own, keys, ids = self._keys_of(chain.from_iterable(found))
        if not len(keys) or not len(self.keys):
            return []
        w = self.rule.window
        maybe = np.flatnonzero(self.bits[keys & (len(self.bits) - 1)] & (doc[: len(keys)] == doc[w - 1 :]))
        at = np.minimum(np.searchsorted(self.keys, keys[maybe]), len(self.keys) - 1)
        known = self.keys[at] == keys[maybe]
        hits, at = maybe[known], at[known]
        begin = np.cumsum(sizes) - sizes
        out = []
        # Each hit meets every place of its template; so many at once that the table of places stays small.
        ends = np.cumsum(self.times[at])
        low = 0
        while low < len(hits):
            high = max(int(np.searchsorted(ends, (ends[low - 1] if low else 0) + PLACES, side="right")), low + 1)
            while high < len(hits) and doc[hits[high]] == doc[hits[high - 1]]:
                high += 1
            out += self._settle(found, begin, doc, own, ids, hits[low:high], at[low:high])
            low = high
        return out

    def _settle(self, found: list[list[str]], begin: np.ndarray, doc: np.ndarray, own: np.ndarray, ids: np.ndarray, hits: np.ndarray, at: np.ndarray) -> list[tuple]:
        """The results of whole texts, given their hits and the templates these are of."""
        times = self.times[at]
        hit = np.repeat(hits, times)
        place = np.repeat(self.first[at] - (np.cumsum(times) - times), times) + np.arange(times.sum())
        pair = doc[hit] * len(self.items) + self.item_of[place]
        order = np.argsort(pair, kind="stable")
        pair, hit, place = pair[order], hit[order], place[order]
        same = own[hit] == self.own[place]  # the slots hold the passage's values
        word, spot = hit - begin[doc[hit]], self.at[place]
        starts = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
        counts = np.diff(np.append(starts, len(pair)))
        some = np.logical_or.reduceat(same, starts) if len(starts) else np.empty(0, bool)
        for k in np.unique(self.item_of[place]).tolist():
            self._ids_of(self.items[k])
        held = np.zeros(len(self.ids), bool)  # of all words, those of the text at hand
        held_of = -1
        out = []
        for s, n in zip(starts[some | (counts >= self._least_alike)].tolist(), counts[some | (counts >= self._least_alike)].tolist(), strict=True):
            d, k = divmod(int(pair[s]), len(self.items))
            item, part = self.items[k], slice(s, s + n)
            if d != held_of:
                if held_of >= 0:
                    held[ids[begin[held_of] : begin[held_of] + len(found[held_of])]] = False
                held[ids[begin[d] : begin[d] + len(found[d])]] = True
                held_of = d
            enough = n >= self._least_alike
            if not enough and not self._few_lacking(~held[self._ids_of(item)], item):
                continue  # the whole text lacks too many of the passage's words
            seeds = list(zip(word[part].tolist(), spot[part].tolist(), strict=True))
            exact = [x for x, e in zip(seeds, same[part].tolist(), strict=True) if e]
            got = self._stretch(found[d], item.tokens, item, exact) if exact else None
            if got:
                out.append((d, item.item_id, "verbatim", *got[:2], 0))
            elif self._alike_enough(seeds):
                got = self._with_other_values(found[d], item, seeds)
                if got:
                    out.append((d, item.item_id, "reparameterised", *got))
        return out

    def leaks(self, text: str, memo: dict | None = None, kind: str = "verbatim") -> list[tuple[int, int, int]]:
        """(item_id, words, edits) of one text."""
        return [(x[1], x[3], x[4]) for x in self.scan([text]) if x[2] == kind]

    @property
    def _least_alike(self) -> int:
        """Windows that a stretch with other values must keep whole."""
        rule = self.rule
        return max(1, rule.words - rule.window + 1 - rule.words // rule.per_edit_alike * rule.window)

    def _alike_enough(self, alike: list[tuple[int, int]]) -> bool:
        """Whether so many windows lie together near one diagonal: within the tokens of rule.words words (two tokens a word at most)."""
        least, drift, span = self._least_alike, 2 * (self.rule.words // self.rule.per_edit_alike), 2 * self.rule.words
        if len(alike) < least:
            return False
        near: dict[int, list[int]] = {}
        for d, p in alike:
            near.setdefault(d - p, []).append(d)
        for low in near:
            at = sorted({d for x in range(low, low + drift + 1) for d in near.get(x, ())})
            if any(at[k + least - 1] - at[k] <= span for k in range(len(at) - least + 1)):
                return True
        return False

    def _with_other_values(self, found: list[str], item: Item, seeds: list[tuple[int, int]]) -> tuple[int, int, int] | None:
        """words, edits, slots of a stretch that has the passage's template with other values in its slots, walking from its windows.

        Slots must be consistent: a value of the passage stands for one value of the text wherever it occurs in the stretch
        (each further place counts as an edit), and some value must differ.
        """
        low, high = max(0, min(d for d, _ in seeds) - len(item.tokens)), min(len(found), max(d for d, _ in seeds) + 2 * len(item.tokens))
        got = self._stretch([self.known[t] for t in found[low:high]], item.templated, item, [(d - low, p) for d, p in seeds], walks_only=True)
        if not got:
            return None
        words, edits, pairs = got
        stands: dict[str, Counter] = {}
        for a, b in pairs:
            if item.templated[b] != item.tokens[b] or item.tokens[b][0].isdigit():
                stands.setdefault(item.tokens[b], Counter())[found[low + a]] += 1
        usual = {own: c.most_common(1)[0] for own, c in stands.items()}
        edits += sum(sum(c.values()) - usual[own][1] for own, c in stands.items())
        slots = sum(own != there for own, (there, _) in usual.items())
        return (words, edits, slots) if slots and edits <= words // self.rule.per_edit_alike else None

    def _stretch(self, found: list[str], own: list[str], item: Item, seeds: list[tuple[int, int]], walks_only: bool = False) -> tuple[int, int, list[tuple[int, int]]] | None:
        """The longest stretch of at least rule.words words around the seeds with at most one edit in rule.per_edit words, with its
        pairs of places. ``found`` and ``own`` are the tokens of text and passage, or the templates of both."""
        reach = len(own) + self.rule.edits * 2 + 8
        seeds = sorted(seeds)
        best, at = None, 0
        while at < len(seeds):
            # Seeds that one stretch could hold together.
            end = at + 1
            while end < len(seeds) and seeds[end][0] - seeds[end - 1][0] < reach:
                end += 1
            low, high = max(0, seeds[at][0] - reach), min(len(found), seeds[end - 1][0] + reach)
            if self._promising(found[low:high], own, item):
                got = self._within(found, own, item, seeds[at:end], walks_only)
                if got and (best is None or got[:2] > best[:2]):
                    best = got
            at = end
        return best

    def _within(self, found: list[str], own: list[str], item: Item, seeds: list[tuple[int, int]], walks_only: bool) -> tuple[int, int, list[tuple[int, int]]] | None:
        best = None
        walked: set[tuple[int, int]] = set()
        aligned: list[int] = []
        # A stretch through a seed leaves its diagonal by its edits at most; so do stretches through seeds of diagonals close by.
        close = 8
        slack = len(own) // self.rule.per_edit + 2 * close
        for d, p in seeds:
            if (d, p) in walked:
                continue
            # Walking from a seed settles most candidates; every seed that no walk has passed is the start of another.
            blocks = self._along(found, own, d, p)
            walked.update((b.a + j, b.b + j) for b in blocks for j in range(b.size))
            got = self._judge(blocks, item, own, found, 0)
            if got is None and not walks_only and all(abs(d - p - x) > close for x in aligned):
                # The rest are aligned over all that a stretch through the seed can reach.
                aligned.append(d - p)
                low, high = max(0, d - p - slack), min(len(found), d - p + len(own) + slack)
                if self._promising(found[low:high], own, item):
                    got = self._judge([b for b in SequenceMatcher(None, found[low:high], own, autojunk=False).get_matching_blocks() if b.size], item, own, found, low)
            if got and (best is None or got[:2] > best[:2]):
                best = got
        return best

    @staticmethod
    def _misspelt(found: list[str], d: int, own: list[str], p: int) -> bool:
        """Whether the text has a misspelt form of the passage's token p in place d."""
        if not (0 <= d < len(found) and 0 <= p < len(own)):
            return False
        a, b = found[d], own[p]
        return a != b and abs(len(a) - len(b)) <= 2 and SequenceMatcher(None, a, b, autojunk=False).ratio() >= 0.7

    def _promising(self, region: list[str], own: list[str], item: Item) -> bool:
        """Whether some stretch of the passage has at most one word in rule.per_edit that the region lacks; no leak is without one."""
        held = set(region)
        return self._few_lacking([t not in held for t in own], item)

    def _few_lacking(self, tokens: np.ndarray | list[bool], item: Item) -> bool:
        n = self.rule.words
        if item.n_words < n:
            return False
        lacking = np.bincount(item.word_of, tokens, minlength=item.n_words) > 0
        # Over words i to j: lacking <= (j - i) / per_edit, so the excess at j isn't above some excess at i <= j - n.
        excess = np.append(0, np.cumsum(lacking)) * self.rule.per_edit - np.arange(item.n_words + 1)
        return bool((excess[n:] <= np.maximum.accumulate(excess)[:-n]).any())

    def _along(self, found: list[str], own: list[str], d: int, p: int) -> list:
        """Matching blocks got by walking from a seed both ways, skipping up to the allowed edits at once."""
        skip = self.rule.edits + 1

        def walk(step: int) -> list[tuple[int, int]]:
            a, b = (d, p) if step < 0 else (d - 1, p - 1)
            out = []
            while True:
                best = None
                for total in range(1, 2 * skip + 1):
                    for da in range(max(1, total - skip), min(total, skip) + 1):
                        db = total + 1 - da
                        x, y = a + step * da, b + step * db
                        if db >= 1 and 0 <= x < len(found) and 0 <= y < len(own) and found[x] == own[y]:
                            nx, ny = x + step, y + step
                            follows = not (0 <= nx < len(found) and 0 <= ny < len(own)) or found[nx] == own[ny]
                            if total == 1 or follows:
                                best = (x, y)
                                break
                    if best:
                        break
                if not best:
                    return out
                a, b = best
                out.append(best)

        points = walk(-1)[::-1] + walk(1)
        blocks: list = []
        for a, b in points:
            if blocks and blocks[-1].a + blocks[-1].size == a and blocks[-1].b + blocks[-1].size == b:
                blocks[-1] = Block(blocks[-1].a, blocks[-1].b, blocks[-1].size + 1)
            else:
                blocks.append(Block(a, b, 1))
        return blocks

    def _judge(self, blocks: list, item: Item, own: list[str], found: list[str], shift: int) -> tuple[int, int, list[tuple[int, int]]] | None:
        """Edits are words of the passage without a full match, and words in the text between matches beyond those."""
        rule, n = self.rule, item.n_words
        if sum(b.size for b in blocks) < rule.words - rule.edits:
            return None
        sizes = np.bincount(item.word_of, minlength=n)
        matched = np.zeros(n, np.int64)
        first, last = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        for b in blocks:
            for k in range(b.size):
                w = int(item.word_of[b.b + k])
                matched[w] += 1
                if first[w] < 0:
                    first[w] = b.a + k
                last[w] = b.a + k
        whole = (matched == sizes) & (last - first == sizes - 1)
        at = np.flatnonzero(whole)
        if len(at) < rule.words - rule.edits:
            return None
        # Between neighbouring whole words: words of the passage that are missing or changed, and tokens of the text.
        missing = np.diff(at) - 1
        extra = first[at[1:]] - last[at[:-1]] - 1
        tokens_missing = np.array([sizes[a + 1 : b].sum() for a, b in zip(at[:-1], at[1:], strict=True)], np.int64)
        cost = np.where(missing > 0, np.maximum(missing, missing + extra - tokens_missing), np.maximum(extra, 0))
        total = np.concatenate([[0], np.cumsum(cost)])
        # A stretch may begin and end with a misspelt word; a changed one there can't be told from the text around it.
        begins = np.cumsum(sizes) - sizes
        ends: dict[tuple[int, int], bool] = {}

        def misspelt(k: int, step: int) -> bool:
            if (k, step) not in ends:
                w = at[k]
                ends[k, step] = self._misspelt(found, shift + (first[w] - 1 if step < 0 else last[w] + 1), own, begins[w] - 1 if step < 0 else begins[w] + sizes[w])
            return ends[k, step]

        best = None
        for i in range(len(at)):
            for j in range(len(at) - 1, i, -1):
                edits = int(total[j] - total[i])
                span = int(at[j] - at[i]) + 1
                # Each edited word taken in at an end counts as a word and as an edit.
                short = rule.words - span
                add = min(short, misspelt(i, -1) + misspelt(j, 1)) if 0 < short <= 2 else 0
                if span + add >= rule.words and edits + add <= (span + add) // rule.per_edit:
                    if best is None or span + add > best[0]:
                        best = (span + add, edits + add, i, j)
                    break
                if short > 2 or (best is not None and span + add <= best[0]):
                    break
        if best is None:
            return None
        low, high = int(begins[at[best[2]]]), int(begins[at[best[3]]] + sizes[at[best[3]]])
        return best[0], best[1], [(shift + b.a + k, b.b + k) for b in blocks for k in range(b.size) if low <= b.b + k < high]


_held: dict[str, Index] = {}  # of this worker: the index of the block it works on


def _index(key: str, part: list[tuple[int, str]], rule: Rule) -> Index:
    if key not in _held:
        _held.clear()
        _held[key] = Index(part, rule)
    return _held[key]


def find_leaks(documents: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rule: Rule = Rule(), block: int = 20_000, most_items: int = 1_000_000) -> DataFrame:
    """doc_id, item_id, kind, words, edits and slots: every document that carries a stretch of a test item's passage.

    A stretch is at least rule.words words in a row of the passage with at most one word in rule.per_edit changed, added or
    misspelt; case, punctuation, markup, spacing and line breaks don't count. Numbers, names and units are replaced with typed
    placeholders, and windows of rule.window template words are hash-joined with those of the passages: every window of the
    same template is a candidate, whatever its slots hold. Where the slots hold the passage's own values, the tokens are aligned
    word by word, and a stretch is ``verbatim``. Else the templates are aligned, and a stretch with at most one edit in
    rule.per_edit_alike words, in whose slots each value of the passage stands for one value of the text, is ``reparameterised`` (the same question
    with other numbers, names or units), with the number of ``slots`` that differ. A document and item have one row, verbatim before the other. Only the passage is test material. NULL and
    empty texts and passages carry nothing; repeated documents come out each; items with equal passages all come out.

    Test items are a stated set (at most ``most_items``, checked), taken in blocks of ``block`` passages, each a pass over all
    documents; a block is sent to the workers once and indexed once by each. Documents stay where they lie: there is no shuffle, and whole texts are read.
    """
    wanted = items.select("item_id", "passage").filter(F.col("passage").isNotNull() & F.col("item_id").isNotNull())
    held = [(int(r[0]), r[1]) for r in wanted.limit(most_items + 1).collect()]
    if len(held) > most_items:
        raise ValueError(f"more than {most_items} test items: search for them in parts")
    kind = documents.schema[id_col].dataType.simpleString()
    source = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).filter(F.length("text") > 0)
    context = documents.sparkSession.sparkContext

    def scan(part: list[tuple[int, str]]) -> DataFrame:
        shared, key = context.broadcast(part), uuid.uuid4().hex  # at most ``block`` passages

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = _index(key, shared.value, rule)
            for whole in batches:
                for at in range(0, whole.num_rows, 2_000):
                    batch = whole.slice(at, 2_000)
                    if len(index.ids) > 500_000:
                        index.ids.clear()
                        index.known.clear()
                    found = index.scan(batch.column(1).to_pylist())
                    kinds = (pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32())
                    columns = [pa.array([f[j] for f in found], t) for j, t in enumerate(kinds)]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(columns[0]), *columns[1:]], names=["doc_id", "item_id", "kind", "words", "edits", "slots"])

        return source.mapInArrow(run, f"doc_id {kind}, item_id int, kind string, words int, edits int, slots int")

    out = scan(held[:block])
    for at in range(block, len(held), block):
        out = out.unionByName(scan(held[at : at + block]))
    return out
