"""Problem 10: the share of a document's words that repeat its own earlier words."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WORD = re.compile(r"[^\W_]+")


@dataclass(frozen=True)
class Settings:
    copy_words: int = 6  # words in a row that make a copy
    share: float = 0.3  # of a document's words in second or later copies, from which it repeats itself
    word_grams: tuple[int, ...] = (2, 3)  # whose repeated shares the model sees as such
    char_gram: int = 5
    bins: int = 1 << 18  # of hashed n-grams, each with a weight of its own
    sample_documents: int = 2_000  # most labelled rows for training
    sample_chars: int = 500_000  # longest text among them
    sample_total: int = 5_000_000  # characters of all of them
    nominate: float = 0.0001  # calibrated probability from which a document is nominated
    ridge: float = 1e-3
    bag_ridge: float = 1e-2
    bag_steps: int = 25


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """The words of a batch of texts as numbers, one text after the other."""

    def __init__(self, texts: list[str | None]):
        known: dict[str, int] = {}
        ids, sizes = [], []
        for text in texts:
            found = WORD.findall(text.lower()) if text else ()
            sizes.append(len(found))
            for w in found:
                ids.append(known.setdefault(w, len(known)))
        self.ids, self.sizes = np.array(ids, np.int64), np.array(sizes, np.int64)
        self.doc = np.repeat(np.arange(len(sizes)), self.sizes)
        names = np.fromiter((hash_text(w) for w in known), np.uint64, len(known))
        self.hashed = names[self.ids] if len(ids) else np.empty(0, np.uint64)

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions at which n words of one text begin, and a 64-bit hash of text and words."""
        last = len(self.ids) - n + 1
        if last <= 0:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        at = np.flatnonzero(self.doc[:last] == self.doc[n - 1 :])
        key = _mixed(self.doc[at].astype(np.uint64) + np.uint64(1))
        for k in range(n):
            key = _mixed(key + self.hashed[at + k])
        return at, key

    def repeated(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions of all n-grams, and which of them occurred before in the same text."""
        at, key = self.grams(n)
        order = np.argsort(key, kind="stable")
        again = np.zeros(len(key), bool)
        if len(key):
            again[order[1:]] = key[order[1:]] == key[order[:-1]]
        return at, again


def hash_text(word: str) -> int:
    """The same 64-bit number for a word in every process."""
    h = 0xCBF29CE484222325
    for b in word.encode("utf-8", "surrogatepass"):
        h = ((h ^ b) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
    return h


def repeated_share(words: Words, n: int) -> np.ndarray:
    """By text: the share of words in a second or later copy of n or more words in a row. Texts without words have 0."""
    at, again = words.repeated(n)
    change = np.zeros(len(words.ids) + 1, np.int64)
    begin = at[again]
    np.add.at(change, begin, 1)
    np.add.at(change, begin + n, -1)
    covered = np.cumsum(change[:-1]) > 0
    return np.bincount(words.doc[covered], minlength=len(words.sizes)) / np.maximum(words.sizes, 1)


@dataclass
class Grams:
    """What the model sees of a batch of texts: dense features, and the bin of every hashed n-gram with the text it is of."""

    dense: np.ndarray
    bins: np.ndarray
    doc: np.ndarray
    per_doc: np.ndarray  # number of n-grams

    def bag(self, weights: np.ndarray) -> np.ndarray:
        """By text: the mean weight of its n-grams."""
        return np.bincount(self.doc, weights[self.bins], minlength=len(self.per_doc)) / np.maximum(self.per_doc, 1)


def _again(key: np.ndarray) -> np.ndarray:
    """Whether a key occurred before, told by a table of one slot per hash: where two keys share a slot the later one isn't told."""
    size = 1 << max(4, int(len(key)).bit_length() + 2)
    slot = (key & np.uint64(size - 1)).astype(np.int64)
    first = np.zeros(size, np.int64)
    at = np.arange(len(key))
    first[slot[::-1]] = at[::-1]
    return (first[slot] != at) & (key[first[slot]] == key)


def features(texts: list[str | None], words: Words, s: Settings) -> Grams:
    """Shares of repeated word and character n-grams as dense features; word 1- and 2-grams and character n-grams as
    bins, with bins of their own for those that occurred before in the same text."""
    n, part = len(texts), s.bins // 4
    dense, bins, doc = [], [], []
    for k in s.word_grams:
        at, again = words.repeated(k)
        share = np.bincount(words.doc[at[again]], minlength=n) / np.maximum(np.bincount(words.doc[at], minlength=n), 1)
        dense += [share, np.sqrt(share)]
        if k == 2:
            pair = _mixed(words.hashed[at] + _mixed(words.hashed[at + 1]))
            bins.append((_mixed(pair) % np.uint64(part)).astype(np.int64) + part * again)
            doc.append(words.doc[at])
    bins.append((_mixed(words.hashed) % np.uint64(part)).astype(np.int64))
    doc.append(words.doc)
    raw = [(t or "").lower().encode("utf-32-le", "surrogatepass") for t in texts]
    sizes = np.array([len(b) // 4 for b in raw], np.int64)
    c, of = np.frombuffer(b"".join(raw), np.uint32).astype(np.uint64), np.repeat(np.arange(n), sizes)
    last = max(len(c) - s.char_gram + 1, 0)
    key = np.zeros(last, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(s.char_gram):
            key = key * np.uint64(0x100000001B3) + c[j : j + last]
    inside = np.flatnonzero(of[:last] == of[s.char_gram - 1 :]) if last else np.empty(0, np.int64)
    key, of = _mixed(key[inside]), of[inside]
    again = _again(_mixed(key + of.astype(np.uint64)))
    share = np.bincount(of[again], minlength=n) / np.maximum(np.bincount(of, minlength=n), 1)
    bins.append(2 * part + (key % np.uint64(part)).astype(np.int64) + part * again)
    doc.append(of)
    bins, doc = np.concatenate(bins).astype(np.int32), np.concatenate(doc).astype(np.int32)
    return Grams(np.column_stack([*dense, share]), bins, doc, np.bincount(doc, minlength=n))


def _labelled(texts: list[str], s: Settings, at_once: int = 250) -> tuple[Grams, np.ndarray]:
    """Features and labels of many texts, made a few at a time: only bins and texts' numbers stay in memory."""
    parts, labels = [], []
    for at in range(0, len(texts), at_once):
        words = Words(texts[at : at + at_once])
        g = features(texts[at : at + at_once], words, s)
        parts.append(Grams(g.dense, g.bins, g.doc + np.int32(at), g.per_doc))
        labels.append(repeated_share(words, s.copy_words) >= s.share)
    joined = Grams(*[np.concatenate([getattr(g, f) for g in parts]) for f in ("dense", "bins", "doc", "per_doc")])
    return joined, np.concatenate(labels).astype(float)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # of the dense features, intercept first
    bag: np.ndarray  # of the bins
    slope: float
    shift: float

    def logit(self, g: Grams) -> np.ndarray:
        return (g.dense - self.mean) / self.scale @ self.weights[1:] + self.weights[0] + g.bag(self.bag)

    def probability(self, g: Grams) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.logit(g) + self.shift, -500, 500)))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float, steps: int = 30) -> np.ndarray:
    """Ridge logistic weights with an unpenalised intercept, by damped Newton steps."""
    a = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(a.shape[1])
    penalty = np.full(a.shape[1], ridge * len(x))
    penalty[0] = 1e-9

    def loss(v):
        z = a @ v
        return np.sum(np.logaddexp(0, z) - y * z) + 0.5 * np.sum(penalty * v * v)

    now = loss(w)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -500, 500)))
        g = a.T @ (p - y) + penalty * w
        h = (a * (p * (1 - p))[:, None]).T @ a + np.diag(penalty)
        step = np.linalg.solve(h + 1e-9 * np.eye(len(w)), g)
        size = 1.0
        while size > 1e-4 and loss(w - size * step) > now:
            size /= 2
        w = w - size * step
        if now - loss(w) < 1e-8 * max(1.0, abs(now)):
            break
        now = loss(w)
    return w


def _fit_bag(g: Grams, offset: np.ndarray, y: np.ndarray, s: Settings) -> np.ndarray:
    """Ridge logistic weights of the bins beside a given offset, by accelerated gradient steps."""
    at = ahead = np.zeros(s.bins)
    each = 1 / np.maximum(g.per_doc, 1)
    length, momentum = 4.0 * len(y), 1.0
    for _ in range(s.bag_steps):
        residual = y - 1 / (1 + np.exp(-np.clip(offset + g.bag(ahead), -500, 500)))
        step = ahead + (np.bincount(g.bins, (residual * each)[g.doc], minlength=s.bins) - s.bag_ridge * ahead) * length / len(y)
        grown = (1 + np.sqrt(1 + 4 * momentum * momentum)) / 2
        ahead, at, momentum = step + (momentum - 1) / grown * (step - at), step, grown
    return at


def fit(texts: list[str], s: Settings = Settings()) -> Model:
    """A calibrated model from texts, labelled by the exact measure.

    Every other text also counts with some of it written once more, and there are long rows just under and over the threshold, so that
    all shares and both labels are there for any corpus. Two
    thirds of the rows fit the weights, the rest calibrate them.
    """
    texts = [t for t in texts if t]
    more = []
    for k, t in enumerate(texts[::2]):
        w = t.split()
        more.append(f"{t} {' '.join(w[: int(len(w) * ((k * 37) % 100) / 60) + 1])}")
    # Long texts that repeat nothing but one stretch, on both sides of the threshold: words of several texts in random order.
    draw = np.random.default_rng(7)
    pool = np.array([w for t in texts[:: max(1, len(texts) // 200)] for w in t.split()[:400]] or ["a"], object)
    for k in range(72):
        part, share = draw.choice(pool, (300, 1200, 3000)[k % 3]), s.share * (0.7 + 0.1 * (k // 3 % 8))
        more.append(" ".join([*part, *part[: int(len(part) * share / (1 - share)) + s.copy_words]]))
    rows = texts + more + ["one two three four five six seven", "one two three four five six one two three four five six"]
    g, y = _labelled(rows, s)
    half = np.arange(len(rows)) % 3 != 0
    if len(set(y[half])) < 2 or len(set(y[~half])) < 2:
        half = np.ones(len(rows), bool)
    mean, scale = g.dense[half].mean(axis=0), g.dense[half].std(axis=0)
    scale = np.where(scale > 1e-9, scale, 1.0)
    weights = _logistic((g.dense[half] - mean) / scale, y[half], s.ridge)
    model = Model(mean, scale, weights, np.zeros(s.bins), 1.0, 0.0)
    inside, renumbered = half[g.doc], np.cumsum(half) - 1
    model.bag = _fit_bag(Grams(g.dense[half], g.bins[inside], renumbered[g.doc[inside]], g.per_doc[half]), model.logit(g)[half], y[half], s)
    held = ~half if not half.all() else half
    shift, slope = _logistic(model.logit(g)[held][:, None], y[held], 1e-3)
    model.slope, model.shift = max(float(slope), 1e-3), float(shift)
    return model


def train(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", s: Settings = Settings()) -> Model:
    """Fits on a bounded sample of documents, chosen by a hash of their id: at most s.sample_documents texts of up to s.sample_chars, and
    s.sample_total characters in all."""
    total = documents.count()
    share = max(1, -(-total // s.sample_documents))
    size = F.length(text_col)
    rows = documents.filter((size > 0) & (size <= s.sample_chars) & (F.pmod(F.xxhash64(id_col), F.lit(share)) == 0)).select(F.col(text_col).alias("t"), F.xxhash64(id_col).alias("h")).limit(s.sample_documents)
    so_far = F.sum(F.length("t")).over(Window.orderBy("h", "t").rowsBetween(Window.unboundedPreceding, 0))  # of the sample
    return fit([r["t"] for r in rows.withColumn("_c", so_far).filter(F.col("_c") <= s.sample_total).select("t").collect()], s)


def measure(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", s: Settings = Settings(), model: Model | None = None, everything: bool = True) -> DataFrame:
    """doc_id, n_words, repeated_share, probability and mostly_repeated of every document.

    Words are runs of letters and digits in lower case, so case, punctuation and spacing don't count. ``probability`` is that of
    hashed word and character n-gram logistic regression (s.bins weights beside the repeated shares of short n-grams), calibrated on
    held-out rows, trained on a bounded sample labelled by the measure itself. Documents of a probability of s.nominate or more are
    nominated, and of those the exact share decides which are ``mostly_repeated`` (s.share or more): ``repeated_share`` is the
    share of words that lie in a second or later copy of s.copy_words or more words in a row of the same document; a copy may
    overlap its original. With ``everything`` it is measured for all documents, else for nominated ones only (NULL for the rest). NULL,
    empty and wordless texts have 0 words, share 0 and are not listed; repeated rows come out each.

    Documents are scored in Arrow batches where they lie; there is no shuffle, and whole texts are read. The model goes to the
    workers once.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model or train(documents, id_col, text_col, s))  # s.bins weights
    kind = documents.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 1_000):
                batch = whole.slice(at, 1_000)
                texts = batch.column(1).to_pylist()
                words = Words(texts)
                p = model.probability(features(texts, words, s))
                nominated = np.flatnonzero((p >= s.nominate) & (words.sizes > 0))
                share = np.full(len(texts), np.nan)
                share[words.sizes == 0] = 0.0
                if everything:
                    share = repeated_share(words, s.copy_words)
                elif len(nominated):
                    share[nominated] = repeated_share(Words([texts[k] for k in nominated]), s.copy_words)
                listed = np.zeros(len(texts), bool)
                listed[nominated] = share[nominated] >= s.share
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(words.sizes.astype(np.int32)), pa.array(share, from_pandas=True), pa.array(p), pa.array(listed)], names=["doc_id", "n_words", "repeated_share", "probability", "mostly_repeated"]
                )

    return documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, n_words int, repeated_share double, probability double, mostly_repeated boolean")
