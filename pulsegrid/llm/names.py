"""Problem 7: typed names mapped to the entry of a reference list that they mean, or to none."""

from __future__ import annotations

import itertools
import math
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Usual clinical abbreviations and synonyms as the words they stand for; | parts alternatives. A general word list:
# it names no entry of any reference list, and words that a list doesn't use are left out when it is applied.
LEXICON = {
    "a": "arterial", "abg": "arterial blood gas", "abp": "arterial line pressure", "aim": "goal", "airways": "airway", "albumin": "colloid", "art": "arterial line|arterial", "aw": "airway",
    "bedside": "point of care", "bis": "bispectral index", "bp": "blood pressure", "bpm": "heart rate", "breaths": "respiratory rate", "bt": "body temperature",
    "capnography": "carbon dioxide", "cardiac": "heart", "ci": "cardiac index", "co": "cardiac output", "co2": "carbon dioxide", "cranial": "intracranial", "cuff": "non invasive cuff", "cvp": "central venous pressure",
    "d": "diastolic", "dbp": "diastolic pressure", "des": "desflurane", "dia": "diastolic", "ebl": "estimated blood loss", "et": "end tidal|expired", "etco2": "end tidal carbon dioxide", "evd": "intracranial", "exp": "expired",
    "fio2": "fraction inspired oxygen", "foley": "urine catheter", "gcs": "coma score", "glu": "glucose", "gluc": "glucose", "hb": "hemoglobin", "hct": "hematocrit", "hgb": "hemoglobin", "hr": "heart rate",
    "iabp": "arterial line pressure", "ibp": "invasive arterial line pressure", "icp": "intracranial pressure", "idx": "index", "in": "intake", "insp": "inspired", "invasive": "invasive arterial line",
    "lact": "lactate", "m": "mean", "manual": "charted", "map": "mean arterial pressure|mean pressure", "mbp": "mean pressure", "nbp": "non invasive cuff pressure", "nibp": "non invasive cuff pressure", "noninvasive": "non invasive cuff|non invasive",
    "nrs": "numeric pain score", "o2": "oxygen", "oscillometric": "non invasive cuff", "out": "output", "pa": "pulmonary artery", "pap": "pulmonary artery pressure", "pcwp": "pulmonary wedge pressure", "peep": "positive end expiratory pressure",
    "pip": "peak airway pressure", "plat": "plateau", "poc": "point of care", "pplat": "plateau airway pressure", "prs": "pressure", "pt": "patient", "radial": "arterial", "rass": "sedation score", "rr": "respiratory rate", "rt": "rate",
    "s": "systolic", "sao2": "oxygen saturation", "sat": "saturation", "saturation": "peripheral oxygen saturation", "sbp": "systolic pressure", "scale": "score", "setting": "limit", "sevo": "sevoflurane", "spo2": "peripheral oxygen saturation",
    "sv": "stroke volume", "svv": "stroke volume variation", "sys": "systolic", "target": "goal", "temp": "temperature", "thermo": "cardiac output", "thermodilution": "cardiac output", "threshold": "limit", "tof": "train of four",
    "tv": "tidal volume", "uo": "urine output", "uop": "urine output", "vas": "pain score", "vent": "ventilator", "vol": "volume", "vt": "tidal volume",
}
# Words that say nothing about what is measured.
EMPTY = frozenset("auto by entry for from iv left manually measured min of on or per percent probe reading right sensor set the value with".split())
CODE = re.compile(r"^[a-z]{1,4}_?\d{3,}$", re.I)
# A short tag before a colon or a dash between blanks, as interfaces put before a name; letters with dots between them are one word.
TAG = re.compile(r"^\s*(\w{1,6})\s*(?::|\s-\s)\s*(?=\S)")
INITIALS = re.compile(r"(?<![a-z0-9])[a-z](?:\.[a-z])+(?![a-z0-9])")
LONGEST_NAME = 200  # characters of a text whose blanks may be misplaced; a longer one is no name with a slip of the finger
MOST_MEMORY = 100_000  # texts or tokens a worker remembers


def distance(a: str, b: str, most: int) -> int:
    """Edits (insert, delete, replace, swap of neighbours) from a to b, or most + 1 if there are more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, last = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return most + 1
        before, last = last, row
    return min(last[-1], most + 1)


def _deletions(token: str, most: int) -> set[str]:
    out, front = {token}, {token}
    for _ in range(most):
        front = {t[:k] + t[k + 1 :] for t in front for k in range(len(t))}
        out |= front
    return out


def _allowed(n: int) -> int:
    return 0 if n < 4 else 1 if n < 9 else 2


def shortens(short: str, word: str) -> bool:
    """``short`` keeps the first letter and some of the following ones, in order: prs, pres and pr for pressure."""
    if not 2 <= len(short) < len(word) or short[0] != word[0]:
        return False
    if word.startswith(short):
        return True
    letters = iter(word)
    return all(c in letters for c in short) and (short[-1] in word[-3:] or not set(short[1:]) & set("aeiou"))


@dataclass
class Typed:
    """A typed text as words: what it is written of, and which of its words may be an interface's addition."""

    tokens: list[str]
    aside: list[bool]


def typed(text: str) -> Typed:
    """Lower-case runs of letters and digits. Words in brackets, behind a spaced dash or before a colon stand aside: they count
    where the list knows them and cost nothing where it doesn't."""
    t = INITIALS.sub(lambda m: m.group().replace(".", ""), text.lower())
    tag = TAG.match(t)
    tokens, aside = [], []
    depth, dashed = 0, False
    for m in re.finditer(r"[a-z0-9]+|[(\[)\]]|\s-\s", t):
        x = m.group()
        if x in "([":
            depth += 1
        elif x in ")]":
            depth = max(0, depth - 1)
        elif x.strip() == "-":
            dashed = dashed or (bool(tokens) and not (tag and m.start() < tag.end()))
        else:
            tokens.append(x)
            aside.append(depth > 0 or dashed or bool(tag and m.end() <= tag.end()))
    return Typed(tokens, aside)


def words(text: str) -> list[str]:
    return typed(text).tokens


@dataclass
class Matcher:
    """Entries of one list as phrases; ranks them for a typed text by soft TF-IDF over repaired tokens."""

    phrases: list[tuple[int, list[str]]]
    lexicon: dict[str, str] = field(default_factory=dict)
    threshold: float = 0.68
    sure: float = 0.8  # for texts whose blanks were moved

    def __post_init__(self):
        # Abbreviations in the entries themselves are read as the words they stand for, beside what is written.
        more = [(ref, [w for t in tokens for w in self.lexicon.get(t, t).split("|")[0].split()]) for ref, tokens in self.phrases]
        self.phrases = list({(ref, tuple(tokens)): (ref, tokens) for ref, tokens in [*self.phrases, *more]}.values())
        count = defaultdict(set)
        for ref, tokens in self.phrases:
            for t in tokens:
                count[t].add(ref)
        refs = len({ref for ref, _ in self.phrases})
        self.idf = {t: math.log(1 + refs / len(r)) for t, r in count.items()}
        self.rare = math.log(1 + refs)
        self.at = defaultdict(list)
        for k, (_, tokens) in enumerate(self.phrases):
            for t in set(tokens):
                self.at[t].append(k)
        self.norm = [math.sqrt(sum(self.idf[t] ** 2 for t in set(tokens))) for _, tokens in self.phrases]
        self.near = defaultdict(set)
        for t in [*self.idf, *self.lexicon]:
            for d in _deletions(t, _allowed(len(t))):
                self.near[d].add(t)
        self.solid = defaultdict(set)
        for ref, tokens in self.phrases:
            self.solid["".join(tokens)].add(ref)
        self.longest, self.longest_word = max(map(len, self.solid), default=0), max(map(len, [*self.idf, *self.lexicon]), default=0)
        self.solid_near = defaultdict(set)
        for s in self.solid:
            for d in _deletions(s, 1):
                self.solid_near[d].add(s)
        self.repairs: dict[str, dict[str, float]] = {}

    def repair(self, token: str) -> dict[str, float]:
        """The token's join with the vocabulary (of the list and the lexicon): words it can stand for, with their similarity."""
        if token in self.repairs:
            return self.repairs[token]
        known = token in self.idf or token in self.lexicon
        out = {token: 1.0} if known else {}
        for word in self.idf if len(token) <= 6 or not known else ():
            if shortens(token, word) and (not known or word.startswith(token)):
                out[word] = 0.92 if word.startswith(token) else 0.85
        if not known:
            most = _allowed(len(token))
            if most and len(token) <= self.longest_word + most:  # a longer one is no misspelt word of the list
                for d in _deletions(token, most):
                    for word in self.near.get(d, ()):
                        e = distance(token, word, max(most, _allowed(len(word))))
                        if e <= min(most, _allowed(len(word))):
                            out[word] = max(out.get(word, 0), 1 - 0.5 * e / min(len(word), 6))
            if len(token) >= 4 and not out:
                # A shortened word that is misspelt as well.
                for word in self.idf:
                    if len(word) > len(token) + 1 and word[0] == token[0] and distance(token, word[: len(token)], 1) <= 1:
                        out[word] = 0.75
        if len(self.repairs) >= MOST_MEMORY:
            self.repairs.clear()
        self.repairs[token] = out
        return out

    def _readings(self, t: Typed) -> Iterator[list[tuple[dict[str, float], bool]]]:
        """Ways to read the words: as they stand, and with abbreviations read as what they stand for. Each word as what it can be
        repaired to, and whether it costs nothing if that is nothing."""
        plain, long = [], []
        for token, aside in zip(t.tokens, t.aside, strict=True):
            sure = 1.0 if token in EMPTY else 0.92 if aside else 0.0  # no guess for what says nothing or stands aside
            found = {w: s for w, s in self.repair(token).items() if s >= sure}
            own = {w: s for w, s in found.items() if w in self.idf}
            empty = aside or len(token) == 1 or token in EMPTY or any(c.isdigit() for c in token)
            plain.append((own, empty))
            short = max(((s, w) for w, s in found.items() if w in self.lexicon), default=None)
            meant = [[w for w in way.split() if w in self.idf] for way in self.lexicon[short[1]].split("|")] if short else []
            meant = [[({w: short[0]}, empty) for w in way] for way in meant if way]
            long.append(meant or [[(own, empty)]])
        yield plain
        if any(way != [[p]] for way, p in zip(long, plain, strict=True)):
            for ways in itertools.islice(itertools.product(*long), 8):
                yield [w for way in ways for w in way]

    def best(self, text: str | None) -> tuple[int, float]:
        """(ref_id, score), ref_id 0 below the threshold. NULL and texts without letters or digits are (0, 0)."""
        if text is None:
            return 0, 0.0
        ranked = self._ranked(typed(text))
        if len(text) <= LONGEST_NAME and (not ranked or max(ranked)[0] < self.threshold):
            # Two words run together, and a blank that changed places with its neighbour; with less room for repairs.
            others = [text[: k - 1] + " " + text[k - 1] + text[k + 1 :] for k, c in enumerate(text) if c == " " and 0 < k]
            others += [text[:k] + text[k + 1] + " " + text[k + 2 :] for k, c in enumerate(text) if c == " " and k < len(text) - 1]
            others += self._parted(text)
            ranked += [r for o in others for r in self._ranked(typed(o)) if r[0] >= self.sure]
        if not ranked:
            return 0, 0.0
        score, _, ref = max(ranked, key=lambda r: (r[0], r[1], -r[2]))
        return (ref if score >= self.threshold else 0), score

    def _parted(self, text: str) -> list[str]:
        """The text with a word parted in two, where both are of the vocabulary and the whole can't be repaired."""
        out = []
        for token in set(words(text)):
            if 4 <= len(token) <= 40 and not self.repair(token):
                cuts = (k for k in range(2, len(token) - 1) if all(x in self.idf or x in self.lexicon for x in (token[:k], token[k:])))
                out += [re.sub(rf"(?i)(?<![a-z0-9]){token}(?![a-z0-9])", f"{token[:k]} {token[k:]}", text) for k in cuts]
        return out

    def _ranked(self, t: Typed) -> list[tuple[float, int, int]]:
        if not t.tokens:
            return []
        solid = "".join(t.tokens)
        if len(self.solid.get(solid, ())) == 1:
            return [(1.0, 0, next(iter(self.solid[solid])))]
        ranked = []
        for reading in self._readings(t):
            gained = defaultdict(dict)
            weight = [max((self.idf[w] for w in known), default=0.0 if empty else self.rare) for known, empty in reading]
            for i, (known, _) in enumerate(reading):
                for word, s in known.items():
                    for p in self.at[word]:
                        slot = gained[p].get(word)
                        if slot is None or slot[1] < s:
                            gained[p][word] = (i, s)
            seen: dict[str, int] = {}  # a word typed twice counts once
            again = [bool(known) and seen.setdefault(max(known, key=known.get), i) != i for i, (known, _) in enumerate(reading)]
            total = sum(w * w for w, a in zip(weight, again, strict=True) if not a)
            for p, pairs in gained.items():
                used, score, size = set(), 0.0, 0.0
                for word, (i, s) in sorted(pairs.items(), key=lambda x: -x[1][1]):
                    if i not in used:
                        used.add(i)
                        score += s * self.idf[word] ** 2
                        size += self.idf[word] ** 2
                size += total - sum(weight[i] ** 2 for i in used if not again[i])
                ranked.append((score / math.sqrt(max(size, 1e-12)) / self.norm[p], -len(self.phrases[p][1]), self.phrases[p][0]))
        if 4 <= len(solid) <= self.longest + 1:
            for d in _deletions(solid, 1):
                for s in self.solid_near.get(d, ()):
                    if len(self.solid[s]) == 1 and distance(solid, s, 1) <= 1:
                        ranked.append((1 - 0.5 / len(s), 0, next(iter(self.solid[s]))))
        return ranked


def matcher(reference: list[tuple[int, str, str, str]], list_name: str, aliases: dict[str, list[str]] | None = None, lexicon: dict[str, str] | None = None) -> Matcher:
    """A matcher over the entries (ref_id, list_name, canonical_name, canonical_display) of one list, with a caller's further names
    by canonical name (``aliases``) and abbreviations (``lexicon``, by default LEXICON)."""
    phrases = []
    for ref, named, name, display in reference:
        if named == list_name:
            phrases += [(ref, words(p)) for p in dict.fromkeys([name, display, *(aliases or {}).get(name or "", [])]) if p and words(p)]
    return Matcher(phrases, LEXICON if lexicon is None else lexicon)


def _is_code(name: str) -> bool:
    """Whether a name is nothing but a code: a few letters and three digits or more, whatever an interface put around it."""
    t = typed(name)
    kept = [x for x, aside in zip(t.tokens, t.aside, strict=True) if not aside and x not in EMPTY]
    return bool(CODE.match("_".join(kept))) or (len(kept) > 1 and bool(CODE.match("".join(kept[-2:]))) and all(len(x) == 1 for x in kept[:-2]))


def resolve_row(m: Matcher, name: str | None, display: str | None) -> int:
    """The entry that a name means; the display name tells where the name is NULL, empty or a bare code, or means none."""
    ref = 0
    if name is not None and name.strip() and not _is_code(name):
        ref = m.best(name)[0]
    return ref or m.best(display)[0]


def map_names(df: DataFrame, reference: DataFrame, list_name: str, id_col: str, name: str, display: str | None = None, aliases: dict[str, list[str]] | None = None, lexicon: dict[str, str] | None = None, most_entries: int = 20_000) -> DataFrame:
    """row_id and ref_id (0: none) of every row whose name isn't letter for letter an entry of its list.

    Each distinct typed token is joined to the vocabulary of the list by edit distance (through deletion neighbourhoods, with
    shortened words beside misspelt ones, and general abbreviations read as the words they stand for), and complete entries are ranked
    by soft TF-IDF over the repaired tokens; the run of all letters covers misplaced blanks, as do blanks moved by one place (in texts of up to
    LONGEST_NAME characters). NULL, empty, blank and code-like
    names are told by ``display``; without one they mean none. Repeated rows come out each. Ties go to the entry with fewer
    tokens, then the lower id.

    ``aliases`` are further names of entries that a caller knows; there are none by default. ``reference`` is a fixed list (at
    most ``most_entries``, checked) and goes to every worker; a longer one is an error. Rows stay where they lie: of each batch
    only the distinct pairs of name and display are resolved, tokens that were joined before are remembered (up to MOST_MEMORY), and the
    rows take their pair's entry, so no value, however frequent, gathers rows anywhere.
    """
    entries = [tuple(r) for r in reference.select("ref_id", "list_name", "canonical_name", "canonical_display").filter(F.col("list_name") == list_name).limit(most_entries + 1).collect()]
    if len(entries) > most_entries:
        raise ValueError(f"the reference list {list_name} has more than {most_entries} entries")
    exact = [e[2] for e in entries if e[2] is not None]
    shown = F.col(display).cast("string") if display else F.lit(None).cast("string")
    text = F.col(name).cast("string")
    rows = df.filter(text.isNull() | ~text.isin(exact)) if exact else df
    rows = rows.select(F.col(id_col).alias("row_id"), text.alias("name"), shown.alias("display"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, memo = matcher(entries, list_name, aliases, lexicon), {}
        for batch in batches:
            a, b = (batch.column(k).dictionary_encode(null_encoding="encode") for k in (1, 2))
            codes = a.indices.to_numpy().astype(np.int64) * max(len(b.dictionary), 1) + b.indices.to_numpy()
            pairs, rows_of = np.unique(codes, return_inverse=True)
            left, right = a.dictionary.to_pylist(), b.dictionary.to_pylist()
            if len(memo) > MOST_MEMORY:
                memo.clear()
            refs = np.zeros(len(pairs), np.int32)
            for k, code in enumerate(pairs.tolist()):
                pair = left[code // len(right)], right[code % len(right)]
                if pair not in memo:
                    memo[pair] = resolve_row(m, *pair)
                refs[k] = memo[pair]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(refs[rows_of] if len(pairs) else refs)], names=["row_id", "ref_id"])

    return rows.mapInArrow(run, f"row_id {rows.schema['row_id'].dataType.simpleString()}, ref_id int")
