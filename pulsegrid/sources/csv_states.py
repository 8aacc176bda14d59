"""A quote-aware finite-state tokenizer for RFC 4180 records, run over chunks.

A byte stream is cut into chunks of equal length wherever they fall. For each chunk the *transition* is computed: the state
in which the chunk ends, for every state in which it may begin. Transitions compose, so the state at the start of each chunk
follows from those of the chunks before it, and a second pass gives the state before every byte. Both passes run over all
chunks at once, so the loop is as long as one chunk, however many bytes there are.
"""

from __future__ import annotations

import numpy as np

# States: at the start of a field, in a bare field, in a quoted field, after a quote in a quoted field, after an error.
START, BARE, QUOTED, QUOTE, BAD = range(5)
# Classes of bytes: any other byte, the quote, the comma, CR or LF, the end of a record (a virtual byte).
OTHER, MARK, COMMA, BREAK, END = range(5)

NEXT = np.zeros((5, 5), np.uint8)  # [class, state]
NEXT[OTHER] = [BARE, BARE, QUOTED, BAD, BAD]
NEXT[MARK] = [QUOTED, BAD, QUOTE, QUOTED, BAD]
NEXT[COMMA] = [START, START, QUOTED, START, BAD]
NEXT[BREAK] = [BAD, BAD, QUOTED, BAD, BAD]
NEXT[END] = START

CLASS_OF = np.full(256, OTHER, np.uint8)
CLASS_OF[ord('"')], CLASS_OF[ord(",")], CLASS_OF[ord("\r")], CLASS_OF[ord("\n")] = MARK, COMMA, BREAK, BREAK


def transitions(chunks: np.ndarray) -> np.ndarray:
    """For each row of classes, the state at its end for each of the five states at its start."""
    state = np.tile(np.arange(5, dtype=np.uint8), (len(chunks), 1))
    for j in range(chunks.shape[1]):
        state = NEXT[chunks[:, j, None], state]
    return state


def starts(moves: np.ndarray, first: int = START) -> np.ndarray:
    """The state at the start of each chunk, by composing the transitions of the chunks before it."""
    out = np.empty(len(moves), np.uint8)
    state = first
    for k, move in enumerate(moves):
        out[k] = state
        state = move[state]
    return out


def states_before(classes: np.ndarray, chunk: int | None = None, first: int = START) -> np.ndarray:
    """The state before every byte of a stream given by its classes."""
    n = len(classes)
    if not n:
        return np.empty(0, np.uint8)
    width = chunk or max(64, int(n**0.5))
    rows = -(-n // width)
    padded = np.full(rows * width, END, np.uint8)
    padded[:n] = classes
    chunks = padded.reshape(rows, width)
    state = starts(transitions(chunks), first)
    before = np.empty((rows, width), np.uint8)
    columns = np.ascontiguousarray(chunks.T)
    for j in range(width):
        before[:, j] = state
        state = NEXT[columns[j], state]
    return before.reshape(-1)[:n]


class Tokens:
    """Records of a byte buffer, tokenized: error offsets, numbers of fields and the unquoted fields of chosen records."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, chunk: int | None = None):
        """``data`` holds the records one after the other, record k at offsets[k]:offsets[k + 1]."""
        lengths = np.diff(offsets)
        # Line ends that close a record belong to no field.
        ends = offsets[1:].copy()
        for mark in (10, 13):
            last = np.where(ends > offsets[:-1], data[np.maximum(ends - 1, 0)] if len(data) else 0, 0)
            ends = ends - (last == mark)
        n = len(lengths)
        sizes = ends - offsets[:-1]
        self.begin = np.concatenate([[0], np.cumsum(sizes + 1)])  # each record has its virtual end
        total = int(self.begin[-1])
        self.stop = self.begin[1:] - 1
        self.classes = np.full(total, END, np.uint8)
        self.data = np.zeros(total, np.uint8)
        inside = np.ones(total, bool)
        inside[self.stop] = False
        if len(data):
            live = data[offsets[0] : offsets[-1]]
            if (ends < offsets[1:]).any():
                within = np.arange(len(live)) - np.repeat(offsets[:-1] - offsets[0], lengths)
                live = live[within < np.repeat(sizes, lengths)]
            self.data[inside] = live
        self.classes[inside] = CLASS_OF[self.data[inside]]
        self.before = states_before(self.classes, chunk)
        last_state = self.before[self.stop]
        self.unclosed = last_state == QUOTED
        self.bad = (last_state == BAD) | self.unclosed
        self.split = (self.classes == COMMA) & (self.before != QUOTED) & (self.before != BAD)
        count = np.concatenate([[0], np.cumsum(self.split)])
        self.columns = (count[self.stop] - count[self.begin[:-1]]) + 1
        self.blank = sizes == 0
        self.error_offset = self._error_offsets(n)

    def _error_offsets(self, n: int) -> np.ndarray:
        """In bytes from the start of the record: the first byte that breaks the rules, or the quote that is never closed."""
        out = np.full(n, -1, np.int64)
        if self.bad.any():
            record = np.repeat(np.arange(n), np.diff(self.begin))
            breaks = np.flatnonzero((self.before != BAD) & (NEXT[self.classes, self.before] == BAD))
            out[record[breaks]] = breaks - self.begin[record[breaks]]
            opens = np.flatnonzero((self.before == START) & (self.classes == MARK))
            last = np.full(n, 0, np.int64)
            last[record[opens]] = opens - self.begin[record[opens]]  # the last opening quote of each record stays
            out = np.where(self.unclosed, last, out)
        return out

    def fields(self, chosen: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Bytes and offsets of the fields of the chosen records, which have ``width`` fields each, in order."""
        live = np.repeat(chosen, np.diff(self.begin))
        content = live & (
            (self.classes == OTHER)
            | ((self.classes == BREAK) & (self.before == QUOTED))
            | ((self.classes == COMMA) & (self.before == QUOTED))
            | ((self.classes == MARK) & (self.before == QUOTE))
        )
        done = np.concatenate([[0], np.cumsum(content)])
        closing = np.flatnonzero(live & (self.split | (self.classes == END)))
        offsets = np.concatenate([[0], done[closing]])
        assert len(closing) == width * int(chosen.sum())
        return self.data[content], offsets
