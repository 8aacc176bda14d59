"""Tokens of a public tokenizer, counted in Arrow batches."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how the byte-level vocabulary splits text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_held: dict[str, object] = {}


def encoding(path: str):
    """The byte-level tokenizer whose ranks lie at ``path``; one for each worker process."""
    if path not in _held:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in Path(path).read_bytes().splitlines() if line)}
        _held[path] = tiktoken.Encoding(Path(path).stem, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _held[path]


def token_counts(documents: DataFrame, id_col: str, text_col: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """``id_col`` and ``tokens``, the number of tokens of the whole text; NULL and empty texts have none.

    Very long texts are cut for counting where a blank follows a line break or a letter, at about 100,000 characters, which the
    tokenizer splits at as well: the count is that of the whole text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = encoding(tokenizer)
        for batch in batches:
            sizes = np.array([sum(len(t.encode_ordinary(part)) for part in _parts(x)) if x else 0 for x in batch.column(1).to_pylist()], np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes)], names=[id_col, "tokens"])

    kind = documents.schema[id_col].dataType.simpleString()
    return documents.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, tokens int")


def _parts(text: str, most: int = 100_000) -> list[str]:
    if len(text) <= most:
        return [text]
    out, at = [], 0
    while len(text) - at > most:
        cut = at + most
        # A single blank between two letters always begins a token.
        while cut < len(text) and not (text[cut] == " " and text[cut - 1].isalpha() and text[cut + 1 : cut + 2].isalpha()):
            cut += 1
        out.append(text[at:cut])
        at = cut
    return out + [text[at:]] if at < len(text) else out
