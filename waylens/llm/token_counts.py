"""Token counts: prefix dynamic programming stores the exact count at every prefix of a text.

The lattice of ``pieces`` gives, for each prefix, the last token of that prefix's own encoding, so its count is the count
at the token's start plus one. The counts of a whole text are stored as their differences, one a character, and answer any
truncation or budget question without encoding again.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from waylens.llm.common import map_texts
from waylens.llm.pieces import Pieces


def _counts(found: list[bytes]) -> np.ndarray:
    """Joins the counts inside segments to counts from the start of the text."""
    if not found:
        return np.zeros(0, np.int32)
    inside = np.frombuffer(b"".join(found), np.int32)
    sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
    before = np.concatenate(([0], np.cumsum(inside[np.cumsum(sizes) - 1])[:-1]))
    return (inside + np.repeat(before, sizes).astype(np.int32))[1:]  # the mark in front is no character of the text


def prefix_counts(pieces: Pieces, texts: list) -> list[np.ndarray]:
    """For each text the tokens of ``text[:1], text[:2], ...`` as int32."""
    def passed(word: str, last: list[str], out: list[int], best: list[float]) -> bytes:
        """Runs the lattice on. ``out`` has the tokens of each prefix: one (or a character's bytes) more than the prefix that
        its last piece follows."""
        single, known = pieces.id, len(last)
        if pieces.algorithm == "bpe":
            pieces.pass_bpe(word, last, len(word))
        else:
            for i in range(known, len(word) + 1):
                k, score = pieces._last_unigram(word, i, best)
                last.append(word[i - k : i])
                best.append(score)
        for i in range(known, len(word) + 1):
            piece = last[i]
            out.append(out[i - len(piece)] + (1 if piece in single else len(pieces.ids_of(piece))))
        return array("i", out[1:]).tobytes()

    return [_counts(x) for x in pieces.values(texts, passed)]


def packed(counts: np.ndarray) -> bytes:
    """Counts of prefixes as their differences, a byte each where they fit (four elsewhere), compressed."""
    steps = np.diff(counts, prepend=np.int32(0))
    small = not len(steps) or int(np.abs(steps).max()) < 128
    return (b"\1" if small else b"\4") + zstandard.ZstdCompressor(level=1).compress(steps.astype(np.int8 if small else "<i4").tobytes())


def unpacked(stored: bytes) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(stored[1:])
    return np.cumsum(np.frombuffer(raw, np.int8 if stored[:1] == b"\1" else "<i4"), dtype=np.int64)


def n_prefixes(stored: bytes) -> int:
    """How many characters there are counts for, as the frame's head says."""
    return zstandard.frame_content_size(stored[1:24]) // (1 if stored[:1] == b"\1" else 4)


def tokens_of(stored: bytes, n_chars: int) -> int:
    """Tokens of the first ``n_chars`` characters."""
    own = unpacked(stored)
    n = min(n_chars, len(own))
    return int(own[n - 1]) if n > 0 else 0


def longest_prefix(stored: bytes, budget: int) -> int:
    """Characters of the longest prefix of at most ``budget`` tokens; counts needn't rise with every character."""
    within = np.flatnonzero(unpacked(stored) <= budget)
    return int(within[-1]) + 1 if len(within) else 0


def count_tokens(docs: DataFrame, model: str, algorithm: str = "bpe", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, prefix_counts`` of every whole text, the counts of all prefixes packed.

    Null texts count as empty: no bytes, no tokens, no prefixes. Repeated rows and null ids are counted row by row; an
    empty table gives no rows. ``model`` is a path that each executor can read. Other columns aren't read.
    """
    def make():
        pieces = Pieces(model, algorithm)

        def work(texts: list) -> list:
            counts = prefix_counts(pieces, texts)
            return [[len(t.encode("utf-8", "surrogatepass")) if t else 0 for t in texts], [int(c[-1]) if len(c) else 0 for c in counts], [packed(c) for c in counts]]

        return work

    return map_texts(docs, make, "n_bytes bigint, n_tokens bigint, prefix_counts binary", id_col, text_col, rows=256)


def budgeted(counted: DataFrame, limit: int) -> DataFrame:
    """Adds ``over_limit``, whether a text has more than ``limit`` tokens, and ``limit_chars``, the characters that fit, from stored
    counts alone: no text is encoded, or read, again."""
    result = StructType([*counted.schema.fields, StructField("over_limit", BooleanType()), StructField("limit_chars", LongType())])
    whole = counted.schema.fieldNames().index("prefix_counts")

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = np.asarray(batch.column("n_tokens"))
            over = total > limit
            # a text within the limit fits whole
            chars = [longest_prefix(x, limit) if o else n_prefixes(x) for x, o in zip(batch.column(whole).to_pylist(), over.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(over), pa.array(chars, pa.int64())], names=result.names)

    return counted.mapInArrow(answer, result)
