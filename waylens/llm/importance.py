"""Target-distribution importance resampling over hashed words.

Pass one counts buckets: each partition adds up one vector with np.bincount, and treeReduce merges the vectors. A bucket's gain
is the logarithm of how much likelier the target is to have it. Pass two gathers the broadcast gains and sums them per
document with np.bincount weights. The documents with the highest weights, disturbed by Gumbel noise that a hash of the id
fixes, are the sample without replacement.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from waylens.llm.common import map_texts, materialize, text_slices
from waylens.operators.ordering import ranked

BUCKETS, SEED = 10_000, 2024
#: A word in lower-cased UTF-8: digits, letters and every byte of other scripts.
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Words of a text that are held at a time, and words whose buckets a task remembers (words of at most LONG bytes).
PART, KNOWN, LONG = 1 << 16, 1 << 18, 64


class Buckets(dict):
    """The bucket of each word met, forgotten when there are too many."""

    def __init__(self, n: int):
        super().__init__()
        self.n = n

    def __missing__(self, word: bytes) -> int:
        found = zlib.crc32(word) % self.n
        if len(word) <= LONG:
            if len(self) >= KNOWN:
                self.clear()
            self[word] = found
        return found


def word_parts(text: str | None, part: int = PART) -> Iterator[list[bytes]]:
    """The words of a text, ``part`` at a time."""
    data = (text or "").encode("utf-8", "surrogatepass").lower()
    if len(data) <= part * 8:
        yield _WORD.findall(data)
        return
    found = (m[0] for m in _WORD.finditer(data))
    while held := list(islice(found, part)):
        yield held


def bucket_parts(text: str | None, known: Buckets, longest: int = 1, part: int = PART) -> Iterator[tuple[np.ndarray, int]]:
    """Buckets of the features of a text, part by part, and the words of the part: runs of 1 to ``longest`` words."""
    before: list[bytes] = []
    for words in word_parts(text, part):
        own = np.fromiter(map(known.__getitem__, words), np.int32, len(words))
        if longest > 1:
            line, more = before + words, [own]
            for size in range(2, longest + 1):
                first = max(0, len(before) - size + 1)
                more.append(np.fromiter((zlib.crc32(b" ".join(line[i : i + size])) % known.n for i in range(first, len(line) - size + 1)), np.int32))
            own = np.concatenate(more)
            before = line[-(longest - 1) :]
        yield own, len(words)


def bucket_counts(texts: DataFrame, text_col: str = "text", longest: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts each bucket has."""
    result = StructType.fromDDL("counts binary")
    arrow = to_arrow_schema(result)

    def count(batches):
        known, total = Buckets(buckets), np.zeros(buckets, np.int64)
        for batch in batches:
            for part in text_slices(batch, 256):
                held, n = [], 0
                for text in part.column(1):
                    for found, _ in bucket_parts(text.as_py(), known, longest):
                        held.append(found)
                        n += len(found)
                        if n > PART:
                            total += np.bincount(np.concatenate(held), minlength=buckets)
                            held, n = [], 0
                if held:
                    total += np.bincount(np.concatenate(held), minlength=buckets)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], schema=arrow)

    vectors = texts.select(F.lit(0), F.col("`" + text_col.replace("`", "``") + "`")).mapInArrow(count, result).rdd
    if not vectors.getNumPartitions():
        return np.zeros(buckets, np.int64)
    return vectors.map(lambda row: np.frombuffer(row[0], np.int64)).treeReduce(np.add, depth=3)


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """``floor(1000 * ln((t + 1)(S + B) / ((s + 1)(T + B))))`` of each bucket, S and T being all features of both sides."""
    b = len(raw)
    s_all, t_all = float(int(raw.sum()) + b), float(int(target.sum()) + b)
    return np.array([math.floor(1000 * math.log((t + 1.0) * s_all / ((s + 1.0) * t_all))) for s, t in zip(raw.tolist(), target.tolist(), strict=True)], np.int64)


def weights(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text", longest: int = 1) -> DataFrame:
    """``doc_id, n_words, n_features, weight`` of every row; a text without words has no features and weight 0."""
    held = docs.sparkSession.sparkContext.broadcast(gain)  # a long a bucket

    def make():
        known, values = Buckets(len(held.value)), held.value.astype(np.float64)

        def work(texts: list) -> tuple[list, list, list]:
            n_words, n_features, total = (np.zeros(len(texts), np.int64) for _ in range(3))
            found: list[np.ndarray] = []
            owner: list[int] = []
            n = 0

            def add() -> None:
                nonlocal n
                if found:  # sums of whole numbers far below 2^53 are exact in doubles
                    row = np.repeat(np.array(owner), [len(x) for x in found])
                    total[:] += np.bincount(row, weights=values[np.concatenate(found)], minlength=len(texts)).astype(np.int64)
                found.clear()
                owner.clear()
                n = 0

            for i, text in enumerate(texts):
                for part, words in bucket_parts(text, known, longest):
                    n_words[i] += words
                    n_features[i] += len(part)
                    found.append(part)
                    owner.append(i)
                    n += len(part)
                    if n > PART:
                        add()
            add()
            return n_words, n_features, total

        return work

    return map_texts(docs, make, "n_words bigint, n_features bigint, weight bigint", id_col, text_col)


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """``floor(-1000 * ln(-ln((h + 0.5) / 2^32)))`` of the first 8 hex digits of sha256(seed:doc_id); a null id is no text."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def importance_resample(docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, longest: int = 1, buckets: int = BUCKETS, seed: int = SEED,
                        id_col: str = "doc_id", text_col: str = "text", target_text: str = "text") -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` of every row of ``docs``.

    ``floor(percent * N / 100)`` of the N rows with ``least_words`` words are drawn, the highest scores first, of equal
    scores the smaller id (a null id before all), of rows that are alike in both one after the other. Ranks come from ranges
    of the order, so no task sees all rows. Null and empty texts have no words and weight 0. An empty target makes every
    gain that of the documents alone; an empty table gives no rows. Other columns aren't read.
    """
    gain = gains(bucket_counts(docs, text_col, longest, buckets), bucket_counts(target, target_text, longest, buckets))
    scored = weights(docs, gain, id_col, text_col, longest)
    # a number of its own tells repeated rows apart, so that they fall into many ranges
    scored = scored.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)).withColumns({"__down": -F.col("score"), "__row": F.monotonically_increasing_id()})
    scored = materialize(scored, "scores")
    able = scored.where(F.col("n_words") >= least_words)
    drawn = able.count() * percent // 100
    placed = ranked(able, "__down", "doc_id", "__row").withColumn("rank", F.when(F.col("rank") < drawn, F.col("rank") + 1).cast("long"))
    rest = scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return placed.unionByName(rest).select("doc_id", "n_features", "weight", "score", "rank")
