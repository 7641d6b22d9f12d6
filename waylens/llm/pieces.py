"""SentencePiece encoding and decoding by a streaming Viterbi lattice.

The lattice runs over the characters of the normalized text. Each position keeps one backpointer, the length of the last
piece of the best path that ends there, and only the last ``longest`` positions can still be pointed at. Whenever the
paths of all of those pass one common boundary, the ids before it are committed and dropped, so the window stays a few
times the longest piece however long the text.

What makes a path best depends on the kind of model:

* ``unigram``: the sum of piece scores, as in the usual Viterbi.
* ``bpe``: a BPE model ranks merges, and its scores aren't additive. A path is the model's own result exactly if each two
  neighbouring pieces stay apart when they are merged alone. So for each prefix one last piece alone fits the piece
  before it: the surviving path into each position is the BPE encoding of that prefix, and ids equal the library's.

Spaces become U+2581, one is put in front, and characters without a piece become their UTF-8 bytes' pieces. No piece has
U+2581 after another character, so in front of a mark only that boundary can still be pointed at: all paths have converged
there, and the stream commits up to it. A text is taken in parts of bounded size from one such boundary to another, inside of
words in chunks. What was committed between two boundaries is remembered, so a lattice runs once for each word met lately.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
from pyspark.sql import DataFrame

from waylens.llm.common import map_texts

SPACE_MARK = "▁"
#: Characters that go into the stream at a time, and the most of a word that the cache keeps.
CHUNK, KEPT = 64, 256
#: The score of two parts that make no piece.
NEVER = float("-inf")
#: Words of a text that are held at a time, and words that are looked up together.
PART, TOGETHER = 1 << 16, 1 << 20
#: A text that other normalizations change: spaces to fold, compositions, compatibility forms, controls.
PROBE = "  Ａ ﬁ  e\u0301 é ½ ①\t\u200b\u00a0A\n "


class Pieces:
    """The pieces of a model file and the lattice over them."""

    def __init__(self, path: str, algorithm: str = "bpe", cache: int = 250_000):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        # the library itself shows the normalization: only spaces are replaced, and one is put in front
        if sp.normalize(PROBE) != SPACE_MARK + PROBE.replace(" ", SPACE_MARK):
            raise ValueError("the model normalizes texts in another way than by space marks alone")
        ids = range(sp.vocab_size())
        plain = [i for i in ids if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.id = {sp.id_to_piece(i): i for i in plain}
        self.score = {sp.id_to_piece(i): sp.get_score(i) for i in plain}
        self.bytes = {int(sp.id_to_piece(i)[3:5], 16): i for i in ids if sp.is_byte(i)}
        self.unknown = sp.unk_id()
        self.longest = max(map(len, self.id))
        self.raw = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else b"" if sp.is_control(i) else sp.id_to_piece(i).encode() for i in ids]
        self.algorithm = algorithm
        self.worst = min(self.score.values(), default=0.0) - 10
        #: For the last three characters of a piece, the lengths of pieces of three or more that end so, longest first.
        lengths: dict[str, set[int]] = {}
        inner: set[str] = set()
        #: Pieces of several characters that a path can hold; in a BPE model, those that their own characters merge into.
        self.usable = {p for p in self.id if len(p) > 1 and (algorithm != "bpe" or self.merged(p) == [p])}
        for p in self.id:
            if len(p) > 1:
                inner.update(p)
            if p in self.usable and len(p) > 2:
                lengths.setdefault(p[-3:], set()).add(len(p))
        self.lengths = {k: tuple(sorted(v, reverse=True)) for k, v in lengths.items()}
        apart = "".join(c for c in "\n\r\t" if c not in inner)
        if any(SPACE_MARK in p.lstrip(SPACE_MARK) for p in self.id):
            raise ValueError("a piece has a space mark inside; words can't be encoded apart")
        self.segments = re.compile(f"{SPACE_MARK}+[^{SPACE_MARK}{apart}]*|[^{SPACE_MARK}{apart}]+" + (f"|[{apart}]" if apart else ""))
        self.apart: dict[tuple[str, str], bool] = {}
        #: What is remembered of words, by what it is used for: two generations each, of at most ``cache`` words.
        self.size, self.memory = cache, {}
        #: How often the stream has committed, and the widest window it held.
        self.commits, self.widest = 0, 0

    def merged(self, text: str) -> list[str]:
        """BPE of a short string, merge by merge: the best score first, the leftmost of equals."""
        parts, score = list(text), self.score.get
        pairs = [score(x + y, NEVER) for x, y in zip(parts, parts[1:])]  # noqa: B905
        while pairs and (best := max(pairs)) > NEVER:
            i = pairs.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i:
                pairs[i - 1] = score(parts[i - 1] + parts[i], NEVER)
            if i < len(pairs):
                pairs[i] = score(parts[i] + parts[i + 1], NEVER)
        return parts

    def fits(self, left: str, right: str) -> bool:
        """Whether two pieces stay apart next to each other."""
        ok = self.apart.get((left, right))
        if ok is None:
            if len(self.apart) > 250_000:
                self.apart.clear()
            ok = self.apart[left, right] = self.merged(left + right) == [left, right]
        return ok

    def pass_bpe(self, text: str, last: list[str], until: int) -> None:
        """Runs the lattice on to ``text[:until]``: ``last`` has the last piece of the encoding of each prefix it has passed, at 0 an
        empty one, and gets those of the following prefixes."""
        usable, apart, fits, lengths, push = self.usable, self.apart, self.fits, self.lengths.get, last.append
        for i in range(len(last), until + 1):
            for k in lengths(text[i - 3 : i], ()) if i > 2 else ():
                if k <= i and (piece := text[i - k : i]) in usable:
                    left = last[i - k]
                    if not left or (ok := apart.get((left, piece))) or ok is None and fits(left, piece):
                        push(piece)
                        break
            else:
                if i > 1 and (piece := text[i - 2 : i]) in usable:
                    left = last[i - 2]
                    if not left or (ok := apart.get((left, piece))) or ok is None and fits(left, piece):
                        push(piece)
                        continue
                push(text[i - 1])

    def _last_unigram(self, text: str, i: int, best: list[float]) -> tuple[int, float]:
        k, top = 1, best[i - 1] + self.score.get(text[i - 1], self.worst)
        for n in range(2, min(self.longest, i) + 1):
            s = self.score.get(text[i - n : i])
            if s is not None and best[i - n] + s > top:
                k, top = n, best[i - n] + s
        return k, top

    def _path(self, last: list[str], end: int) -> list[str]:
        out = []
        while end > 0:
            out.append(last[end])
            end -= len(last[end])
        return out[::-1]

    def _converged(self, last: list[str]) -> int:
        """The last boundary that the paths of all live positions pass; 0 if they meet only at the start."""
        n = len(last) - 1
        ends = set(range(max(1, n - self.longest + 1), n + 1))
        while len(ends) > 1:
            i = max(ends)
            ends.remove(i)
            ends.add(i - len(last[i]))
        return max(0, ends.pop())

    def stream(self, chunks: Iterable[str], text: str = "", last: list[str] | None = None, best: list[float] | None = None) -> Iterator[list[str]]:
        """Commits pieces of a normalized text that comes in chunks; the window never exceeds a few times ``longest`` and a
        chunk. ``text``, ``last`` and ``best`` are a prefix that a lattice has passed; it runs on in those lists."""
        bpe, longest = self.algorithm == "bpe", self.longest
        last, best = [""] if last is None else last, [0.0] if best is None else best
        for chunk in chunks:
            text += chunk
            while len(last) <= len(text):
                # to the next place where the paths are asked whether they have converged
                until = min(len(text), max(2 * longest, (len(last) // longest + 1) * longest))
                if bpe:
                    self.pass_bpe(text, last, until)
                else:
                    for i in range(len(last), until + 1):
                        k, score = self._last_unigram(text, i, best)
                        last.append(text[i - k : i])
                        best.append(score)
                if until >= 2 * longest and until % longest == 0 and (edge := self._converged(last)):
                    self.commits, self.widest = self.commits + 1, max(self.widest, len(text))
                    yield self._path(last, edge)
                    # what lies before the edge is no longer pointed at by any live position
                    text = text[edge:]
                    del last[:edge], best[:edge]
        if text:  # the next mark, or the text's end: only this boundary is live
            self.commits, self.widest = self.commits + 1, max(self.widest, len(text))
            yield self._path(last, len(text))

    def ids_of(self, piece: str) -> list[int]:
        i = self.id.get(piece)
        if i is not None:
            return [i]
        return [self.bytes[b] for b in piece.encode("utf-8", "surrogatepass")] if self.bytes else [self.unknown]

    def parts(self, text: str) -> Iterator[list[str]]:
        """The words of a normalized text, from one boundary where all paths meet to the next, PART at a time."""
        if len(text) <= PART:
            yield self.segments.findall(text)
            return
        found = (m[0] for m in self.segments.finditer(text))
        while held := list(islice(found, PART)):
            yield held

    def values(self, texts: list, passed) -> list[list]:
        """For each text, ``passed(word, last, out, best)`` for each of its words: a lattice that begins at the word's start,
        where all paths meet, or has passed a prefix of it. Each ``passed`` has a memory of its own.

        Words go through TOGETHER at a time, so what is held of a text beside its results has a bound.
        """
        rows: list[list] = [[] for _ in texts]
        waiting, n = [], 0
        for row, t in zip(rows, texts, strict=True):
            for own in self.parts(self.normalized(t)) if t else ():
                waiting.append((row, own))
                n += len(own)
                if n >= TOGETHER:
                    self._answer(waiting, passed)
                    waiting, n = [], 0
        self._answer(waiting, passed)
        return rows

    def _answer(self, waiting: list, passed) -> None:
        """Adds what ``passed`` gives for each word to the rows that wait for it.

        Words not in the memory are taken in sorted order, so that one run of the lattice serves the prefix that neighbours
        share. The memory has two generations: what is asked for again outlives the clearing of the older one.
        """
        name = passed.__qualname__
        young, old = self.memory.setdefault(name, ({}, {}))
        open_rows, missing = [], set()
        for row, own in waiting:
            at, known = len(row), list(map(young.get, own))
            row += known
            new = [(at + k, own[k]) for k, v in enumerate(known) if v is None]
            if new:  # only words that aren't known yet are held on to
                open_rows.append((row, new))
                missing.update(s for _, s in new)
        for s in missing & old.keys():
            young[s] = old.pop(s)
            missing.discard(s)
        last, out, best, before, longer = [""], [0], [0.0], "", []
        for s in sorted(missing):
            k = 0
            for x, y in zip(before, s):  # noqa: B905
                if x != y:
                    break
                k += 1
            del last[k + 1 :], out[k + 1 :], best[k + 1 :]
            young[s] = passed(s, last, out, best)
            before = s
            if len(last) <= len(s):  # the stream has dropped what it committed
                last, out, best, before = [""], [0], [0.0], ""
            if len(s) > KEPT:
                longer.append(s)
        for row, new in open_rows:
            for k, s in new:
                row[k] = young[s]
        for s in longer:
            del young[s]
        if len(young) > self.size:
            self.memory[name] = ({}, young)

    def _committed(self, word: str, last: list[str], out: list[int], best: list[float]) -> bytes:
        """Ids of a word as the stream commits them; a word that ends before the first question has one commit, at its end."""
        at, n = len(last) - 1, len(word)
        if n < 2 * self.longest and self.algorithm == "bpe":
            self.pass_bpe(word, last, n)
            self.commits += 1
            self.widest = max(self.widest, n)
            return self._path_ids(self._path(last, n))
        chunks = (word[i : i + CHUNK] for i in range(at, n, CHUNK))
        done = [self._path_ids(p) for p in self.stream(chunks, word[:at], last, best)]
        return done[0] if len(done) == 1 else b"".join(done)

    def normalized(self, text: str) -> str:
        return SPACE_MARK + text.replace(" ", SPACE_MARK) if text else ""

    def _path_ids(self, pieces: list[str]) -> bytes:
        known = self.id
        try:
            ids = [known[p] for p in pieces]
        except KeyError:
            ids = [i for p in pieces for i in self.ids_of(p)]
        return array("i", ids).tobytes()

    def encode(self, texts: list) -> list[np.ndarray]:
        """Ids of each text as int32; a null text has none."""
        found = self.values(texts, self._committed)
        return [np.frombuffer(b"".join(x), np.int32) for x in found]

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids: bytes join to characters (broken ones become U+FFFD), space marks to spaces, less the first."""
        raw = self.raw
        text = b"".join([raw[i] for i in ids]).decode("utf-8", "replace").replace(SPACE_MARK, " ")
        return text[1:] if text.startswith(" ") else text


def encode_documents(docs: DataFrame, model: str, algorithm: str = "bpe", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids, n_tokens, decoded_sha256, round_trip``: ids of every whole text, decoded again and compared.

    A null text has null ids and round_trip, no tokens; an empty one an empty array. Repeated rows and null ids are
    encoded row by row; an empty table gives no rows. Texts with U+2581 come back with spaces in its place: round_trip is
    false for them. ``model`` is a path that each executor can read. Other columns aren't read.
    """
    def make():
        pieces = Pieces(model, algorithm)

        def work(texts: list) -> list:
            ids = [None if t is None else i for t, i in zip(texts, pieces.encode(texts), strict=True)]
            back = [None if i is None else pieces.decode(i.tolist()) for i in ids]
            return [
                ids,
                [0 if i is None else len(i) for i in ids],
                [None if b is None else hashlib.sha256(b.encode("utf-8", "surrogatepass")).hexdigest() for b in back],
                [None if t is None else b == t for t, b in zip(texts, back, strict=True)],
            ]

        return work

    return map_texts(docs, make, "ids array<int>, n_tokens bigint, decoded_sha256 string, round_trip boolean", id_col, text_col, rows=512)
