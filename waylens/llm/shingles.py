"""Word shingles as 64-bit hashes, computed for many texts at once with numpy."""

from __future__ import annotations

import numpy as np
import xxhash

#: Words of a shingle.
SIZE = 5
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Words of more bytes are hashed one by one; shorter ones eight bytes at a time, all words at once.
SHORT_WORD = 64
#: For n bytes left of a word, the mask of its next eight.
_LEFT = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def word_hashes(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts (A-Z lower-cased), and where each text's words begin, one more at the end.

    Eight bytes at a time are mixed into a state that begins with the word's size, so words of one size up to eight bytes
    never collide; words over SHORT_WORD bytes take xxh3.
    """
    parts = [b"" if t is None else t.encode("utf-8", "surrogatepass").lower() for t in texts]
    raw = b"\n".join([b"", *parts, bytes(8)])
    n = len(raw) - 8
    data = np.frombuffer(raw, np.uint8)
    begins = np.cumsum([1, *(len(p) + 1 for p in parts)])
    space = _SPACE[data[:n]]
    starts = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
    sizes = ends - starts
    lanes = np.ndarray((n,), "<u8", raw, strides=(1,))
    hashes = _mix(sizes.astype(np.uint64))
    for done in range(0, min(SHORT_WORD, int(sizes.max(initial=0))), 8):
        at = np.flatnonzero(sizes > done) if done else slice(None)
        hashes[at] = _mix(hashes[at] ^ (lanes[starts[at] + done] & _LEFT[np.minimum(sizes[at] - done, 8)]))
    for i in np.flatnonzero(sizes > SHORT_WORD).tolist():
        hashes[i] = xxhash.xxh3_64_intdigest(raw[starts[i] : ends[i]])
    return hashes, np.searchsorted(starts, begins)


def shingle_sets(texts: list) -> list[np.ndarray]:
    """Sorted distinct shingle hashes (int64) of each text: of SIZE words, or of all words where there are fewer."""
    words, at = word_hashes(texts)
    n = len(words)
    if n >= SIZE:
        h = words[: n - SIZE + 1].copy()
        for i in range(1, SIZE):
            h = _mix(h * np.uint64(5) + np.uint64(i) + words[i : n - SIZE + 1 + i])
        h = h.view(np.int64)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= SIZE:
            own = np.sort(h[a : b - SIZE + 1])
            out.append(own[np.concatenate(([True], own[1:] != own[:-1]))])
        elif b > a:
            short = words[a : a + 1]
            for i in range(a + 1, b):
                short = _mix(short * np.uint64(3) + words[i : i + 1])
            out.append(_mix(short + np.uint64(b - a)).view(np.int64))
        else:
            out.append(np.zeros(0, np.int64))
    return out


def set_id(shingles: np.ndarray) -> tuple[int, int]:
    """128-bit id of a set as two signed 64-bit halves; equal sets have equal ids."""
    digest = np.frombuffer(xxhash.xxh3_128_digest(shingles.tobytes(), len(shingles)), np.int64)
    return int(digest[0]), int(digest[1])
