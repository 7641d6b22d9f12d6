"""The Jaccard join and the components against all pairs."""

import re
from collections import Counter, defaultdict

import numpy as np

from waylens.llm import jaccard
from waylens.llm.components import components
from waylens.llm.shingles import shingle_sets, word_hashes

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    words = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def expected(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    parent = list(range(len(sets)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                parent[find(a)] = find(b)
    names = defaultdict(list)
    for k, (i, s) in enumerate(sets):
        if s and i is not None:
            names[find(k)].append(i)
    return Counter((i, len(s), min(names[find(k)], default=None) if s else i) for k, (i, s) in enumerate(sets))


def check(docs, **options):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.similar_components(docs, **options).collect())
    assert got == expected(rows)


def test_odd(odd):
    check(odd)
    assert jaccard.similar_components(odd.limit(0)).count() == 0


def test_documents(documents):
    check(documents)


def test_split_lists_small_blocks_and_ids_that_clash(documents):
    check(documents, hot=10, block_bytes=4096, id_bits=5)


def test_words_that_defeat_a_polynomial(spark):
    """Thue-Morse words have equal polynomials modulo a power of two, whatever its base."""
    a, b = "a", "b"
    while len(a) < 2048:
        a, b = a + b, b + a
        assert word_hashes([a])[0] != word_hashes([b])[0]
    words = lambda w: " ".join([w, "one", "two", "three", "four", "five"] * 3)
    check(spark.createDataFrame([(1, words(a)), (2, words(b)), (3, a), (4, b), (5, words(a) + " six")], "doc_id bigint, text string"))


def test_word_hashes_are_the_words_own():
    """The same word has the same hash wherever it stands, and no two words share one."""
    import random

    rng = random.Random(3)
    words = ["x" * n for n in range(1, 200)] + ["".join(rng.choice("abé日") for _ in range(rng.randint(1, 90))) for _ in range(5000)]
    words = sorted(set(words))
    texts = [" ".join(words[i::7]) for i in range(7)] + [None, ""] + words
    hashes, at = word_hashes(texts)
    alone = hashes[at[9] :]
    assert len(set(alone.tolist())) == len(words)
    for i in range(7):
        assert hashes[at[i] : at[i + 1]].tolist() == alone[i::7].tolist()


def test_one_template(spark):
    """Pages of one template that differ in a slot or two: long lists over many components, and no pair of most."""
    import random

    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    frame = [word() for _ in range(120)]
    rows = [(i, " ".join([*frame[:60], *(word() for _ in range(5 + i % 40)), *frame[60:]])) for i in range(1200)]
    check(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4), hot=100, block_bytes=1 << 16)


def test_many_near_copies_and_a_common_passage(spark):
    """Lists longer than the neighbourhood: a chain of near copies, and a passage in unlike documents."""
    import random

    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(8))
    base, passage = [word() for _ in range(200)], [word() for _ in range(30)]
    rows = []
    for i in range(60):
        own = list(base)
        for at in rng.sample(range(200), 3 + i % 5):
            own[at] = word()
        rows.append((i, " ".join(own)))
    rows += [(100 + i, " ".join([*passage, *(word() for _ in range(40))])) for i in range(40)]
    rows += [(200 + i, " ".join([*passage, word()])) for i in range(25)]
    check(spark.createDataFrame(rows, "doc_id bigint, text string"))


def test_prefixes_share_enough():
    rng = np.random.default_rng(3)
    frequent = np.sort(rng.integers(-(2**62), 2**62, 300))
    counts = rng.integers(8, 500, 300)
    for _ in range(300):
        n = int(rng.integers(1, 80))
        a = np.unique(np.concatenate((rng.choice(frequent, n // 2), rng.integers(-(2**62), 2**62, n - n // 2))))
        b = a.copy()
        b[rng.integers(0, len(b), len(b) // 20)] = rng.integers(-(2**62), 2**62)
        b = np.unique(b)
        common = len(np.intersect1d(a, b))
        if 100 * common >= 80 * (len(a) + len(b) - common):
            x, m, _ = jaccard.prefix_of(a, frequent, counts, 80)
            y, k, _ = jaccard.prefix_of(b, frequent, counts, 80)
            assert len(np.intersect1d(x, y)) >= min(m, k)


def test_shingle_hashes_tell_sets_apart():
    texts = ["a b c d e f", "A b\tc\nd  e f ", "ab c d e f", "a b c d", "a b c", "", None, " ", "a b c d e f a b c d e f"]
    sets = shingle_sets(texts)
    assert [len(s) for s in sets] == [2, 2, 1, 1, 1, 0, 0, 0, 6]
    assert (sets[0] == sets[1]).all() and len({tuple(s) for s in sets if len(s)}) == 5


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 1), (10, 9), (9, 8), (20, 20), *((i, i + 1) for i in range(100, 160)), *((500, i) for i in range(501, 540))]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    want = {1: 1, 2: 1, 3: 1, 10: 8, 9: 8, 8: 8} | {i: 100 for i in range(100, 161)} | {i: 500 for i in range(500, 540)}
    assert got == want
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
