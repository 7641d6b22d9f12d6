"""Mixing, sharding and quality rules against plain Python."""

import re
from collections import Counter, defaultdict

from waylens.llm import mixing, quality, sharding

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def rows(df):
    return df.collect()


def test_permutation_is_a_permutation():
    for n in (1, 2, 3, 7, 64, 1000):
        assert sorted(sharding.place(i, n, 3) for i in range(n)) == list(range(n))


def test_shards(odd, documents):
    for docs in (odd, documents, odd.limit(0)):
        got = rows(sharding.shard_documents(docs))
        n = docs.count()
        assert sorted(r.place for r in got) == list(range(n)) == sorted(r.row_number for r in got)
        assert all(r.place == sharding.place(r.row_number, n, 20240607) for r in got)
        slots = defaultdict(list)
        for r in got:
            slots[r.shard].append(r.slot)
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
        assert len(slots) == min(n, 40) and max(map(len, slots.values()), default=0) - min(map(len, slots.values()), default=0) <= 1


def test_shards_do_not_depend_on_partitions(documents):
    key = lambda df: sorted((r.doc_id, r.shard, r.slot) for r in df.collect())
    assert key(sharding.shard_documents(documents)) == key(sharding.shard_documents(documents.repartition(7)))


def expected_targets(sizes, cap=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target = dict.fromkeys(names, 0.0)
    free, left = set(names), float(sum(sizes.values()))
    while left > 1e-6 and free:
        total = sum(weight[s] for s in free)
        share = {s: left * weight[s] / total for s in free}
        left = 0.0
        for s in list(free):
            target[s] += share[s]
            if target[s] > cap * sizes[s]:
                left += target[s] - cap * sizes[s]
                target[s] = cap * sizes[s]
                free.remove(s)
    return target


def test_mix(odd, documents):
    for docs in (odd, documents):
        got = rows(mixing.mix_sources(docs))
        text = Counter((r.doc_id, r.source, len(WORDS.findall(r.text or ""))) for r in docs.collect())
        assert Counter((r.doc_id, r.source, r["size"]) for r in got) == text
        sizes, taken, longest = Counter(), Counter(), Counter()
        for r in got:
            sizes[r.source] += r["size"]
            taken[r.source] += r.taken
            longest[r.source] = max(longest[r.source], r["size"])
            assert r.taken <= 3 * r["size"]
        targets = expected_targets(sizes)
        for r in got:
            assert abs(r.target - targets[r.source]) < 1e-6 * max(1, r.target) and r.source_size == sizes[r.source]
        for s in sizes:
            assert abs(taken[s] - targets[s]) <= longest[s] / 2 + 1e-6, s
        again = rows(mixing.mix_sources(docs.repartition(5)))
        assert sorted(map(repr, got)) == sorted(map(repr, again))
    assert mixing.mix_sources(odd.limit(0)).count() == 0


def expected_statistics(text):
    words = WORDS.findall(text or "")
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    count = Counter(windows)
    covered = {j for i, w in enumerate(windows) if count[w] > 1 for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if WORDS.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_statistics(odd, documents):
    for docs in (odd, documents):
        want = Counter((r.doc_id, *expected_statistics(r.text)) for r in docs.collect())
        got = rows(quality.statistics(docs))
        assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
        assert all(r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) for r in got)


def test_filters_on_statistics_are_not_inlined(odd):
    plan = quality.statistics(odd).where("n_repeat_words = 0 AND NOT base_failed")._jdf.queryExecution().optimizedPlan().toString()
    assert "split(coalesce" in plan and max(line.count("split(") for line in plan.splitlines()) <= 2


def test_rules_are_learned_and_hold(spark):
    import random

    rng = random.Random(1)
    made = []
    for i in range(400):
        bad = i % 4 == 0
        words = ["".join(rng.choice("abcdefgh") for _ in range(6)) + ("###" if bad else "") for _ in range(30)]
        made.append((i, " ".join(words), 0 if bad else 1))
    docs = spark.createDataFrame(made, "doc_id bigint, text string, quality int")
    judged = rows(quality.quality_filter(docs.drop("quality"), docs.select("doc_id", "quality")))
    assert {r.doc_id for r in judged if not r.kept} == {i for i in range(400) if i % 4 == 0}
    assert {r.rule for r in judged if r.rule} and all(">" in r.rule or "<=" in r.rule for r in judged if r.rule)


def test_without_labels_the_base_rules_decide(odd, labels):
    got = rows(quality.quality_filter(odd, labels.limit(0)))
    assert len(got) == odd.count() and all(r.kept == (not r.base_failed) for r in got)
    assert quality.quality_filter(odd.limit(0), labels).count() == 0
