"""Whitening, importance resampling and SimHash classes against plain loops."""

import hashlib
import math
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from waylens.llm import importance, simhash, whitening
from waylens.llm.queries import op11_whitening, op12_importance, op13_simhash


# whitening


def check_whitening(rows, vectors, most=32, tolerance=1e-9):
    """``rows`` of the operator against exact sums and a covariance of fractions' worth of precision."""
    x = np.array([[math.floor(64 * float(c)) + 1_000_000 for c in v] for _, v in vectors], dtype=object)
    n, sums = len(x), x.sum(axis=0)
    spread = n * x - sums
    exact = [int(v) for v in (spread**2).sum(axis=1)]
    v = np.array([[float(Fraction(int((spread[:, i] * spread[:, j]).sum()), n**3)) for j in range(x.shape[1])] for i in range(x.shape[1])])
    values = np.linalg.eigvalsh(v)[::-1]
    k = min(most, int((values > values[0] * 1e-9).sum()))
    assert len(rows) == n * k
    by_id: dict = {}
    for r in rows:
        by_id.setdefault((r["vec_id"], r["deviation"]), []).append(r)
    assert sorted(by_id, key=repr) == sorted({(i, d) for (i, _), d in zip(vectors, exact, strict=True)}, key=repr)
    w = np.array([[r["whitened"] for r in sorted(rows, key=lambda r: (repr(r["vec_id"]), r["deviation"])) if r["component"] == c] for c in range(1, k + 1)])
    assert np.abs(w @ w.T / n - np.eye(k)).max() < tolerance and np.abs(w.mean(axis=1)).max() < tolerance
    for r in rows:
        assert r["n"] == n and abs(r["explained"] - values[r["component"] - 1] / np.trace(v)) < 1e-9 and 0 <= r["identity_error"] < 1e-9
    # projections: whitened values of one component give back e^(1/2) of its unit eigenvector
    order = sorted(range(n), key=lambda i: (repr(vectors[i][0]), exact[i]))
    centred = np.array([[float(Fraction(int(s), n)) for s in spread[i]] for i in order])
    loads = centred.T @ w.T / n
    assert np.allclose((loads**2).sum(axis=0), values[:k], rtol=1e-8)
    assert np.allclose(v @ loads, loads * values[:k], atol=1e-7 * values[0])


def test_whitening_query(spark, sf):
    vectors = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    check_whitening(op11_whitening(spark, sf).collect(), vectors)


@pytest.fixture(scope="module")
def odd_vectors(spark):
    rng = np.random.default_rng(3)
    good = [(i, [float(x) for x in rng.normal(size=5) * [1, 5, 0.5, 40, 200]]) for i in range(60)]
    bad = [(100, None), (101, []), (102, [1.0, None, 2.0, 3.0, 4.0]), (103, [1.0, math.nan, 2.0, 3.0, 4.0]), (104, [math.inf, 1.0, 2.0, 3.0, 4.0]), (105, [1.0, 2.0]), (None, None)]
    repeated = [(7, good[7][1])] * 40 + [(None, good[8][1])]
    df = spark.createDataFrame(good + bad + repeated, "vec_id int, embedding array<double>")
    for name in ("v", "n", "dim", "block", "at", "a`b"):
        df = df.withColumn(name, F.lit("clash"))
    return df, good + repeated


def test_whitening_leaves_out_broken_vectors(odd_vectors):
    df, vectors = odd_vectors
    rows = whitening.whitened_components(df.repartition(5)).collect()
    check_whitening(rows, vectors)


def test_tiles_change_nothing(odd_vectors):
    df, _ = odd_vectors
    usual, small = whitening.fit_whitening(df), whitening.fit_whitening(df, tile=2, rows=7)
    assert usual.sums == small.sums and np.allclose(usual.values, small.values, rtol=1e-12) and np.allclose(np.abs(usual.vectors), np.abs(small.vectors), atol=1e-9)


def test_without_variance_or_rows(spark):
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(4)], "vec_id bigint, embedding array<float>")
    assert whitening.whitened_components(same).count() == 0
    empty = whitening.whitened_components(same.limit(0))
    assert empty.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and empty.count() == 0
    line = spark.createDataFrame([(i, [float(i), 2.0 * i, 0.0]) for i in range(4)], "vec_id bigint, embedding array<float>")
    assert {r["component"] for r in whitening.whitened_components(line).collect()} == {1}


def test_deviations_beyond_a_long_are_null(spark):
    rows = [(i, [1e30 if i % 2 else -1e30, float(i)]) for i in range(10)]
    found = whitening.whitened_components(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()
    assert {r["deviation"] for r in found} == {None} and {r["component"] for r in found} <= {1, 2}


# importance resampling


def plain_importance(docs, target, percent=10, least=20, longest=1, buckets=10_000, seed=2024):
    def features(text):
        found = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return len(found), [zlib.crc32(" ".join(found[i : i + k]).encode()) % buckets for k in range(1, longest + 1) for i in range(len(found) - k + 1)]

    s, t = [0] * buckets, [0] * buckets
    for counts, texts in ((s, [x for _, x in docs]), (t, target)):
        for text in texts:
            for b in features(text)[1]:
                counts[b] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s) + buckets) / ((s[b] + 1) * (sum(t) + buckets)))) for b in range(buckets)]
    rows = []
    for doc_id, text in docs:
        n, found = features(text)
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in found)
        rows.append([doc_id, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    able = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    ranks = {id(r): i + 1 for i, r in enumerate(able[: len(able) * percent // 100])}
    return sorted((tuple(r[:4]) + (ranks.get(id(r)),) for r in rows), key=repr)


def test_importance_of_odd_documents(spark, odd):
    docs = [(r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").collect()]
    target = ["one two three", None, "", "line here é 日本 a b", "x " * 500]
    frame = spark.createDataFrame([(t,) for t in target], "text string")
    for longest in (1, 3):
        found = importance.importance_resample(odd, frame, percent=60, least_words=2, longest=longest)
        assert sorted((tuple(r) for r in found.collect()), key=repr) == plain_importance(docs, target, 60, 2, longest)


def test_importance_query(spark, sf, documents):
    docs = [(r["doc_id"], r["text"]) for r in documents.collect()]
    target = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert sorted((tuple(r) for r in op12_importance(spark, sf).collect()), key=repr) == plain_importance(docs, target)


def test_importance_of_empty_tables(spark, odd):
    nothing = spark.createDataFrame([], "doc_id bigint, text string")
    assert importance.importance_resample(nothing, odd).count() == 0
    assert importance.importance_resample(odd, nothing).count() == odd.count()


def test_long_texts_come_in_parts():
    text = "ab Cd é1 " * 1000
    known = importance.Buckets(97)
    for longest in (1, 2, 3):
        whole = np.concatenate([b for b, _ in importance.bucket_parts(text, known, longest, 1 << 20)])
        parts = [b for b, _ in importance.bucket_parts(text, known, longest, 17)]
        assert len(parts) > 100 and sorted(np.concatenate(parts)) == sorted(whole)


# SimHash


def plain_fingerprint(text):
    found = re.findall("[^ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(found[i : i + 4]) for i in range(max(1, len(found) - 3))] if found else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_classes(rows, radius=4):
    distinct = sorted({fp for _, fp in rows})
    root = {fp: fp for fp in distinct}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(distinct):
        for b in distinct[i + 1 :]:
            if (a ^ b).bit_count() <= radius:
                root[top(a)] = top(b)
    least: dict = {}
    for doc_id, fp in rows:
        if doc_id is not None:
            least[top(fp)] = min(doc_id, least.get(top(fp), doc_id))
    return sorted(((i, f"{fp:016x}", least.get(top(fp))) for i, fp in rows), key=repr)


def test_simhash_query(spark, sf, documents):
    rows = [(r["doc_id"], plain_fingerprint(r["text"])) for r in documents.collect()]
    assert sorted((tuple(r) for r in op13_simhash(spark, sf).collect()), key=repr) == plain_classes(rows)


def test_simhash_of_odd_documents(odd):
    rows = [(r["doc_id"], plain_fingerprint(r["text"])) for r in odd.select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in simhash.near_duplicates(odd).collect()), key=repr) == plain_classes(rows)
    assert simhash.near_duplicates(odd.limit(0)).count() == 0


def test_parts_of_a_long_text(monkeypatch):
    text = " ".join(str(i * i % 977) for i in range(3000))
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "PART", 97)
    assert simhash.fingerprint(text) == whole == plain_fingerprint(text)


def test_links_of_crowded_tiles(spark, monkeypatch):
    rng = np.random.default_rng(1)
    base = rng.integers(-(2**62), 2**62, 12)
    near = [int(b) ^ sum(1 << int(k) for k in rng.choice(63, rng.integers(0, 4), replace=False)) for b in base for _ in range(40)]
    chain = [0]
    for k in range(0, 60, 4):  # each four bits beyond the one before: one class without a close pair at its ends
        chain.append(chain[-1] | 0b1111 << k)
    values = sorted({*near, *chain, -1})
    df = spark.createDataFrame([(v,) for v in values], "fp bigint")
    monkeypatch.setattr(simhash, "CELLS", 64)
    for size in (3, 512):
        edges = simhash.tile_links(df, tile_rows=size).collect()
        root = {v: v for v in values}

        def top(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in edges:
            root[top(a)] = top(b)
        mask = (1 << 64) - 1
        want = plain_classes([(v, v & mask) for v in values])
        least = {}
        for v in values:
            least[top(v)] = min(v, least.get(top(v), v))
        assert sorted(((v, f"{v & mask:016x}", least[top(v)]) for v in values), key=repr) == want
