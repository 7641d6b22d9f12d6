"""The pipeline's stages: columns, decisions and odd rows."""

from collections import Counter

import corpus_pipeline as pipeline
from pyspark.sql import functions as F
from test_pairs import shingles

from waylens.llm import mixing, pii, quality
from waylens.llm.common import materialize


def test_stages(spark, sf, odd):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = [n for n, _ in pipeline.STAGES]
    assert len(names) == 5
    kept = [docs]
    for name, stage in pipeline.STAGES:
        kept.append(materialize(stage(spark, kept[-1], sf), "test-stage"))
        if name != names[-1]:
            assert kept[-1].columns == docs.columns and kept[-1].dtypes == docs.dtypes, name
    good, single, clean, mixed, ids = kept[1:]
    ok = {r.doc_id for r in docs.collect() if len(r.text.split()) >= 10}
    assert {r.doc_id for r in good.select("doc_id").collect()} <= ok and good.count() > 0.7 * docs.count()
    assert single.count() == single.select("doc_id").distinct().count() < good.count()
    assert not clean.where("text rlike '[A-Za-z0-9]@[a-z0-9]+[.]example'").count() and clean.where("text like '%<email>%'").count()
    assert clean.where("n_chars <> length(text)").count() == 0 and clean.count() == single.count()
    assert mixed.select("doc_id").distinct().count() < mixed.count() or mixed.count() <= clean.count()
    assert ids.count() == mixed.count() and ids.where("NOT round_trip").count() == 0


def test_odd_rows_and_empty_tables(spark, sf, odd):
    for docs in (odd, odd.limit(0)):
        for name, stage in pipeline.STAGES:
            docs = materialize(stage(spark, docs, sf), "test-odd")
            if name != pipeline.STAGES[-1][0]:
                assert docs.columns == odd.columns


def test_spans_are_broadcast_by_their_number(spark, sf, monkeypatch):
    monkeypatch.setattr(pipeline, "BROADCAST_ROWS", 20)
    for ids, joined in (([1], "BroadcastHashJoin"), ([1, None], "SortMergeJoin")):
        docs = spark.createDataFrame([(i, " ".join(f"u{j}@x.org" for j in range(15))) for i in ids] + [(9, "no mail"), (None, None)], "doc_id bigint, text string")
        clean = pipeline.personal_data(spark, docs, sf)
        assert joined in clean._jdf.queryExecution().executedPlan().toString()
        want = [(i, " ".join(["<email>"] * 15)) for i in ids] + [(9, "no mail"), (None, None)]
        assert sorted(map(str, clean.collect())) == sorted(f"Row(doc_id={i!r}, text={t!r})" for i, t in want)


def rows_of(df):
    return Counter((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())


def kept_by_rules(spark, docs, sf):
    """Rules evaluated in plain Python over the statistics."""
    rules = quality.learn_rules(quality.labelled_statistics(docs, spark.read.parquet(f"{sf}/labels.parquet"), "quality", 20_000, "doc_id", "text"))
    stats = quality.statistics(docs.select(F.struct("doc_id", "text").alias("k"), "text"), "k").collect()
    bad = lambda r: r.base_failed or any(all((r[c.feature] > c.threshold) == c.above for c in rule.conditions) for rule in rules)
    return Counter((r.doc_id.doc_id, r.doc_id.text) for r in stats if not bad(r))


def heads_of_classes(docs):
    """One key of each group of similar texts, by all pairs."""
    rows = [((r.doc_id is not None, r.doc_id, r.h), r.text) for r in docs.select("doc_id", "text", F.xxhash64("text").alias("h")).distinct().collect()]
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                parent[top(a)] = top(b)
    first = {}
    for i, (k, t) in enumerate(rows):
        order = (k[0], k[1] or 0, k[2])
        if top(i) not in first or order < first[top(i)][0]:
            first[top(i)] = (order, k[1], t)
    return Counter((i, t) for _, i, t in first.values())


def without_spans(docs):
    found = pii.find_personal_data(docs.select(F.struct("doc_id", "text").alias("k"), "text"), id_col="k").select("doc_id", pii.marked(pii.KINDS).alias("spans")).collect()
    out = Counter()
    for r in found:
        text, made, at = r.doc_id.text, "", 0
        for s in r.spans:
            if s.s >= at:
                made += text[at : s.s] + f"<{s.k}>"
            at = max(at, s.e)
        out[r.doc_id.doc_id, text if text is None else made + text[at:]] += 1
    return out


def taken(docs):
    key = F.struct(F.col("doc_id").alias("i"), F.xxhash64("text").alias("h"), F.col("source"))
    mixed = mixing.mix_sources(docs.select(key.alias("k"), "text", "source"), id_col="k").collect()
    text = {(r.doc_id, r.h): r.text for r in docs.select("doc_id", "text", F.xxhash64("text").alias("h")).collect()}
    out = Counter()
    for r in mixed:
        out[r.doc_id.i, text[r.doc_id.i, r.doc_id.h]] += (r.epochs + r.picked) if r["size"] else 0
    return +out


def test_each_stage_against_brute_force(spark, sf, odd):
    documents = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source")
    twice = odd.select("doc_id", "text", "source").where("length(text) < 40000 OR text IS NULL")
    docs = materialize(documents.unionByName(twice).unionByName(documents.where("doc_id % 10 = 0").withColumn("source", F.lit("elsewhere"))), "mixed")
    expected = (lambda d: kept_by_rules(spark, d, sf), heads_of_classes, without_spans, taken)
    for (name, stage), want in zip(pipeline.STAGES, expected):  # noqa: B905
        made = materialize(stage(spark, docs, sf), "brute")
        assert rows_of(made) == want(docs), name
        docs = made
