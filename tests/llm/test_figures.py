"""How well learned operators do on rows that they weren't fitted on; the figures stand in the README."""

import pytest
from pyspark.sql import functions as F

from waylens.llm import pii, quality, toxicity

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def big(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def test_quality_rules_on_unseen_labels(big):
    docs, labels = big
    seen = labels.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0)
    rules = quality.learn_rules(quality.labelled_statistics(docs, seen, "quality", 20_000, "doc_id", "text"))
    unseen = labels.join(seen, "doc_id", "left_anti").where("quality IS NOT NULL").select("doc_id", "quality")
    judged = quality.apply_rules(quality.statistics(docs, "doc_id"), rules).join(unseen, "doc_id")
    found = {(r.quality, r.kept): r["count"] for r in judged.groupBy("quality", "kept").count().collect()}
    caught = found.get((0, False), 0) / max(1, found.get((0, False), 0) + found.get((0, True), 0))
    lost = found.get((1, False), 0) / max(1, found.get((1, False), 0) + found.get((1, True), 0))
    print("quality rules on unseen labels: bad dropped", round(caught, 3), "good dropped", round(lost, 3), found)
    assert caught > 0.9 and lost < 0.06


def test_toxicity_on_the_held_out_fold(big):
    docs, labels = big
    rows = toxicity.score_toxicity(docs, labels).where("held_out").join(labels.where("toxic IS NOT NULL").select("doc_id", "toxic"), "doc_id").select("score", "predicted", "toxic").collect()
    ranked = sorted((r.score, r.toxic) for r in rows)
    positive = sum(t for _, t in ranked)
    place, i = 0.0, 0
    while i < len(ranked):  # equal scores share their middle rank
        j = i
        while j < len(ranked) and ranked[j][0] == ranked[i][0]:
            j += 1
        place += sum(t for _, t in ranked[i:j]) * (i + j + 1) / 2
        i = j
    auc = (place - positive * (positive + 1) / 2) / (positive * (len(ranked) - positive))
    hit = sum(r.predicted and r.toxic for r in rows)
    f1 = 2 * hit / max(1, sum(r.predicted for r in rows) + positive)
    print("toxicity on the held-out fold: AUC", round(auc, 4), "F1", round(f1, 4), "of", len(rows), positive)
    assert auc > 0.97 and f1 > 0.85


def test_recall_of_planted_secrets(big):
    docs, _ = big
    values = docs.select("doc_id", "text", F.explode(F.regexp_extract_all("text", F.lit('token = "([^"]+)"'), F.lit(1))).alias("value"))
    found = pii.find_personal_data(docs).select("doc_id", pii.marked(pii.KINDS).alias("all"))
    place = F.instr("text", F.col("value")) - 1
    planted = values.select("doc_id", "value", place.alias("at"), (place + F.length("value")).alias("until")).distinct()
    covered = planted.join(found, "doc_id", "left")
    inside = F.exists("all", lambda x: (x["s"] <= F.col("at")) & (x["e"] >= F.col("until")))
    n, hit = covered.agg(F.count("*"), F.count_if(F.coalesce(inside, F.lit(False)))).first()
    print("personal data: labelled secrets covered", hit, "of", n)
    assert n > 50 and hit / n > 0.9
