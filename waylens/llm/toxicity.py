"""Toxicity: gradient-boosted trees over dense features of a text, with isotonic calibration.

Three disjoint folds of the labelled rows (by CRC-32 of the id, modulo 4) do three jobs: fold 0 yields a lexicon of words
and stems that toxic texts use more, fold 1 trains the trees, fold 3 fits the calibration. Fold 2 is held out: its labels
are never read. Scores depend on the text alone.

Fitting takes at most ``fit_limit`` labelled rows (those with the smallest md5 of their id); features and scores cover
every whole text.
"""

from __future__ import annotations

import math
import re

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waylens.llm.common import map_texts, materialize

#: A small general lexicon of insults; the learned one adds what the labelled texts of other languages use.
INSULTS = frozenset(
    "idiot moron imbecile stupid dumb fool loser trash garbage scum filth vermin worthless pathetic disgusting clown creep coward liar freak "
    "dummkopf trottel abschaum arschloch versager crétin abruti connard ordure imbécile estúpido imbécil basura escoria perdedor payaso".split()
)
SECOND_PERSON = frozenset("you your yours yourself youre u ur du dich dir dein deine ihr euch tu te toi ton ta vous votre tú ti tus usted ustedes".split())
#: Signs that stand for letters in disguised words.
LEET = str.maketrans("0134578@$!|+", "oieastbasilt")
NEAR = 5
FEATURES = (
    "log_words", "insult_rate", "insult_count", "word_rate", "word_max", "stem_rate", "stem_max", "hits_near_you", "you_rate", "capital_rate", "shout_rate", "bang_rate", "punct_rate", "obfuscated_rate", "disguised_hits"
)
_EDGES = re.compile(r"^[^\w@$]+|[^\w@$]+$")
_DOUBLED = re.compile(r"(.)\1{2,}")


def plain(token: str) -> tuple[str, bool]:
    """The word behind a token and whether it was disguised: signs for letters, letters set apart or drawn out."""
    word = _EDGES.sub("", token.lower())
    if not word or word.isalpha() and not _DOUBLED.search(word):
        return word, False
    if not any(c.isalpha() for c in word):
        return word, False
    clear = _DOUBLED.sub(r"\1", re.sub(r"[^\w]|_", "", word.translate(LEET)))
    return clear, clear != word


def terms(word: str) -> list[str]:
    """A word and its stems of four and five letters, marked."""
    return [word, *(f"{word[:n]}-" for n in (4, 5) if len(word) > n)]


def _features(text: str, lexicon: dict[str, float], known: dict) -> tuple:
    tokens = text.split()
    n = len(tokens)
    if len(known) > 200_000:
        known.clear()
    hits, yous = [], []
    insults = words = stems = obfuscated = disguised = shouts = 0
    word_max = stem_max = 0.0
    for i, token in enumerate(tokens):
        found = known.get(token)
        if found is None:
            word, hidden = plain(token)
            stem = max((lexicon.get(t, 0.0) for t in terms(word)[1:]), default=0.0)
            shout = len(word) > 2 and token.isupper()
            found = known[token] = (word in INSULTS, lexicon.get(word, 0.0), stem, hidden, word in SECOND_PERSON, shout)
        insult, weight, stem, hidden, you, shout = found
        if insult or weight or stem:
            hits.append(i)
            insults += insult
            words += weight > 0
            stems += stem > 0
            disguised += hidden
            word_max, stem_max = max(word_max, weight), max(stem_max, stem)
        obfuscated += hidden
        shouts += shout
        if you:
            yous.append(i)
    near, j = 0, 0
    for i in hits:
        while j < len(yous) and yous[j] < i - NEAR:
            j += 1
        near += j < len(yous) and yous[j] <= i + NEAR
    letters = max(1, len(text) - text.count(" "))
    per = max(1, n)
    capitals = sum(map(str.isupper, text))
    marks = len(re.findall(r"[^\w\s]", text))
    return (
        math.log1p(n), insults / per, float(insults), words / per, word_max, stems / per, stem_max, near / max(1, len(hits)), len(yous) / per, capitals / letters,
        shouts / per, text.count("!") / per, marks / per, obfuscated / per, float(disguised),
    )


def features(docs: DataFrame, lexicon: dict[str, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and FEATURES of every row; ``lexicon`` has at most as many entries as ``learn_lexicon`` returns."""
    def make():
        known: dict = {}

        def work(texts: list) -> list:
            rows = [_features(t or "", lexicon, known) for t in texts]
            return [list(c) for c in zip(*rows, strict=True)]

        return work

    return map_texts(docs, make, ", ".join(f"{f} double" for f in FEATURES), id_col, text_col)


def learn_lexicon(texts: DataFrame, most: int = 1000, least_docs: int = 3, least_odds: float = 1.5) -> dict[str, float]:
    """Words and stems of ``doc_id, text, label`` with the log odds of standing in a toxic text; ``most`` at most."""
    def make():
        def work(rows: list) -> list:
            return [[sorted({t for token in set((text or "").split()) if len(word := plain(token)[0]) > 2 for t in terms(word)}) for text in rows]]

        return work

    labels = texts.select(F.col("doc_id").alias("__id"), "label").distinct()
    found = map_texts(texts, make, "terms array<string>")
    counted = found.join(F.broadcast(labels), F.col("doc_id") == F.col("__id"))
    sizes = counted.agg(F.sum("label").alias("t"), F.count("*").alias("n")).first()
    toxic, clean = sizes["t"] or 0, (sizes["n"] or 0) - (sizes["t"] or 0)
    if not toxic or not clean:
        return {}
    stats = counted.select("label", F.explode("terms").alias("term")).groupBy("term").agg(F.sum("label").alias("t"), F.count("*").alias("n")).where(F.col("t") >= least_docs)
    odds = F.log((F.col("t") + 0.5) / (toxic + 1)) - F.log((F.col("n") - F.col("t") + 0.5) / (clean + 1))
    best = stats.select("term", odds.alias("odds"), "t").where(F.col("odds") >= least_odds).orderBy(F.desc(F.col("odds") * F.col("t")), "term").limit(most)
    return {r["term"]: r["odds"] for r in best.collect()}


def fold(id_col) -> object:
    """CRC-32 of the id as text, modulo 4; null for a null id."""
    return F.crc32(id_col.cast("string").cast("binary")) % 4


def labelled_texts(docs: DataFrame, labels: DataFrame, label_col: str, fit_limit: int, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, text, label`` of the rows that fitting may read, at most ``fit_limit`` (their ids are broadcast); an id that
    is repeated has its smallest text."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & (fold(F.col(id_col)) != 2))
    known = known.groupBy(F.col(id_col).alias("__id")).agg((F.max(label_col) > 0).cast("int").alias("label"))
    sample = materialize(known.orderBy(F.md5(F.col("__id").cast("string")), "__id").limit(fit_limit), "toxicity-labels")
    own = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    own = own.join(F.broadcast(sample), F.col("doc_id") == F.col("__id")).groupBy("doc_id", "label").agg(F.min("text").alias("text"))  # one row an id, however often it's repeated
    return materialize(own.select("doc_id", "text", "label"), "toxicity-texts")


def score_toxicity(
    docs: DataFrame, labels: DataFrame, label_col: str = "toxic", threshold: float = 0.3, fit_limit: int = 24_000, rounds: int = 20, depth: int = 3, seed: int = 7, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row of ``docs``.

    Null and empty texts get the score of a text without words. Repeated rows are scored row by row, ids that are null are
    never held out and have no label, of repeated labels the largest counts. Without labels of both classes every score is
    the rate of class 1 in what can be read (0 with none); without them in the calibration fold the trees' probability
    stands. An empty table gives no rows. Other columns aren't read.
    """
    texts = labelled_texts(docs, labels, label_col, fit_limit, id_col, text_col)
    part = lambda *k: texts.where(fold(F.col("doc_id")).isin(*k))
    lexicon = learn_lexicon(part(0))
    rows = features(docs, lexicon, id_col, text_col)
    train = materialize(features(part(1, 3), lexicon).join(F.broadcast(texts.select(F.col("doc_id").alias("__id"), "label").distinct()), F.col("doc_id") == F.col("__id")).drop("__id"), "toxicity-features")
    counts = {(r["fold"], r["label"]): r["count"] for r in train.groupBy(fold(F.col("doc_id")).alias("fold"), "label").count().collect()}
    both = lambda k: counts.get((k, 0), 0) > 0 and counts.get((k, 1), 0) > 0
    held_out = F.coalesce(fold(F.col("doc_id")) == 2, F.lit(False))
    if not both(1):
        n = sum(counts.values())
        score = F.lit(sum(v for (_, label), v in counts.items() if label) / n if n else 0.0)
        scored = rows.select("doc_id", score.alias("score"))
    else:
        vector = VectorAssembler(inputCols=list(FEATURES), outputCol="__features")
        trees = GBTClassifier(labelCol="label", featuresCol="__features", maxIter=rounds, maxDepth=depth, stepSize=0.3, seed=seed, maxBins=64, minInstancesPerNode=3, predictionCol="__class")
        model = trees.fit(vector.transform(train.where(fold(F.col("doc_id")) == 1).coalesce(4)))
        raw = lambda df: model.transform(vector.transform(df)).withColumn("__score", vector_to_array("probability")[1]).drop("__features", "rawPrediction", "probability", "__class")
        scored = raw(rows)
        if both(3):
            calibration = raw(train.where(fold(F.col("doc_id")) == 3)).select(F.col("label").cast("double").alias("label"), "__score")
            isotonic = IsotonicRegression(labelCol="label", featuresCol="__score", predictionCol="__calibrated").fit(calibration)
            scored = isotonic.transform(scored).withColumn("__score", F.col("__calibrated"))
        scored = scored.select("doc_id", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("__score"))).alias("score"))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
