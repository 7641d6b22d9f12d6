"""The corpus pipeline: quality rules, near duplicates, personal data, source mixing, SentencePiece ids.

Each stage takes the documents its predecessor kept and returns documents again (the last one returns ids). A row is known
by its id and the hash of its text, so rows that repeat an id with another text keep their own verdicts, and rows that
repeat both share one. Null texts and ids are values like others, further columns of any name are carried along, and an
empty table passes through every stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waylens.llm import jaccard, mixing, pieces, pii, quality
from waylens.llm.common import materialize, table
from waylens.llm.queries import piece_model

#: No SQL has the learned rules, the cues and the lattice; tests hold the stages against brute force.
ORACLE_SQL = None
KEY, BOX = "key", "box"
#: Verdicts of so many rows, or spans, at most (some 50 to 150 bytes each) are broadcast to the documents; more are joined by
#: key.
BROADCAST_ROWS = 400_000


def _name(column: str) -> Column:
    return F.col("`" + column.replace("`", "``") + "`")


def _boxed(docs: DataFrame, *more: str) -> DataFrame:
    """``key, text, box`` and ``more``: the whole row in one struct, so its columns' names meet no other. The key is the id
    and the hash of the text, and the columns ``more`` if there are any."""
    key = F.struct(F.col("doc_id").alias("i"), F.xxhash64("text").alias("h"), *[F.col(c) for c in more])
    return docs.select(key.alias(KEY), "text", *more, F.struct(*[_name(c).alias(c) for c in docs.columns]).alias(BOX))


def _unboxed(rows: DataFrame, docs: DataFrame, **changed: Column) -> DataFrame:
    return rows.select(*[changed.get(c, F.col(BOX).getField(c)).alias(c) for c in docs.columns])


def _verdicts(rows: DataFrame, name: str, size: Column | None = None) -> DataFrame:
    """Verdicts by key, written once, and broadcast if few; ``size`` is what a row counts where its width has no bound."""
    rows = materialize(rows, name)
    if size is not None:
        few = (rows.agg(F.sum(size)).first()[0] or 0) <= BROADCAST_ROWS
        return F.broadcast(rows) if few else rows.hint("merge")
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or a learned rule go. Null and empty texts have no words, so they go; rows that
    repeat a text share its verdict."""
    rules = quality.learn_rules(quality.labelled_statistics(docs, table(spark, sf_dir, "labels"), "quality", 20_000, "doc_id", "text"))
    judged = quality.apply_rules(quality.statistics(_boxed(docs), BOX), rules).where("kept")
    return _unboxed(judged.select(F.col("doc_id").alias(BOX)), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked documents stays, the one with the smallest id (a null id before all others, equal ids
    by the text's hash); of rows that repeat it, one. Null and empty texts link with nothing and stay, one a key."""
    rows = _boxed(docs)
    classes = materialize(jaccard.similar_components(rows, id_col=KEY), "classes")
    kept = classes.where("doc_id = component_id").groupBy(F.col("doc_id").alias(KEY)).agg(F.count("*").alias("n"))
    kept = materialize(kept, "class-heads")
    rows = rows.join(_verdicts(kept.select(KEY), "kept"), KEY, "left_semi")
    if not kept.where("n > 1").isEmpty():
        rows = rows.dropDuplicates([KEY])
    return _unboxed(rows, docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data become their kind in angle brackets; ``n_chars`` follows the text. Of spans that overlap the
    first names the kind. Null and empty texts stay as they are; all rows stay."""
    rows = _boxed(docs)
    found = pii.find_personal_data(rows, id_col=KEY)
    spans = found.select(F.col("doc_id").alias(KEY), pii.marked(pii.KINDS).alias("spans")).where(F.size("spans") > 0).dropDuplicates([KEY])
    rows = rows.join(_verdicts(spans, "spans", F.size("spans")), KEY, "left")
    rows = rows.withColumn("text", F.when(F.col("spans").isNull(), F.col("text")).otherwise(pii.redacted(F.col("text"), F.col("spans"))))
    changed = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return _unboxed(rows, docs, **changed)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: complete epochs, and once more if it was picked. Texts without words have
    no size and are never taken. Rows that repeat id, text and source each have a count, dealt in the order of the rows'
    hashes."""
    rows = _boxed(docs, "source")
    mixed = mixing.mix_sources(rows, id_col=KEY)
    times = mixed.select(F.col("doc_id").alias(KEY), F.when(F.col("size") > 0, F.col("epochs") + F.col("picked")).otherwise(F.lit(0)).alias("times"))
    times = materialize(times, "times")
    if times.select(KEY).distinct().count() < times.count():
        turn = Window.partitionBy(KEY)
        hashed = F.xxhash64(*[F.col(BOX).getField(f.name) for f in docs.schema.fields if "map<" not in f.dataType.simpleString()])
        times = times.withColumn("turn", F.row_number().over(turn.orderBy("times")))
        rows = rows.withColumn("turn", F.row_number().over(turn.orderBy(hashed))).join(_verdicts(times.where("times > 0"), "taken"), [KEY, "turn"])
    else:
        rows = rows.join(_verdicts(times.where("times > 0"), "taken"), KEY)
    return _unboxed(rows.select(BOX, F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))), docs)


def sentencepiece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each text, decoded again and compared; a null text has none, an empty one an empty array."""
    return pieces.encode_documents(docs, piece_model())


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("PII", personal_data),
    ("mixing sources to target weights", source_mix),
    ("SentencePiece encoding and decoding", sentencepiece_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``, each written as Parquet and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, f"stage-{i}")
    return docs
