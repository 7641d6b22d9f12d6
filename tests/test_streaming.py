"""The streaming forms against their batch forms."""

from pyspark.sql import functions as F

from waylens.streaming import sessions


def test_sessions_and_rollup(spark, tmp_path):
    rows = [(i, 1, (1000 + i * 600 + (10_000 if i > 4 else 0)) * 10**9, f"https://h{i % 2}.example/", "History") for i in range(8)] + [(99, 1, 10**15, "https://h.example/", "History")]
    schema = "seq bigint, profile bigint, timestamp_ns bigint, url string, artifact string"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    for name, df in (("s", sessions.streaming_sessions(stream)), ("h", sessions.streaming_host_rollup(stream, F.col("url"))), ("d", sessions.streaming_deduplicated(stream))):
        df.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"cp-{name}")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.events for r in spark.table("s").collect()) == [3, 5]
    assert sum(r.events for r in spark.table("h").collect()) == 8
    assert spark.table("d").count() == 9
