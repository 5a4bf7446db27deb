from __future__ import annotations

from lexcheck.sources import settings, wordlists
from lexcheck.streaming import check

CONFIG = settings.build(settings.DEFAULTS)


def test_stream_of_texts(spark, tmp_path):
    source = tmp_path / "in"
    spark.createDataFrame([(1, "hello wurld"), (2, "hello abc123de secret")], "id long, text string").write.parquet(str(source))
    words = spark.createDataFrame([("english", "hello")], wordlists.SCHEMA)
    texts = spark.readStream.schema("id long, text string").parquet(str(source))
    seen = []
    started = check.start_check(texts, words, CONFIG, "id", "text", lambda df, n: seen.extend(r["norm"] for r in df.collect()), str(tmp_path / "state"))
    started.awaitTermination(120)
    assert {"wurld", "secret"} <= set(seen) and "hello" not in seen


def test_counts_by_window(spark, tmp_path):
    source = tmp_path / "in"
    rows = spark.sql("SELECT 1L AS id, 'hello wurld' AS text, timestamp'2024-01-01 00:10:00' AS ts UNION ALL SELECT 2L, 'a1b2c3 wurld helo', timestamp'2024-01-01 05:10:00'")
    rows.write.parquet(str(source))
    words = spark.createDataFrame([("english", "hello")], wordlists.SCHEMA)
    texts = spark.readStream.schema(rows.schema).parquet(str(source))
    made = check.windowed_counts(texts, words, CONFIG, "id", "text", "ts")
    started = made.writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    started.awaitTermination(120)
    got = {r["window"]["start"].hour: r["errors"] for r in spark.table("windows").collect()}
    assert sorted(got.values()) == [1, 2]
