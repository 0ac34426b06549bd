from pyspark.sql import functions as F

from quillon.sources import robots
from quillon.streaming import ingest


def page(spark, folder, name, rows):
    spark.createDataFrame(rows, ingest.PAGES).coalesce(1).write.parquet(f"{folder}/{name}")


def test_rounds_of_pages(spark, tmp_path):
    landing, log, state = (str(tmp_path / x) for x in ("landing/*", "log", "state"))
    folder = str(tmp_path / "landing")
    page(spark, folder, "one", [(1, "https://x.com/a?utm_source=1", "<p>Hello</p>"), (2, "https://x.com/b", "<p>B</p>"), (3, "mailto:x", "")])
    ingest.follow(spark, landing, log, state).awaitTermination()
    page(spark, folder, "two", [(4, "https://x.com/a", "<p>Hello</p>"), (5, "https://x.com/b", "<div>b</div>"), (6, "https://x.com/c", "<p>C</p>")])
    ingest.follow(spark, landing, log, state).awaitTermination()
    page(spark, folder, "three", [(7, "https://x.com/b", "<div>other</div>")])
    ingest.follow(spark, landing, log, state).awaitTermination()
    rows = spark.read.parquet(log).orderBy("batch", "url").collect()
    assert [(r.batch, r.url[-1], r.change) for r in rows] == [(0, "a", "new"), (0, "b", "new"), (1, "a", "unchanged_bytes"), (1, "b", "unchanged_content"), (1, "c", "new"), (2, "b", "changed")]


def test_windows_on_a_stream(spark, tmp_path):
    rows = [(f"2024-01-01 00:{m:02d}:00", "click", 1, float(m)) for m in range(0, 60, 10)]
    events = spark.createDataFrame(rows, "ts string, event_type string, user_id int, value double").withColumn("ts", F.to_timestamp("ts"))
    events.write.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "events"))
    query = ingest.latencies(stream).writeStream.format("memory").queryName("latencies").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert [(r.n, r["mean"]) for r in spark.table("latencies").collect()] == [(6, 25.0)]
    assert [r.n for r in ingest.sessions(events).collect()] == [6]


def test_fetcher_is_called_once_a_url(spark):
    urls = spark.createDataFrame([("https://a.com",), ("https://b.com",)], "url string")

    def fetch(url):
        if "b" in url:
            raise OSError("down")
        return 200, "<p>ok</p>"

    assert {r.url: r.status for r in robots.fetched(urls, fetch).collect()} == {"https://a.com": 200, "https://b.com": 0}
