"""Pages arriving in a landing folder: each micro-batch is compared with the state of its urls and appended to a change log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.functions.text import normalize
from quillon.operators.frontier import canonical
from quillon.operators.tables import change_type

PAGES = "page_id long, url string, html string"
LOG = "batch long, url string, change string, raw string, content string"


def arriving(spark: SparkSession, folder: str, schema: str = PAGES) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 64).parquet(folder)


def compared(pages: DataFrame, log: DataFrame, batch: int) -> DataFrame:
    """What a batch of pages adds to the log: a row for each url, with how its page changed since the last row."""
    hashed = pages.select(
        canonical(F.col("url")).alias("url"), F.sha2(F.encode("html", "UTF-8"), 256).alias("raw"),
        F.sha2(F.encode(normalize(F.regexp_replace("html", "<[^>]*>", " ")), "UTF-8"), 256).alias("content"), "page_id",
    )
    latest = hashed.where("url is not null").withColumn("r", F.row_number().over(Window.partitionBy("url").orderBy(F.desc("page_id")))).where("r = 1").drop("r", "page_id")
    state = log.groupBy("url").agg(F.max_by(F.struct(F.col("raw").alias("old_raw"), F.col("content").alias("old_content")), "batch").alias("s")).select("url", "s.*")
    change = change_type(F.col("old_raw").isNotNull(), F.col("raw") == F.col("old_raw"), F.col("content") == F.col("old_content"), F.lit(False))
    return latest.join(state, "url", "left").select(F.lit(batch).cast("long").alias("batch"), "url", change.alias("change"), "raw", "content")


def follow(spark: SparkSession, landing: str, log: str, checkpoint: str):
    """Runs over all that has arrived, then stops. A batch that is run again after a failure writes the same folder again."""

    def apply(pages: DataFrame, batch: int) -> None:
        before = spark.read.schema(LOG).parquet(log).where(F.col("batch") < batch) if _exists(spark, log) else spark.createDataFrame([], LOG)
        compared(pages, before, batch).drop("batch").write.mode("overwrite").parquet(f"{log}/batch={batch}")

    return arriving(spark, landing).writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def latencies(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts and means in event-time windows; works on streams and on tables."""
    at = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return at.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean")).select(F.col("w.start").alias("start"), "event_type", "n", "mean")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Runs of a user's events without a pause of `gap`."""
    at = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return at.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n")
