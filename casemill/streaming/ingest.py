"""Incremental ingestion with Structured Streaming: files once each, rows once per key, latest state per key."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casemill.scratch import fresh
from casemill.streaming.highlights import lifecycle


def ingest_once(spark: SparkSession, stream: DataFrame, target: str, checkpoint: str, key: str) -> None:
    """Append the stream's rows whose key has not come before; run again with its checkpoint, it takes up what is new.

    Spark's state holds the keys in the checkpoint, so a batch reads its own rows only, however much is there already.
    Every batch is written to a folder of its own by overwriting, so a batch that is replayed after a failure
    replaces itself.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    query = stream.dropDuplicates([key]).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def ingest_recent(stream: DataFrame, target: str, checkpoint: str, key: str, event_time: str, delay: str = "1 hour") -> list[dict]:
    """Append rows at most once a key with bounded state; returns what Spark reports of each batch.

    A row is late, and dropped, if its time is not after the watermark: the latest time of earlier batches less
    ``delay``. A key is remembered until the watermark passes its row's time by ``delay``, so state holds the keys of that span
    and no more, and a repetition within it is dropped. Rows without a time are late. Batches overwrite their own
    folder, so a replay changes nothing.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    once = stream.where(F.col(event_time).isNotNull()).withWatermark(event_time, delay).dropDuplicatesWithinWatermark([key])
    query = once.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return [progress if isinstance(progress, dict) else json.loads(progress.json) for progress in query.recentProgress]


def recent_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table through :func:`ingest_recent` as one batch, with a span that covers it."""
    base = fresh(spark, "recent")
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/event[s].parquet")
    rows = stream.select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    ingest_recent(rows, f"{base}/events", f"{base}/checkpoint", "event_id", "ts", "1 day")
    return spark.read.schema(rows.schema).parquet(f"{base}/events/batch=*").select("event_id", "user_id", "event_type")


def run_lifecycle(events: DataFrame, folder: str, limit: str = "10 minutes", delay: str = "5 minutes") -> None:
    """Run :func:`casemill.streaming.highlights.lifecycle` over what is there; run again, it takes up what is new.

    Changes are appended to a log, a batch overwriting its own folder.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/log/batch={batch_id}")

    query = lifecycle(events, limit, delay).writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()


def latest_highlights(spark: SparkSession, folder: str) -> DataFrame:
    """The last version of every highlight in the log."""
    log = spark.read.option("basePath", f"{folder}/log").parquet(f"{folder}/log/batch=*")
    return log.groupBy("highlight_id").agg(F.max_by(F.struct("user_id", "sent_at", "summarization", "summarized_at"), "version").alias("s")).select("highlight_id", "s.*")


def event_highlights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a highlight: purchases are answered in three minutes, errors fail in one, views are answered too late, and others never."""
    folder = fresh(spark, "lifecycle")
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/event[s].parquet")
    stream = stream.withColumn("ts", F.col("ts").cast("timestamp"))
    user = F.col("user_id").cast("string").alias("user_id")
    sent = F.struct(F.lit("sent").alias("kind"), F.lit(None).cast("string").alias("text"), F.col("ts").alias("ts"))
    minutes = F.expr("CASE event_type WHEN 'purchase' THEN 3 WHEN 'error' THEN 1 WHEN 'view' THEN 30 END")
    kind = F.when(F.col("event_type") == "error", "failed").otherwise("summary")
    answer = F.struct(kind.alias("kind"), F.concat(F.col("event_type"), F.lit(" of "), F.col("event_id").cast("string")).alias("text"), (F.col("ts") + F.make_dt_interval(mins=minutes)).alias("ts"))
    events = stream.select(F.col("event_id").cast("string").alias("highlight_id"), user, F.explode(F.array(answer, sent, sent)).alias("e")).select("highlight_id", "user_id", "e.*")
    run_lifecycle(events, folder)
    return latest_highlights(spark, folder).select(F.col("highlight_id").cast("long").alias("highlight_id"), "summarization", (F.unix_millis("summarized_at") - F.unix_millis("sent_at")).alias("after_ms"))


def ingest_events(spark: SparkSession, sf_dir: str, target: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """The events table as a bounded stream into a deduplicated table; returns what the table holds."""
    base = fresh(spark, "stream")
    target, checkpoint = target or f"{base}/events", checkpoint or f"{base}/checkpoint"
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/event[s].parquet")  # a glob, so that one file will do as well
    ingest_once(spark, stream, target, checkpoint, "event_id")
    return spark.read.schema(schema).parquet(f"{target}/batch=*").select("event_id", "user_id", "event_type")


def upsert_highlights(spark: SparkSession, sf_dir: str, buckets: int = 16) -> DataFrame:
    """Every event as a highlight that is inserted without a summary and then updated; returns the latest state of each.

    The stream appends both versions to a log that is partitioned by a hash of the key, a batch overwriting its own
    folder; the state is the last version of each key, so a replayed batch changes nothing.
    """
    base = fresh(spark, "highlights")
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/event[s].parquet")

    def write(batch: DataFrame, batch_id: int) -> None:
        failed = F.col("event_type") == "error"
        inserted = batch.select("user_id", "event_id", F.lit(0).alias("version"), F.lit(None).cast("string").alias("summarization"), F.lit(False).alias("summarized"))
        updated = batch.select("user_id", "event_id", F.lit(1).alias("version"), F.when(failed, "Error: failed").otherwise(F.col("event_type")).alias("summarization"), (~failed).alias("summarized"))
        both = inserted.unionByName(updated).withColumn("bucket", F.pmod(F.xxhash64("event_id"), F.lit(buckets)))
        both.write.mode("overwrite").partitionBy("bucket").parquet(f"{base}/log/batch={batch_id}")

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    log = spark.read.option("basePath", f"{base}/log").parquet(f"{base}/log/batch=*")
    return log.groupBy("user_id", "event_id").agg(F.max_by(F.struct("summarization", "summarized"), "version").alias("s")).select("user_id", "event_id", "s.*")
