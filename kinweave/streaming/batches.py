"""Streams of event batches, each linked as it arrives."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kinweave.plans.linkage import predict
from kinweave.sources.files import EVENT, Config


def file_stream(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(EVENT).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def kafka_stream(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """Events as JSON values; the message key is the batch id."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).load()
    return raw.select(F.col("key").cast("string").alias("batch_id"), F.from_json(F.col("value").cast("string"), EVENT).alias("e")).select("batch_id", "e.*")


def link_stream(stream: DataFrame, model: PipelineModel, config: Config, out: str, checkpoint: str) -> StreamingQuery:
    """Write each batch's entities below out/batch_id=N; a batch that is run again overwrites itself."""

    def one(batch: DataFrame, number: int) -> None:
        auto, review = predict(batch, model, config)
        auto.write.mode("overwrite").parquet(f"{out}/auto/batch_id={number}")
        review.write.mode("overwrite").parquet(f"{out}/review/batch_id={number}")

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def weekday_counts(stream: DataFrame, late: str = "1 hour", window: str = "1 day") -> DataFrame:
    """Events by window and weekday, final once the watermark has passed."""
    return stream.withWatermark("created_at", late).groupBy(F.window("created_at", window), F.weekday("created_at").alias("weekday")).agg(F.count("*").alias("n"))
