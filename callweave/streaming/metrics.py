"""Structured Streaming jobs over the analysis history.

Sources are file streams (new parquet / source files as they land); state is
kept by Spark's state store under a checkpoint folder on shared storage, so a
restarted query resumes where it stopped. Event time comes from
``timestamp``; a watermark bounds the state and drops rows that arrive later
than it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callweave.operators import history as H
from callweave.session import scratch_path


def file_stream(spark: SparkSession, folder: str, file_glob: str, schema,
                max_files_per_trigger: int | None = None, fmt: str = "parquet") -> DataFrame:
    reader = spark.readStream.schema(schema).format(fmt).option("pathGlobFilter", file_glob)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.load(folder)


def windowed_metrics(analyses: DataFrame, window: str = "1 day", watermark: str = "1 hour") -> DataFrame:
    """Per tumbling window: analyses, mean confidence, success rate (confidence > 0)."""
    w = (analyses.withWatermark("timestamp", watermark)
         .groupBy(F.window("timestamp", window))
         .agg(F.count(F.lit(1)).alias("analyses"),
              F.sum("confidence_score").alias("sum_confidence"),
              F.count_if(F.col("confidence_score") > 0).alias("successes")))
    return w.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
                    "analyses", "sum_confidence", "successes",
                    (F.col("sum_confidence") / F.col("analyses")).alias("mean_confidence"),
                    (F.col("successes") / F.col("analyses")).alias("success_rate"))


def sliding_trend(analyses: DataFrame, length: str = "7 days", slide: str = "1 day",
                  watermark: str = "1 hour") -> DataFrame:
    """Sliding-window trend per service pair."""
    w = (analyses.withWatermark("timestamp", watermark)
         .groupBy(F.window("timestamp", length, slide), H.service_key().alias("services"))
         .agg(F.count(F.lit(1)).alias("analyses"), F.sum("confidence_score").alias("sum_confidence")))
    return w.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
                    "services", "analyses", "sum_confidence",
                    (F.col("sum_confidence") / F.col("analyses")).alias("mean_confidence"))


def run_append(df: DataFrame, name: str, checkpoint: str | None = None, sink: str | None = None) -> str:
    """Run a streaming aggregate in append mode over all data available now; returns the sink folder."""
    spark = df.sparkSession
    sink = sink or scratch_path(spark, f"{name}-out")
    checkpoint = checkpoint or scratch_path(spark, f"{name}-state")
    q = (df.writeStream.outputMode("append").format("parquet").option("path", sink)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    return sink


def history_ingest(analyses: DataFrame, table_path: str, rejects_path: str, usage_path: str,
                   checkpoint: str | None = None):
    """T3 + A12: validate each micro-batch, append valid rows to the history table and
    rejects to a side table; keep a running service-usage snapshot (complete mode)."""
    spark = analyses.sparkSession
    checkpoint = checkpoint or scratch_path(spark, "history-ingest")

    def write_batch(batch: DataFrame, batch_id: int):
        checked = H.validate(batch)
        # idempotent per batch id: a retried batch overwrites its own folder
        (checked.where(F.col("reject_reason").isNull()).drop("reject_reason")
         .write.mode("overwrite").parquet(f"{table_path}/batch={batch_id}"))
        (checked.where(F.col("reject_reason").isNotNull())
         .write.mode("overwrite").parquet(f"{rejects_path}/batch={batch_id}"))

    valid = H.validate(analyses).where(F.col("reject_reason").isNull())
    usage = valid.groupBy(H.service_key().alias("services")).agg(F.count(F.lit(1)).alias("analyses"))

    def write_usage(batch: DataFrame, batch_id: int):
        batch.write.mode("overwrite").parquet(usage_path)

    q1 = (analyses.writeStream.foreachBatch(write_batch)
          .option("checkpointLocation", checkpoint + "/append").trigger(availableNow=True).start())
    q2 = (usage.writeStream.outputMode("complete").foreachBatch(write_usage)
          .option("checkpointLocation", checkpoint + "/usage").trigger(availableNow=True).start())
    q1.awaitTermination()
    q2.awaitTermination()
