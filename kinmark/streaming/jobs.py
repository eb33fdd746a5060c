"""Streaming forms of the service's queries: quota, rate limit, status, and the analysis job."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.service import MAX_ERROR
from ..operators.similarity import unified_report
from ..storage import stored


def quota_stream(events: DataFrame, late: str = "1 day", key: str = "user_id", ts: str = "ts", limit: int = 5) -> DataFrame:
    """Counts a user and UTC day as they come; state is dropped once the watermark has passed a day."""
    out = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).groupBy(F.window(ts, "1 day").alias("w"), key).agg(F.count("*").alias("n"))
    return out.select(key, F.to_date("w.start").alias("day"), "n", (F.col("n") >= limit).alias("blocked"))


def rate_stream(events: DataFrame, late: str = "5 minutes", key: str = "user_id", ts: str = "ts", limit: int = 20) -> DataFrame:
    out = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).groupBy(F.window(ts, "1 minute").alias("w"), key).agg(F.count("*").alias("n"))
    return out.select(key, F.col("w.start").alias("start"), "n", (F.col("n") > limit).alias("over"))


def once(events: DataFrame, id_col: str, ts: str = "ts", late: str = "1 day") -> DataFrame:
    """Each id once, however often it is delivered; ids are forgotten after the watermark."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).dropDuplicatesWithinWatermark([id_col])


def analysis_job(submissions: DataFrame, out_path: str, checkpoint: str):
    """Starts the job that writes a report for each arriving submission (pair_id, mode, text_a, text_b), and its states.

    Reports go to out_path, (submission_id, status, error_message, ts) to out_path-status: processing when a batch begins,
    completed or failed when its reports are written. The time of a report is that of its batch. A batch that is retried
    writes its own folders again, so each batch counts once; a submission that is delivered twice in a batch counts once.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        began = time.time()
        batch = batch.dropDuplicates(["pair_id"])
        ids = batch.select(F.col("pair_id").alias("submission_id"), F.lit("processing").alias("status"), F.lit(None).cast("string").alias("error_message"), F.current_timestamp().alias("ts"))
        ids.write.mode("overwrite").parquet(f"{out_path}-status/batch={batch_id}/state=begun")
        report = stored(unified_report(batch))
        spent = int(1000 * (time.time() - began))
        report.withColumns({"processing_time_ms": F.lit(spent), "algorithm_version": F.lit("1.0.0"), "created_at": F.current_timestamp()}).write.mode("overwrite").parquet(f"{out_path}/batch={batch_id}")
        error = F.substring("error", 1, MAX_ERROR)
        ended = report.select(F.col("pair_id").alias("submission_id"), F.when(F.col("error").isNull(), "completed").otherwise("failed").alias("status"), error.alias("error_message"), F.current_timestamp().alias("ts"))
        ended.write.mode("overwrite").parquet(f"{out_path}-status/batch={batch_id}/state=ended")

    return submissions.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def file_submissions(pairs: DataFrame, files: DataFrame) -> DataFrame:
    """(pair_id, mode, text_a, text_b) of pairs (pair_id, mode, path_a, path_b), with texts from files (path, text).

    A path that stands twice in files, as that of a file that was uploaded twice, counts once.
    """
    out, files = pairs, files.dropDuplicates(["path"])
    for x in "ab":
        out = out.join(files.select(F.col("path").alias(f"path_{x}"), F.col("text").alias(f"text_{x}")), f"path_{x}", "left")
    return out.select("pair_id", "mode", "text_a", "text_b")
