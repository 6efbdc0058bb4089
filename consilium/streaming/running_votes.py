"""Running votes over a stream of answers (an extension: batch votes, kept current)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def running_votes(answers: DataFrame, late: str = "1 hour") -> DataFrame:
    """(window, key, item, votes) of a stream (ts, key, sample, item): each sample counts once, late ones up to ``late``."""
    once = answers.withWatermark("ts", late).dropDuplicatesWithinWatermark(["key", "sample", "item"])
    return once.groupBy(F.window("ts", "1 day"), "key", "item").agg(F.count(F.lit(1)).alias("votes"))


def finished_tasks(responses: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write each micro-batch of responses once, replacing a replayed batch, so a run resumes where it stopped."""

    def put(batch: DataFrame, number: int) -> None:
        batch.dropDuplicates(["task_id"]).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return responses.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
