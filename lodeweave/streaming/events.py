"""Structured Streaming forms of the append-only and session operators (extensions beyond the batch originals).

Each takes and gives streaming DataFrames; run with availableNow they equal the batch operators.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def deduplicated(events: DataFrame, key: str = "event_id", at: str = "ts", delay: str = "2 days") -> DataFrame:
    """Redelivered events dropped while their watermark lasts."""
    return events.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


def status_fold(queue: DataFrame, key: str, order: str) -> DataFrame:
    """The latest status per key of an append-only queue, in update mode."""
    return queue.groupBy(key).agg(F.max_by("status", order).alias("status"))


def session_counts(events: DataFrame, user: str = "user_id", at: str = "ts", gap: str = "1 day", delay: str = "2 days") -> DataFrame:
    """(user, start, end, n): sessions that end after a gap without events."""
    g = events.withWatermark(at, delay).groupBy(user, F.session_window(at, gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return g.select(user, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def windowed_counts(events: DataFrame, by: str = "event_type", at: str = "ts", width: str = "1 day", delay: str = "2 days") -> DataFrame:
    """(by, start, n, total): tumbling windows, late rows within the delay included."""
    g = events.withWatermark(at, delay).groupBy(by, F.window(at, width).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total"))
    return g.select(by, F.col("w.start").alias("start"), "n", "total")


def breaker_stream(calls: DataFrame, key: str, threshold: int = 3) -> DataFrame:
    """(key, n_calls, streak, open) of calls(key, n, failed) after each batch: consecutive failures kept as state per key."""

    def update(k: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, streak = state.get if state.exists else (0, 0)
        for pdf in pdfs:
            for failed in pdf.sort_values("n")["failed"]:
                n, streak = n + 1, streak + 1 if failed else 0
        state.update((n, streak))
        yield pd.DataFrame({"key": [str(k[0])], "n_calls": [n], "streak": [streak], "open": [streak >= threshold]})

    return calls.groupBy(key).applyInPandasWithState(update, "key string, n_calls long, streak long, open boolean", "n long, streak long", "update", GroupStateTimeout.NoTimeout)


def run_available(stream: DataFrame, folder: str, mode: str = "append", key: str | None = None) -> DataFrame:
    """Process what is there and return the result as a table of files under ``folder``, beside the stream's state.

    Each batch is written to its own part of the folder, so a repeated batch replaces itself. Of complete results
    the last batch counts; of updates the last row of each ``key``; appended rows all count."""
    spark = stream.sparkSession

    def write(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={n}")

    stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    out = spark.read.option("basePath", f"{folder}/out").parquet(f"{folder}/out")
    if mode == "complete":
        out = out.filter(F.col("batch") == out.agg(F.max("batch")).scalar())
    elif mode == "update":
        rest = [c for c in out.columns if c not in (key, "batch")]
        out = out.groupBy(key).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(key, *(F.col(f"r.{c}").alias(c) for c in rest))
    return out.drop("batch")


def ingest(stream: DataFrame, root: str, work, key: str, run: str = "run") -> None:
    """Process what is there, each key once over all runs: a batch leaves out the keys that an earlier run finished, writes its
    results with their status, and the stream's state tells which files are done, so a run that died goes on where it was.

    work: DataFrame -> DataFrame with ``key`` and status ('done', or anything else to be tried again by a new run). How much is
    worked on at once is bounded by the source's maxFilesPerTrigger and the session's cores; each batch has its own folder and replaces itself."""
    spark = stream.sparkSession

    def write(batch: DataFrame, n: int) -> None:
        have = _results(spark, root)
        here = f"{run}-{n}"
        if have is not None:
            batch = batch.join(have.filter((F.col("status") == "done") & (F.col("batch") != here)).select(key), key, "left_anti")
        work(batch).write.mode("overwrite").parquet(f"{root}/results/batch={here}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{root}/state-{run}").trigger(availableNow=True).start().awaitTermination()


def _results(spark, root: str) -> DataFrame | None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/results")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return None
    return spark.read.option("basePath", f"{root}/results").parquet(f"{root}/results")


def ingested(spark, root: str, key: str) -> DataFrame:
    """The result of each key: that of its done row, else of its latest try."""
    have = _results(spark, root)
    rest = [c for c in have.columns if c not in (key, "batch")]
    best = F.struct((F.col("status") == "done").alias("ok"), "batch")
    return have.groupBy(key).agg(F.max_by(F.struct(*rest), best).alias("r")).select(key, *(F.col(f"r.{c}").alias(c) for c in rest))
