"""The file watcher as a stream: changed paths gathered for a debounce time, one batch of distinct paths each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

DEBOUNCE_MS = 200


def watch_directory(spark: SparkSession, path: str, on_change: Callable[[list[str]], None], checkpoint: str, debounce_ms: int = DEBOUNCE_MS, max_paths: int = 10_000) -> StreamingQuery:
    """Start a stream over the files of ``path``; each non-empty trigger calls ``on_change`` with its sorted distinct paths.

    A trigger's paths reach the driver in blocks of ``max_paths``, so a burst is several calls.
    """
    files = spark.readStream.format("text").option("wholetext", "true").option("recursiveFileLookup", "true").load(path)
    changed = files.select(F.regexp_replace(F.input_file_name(), "^file:(//)?", "").alias("path"))

    def flush(batch: DataFrame, _: int) -> None:
        block: list[str] = []
        for r in batch.distinct().orderBy("path").toLocalIterator():
            block.append(r[0])
            if len(block) == max_paths:
                on_change(block)
                block = []
        if block:
            on_change(block)

    return changed.writeStream.foreachBatch(flush).option("checkpointLocation", checkpoint).trigger(processingTime=f"{debounce_ms} milliseconds").start()


def snapshot(spark: SparkSession, path: str) -> DataFrame:
    """path, mtime, n_bytes of the files below ``path``; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreMissingFiles", "true").load(path)
    return files.select(F.regexp_replace("path", "^file:", "").alias("path"), F.col("modificationTime").alias("mtime"), F.col("length").alias("n_bytes"))


def changes(before: DataFrame, now: DataFrame) -> DataFrame:
    """path, change (added, modified, removed) between two snapshots (path, mtime, n_bytes)."""
    stamp = lambda df, name: df.groupBy("path").agg(F.max(F.struct("mtime", "n_bytes")).alias(name))
    both = stamp(before, "was").join(stamp(now, "now"), "path", "full_outer")
    kind = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("was") != F.col("now"), "modified")
    return both.select("path", kind.alias("change")).where("change is not null")


def poll_directory(spark: SparkSession, path: str, state: str, on_change: Callable[[list[tuple[str, str]]], None], checkpoint: str, every_ms: int = 1000, max_paths: int = 10_000) -> StreamingQuery:
    """Like ``watch_directory`` for changed and removed files too: each trigger compares the tree with its last snapshot.

    Snapshots are tables below ``state``, one a trigger and named by it, so that a repeated trigger compares with the same one.
    The first trigger only takes a snapshot. Changes reach the driver in blocks.
    """
    clock = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).option("numPartitions", 1).load()

    def look(_: DataFrame, k: int) -> None:
        snapshot(spark, path).write.mode("overwrite").parquet(f"{state}/s{k}")
        if k == 0:
            return
        was, now = (spark.read.parquet(f"{state}/s{i}") for i in (k - 1, k))
        block: list[tuple[str, str]] = []
        for r in changes(was, now).orderBy("path").toLocalIterator():
            block.append((r[0], r[1]))
            if len(block) == max_paths:
                on_change(block)
                block = []
        if block:
            on_change(block)

    return clock.writeStream.foreachBatch(look).option("checkpointLocation", checkpoint).trigger(processingTime=f"{every_ms} milliseconds").start()


def change_batches(events: DataFrame, debounce: str = "200 milliseconds", time: str = "ts", path: str = "path") -> DataFrame:
    """window_start, n_paths, paths (sorted, joined by ', '): the batch form, and the streaming form under a watermark."""
    rows = events.select(F.window(time, debounce).alias("w"), F.col(path).alias("path")).where("path is not null")
    return rows.groupBy("w").agg(F.array_sort(F.collect_set("path")).alias("p")).select(F.col("w.start").alias("window_start"), F.size("p").alias("n_paths"), F.array_join("p", ", ").alias("paths"))


def streamed_batches(events: DataFrame, debounce: str = "200 milliseconds", late: str = "1 minute", time: str = "ts", path: str = "path") -> DataFrame:
    """``change_batches`` of a stream: late events up to ``late`` still join their window."""
    return change_batches(events.withWatermark(time, late), debounce, time, path)
