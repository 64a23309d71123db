"""Structured Streaming jobs over tables that keep arriving as files.

Each job reads a folder as a stream, runs until nothing new is left, and writes its result and its progress to the
shared folder, so that a restart or a lost executor goes on where it was.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from diffloom.session import shared_dir


def arriving(spark: SparkSession, path: str) -> DataFrame:
    """The parquet table at ``path`` as a stream; its schema is that of the files already there.

    The path is given as a pattern, since a stream takes a folder or a pattern but not a single file.
    """
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]")


def _finished(stream: DataFrame, mode: str, name: str) -> DataFrame:
    """Run a stream to its end and read back what it wrote."""
    spark = stream.sparkSession
    out, progress = (f"{shared_dir(spark)}/{name}-{kind}-{uuid.uuid4().hex}" for kind in ("out", "progress"))
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", progress).trigger(availableNow=True)
    if mode == "append":
        job = writer.format("parquet").option("path", out).start()
    else:  # a batch that is run again replaces what it has written
        job = writer.foreachBatch(lambda df, i: df.write.mode("overwrite").parquet(f"{out}/batch={i}")).start()
    job.awaitTermination()
    read = spark.read.schema(stream.schema) if mode == "append" else spark.read.schema(f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in stream.schema)}, batch bigint")
    return read.parquet(out)


def windowed_counts(events: DataFrame, at: str, width: str, delay: str, *keys: str) -> DataFrame:
    """(keys.., window_start, n): events per window of event time; later than ``delay`` behind the newest is dropped.

    Each batch writes the windows it changes and forgets those that ended before the watermark, so state is bounded; the
    last count of a window counts.
    """
    timed = events.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", delay)
    per = timed.groupBy(*keys, F.window("_at", width).alias("_w")).agg(F.count(F.lit(1)).alias("n"))
    changed = _finished(per.select(*keys, F.col("_w.start").cast("timestamp_ntz").alias("window_start"), "n"), "update", "windows")
    return changed.groupBy(*keys, "window_start").agg(F.max_by("n", "batch").alias("n"))


def distinct_within(events: DataFrame, at: str, delay: str, *keys: str) -> DataFrame:
    """(keys..): each key once, as long as its copies arrive within ``delay`` of each other."""
    timed = events.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", delay)
    return _finished(timed.dropDuplicatesWithinWatermark(list(keys)).select(*keys), "append", "distinct")


def budgeted(events: DataFrame, key: str, order: str, cost: str, budget: int) -> DataFrame:
    """(key, order, cost, admitted): greedy admission under a budget per key that lasts over all batches.

    Within a batch a key's rows are taken in order; the state is the sum spent, one number a key.
    """

    def admit(_: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        spent = state.get[0] if state.exists else 0
        rows, ok = pd.concat(list(chunks)).sort_values(order), []
        for c in rows[cost]:
            ok.append(spent + c <= budget)
            spent += c if ok[-1] else 0
        yield rows.assign(admitted=ok)
        state.update((int(spent),))

    rows = events.select(key, order, cost)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", admitted boolean"
    out = rows.groupBy(key).applyInPandasWithState(admit, schema, "spent bigint", "append", GroupStateTimeout.NoTimeout)
    return _finished(out, "append", "budget")
