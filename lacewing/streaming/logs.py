"""Structured Streaming forms: append log, last value by key, rates, admission.

All streams run with the availableNow trigger over a folder and end.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_path


def source(spark: SparkSession, folder: str, table: str = "events") -> DataFrame:
    """A stream over one table of a folder; its schema is that of the table now."""
    schema = spark.read.parquet(f"{folder}/{table}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{table}.parquet").option("maxFilesPerTrigger", 1).parquet(folder)


def append_log(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Exactly-once file sink; a restart resumes at its checkpoint."""
    stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path).awaitTermination()


def last_by_key(stream: DataFrame, key: str, seq: str, value: str) -> DataFrame:
    """Last value of each key as a stateful operator; each batch emits the keys it changed."""
    kinds = {f.name: f.dataType.simpleString() for f in stream.schema}

    def update(k, frames: Iterator[pd.DataFrame], state):
        best = state.get if state.exists else None
        for pdf in frames:
            row = pdf.loc[pdf[seq].idxmax()]
            if best is None or row[seq] > best[0]:
                best = (int(row[seq]), row[value])
        state.update(best)
        yield pd.DataFrame({key: [k[0]], seq: [best[0]], value: [best[1]]})

    out = f"{key} {kinds[key]}, {seq} bigint, {value} {kinds[value]}"
    return stream.select(key, seq, value).groupBy(key).applyInPandasWithState(update, out, f"{seq} bigint, {value} {kinds[value]}", "update", "NoTimeout")


def windowed_rate(stream: DataFrame, ts: str = "ts", late: str = "10 minutes", size: str = "60 seconds") -> DataFrame:
    """Calls in each window; rows later than the watermark are dropped."""
    if stream.schema[ts].dataType.typeName() == "timestamp_ntz":  # read as UTC, whatever the session's zone
        stream = stream.withColumn(ts, F.expr(f"timestamp_micros(timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01', {ts}))"))
    return stream.withWatermark(ts, late).groupBy(F.window(ts, size).alias("w")).agg(F.count("*").alias("calls"))


def admit(stream: DataFrame, path: str, checkpoint: str, order: str, cap: int) -> None:
    """At most ``cap`` rows of each micro-batch go online, the others are deferred; a repeated batch writes the same folder."""

    def batch(df: DataFrame, epoch: int) -> None:
        first = df.orderBy(order).limit(cap).select(order).withColumn("online", F.lit(True))
        df.join(F.broadcast(first), order, "left").select(order, F.coalesce("online", F.lit(False)).alias("online")).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def run_update(changes: DataFrame, key: str, seq: str) -> DataFrame:
    """Run an update stream to its end and return the last row of each key."""
    spark = changes.sparkSession
    path = shared_path(spark, "changes")

    def batch(df: DataFrame, epoch: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    changes.writeStream.foreachBatch(batch).outputMode("update").option("checkpointLocation", shared_path(spark, "offsets")).trigger(availableNow=True).start().awaitTermination()
    d = spark.read.option("basePath", path).parquet(path)
    cols = [c for c in changes.columns if c != key]
    return d.groupBy(key).agg(F.max_by(F.struct(*cols), F.struct(seq, "epoch")).alias("v")).select(key, "v.*")
