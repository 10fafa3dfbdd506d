"""Structured Streaming forms of the event operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType


def stream(spark: SparkSession, folder: str, schema: StructType | str, files: int = 8) -> DataFrame:
    """New parquet files of a folder, a bounded number for each trigger; ts becomes a timestamp."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def deduplicated(events: DataFrame, key: str = "event_id", delay: str = "1 hour") -> DataFrame:
    """First row of each key, with state kept for no longer than the delay."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark([key])


def debounced(events: DataFrame, key: str = "user_id", gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """One row per burst of events: a refresh happens when a key has been quiet for the gap."""
    return events.withWatermark("ts", delay).groupBy(key, F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def windowed_counts(events: DataFrame, window: str = "1 day", delay: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", delay).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def repeated_failures(events: DataFrame, limit: int = 3, failure: str = "error") -> DataFrame:
    """(user_id, event_id): a row when a key has failed `limit` times in a row. State is one counter and one time per key."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        run = state.get[0] if state.exists else 0
        blocked = []
        for row in pd.concat(list(batches)).sort_values(["ts", "event_id"]).itertuples():
            run = run + 1 if row.event_type == failure else 0
            if run == limit:
                blocked.append(row.event_id)
        state.update((run,))
        yield pd.DataFrame({"user_id": [key[0]] * len(blocked), "event_id": blocked}).astype({"user_id": "int64", "event_id": "int64"})

    return events.groupBy("user_id").applyInPandasWithState(step, "user_id long, event_id long", "run int", "append", GroupStateTimeout.NoTimeout)


def upsert_latest(target: str, key: str = "user_id"):
    """A foreachBatch function that folds a batch into the latest row of each key, in a versioned folder per batch."""

    def merge(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        rest = [c for c in batch.columns if c != key]
        both = batch
        if epoch > 0:
            both = spark.read.parquet(f"{target}/v={epoch - 1}").unionByName(batch)
        both.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct("ts", "event_id")).alias("r")).select(key, "r.*").write.mode("overwrite").parquet(f"{target}/v={epoch}")

    return merge


def fingerprint_changes(rows: DataFrame, key: str = "user_id", fingerprint: str = "event_type", order: tuple[str, str] = ("ts", "event_id")) -> DataFrame:
    """(key, event_id, before, after): a row when the fingerprint of a key is another than the last one seen, its first one included.

    State is the last fingerprint of each key and lives on in the checkpoint, so a run
    that finds nothing new fires nothing. A null fingerprint counts as the empty one.
    """
    kind = rows.schema[key].dataType.simpleString()

    def step(own: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        out = []
        for row in pd.concat(list(batches)).sort_values(list(order)).itertuples():
            now = row.now or ""
            if last is None or now != last:
                out.append((own[0], getattr(row, order[1]), last, now))
                last = now
        state.update((last,))
        yield pd.DataFrame(out, columns=[key, "event_id", "before", "after"]).astype({"event_id": "int64"})

    narrow = rows.select(key, *order, F.col(fingerprint).cast("string").alias("now"))
    return narrow.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, event_id long, before string, after string", "last string", "append", GroupStateTimeout.NoTimeout)
