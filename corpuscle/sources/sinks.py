"""Sinks: bounded logs, snapshots, metrics rows and rendered text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscle.operators.relational import top_per_group


def append_log(df: DataFrame, path: str) -> None:
    """Append rows as JSON lines; files of one commit appear together."""
    df.write.mode("append").json(path)


def keep_newest(df: DataFrame, path: str, key: list[str], order: list[str], most: int) -> None:
    """Write the newest rows of each key to a new folder: retention never rewrites what it reads."""
    top_per_group(df, key, [F.desc(c) for c in order], most).drop("rank").write.mode("error").parquet(path)


def pruned(df: DataFrame, key: list[str], order: list[str], most: int) -> DataFrame:
    """(key, kept, dropped): what keep_newest would keep and drop of each key: the dry run."""
    per = df.groupBy(*key).agg(F.count("*").alias("n"))
    return per.select(*key, F.least("n", F.lit(most)).alias("kept"), F.greatest(F.col("n") - most, F.lit(0)).alias("dropped"))


def merged_tail(logs: list[DataFrame], key: str, order: list[str], most: int) -> DataFrame:
    """The last `most` records of several logs: the last of each log by place, one for each key (the first log's wins), in the given order.

    Each log has a column place, its line number. Only `most` rows of a log are ever
    compared.
    """
    tails = [log.orderBy(F.desc("place")).limit(most).withColumn("_log", F.lit(n)) for n, log in enumerate(logs)]
    both = tails[0]
    for t in tails[1:]:
        both = both.unionByName(t)
    rest = [c for c in both.columns if c not in (key, "_log")]
    once = both.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct("_log", "place")).alias("r")).select(key, "r.*")
    return once.orderBy(*(F.desc(c) for c in order)).limit(most).drop("place")


def write_snapshot(df: DataFrame, path: str, snapshot_id: str) -> None:
    """A snapshot is one partition of a table; writing it again replaces that partition alone."""
    df.withColumn("snapshot_id", F.lit(snapshot_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("snapshot_id").parquet(path)


def markdown(title: Column, score: Column, body: Column) -> Column:
    """A rendered section."""
    return F.concat(F.lit("## "), title, F.lit(" ("), F.format_number(score, 1), F.lit(")\n\n"), F.coalesce(body, F.lit("")), F.lit("\n"))


def compact(path: Column, mode: Column, tokens: Column) -> Column:
    return F.concat_ws(" | ", path, mode, tokens.cast("string"))
