"""Helpers shared by the operators: checkpoints, Arrow batch bounds, splits."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corpuscle import shared
from corpuscle.shared import bound_batches, cut, join_facts

__all__ = ["bound_batches", "bounded_sample", "cut", "fold", "join_facts", "keyed", "map_batches", "table", "words_of"]

#: Classes of a bounded sample, the largest ones.
MOST_CLASSES = 1024


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow under bounded batches."""
    bound_batches(df.sparkSession)
    return df.mapInArrow(fn, schema)


def keyed(rows: DataFrame, *columns: str) -> DataFrame:
    """The named columns of rows (id, text), a hash of id and text, and the text's size: what a sample is drawn from."""
    return rows.select(*columns, F.xxhash64("id", "text").alias("h"), F.octet_length("text").alias("size"))


def bounded_sample(texts: DataFrame, keys: DataFrame, classes: str, most_rows: int, most_bytes: int, long: int) -> DataFrame:
    """(class, rank, text) of a sample of texts(id, text), whole: at most most_rows of each class, most_bytes of all classes.

    keys(class, h, size) are those of keyed(). The MOST_CLASSES largest classes take part
    and have the same part of the bytes each. Rows are taken by their hash, texts of more
    than long bytes last; a text that alone is more than its class may have is never
    taken, so a class of such texts has no sample. Rows that repeat both id and text count
    once. Only keys are shuffled and ranked, and of these no more than several times the
    sample, those under a share of the hash range. Texts are looked up by the keys that
    were chosen.
    """
    counts = keys.groupBy(classes).agg(F.count("*").alias("n"), F.count_if(F.col("size") <= long).alias("short")).orderBy(F.desc("n"), classes).limit(MOST_CLASSES)
    share = F.least(F.lit(1.0), F.lit(8.0 * most_rows) / F.when(F.col("short") > most_rows, F.col("short")).otherwise(F.col("n")))
    per_class = counts.select(classes, share.alias("share"), (F.lit(most_bytes) / F.count("*").over(Window.partitionBy())).alias("budget"))  # at most MOST_CLASSES rows
    near = keys.join(F.broadcast(per_class), classes).where((F.col("h").cast("double") / 2.0**64 + 0.5 <= F.col("share")) & (F.col("size") <= F.col("budget")))
    order = Window.partitionBy(classes).orderBy(F.col("size") > long, "h")
    ranked = near.dropDuplicates([classes, "h"]).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most_rows)
    spent = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))
    chosen = ranked.withColumn("spent", spent).where(F.col("spent") <= F.col("budget")).select(classes, "rank", "h")
    return keyed(texts, "text").drop("size").join(F.broadcast(chosen), "h").groupBy(classes, "rank").agg(F.any_value("text").alias("text"))


#: A-Z to a-z, other ASCII bytes that are no letter or digit to spaces; bytes of other characters stay.
_WORD_BYTES = bytes(b if b >= 128 else ord(chr(b).lower()) if chr(b).isalnum() else ord(" ") for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    """The words of a UTF-8 text: runs of ASCII letters, lower-cased, digits and characters beyond ASCII."""
    return text.translate(_WORD_BYTES).split() if text else []


def fold(id_column: Column, folds: int) -> Column:
    """crc32 of the id's text modulo folds; a null id counts as the empty text."""
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")) % folds


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; documents are dealt to all cores even where its files are too few."""
    found = shared.table(spark, sf_dir, name)
    return shared.spread(found) if name == "documents" else found
