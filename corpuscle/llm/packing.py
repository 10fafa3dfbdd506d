"""Harmonic packing of tokenised documents into fixed-capacity sequences.

Lengths fall into reciprocal-capacity classes: class k holds pieces of at most
capacity // k tokens, and every bin of class k takes exactly k of them, so bins
are filled without looking at lengths. Workers (salts of the document id) number
their pieces of a class on their own; the base of each worker's numbers comes
from counts per class and worker, so one bin per class at most stays open in
the whole corpus. The pieces of those open bins, fewer than the sum of all k,
are packed once more by first fit.

A document is cut into full sequences and a rest. A rest that would waste more
than 1/32 of itself in its class gives up a piece of exactly capacity // (k + 1)
tokens first, as often as needed.

Defined results: a null or empty text is one piece (the end id alone); rows
that repeat an id are packed once per row; an empty table gives no rows. Extra
input columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import accumulate, takewhile

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuscle.llm.bpe import encoder
from corpuscle.llm.common import cut, map_batches

CAPACITY, END_ID, WORKERS = 4096, 2, 1024
#: A rest may waste 1/WASTE of its own length; from class SMALL on it is never cut.
WASTE, SMALL = 32, 32


def harmonic_classes(capacity: int) -> list[int]:
    """All k up to SMALL, then steps of about a tenth, so that few bins stay open."""
    steps = accumulate(range(capacity), lambda k, _: max(k + 1, k * 11 // 10), initial=SMALL)
    return [*range(1, min(SMALL, capacity + 1)), *takewhile(lambda k: k <= capacity, steps)]


def piece_lengths(tokens: int, capacity: int, classes: list[int]) -> list[tuple[int, int]]:
    """(length, class) of the pieces of a document, in order."""
    out = [(capacity, 1)] * (tokens // capacity)
    rest = tokens % capacity
    while rest:
        k = max(1, capacity // rest)
        if k >= SMALL:
            out.append((rest, max(c for c in classes if c <= k)))
            break
        if (capacity // k - rest) * WASTE <= rest:
            out.append((rest, k))
            break
        unit = capacity // (k + 1)
        out.append((unit, k + 1))
        rest -= unit
    return out


def pieces(docs: DataFrame, tokenizer: str, id_column: str, text_column: str, capacity: int) -> DataFrame:
    kind = docs.schema[id_column].dataType.simpleString()
    classes = harmonic_classes(capacity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, end = encoder(tokenizer), END_ID.to_bytes(4, "little")
        for batch in batches:
            of, rows = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                ids = own.encode(text) + end
                start = 0
                for length, k in piece_lengths(len(ids) // 4, capacity, classes):
                    of.append(i)
                    rows.append((start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), len(ids) // 4, k))
                    start += length
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of, pa.int64())), *(pa.array(c, pa.int64()) for c in columns)], names=["id", "start", "length", "ids_crc32", "doc_tokens", "k"])

    return map_batches(docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text")), run, f"id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, k bigint")


def pack(docs: DataFrame, tokenizer: str, id_column: str = "doc_id", text_column: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    kind = docs.schema[id_column].dataType.simpleString()
    made = cut(pieces(docs, tokenizer, id_column, text_column, capacity).withColumn("worker", F.pmod(F.xxhash64("id", "start", "ids_crc32"), F.lit(WORKERS))))
    # at most classes x workers rows, whatever the input
    counts = made.groupBy("k", "worker").agg(F.count("*").alias("own"))
    by_class = Window.partitionBy("k")
    counts = counts.select("k", "worker", (F.sum("own").over(by_class.orderBy("worker").rowsBetween(Window.unboundedPreceding, 0)) - F.col("own")).alias("base"), F.sum("own").over(by_class).alias("total"))
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own_order = Window.partitionBy("worker", "k").orderBy("id", "start", "ids_crc32")
    slots = made.repartition(partitions, "worker").withColumn("rank", F.row_number().over(own_order))
    slots = slots.join(F.broadcast(counts), ["k", "worker"]).withColumn("slot", F.col("base") + F.col("rank") - 1)
    slots = slots.withColumn("bin", F.expr("slot div k")).withColumn("closed", F.expr("bin < total div k"))

    def first_fit(rest: pd.DataFrame) -> pd.DataFrame:
        rest = rest.sort_values(["length", "k", "slot"], ascending=[False, True, True])
        free: list[int] = []
        bins = []
        for length in rest["length"]:
            i = next((i for i, room in enumerate(free) if room >= length), len(free))
            free[i : i + 1] = [(free[i] if i < len(free) else capacity) - length]
            bins.append(i)
        return rest.assign(k=0, bin=bins).drop(columns="all")

    columns = ["id", "start", "length", "ids_crc32", "doc_tokens", "k", "slot", "bin"]
    schema = f"id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, k bigint, slot bigint, bin bigint"
    slots = cut(slots.select(*columns, "closed"))
    # fewer than the sum of all k pieces are left, a bound that no input changes
    again = slots.where(~F.col("closed")).select(*columns, F.lit(0).alias("all")).groupBy("all").applyInPandas(lambda rest: first_fit(rest), schema)
    binned = slots.where("closed").select(*columns).unionByName(again)
    inside = Window.partitionBy("k", "bin").orderBy("slot", F.desc("length"), "id", "start").rowsBetween(Window.unboundedPreceding, 0)
    return binned.select("id", "start", "length", "ids_crc32", "doc_tokens", (F.shiftleft("k", 40) + F.col("bin")).alias("sequence_id"), (F.sum("length").over(inside) - F.col("length")).alias("offset"))
