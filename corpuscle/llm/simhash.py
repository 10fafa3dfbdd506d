"""SimHash near-duplicates through a segment-popcount embedding.

A 64-bit fingerprint is mapped to the bit counts of its 32 two-bit segments, a
point of {0, 1, 2}^32. Flipping one bit moves one coordinate by at most one, so
the Manhattan distance of two points is a lower bound of the Hamming distance of
their fingerprints. Points are kept as thermometer codes (0: 00, 1: 01, 2: 11),
so that the Manhattan distance is the popcount of an exclusive or.

The 32 coordinates are dealt to groups. Two fingerprints within 3 bits lie within
Manhattan distance 3, so they agree in all but three groups at most. The grid that
all but three of the groups span is therefore joined with itself, once for each
choice of groups: an equi-join on a cell. More groups make finer cells and more
choices; their number follows from the number of fingerprints, so that a
fingerprint meets few others by chance, and does not change the result. A pair found
is kept if its whole Manhattan distance is at most 3, and then if the Hamming
distance itself is; both tests run inside the join. Exact copies share a
fingerprint and join once. No set of 64-bit fingerprints has more than 128
members that are all within 3 bits of each other, so links stay proportional.

Defined results: text is lower-cased A-Z, split at ASCII white space; under
three words the whole sequence is the one shingle; a null, empty or blank text
has fingerprint zero and links like any other; repeated rows stay; an empty
table gives no rows. Other columns are ignored. drop_copies() keeps one row of
each component, that with the smallest id (a null id last), then the smallest hash
of its text, then of the whole row: rows that share an id are told apart.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscle.llm.common import cut, join_facts, map_batches
from corpuscle.llm.components import components

SHINGLE, SEED, DISTANCE = 3, 42, 3
#: Shingles hashed at a time, so that a very long text needs no more memory than a short one.
BLOCK = 1 << 14
#: Keys of dropped documents that are sent to every task (about 40 bytes each); beyond it the join shuffles.
BROADCAST_IDS = 1_000_000
#: Fingerprints that one may meet by chance in a cell.
CHANCE = 10

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_LOW = 0x5555555555555555


def fingerprint(text: str | None) -> int:
    """The SimHash of a text, unsigned."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - SHINGLE + 1)
    counts = np.zeros((8, 256), np.int64)
    for at in range(0, n, BLOCK):
        part = words[at : min(at + BLOCK, n) + SHINGLE - 1]
        shingles = map(b" ".join, zip(*(part[i:] for i in range(SHINGLE)), strict=False)) if len(words) >= SHINGLE else [b" ".join(words)]
        hashes = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), "<u8")
        lanes = hashes.view(np.uint8).reshape(-1, 8)
        for lane in range(8):
            counts[lane] += np.bincount(lanes[:, lane], minlength=256)
    ones = (counts @ _BITS).reshape(64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, fp): fp is the fingerprint as a signed 64-bit integer."""
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], names=["id", "fp"])

    return map_batches(docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text")), run, f"id {kind}, fp bigint")


def embedding(fp: Column) -> Column:
    """The segment-popcount point of a fingerprint as thermometer codes."""
    shifted = F.shiftrightunsigned(fp, 1)
    some, both = (fp.bitwiseOR(shifted)).bitwiseAND(F.lit(_LOW)), (fp.bitwiseAND(shifted)).bitwiseAND(F.lit(_LOW))
    return some.bitwiseOR(F.shiftleft(both, 1))


def cells(n: int) -> list[int]:
    """Masks of the grids that are joined for n fingerprints: each leaves out three of the groups of coordinates."""
    # two random points share a coordinate with chance 3/8; the mean number of those met in a cell stays small
    groups = next(g for g in range(2 * DISTANCE, 33) if g == 12 or n * (3 / 8) ** (32 * (g - DISTANCE) / g) <= CHANCE)
    of = [sum(3 << 2 * c for c in range(g, 32, groups)) for g in range(groups)]
    return [sum(m for g, m in enumerate(of) if g not in out) for out in combinations(range(groups), DISTANCE)]


def links(fps: DataFrame, n: int | None = None) -> DataFrame:
    """(a, b): every pair of distinct fingerprints within DISTANCE bits, at least once; fps has n distinct fp."""
    masks = cells(fps.count() if n is None else n)
    signed = F.array(*(F.lit(m - (m >> 63 << 64)) for m in masks))
    grid = fps.select("fp", embedding(F.col("fp")).alias("point")).select("fp", F.posexplode(signed).alias("grid", "mask"), "point")
    grid = grid.select("fp", F.xxhash64("grid", F.col("point").bitwiseAND(F.col("mask"))).alias("cell"))
    a, b = grid.withColumnRenamed("fp", "a"), grid.withColumnRenamed("fp", "b")
    bound = F.bit_count(embedding(F.col("a")).bitwiseXOR(embedding(F.col("b")))) <= DISTANCE
    exact = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE
    return a.join(b, (a["cell"] == b["cell"]) & (F.col("a") < F.col("b")) & bound & exact).select("a", "b")


def _components(rows: DataFrame) -> DataFrame:
    """(fp, n, component, root) of every distinct fingerprint of rows (id, fp); root is one fingerprint of the component."""
    classes = cut(rows.groupBy("fp").agg(F.min("id").alias("first"), F.count("*").alias("n")))
    roots = components(links(classes)).withColumnRenamed("node", "fp")
    joined = classes.join(roots, "fp")
    linked = join_facts(joined.select("fp", "root"), joined.groupBy("root").agg(F.min("first").alias("least"), F.count("*").alias("size")), ["root"], "size", classes.count())
    return cut(classes.join(linked, "fp", "left").select("fp", "n", F.coalesce("least", "first").alias("component"), F.coalesce("root", "fp").alias("root")))


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, fp, component): component is the smallest id reachable over links."""
    rows = cut(fingerprints(docs, id_column, text_column))
    return join_facts(rows, _components(rows), ["fp"], "n", rows.count()).select("id", "fp", "component")


def drop_copies(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row of each component of near copies, whole."""
    text = F.col(text_column).cast("string")
    key = F.struct(F.col(id_column).isNull().alias("lost"), F.col(id_column).alias("id"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2"))
    rows = cut(fingerprints(docs.select(key.alias("key"), text.alias("text")), "key", "text").select(F.col("id").alias("key"), F.col("id.id").alias("id"), "fp"))
    found = join_facts(rows, _components(rows), ["fp"], "n", rows.count())
    keys = cut(found.groupBy("root", "key").agg(F.count("*").alias("n")))
    first = keys.groupBy("root").agg(F.min("key").alias("key"))
    kept = cut(first.join(keys, ["root", "key"]).select("key", "n"))
    gone = cut(keys.select("key").join(kept, "key", "left_anti"))
    same = lambda df: key.eqNullSafe(df["key"])
    sent = lambda df: df if df.count() > BROADCAST_IDS else F.broadcast(df)
    again = kept.where("n > 1").select("key")
    out = docs.join(sent(gone), same(gone), "left_anti")
    if again.isEmpty():
        return out
    # of rows that are equal in id and text, the first by a hash of all columns
    many = docs.join(sent(again), same(again), "left_semi").select(key.alias("key"), F.struct("*").alias("row"))
    once = many.groupBy("key").agg(F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row")).select("row.*")
    return out.join(sent(again), same(again), "left_anti").unionByName(once)
