"""How many items each two members of a group share, without a shuffled row per pair."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Members of a block, and distinct items of two blocks that are multiplied at once.
BLOCK, ITEMS = 2048, 1024
#: Pairs of an item are multiplied above this share of all pairs of two blocks, and listed below it.
DENSE = 0.01


def _counts(left: pa.Table, right: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Members of both sides and the matrix of the number of items that each two share."""
    def side(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        lists = t["items"].combine_chunks()
        return t["member"].to_numpy(), np.repeat(np.arange(len(t)), np.diff(lists.offsets.to_numpy())), lists.flatten().to_numpy()

    (a, ra, ia), (b, rb, ib) = side(left), side(right)
    both = np.intersect1d(ia, ib)
    ka, kb = np.isin(ia, both), np.isin(ib, both)
    ra, ca, rb, cb = ra[ka], np.searchsorted(both, ia[ka]), rb[kb], np.searchsorted(both, ib[kb])
    na, nb = np.bincount(ca, minlength=len(both)), np.bincount(cb, minlength=len(both))
    dense = na * nb > DENSE * len(a) * len(b)
    shared = np.zeros((len(a), len(b)), np.int64)
    heavy = np.flatnonzero(dense)
    for i in range(0, len(heavy), ITEMS):
        part = heavy[i : i + ITEMS]
        place = np.full(len(both), -1)
        place[part] = np.arange(len(part))
        x, y = np.zeros((len(a), len(part)), np.float32), np.zeros((len(b), len(part)), np.float32)
        for m, r, c in ((x, ra, place[ca]), (y, rb, place[cb])):
            m[r[c >= 0], c[c >= 0]] = 1
        shared += (x @ y.T).astype(np.int64)  # sums of at most ITEMS ones are exact
    order = np.argsort(cb, kind="stable")
    rb, start = rb[order], np.cumsum(nb) - nb
    light = ~dense[ca]
    for x, c in zip(ra[light], ca[light]):
        shared[x, rb[start[c] : start[c] + nb[c]]] += 1  # a member holds an item once
    return a, b, shared


def _pairs(left: pa.Table, right: pa.Table) -> pa.Table:
    if not (len(left) and len(right)):
        return pa.table({n: pa.array([], pa.int64()) for n in ("a", "b", "overlap")})
    a, b, shared = _counts(left, right)
    once = a[:, None] < b[None, :] if left["i"][0].as_py() == left["j"][0].as_py() else np.ones(shared.shape, bool)
    x, y = np.nonzero((shared > 0) & once)
    return pa.table({"a": np.minimum(a[x], b[y]), "b": np.maximum(a[x], b[y]), "overlap": shared[x, y]})


def shared_items(rows: DataFrame, group: str, member: str, item: str) -> DataFrame:
    """(a, b, overlap): members a < b of a group with at least one item in common, each a bigint; rows with a null take no part.

    Members are dealt to blocks of about BLOCK. Each two blocks of a group meet in one
    task, where the items of a block are a matrix; what is shuffled is each member's
    items, once per block of its group, and never a pair. A pair is written once.
    A member that is in several groups has its pairs of each.
    """
    each = rows.select(F.col(group).alias("g"), F.col(member).cast("bigint").alias("member"), F.col(item).cast("bigint").alias("item")).dropna()
    held = each.groupBy("g", "member").agg(F.collect_set("item").alias("items"))
    sizes = held.groupBy("g").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    dealt = held.join(sizes, "g").withColumn("at", F.pmod(F.xxhash64("member"), F.col("blocks")).cast("int"))
    meets = lambda i, j, other: dealt.withColumn("o", F.explode(other)).select(*(F.col(c).alias(n) for c, n in (("g", "g"), (i, "i"), (j, "j"), ("member", "member"), ("items", "items"))))
    left = meets("at", "o", F.sequence("at", F.col("blocks") - 1)).groupBy("g", "i", "j")
    right = meets("o", "at", F.sequence(F.lit(0), F.col("at"))).groupBy("g", "i", "j")
    return left.cogroup(right).applyInArrow(_pairs, "a bigint, b bigint, overlap bigint")
