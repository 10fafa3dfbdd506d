"""Exact top-k search by inner product: columnar branch and bound.

Vectors are packed into blocks that are stored vertically (dimension by
dimension). Every query block meets every candidate block once. Inside, partial
products are accumulated a dimension block at a time; what the missing dimensions
can still add is at most the product of the two remaining norms, so a candidate
whose partial product plus that bound is below the query's k-th best so far is
dropped, and the survivors are compacted before the next dimension block. A tile of
query blocks meets a run of candidate blocks in one group, which reads either once
and carries the k-th best along. Every
query block first meets one candidate block alone; the k-th best found there is
the least that its queries ask of every run.

All arithmetic is exact: vectors are integers, products are taken in double
precision as long as they stay below 2**53 and in 64-bit or arbitrary integers
otherwise; bounds are widened by more than their rounding error. Vectors with
components of 63 bits or more lie in blocks of their own, in wider integers; where
products may pass 64 bits all of them are taken, without bounds.

A query is a stated set of rows and is meant to see all candidates, in blocks;
rows of a run are at most k for each of its queries, and the last ranking is a
window over one query's rows.

Defined results: rows with a null id, and vectors that are null, empty, or hold null or non-finite
components take no part; vectors meet only those of their own length; ties go to
the smaller id; an empty table gives no rows. Rows are told apart by the column
row: rows that repeat an id or a vector are candidates, and queries, of their own,
and a query meets every row but itself. Scores beyond 64 bits are ranked exactly
and given as the nearest 64-bit number.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuscle.llm.common import cut, map_batches

#: Least and largest score.
LOW, HIGH = -(2**63), 2**63 - 1

K = 20
#: Candidates and queries of a packed block, and dimensions accumulated at a time.
BLOCK_ROWS, QUERY_ROWS, BLOCK_DIMS = 2048, 512, 16
#: Candidate blocks, on average, of a run.
RUN = 4
#: Query blocks, on average, that meet a run in one group, and lengths whose first blocks are sent to every task.
TILE, BROADCAST_LENGTHS = 64, 64
#: Share of surviving pairs below which pairs are kept as a list.
SPARSE = 0.05
#: Components below this many bits lie in 64-bit blocks; bytes of any score's distance from 64 bits, in order.
NARROW, FAR_BYTES = 62, 272
#: Factor of the remaining norms that covers the rounding of bounds.
WIDER = 1 + 1e-9


def usable(vector: Column) -> Column:
    """True for vectors that take part."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~F.coalesce(bad, F.lit(True))


def numbered(rows: DataFrame) -> DataFrame:
    """rows with the column row, a number of their own that stays the same."""
    return cut(rows.withColumn("row", F.monotonically_increasing_id()))


def _scaled(x: float, scale: int) -> int:
    """floor(scale * x), also where the product is beyond doubles; scale is a power of two."""
    return math.floor(x * scale) if abs(x) < 2.0**53 else int(x) * scale


def _packed(matrix: np.ndarray) -> bytes:
    """int64, or wider numbers of one width: _unpacked tells it from the length."""
    if matrix.dtype != object:
        return matrix.tobytes()
    width = max(9, *(int(v).bit_length() // 8 + 1 for v in matrix.flat))
    return b"".join(int(v).to_bytes(width, "little", signed=True) for v in matrix.flat)


def _blocks(rows: DataFrame, size: int, scale: int) -> DataFrame:
    """(dims, ids, matrix): integer matrices of shape (dims, at most size rows), checkpointed; ids holds ids, then row numbers."""
    rows = rows.where("id is not null").select("id", "row", "vector")
    doubles = rows.schema["vector"].dataType.elementType.typeName() in ("float", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, bool], tuple[list, list]] = {}

        def out(dims: int, wide: bool) -> pa.RecordBatch:
            ids, vectors = held.pop((dims, wide))
            matrix = np.ascontiguousarray(np.array(vectors, object if wide else np.int64).T)
            return pa.RecordBatch.from_arrays([pa.array([dims], pa.int32()), pa.array([np.array(ids, np.int64).T.tobytes()], pa.binary()), pa.array([_packed(matrix)], pa.binary())], names=["dims", "ids", "matrix"])

        for batch in batches:
            for i, n, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                wide = max(max(v), -min(v)) * scale >= 2**NARROW
                if doubles:
                    v = [_scaled(x, scale) for x in v] if wide else np.floor(np.array(v, np.float64) * scale).astype(np.int64)
                ids, vectors = held.setdefault((len(v), wide), ([], []))
                ids.append((i, n))
                vectors.append(v)
                if len(ids) == size:
                    yield out(len(v), wide)
        for key in list(held):
            yield out(*key)

    # dealt out evenly, a block or less to a partition
    return cut(map_batches(rows.repartition(max(1, -(-rows.count() // size))), run, "dims int, ids binary, matrix binary"))


def _dot(a: np.ndarray, b: np.ndarray, exact: type) -> np.ndarray:
    return a.astype(exact).T @ b.astype(exact)


def _largest(m: np.ndarray) -> int:
    return max(1, int(m.max(initial=0)), -int(m.min(initial=0)))


def _kth(s: np.ndarray, k: int) -> float:
    """The k-th best score of a query, -inf if it has fewer; what lies beyond 1e300 counts as that."""
    return float(min(max(s[k - 1], -(10**300)), 10**300)) if len(s) >= k else -np.inf


def _search_all(best: list[tuple[np.ndarray, np.ndarray]], q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int) -> None:
    """search_block in arbitrary integers: every product is taken."""
    right = c.astype(object)
    for j in range(q.shape[1]):
        s, i = np.concatenate([best[j][0].astype(object), q[:, j].astype(object) @ right]), np.concatenate([best[j][1], c_ids], axis=1)
        o = heapq.nsmallest(k, np.flatnonzero(i[1] != q_ids[1, j]), key=lambda x: (-s[x], i[0, x], i[1, x]))  # noqa: B023
        best[j] = (s[o], i[:, o])


def search_block(best: list[tuple[np.ndarray, np.ndarray]], floor: np.ndarray, q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int) -> None:
    """Merge the candidates c into best, (scores, [ids, row numbers]) for every query of q; both matrices are vertical.

    Ids are pairs of rows: ids and row numbers. floor is what a candidate must reach for each query.
    """
    dims, size = q.shape[0], _largest(q) * _largest(c)
    if size * dims >= 2**63:
        return _search_all(best, q_ids, q, c_ids, c, k)
    exact = np.float64 if size * dims < 2**53 else np.int64
    rest = lambda m: np.sqrt(np.cumsum((m.astype(np.float64) ** 2)[::-1], axis=0)[::-1])
    q_rest, c_rest = rest(q), rest(c)
    floor = np.maximum(floor, np.array([_kth(s, k) for s, _ in best], np.float64))
    for at in range(0, q.shape[1], 256):
        own = slice(at, min(at + 256, q.shape[1]))
        # while many pairs survive: all pairs of the remaining candidates, a dimension block at a time
        columns, score = np.arange(c.shape[1]), np.zeros((own.stop - own.start, c.shape[1]), exact)
        left, lo = c, 0
        edge = floor[own]
        while lo < dims:
            hi = min(lo + BLOCK_DIMS, dims)
            score = score + _dot(q[lo:hi, own], left[lo:hi], exact)
            lo = hi
            slack = np.multiply.outer(q_rest[lo, own], c_rest[lo][columns]) * WIDER if lo < dims else 0.0
            if lo == BLOCK_DIMS < dims and np.isneginf(edge).any() and c.shape[1] > k:
                # no k-th best yet: one more than k candidates reach this much, one of which may be the query itself
                few = np.isneginf(edge)
                least = score[few].astype(np.float64) - slack[few]
                edge = edge.copy()
                edge[few] = np.partition(least, c.shape[1] - k - 1, axis=1)[:, c.shape[1] - k - 1] - 1.0
            alive = score.astype(np.float64) + slack >= (edge - 1e-6 * (1 + np.abs(edge)))[:, None]
            some = alive.any(axis=0)
            columns, left, score, alive = columns[some], left[:, some], score[:, some], alive[:, some]
            if alive.size == 0 or alive.mean() < SPARSE:
                break
        alive &= q_ids[1, own][:, None] != c_ids[1, columns][None]
        qi, ci = np.nonzero(alive)
        score, ci = score[qi, ci], columns[ci]
        # then the surviving pairs alone
        for lo in range(lo, dims, BLOCK_DIMS):  # noqa: B020
            hi = min(lo + BLOCK_DIMS, dims)
            if len(qi):
                score = score + (q[lo:hi, own].astype(exact)[:, qi] * c[lo:hi].astype(exact)[:, ci]).sum(axis=0)
            if hi < dims:
                bound = score.astype(np.float64) + q_rest[hi, own][qi] * c_rest[hi][ci] * WIDER
                keep = bound >= edge[qi] - 1e-6 * (1 + np.abs(edge[qi]))
                qi, ci, score = qi[keep], ci[keep], score[keep]
        score = score.astype(np.int64)
        found = c_ids[:, ci]
        order = np.lexsort((found[1], found[0], -score, qi))
        qi, found, score = qi[order], found[:, order], score[order]
        edges = np.searchsorted(qi, np.arange(own.stop - own.start + 1))
        for j in range(own.stop - own.start):
            a, b = edges[j], min(edges[j] + k, edges[j + 1])
            if a == b:
                continue
            s, i = np.concatenate([best[at + j][0], score[a:b]]), np.concatenate([best[at + j][1], found[:, a:b]], axis=1)
            o = np.lexsort((i[1], i[0], -s))[:k] if s.dtype != object else np.array(sorted(range(len(s)), key=lambda x: (-s[x], *i[:, x]))[:k], int)
            best[at + j] = (s[o], i[:, o])


def _none(queries: int) -> list[tuple[np.ndarray, np.ndarray]]:
    return [(np.zeros(0, np.int64), np.zeros((2, 0), np.int64))] * queries


def _unpacked(dims: int, ids: bytes, matrix: bytes) -> tuple[np.ndarray, np.ndarray]:
    own = np.frombuffer(ids, np.int64).reshape(2, -1)
    width = len(matrix) // (dims * own.shape[1])
    if width == 8:
        return own, np.frombuffer(matrix, np.int64).reshape(dims, -1)
    return own, np.array([int.from_bytes(matrix[at : at + width], "little", signed=True) for at in range(0, len(matrix), width)], object).reshape(dims, -1)


def _far(score: int) -> bytes | None:
    """How far a score lies at or beyond the 64-bit numbers, as bytes in its order; null within."""
    return (score - min(max(score, LOW), HIGH) + (1 << 8 * FAR_BYTES - 1)).to_bytes(FAR_BYTES, "big") if score <= LOW or score >= HIGH else None


def top_k(queries: DataFrame, candidates: DataFrame, k: int = K, scale: int = 1) -> DataFrame:
    """(query_id, rank, id, score) of each query's k largest inner products.

    Inputs are (id bigint, row bigint, vector) with the rows of one numbered() table. A
    vector is an array<bigint>, or one of doubles x that stand for floor(scale * x); scale
    is a power of two, and 1 for integers.
    """
    c = _blocks(candidates, BLOCK_ROWS, scale).select("dims", F.struct(F.col("ids").alias("c_ids"), F.col("matrix").alias("c")).alias("block"))
    q = _blocks(queries, QUERY_ROWS, scale).select("dims", F.col("ids").alias("q_ids"), F.col("matrix").alias("q"))
    runs = max(1, -(-c.count() // RUN))
    c = c.groupBy("dims", F.pmod(F.xxhash64("block.c_ids"), F.lit(runs)).alias("run")).agg(F.collect_list("block").alias("cs"))
    probe = c.groupBy("dims").agg(F.min_by(F.get("cs", F.lit(0)), "run").alias("probe"))  # a block for each length

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            floors = []
            for x in batch.to_pylist():
                ids, m = _unpacked(x["dims"], x["q_ids"], x["q"])
                best, none = _none(m.shape[1]), np.full(m.shape[1], -np.inf)
                search_block(best, none, ids, m, *_unpacked(x["dims"], x["probe"]["c_ids"], x["probe"]["c"]), k)
                floors.append(np.array([_kth(s, k) for s, _ in best], np.float64).tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(floors, pa.binary())], names=["dims", "q_ids", "q", "floor"])

    probe = F.broadcast(probe) if c.select("dims").distinct().count() <= BROADCAST_LENGTHS else probe
    q = cut(map_batches(q.join(probe, "dims").select("dims", "q_ids", "q", "probe"), first, "dims int, q_ids binary, q binary, floor binary"))
    tiles = max(1, -(-q.count() // TILE))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))  # noqa: E731  keys of either side are of one type: a cogroup casts none, and int and bigint hash apart
    q = q.withColumn("tile", F.pmod(F.xxhash64("q_ids"), F.lit(tiles))).withColumn("run", every(runs))
    c = c.withColumn("tile", every(tiles)).withColumnRenamed("dims", "c_dims")

    def run(queries: pa.Table, blocks: pa.Table) -> pa.Table:
        """A tile of query blocks meets a run of candidate blocks; either is read once."""
        runs, out = [_unpacked(x["c_dims"], b["c_ids"], b["c"]) for x in blocks.to_pylist() for b in x["cs"]], []
        none = pa.schema([*((n, pa.int64()) for n in ("query_id", "query_row", "id", "row", "score")), ("far", pa.binary())])
        for x in queries.to_pylist():
            q_ids, m = _unpacked(x["dims"], x["q_ids"], x["q"])
            best, floor = _none(m.shape[1]), np.frombuffer(x["floor"], np.float64)
            for block in runs:
                search_block(best, floor, q_ids, m, *block, k)
            of, ids = np.repeat(q_ids, [len(s) for s, _ in best], axis=1), np.concatenate([i for _, i in best], axis=1)
            exact = [int(v) for s, _ in best for v in s]
            scores = np.array([min(max(v, LOW), HIGH) for v in exact], np.int64)
            out.append(pa.Table.from_arrays([*map(pa.array, (*of, *ids, scores)), pa.array(map(_far, exact), pa.binary())], names=none.names))
        return pa.concat_tables(out) if out and runs else none.empty_table()

    groups = q.groupBy("dims", "run", "tile").cogroup(c.groupBy("c_dims", "run", "tile"))
    found = groups.applyInArrow(run, "query_id bigint, query_row bigint, id bigint, row bigint, score bigint, far binary")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), F.desc("far"), "id", "row")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


ORACLE_SQL = f"""
WITH v AS (SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.vec_id AS query_id, q.r, c.vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.r <> c.r AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
QUALIFY rank <= {K}
"""
