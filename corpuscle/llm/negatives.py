"""Hard-negative mining by dual-tree search.

Rows are dealt into blocks of about BLOCK_ROWS by label and by a cell of space (the
nearest two of a few pivots, drawn from a bounded sample), the anchors into blocks
of about ANCHOR_ROWS; every block holds a ball tree: nodes with a centre, a radius
and a range of labels. The inner product of any member of one node with any member
of another lies within |centre a| * r_c + |centre c| * r_a + r_a * r_c of the centres'
product. This interval discards a whole group of anchors against a whole group of
candidates at once, if no member can reach what the group still asks for or all are
above what it may have. Pairs of leaves that stay are scored exactly.

Blocks are compared twice: for the positives (same label, the k best of each
anchor), and for the negatives (other labels, scores between a share of a positive's
score and that score, the best of each positive). Pairs of blocks are judged by
their roots first, on their summaries alone; only those that stay are brought
together. A pair returns at most k rows for each anchor, or each positive.

Identical vectors, however many, spread over blocks of bounded size like all others.

Scores are exact: doubles while products stay below 2**53, 64-bit or arbitrary
integers beyond; intervals are widened by more than their rounding error.

Defined results: rows with a null id or label, and vectors that are null, empty or
hold null or non-finite components take no part; vectors meet only those of their
own length; rows that repeat an id or a vector are rows of their own, and an anchor
meets every row but itself; ties go to the smaller id; anchors without a positive,
and positives without a negative in range, give no rows (a negative score leaves no
range); an empty table gives no rows. Scores beyond 64 bits count as the nearest
64-bit number.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuscle.llm.common import cut, map_batches

POSITIVES, NEGATIVES = 5, 5
#: A negative has at least this many hundredths of its positive's score.
LEAST_SHARE = 80
BLOCK_ROWS, ANCHOR_ROWS = 4096, 1024
#: Rows of a leaf, of candidates and of anchors.
LEAF, ANCHOR_LEAF = 128, 32
#: Pivots, and rows of the sample they are taken from.
PIVOTS, SAMPLE = 64, 4096
#: Candidate blocks whose summaries are judged in one task, on average.
SHARE = 256
#: A relative and an absolute allowance for rounding in bounds.
SLACK = 1e-9
LOW, HIGH = -(2**63), 2**63 - 1


@dataclass
class Tree:
    """A ball tree over rows that are stored in its order; node 0 is the root."""

    ids: np.ndarray
    rows: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    nodes: list[tuple[int, int, int, int]]  # start, end, left, right; leaves have -1
    centres: np.ndarray
    radii: np.ndarray
    norms: np.ndarray
    lows: np.ndarray
    highs: np.ndarray

    @classmethod
    def grow(cls, ids: np.ndarray, rows: np.ndarray, labels: np.ndarray, vectors: np.ndarray, leaf: int) -> Tree:
        """Halves are cut at the median of the direction in which a node is widest; labels are parted first."""
        points, order, nodes, todo = vectors.astype(np.float64), np.argsort(labels, kind="stable"), [], [(0, len(ids), -1, 0)]
        while todo:
            a, b, parent, side = todo.pop()
            own, number = order[a:b], len(nodes)
            nodes.append([a, b, -1, -1])
            if parent >= 0:
                nodes[parent][2 + side] = number
            if b - a <= leaf:
                continue
            own_labels = labels[own]
            if own_labels[0] != own_labels[-1]:
                edges = np.flatnonzero(np.diff(own_labels)) + 1  # of the changes of label the one nearest the middle
                middle = int(edges[np.argmin(np.abs(edges - len(own) // 2))])
            else:
                spread = points[own] - points[own].mean(axis=0)
                along = spread @ spread[np.argmax((spread**2).sum(axis=1))]
                middle = len(own) // 2
                order[a:b] = own[np.argpartition(along, middle)]
            todo += [(a, a + middle, number, 0), (a + middle, b, number, 1)]
        points, labels = points[order], labels[order]
        centres = np.array([points[a:b].mean(axis=0) for a, b, _, _ in nodes])
        radii = np.array([np.sqrt(((points[a:b] - c) ** 2).sum(axis=1).max()) for (a, b, _, _), c in zip(nodes, centres, strict=True)])
        low, high = (np.array([f(labels[a:b]) for a, b, _, _ in nodes]) for f in (np.min, np.max))
        return cls(ids[order], rows[order], labels, vectors[order], [tuple(n) for n in nodes], centres, radii, np.sqrt((centres**2).sum(axis=1)), low, high)


def interval(product, a_norm, a_radius, c_norm, c_radius):
    """Least and greatest inner product between members of two balls."""
    reach = a_norm * c_radius + c_norm * a_radius + a_radius * c_radius
    reach = reach + SLACK * (1 + a_norm * c_norm + reach)
    return product - reach, product + reach


def _exact(a: np.ndarray, c: np.ndarray) -> type:
    most = float(max(1, np.abs(a).max(initial=0))) * float(max(1, np.abs(c).max(initial=0))) * a.shape[1]
    return np.float64 if most < 2**53 else np.int64 if most < 2**63 else object


def _scores(a: np.ndarray, c: np.ndarray, kind: type) -> np.ndarray:
    found = a.astype(kind) @ c.astype(kind).T
    return found.astype(np.int64) if kind is not object else np.array([[min(max(int(x), LOW), HIGH) for x in row] for row in found], np.int64)


class Wishes:
    """What anchors ask of candidates: each wish the k best scores within [low, high] for the anchor at a place of the tree."""

    def __init__(self, size: int, wanted: list[tuple[int, int, int]], k: int):
        self.k, self.wanted = k, wanted
        self.found: list[list[tuple[int, int, int]]] = [[] for _ in wanted]  # heaps of (score, -id, -row)
        self.of: dict[int, list[int]] = {}
        #: the least score that any wish of an anchor still takes, and the greatest
        self.floor, self.roof = np.full(size, HIGH), np.full(size, LOW)
        for n, (place, low, high) in enumerate(wanted):
            self.of.setdefault(place, []).append(n)
            self.floor[place], self.roof[place] = min(self.floor[place], low), max(self.roof[place], high)

    def least(self, n: int) -> int:
        return max(self.wanted[n][1], self.found[n][0][0]) if len(self.found[n]) == self.k else self.wanted[n][1]

    def offer(self, place: int, scores: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        for n in self.of[place]:
            heap, (_, _, high) = self.found[n], self.wanted[n]
            take = np.flatnonzero((scores >= self.least(n)) & (scores <= high))
            if len(take) > self.k:
                take = take[np.lexsort((rows[take], ids[take], -scores[take]))[: self.k]]
            for j in take.tolist():
                entry = (int(scores[j]), -int(ids[j]), -int(rows[j]))
                if len(heap) < self.k:
                    heapq.heappush(heap, entry)
                else:
                    heapq.heappushpop(heap, entry)
        self.floor[place] = min(map(self.least, self.of[place]))


def dual_search(anchors: Tree, wishes: Wishes, tree: Tree, same: bool) -> None:
    """Fill every wish from the rows of tree: those of the anchor's label (same), or of other labels.

    Pairs of nodes are taken by their greatest possible product, highest first.
    """
    kind, tick, todo = _exact(anchors.vectors, tree.vectors), count(), []

    def push(a: int, c: int) -> None:
        low, high = interval(float(anchors.centres[a] @ tree.centres[c]), anchors.norms[a], anchors.radii[a], tree.norms[c], tree.radii[c])
        heapq.heappush(todo, (-high, next(tick), low, a, c))

    def ruled_out(a: int, c: int, low: float, high: float) -> bool:
        if same:
            apart = anchors.highs[a] < tree.lows[c] or tree.highs[c] < anchors.lows[a]
        else:
            apart = anchors.lows[a] == anchors.highs[a] == tree.lows[c] == tree.highs[c]
        a0, a1 = anchors.nodes[a][:2]
        return apart or wishes.floor[a0:a1].min() > high or wishes.roof[a0:a1].max() < low

    push(0, 0)
    while todo:
        high, _, low, a, c = heapq.heappop(todo)
        if ruled_out(a, c, low, -high):
            continue
        (a0, a1, a_left, a_right), (c0, c1, c_left, c_right) = anchors.nodes[a], tree.nodes[c]
        if a_left >= 0 and (c_left < 0 or a1 - a0 >= c1 - c0):
            push(a_left, c)
            push(a_right, c)
        elif c_left >= 0:
            push(a, c_left)
            push(a, c_right)
        else:
            scores = _scores(anchors.vectors[a0:a1], tree.vectors[c0:c1], kind)
            equal = anchors.labels[a0:a1, None] == tree.labels[None, c0:c1]
            good = (equal if same else ~equal) & (anchors.rows[a0:a1, None] != tree.rows[None, c0:c1])
            good &= (scores >= wishes.floor[a0:a1, None]) & (scores <= wishes.roof[a0:a1, None])
            for i in np.flatnonzero(good.any(axis=1)).tolist():
                own = np.flatnonzero(good[i])
                wishes.offer(a0 + i, scores[i, own], tree.ids[c0 + own], tree.rows[c0 + own])


def numbered(rows: DataFrame) -> DataFrame:
    """(row, id, label, vector) with a number of its own for each row that takes part; checkpointed."""
    rows = rows.where("id is not null and label is not null and vector is not null and size(vector) > 0").select(F.col("id").cast("bigint").alias("id"), F.col("label").cast("bigint").alias("label"), F.col("vector").cast("array<bigint>").alias("vector"))
    return cut(rows.withColumn("row", F.monotonically_increasing_id()))


def _celled(rows: DataFrame) -> DataFrame:
    """rows with dims and a cell: the nearest two pivots of the vector's length, as one number.

    Cells only decide which rows share a block. Pivots come from at most SAMPLE rows,
    those with the smallest hashes of their numbers; other lengths have a single cell.
    """
    sample = [np.array(r[0], np.float64) for r in rows.orderBy(F.xxhash64("row")).select("vector").limit(SAMPLE).collect()]
    pivots: dict[int, np.ndarray] = {}
    for dims in {len(v) for v in sample}:
        points = np.array([v for v in sample if len(v) == dims])
        chosen = [0]
        apart = np.full(len(points), np.inf)
        while len(chosen) < min(PIVOTS, len(points)):
            apart = np.minimum(apart, ((points - points[chosen[-1]]) ** 2).sum(axis=1))
            chosen.append(int(apart.argmax()))
        pivots[dims] = points[chosen]
    sent = rows.sparkSession.sparkContext.broadcast(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(3).to_pylist()
            cells = np.zeros(len(vectors), np.int64)
            for dims in {len(v) for v in vectors} & sent.value.keys():
                own, p = np.array([i for i, v in enumerate(vectors) if len(v) == dims]), sent.value[dims]
                points = np.array([vectors[i] for i in own], np.float64)
                far = (p**2).sum(axis=1) - 2 * points @ p.T
                near = np.argsort(far, axis=1, kind="stable")[:, :2]
                cells[own] = near[:, 0] * PIVOTS + near[:, -1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([len(v) for v in vectors], pa.int32()), pa.array(cells)], names=["row", "id", "label", "vector", "dims", "cell"])

    return map_batches(rows.select("row", "id", "label", "vector"), run, "row bigint, id bigint, label bigint, vector array<bigint>, dims int, cell bigint")


#: A block: a summary, and its tree, which only Python reads.
_BLOCK = "block bigint, dims int, centre array<double>, radius double, low bigint, high bigint, tree binary"
_SUMMARY = ["block", "dims", "centre", "radius", "low", "high"]


def _blocks(celled: DataFrame, size: int, leaf: int) -> DataFrame:
    """Blocks of at most size rows of one length, near each other by label and cell; checkpointed."""
    many = max(1, -(-celled.count() // size))
    dealt = celled.repartitionByRange(many, "dims", "label", "cell", F.xxhash64("row")).sortWithinPartitions("dims", "label", "cell")
    names = [c.split()[0] for c in _BLOCK.split(", ")]
    kinds = [pa.int64(), pa.int32(), pa.list_(pa.float64()), pa.float64(), pa.int64(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def out() -> pa.RecordBatch:
            rows, ids, labels, vectors = (np.array(x, np.int64) for x in zip(*held, strict=True))
            held.clear()
            tree = Tree.grow(ids, rows, labels, vectors, leaf)
            made = [int(rows[0]), vectors.shape[1], tree.centres[0].tolist(), float(tree.radii[0]), int(labels.min()), int(labels.max()), pickle.dumps(tree)]
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(made, kinds, strict=True)], names=names)

        for batch in batches:
            for entry in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (len(held) == size or len(held[0][3]) != len(entry[3])):
                    yield out()
                held.append(entry)
        if held:
            yield out()

    return cut(map_batches(dealt.select("row", "id", "label", "vector"), run, _BLOCK))


def _pairs(anchors: DataFrame, blocks: DataFrame, same: bool) -> DataFrame:
    """(a_block, c_block) whose summaries alone do not rule each other out; anchors have least and most, the scores they ask for.

    Only summaries meet: those of all anchor blocks with a share of the candidate blocks in one task.
    """
    shares = max(1, -(-blocks.count() // SHARE))
    a = anchors.select(*(F.col(c).alias(f"a_{c}") for c in _SUMMARY), "least", "most").withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
    c = blocks.select(*(F.col(c).alias(f"c_{c}") for c in _SUMMARY)).withColumn("share", F.pmod(F.xxhash64("c_block"), F.lit(shares)))
    pairs = a.join(c, "share").where("a_dims = c_dims")
    if same:
        return pairs.where("a_low <= c_high and c_low <= a_high").select("a_block", "c_block")
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)
    norm = lambda x: F.sqrt(dot(x, x))
    low, high = interval(dot("a_centre", "c_centre"), norm("a_centre"), F.col("a_radius"), norm("c_centre"), F.col("c_radius"))
    pure = (F.col("a_low") == F.col("a_high")) & (F.col("c_low") == F.col("c_high")) & (F.col("a_low") == F.col("c_low"))
    return pairs.where(~pure & (high >= F.col("least")) & (low <= F.col("most"))).select("a_block", "c_block")


def _searched(anchors: DataFrame, blocks: DataFrame, same: bool, k: int) -> DataFrame:
    """(block, anchor, tag, score, id, row): for each wish at most k rows of each candidate block. wishes: (anchor row, tag, low, high)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.to_pylist():
                own, tree = pickle.loads(x["a_tree"]), pickle.loads(x["c_tree"])
                place = {int(r): i for i, r in enumerate(own.rows)}
                asked = x["wishes"] if x["wishes"] is not None else [{"anchor": r, "tag": 0, "low": LOW, "high": HIGH} for r in own.rows.tolist()]
                wishes = Wishes(len(own.rows), [(place[w["anchor"]], w["low"], w["high"]) for w in asked], k)
                dual_search(own, wishes, tree, same)
                out = [(x["a_block"], w["anchor"], w["tag"], s, -i, -r) for w, heap in zip(asked, wishes.found, strict=True) for s, i, r in heap]
                columns = list(zip(*out, strict=True)) or [[]] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["block", "anchor", "tag", "score", "id", "row"])

    met = _pairs(anchors, blocks, same).join(anchors.select(F.col("block").alias("a_block"), F.col("tree").alias("a_tree"), "wishes"), "a_block")
    met = met.join(blocks.select(F.col("block").alias("c_block"), F.col("tree").alias("c_tree")), "c_block")
    found = map_batches(met.select("a_block", "a_tree", "wishes", "c_tree"), run, "block bigint, anchor bigint, tag bigint, score bigint, id bigint, row bigint")
    best = Window.partitionBy("anchor", "tag").orderBy(F.desc("score"), "id", "row")  # at most k rows from each candidate block
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def mine(rows: DataFrame, anchors: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, least_share: int = LEAST_SHARE) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of the rows (id, label, vector) for which anchors holds.

    vector is an array of integers; a row's positives are its best rows of the same
    label, and a positive's negatives the best rows of other labels that score at
    least least_share hundredths of it, and no more than it.
    """
    celled = cut(_celled(numbered(rows)))
    blocks = _blocks(celled, BLOCK_ROWS, LEAF)
    own = celled.where(anchors)
    tiles = _blocks(own, ANCHOR_ROWS, ANCHOR_LEAF)
    none = F.lit(None).cast("array<struct<anchor: bigint, tag: bigint, low: bigint, high: bigint>>")
    near = cut(_searched(tiles.select("*", F.lit(0.0).alias("least"), F.lit(0.0).alias("most"), none.alias("wishes")), blocks, True, positives))
    asked = near.where("score >= 0").withColumn("low", F.expr(f"CAST((CAST(score AS decimal(38,0)) * {least_share} + 99) div 100 AS bigint)"))
    # wishes of a block: at most positives for each of its ANCHOR_ROWS anchors
    wishes = asked.groupBy("block").agg(F.min("low").cast("double").alias("least"), F.max("score").cast("double").alias("most"), F.collect_list(F.struct("anchor", F.col("rank").cast("bigint").alias("tag"), "low", F.col("score").alias("high"))).alias("wishes"))
    found = _searched(tiles.join(wishes, "block"), blocks, False, negatives)
    of = near.select("anchor", F.col("rank").cast("bigint").alias("tag"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    named = found.select("anchor", "tag", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")).join(of, ["anchor", "tag"])
    named = named.join(own.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id")), "anchor")
    return named.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


ORACLE_SQL = f"""
WITH v AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT a.r AS a, a.vec_id AS anchor_id, c.r AS c, c.vec_id, a.label = c.label AS same, CAST(list_dot_product(CAST(a.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM v a JOIN v c ON a.r <> c.r AND len(a.v) = len(c.v) WHERE a.vec_id % 100 = 0),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id, c) <= {POSITIVES})
SELECT p.anchor_id, p.vec_id AS positive_id, CAST(row_number() OVER (PARTITION BY p.a, p.c ORDER BY n.score DESC, n.vec_id, n.c) AS INTEGER) AS rank, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON n.a = p.a AND NOT n.same AND {LEAST_SHARE} * p.score <= 100 * n.score AND 100 * n.score <= 100 * p.score QUALIFY rank <= {NEGATIVES}
"""
