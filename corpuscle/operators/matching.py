"""Greedy one-to-one matching of candidates with what they would replace."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuscle.shared import cut

#: What a replacement must gain, and what each further token costs.
LEAST_GAIN, TOKEN_COST = 55.0, 0.04
#: Rows of a group that meet in a round, at first, on either side.
FRONTIER = 8192


def _places(ids: list) -> tuple[np.ndarray, np.ndarray]:
    """The rows in order of their ids, and the place of each one's id among the distinct ids."""
    place = {x: n for n, x in enumerate(sorted(set(ids)))}
    own = np.array([place[x] for x in ids], np.int64)
    order = np.argsort(own, kind="stable")
    return order, own[order]


def match_frontier(left: pa.Table, right: pa.Table, least: float, cost: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(left rows, right rows, gains, tokens more) of the sorted loop, as far as a pair gains at least `least` and more than any bound of the rows.

    Each candidate keeps its best incumbent; one that was taken meanwhile is looked for
    again when its candidate comes first. Memory is that of the rows, never of the pairs.
    """
    (c_rows, cid), (i_rows, iid) = _places(left["id"].to_pylist()), _places(right["id"].to_pylist())
    column = lambda t, name, rows: t[name].to_numpy()[rows]
    v, t, rank = (column(left, n, c_rows) for n in ("value", "tokens", "rank"))
    w, u = (column(right, n, i_rows) for n in ("value", "tokens"))
    edge = max((x for side in (left, right) for x in side["bound"].to_pylist() if x is not None), default=-np.inf)
    free = np.ones(len(w), bool)

    def best(n: int) -> tuple | None:
        gain = np.where(free, v[n] - w - np.maximum(0, t[n] - u) * cost, -np.inf)
        most = gain.max(initial=-np.inf)
        if not (most >= least and most > edge):
            return None
        few = np.flatnonzero(gain == most)
        m = few[np.argmin(t[n] - u[few])]  # of equal ones the first, which has the least id
        return -most, int(t[n] - u[m]), int(rank[n]), int(cid[n]), int(iid[m]), n, int(m)

    heap = [x for n in range(len(v)) if (x := best(n))]
    heapq.heapify(heap)
    used, taken = set(), []
    while heap:
        less, more, _, candidate, incumbent, n, m = heap[0]
        if candidate in used:
            heapq.heappop(heap)
        elif not free[m]:
            again = best(n)
            heapq.heapreplace(heap, again) if again else heapq.heappop(heap)
        else:
            heapq.heappop(heap)
            used.add(candidate)
            free &= iid != incumbent
            taken.append((c_rows[n], i_rows[m], -less, more))
    a, b, gains, more = zip(*taken, strict=True) if taken else ((), (), (), ())
    return np.array(a, np.int64), np.array(b, np.int64), np.array(gains, np.float64), np.array(more, np.int64)


def greedy_matching(candidates: DataFrame, incumbents: DataFrame, least: float = LEAST_GAIN, cost: float = TOKEN_COST, frontier: int = FRONTIER) -> DataFrame:
    """(g, candidate, incumbent, gain, more): candidates(g, id, value, tokens, rank) matched one-to-one with incumbents(g, id, value, tokens).

    A pair gains the difference of values less `cost` for each token that the candidate
    has more. Of the pairs that gain at least `least` the best comes first (by gain,
    then fewer tokens more, then rank, then ids), and each row is used once: the result
    of a loop over the sorted pairs.

    No group is crossed with itself whole. A row can gain no more than it would with the
    least value, and with the least value and tokens, of the other side; rows that
    cannot gain enough go at once. Only the `frontier` rows of either side that could
    gain most meet, in the sorted loop, as long as pairs gain more than any row beyond
    them could. The next round goes on without what was taken. A frontier doubles up to
    FRONTIER, and beyond it if a round takes none of its group. Rows without tokens or value take no part.
    """
    usable = "g is not null and id is not null and value is not null and not isnan(cast(value as double)) and tokens > 0"
    side = lambda df, *more: df.where(usable).select("g", "id", F.col("value").cast("double").alias("value"), F.col("tokens").cast("bigint").alias("tokens"), *more).withColumn("net", F.col("value") - F.col("tokens") * F.lit(cost))
    c = cut(side(candidates, F.coalesce(F.col("rank").cast("bigint"), F.lit(999_999)).alias("rank")))
    i = cut(side(incumbents))
    width = cut(c.select("g").intersect(i.select("g")).withColumn("width", F.lit(frontier).cast("bigint")))
    none = "g {g}, candidate {c}, incumbent {i}, gain double, more bigint".format(g=c.schema["g"].dataType.simpleString(), c=c.schema["id"].dataType.simpleString(), i=i.schema["id"].dataType.simpleString())
    done = c.sparkSession.createDataFrame([], none)

    def fold(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.rename_columns([x[2:] for x in right.column_names])
        a, b, gain, more = match_frontier(left, right, least, cost)
        return pa.table({"g": left["g"].take(a), "candidate": left["id"].take(a), "incumbent": right["id"].take(b), "gain": gain, "more": more})

    while not width.isEmpty():
        # what rounding may add to a sum of these
        size = lambda df: df.groupBy("g").agg(F.max(F.abs("value") + F.col("tokens") * F.lit(cost)).alias("size"))
        slack = size(c).join(size(i).withColumnRenamed("size", "other"), "g").select("g", ((F.col("size") + F.col("other")) * 1e-9).alias("slack"))
        lowest = i.groupBy("g").agg(F.min("value").alias("v"), F.min("net").alias("n")).join(slack, "g").join(width, "g")
        highest = c.groupBy("g").agg(F.max("value").alias("v"), F.max("net").alias("n")).join(slack, "g").join(width, "g")
        reach = lambda a, b: (F.least(F.col(a) - F.col(b), F.col("net") - F.col("n")) if a == "value" else F.least(F.col(a) - F.col(b), F.col("n") - F.col("net"))) + F.col("slack")
        order = Window.partitionBy("g").orderBy(F.desc("reach"), "id")
        near = lambda df, ends, a, b: df.join(ends, "g").withColumn("reach", reach(a, b)).where(F.col("reach") >= least).withColumn("at", F.row_number().over(order)).where(F.col("at") <= F.col("width") + 1).select(*df.columns, "reach", "at", "width")
        left, right = cut(near(c, lowest, "value", "v")), cut(near(i, highest, "v", "value"))
        beyond = left.select("g", "at", "width", "reach").unionByName(right.select("g", "at", "width", "reach")).where("at > width").groupBy("g").agg(F.max("reach").alias("bound"))
        beyond = cut(beyond)
        met = lambda df: df.where("at <= width").join(beyond, "g", "left").drop("reach", "at", "width")
        other = met(right).select(*(F.col(x).alias(f"i_{x}") for x in ("g", "id", "value", "tokens", "bound")))  # both sides may come of one table
        taken = cut(met(left).groupBy("g").cogroup(other.groupBy("i_g")).applyInArrow(fold, none))
        done = done.unionByName(taken)
        c = cut(c.join(taken.select("g", F.col("candidate").alias("id")), ["g", "id"], "left_anti"))
        i = cut(i.join(taken.select("g", F.col("incumbent").alias("id")), ["g", "id"], "left_anti"))
        # a group goes on while rows beyond its frontier could still gain enough
        some = taken.groupBy("g").agg(F.count("*").alias("taken"))
        width = cut(width.join(beyond, "g").join(some, "g", "left").select("g", F.when(F.col("taken").isNull() | (F.col("width") < FRONTIER), F.col("width") * 2).otherwise(F.col("width")).alias("width")))
    return done
