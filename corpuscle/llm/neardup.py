"""Embedding near-duplicates on a robust-pruned flat graph.

1. Equal vectors become one node with a weight. Nodes of a label are dealt to
   cells (nearest of some centroids that are fitted on a bounded sample), and
   cells to shards of about SHARD nodes.
2. Within its first shard every node joins a ball: a leader and nodes within
   half the link angle of it, so that any two members are linked by the triangle
   inequality. A group of near copies becomes a few balls; no pair is written out.
3. Graph over ball leaders: each leader goes to its OVERLAP nearest cells, each
   shard builds a robust-pruned graph with reverse edges and with every node
   reachable from the shard's medoid, and the adjacency lists of all shards are
   united.
4. Range-expanding search: each leader is searched greedily from the medoid of
   every shard of its cells (in its own shard also from itself); around what is in
   range, neighbours are expanded until no new one is in range. Union edges that
   leave a shard are followed by joins in the same manner.
   Two leaders are in range if their angle is at most the link angle plus both
   radii.
5. Ball pairs whose angle and radii settle all member pairs are counted as a
   whole; the others are verified member by member in double precision, in blocks.
6. Audit: for a bounded sample of the leaders of each label the pairs in range are
   found by brute force, each weighing as much as the links it stands for; a label
   below the target recall is searched again with more overlap. If the last search
   still is below it, all leaders of the label are compared in blocks: an exact way
   that costs their square.

Defined results: vectors that are null, empty, zero, or hold null or non-finite
components, and rows with a null label, link with nothing and are components of
their own; so are vectors of another length. Rows that repeat an id are vectors
of their own; equal rows link with each other. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuscle.llm.common import cut, join_facts, map_batches
from corpuscle.llm.components import components

COSINE = 0.93
#: Nodes of a shard, nearest cells of a leader, edges that pruning keeps, its slack, candidates per node, beam of the search.
SHARD, OVERLAP, DEGREE, SLACK, NEAREST, BEAM = 1500, 2, 16, 1.2, 48, 24
#: Bounds of the fitted part: centroids of a label, sampled vectors for each of them; nodes that meet the centroids in one group.
FIT_CELLS, FIT_LEAST, DEAL = 2048, 8, 20_000
#: Leaders of a label audited (and how many if none of them has a pair in range), least recall, and the largest overlap tried.
AUDIT, AUDIT_MORE, TARGET, MOST_OVERLAP = 256, 4096, 0.99, 8
#: Vectors of a block that meets another one.
BLOCK = 1024
_EDGE = 1e-9


def _angle(cosine: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosine, -1.0, 1.0))


def usable(rows: DataFrame) -> DataFrame:
    """The rows of (id, label, vector array<double>) that can link, with their vectors' norms."""
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))
    fit = F.col("label").isNotNull() & (F.size("vector") > 0) & ~F.coalesce(bad, F.lit(True))
    return rows.withColumn("norm", F.when(fit, norm)).withColumn("ok", F.coalesce((F.col("norm") > 0) & (F.col("norm") < float("inf")), F.lit(False)))


def nodes(rows: DataFrame) -> DataFrame:
    """(node, label, vector, weight, first, unit, dims) of the distinct vectors of usable rows."""
    found = rows.where("ok").groupBy("label", "vector", "norm").agg(F.count("*").alias("weight"), F.min("id").alias("first"))
    return cut(found.withColumn("node", F.monotonically_increasing_id()).withColumn("unit", F.expr("transform(vector, x -> x / norm)")).withColumn("dims", F.size("vector")).drop("norm"))


def centroids(found: DataFrame) -> DataFrame:
    """(key, centres, dims, deals): cell centres of every label of more than SHARD nodes, by rounds of spherical k-means on a bounded sample; checkpointed.

    A label's sample has FIT_LEAST vectors for each of its cells, of which it gets
    FIT_CELLS at most; each label is fitted in a task of its own. deals is the number
    of groups, of some DEAL nodes each, in which a label meets its centres.
    """
    sizes = found.groupBy(_key().alias("key")).agg(F.count("*").alias("n")).where(F.col("n") > SHARD)
    sizes = cut(sizes.withColumn("cells", F.least(F.lit(FIT_CELLS), F.ceil(F.col("n") / SHARD) + 1).cast("int")))
    hashed = F.xxhash64("unit").cast("double") / 2.0**64 + 0.5
    share = F.least(F.lit(1.0), F.greatest(F.lit(float(SHARD)), F.col("cells") * FIT_LEAST) / F.col("n"))
    weights = sizes.select("key", F.col("n").alias("weight"), "cells", share.alias("share"))
    drawn = join_facts(found.select(_key().alias("key"), "unit"), weights, ["key"], "weight", found.count()).where(hashed <= F.col("share"))

    def fit(own: pd.DataFrame) -> pd.DataFrame:
        v = np.array(sorted(map(tuple, own["unit"])))
        k = min(int(own["cells"].iloc[0]), max(1, len(v) // FIT_LEAST))
        c = v[np.random.default_rng(5).choice(len(v), k, replace=False)]
        for _ in range(6):
            near = (v @ c.T).argmax(axis=1)
            c = np.array([v[near == j].mean(axis=0) if (near == j).any() else c[j] for j in range(k)])
            c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
        return pd.DataFrame({"key": [own["key"].iloc[0]], "centres": [c.astype(np.float64).tobytes()], "dims": [c.shape[1]]})

    fitted = drawn.select("key", "cells", "unit").groupBy("key").applyInPandas(fit, "key string, centres binary, dims int")
    return cut(fitted.join(sizes.select("key", F.ceil(F.col("n") / DEAL).cast("int").alias("deals")), "key"))


def _key() -> Column:
    return F.concat_ws(":", F.col("label").cast("string"), F.col("dims"))


def deal(found: DataFrame, centres: DataFrame, overlap: int) -> DataFrame:
    """found with (place, cell, sub, subs): a row for each of the nearest cells; a cell has subs shards, of which the row's is sub.

    A group of nodes of one label meets the label's centres once; nothing is sent to every task.
    """
    rows = found.withColumn("key", _key())
    big = centres.select("key", F.col("deals").alias("weight"), "deals").withColumn("weight", F.col("weight") * DEAL)
    dealt = join_facts(rows.select("node", "key", "unit"), big, ["key"], "weight", found.count()).withColumn("deal", F.pmod(F.xxhash64("node"), F.col("deals")).cast("int")).select("node", "key", "unit", "deal")
    sent = centres.select(F.col("key").alias("of"), "centres", "dims", F.explode(F.expr("sequence(0, deals - 1)")).alias("part"))

    def near(nodes: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        if not len(nodes) or not len(own):
            return pd.DataFrame({"node": [], "place": [], "cell": []}).astype({"node": "int64", "place": "int32", "cell": "int32"})
        c = np.frombuffer(own["centres"].iloc[0]).reshape(-1, int(own["dims"].iloc[0]))
        best = np.argsort(-(np.stack(nodes["unit"].to_numpy()) @ c.T), axis=1, kind="stable")[:, :overlap]
        ids, places = nodes["node"].to_numpy(np.int64), best.shape[1]
        return pd.DataFrame({"node": np.repeat(ids, places), "place": np.tile(np.arange(places, dtype=np.int32), len(ids)), "cell": best.astype(np.int32).ravel()})

    cells = dealt.groupBy("key", "deal").cogroup(sent.groupBy("of", "part")).applyInPandas(near, "node bigint, place int, cell int")
    small = rows.select("node", "key").join(centres.select("key"), "key", "left_anti").select("node", F.lit(0).alias("place"), F.lit(0).alias("cell"))
    placed = cut(rows.join(cells.unionByName(small), "node"))
    subs = placed.groupBy("key", "cell").agg(F.count("*").alias("in_cell"), F.ceil(F.count("*") / SHARD).cast("int").alias("subs"))
    return join_facts(placed, subs, ["key", "cell"], "in_cell", placed.count()).withColumn("sub", F.pmod(F.xxhash64("node"), F.col("subs")).cast("int"))


def balls(dealt: DataFrame) -> DataFrame:
    """(node, ball, angle): the leader of each node's ball, at most half the link angle away."""
    reach = np.cos(np.arccos(COSINE) / 2 - 1e-6)

    def run(shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.sort_values("node")
        v, ids = np.stack(shard["unit"].to_numpy()), shard["node"].to_numpy()
        s = v @ v.T
        leader = np.full(len(ids), -1)
        for i in np.argsort(-(s >= reach).sum(axis=1), kind="stable"):  # those with most nodes in reach lead first
            if leader[i] < 0:
                own = (leader < 0) & (s[i] >= reach)
                own[i] = True
                leader[own] = i
        angle = np.where(leader == np.arange(len(ids)), 0.0, _angle(s[np.arange(len(ids)), leader]))
        return pd.DataFrame({"node": ids, "ball": ids[leader], "angle": angle})

    return dealt.select("key", "cell", "sub", "node", "unit").groupBy("key", "cell", "sub").applyInPandas(run, "node bigint, ball bigint, angle double")


def prune(s: np.ndarray) -> np.ndarray:
    """Out-neighbours (rows, DEGREE), -1 padded, by robust pruning on cosines s."""
    m = len(s)
    k = min(NEAREST, m - 1)
    if k <= 0:
        return np.full((m, 1), -1)
    rows = np.arange(m)[:, None]
    masked = s.copy()
    np.fill_diagonal(masked, -np.inf)
    near = np.argpartition(-masked, k - 1, axis=1)[:, :k]
    far = np.random.default_rng(3).integers(0, m, (m, 8))  # long edges, for the walk from afar
    cand = np.concatenate([near, far], axis=1)
    sim = masked[rows, cand]
    out = np.full((m, min(DEGREE, cand.shape[1])), -1)
    for t in range(out.shape[1]):
        best = sim.argmax(axis=1)
        some = sim[np.arange(m), best] > -np.inf
        chosen = np.where(some, cand[np.arange(m), best], -1)
        out[:, t] = chosen
        # a candidate goes if the chosen one is nearer to it, with slack, than the node is
        hidden = SLACK * (1 - s[chosen[:, None], cand]) <= 1 - sim
        sim[some & True] = np.where(hidden[some], -np.inf, sim[some])
        sim[np.arange(m), best] = -np.inf
    return out


def graph(shard: pd.DataFrame) -> pd.DataFrame:
    """(a, b) edges of one shard; (medoid, medoid) marks where a search starts."""
    shard = shard.sort_values("ball")
    ids, v = shard["ball"].to_numpy(), np.stack(shard["unit"].to_numpy())
    s = v @ v.T
    out = prune(s)
    a, b = np.repeat(np.arange(len(ids)), out.shape[1]), out.ravel()
    a, b = a[b >= 0], b[b >= 0]
    medoid = int(s.sum(axis=1).argmax())
    # of the edges that come back, a node keeps the DEGREE nearest, so hubs stay small
    order = np.lexsort((a, -s[b, a], b))
    turned = b[order]
    rank = np.arange(len(turned)) - np.searchsorted(turned, turned)
    back = order[rank < DEGREE]
    a, b = np.r_[a, b[back]], np.r_[b, a[back]]
    reached, front = np.zeros(len(ids), bool), np.array([medoid])
    while True:
        reached[front] = True
        step = np.zeros(len(ids), bool)
        step[b[reached[a]]] = True
        front = np.nonzero(step & ~reached)[0]
        if not len(front):
            lost = np.nonzero(~reached)[0]
            if not len(lost):
                break
            # tie the nearest unreached node to its nearest reached one
            i, j = np.unravel_index(s[np.ix_(lost, np.nonzero(reached)[0])].argmax(), (len(lost), int(reached.sum())))
            x, y = lost[i], np.nonzero(reached)[0][j]
            a, b, front = np.r_[a, x, y], np.r_[b, y, x], np.array([x])
    edges = np.unique(np.stack([ids[np.r_[a, medoid]], ids[np.r_[b, medoid]]], axis=1), axis=0)
    return pd.DataFrame({"a": edges[:, 0], "b": edges[:, 1]})


def _search(index: pd.DataFrame, queries: pd.DataFrame, own: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, node, cosine) positions in range, by greedy search from the medoid and range expansion."""
    ids, v, radius = index["ball"].to_numpy(), np.stack(index["unit"].to_numpy()), index["radius"].to_numpy()
    q, q_radius = np.stack(queries["unit"].to_numpy()), queries["radius"].to_numpy()
    place = {b: i for i, b in enumerate(ids)}
    local = [[place[b] for b in x if b in place and b != a] for a, x in zip(ids, index["next"], strict=True)]
    width = max(1, max(map(len, local)))
    adjacent = np.full((len(ids), width), -1)
    for i, x in enumerate(local):
        adjacent[i, : len(x)] = x
    starts = [i for i, (a, x) in enumerate(zip(ids, index["next"], strict=True)) if a in x] or [0]
    n, link = len(q), np.arccos(COSINE)
    rows = np.arange(n)
    beam = np.tile(np.array(starts[:4]), (n, 1))
    if own:  # queries and index are the same shard: a leader also starts from itself
        at = np.array([place.get(b, starts[0]) for b in queries["ball"]])
        beam = np.concatenate([np.where((beam == at[:, None]), -1, beam), at[:, None]], axis=1)
    seen = np.zeros((n, len(ids) + 1), bool)  # the last column stands for no node
    seen[:, -1] = True
    np.put_along_axis(seen, beam, True, axis=1)
    cosine = np.where(beam >= 0, np.einsum("nd,nkd->nk", q, v[beam]), -np.inf)
    expanded = beam < 0
    found = [(np.repeat(rows, beam.shape[1]), beam.ravel(), cosine.ravel())]
    active = rows
    while len(active):
        todo = np.where(expanded[active], -np.inf, cosine[active])
        best = todo.argmax(axis=1)
        alive = todo[np.arange(len(active)), best] > -np.inf
        active, best = active[alive], best[alive]
        if not len(active):
            break
        expanded[active, best] = True
        nxt = adjacent[beam[active, best]]
        new = ~np.take_along_axis(seen[active], nxt, axis=1)
        r, c = np.nonzero(new)
        o, who = nxt[r, c], active[r]
        seen[who, o] = True
        sim = np.einsum("kd,kd->k", q[who], v[o])
        found.append((who, o, sim))
        wide = np.full(nxt.shape, -np.inf)
        wide[r, c] = sim
        merged, at = np.concatenate([cosine[active], wide], axis=1), np.concatenate([beam[active], nxt], axis=1)
        done = np.concatenate([expanded[active], ~new], axis=1)
        keep = np.argsort(-merged, axis=1, kind="stable")[:, :BEAM]
        if beam.shape[1] < keep.shape[1]:
            grow = keep.shape[1] - beam.shape[1]
            beam = np.pad(beam, ((0, 0), (0, grow)), constant_values=-1)
            cosine, expanded = np.pad(cosine, ((0, 0), (0, grow)), constant_values=-np.inf), np.pad(expanded, ((0, 0), (0, grow)), constant_values=True)
        k = keep.shape[1]
        beam[active, :k], cosine[active, :k], expanded[active, :k] = (np.take_along_axis(x, keep, axis=1) for x in (at, merged, done))
    who, o, sim = (np.concatenate(x) for x in zip(*found, strict=True))
    inside = (o >= 0) & (_angle(sim) <= link + q_radius[who] + radius[o] + _EDGE)
    hits = [(who[inside], o[inside], sim[inside])]
    front = hits[0]
    while len(front[0]):
        nxt = adjacent[front[1]]
        r, c = np.nonzero(~seen[front[0][:, None], nxt])
        pairs = np.unique(np.stack([front[0][r], nxt[r, c]], axis=1), axis=0)
        seen[pairs[:, 0], pairs[:, 1]] = True
        sim = np.einsum("kd,kd->k", q[pairs[:, 0]], v[pairs[:, 1]])
        ok = _angle(sim) <= link + q_radius[pairs[:, 0]] + radius[pairs[:, 1]] + _EDGE
        front = (pairs[ok, 0], pairs[ok, 1], sim[ok])
        hits.append(front)
    return tuple(np.concatenate(x) for x in zip(*hits, strict=True))


def search(placed: DataFrame, adjacency: DataFrame) -> DataFrame:
    """(a, b) distinct leader pairs in range, found by the graph, with a < b."""
    rows = placed.join(adjacency, "ball")
    every = F.explode(F.sequence(F.lit(0), F.col("subs") - 1))
    index = rows.withColumn("part", every).select("key", "cell", "sub", "part", F.lit(True).alias("is_index"), "ball", "unit", "radius", "next")
    query = rows.withColumn("other", every).select("key", "cell", F.col("other").alias("sub"), F.col("sub").alias("part"), F.lit(False).alias("is_index"), "ball", "unit", "radius", F.lit(None).cast("array<bigint>").alias("next"))

    def run(key: tuple, task: pd.DataFrame) -> pd.DataFrame:
        index, queries = (task[task["is_index"] == x].sort_values("ball") for x in (True, False))
        if not len(index) or not len(queries):
            return pd.DataFrame({"a": [], "b": [], "inside": []}).astype({"a": "int64", "b": "int64", "inside": "bool"})
        who, o, _ = _search(index, queries, key[2] == key[3])
        q, ids = queries["ball"].to_numpy(), index["ball"].to_numpy()
        here = set(ids)
        out = [(q[i], ids[j], True) for i, j in zip(who, o, strict=True) if q[i] != ids[j]]
        nxt = index["next"].to_list()
        out += [(q[i], b, False) for i, j in zip(who, o, strict=True) for b in nxt[j] if b not in here and b != q[i]]
        out = list(dict.fromkeys(out))
        return pd.DataFrame({"a": [x[0] for x in out], "b": [x[1] for x in out], "inside": [x[2] for x in out]}).astype({"a": "int64", "b": "int64", "inside": "bool"})

    found = cut(index.unionByName(query).groupBy("key", "cell", "sub", "part").applyInPandas(run, "a bigint, b bigint, inside boolean"))
    ordered = lambda df: df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
    inside, outside = cut(ordered(found.where("inside"))), ordered(found.where("not inside"))
    leaders = placed.where("place = 0").select("ball", "key", "unit", "radius")
    while True:  # edges of the union that leave the shard
        fresh = outside.join(inside, ["a", "b"], "left_anti")
        near = fresh.join(leaders.select(F.col("ball").alias("a"), F.col("key").alias("ka"), F.col("unit").alias("ua"), F.col("radius").alias("ra")), "a").join(leaders.select(F.col("ball").alias("b"), F.col("key").alias("kb"), F.col("unit").alias("ub"), F.col("radius").alias("rb")), "b").where("ka = kb")
        near = cut(near.where(f"acos(greatest(-1D, least(1D, aggregate(zip_with(ua, ub, (x, y) -> x * y), 0D, (s, x) -> s + x)))) <= acos({COSINE}D) + ra + rb + {_EDGE}").select("a", "b"))
        if near.isEmpty():
            return inside
        inside = cut(inside.unionByName(near))
        both = near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b")))
        outside = ordered(both.join(adjacency.select(F.col("ball").alias("b"), F.explode("next").alias("c")), "b").select("a", F.col("c").alias("b")))


def _in_range(cosine: np.ndarray, r: np.ndarray, s: np.ndarray) -> np.ndarray:
    return _angle(cosine) <= np.arccos(COSINE) + r + s + _EDGE


def audit(leaders: DataFrame, found: DataFrame) -> DataFrame:
    """(key): the labels of which the search has too small a share of the links that a sample of leaders stands for, found by brute force; checkpointed.

    Every label is audited on its own, by AUDIT of its leaders, or all of them if it has
    no more. Where none of them has a pair in range, AUDIT_MORE are tried. A label in
    which none of these has one either is left as it is: at 95 % confidence fewer than
    3 in AUDIT_MORE of its leaders have a pair in range, and the search found what it found.
    """
    first = _audit(leaders, found, AUDIT)
    blind = cut(first.where(f"n = 0 and sampled >= {AUDIT}").select("key"))
    bad = first.where((F.col("n") > 0) & (F.col("hit") < TARGET * F.col("n"))).select("key")
    if not blind.isEmpty():
        again = _audit(leaders.join(blind, "key", "left_semi"), found, AUDIT_MORE)
        bad = bad.unionByName(again.where((F.col("n") > 0) & (F.col("hit") < TARGET * F.col("n"))).select("key"))
    return cut(bad)


def _audit(leaders: DataFrame, found: DataFrame, size: int) -> DataFrame:
    """(key, sampled, n, hit) of every label: its leaders in the sample, the links between balls of pairs in range of them, and those of pairs that were found."""
    ranked = leaders.select("key", "ball", "unit", "radius").withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy(F.xxhash64("ball"), "ball")))
    sample = ranked.where(F.col("n") <= size).select("key", F.lit(0).alias("chunk"), "ball", "unit", "radius")
    asked = cut(sample.groupBy("key", "chunk").applyInPandas(_pack, _PACKED))  # at most AUDIT_MORE vectors of a label
    met = _packed(leaders).join(asked.withColumnsRenamed({c: f"{c}_b" for c in ("ids", "radii", "units")}).drop("chunk"), "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.to_pylist():
                a, b = _close(x)
                yield pa.RecordBatch.from_arrays([pa.array([x["key"]] * len(a), pa.string()), pa.array(a), pa.array(b)], names=["key", "a", "b"])

    true = map_batches(met.select("key", "ids", "radii", "units", "ids_b", "radii_b", "units_b"), run, "key string, a bigint, b bigint").distinct()
    side = lambda x: leaders.select(F.col("ball").alias(x), F.col("total").cast("double").alias(f"t{x}"))
    weighed = true.join(side("a"), "a").join(side("b"), "b").join(found.withColumn("got", F.lit(True)), ["a", "b"], "left").withColumn("links", F.col("ta") * F.col("tb"))
    per = weighed.groupBy("key").agg(F.sum("links").alias("n"), F.coalesce(F.sum(F.when(F.col("got"), F.col("links"))), F.lit(0.0)).alias("hit"))
    counts = sample.groupBy("key").agg(F.count("*").alias("sampled"))
    return cut(counts.join(per, "key", "left").select("key", "sampled", F.coalesce("n", F.lit(0.0)).alias("n"), F.coalesce("hit", F.lit(0.0)).alias("hit")))


_PACKED = "key string, chunk int, ids binary, radii binary, units binary"


def _pack(own: pd.DataFrame) -> pd.DataFrame:
    one = {c: [own[c].iloc[0]] for c in ("key", "chunk")}
    return pd.DataFrame(one | {"ids": [own["ball"].to_numpy(np.int64).tobytes()], "radii": [own["radius"].to_numpy(np.float64).tobytes()], "units": [np.stack(own["unit"].to_numpy()).astype(np.float64).tobytes()]})


def _packed(leaders: DataFrame) -> DataFrame:
    """(key, chunk, ids, radii, units): a label's leaders in blocks of some BLOCK rows; checkpointed."""
    sizes = leaders.groupBy("key").agg(F.count("*").alias("n")).withColumn("chunks", F.ceil(F.col("n") / BLOCK).cast("int"))
    dealt = join_facts(leaders.select("ball", "key", "unit", "radius"), sizes, ["key"], "n", leaders.count()).withColumn("chunk", F.pmod(F.xxhash64("ball"), F.col("chunks")).cast("int"))
    return cut(dealt.select("key", "chunk", "ball", "unit", "radius").groupBy("key", "chunk").applyInPandas(_pack, _PACKED))


def _close(x: dict) -> tuple[np.ndarray, np.ndarray]:
    """(a, b) of the pairs in range of two blocks, with a < b."""
    ia, ib = (np.frombuffer(x[c], np.int64) for c in ("ids", "ids_b"))
    ra, rb = (np.frombuffer(x[c]) for c in ("radii", "radii_b"))
    ua, ub = np.frombuffer(x["units"]).reshape(len(ia), -1), np.frombuffer(x["units_b"]).reshape(len(ib), -1)
    i, j = np.nonzero(_in_range(ua @ ub.T, ra[:, None], rb[None]))
    a, b = np.minimum(ia[i], ib[j]), np.maximum(ia[i], ib[j])
    return a[a < b], b[a < b]


def every_pair(leaders: DataFrame) -> DataFrame:
    """(a, b) all leader pairs in range, with a < b: every block of a label meets every other one."""
    blocks = _packed(leaders)
    other = blocks.withColumn("chunk", F.explode(F.expr("sequence(0, chunk)"))).withColumnsRenamed({c: f"{c}_b" for c in ("ids", "radii", "units")})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.to_pylist():
                a, b = _close(x)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return cut(map_batches(blocks.join(other, ["key", "chunk"]), run, "a bigint, b bigint").distinct())


def _members(pairs: DataFrame, members: DataFrame, leaders: DataFrame, total: int) -> DataFrame:
    """(node, n, a, b): links of members of undecided ball pairs, counted in blocks."""

    def pack(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("node")
        return pd.DataFrame({"ball": [own["ball"].iloc[0]], "ids": [own["node"].to_numpy(np.int64).tobytes()], "weights": [own["weight"].to_numpy(np.int64).tobytes()], "units": [np.stack(own["unit"].to_numpy()).astype(np.float64).tobytes()]})

    need = pairs.select(F.col("a").alias("ball")).unionByName(pairs.select(F.col("b").alias("ball"))).distinct()
    sizes = leaders.join(need, "ball").select("ball", "members", F.ceil(F.col("members") / BLOCK).cast("int").alias("chunks"))
    dealt = join_facts(members, sizes, ["ball"], "members", total).withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")))
    blocks = cut(dealt.select("ball", "chunk", "node", "weight", "unit").groupBy("ball", "chunk").applyInPandas(pack, "ball bigint, ids binary, weights binary, units binary"))
    side = lambda x: blocks.select(F.col("ball").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in ("ids", "weights", "units")))
    met = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for x in batch.to_pylist():
                ia, ib, wa, wb = (np.frombuffer(x[c], np.int64) for c in ("ids_a", "ids_b", "weights_a", "weights_b"))
                ua, ub = (np.frombuffer(x[c]).reshape(len(i), -1) for c, i in (("units_a", ia), ("units_b", ib)))
                linked = ua @ ub.T >= COSINE
                for ids, n in ((ia, linked @ wb), (ib, wa @ linked)):
                    out += [(int(i), int(c), x["a"], x["b"]) for i, c in zip(ids[n > 0], n[n > 0], strict=True)]
            columns = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["node", "n", "a", "b"])

    return map_batches(met, run, "node bigint, n bigint, a bigint, b bigint")


def near_duplicates(rows: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label") -> DataFrame:
    """(id, n_links, component_id) for every row; component_id is the smallest id reachable over links."""
    rows = usable(rows.select(F.col(id_column).alias("id"), F.col(label_column).alias("label"), F.col(vector_column).cast("array<double>").alias("vector")))
    found = nodes(rows)
    total = found.count()
    centres = centroids(found)
    of = cut(balls(deal(found, centres, 1)))
    members = cut(of.join(found.select("node", "weight", "first", "unit", "label", "dims"), "node"))
    facts = members.groupBy("ball").agg(F.max("angle").alias("radius"), F.sum("weight").alias("total"), F.min("first").alias("first"), F.count("*").alias("members"))
    leaders = cut(facts.join(members.where("node = ball").select("ball", "unit", "label", "dims"), "ball"))
    overlap, left, parts = OVERLAP, leaders, []
    while True:
        placed = cut(deal(left.withColumn("node", F.col("ball")), centres, overlap).drop("node"))
        edges = placed.select("key", "cell", "sub", "ball", "unit").groupBy("key", "cell", "sub").applyInPandas(graph, "a bigint, b bigint")
        adjacency = cut(edges.groupBy(F.col("a").alias("ball")).agg(F.collect_set("b").alias("next")))
        pairs, own = search(placed, adjacency), placed.where("place = 0")
        failing = audit(own, pairs)
        if failing.isEmpty():
            parts.append(pairs)
            break
        good = own.join(failing, "key", "left_anti").select(F.col("ball").alias("a"))
        parts.append(cut(pairs.join(good, "a", "left_semi")))
        if overlap >= MOST_OVERLAP:
            parts.append(every_pair(own.join(failing, "key", "left_semi")))
            break
        overlap *= 2
        left = cut(left.withColumn("key", _key()).join(failing, "key", "left_semi").drop("key"))  # labels that are found well enough are done
    pairs = reduce(DataFrame.unionByName, parts)
    facts = leaders.select("ball", "unit", "radius", "total")
    named = lambda x: facts.select(F.col("ball").alias(x), F.col("unit").alias(f"u{x}"), F.col("radius").alias(f"r{x}"), F.col("total").alias(f"t{x}"))
    cosine = "aggregate(zip_with(ua, ub, (x, y) -> x * y), 0D, (s, x) -> s + x)"
    judged = pairs.join(named("a"), "a").join(named("b"), "b").selectExpr("a", "b", "ta", "tb", "ra", "rb", f"{cosine} c").withColumn("angle", F.expr("acos(greatest(-1D, least(1D, c)))"))
    alone = "(ra = 0 and rb = 0)"
    judged = cut(judged.withColumn("all", F.expr(f"case when {alone} then c >= {COSINE}D else angle + ra + rb <= acos({COSINE}D) - {_EDGE} end")))
    whole = judged.where("all")
    some = cut(_members(judged.where(f"not all and not {alone}"), members.select("ball", "node", "weight", "unit"), leaders, total))
    by_ball = whole.select(F.col("a").alias("ball"), F.col("tb").alias("n")).unionByName(whole.select(F.col("b").alias("ball"), F.col("ta").alias("n"))).groupBy("ball").agg(F.sum("n").alias("outer"))
    by_node = some.groupBy("node").agg(F.sum("n").alias("partial"))
    roots = components(whole.select("a", "b").unionByName(some.select("a", "b").distinct()))
    least = roots.join(leaders.select(F.col("ball").alias("node"), "first"), "node").groupBy("root").agg(F.min("first").alias("least"))
    component = roots.join(least, "root").select(F.col("node").alias("ball"), "least")
    per_ball = cut(leaders.select("ball", "members", "total", "first").join(by_ball, "ball", "left").join(component, "ball", "left"))
    counted = join_facts(members.select("node", "ball"), per_ball, ["ball"], "members", total).join(by_node, "node", "left")
    counted = counted.select("node", (F.col("total") - 1 + F.coalesce("outer", F.lit(0)) + F.coalesce("partial", F.lit(0))).alias("n_links"), F.coalesce("least", "first").alias("component_id"))
    per_vector = cut(found.select("node", "label", "vector", "weight").join(counted, "node").drop("node"))
    linked = join_facts(rows.where("ok").select("id", "label", "vector"), per_vector, ["label", "vector"], "weight", rows.count()).select("id", F.col("n_links").cast("bigint").alias("n_links"), "component_id")
    return linked.unionByName(rows.where("not ok").select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id")))
