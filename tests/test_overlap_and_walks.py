from __future__ import annotations

import random

from corpuscle import plans
from corpuscle.operators import graph, overlap


def test_shared_items_of_blocks_equal_those_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(overlap, "BLOCK", 4)
    draw = random.Random(7)
    rows = [(draw.randrange(3), m, draw.choice([1, 2, 3, 10**15, -5]) if draw.random() < 0.5 else draw.randrange(60)) for m in range(60) for _ in range(6)]
    rows = [(m % 3, m, i) for _, m, i in rows] + [(0, 0, None), (None, 3, 1), (1, None, 1)]
    held: dict = {}
    for g, m, i in rows:
        if None not in (g, m, i):
            held.setdefault((g, m), set()).add(i)
    want = {(a, b, n) for (g, a), x in held.items() for (h, b), y in held.items() if g == h and a < b and (n := len(x & y))}
    found = [tuple(r) for r in overlap.shared_items(spark.createDataFrame(rows, "g long, m long, i long"), "g", "m", "i").collect()]
    assert set(found) == want and len(found) == len(want)


def test_thread_conflicts_shuffles_no_pairs(spark):
    plan = plans.QUERIES["thread_conflicts"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(a#" not in plan


def _rounds(monkeypatch) -> list:
    made: list = []
    real = graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: made.append(df._jdf.queryExecution().executedPlan().toString()) or real(df))
    return made


def test_a_walk_leaves_the_edges_where_they_are(spark, monkeypatch):
    made = _rounds(monkeypatch)
    edges = spark.createDataFrame([("a", "b"), ("a", "b"), ("b", "c"), ("d", "c")], "src string, dst string")
    seed = spark.createDataFrame([("a",)], "node string")
    assert {(r.node, r.hop, r.parent) for r in graph.bfs(edges, seed).collect()} == {("a", 0, None), ("b", 1, "a"), ("c", 2, "b"), ("d", 3, "c")}
    assert "Exchange" not in made[0] and not any("hashpartitioning(src#" in p for p in made)


def test_a_large_frontier_is_joined_by_shuffle_with_the_same_levels(spark, monkeypatch):
    monkeypatch.setattr(graph, "NEAR", 0)
    edges = spark.createDataFrame([("a", "b"), ("a", "b"), ("b", "c"), ("d", "c")], "src string, dst string")
    assert {(r.node, r.hop) for r in graph.bfs(edges, spark.createDataFrame([("a",)], "node string")).collect()} == {("a", 0), ("b", 1), ("c", 2), ("d", 3)}


def test_a_search_ends_at_the_first_level_with_a_target(spark, monkeypatch):
    made = _rounds(monkeypatch)
    edges = spark.createDataFrame([(str(i), str(i + 1)) for i in range(6)], "src string, dst string")
    assert [r.node for r in graph.shortest_path(edges, "0", "2").orderBy("hop").collect()] == ["0", "1", "2"]
    assert len(made) == 4  # the edges, the start and two levels
