"""The chain of boosts: its order, its hubs and odd input; the whole chain is held against SQL with the other plans."""

import pytest
from pyspark.sql import functions as F

from corpuscle import shared
from corpuscle.operators import boosts

ROWS = "g string, path string, score double, reasons array<string>, changed boolean, skipped boolean, workspace string, api_path string, calls array<string>"


def context(spark, near=(), keywords=("order",), **given):
    empty = {"edges": "g string, src string, dst string, type string, edge_key string", "workspaces": "g string, root string", "needs": "g string, root string, dep string", "noise": "g string, path string, n long", "feedback": "g string, path string, amount double"}
    tables = {k: spark.createDataFrame(given.get(k, []), ddl) for k, ddl in empty.items()}
    tasks = spark.createDataFrame([("g", list(keywords), ["web"], 0.5)], "g string, keywords array<string>, words array<string>, generic_ratio double")
    return boosts.Context(tasks=tasks, near=spark.createDataFrame([("g", a, b) for a, b in near], "g string, a string, b string"), **tables)


def row(path, score=0.0, reasons=(), changed=False, skipped=False, workspace=None, api_path=None, calls=()):
    return ("g", path, score, list(reasons), changed, skipped, workspace, api_path, list(calls))


def scores(df):
    return {r["path"]: (r["score"], r["reasons"]) for r in df.collect()}


def test_each_pass_reads_the_ones_before(spark):
    near = [("src/order.py", "src/a.py"), ("src/a.py", "tests/test_order.py"), ("src/a.py", "src/far.py"), ("src/a.py", "cfg/app.toml")]
    rows = [row("src/order.py", 130.0), row("src/a.py"), row("tests/test_order.py"), row("src/far.py"), row("cfg/app.toml"), row("src/skip.py", 500.0, skipped=True)]
    table, c = boosts.candidates(spark.createDataFrame(rows, ROWS)), context(spark, near)
    found = scores(boosts.chain(table, c))
    assert found["src/a.py"] == (24.0, ["recall neighbor of src/order.py"])
    assert found["tests/test_order.py"] == (51.0, ["second-pass related test of src/order.py", "test for high-scoring src/order.py"])
    # another order is another result
    late = (boosts.second_pass, *(p for p in boosts.CHAIN if p not in (boosts.second_pass, boosts.tests)), boosts.tests)
    moved = scores(boosts.chain(table, c, (boosts.tests, *late[:-1])))
    assert moved != found and moved["tests/test_order.py"][1][0] == "test for high-scoring src/order.py"
    assert found["cfg/app.toml"][1] == ["second-pass recall neighbor of src/order.py"] and found["src/far.py"] == (0.0, [])
    # a test that the second pass has not named yet gains from its source
    alone = scores(boosts.chain(boosts.candidates(spark.createDataFrame([row("src/order.py", 10.0), row("tests/test_order.py")], ROWS)), context(spark)))
    assert alone["tests/test_order.py"] == (35.0, ["test for high-scoring src/order.py"])


def test_workspaces_history_and_feedback(spark):
    rows = [row("packages/web/a.py", 5.0, workspace="packages/web"), row("lib/b.py", 5.0, workspace="lib"), row("api/c.py", 5.0, workspace="api"), row("x/d.py", 50.0, ["other"]), row("x/e.py", 50.0, ["config file"]), row("x/f.py", 50.0, ["filename keyword match"]), row("x/h.py", 50.0, changed=True)]
    c = context(spark, workspaces=[("g", w) for w in ("packages/web", "lib", "api")], needs=[("g", "packages/web", "lib"), ("g", "api", "packages/web")], noise=[("g", "x/d.py", 4), ("g", "x/e.py", 4), ("g", "x/f.py", 3), ("g", "x/h.py", 9)], feedback=[("g", "x/d.py", 7.0), ("g", "x/h.py", 7.0), ("g", "x/d.py", 3.0)])
    found = scores(boosts.chain(boosts.candidates(spark.createDataFrame(rows, ROWS)), c))
    assert found["packages/web/a.py"][1] == ["workspace match packages/web"] and found["lib/b.py"][0] == 29.0 and found["api/c.py"][0] == 17.0
    assert found["x/d.py"] == (7.0, ["other", "repeat noise path suppressed", "learning feedback miss boost +7"])
    assert found["x/e.py"][0] == 50.0 - 32.0 and found["x/f.py"][0] == 50.0 - 22.0 and found["x/h.py"][0] == 50.0


def test_a_hub_is_split_and_nothing_is_lost(spark, monkeypatch):
    near = [("src/order.py", "src/hub.py")] + [("src/hub.py", f"lib/order_x{i}.py") for i in range(400)]
    rows = [row("src/order.py", 130.0), row("src/hub.py")] + [row(f"lib/order_x{i}.py") for i in range(400)]
    make = lambda: scores(boosts.second_pass(boosts.recall(boosts.candidates(spark.createDataFrame(rows, ROWS)), context(spark, near)), context(spark, near)))
    want = make()
    assert sum(s > 0 for s, _ in want.values()) == 2 + 32  # the hub, the seed and the best 32 behind the hub
    monkeypatch.setattr(shared, "HOT", 4)  # the hub goes by broadcast
    assert make() == want


def test_odd_rows(spark):
    rows = [(None, "a.py", None, None, None, None, None, None, None), ("g", None, 1.0, [], False, False, None, None, []), ("g", "", 1.0, [], False, False, None, None, [])]
    found = scores(boosts.chain(boosts.candidates(spark.createDataFrame(rows, ROWS)), context(spark)))
    assert found == {"a.py": (0.0, []), "": (1.0, [])}
    assert boosts.chain(boosts.candidates(spark.createDataFrame([], ROWS)), context(spark)).count() == 0


@pytest.mark.parametrize(("path", "terms"), [("services/api/users/[id]/route.ts", ["users", "id"]), ("src/a.py", []), ("api/_private/order-items/views.py", ["order", "items"]), ("web/api", [])])
def test_route_terms(spark, path, terms):
    assert spark.createDataFrame([(path,)], "p string").select(boosts.route_terms(F.col("p"))).first()[0] == terms
