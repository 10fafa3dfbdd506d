"""Golden and brute-force tests of operators, sources and streams."""

import random
import subprocess

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuscle.functions import classify, text
from corpuscle.operators import extensions, graph, selection
from corpuscle.operators import relational as rel
from corpuscle.sources import readers, sinks, symbols
from corpuscle.streaming import events


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_tokens(spark):
    assert one(spark, text.ordered_tokens(F.lit("fooBarHTTPServer2X"))) == ["foo", "bar", "httpserver2", "x"]
    assert one(spark, text.task_terms(F.lit("Use the fooBar in a-b Query"))) == ["foobar", "query"]
    assert one(spark, text.bigrams(F.array(*map(F.lit, ["a", "b", "a", "b"])))) == ["a b", "b a"]
    assert [one(spark, text.singular(F.lit(w))) for w in ("queries", "classes", "files", "status", "cat")] == ["query", "class", "file", None, None]
    assert one(spark, text.conventional_commit(F.lit("Fix(api)!: broken route"))) == ("fix", "api", "broken route")
    assert one(spark, text.literal_phrases(F.lit('see `order index` and "user Service" in user-service'))) == ["order index", "user service"]
    assert one(spark, text.api_path(F.lit("call /api/users/[id]/items?x=1"))) == "/api/users/items"
    assert [one(spark, text.duration_hours(F.lit(v))) for v in ("24h", "7d", "3", "x")] == [24, 168, 72, None]
    assert one(spark, text.citation(F.lit("a/b.py:3-9 and c.ts:4")))[0] == ("a/b.py", 3, 9)
    assert one(spark, text.first_line(F.lit("# head\n\n  do   this \nmore"))) == "do this"


def test_classifiers(spark):
    families = {"docs/a.py": "docs", "README": "docs", "x/fixtures/a.ts": "fixtures", "src/tests/a.py": "test", "a.test.ts": "test", "dist/a.js": "generated", "package.json": "config", "src/a.go": "source", "LICENSE": "other"}
    assert {p: one(spark, classify.path_family(F.lit(p))) for p in families} == families
    assert one(spark, classify.module_of(F.lit("src/core/x.py"))) == "src/core" and one(spark, classify.module_of(F.lit("x.py"))) == "x.py"
    assert one(spark, classify.task_kind(F.lit("fix failing tests")))["kind"] == "bugfix" and one(spark, classify.task_kind(F.lit("zzz")))["kind"] == "general"
    assert [one(spark, classify.context_intent(F.lit(t))) for t in ("review the PR", "security review", "share notes", "map repo", "preview")] == ["review", "audit", "share", "repo_overview", "coding_task"]


def test_snapshot_diff(spark):
    old = spark.createDataFrame([("a", "h1"), ("b", "h2"), ("c", "h3")], "path string, hash string")
    new = spark.createDataFrame([("a", "h1"), ("b", "h9"), ("d", "h4")], "path string, hash string")
    assert dict(rel.keyed_diff(old, new, "path", "hash").collect()) == {"a": "unchanged", "b": "modified", "c": "deleted", "d": "added"}


def test_matches_and_prefixes(spark):
    removed = spark.createDataFrame([(1, "x"), (2, "y"), (3, "y")], "k long, name string")
    added = spark.createDataFrame([(11, "x"), (12, "y")], "k long, name string")
    assert [(r.before, r.after) for r in rel.unique_matches(removed, added, ["name"], "k").collect()] == [(1, 11)]
    assert {(r.before, r.after) for r in rel.ambiguous_matches(removed, added, ["name"], "k").collect()} == {(2, 12), (3, 12)}
    rows = spark.createDataFrame([("a/b/c",), ("a/x",), ("z",)], "path string")
    got = rel.longest_prefix(rows, "path", spark.createDataFrame([("a",), ("a/b",)], "ws string"), "ws")
    assert {r.path: r.ws for r in got.collect()} == {"a/b/c": "a/b", "a/x": "a", "z": None}


def test_intervals(spark):
    rows = spark.createDataFrame([(1, 1, 3), (1, 5, 6), (1, 9, 9), (2, 1, 1)], "k int, s int, e int")
    assert sorted((r.k, r.s, r.e) for r in rel.merge_intervals(rows, ["k"], "s", "e", 2).collect()) == [(1, 1, 6), (1, 9, 9), (2, 1, 1)]


def test_graph(spark):
    edges = spark.createDataFrame([("a", "b", "calls"), ("b", "c", "calls"), ("d", "c", "calls"), ("x", "y", "calls")], "src string, dst string, type string")
    seed = spark.createDataFrame([("a",)], "node string")
    assert {r.node: r.hop for r in graph.bfs(edges, seed).collect()} == {"a": 0, "b": 1, "c": 2, "d": 3}
    assert [r.node for r in graph.shortest_path(edges, "a", "d").orderBy("hop").collect()] == ["a", "b", "c", "d"]
    assert graph.shortest_path(edges, "a", "a").count() == 0 and graph.shortest_path(edges, "a", "x").count() == 0
    assert {r.node for r in graph.dependents_closure(edges, spark.createDataFrame([("c",)], "node string")).collect()} == {"a", "b", "c", "d"}
    assert {(r.node, r.hop) for r in graph.two_hop(edges, seed).collect()} == {("b", 1), ("c", 2)}


@pytest.mark.parametrize("chunk", [1000, 7])
def test_greedy_budget_equals_a_loop(spark, chunk):
    rng = np.random.default_rng(1)
    rows = [(int(g), i, int(s), int(t)) for i, (g, s, t) in enumerate(zip(rng.integers(0, 4, 200), rng.integers(0, 50, 200), rng.integers(1, 60, 200), strict=True))]
    got = {r.i: (r.action, r.spent) for r in selection.greedy_budget(spark.createDataFrame(rows, "g long, i long, s long, t long"), "g", "i", "s", "t", 150, 6, chunk).collect()}
    want = {}
    for g in range(4):
        spent = taken = 0
        for _, i, _, t in sorted((r for r in rows if r[0] == g), key=lambda r: (-r[2], r[1])):
            action = "cap reached" if taken >= 6 else "over budget" if spent + t > 150 else "selected"
            spent, taken = (spent + t, taken + 1) if action == "selected" else (spent, taken)
            want[i] = (action, spent)
    assert got == want


def test_greedy_budget_takes_nulls_ties_and_repeats(spark):
    rows = [("a", 1, 5.0, 4), ("a", 1, 5.0, 4), ("a", 2, None, 2), ("a", 3, float("nan"), None), (None, 4, 1.0, 11), (None, 5, 0.5, 10)]
    frame = spark.createDataFrame(rows, "g string, i long, s double, t long")
    got = sorted(map(tuple, selection.greedy_budget(frame, "g", "i", "s", "t", 10, 3, 1).collect()), key=repr)
    assert got == sorted([("a", 1, "selected", 4), ("a", 1, "selected", 8), ("a", 2, "selected", 10), ("a", 3, "cap reached", 10), (None, 4, "over budget", 0), (None, 5, "selected", 10)], key=repr)
    assert selection.greedy_budget(frame.limit(0), "g", "i", "s", "t", 10).count() == 0


def test_diverse_picks_equal_a_loop(spark):
    rng = np.random.default_rng(2)
    rows = [(i % 3, i, float(rng.integers(0, 100)), [str(x) for x in rng.integers(0, 6, 3)]) for i in range(45)]
    got = sorted(tuple(r) for r in selection.diverse_top_k(spark.createDataFrame(rows, "g long, i long, s double, t array<string>"), "g", "i", "s", "t").select("g", "pick", "i").collect())
    want = []
    for g in range(3):
        left, chosen = [r for r in rows if r[0] == g], []
        for pick in (1, 2, 3):
            near = lambda r: max((len({*r[3]} & {*c[3]}) / len({*r[3]} | {*c[3]}) for c in chosen), default=0.0)  # noqa: B023, E731
            best = max(left, key=lambda r: (r[2] - 70 * near(r), -r[1]))  # noqa: B023
            chosen.append(best)
            left.remove(best)
            want.append((g, pick, best[1]))
    assert got == sorted(want)


def test_sources(spark, tmp_path):
    (tmp_path / "tree/src").mkdir(parents=True)
    (tmp_path / "tree/src/a.py").write_text("import os\nfrom .b import c\n\nclass A:\n    def m(self):\n        pass\n\ndef f():\n    return 1\n")
    (tmp_path / "tree/src/b.ts").write_text("import x from './y'\nexport function go() {\n}\nclass Z {}\n")
    (tmp_path / "tree/data.bin").write_bytes(b"abc\0def")
    (tmp_path / "tree/raw.txt").write_bytes(b"a\0b")
    (tmp_path / "tree/skip.log").write_text("x")
    tree = readers.scan_tree(spark, str(tmp_path / "tree"), [r"\.log$"])
    assert {r.path: r.bucket for r in tree.collect()} == {"src/a.py": "packable", "src/b.ts": "packable", "data.bin": "binary", "raw.txt": "binary", "skip.log": "ignored"}
    found = {(r.path, r.name, r.kind) for r in symbols.facts(tree).collect()}
    assert {("src/a.py", "A", "class"), ("src/a.py", "m", "method"), ("src/a.py", "f", "function"), ("src/a.py", ".b", "import"), ("src/b.ts", "go", "function"), ("src/b.ts", "./y", "import")} <= found
    assert {r.path: r.n_symbols for r in symbols.summaries(tree).collect()} == {"src/a.py": 3, "src/b.ts": 2}
    (tmp_path / "log.jsonl").write_text('{"id": 1, "t": "a"}\n\nnot json\n[1]\n{"id": 2, "t": "b"}\n{"id": \n')
    assert [r.id for r in readers.json_lines(spark, str(tmp_path / "log.jsonl"), "id int, t string").orderBy("id").collect()] == [1, 2]
    assert [r.id for r in readers.json_lines(spark, str(tmp_path / "log.jsonl"), "id int, t string", 1, "id").collect()] == [2]
    assert readers.toml_cases(spark, '[[cases]]\ntask = "x"\nbudget = 3\n[[cases]]\ntask = "y"\n', "cases", "task string, budget int").count() == 2
    (tmp_path / "s.md").write_text("---\nname: skill\ndescription: does things\n---\nbody\n")
    row = readers.front_matter(spark, str(tmp_path / "s.md")).first()
    assert (row.name, row.description, row.body) == ("skill", "does things", "body\n")


def test_git_source(spark, tmp_path):
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=n", "-c", "user.email=e@x", *a], check=True, capture_output=True)
    git("init")
    (tmp_path / "a.txt").write_text("1")
    git("add", "a.txt")
    git("commit", "-m", "one")
    spark.dataSource.register(readers.GitLog)
    rows = spark.read.format("git_log").option("repository", str(tmp_path)).load().collect()
    assert [(r.path, r.status) for r in rows] == [("a.txt", "A")]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 1), (2, "a", 2), (3, "b", 1)], "id long, k string, t long")
    sinks.append_log(df, f"{tmp_path}/log")
    sinks.append_log(df, f"{tmp_path}/log")
    assert spark.read.json(f"{tmp_path}/log").count() == 6
    sinks.keep_newest(df, f"{tmp_path}/kept", ["k"], ["t"], 1)
    assert {r.id for r in spark.read.parquet(f"{tmp_path}/kept").collect()} == {2, 3}
    for snapshot in ("s1", "s2", "s1"):
        sinks.write_snapshot(df, f"{tmp_path}/snap", snapshot)
    assert spark.read.parquet(f"{tmp_path}/snap").count() == 6


def test_extensions(spark, tmp_path):
    df = spark.createDataFrame([(1, "yes"), (2, "no"), (2, "no")], "id long, v string")
    script = tmp_path / "judge.py"
    script.write_text("import sys, json\nfor x in sys.stdin:\n    print(json.dumps({'verdict': json.loads(x)['value'].upper()}))\n")
    assert sorted(r.verdict for r in extensions.command_judge(df, ["python3", str(script)], "id", "v").collect()) == ["NO", "NO", "YES"]
    assert {r.verdict for r in extensions.command_judge(df, ["false"], "id", "v").collect()} == {"error"}
    for name, write in extensions.WRITERS.items():
        write(df, f"{tmp_path}/{name}")
    assert extensions.project_index(spark, [f"{tmp_path}/parquet", f"{tmp_path}/absent"], "id long, v string").count() == 3
    assert extensions.golden_compare(df, df).count() == 0
    assert {r.side: r.n for r in extensions.golden_compare(df, df.distinct()).collect()} == {"extra": 1}
    assert one(spark, extensions.trigger_phrases(F.lit("fix-tests"), F.lit('Use when tests fail. Say "red build".'))) == ["fix tests", "red build", "tests fail"]


@pytest.fixture
def event_folder(spark, tmp_path):
    rows = [(i, f"2024-01-0{1 + i // 10} 00:{i % 10 * 5:02d}:00", i % 2, "error" if i % 4 < 2 else "view", 1.0) for i in range(40)]
    df = spark.createDataFrame(rows + rows[:3], "event_id long, ts string, user_id long, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    df.coalesce(1).write.parquet(f"{tmp_path}/events")
    return f"{tmp_path}/events", df.schema


def drain(frame, name):
    query = frame.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    return frame.sparkSession.sql(f"select * from {name}")


def test_streams(spark, event_folder):
    folder, schema = event_folder
    live = events.stream(spark, folder, schema)
    assert drain(events.deduplicated(live), "once").count() == 40
    assert drain(events.windowed_counts(live), "daily").agg(F.sum("n")).first()[0] == 23  # the last two days are still open: the watermark is an hour behind
    assert drain(events.debounced(live), "bursts").agg(F.sum("n")).first()[0] == 33
    assert drain(events.repeated_failures(live, 1), "failures").count() > 0


def test_upsert(spark, event_folder, tmp_path):
    folder, schema = event_folder
    query = events.stream(spark, folder, schema).writeStream.foreachBatch(events.upsert_latest(f"{tmp_path}/latest")).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert {r.user_id: r.event_id for r in spark.read.parquet(f"{tmp_path}/latest/v=0").collect()} == {0: 38, 1: 39}


def test_closure_has_no_end_of_hops(spark):
    chain = spark.createDataFrame([(f"n{i:03}", f"n{i + 1:03}", "calls") for i in range(60)], "src string, dst string, type string")
    found = graph.dependents_closure(chain, spark.createDataFrame([("n060",)], "node string"))
    assert {r["node"] for r in found.collect()} == {f"n{i:03}" for i in range(61)}


def test_binary_by_a_zero_byte_anywhere(spark, tmp_path):
    for name, data in (("a.txt", b"value 0\n\x00tail"), ("b.txt", b"0\n" * 20), ("c.txt", b"x" * 2000 + b"\x00"), ("d.sh", b"#")):
        (tmp_path / name).write_bytes(data)
    found = {r["path"]: (r["bucket"], r["language"]) for r in readers.scan_tree(spark, str(tmp_path)).collect()}
    assert {k: v[0] for k, v in found.items()} == {"a.txt": "binary", "b.txt": "packable", "c.txt": "packable", "d.sh": "packable"} and found["d.sh"][1] == "bash"


def test_running_sums_cross_parts(spark):
    rng = random.Random(41)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.randrange(20), i, rng.choice([1, 2, 5])) for i in range(400)]
    got = rel.running(spark.createDataFrame(rows, "k string, o int, i int, v long"), ["k"], [F.desc("o"), F.col("i")], "v").collect()
    want = {}
    for key in {r[0] for r in rows}:
        total = 0
        for n, r in enumerate(sorted((r for r in rows if r[0] == key), key=lambda r: (-r[1], r[2]))):
            total += r[3]
            want[r[2]] = (n + 1, total)
    assert {r["i"]: (r["rank"], r["spent"]) for r in got} == want and len(got) == len(rows)
    assert rel.running(spark.createDataFrame([], "k string, o int, v long"), ["k"], [F.col("o")], "v").count() == 0


def test_adjacency_and_browse(spark):
    edges = spark.createDataFrame([("a", "b", "x"), ("b", "a", "x"), ("a", "a", "x"), ("a", "c", "y"), ("d", "a", "x")], "src string, dst string, type string")
    nodes = spark.createDataFrame([("a",)], "node string")
    assert [(r["other"], r["side"]) for r in graph.adjacent(edges, nodes, "x").orderBy("other", "side").collect()] == [("a", "out"), ("b", "in"), ("b", "out"), ("d", "in")]
    assert graph.adjacent(edges, nodes, limit=2).count() == 2 and graph.adjacent(edges, nodes, direction="out").count() == 3
    full = edges.selectExpr("concat(src, dst) key", "src", "dst", "type", "if(type = 'x', 'high', 'low') confidence", "array(type, 's') sources")
    names = spark.createDataFrame([("a", "Alpha One", "py"), ("b", "Beta", "go"), ("c", "Gamma one", None), ("d", None, "py")], "entity string, name string, language string")
    found, ends = graph.browse(full, names, terms=["ONE", "alp"], language="go", source="s")
    assert {r["key"] for r in found.collect()} == {"ab", "ba"} and {r["entity"] for r in ends.collect()} == {"a", "b"}
    assert graph.browse(full, names, confidence="low")[0].count() == 1 and graph.browse(full, names, relationship="none")[1].count() == 0


def test_tasks_phrases_and_generic_terms(spark):
    assert one(spark, text.task_terms(F.lit("Fix(userService)!: handle empty orders"))) == ["fix", "user", "service", "handle", "empty", "orders"]
    assert one(spark, text.task_terms(F.lit("no commit: in two\nlines"))) == ["commit", "two", "lines"]
    assert one(spark, text.literal_phrases(F.lit("`update tests` and 'update orders' in docs/tests"))) == ["update orders"]
    assert [one(spark, text.singular(F.lit(w))) for w in ("changes", "orders", "tests", "status", "entries")] == [None, "order", None, None, "entry"]
