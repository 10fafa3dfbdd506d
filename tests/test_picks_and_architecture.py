"""Picks and property-graph upkeep against plain loops, and their edge cases."""

import hashlib
import random

from pyspark.sql import functions as F

from corpuscle import shared
from corpuscle.functions import values
from corpuscle.operators import architecture as arch
from corpuscle.operators import picks


def test_role_seeds(spark):
    def seeds(rows, window=2):  # rows: (config, source, scope) by falling score
        df = spark.createDataFrame([("g", i, c, s, x) for i, (c, s, x) in enumerate(rows)], "g string, i int, c boolean, s boolean, x string")
        out = picks.role_seeds(df, "g", "i", [F.col("i")], (F.col("c"), F.col("s")), F.col("x"), window)
        return [r["i"] for r in out.orderBy("seed").collect()]

    none, conf, src = (False, False, ""), (True, False, "a"), (False, True, "a")
    assert seeds([none, none, src, conf]) == [2, 3]
    assert seeds([conf, none, none, src]) == [3]
    assert seeds([conf, src, none]) == []
    assert seeds([none, none, conf]) == []
    assert seeds([none, none, conf, (False, True, "b")]) == []
    assert seeds([none, none, conf, (False, True, "")]) == [2, 3]
    assert seeds([none, none, src, conf], window=1) == []
    assert seeds([none, (None, None, ""), *[none] * 29, conf, src]) == []
    assert seeds([]) == []


def test_lane_topics_against_a_loop(spark):
    rng = random.Random(5)
    rows = [(g, t, rng.choice("pqr"), rng.sample([*picks.LANES, "x"], rng.randint(0, 3)), rng.random() < 0.5, rng.randint(0, 5)) for g in range(12) for t in range(rng.randint(1, 9))]
    df = spark.createDataFrame(rows, "g int, t int, p string, lanes array<string>, m boolean, s int")
    for limit, spread in ((3, True), (2, True), (3, False)):
        want = set()
        for g in range(12):
            ids, projects, n = set(), set(), 0
            for lane in picks.LANES:
                left = sorted((r for r in rows if r[0] == g and lane in r[3] and r[1] not in ids), key=lambda r: (-r[5], r[1]))
                left = [r for r in left if not r[4]] or left
                left = ([r for r in left if r[2] not in projects] if spread else []) or left
                if left and n < limit:
                    want.add((g, lane, left[0][1], left[0][2]))
                    ids.add(left[0][1])
                    projects.add(left[0][2])
                    n += 1
        got = picks.lane_topics(df, "g", "t", "p", "lanes", "m", [F.desc("s"), F.col("t")], limit, spread)
        assert {tuple(r) for r in got.collect()} == want


def test_priors_skip_noise_and_keep_the_first_evidence(spark):
    rows = [(1, "Fix login", "src/a.py"), (2, "login page", "src/a.py"), (3, "login", "src/a.py"), (4, "fix LOGIN now", "src/a.py"), (5, "login", "x.log"), (6, "other", "src/b.py"), (7, None, "src/b.py"), (8, "fix it", "src/login.py")]
    out = picks.route_priors(spark.createDataFrame(rows, "i int, task string, path string"), "task", "path", "i", "fix login").collect()
    assert [(r["path"], r["score"], r["events"], r["confidence"], r["evidence"], r["last"]) for r in out] == [
        ("src/a.py", 6, 4, 0.85, ["Fix login", "login page", "login"], "fix LOGIN now"),
        ("src/login.py", 2, 1, 0.59, ["fix it"], "fix it"),
    ]


def test_gap_without_a_selection_is_null(spark):
    df = spark.createDataFrame([("a", 9.0, 1), ("a", 7.0, 2), ("a", 4.25, None), ("b", 3.0, None)], "g string, s double, place int")
    assert {(r["g"], r["s"]): r["gap"] for r in picks.score_gaps(df, "g", "s", "place").collect()} == {("a", 9.0): 2.0, ("a", 7.0): 0.0, ("a", 4.25): -2.8, ("b", 3.0): None}


def test_lessons_by_points_and_place(spark):
    df = spark.createDataFrame([(0, "Use cache", 50, "accepted", True), (1, "avoid eval", 99, "new", True), (2, "use Retry", 50, "new", False), (3, "use retry", 50, "new", False)], "i int, rule string, c int, status string, e boolean")
    out = picks.rank_lessons(df, "rule", "c", F.col("status") == "accepted", F.col("e"), "i", ["cache"], ["RETRY"], ["Eval"], 2)
    assert [(r["i"], r["score"]) for r in out.collect()] == [(0, 105), (2, 70)]


def test_reasons_without_a_rule_stay(spark):
    said = [("Has Related Tests in x", "related_test"), ("budget: full", "budget"), ("Odd one", "Odd one"), (None, None), ("", "")]
    df = spark.createDataFrame([(r,) for r, _ in said], "reason string").select("reason", picks.reason_bucket(F.col("reason")).alias("b"))
    assert {(r["reason"], r["b"]) for r in df.collect()} == set(said)


def test_flat_values(spark):
    cases = {'"a"': ["a"], '["a", {"name": "b"}, 3, null]': ["a", "b", "3"], "null": [], "7": ["7"], "[]": [], "not json": [], None: [], '{"x":1}': ['{"x":1}'], '["{}"]': ["{}"]}
    df = spark.createDataFrame([(k,) for k in cases], "j string").select("j", values.flat_values(F.col("j")).alias("v"))
    assert {r["j"]: r["v"] for r in df.collect()} == cases
    one = spark.createDataFrame([(["x", "Login a", "login b"],), ([],), (["z"],)], "v array<string>").select(values.best_match(F.col("v"), [("login", 0.6), ("x", 0.1)]).alias("b"))
    assert [r["b"] and tuple(r["b"]) for r in one.collect()] == [("Login a", 0.6), None, None]


def test_owners_keep_files_and_the_first_edge(spark):
    entities = spark.createDataFrame([("f", "module"), ("t", "test"), ("s", "symbol"), ("u", "symbol")], "key string, kind string")
    edges = spark.createDataFrame([("t", "s", "contains", 2), ("f", "s", "contains", 1), ("f", "t", "contains", 0), ("s", "u", "contains", 0), ("f", "u", "calls", 0)], "src string, dst string, type string, place int")
    assert {tuple(r) for r in arch.file_owners(entities, edges).collect()} == {("f", "f"), ("t", "t"), ("s", "f")}


def test_targets_stay_when_unresolved_or_ambiguous(spark):
    entities = spark.createDataFrame([("m", "a", "a.py"), ("m", "b", "b.py"), ("m", "b", "c.py"), ("m", "a", "a.py")], "kind string, name string, path string")
    refs = [("m", "a", "a.py", t, "imports", x, p) for t, x, p in [("a", "1", 1), ("b", "2", 2), ("zz", "3", 3), ("zz", "3", 9), ("zz", "4", 4), (None, "5", 5)]]
    nodes, edges = arch.build_graph(entities, spark.createDataFrame(refs, "kind string, name string, path string, target string, type string, anchor string, place int"), "r")
    kinds = sorted((r["kind"], r["name"]) for r in nodes.collect())
    assert kinds == [("ambiguous", "b"), ("m", "a"), ("m", "b"), ("m", "b"), ("unresolved", "zz")]
    assert sorted((r["resolution"], r["place"]) for r in edges.collect()) == [("ambiguous", 2), ("resolved", 1), ("unresolved", 4), ("unresolved", 9)]
    assert edges.join(nodes, edges["dst"] == nodes["key"], "left_anti").count() == 0


def test_edges_are_grouped_by_texts_and_not_by_hashes(spark):
    kinds = "kind string, name string, path string"
    refs = [("m", "a|b", "c", "a", None, "1", 1), ("m", "a", "b|c", "a", "", "1", 2), ("m", "a", "b|c", "a", "x", "1", None)]
    _, edges = arch.build_graph(spark.createDataFrame([("m", "a", "b|c")], kinds), spark.createDataFrame(refs, kinds + ", target string, type string, anchor string, place int"), "r")
    assert "hashpartitioning(edge_key#" not in edges._jdf.queryExecution().executedPlan().toString()
    rows = {r["place"]: r for r in edges.collect()}
    assert set(rows) == {2, None} and rows[2]["type"] == "" and rows[None]["type"] == "x"  # the texts of the first two sources are equal
    assert {(r["src"], r["dst"], r["resolution"]) for r in rows.values()} == {(hashlib.sha256(b"r|m|a|b|c").hexdigest(),) * 2 + ("resolved",)}
    assert rows[2]["edge_key"] == hashlib.sha256("||".join([rows[2]["src"], rows[2]["dst"] + "|1"]).encode()).hexdigest()


def loop_edges(entities, refs, repo="r"):
    sha = lambda *parts: hashlib.sha256("|".join(str(p or "") for p in parts).encode()).hexdigest()
    keys, last = {}, {}
    for kind, name, path in sorted(set(entities)):
        keys.setdefault(name, []).append(sha(repo, kind, name, path))
    for kind, name, path, target, type_, anchor, place in refs:
        same = keys.get(target, [])
        state = "unresolved" if not same else "ambiguous" if len(same) > 1 else "resolved"
        src, dst = sha(repo, kind, name, path), same[0] if len(same) == 1 else sha(repo, state, target, "")
        key = sha(src, type_, dst, anchor)
        last[key] = max(last.get(key, (key, src, dst, type_, state, -1)), (key, src, dst, type_, state, place), key=lambda e: e[5])
    return sorted(last.values())


def test_edges_of_a_target_lie_together_and_hot_targets_stay_where_they_are(spark, monkeypatch):
    rng, kinds = random.Random(4), "kind string, name string, path string"
    entities = [("m", f"n{rng.randrange(30)}", f"p{i}") for i in range(40)] + [("m", "x", "y|z"), ("m", "x|y", "z"), ("m", "u", "u|v")]
    refs = [(*rng.choice(entities), rng.choice(["n1", f"n{rng.randrange(60)}", "x", "x|y", "u"]), rng.choice("ci"), str(rng.randrange(3)), i) for i in range(900)]
    own, asked = spark.createDataFrame(entities, kinds), spark.createDataFrame(refs, kinds + ", target string, type string, anchor string, place int").repartition(3)
    assert sorted(map(tuple, arch.build_graph(own, asked, "r")[1].collect())) == loop_edges(entities, refs)  # x and x|y have one key
    entities, refs = [e for e in entities if e[1] != "x"], [r for r in refs if r[1] != "x" and r[3] != "x"]
    own, asked = spark.createDataFrame(entities, kinds), spark.createDataFrame(refs, kinds + ", target string, type string, anchor string, place int").repartition(3)
    rows = arch.build_graph(own, asked, "r", parts=3)[1].collect()
    assert sorted(map(tuple, rows)) == loop_edges(entities, refs)
    ends = [r["dst"] for r in rows]
    assert sum(a != b for a, b in zip(ends, ends[1:], strict=False)) + 1 == len(set(ends))
    monkeypatch.setattr(shared, "HOT_ROWS", 100)
    assert [r["target"] for r in shared.hot_keys(asked.where("target <> 'u' and target <> 'x|y'"), "target").collect()] == ["n1"]
    edges = arch.build_graph(own, asked, "r", asked.select("target"))[1]
    assert sorted(map(tuple, edges.collect())) == loop_edges(entities, refs)


def test_quality_over_nothing_is_null(spark):
    kind = "src string, type string, dst string, path string, start int, end int"
    made = spark.createDataFrame([("a", "calls", "b", "x", 3, None), ("a", "calls", "c", "x", 9, 12), ("a", "tests", "c", "x", 1, 1)], kind)
    want = spark.createDataFrame([("a", "calls", "b", "x", 1, 3), ("a", "calls", "c", "y", 9, 9), ("d", "calls", "c", None, None, None)], kind)
    assert tuple(arch.relation_quality(made, want).first()) == (1.0, 2 / 3, 0.5)
    assert tuple(arch.relation_quality(made.limit(0), want).first()) == (None, 0.0, None)
    assert tuple(arch.relation_quality(made, want.limit(0)).first()) == (None, None, None)


def test_kept_up_view_equals_one_built_anew(spark):
    rows = spark.createDataFrame([(f"f{i}", f"h{i}", i) for i in range(10)], "key string, hash string, n int")
    view = lambda df: df.select("key", (F.col("n") * 2).alias("v"))
    near = lambda changed: changed.where("key = 'f0'").select(F.lit("f1").alias("key"))
    for touched, mode in ((1, "incremental"), (3, "incremental"), (4, "cold")):
        moved = F.substring("key", 2, 1).cast("int") < touched - 1
        now = rows.where("key <> 'f9'").withColumn("hash", F.when(moved, F.lit("new")).otherwise(F.col("hash"))).withColumn("n", F.when(moved, 100 + F.col("n")).otherwise(F.col("n")))
        build = lambda keys, now=now: view(now if keys is None else now.join(keys, "key", "left_semi"))
        got, how = arch.maintain(view(rows), rows, now, near, build)
        assert how == mode, touched
        assert got.exceptAll(view(now)).isEmpty() and view(now).exceptAll(got).isEmpty()
