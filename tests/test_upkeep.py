"""Stores, retention, scans, matching, excerpts and fingerprints against plain loops and damaged files."""

import os
import random
import shutil

import pytest
from pyspark.sql import functions as F

from corpuscle.functions import excerpts
from corpuscle.operators import matching, retention
from corpuscle.sources import scan, store
from corpuscle.streaming import events


def two(spark, n=5):
    return {"a": spark.range(n).withColumn("x", F.col("id") * 2), "b": spark.createDataFrame([(1, None), (2, "t")], "k int, s string")}


def rows(df):
    return sorted(map(repr, df.collect()))


def test_a_version_is_read_back_and_a_torn_one_is_not_seen(spark, tmp_path):
    root = str(tmp_path)
    with pytest.raises(store.Damaged):
        store.load(spark, root)
    assert store.publish(two(spark), root) == 1
    found, version = store.load(spark, root)
    assert version == 1 and rows(found["a"]) == rows(two(spark)["a"]) and rows(found["b"]) == rows(two(spark)["b"])
    # data of a second version without a manifest, and a manifest that names fewer tables than it says
    two(spark, 9)["a"].write.parquet(f"{root}/data/a/{2:012d}")
    spark.createDataFrame([(2, "a", f"data/a/{2:012d}", 9, "0", 2)], store.MANIFEST).coalesce(1).write.json(f"{root}/manifests/{2:012d}")
    assert store.load(spark, root)[1] == 1
    assert store.publish({"a": spark.range(3), "b": two(spark)["b"]}, root) == 3
    found, version = store.load(spark, root)
    assert version == 3 and found["a"].count() == 3


def test_a_wrong_digest_is_damage_and_only_that_table_is_built_again(spark, tmp_path):
    root = str(tmp_path)
    store.publish(two(spark), root)
    store.publish(two(spark, 7), root)
    two(spark, 8)["a"].write.mode("overwrite").parquet(f"{root}/data/a/{2:012d}")
    found, version = store.load(spark, root)
    assert version == 1 and found["a"].count() == 5  # the version before is whole
    built = []
    found, version = store.load(spark, root, {"a": lambda: built.append("a") or two(spark, 7)["a"], "b": lambda: built.append("b") or two(spark)["b"]})
    assert version == 3 and built == ["a"] and found["a"].count() == 7
    kept = {r["name"]: r["path"] for r in store.versions(spark, root)[0][1]}
    assert kept == {"a": f"data/a/{3:012d}", "b": f"data/b/{2:012d}"}
    for part in os.listdir(f"{root}/data/b/{2:012d}"):
        if part.startswith("part-"):
            os.rename(f"{root}/data/b/{2:012d}/{part}", f"{root}/{part}.lost")
    shutil.move(f"{root}/data/b/{1:012d}", f"{root}/gone")
    with pytest.raises(store.Damaged):
        store.load(spark, root)


def test_stored_hashes_take_little_more_than_half_their_text(spark, tmp_path):
    root, n = str(tmp_path), 20_000
    hashes = spark.range(n).select(F.sha2(F.col("id").cast("string"), 256).alias("h"))
    store.publish({"a": hashes}, root)
    folder = f"{root}/data/a/{1:012d}"
    assert sum(os.path.getsize(f"{folder}/{f}") for f in os.listdir(folder) if f.startswith("part-")) < 0.6 * 64 * n
    assert rows(store.load(spark, root)[0]["a"]) == rows(hashes)


def loop_retention(states, uses, records, keep, most):
    plan = {}
    for g in {s[0] for s in states} | {r[0] for r in records}:
        own = [s for s in states if s[0] == g]
        blind = any(s[5] is None for s in own)
        live = sorted((s for s in own if s[5]), key=lambda s: (s[3], s[1]), reverse=True)
        tree, refs = [s for s in live if s[2] == "WORKTREE"][:1], [s for s in live if s[2] != "WORKTREE"]
        kept = [*tree, *refs[:keep]]
        needs = lambda ss: {r for _, s, r in uses if _ == g and s in {x[1] for x in ss}}  # noqa: B023, E731
        size = lambda ss: sum(x[4] for x in ss) + sum(b for gg, r, b in records if gg == g and r in needs(ss))  # noqa: B023, E731
        out = set()
        while most and size(kept) > most and len([k for k in kept if k[2] != "WORKTREE"]) > 2:
            out.add(kept.pop()[1])
        for s in own:
            plan[g, "state", s[1]] = "unreadable" if s[5] is None else "stale" if not s[5] else "unreadable neighbours" if blind else "budget" if s[1] in out else "retained" if s in kept else "old"
        once = needs([*kept, *(s for s in live if s[1] in out)])
        for gg, r, _ in records:
            if gg == g:
                plan[g, "record", r] = "unreadable neighbours" if blind else "reachable" if r in needs(kept) else "budget" if r in once else "unreachable"
    return plan


@pytest.mark.parametrize("most", [0, 400, 900])
def test_retention_equals_the_loop_and_nothing_live_goes(spark, most):
    rng = random.Random(most)
    states = [(g, f"s{g}{i}", rng.choice(["WORKTREE", "r", "r"]), rng.randrange(50), rng.randrange(40), rng.choice([True] * 8 + [False] + ([None] if g == 2 else []))) for g in range(4) for i in range(14)]
    records = [(g, f"x{i}", rng.randrange(90)) for g in range(4) for i in range(20)]
    uses = sorted({(s[0], s[1], f"x{rng.randrange(16)}") for s in states for _ in range(3)})
    df = spark.createDataFrame(states, "g int, state string, ref string, changed int, bytes long, current boolean")
    plan = retention.retention_plan(df, spark.createDataFrame(uses, "g int, state string, record string"), held := spark.createDataFrame(records, "g int, record string, bytes long"), 5, most)
    got = {(r["g"], r["kind"], r["key"]): r for r in plan.collect()}
    want = loop_retention(states, uses, records, 5, most)
    assert {k: r["reason"] for k, r in got.items()} == want
    left = {(r["g"], r["record"]) for r in retention.sweep(held, plan, "record", "record").collect()}
    alive = {(g, r) for g, s, r in uses if want[g, "state", s] == "retained"}
    assert alive <= left and len(left) == sum(r["kept"] for r in retention.report(plan.where("kind = 'record'")).collect())


def test_registry_of_blocks(spark):
    own = spark.createDataFrame([("p", 2, "b", 10), ("p", 1, "a", 20), ("q", 1, "z", 1)], "pack string, place long, path string, tokens long")
    symbols = spark.createDataFrame([("p", "a", 9, "g", 2), ("p", "a", 3, "f", 1), ("p", "none", 1, "h", 1)], "pack string, path string, line int, name string, tokens long")
    omitted = spark.createDataFrame([("p", 1, "o", 5)], "pack string, place long, path string, tokens long")
    found = [tuple(r) for r in retention.block_registry(own, symbols, omitted, 4).orderBy("pack", "position").collect()]
    assert found == [("p", 1, "file", "a", "", 20), ("p", 2, "symbol", "a", "f", 1), ("p", 3, "symbol", "a", "g", 2), ("p", 4, "file", "b", "", 10), ("q", 1, "file", "z", "", 1)]


@pytest.mark.parametrize(
    ("lines", "taken", "left"),
    [
        (["*.py"], ["a.py", "x/b.py", "d.py/e.txt"], ["a.pyc", "a.txt"]),
        (["build/"], ["build/a", "x/build/y/z"], ["build", "x/builds/a"]),
        (["/docs"], ["docs", "docs/a.md"], ["x/docs"]),
        (["a/b"], ["a/b", "a/b/c"], ["x/a/b", "a/bc"]),
        (["**/gen"], ["gen/a", "x/y/gen"], ["gens"]),
        (["src/**/t?.py"], ["src/t1.py", "src/a/b/t2.py"], ["src/t10.py", "t1.py"]),
        (["logs/**"], ["logs/a", "logs/a/b"], ["logs", "x/logs/a"]),
        (["*.log", "!keep.log", "x/keep.log"], ["a.log", "x/keep.log"], ["keep.log", "y/keep.log"]),
        (["# c", "", "\\#odd", "[ab]?.t", "[!x]y"], ["#odd", "a1.t", "zy"], ["c", "c1.t", "xy"]),
    ],
)
def test_rules(spark, lines, taken, left):
    df = spark.createDataFrame([(p,) for p in taken + left], "path string")
    assert {r[0] for r in df.where(scan.matched(F.col("path"), lines)).collect()} == set(taken)


def test_include_comes_first(spark):
    df = spark.createDataFrame([(p,) for p in ("src/a.py", "src/b.md", "c.py", "src/gen/d.py", "src/gen/e.py")], "path string")
    out = df.where(~scan.ignored(F.col("path"), ["src/"], ["*.md"], ["gen/", "!e.py"]))
    assert {r[0] for r in out.collect()} == {"src/a.py", "src/gen/e.py"}


def test_a_delta_scan_equals_a_full_one_after_random_edits(spark):
    rng = random.Random(8)
    paths = [f"{d}/{n}{e}" for d in ("src", "src/deep/er", "docs", "out", ".git", "gen") for n in ("a", "b", "c") for e in (".py", ".md", ".png", ".gen.py")]
    tree = lambda kept: {p: rng.choice([b"", b"x" * 30_000, b"text", b"a\x00b", "é".encode()]) for p in kept}
    old = tree(paths[:-8])
    new = {p: (rng.choice([b"new", b"n\x00"]) if rng.random() < 0.2 else t) for p, t in old.items() if rng.random() < 0.9} | tree(paths[-8:])
    edits = [p for p in {*old, *new} if old.get(p) != new.get(p)]
    changed = [p for p in edits if not p.startswith("docs/")] + ["docs", "nothing/here", " "]
    df = lambda m: spark.createDataFrame(list(m.items()), "path string, content binary")
    rules = {"include": ["src", "docs", "gen", "out/*.md"], "exclude": ["*.gen.py"], "ignore": ["docs/", "!docs/a*"], "max_tokens": 1000, "skip": ["gen/b.py"]}
    got = scan.scan_changed(df(new), scan.scan(df(old), **rules), spark.createDataFrame([(p,) for p in changed], "path string"), **rules).collect()
    want = {r["path"]: r.asDict() for r in scan.scan(df(new), **rules).collect()}
    for r in got:
        assert {k: v for k, v in r.asDict().items() if k != "reused"} == want[r["path"]]
    assert {r["path"] for r in got if r["bucket"] == "packable"} == {p for p, r in want.items() if r["bucket"] == "packable"}
    assert any(r["reused"] for r in got) and all(not r["reused"] for r in got if r["path"] in edits) and not any(p.startswith(".git/") for p in want)


@pytest.mark.parametrize(("seed", "frontier"), [(1, 128), (2, 2), (3, 1)])
def test_matching_equals_the_sorted_loop(spark, seed, frontier):
    rng = random.Random(seed)
    c = [(rng.choice("ab"), i, float(rng.randrange(0, 300, 5)), rng.choice([0, 100, 100, 700]), rng.choice([None, 3, 9])) for i in range(60)]
    i = [(rng.choice("abc"), j, float(rng.randrange(0, 300, 5)), rng.choice([0, 50, 100])) for j in range(40)]
    pairs = []
    for g, a, v, t, k in c:
        for h, b, w, u in i:
            if g == h and t > 0 and u > 0 and (gain := v - w - max(0, t - u) * 0.04) >= 55:
                pairs.append((g, -gain, t - u, k or 999_999, a, b))
    want, used = set(), set()
    for g, less, more, _, a, b in sorted(pairs):
        if ("c", g, a) not in used and ("i", g, b) not in used:
            used |= {("c", g, a), ("i", g, b)}
            want.add((g, a, b, -less, more))
    got = matching.greedy_matching(spark.createDataFrame(c, "g string, id long, value double, tokens long, rank int"), spark.createDataFrame(i, "g string, id long, value double, tokens long"), frontier=frontier)
    assert {(r["g"], r["candidate"], r["incumbent"], r["gain"], r["more"]) for r in got.collect()} == want
    assert len({(g, a) for g, a, *_ in want}) == len({(g, b) for g, _, b, *_ in want}) == len(want) > 5


CODE = """import os
from x import y

# about alpha
@mark
def alpha(v):
    return v

def beta():
    pass


def gamma():
    # uses alpha
    return 3
""" + "\n".join(f"line {n}" for n in range(40)) + "\nlast alpha here\ntail"


def test_excerpts_take_blocks_windows_and_headers():
    text, spans = excerpts.excerpt(CODE, ["alpha"], 10_000)
    assert spans[0] == (0, 19) or spans[0][0] == 0
    assert text.startswith("import os\nfrom x import y") and "def beta" in text and text.endswith("last alpha here\ntail") and "line 20" not in text
    short, spans = excerpts.excerpt(CODE, ["alpha"], 12)
    assert excerpts.tokens_of(short) <= 12 and short.startswith("import os") and len(spans) == 1
    assert excerpts.excerpt("", ["alpha"], 10) == ("", []) and excerpts.excerpt("nothing", ["alpha"], 10) == ("", [])


def test_excerpts_in_spark_equal_the_function(spark):
    cases = [(0, CODE, ["alpha"], 30, ".py"), (1, None, ["x"], 9, ""), (2, "package main\n\nfunc f() {}", ["none"], 50, ".go"), (3, "a tion b\n" * 50, ["tion"], 20, ""), (4, "x" * 4000, ["xxx"], 5, ""), (5, "t", None, None, None)]
    df = spark.createDataFrame(cases, "i int, t string, w array<string>, m int, s string")
    got = {r["i"]: r["x"] for r in df.select("i", excerpts.excerpts(F.col("t"), F.col("w"), F.col("m"), F.col("s")).alias("x")).collect()}
    for i, t, w, m, s in cases:
        text, spans = excerpts.excerpt(t or "", w or [], m or 0, s == ".go")
        assert (got[i]["excerpt"], [tuple(x) for x in got[i]["spans"]]) == (text, spans) and got[i]["tokens"] <= max(m or 0, 0)


def test_fingerprints_fire_once_for_each_change_over_two_runs(spark, tmp_path):
    ddl = "event_id long, user_id long, ts timestamp, event_type string, value double"
    folder, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    import datetime

    at = lambda n: datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=n)

    def run(data):
        spark.createDataFrame([(n, u, at(n), e, 0.0) for n, u, e in data], ddl).coalesce(1).write.mode("append").parquet(folder)
        changes = events.fingerprint_changes(events.stream(spark, folder, ddl))
        changes.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
        return sorted((r["user_id"], r["event_id"], r["before"], r["after"]) for r in spark.read.parquet(out).collect())

    first = run([(0, 1, "a"), (1, 1, "a"), (2, 2, "b"), (3, 1, "c")])
    assert first == [(1, 0, None, "a"), (1, 3, "a", "c"), (2, 2, None, "b")]
    assert run([(4, 1, "c"), (5, 2, "b"), (6, 2, "d"), (7, 2, "d"), (8, 1, None)]) == sorted([*first, (2, 6, "b", "d"), (1, 8, "c", "")])


@pytest.mark.parametrize("frontier", [40, 1000])
def test_matching_takes_many_pairs_in_a_round(spark, frontier, monkeypatch):
    """Rows that all want the same incumbent are matched in a few rounds, not one a pair."""
    rounds, match, cut = [], matching.greedy_matching, matching.cut
    monkeypatch.setattr(matching, "cut", lambda df: (rounds.append(df.columns), cut(df))[1])
    c = [("a", n, 1000.0 + n % 90, 10, n % 7) for n in range(150)]
    i = [("a", n, float(n % 80), 5 + n % 9) for n in range(200)]
    got = [(r["candidate"], r["incumbent"], r["gain"]) for r in match(spark.createDataFrame(c, "g string, id long, value double, tokens long, rank int"), spark.createDataFrame(i, "g string, id long, value double, tokens long"), frontier=frontier).collect()]
    pairs = sorted((-(v - w - max(0, t - u) * 0.04), t - u, k, a, b) for _, a, v, t, k in c for _, b, w, u in i)
    want, left, right = [], set(), set()
    for less, _, _, a, b in pairs:
        if a not in left and b not in right:
            left.add(a), right.add(b), want.append((a, b, -less))
    assert sorted(got) == sorted(want) and len(want) == 150 and sum("more" in x for x in rounds) <= 15
    one = spark.range(40).selectExpr("'a' AS g", "id", "cast(id * 53 % 400 AS double) AS value", "id % 9 + 1 AS tokens", "id % 5 AS rank")
    assert matching.greedy_matching(one.where("id % 2 = 0"), one.where("id % 2 = 1")).count() > 5
