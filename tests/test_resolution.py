"""The resolution cascade and stale files against plain loops over rows."""

import posixpath
import random
import re
from collections import Counter

from corpuscle import plans
from corpuscle.operators import architecture, resolution

ENDINGS = [".py", ".js", ".ts", ".tsx", ".go", ".rs", ".java", ".kt", ".rb", ".php", "/__init__.py", "/index.ts", "/index.js"]


def keys_of(name, source):
    if name.startswith("."):
        bare = name.lstrip(".")
        folder = source
        for _ in range(len(name) - len(bare)):
            folder = posixpath.dirname(folder)
        value = posixpath.normpath(posixpath.join(folder, bare.lstrip("/")))
    else:
        value = name.replace("\\", "/")
    value = value.strip("/")
    path = value.replace(".", "/")
    return {k for k in [name, value, path, *(path + e for e in ENDINGS)] if k and k != "."}


def answer(path, scope, relation, name, symbols, files, aliases, objects):
    raw = re.sub(r"^(?:extends|implements|super|trait)\s+", "", name.strip().strip("'\"")).strip().replace("::", ".").split("<")[0].strip()
    said = lambda found, good: (good, next(iter(found))) if len(found) == 1 else ("ambiguous", None)
    mine = [s for s in symbols if s[1] == path]
    if scope and "." in scope and "." not in raw and (hit := {s[0] for s in mine if s[3] == f"{scope.rsplit('.', 1)[0]}.{raw}"}):
        return said(hit, "resolved_same_file")
    if hit := {s[0] for s in mine if raw in (s[2], s[3]) or s[3].endswith("." + raw)}:
        return said(hit, "resolved_same_file")
    for _, alias, original in sorted((a for a in aliases if a[0] == path), key=lambda a: (-len(a[1]), a[2])):
        if raw == alias or raw.startswith(alias + "."):
            raw = original + raw[len(alias) :]
            break
    if relation == "imports":
        wanted = keys_of(raw, path)
        hit = set()
        for entity, p in files:
            bare = re.sub(r"(?<=[^/])\.[^./]+$", "", p)
            own = {p, bare.replace("/", "."), bare.split("/")[-1]} | ({p.removesuffix("/__init__.py")} if p.endswith("/__init__.py") else set())
            hit |= {entity} if own & wanted else set()
        return said(hit, "resolved") if hit else ("unresolved", None)
    tail = raw.rsplit(".", 1)[-1]
    names = lambda s: {s[2], s[3], s[3].split(":", 1)[-1]}
    for hit in (
        {o[0] for o in objects if raw in o[1:]}, {o[0] for o in objects if tail in o[1:]}, {s[0] for s in symbols if raw in names(s)}, {s[0] for s in symbols if tail in names(s)},
        {s[0] for s in symbols if any(n.endswith("." + raw) for n in names(s))},
    ):
        if hit:
            return said(hit, "resolved")
    return "unresolved", None


def test_every_stage_equals_the_loop(spark):
    rng = random.Random(5)
    paths = ["src/a.py", "src/b.py", "src/pkg/__init__.py", "src/pkg/c.py", "lib/a.ts", "lib/deep/x.go", "top.rb"]
    files = [(p, p) for p in paths]
    symbols = [(f"s{i}", rng.choice(paths), rng.choice("fghk"), q) for i in range(40) for q in [rng.choice(["A.f", "A.g", "B.f", "f", "g", "mod:A.h", "mod:k", "X.A.f", "A.B.k", "zz", "X.Y.only"])]]
    aliases = [(p, a, o) for p in paths[:4] for a, o in rng.sample([("np", "A"), ("np.sub", "B"), ("q", "src.b"), ("w", "nothing"), ("np", "B")], 3)]
    objects = [("o1", "/users", "api:/users"), ("o2", "q1", "queue.q1"), ("o3", "q1", "queue.q2")]
    targets = ["f", "A.f", "'B.f'", "k", "np.f", "np.sub.f", "np", "extends A<T>", "A::g", "q", "w.f", ".b", "..b", ".pkg", "./c", "../a", "src.a", "src/pkg", "a", "top", "Y.only", "only", "/users", "q1", "queue.q1", "x.queue.q1", "", "zz", "lib\\a"]
    scopes = [None, "A.g", "A.B.k", "A", "X.A.f"]
    rows = [(i, rng.choice(paths), rng.choice(scopes), rng.choice(["imports", "calls", "inherits"]), rng.choice(targets)) for i in range(600)] + [(600, None, None, "calls", "f"), (601, "src/a.py", None, "calls", None), (602, "src/a.py", None, None, "zz")]
    df = lambda data, ddl: spark.createDataFrame(data, ddl)
    got = resolution.resolve(
        df(rows, "i int, path string, scope string, relation string, name string"), df(symbols, "entity string, path string, display string, qualified string"), df(files, "entity string, path string"),
        df(aliases, "path string, alias string, original string"), df(objects, "entity string, display string, qualified string"),
    ).collect()
    want = {i: answer(p, s, r, n, symbols, files, aliases, objects) if p is not None and n is not None else ("unresolved", None) for i, p, s, r, n in rows}
    assert {r["i"]: (r["resolution"], r["target"]) for r in got} == want and len(got) == len(rows)
    assert {r["stage"] for r in got} == {None, *range(8)} - {resolution.OBJECT_TAIL} | ({resolution.OBJECT_TAIL} if any(r["stage"] == resolution.OBJECT_TAIL for r in got) else set())


def test_hot_names_are_split_and_no_row_is_lost(spark, monkeypatch):
    from corpuscle import shared

    monkeypatch.setattr(shared, "HOT", 3)  # a key with a third of the lookups goes by broadcast
    rows = [(i, "a.py", None, "calls", "hot" if i % 3 else f"n{i}") for i in range(300)]
    none = spark.createDataFrame([], "path string, alias string, original string")
    found = resolution.resolve(spark.createDataFrame(rows, "i int, path string, scope string, relation string, name string"), spark.createDataFrame([("e", "b.py", "hot", "hot")], "entity string, path string, display string, qualified string"), spark.createDataFrame([], "entity string, path string"), none)
    assert Counter(r["resolution"] for r in found.collect()) == {"resolved": 200, "unresolved": 100}


def test_a_name_of_many_files_is_looked_up_once(spark, monkeypatch):
    seen, real = [], resolution.join_facts
    monkeypatch.setattr(resolution, "join_facts", lambda rows, *rest: (seen.append(rows), real(rows, *rest))[1])
    rows = [(f"f{i}.py", None, "calls", f"n{i % 3}") for i in range(60)]
    none = spark.createDataFrame([], "path string, alias string, original string")
    found = resolution.resolve(spark.createDataFrame(rows, "path string, scope string, relation string, name string"), spark.createDataFrame([("e", "b.py", "n1", "n1")], "entity string, path string, display string, qualified string"), spark.createDataFrame([], "entity string, path string"), none)
    assert Counter((r["resolution"], r["target"]) for r in found.collect()) == {("resolved", "e"): 20, ("unresolved", None): 40}
    assert seen[0].where(seen[0]["stage"] > resolution.LOCAL).count() <= 3 * 5


def loop_stale(old, new):
    changed = {p for p in old.keys() & new.keys() if old[p][0] != new[p][0]} | new.keys() - old.keys()
    deleted = old.keys() - new.keys()
    moved = changed | deleted
    names = {s for p in moved for m in (old, new) for s in m.get(p, (0, [], [], []))[1]} | moved
    out = set(moved) | (set(new) if any(p.split("/")[-1].lower() == "package.json" for p in moved) else set())
    while True:
        more = set()
        for m in (old, new):
            for p, (_, _, imports, targets) in m.items():
                all_ = {*imports, *targets}
                reach = {k for x in imports for k in keys_of(x, p)}
                aim = {k for x in all_ for k in keys_of(x, p)}
                if reach & out or aim & moved or all_ & names or any(x.rsplit("/", 1)[-1] in names for x in all_):
                    more.add(p)
        if more <= out:
            return out
        out |= more


def test_stale_files_equal_the_loop(spark):
    rng = random.Random(6)
    paths = [f"src/p{i}.py" for i in range(30)]
    for build_file in (False, True):
        make = lambda: {p: (rng.choice("ab"), [f"s{rng.randrange(40)}"], rng.sample([f"src.p{rng.randrange(30)}", f".p{rng.randrange(30)}", "os"], rng.randint(0, 1)), rng.sample([f"s{rng.randrange(90)}", f"x/s{rng.randrange(90)}"], rng.randint(0, 1))) for p in paths}
        old = make()
        new = {p: (rng.choice("ab") if rng.random() < 0.1 else old[p][0], *old[p][1:]) for p in paths[2:]} | {"src/new.py": ("a", ["s1"], [], [])}
        if build_file:
            new["web/package.json"] = ("a", [], [], [])
        df = lambda m: spark.createDataFrame([(p, *v) for p, v in m.items()], "path string, hash string, symbols array<string>, imports array<string>, targets array<string>")
        got = {r["path"]: r["state"] for r in resolution.stale_files(df(old), df(new)).collect()}
        assert got.keys() == loop_stale(old, new)
        assert {p for p, s in got.items() if s == "deleted"} == set(paths[:2]) and any(s == "dependent" for s in got.values())


def test_only_stale_files_are_built_again(spark):
    rows = plans.QUERIES["maintained_files"](spark, "/root/testdata/sf0.01").collect()
    built = Counter(r["build"] for r in rows)
    assert built[1] > built[2] > 0


def test_maintain_calls_the_builder_with_dependents_alone(spark):
    keys = lambda n: spark.createDataFrame([(f"f{i}", "a" if i else n) for i in range(10)], "key string, hash string")
    asked = []

    def build(stale):
        asked.append(None if stale is None else sorted(r[0] for r in stale.collect()))
        return spark.createDataFrame([], "key string, n int") if stale is None else stale.selectExpr("key", "2 as n")

    view = spark.createDataFrame([(f"f{i}", 1) for i in range(10)], "key string, n int")
    got, how = architecture.maintain(view, keys("a"), keys("b"), lambda changed: changed.selectExpr("'f7' as key"), build)
    assert how == "incremental" and asked == [["f0", "f7"]] and sorted((r[0], r[1]) for r in got.collect()) == [(f"f{i}", 2 if i in (0, 7) else 1) for i in range(10)]
    assert architecture.maintain(view, keys("a"), keys("b"), lambda changed: view.select("key"), build)[1] == "cold" and asked[1] is None


def test_edges_to_what_is_no_file_are_not_walked(spark, monkeypatch):
    """Of the many paths that an import may stand for, only known files stay in the edges that each round reads."""
    kept, cut = [], resolution.cut
    monkeypatch.setattr(resolution, "cut", lambda df: kept.append(cut(df)) or kept[-1])
    cols = "path string, hash long, symbols array<string>, imports array<string>, targets array<string>"
    files = lambda h: spark.createDataFrame([("a.py", 1, [], ["b"], []), ("b.py", h, [], ["gone"], []), ("c.py", 1, [], ["a"], [])], cols)
    assert {tuple(r) for r in resolution.stale_files(files(1), files(2)).collect()} == {("b.py", "changed"), ("a.py", "dependent"), ("c.py", "dependent")}
    assert [{tuple(r) for r in df.select("by", "path").collect()} for df in kept if set(df.columns) == {"by", "path"}] == [{("a.py", "b.py"), ("c.py", "a.py")}]
