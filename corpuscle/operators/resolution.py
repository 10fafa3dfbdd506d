"""Resolution of names to entities by a cascade of candidate joins, and what a change makes stale."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscle.shared import cut, join_facts

#: Relations whose targets are files; all others name symbols.
FILE_RELATIONS = ["imports", "documents", "configures"]
#: What a module path may end in, in order.
FILE_ENDINGS = [
    "", ".py", ".js", ".ts", ".tsx", ".go", ".rs", ".java", ".kt", ".rb", ".php",
    "/__init__.py", "/index.ts", "/index.js",
]
#: Files whose change makes every file stale.
BUILD_FILES = [
    "package.json", "tsconfig.json", "go.mod", "cargo.toml", "pom.xml", "build.gradle", "build.gradle.kts", "gemfile",
    "composer.json",
]
#: Stages of the cascade; the least that has a hit decides.
SCOPED, LOCAL, FILE, OBJECT, OBJECT_TAIL, SYMBOL, SYMBOL_TAIL, SUFFIX = range(8)
_SEP = "\x00"


def plain_name(target: Column) -> Column:
    """A target without quotes, a leading keyword and type arguments, its parts joined by dots."""
    bare = F.regexp_replace(F.trim(target), r"""^['"]+|['"]+$""", "")
    bare = F.trim(F.regexp_replace(bare, r"^(?:extends|implements|super|trait)\s+", ""))
    return F.trim(F.substring_index(F.replace(bare, F.lit("::"), F.lit(".")), "<", 1))


def _tail(name: Column) -> Column:
    return F.substring_index(name, ".", -1)


def leading_parts(name: Column) -> Column:
    """a, a.b, a.b.c of a.b.c."""
    parts = F.split(name, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "."))


def dotted_suffixes(name: Column) -> Column:
    """What follows each dot of a name."""
    parts = F.split(name, r"\.")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(2), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))).otherwise(F.array().cast("array<string>"))


def normal_path(path: Column) -> Column:
    """A path without empty parts and '.', and with '..' taken back where it can be."""
    none = F.array().cast("array<string>")
    step = lambda done, p: F.when((p == "") | (p == "."), done).when((p == "..") & (F.size(done) > 0) & (F.try_element_at(done, F.lit(-1)) != ".."), F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(p)))
    return F.array_join(F.aggregate(F.split(path, "/"), none, step), "/")


def file_candidates(name: Column, source_path: Column) -> Column:
    """Distinct file keys that a module name may stand for; leading dots count folders up from the source."""
    dots = F.length(name) - F.length(F.regexp_replace(name, r"^\.+", ""))
    parts = F.split(source_path, "/")
    base = F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - dots, F.lit(0))), "/")
    rest = F.regexp_replace(name, r"^\.+/*", "")
    near = normal_path(F.concat(base, F.lit("/"), rest))
    value = F.regexp_replace(F.when(dots > 0, near).otherwise(F.replace(name, F.lit("\\"), F.lit("/"))), "^/+|/+$", "")
    path = F.replace(value, F.lit("."), F.lit("/"))
    every = F.concat(F.array(name, value), F.transform(F.array(*map(F.lit, FILE_ENDINGS)), lambda e: F.concat(path, e)))
    return F.filter(F.array_distinct(every), lambda p: (p != "") & (p != "."))


def file_keys(files: DataFrame) -> DataFrame:
    """(key, entity): a file by its path, its module name, its stem and, for a package, its folder."""
    bare = F.regexp_replace("path", r"(?<=[^/])\.[^./]+$", "")
    folder = F.when(F.col("path").endswith("/__init__.py"), F.regexp_replace("path", "/__init__.py$", ""))
    keys = F.array(F.col("path"), F.replace(bare, F.lit("/"), F.lit(".")), F.substring_index(bare, "/", -1), folder)
    trimmed = F.transform(keys, lambda k: F.regexp_replace(F.replace(k, F.lit("\\"), F.lit("/")), "^/+|/+$", ""))
    return files.select(F.explode(F.array_distinct(F.array_compact(trimmed))).alias("key"), "entity").where("key <> ''")


def rewritten(asks: DataFrame, aliases: DataFrame) -> DataFrame:
    """asks(path, name, ...) with name rewritten by the longest alias(path, alias, original) of its file that leads it; the first by original of equals."""
    known = aliases.where("alias <> ''").groupBy("path", "alias").agg(F.min("original").alias("original"))
    leads = asks.select("path", "name").distinct().withColumn("alias", F.explode(leading_parts(F.col("name"))))
    best = leads.join(known, ["path", "alias"]).groupBy("path", "name").agg(F.max_by(F.struct("alias", "original"), F.length("alias")).alias("a"))
    own = asks.join(best, ["path", "name"], "left")
    return own.withColumn("name", F.when(F.col("a").isNull(), F.col("name")).otherwise(F.concat("a.original", F.substr("name", F.length("a.alias") + 1)))).drop("a")


def resolve(relations: DataFrame, symbols: DataFrame, files: DataFrame, aliases: DataFrame, objects: DataFrame | None = None, more_file_keys: DataFrame | None = None) -> DataFrame:
    """relations with stage, resolution (resolved_same_file, resolved, ambiguous, unresolved) and target, the entity.

    relations(path, scope, relation, name, ...), where scope is the qualified name of
    the symbol that refers, or null; symbols(entity, path, display, qualified);
    files(entity, path); aliases(path, alias, original); objects(entity, display,
    qualified) are known before symbols, such as endpoints and queues.

    A name is looked up in its own scope, in its own file, and then, rewritten by the
    longest alias of its file, among the files it may stand for or by whole name, by
    last part and as the end of a longer name. The first of these stages with a hit
    decides: one entity is the target, several are ambiguous.

    Relations are numbered and written once. What does not depend on their file is looked
    up once for each distinct name, what does for each relation; all lookups are one join
    with one index, whose facts are one row for each key, and a lookup is a number, a
    stage and a key. Keys and names that a large share of the rows have are never hot.
    Null names and paths stay unresolved.
    """
    kind = F.coalesce(F.col("relation").isin(FILE_RELATIONS), F.lit(False))
    asks = cut(relations.withColumns({"_file": kind, "_raw": plain_name(F.col("name")), "_row": F.monotonically_increasing_id()}))
    there = asks.where("path is not null and name is not null")
    folder = F.when(F.col("_file") & F.col("name").startswith("."), F.col("path")).otherwise(F.lit("")).alias("_from")
    called = cut(rewritten(there.select("_row", "_file", "path", F.col("_raw").alias("name")), aliases).select("_row", "_file", "name", folder))
    names = cut(called.groupBy("_file", "name", "_from").agg(F.count("*").alias("weight")).withColumn("_name", F.monotonically_increasing_id()))
    outer = F.when(F.contains("scope", F.lit(".")) & ~F.contains("_raw", F.lit(".")), F.regexp_extract("scope", r"^(.*)\.[^.]*$", 1))
    look = lambda stage, key: F.struct(F.lit(stage).alias("stage"), key.alias("key"))
    own = lambda name: F.concat(F.col("path"), F.lit(_SEP), name)
    near = F.array(look(SCOPED, own(F.concat(outer, F.lit("."), F.col("_raw")))), look(LOCAL, own(F.col("_raw"))))
    as_file = F.transform(file_candidates(F.col("name"), F.col("_from")), lambda k: F.struct(F.lit(FILE).alias("stage"), k.alias("key")))
    as_object = [] if objects is None else [look(OBJECT, F.col("name")), look(OBJECT_TAIL, _tail(F.col("name")))]
    as_name = F.array(*as_object, look(SYMBOL, F.col("name")), look(SYMBOL_TAIL, _tail(F.col("name"))), look(SUFFIX, F.col("name")))
    of_rows = there.select(F.lit(True).alias("one"), F.col("_row").alias("id"), F.explode(near).alias("l"))
    of_names = names.select(F.lit(False).alias("one"), F.col("_name").alias("id"), F.explode(F.when(F.col("_file"), as_file).otherwise(as_name)).alias("l"))
    lookups = of_rows.unionByName(of_names).select("one", "id", "l.*").where("key is not null")

    named = symbols.select("entity", "path", "display", "qualified", F.array_distinct(F.array_compact(F.array(F.col("display"), F.col("qualified"), F.regexp_replace("qualified", "^[^:]*:", "")))).alias("names"))
    entry = lambda df, stage, key: df.select(F.lit(stage).alias("stage"), key.alias("key"), "entity")
    local = F.array_distinct(F.concat(F.array_compact(F.array("display", "qualified")), F.coalesce(dotted_suffixes(F.col("qualified")), F.array().cast("array<string>"))))
    index = entry(named, SCOPED, own(F.col("qualified"))).unionByName(named.select(F.lit(LOCAL).alias("stage"), F.explode(F.transform(local, own)).alias("key"), "entity"))
    keys = file_keys(files)
    keys = keys if more_file_keys is None else keys.unionByName(more_file_keys.select("key", "entity"))
    index = index.unionByName(entry(keys, FILE, F.col("key")))
    whole = named.select(F.explode("names").alias("key"), "entity")
    tails = named.select(F.explode(F.array_distinct(F.flatten(F.transform("names", dotted_suffixes)))).alias("key"), "entity")
    index = index.unionByName(entry(whole, SYMBOL, F.col("key"))).unionByName(entry(whole, SYMBOL_TAIL, F.col("key"))).unionByName(entry(tails, SUFFIX, F.col("key")))
    if objects is not None:
        held = objects.select(F.explode(F.array_distinct(F.array_compact(F.array("display", "qualified")))).alias("key"), "entity")
        index = index.unionByName(entry(held, OBJECT, F.col("key"))).unionByName(entry(held, OBJECT_TAIL, F.col("key")))
    facts = index.where("key is not null").groupBy("stage", "key").agg(F.min("entity").alias("low"), F.max("entity").alias("high"))

    weights = lookups.groupBy("stage", "key").agg(F.count("*").alias("weight"))
    known = cut(weights.join(facts, ["stage", "key"]))
    total = known.agg(F.coalesce(F.sum("weight"), F.lit(0))).first()[0]
    hits = join_facts(lookups, known, ["stage", "key"], "weight", total)
    # of the least stage, the least entity and the greatest; those that are null come last
    lowest, highest = F.min(F.struct("stage", F.col("low").isNull().alias("no"), "low")), F.max(F.struct((-F.col("stage")).alias("stage"), "high"))
    found = cut(hits.groupBy("one", "id").agg(lowest.alias("l"), highest.alias("h")).select("one", "id", F.struct("l.stage", "l.low", "h.high").alias("hit")))
    answers = names.join(found.where("not one").select(F.col("id").alias("_name"), "hit"), "_name").select("_file", "name", "_from", "weight", "hit")
    named = join_facts(called, answers, ["_file", "name", "_from"], "weight", called.count()).select("_row", "hit")
    best = named.unionByName(found.where("one").select(F.col("id").alias("_row"), "hit")).groupBy("_row").agg(F.min_by("hit", "hit.stage").alias("hit"))
    one = F.col("hit.low") == F.col("hit.high")
    state = F.when(F.col("hit").isNull(), "unresolved").when(~one, "ambiguous").when(F.col("hit.stage") <= LOCAL, "resolved_same_file").otherwise("resolved")
    return asks.join(best, "_row", "left").select(*relations.columns, F.col("hit.stage").alias("stage"), state.alias("resolution"), F.when(one, F.col("hit.low")).alias("target"))


def stale_files(before: DataFrame, now: DataFrame) -> DataFrame:
    """(path, state) of the files to build again: changed (or new), deleted, or dependent.

    Both are manifests (path, hash, symbols, imports, targets), arrays of names. A
    changed or deleted file makes stale who imports it, who targets it or one of its
    symbols of before or now, and on from there who imports a stale file. A change of a
    build file makes every file stale. The walk goes frontier by frontier over import
    edges that are written once.
    """
    old, new = before.select("path", F.col("hash").alias("old")), now.select("path", F.col("hash").alias("new"))
    both = old.withColumn("was", F.lit(True)).join(new.withColumn("is", F.lit(True)), "path", "full_outer")
    moved = cut(both.where(F.col("was").isNull() | F.col("is").isNull() | ~F.col("old").eqNullSafe(F.col("new"))).select("path", F.when(F.col("is").isNull(), "deleted").otherwise("changed").alias("state")))
    every = before.select("path", "symbols", "imports", "targets").unionByName(now.select("path", "symbols", "imports", "targets"))
    names = every.join(moved.select("path"), "path", "left_semi").select(F.explode("symbols").alias("name")).unionByName(moved.select(F.col("path").alias("name"))).distinct()
    reach = lambda column: F.flatten(F.transform(F.coalesce(column, F.array().cast("array<string>")), lambda x: file_candidates(x, F.col("path"))))
    edges = cut(every.select(F.col("path").alias("by"), F.explode(F.array_distinct(reach(F.col("imports")))).alias("path")).where("by <> path").distinct().join(every.select("path").distinct(), "path", "left_semi"))  # most candidates are no files
    wanted = F.concat(F.coalesce("imports", F.array().cast("array<string>")), F.coalesce("targets", F.array().cast("array<string>")))
    called = every.select(F.col("path").alias("by"), F.explode(F.array_distinct(F.concat(wanted, F.transform(wanted, lambda x: F.substring_index(x, "/", -1))))).alias("name"))
    aimed = every.select(F.col("path").alias("by"), F.explode(F.array_distinct(reach(wanted))).alias("path"))
    frontier = called.join(names, "name", "left_semi").select(F.col("by").alias("path")).unionByName(aimed.join(moved.select("path"), "path", "left_semi").select(F.col("by").alias("path")))
    if not moved.where(F.lower(F.substring_index("path", "/", -1)).isin(BUILD_FILES)).isEmpty():
        frontier = frontier.unionByName(now.select("path"))
    seen = cut(moved.select("path").unionByName(frontier).distinct())
    last = seen
    while not last.isEmpty():
        step = edges.join(last, "path", "left_semi").select(F.col("by").alias("path")).distinct()
        last = cut(step.join(seen, "path", "left_anti"))
        seen = seen.unionByName(last)
    return cut(seen.join(moved, "path", "left").select("path", F.coalesce("state", F.lit("dependent")).alias("state")))
