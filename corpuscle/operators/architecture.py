"""Building, resolving, projecting and maintaining a property graph of entities."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscle.operators.relational import top_per_group
from corpuscle.shared import cut, hot_keys

#: Kinds of entities that are files.
FILE_KINDS = ["module", "config", "test", "document"]
#: Terms that one search looks for at most.
MOST_TERMS = 10_000
#: Above this share of affected files a view is built anew.
REBUILD = 0.4


def key_of(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256)


def build_graph(entities: DataFrame, references: DataFrame, repo: str, targets: DataFrame | None = None, parts: int | None = None, finish: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> tuple[DataFrame, DataFrame]:
    """(key, kind, name, path) and (edge_key, src, dst, type, resolution, place) of entities(kind, name, path) and references(kind, name, path, target, type, anchor, place).

    A target is the only entity of that name. One that no entity or several have
    becomes an entity of kind unresolved or ambiguous of its own, so no reference is
    lost. Of edges with one key (source, type, target, anchor) the last by place stays.
    References are shuffled once, by their target, in `parts` partitions, and hashed after
    that; edges of a target lie together, so that files hold its hash once. After the
    shuffle, finish makes the columns beside target, so that numbers may be shuffled in
    place of texts. Targets that many references share have no hot key, their facts go by
    broadcast; they are counted in targets(target), if given, which then is less to read.
    """
    text = lambda *cols: F.concat_ws("|", *(F.coalesce(c.cast("string"), F.lit("")) for c in cols))
    of = lambda e: key_of(F.lit(repo), F.col(f"{e}.kind"), F.col("target"), F.col(f"{e}.path"))
    parts = parts or int(entities.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # a name's first and last entity are one if it has no other; no hash is shuffled for that
    each = F.struct("kind", "path")
    named = entities.where("name is not null").groupBy(F.col("name").alias("target")).agg(F.min(each).alias("low"), F.max(each).alias("high"))
    index = cut(named.select("target", F.when(F.col("low").eqNullSafe(F.col("high")), F.col("low")).alias("only"), F.lit(True).alias("known")))
    asked = references.where("target is not null")
    made = lambda rows: finish(rows).select("target", text(F.lit(repo), F.col("kind"), F.col("name"), F.col("path")).alias("_src"), "type", text(F.col("anchor")).alias("_anchor"), "place")
    last = lambda rows: rows.groupBy("target", "_src", F.struct(text(F.col("type")).alias("type"), "_anchor").alias("_by")).agg(F.max_by(F.struct("type", "place"), F.struct("place")).alias("e"))
    state = F.when(F.col("known").isNull(), "unresolved").when(F.col("only").isNull(), "ambiguous").otherwise("resolved")
    found = lambda rows, facts: rows.join(facts, "target", "left").withColumn("resolution", state)
    open_text = text(F.lit(repo), F.col("resolution"), F.col("target"), F.lit(""))

    hot = hot_keys(targets.where("target is not null") if targets is not None else asked, "target")
    rest = asked if hot is None else asked.join(F.broadcast(hot), "target", "left_anti")
    edges = found(last(made(rest.repartition(parts, "target"))), index.repartition(parts, "target").hint("shuffle_hash")).sortWithinPartitions("target")
    if hot is not None:
        edges = edges.unionByName(found(last(made(asked.join(F.broadcast(hot), "target", "left_semi"))), F.broadcast(index.join(F.broadcast(hot), "target", "left_semi"))))
    edges = edges.select("_src", "_by", F.when(F.col("resolution") == "resolved", of("only")).otherwise(F.sha2(open_text, 256)).alias("dst"), "e.type", "resolution", "e.place")
    # where a name or a path has a separator in it, entities of two names may have one key
    split = index.where("only is not null").where(F.concat_ws("", "only.kind", "target", "only.path").contains("|"))
    if not split.groupBy(of("only")).count().where("count > 1").isEmpty():
        edges = edges.groupBy("_src", "_by", "dst").agg(F.max_by(F.struct("type", "resolution", "place"), F.struct("place")).alias("e")).select("_src", "_by", "dst", "e.*")
    edges = edges.withColumn("src", F.sha2("_src", 256))
    edges = edges.select(key_of(F.col("src"), F.col("_by.type"), F.col("dst"), F.col("_by._anchor")).alias("edge_key"), "src", "dst", "type", "resolution", "place")

    own = entities.select("kind", "name", "path").distinct().select(key_of(F.lit(repo), F.col("kind"), F.col("name"), F.col("path")).alias("key"), "kind", "name", "path")
    open_ = found(asked.select("target").distinct(), index).where("resolution <> 'resolved'").select(F.sha2(open_text, 256).alias("key"), F.col("resolution").alias("kind"), F.col("target").alias("name"), F.lit("").alias("path"))
    return own.unionByName(open_), edges


def file_owners(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """(key, owner) of entities(key, kind) and edges(src, dst, type, place): a file owns itself, any other entity has the file of its first `contains` edge."""
    files = entities.where(F.col("kind").isin(FILE_KINDS)).select("key")
    first = edges.where("type = 'contains'").join(files.select(F.col("key").alias("src")), "src").groupBy(F.col("dst").alias("key")).agg(F.min_by("src", "place").alias("owner"))
    return files.select("key", F.col("key").alias("owner")).unionByName(first.join(files, "key", "left_anti"))


def resolve_names(entities: DataFrame, key: str, columns: list[str], kind: str, display: str, asked: DataFrame, limit: int = 20) -> DataFrame:
    """(asked, key, exact): entities that have the asked name in one of the columns, in any case; for a name without one, the best of a search.

    Names meet entities by equi-join; only the terms of names without an exact one, at most
    MOST_TERMS of them, are looked for in every text. A search gives 3 points
    for a term that is the display name, 1 for one that the columns contain.
    """
    names = asked.select("asked").distinct()
    each = entities.select(F.col(key).alias("key"), F.explode(F.array_distinct(F.array(*(F.lower(F.col(c).cast("string")) for c in columns)))).alias("name"))
    exact = cut(each.join(names, F.col("name") == F.lower("asked")).select("asked", "key").distinct())
    missing = asked.select("asked").distinct().join(exact.select("asked").distinct(), "asked", "left_anti")
    wanted = missing.select("asked", F.explode(F.filter(F.split(F.lower("asked"), r"\s+"), lambda t: t != "")).alias("term"))
    if wanted.count() > MOST_TERMS:
        raise ValueError(f"more than {MOST_TERMS} terms to search for at once; ask in parts")
    wanted = F.broadcast(wanted)
    text = F.lower(F.concat_ws(" ", *(F.col(c).cast("string") for c in columns)))
    rows = entities.select(F.col(key).alias("key"), F.col(kind).alias("kind"), F.lower(display).alias("display"), text.alias("text"))
    hits = rows.join(wanted, F.col("text").contains(F.col("term"))).groupBy("asked", "key", "kind", "display").agg(F.sum(F.when(F.col("term") == F.col("display"), 3).otherwise(1)).alias("score"))
    best = top_per_group(hits, ["asked"], [F.desc("score"), F.col("kind"), F.col("display"), F.col("key")], limit)
    return exact.withColumn("exact", F.lit(True)).unionByName(best.select("asked", "key", F.lit(False).alias("exact")))


def relation_quality(found: DataFrame, wanted: DataFrame) -> DataFrame:
    """One row (precision, recall, grounding) of edges (src, dst, type, path, start, end) against those wanted.

    Only types that are wanted count; which they are is told by sums of each type, as a
    join by type would gather all edges under a few keys. Precision and recall are over distinct tuples,
    grounding is the wanted rows that a found edge of the same path overlaps, over the
    tuples found rightly. A wanted row without path or start takes any; an end that
    is missing is the start. A ratio over nothing is null.
    """
    tuple_ = ["src", "type", "dst"]
    flags = found.select(*tuple_, F.when(F.col("type").isNotNull(), 1).otherwise(0).alias("f"), F.lit(0).alias("w")).unionByName(wanted.select(*tuple_, F.lit(0).alias("f"), F.lit(1).alias("w")))
    sums = [F.sum("f").alias("found"), F.sum("w").alias("wanted"), F.sum(F.col("f") * F.col("w")).alias("right")]
    by_type = flags.groupBy(*tuple_).agg(F.max("f").alias("f"), F.max("w").alias("w")).groupBy("type").agg(*sums)
    per = by_type.where("wanted > 0").agg(*(F.sum(c).alias(c) for c in ("found", "wanted", "right")))
    g = found.select(*(F.col(c).alias(f"_{c}") for c in tuple_), F.col("path").alias("_path"), F.col("start").alias("_start"), F.coalesce("end", "start").alias("_end"))
    same = (F.col("src") == F.col("_src")) & (F.col("type") == F.col("_type")) & (F.col("dst") == F.col("_dst"))
    meets = F.col("start").isNull() | ((F.col("_end") >= F.col("start")) & (F.col("_start") <= F.coalesce("end", "start")))
    there = F.col("path").isNull() | (F.col("path") == "") | (F.col("path") == F.col("_path"))
    grounded = wanted.join(g, same & meets & there, "left_semi").agg(F.count("*").alias("grounded"))
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    return per.crossJoin(F.broadcast(grounded)).select(ratio("right", "found").alias("precision"), ratio("right", "wanted").alias("recall"), ratio("grounded", "right").alias("grounding"))


def diff_map(base: DataFrame, head: DataFrame, base_edges: DataFrame, head_edges: DataFrame, aliases: DataFrame, limit: int = 500) -> tuple[DataFrame, DataFrame]:
    """Nodes (key, domain, path, status) and edges (src, dst, type, status) of what changed between two graphs.

    Entities are (key, domain, path, hash), edges (src, dst, type), aliases (before,
    after, status). A node's first status of added, removed, changed, alias or
    ambiguous, context counts; context nodes are known endpoints of changed edges. The
    first `limit` nodes by domain, path and key stay, and twice as many edges between them.
    """
    both = base.select("key", F.struct("domain", "path").alias("b"), F.col("hash").alias("bh")).join(head.select("key", F.struct("domain", "path").alias("h"), F.col("hash").alias("hh")), "key", "full_outer")
    known = cut(both.select("key", F.coalesce("h", "b").alias("at"), F.when(F.col("b").isNull(), 0).when(F.col("h").isNull(), 1).when(~F.col("bh").eqNullSafe(F.col("hh")), 2).alias("level")))
    edge = ["src", "dst", "type"]
    a, b = head_edges.select(*edge).distinct(), base_edges.select(*edge).distinct()
    moved = cut(a.join(b, edge, "left_anti").withColumn("turn", F.lit(0)).unionByName(b.join(a, edge, "left_anti").withColumn("turn", F.lit(1))))
    named = aliases.select("before", "after", F.when(F.col("status") == "confirmed", 3).otherwise(4).alias("level"), "status")
    marks = known.where("level is not null").select("key", "level").unionByName(named.select(F.explode(F.array("before", "after")).alias("key"), "level"))
    marks = marks.unionByName(moved.select(F.explode(F.array("src", "dst")).alias("key"), F.lit(5).alias("level")))
    level = marks.groupBy("key").agg(F.min("level").alias("level"))
    status = F.element_at(F.array(*(F.lit(s) for s in ("added", "removed", "changed", "alias", "ambiguous", "context"))), F.col("l") + 1)
    nodes = cut(level.select("key", F.col("level").alias("l")).join(known.select("key", "at"), "key").select("key", "at.domain", "at.path", status.alias("status")).orderBy("domain", "path", "key").limit(max(1, limit)))
    links = moved.select(*edge, F.when(F.col("turn") == 0, "added").otherwise("removed").alias("status"), "turn")
    links = links.unionByName(named.select(F.col("before").alias("src"), F.col("after").alias("dst"), F.lit("alias").alias("type"), "status", F.lit(2).alias("turn")))
    for end in ("src", "dst"):
        links = links.join(F.broadcast(nodes.select(F.col("key").alias(end))), end, "left_semi")
    return nodes, links.orderBy("turn", "src", "dst", "type").limit(max(1, 2 * limit)).drop("turn")


def maintain(view: DataFrame, before: DataFrame, now: DataFrame, dependents: Callable[[DataFrame], DataFrame], build: Callable[[DataFrame | None], DataFrame], owner: str = "key") -> tuple[DataFrame, str]:
    """The view of `now`(key, hash) out of the view of `before`, and how it came about: cold or incremental.

    Affected are changed, added and deleted files and dependents(changed) of them. If
    they are more than REBUILD of the files, build(None) builds all; otherwise
    build(affected) gives the rows of affected owners and the others stay.
    """
    both = before.select("key", F.col("hash").alias("b")).join(now.select("key", F.col("hash").alias("n")), "key", "full_outer")
    changed = cut(both.where(~F.col("b").eqNullSafe(F.col("n"))).select("key"))
    affected = cut(changed.unionByName(dependents(changed).select("key")).distinct())
    if affected.count() > REBUILD * max(1, now.count()):
        return build(None), "cold"
    kept = view.join(affected.select(F.col("key").alias(owner)), owner, "left_anti")
    return kept.unionByName(build(affected)), "incremental"
