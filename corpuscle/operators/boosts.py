"""The chain of boosts: ordered passes over one table of candidates, each of which reads the scores and reasons of those before."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuscle.functions import text
from corpuscle.operators.related import ENTRYPOINT_ROLES, IMPLEMENTATION_ROLES, NOISE
from corpuscle.shared import cut, join_facts

# Reasons that make a seed of the second pass, that are strong evidence, and that are weak alone.
SEED_REASONS = ["modified", "staged", "workspace match", "cross-layer related", "recall neighbor", "historically co-changed"]
STRONG_REASONS = [
    "symbol keyword match", "content keyword match", "matched entrypoint", "matched external system", "matched domain", "matched env read", "matched side effect", "direct dependency",
    "reverse dependency", "has related tests", "test for", "config file", "release/version metadata", "knowledge/architecture doc", "historically co-changed",
]
WEAK_REASONS = ["filename keyword match", "symbol keyword match", "matched role keyword", "matched ranking keyword", "matched define", "matched call", "matched naming keyword"]
# File names that are configuration, and that stand for the route of their folder.
CONFIG_SUFFIXES = [".toml", ".yaml", ".yml", ".json", ".env", ".ini", ".cfg", ".conf", ".dockerfile", ".makefile"]
CONFIG_STEMS = ["config", "settings", "configuration", "env", ".env", "pyproject", "package", "dockerfile", "makefile", "cargo", "go", "build", "cmake"]
ROUTE_STEMS = ["route", "routes", "urls", "views", "controller"]


@dataclass(frozen=True)
class Weights:
    """Points of the passes. The defaults."""

    related_test: float = 35.0
    cross_layer_related: float = 30.0
    recall_neighbor: float = 24.0
    workspace_match: float = 32.0
    graph_base: float = 8.0
    graph_each: float = 4.0
    graph_most: float = 24.0
    graph_neighbors: int = 200
    changed_seed: float = 8.0
    recall_score: float = 120.0
    recall_seeds: int = 8
    second_score: float = 100.0
    second_seeds: int = 10
    second_domain: float = 4.0
    second_most: int = 32
    consumer_base: float = 90.0
    consumer_most: float = 150.0
    consumer_keyword: float = 45.0
    pair_score: float = 90.0
    pair_more: float = 15.0
    pair_most: float = 85.0
    pair_keyword: float = 25.0
    entry_points: int = 5
    noise_each: float = 6.0
    noise_more: float = 4.0
    noise_most: float = 45.0


@dataclass
class Context:
    """What the passes look up beside the candidates, all by group g.

    tasks(g, keywords, words, generic_ratio), one row for each group; edges(g, src,
    dst, type, edge_key) of the graph; near(g, a, b), pairs of files that import or test
    each other; workspaces(g, root); needs(g, root, dep) between workspaces;
    noise(g, path, n); feedback(g, path, amount).
    """

    tasks: DataFrame
    edges: DataFrame
    near: DataFrame
    workspaces: DataFrame
    needs: DataFrame
    noise: DataFrame
    feedback: DataFrame
    weights: Weights = Weights()


def _list(values: Sequence[str]) -> Column:
    return F.array(*(F.lit(v) for v in values)).cast("array<string>")


def _starts(reason: Column, prefixes: Sequence[str]) -> Column:
    return F.greatest(F.lit(False), *(reason.startswith(p) for p in prefixes))


def _any(reasons: str, prefixes: Sequence[str]) -> Column:
    return F.exists(reasons, lambda r: _starts(r, prefixes))


def _name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def _stem(name: Column) -> Column:
    return F.regexp_replace(name, r"(?<=.)\.[^./]+$", "")


def route_terms(path: Column) -> Column:
    """The terms of a path behind its folder `api`, without the file that stands for the route; empty for other paths."""
    parts = F.split(F.lower(path), "/")
    at = F.array_position(parts, "api")
    behind = F.when(at > 0, F.slice(parts, at.cast("int") + 1, F.size(parts))).otherwise(F.array().cast("array<string>"))
    last = F.try_element_at(behind, F.lit(-1))
    own = F.when(_stem(last).isin(ROUTE_STEMS), F.slice(behind, F.lit(1), F.greatest(F.size(behind) - 1, F.lit(0)))).otherwise(behind)
    bare = F.filter(F.transform(own, lambda p: F.regexp_replace(p, r"^[\[\](){}]+|[\[\](){}]+$", "")), lambda p: (p != "") & ~p.startswith("_"))
    return F.array_distinct(F.filter(F.flatten(F.transform(bare, text.ordered_tokens)), lambda t: ~t.isin(NOISE)))


def candidates(df: DataFrame) -> DataFrame:
    """The table of the chain out of (g, path, score, reasons, changed, skipped, workspace, api_path, calls): one row for each path of a group.

    workspace is the workspace of the path or null, api_path the path it answers for
    or null, calls the API paths that a client file uses. A null group is the group ''.
    """
    name, p = _name(F.col("path")), F.col("path")
    stem, parts, tokens = _stem(name), F.split("path", "/"), text.path_tokens(F.col("path"))
    test = stem.startswith("test_") | stem.endswith("_test") | stem.endswith(".test") | stem.endswith(".spec") | F.arrays_overlap(parts, _list(["tests", "__tests__"]))
    words = F.split(F.lower(name), "[^a-z0-9]+")
    config = F.regexp_extract(F.lower(name), r"(?<=.)\.[^./]+$", 0).isin(CONFIG_SUFFIXES) | F.lower(stem).isin(CONFIG_STEMS) | F.arrays_overlap(words, _list(["config", "conf"]))
    domain = F.filter(tokens, lambda t: (F.length(t) >= 3) & ~t.isin(NOISE))
    none = F.array().cast("array<string>")
    return df.select(
        F.coalesce(F.col("g").cast("string"), F.lit("")).alias("g"), p, F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"), F.coalesce("reasons", none).alias("reasons"), F.coalesce("changed", F.lit(False)).alias("changed"),
        F.coalesce("skipped", F.lit(False)).alias("skipped"), "workspace", "api_path", F.coalesce("calls", none).alias("calls"), test.alias("test"), config.alias("config"), stem.alias("stem"), domain.alias("domain"),
        F.arrays_overlap(tokens, _list(ENTRYPOINT_ROLES)).alias("entry"), F.arrays_overlap(tokens, _list(IMPLEMENTATION_ROLES)).alias("implementation"), route_terms(p).alias("route"),
    ).where("path is not null")


def _apply(rows: DataFrame, boosts: DataFrame, zero: bool = False) -> DataFrame:
    """rows with the amount and the reason of boosts(g, path, amount, reason), at most one for each path; zero: an amount that is null sets the score to 0."""
    met = rows.join(boosts, ["g", "path"], "left")
    score = F.col("score") + F.coalesce("amount", F.lit(0.0))
    if zero:
        score = F.when(F.col("reason").isNotNull(), F.when(F.col("amount").isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), score))).otherwise(score)
    return met.withColumn("score", score).withColumn("reasons", F.when(F.col("reason").isNotNull(), F.concat("reasons", F.array("reason"))).otherwise(F.col("reasons"))).drop("amount", "reason")


def graph(rows: DataFrame, c: Context) -> DataFrame:
    """Files that edges of any type join to a changed file, more for more types."""
    w = c.weights
    changed = rows.where("changed").select("g", F.col("path").alias("src"))
    both = c.edges.select("g", "src", "dst", "type", "edge_key").unionByName(c.edges.select("g", F.col("dst").alias("src"), F.col("src").alias("dst"), "type", "edge_key"))
    met = both.where("src <> dst").join(changed, ["g", "src"])
    first = met.withColumn("n", F.row_number().over(Window.partitionBy("g", "src").orderBy("edge_key", "dst", "type"))).where(F.col("n") <= w.graph_neighbors)
    per = first.groupBy("g", F.col("dst").alias("path")).agg(F.array_sort(F.collect_set("type")).alias("types"))
    amount = F.least(F.lit(w.graph_most), w.graph_base + w.graph_each * F.size("types"))
    return _apply(rows, per.select("g", "path", amount.alias("amount"), F.concat(F.lit("semantic graph: "), F.array_join("types", ", "), F.lit(" from changed file")).alias("reason")))


def workspace(rows: DataFrame, c: Context) -> DataFrame:
    """Files of workspaces that are changed or named, then of those they need, then of those that need them."""
    w = c.weights
    named = c.workspaces.withColumn("word", F.explode(text.path_tokens(F.col("root")))).join(c.tasks.select("g", F.explode("words").alias("word")), ["g", "word"]).select("g", "root")
    active = cut(rows.where("changed and workspace is not null").select("g", F.col("workspace").alias("root")).unionByName(named).distinct())
    level = lambda df, n: df.select("g", "root", F.lit(n).alias("level"))
    deps = c.needs.join(active, ["g", "root"]).select("g", F.col("dep").alias("root"))
    users = c.needs.join(active.select("g", F.col("root").alias("dep")), ["g", "dep"]).select("g", "root")
    best = level(active, 0).unionByName(level(deps, 1)).unionByName(level(users, 2)).groupBy("g", F.col("root").alias("workspace")).agg(F.min("level").alias("level"))
    hit = rows.where("not skipped").select("g", "path", "workspace").join(best, ["g", "workspace"])
    amount = F.when(F.col("level") == 0, w.workspace_match).when(F.col("level") == 1, w.recall_neighbor).otherwise(w.recall_neighbor * 0.5)
    said = F.element_at(_list(["workspace match ", "workspace dependency ", "workspace dependent "]), F.col("level") + 1)
    return _apply(rows, hit.select("g", "path", amount.alias("amount"), F.concat(said, "workspace").alias("reason")))


def _met(near: DataFrame, seeds: DataFrame) -> DataFrame:
    """(g, path, seeds): neighbours of seeds(g, path, seeds array), hubs of which stay where they are."""
    both = near.select("g", "a", "b").unionByName(near.select("g", F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    degree = both.groupBy("g", "a").agg(F.count("*").alias("degree")).join(seeds.select("g", F.col("path").alias("a"), "seeds"), ["g", "a"])
    facts = cut(degree)
    return join_facts(both, facts, ["g", "a"], "degree", facts.agg(F.coalesce(F.sum("degree"), F.lit(0))).first()[0]).select("g", F.col("a").alias("hop"), F.col("b").alias("path"), "seeds")


def _seeds(rows: DataFrame, cond: Column, order: list[Column], most: int, *extra: str) -> DataFrame:
    """(g, path, n, ...): the first rows of each group that may be seeds, numbered."""
    best = rows.where(cond).withColumn("n", F.row_number().over(Window.partitionBy("g").orderBy(*order)))
    return cut(best.where(F.col("n") <= most).select("g", "path", "n", *extra))


def recall(rows: DataFrame, c: Context) -> DataFrame:
    """Neighbours of the changed and of the best files."""
    w = c.weights
    seeds = _seeds(rows, F.col("changed") | (F.col("score") >= w.recall_score), [F.desc("changed"), F.desc("score"), F.col("path")], w.recall_seeds, "changed")
    seed = F.struct(F.when(F.col("changed"), -w.changed_seed).otherwise(0.0).alias("worth"), "n", F.col("path").alias("seed"))
    best = _met(c.near, seeds.select("g", "path", seed.alias("seeds"))).groupBy("g", "path").agg(F.min("seeds").alias("s"))
    told = best.join(rows.where("not skipped").select("g", "path"), ["g", "path"])
    return _apply(rows, told.select("g", "path", (w.recall_neighbor - F.col("s.worth")).alias("amount"), F.concat(F.lit("recall neighbor of "), "s.seed").alias("reason")))


def substrings(word: Column) -> Column:
    """Every non-empty part of a short word, and the word without its test_."""
    size = F.length(word)
    parts = F.transform(F.sequence(F.lit(1), size), lambda i: F.transform(F.sequence(F.lit(1), size - i + 1), lambda n: F.substr(word, i, n)))
    return F.when(size > 0, F.array_distinct(F.concat(F.flatten(parts), F.array(F.replace(word, F.lit("test_"), F.lit("")))))).otherwise(F.array().cast("array<string>"))


def second_pass(rows: DataFrame, c: Context) -> DataFrame:
    """Files two steps from strong seeds that are a test of what lies there, share a domain, or are configuration; the best few of a group."""
    w = c.weights
    seeds = _seeds(rows, (F.col("score") >= w.second_score) | _any("reasons", SEED_REASONS), [F.desc("score"), F.col("path")], w.second_seeds, "domain")
    seeds = seeds.join(c.tasks.select("g", F.filter("keywords", lambda k: ~k.isin(NOISE)).alias("k")), "g", "left").select("g", "path", "n", F.array_union("domain", F.coalesce("k", F.array().cast("array<string>"))).alias("wide"))
    known = rows.select("g", "path")
    one = _met(c.near, seeds.select("g", "path", F.array(F.col("n")).alias("seeds"))).join(known, ["g", "path"]).select("g", "path", F.explode("seeds").alias("n")).distinct()
    one = cut(one)
    two = _met(c.near, one.groupBy("g", "path").agg(F.array_sort(F.collect_set("n")).alias("seeds"))).select("g", "path", F.explode("seeds").alias("n")).distinct()
    two = two.join(one, ["g", "path", "n"], "left_anti").join(seeds.select("g", "path", "n"), ["g", "path", "n"], "left_anti")
    own = cut(two.join(rows.where("not skipped").select("g", "path", "test", "config", "domain", "stem"), ["g", "path"]).join(seeds.select("g", "n", F.col("path").alias("seed"), "wide"), ["g", "n"]))
    stems = one.join(rows.select("g", "path", "stem"), ["g", "path"]).select("g", "n", "stem").unionByName(seeds.join(rows.select("g", "path", "stem"), ["g", "path"]).select("g", "n", "stem")).unionByName(seeds.select("g", "n", F.explode("wide").alias("stem")))
    tests = own.where("test").select("g", "n", "path", F.explode(substrings(F.col("stem"))).alias("stem")).join(stems.distinct(), ["g", "n", "stem"]).select("g", "n", "path").distinct().withColumn("pair", F.lit(True))
    shares = F.arrays_overlap("domain", "wide")
    judged = own.join(tests, ["g", "n", "path"], "left").withColumn("pair", F.coalesce("pair", F.lit(False))).withColumn("shares", shares)
    good = judged.where(F.col("pair") | F.col("shares") | (F.col("config") & (F.size("wide") > 0)))
    amount = w.recall_neighbor * 0.5 + F.when(F.col("shares"), w.second_domain).otherwise(0.0)
    best = good.groupBy("g", "path").agg(F.min(F.struct((-amount).alias("less"), "n", "pair", "seed")).alias("b"))
    kept = best.withColumn("rank", F.row_number().over(Window.partitionBy("g").orderBy("b.less", "b.n", "path"))).where(F.col("rank") <= w.second_most)
    said = F.when(F.col("b.pair"), "second-pass related test of ").otherwise("second-pass recall neighbor of ")
    return _apply(rows, kept.select("g", "path", (-F.col("b.less")).alias("amount"), F.concat(said, "b.seed").alias("reason")))


def api_consumers(rows: DataFrame, c: Context) -> DataFrame:
    """Files that answer for an API path which a client file of a positive score calls."""
    w = c.weights
    ends = rows.where("api_path is not null").groupBy("g", "api_path").agg(F.max("path").alias("path"))
    calls = rows.where("score > 0").select("g", F.col("path").alias("consumer"), F.explode("calls").alias("api_path")).distinct()
    first = calls.withColumn("n", F.row_number().over(Window.partitionBy("g", "api_path").orderBy("consumer"))).where("n <= 2")  # one of them is not the file itself
    met = first.join(ends, ["g", "api_path"]).where("consumer <> path").join(c.tasks.select("g", "keywords"), "g", "left")
    wanted = F.arrays_overlap(F.split(F.lower("api_path"), "[^a-z0-9]+"), F.filter("keywords", lambda k: ~k.isin(NOISE)))
    amount = F.lit(min(w.consumer_most, w.consumer_base + w.cross_layer_related * 0.6)) + F.when(wanted, w.consumer_keyword).otherwise(0.0)
    best = met.groupBy("g", "path").agg(F.min(F.struct((-amount).alias("less"), "api_path", "consumer")).alias("b"))
    return _apply(rows, best.select("g", "path", (-F.col("b.less")).alias("amount"), F.concat(F.lit("API producer for frontend call "), "b.api_path", F.lit(" from "), "b.consumer").alias("reason")))


def api_pairs(rows: DataFrame, c: Context) -> DataFrame:
    """Files of the same API family as an endpoint that matches the task."""
    w = c.weights
    own = rows.where(F.size("route") > 0).join(c.tasks.select("g", F.filter("keywords", lambda k: ~k.isin(NOISE)).alias("k")), "g", "left").withColumn("family", F.get("route", F.lit(0))).withColumn("asked", F.coalesce(F.arrays_overlap("route", "k"), F.lit(False)))
    owner = _any("reasons", ["API route owner match:"])
    seeds = own.where(~F.col("skipped") & (owner | ((F.col("score") >= w.pair_score) & F.col("asked")))).groupBy("g", "family").agg(F.min_by(F.struct("path", "route"), F.struct((-F.col("score")).alias("less"), "path")).alias("seed"))
    several = own.where("not skipped").groupBy("g").agg(F.count("*").alias("n")).where("n > 1").select("g")
    met = own.where(~_any("reasons", ["API endpoint pair"])).join(seeds.join(several, "g"), ["g", "family"]).where("seed.path <> path")
    amount = F.lit(min(w.pair_most, w.cross_layer_related + w.pair_more)) + F.when(F.col("asked"), w.pair_keyword).otherwise(0.0)
    return _apply(rows, met.select("g", "path", amount.alias("amount"), F.concat(F.lit("API endpoint pair with /api/"), F.array_join("seed.route", "/")).alias("reason")))


def layers(rows: DataFrame, c: Context) -> DataFrame:
    """Implementation files that share a domain with the task or with one of the best entry points."""
    w = c.weights
    ranked = rows.where("score > 0 and not skipped").select("g", "score").withColumn("n", F.row_number().over(Window.partitionBy("g").orderBy(F.desc("score")))).where(F.col("n") <= w.entry_points)
    least = ranked.groupBy("g").agg(F.min("score").alias("least"))
    seeds = rows.where("entry").select("g", "score", "domain").join(least, "g").where("score >= least").select("g", F.explode("domain").alias("term"))
    asked = c.tasks.join(least, "g").select("g", F.explode(F.filter("keywords", lambda k: ~k.isin(NOISE))).alias("term"))
    own = rows.where(~F.col("skipped") & F.col("implementation") & ~F.array_contains("reasons", "cross-layer related implementation"))
    hits = own.select("g", "path", F.explode("domain").alias("term")).join(seeds.unionByName(asked).distinct(), ["g", "term"], "left_semi").select("g", "path").distinct()
    return _apply(rows, hits.select("g", "path", F.lit(w.cross_layer_related).alias("amount"), F.lit("cross-layer related implementation").alias("reason")))


def upper_median(rows: DataFrame) -> DataFrame:
    """(g, middle): of the scores of rows(g, score) the one at place n div 2, counted from 0: a running count over distinct scores."""
    per = rows.groupBy("g", "score").agg(F.count("*").alias("n"))
    run = per.withColumn("upto", F.sum("n").over(Window.partitionBy("g").orderBy("score"))).join(rows.groupBy("g").agg(F.count("*").alias("total")), "g")
    return run.where("upto > total div 2").groupBy("g").agg(F.min("score").alias("middle"))


def tests(rows: DataFrame, c: Context) -> DataFrame:
    """Tests whose name holds the stem of a source that scores at least the median of the sources."""
    middle = upper_median(rows.where("not skipped and not test and score > 0").select("g", "score"))
    sources = rows.where("not test and not config").join(middle, "g").where("score >= middle").groupBy("g", "stem").agg(F.min("path").alias("source"))
    own = rows.where(F.col("test") & ~F.exists("reasons", lambda r: F.contains(r, F.lit("test for")))).select("g", "path", F.explode(substrings(F.col("stem"))).alias("stem"))
    first = own.join(sources, ["g", "stem"]).groupBy("g", "path").agg(F.min("source").alias("source"))
    return _apply(rows, first.select("g", "path", F.lit(c.weights.related_test).alias("amount"), F.concat(F.lit("test for high-scoring "), "source").alias("reason")))


def history(rows: DataFrame, c: Context) -> DataFrame:
    """Files that earlier selections proved noisy lose points, or all of them where nothing strong speaks for them."""
    w = c.weights
    own = rows.where("not changed").select("g", "path", _any("reasons", STRONG_REASONS).alias("strong"), _any("reasons", WEAK_REASONS).alias("weak"))
    met = own.join(c.noise.where("n > 0"), ["g", "path"]).join(c.tasks.select("g", "generic_ratio"), "g", "left")
    broad = (F.coalesce("generic_ratio", F.lit(0.0)) >= 0.35) & (F.col("n") >= 4) & ~F.col("strong")
    only = (F.col("n") >= 6) & F.col("weak") & ~F.col("strong")
    penalty = F.least(F.lit(w.noise_most), F.col("n") * w.noise_each + F.greatest(F.lit(0), F.col("n") - 2) * w.noise_more)
    said = F.when(broad, "repeat noise path suppressed").when(only, "repeat weak-noise path suppressed").otherwise(F.concat(F.lit("history noise penalty -"), penalty.cast("bigint").cast("string")))
    return _apply(rows, met.select("g", "path", F.when(~broad & ~only, -penalty).alias("amount"), said.alias("reason")), zero=True)


def feedback(rows: DataFrame, c: Context) -> DataFrame:
    """What was missed before gains what was learned from it."""
    met = rows.where("not changed").select("g", "path").join(c.feedback.where("amount > 0").groupBy("g", "path").agg(F.max("amount").cast("double").alias("amount")), ["g", "path"])
    return _apply(rows, met.select("g", "path", "amount", F.concat(F.lit("learning feedback miss boost +"), F.round("amount").cast("bigint").cast("string")).alias("reason")))


Pass = Callable[[DataFrame, Context], DataFrame]
#: The order is part of the meaning: seeds, thresholds and strong reasons come from the passes before.
CHAIN: tuple[Pass, ...] = (graph, workspace, recall, second_pass, api_consumers, api_pairs, layers, tests, history, feedback)


def chain(rows: DataFrame, context: Context, passes: Sequence[Pass] = CHAIN) -> DataFrame:
    """candidates() after all passes, in order; each pass is written once, as it is read several times.

    The table is dealt by (g, path) once; what a pass finds is joined to it by these
    keys. Seeds are a few of each group, the terms and stems of a pass meet by
    equi-joins, hubs are joined without a hot key.
    """
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = cut(rows.repartition(partitions, "g", "path"))
    for one in passes:
        rows = cut(one(rows, context))
    return rows
