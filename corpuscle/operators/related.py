"""Boosts along related paths and calls, selectors, and the upsert of a skill map."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuscle.functions import text

# Path tokens that name a role, and tokens that say nothing about a domain.
IMPLEMENTATION_ROLES = [
    "api", "apis", "route", "routes", "router", "endpoint", "endpoints", "controller", "controllers", "service", "services", "handler", "handlers", "resolver", "resolvers",
    "schema", "schemas", "model", "models", "repository", "repositories", "repo", "repos", "client", "clients", "adapter", "adapters", "provider", "providers",
    "serializer", "serializers", "validator", "validators", "worker", "workers", "job", "jobs", "mailer", "mailers", "migration", "migrations", "paginator", "pagination",
]
ENTRYPOINT_ROLES = [
    "page", "pages", "screen", "screens", "view", "views", "component", "components", "api", "route", "routes", "router",
    "controller", "controllers", "endpoint", "endpoints", "handler", "handlers", "webhook", "webhooks",
]
PLACES = ["src", "app", "apps", "lib", "libs", "pkg", "packages", "backend", "frontend", "server", "client", "web", "mobile", "index", "main", "test", "tests", "spec", "specs"]
NOISE = sorted({*PLACES, *IMPLEMENTATION_ROLES, *ENTRYPOINT_ROLES})

#: Evidence after the first that counts: 32 rounds of reinforcement lift any confidence to 100.
ROUNDS = 32


def _list(values: list[str]) -> Column:
    return F.array(*(F.lit(v) for v in values)).cast("array<string>")


def cross_layer(scored: DataFrame, item: str, keywords: list[str], amount: float = 30.0) -> DataFrame:
    """scored(item, path, score, skipped) with related: implementation files that share a domain token with a task or an entry point.

    Entry points are files with an entry role that score at least the fifth best
    positive score. Domain tokens meet by equi-join; no pair of files is formed.
    """
    rows = scored.withColumn("tokens", text.path_tokens(F.col("path")))
    domain = F.filter("tokens", lambda t: (F.length(t) >= 3) & ~t.isin(NOISE))
    least = rows.where("score > 0 and not skipped").select("score").orderBy(F.desc("score")).limit(5).agg(F.min("score").alias("least")).where("least is not null")  # one row
    seeds = rows.join(F.broadcast(least), F.col("score") >= F.col("least")).where(F.arrays_overlap("tokens", _list(ENTRYPOINT_ROLES))).select(F.explode(domain).alias("term"))
    asked = least.select(F.explode(_list([k for k in keywords if k not in NOISE])).alias("term"))
    terms = seeds.unionByName(asked).distinct()
    open_rows = rows.where(~F.col("skipped") & F.arrays_overlap("tokens", _list(IMPLEMENTATION_ROLES)))
    hits = open_rows.select(item, F.explode(domain).alias("term")).join(terms, "term", "left_semi").select(item).distinct().withColumn("related", F.lit(True))
    found = scored.join(hits, item, "left").withColumn("related", F.coalesce("related", F.lit(False)))
    return found.withColumn("score", F.col("score") + F.when(F.col("related"), F.lit(amount)).otherwise(0.0))


def producer_boosts(endpoints: DataFrame, calls: DataFrame, keywords: list[str], weight: float = 30.0) -> DataFrame:
    """(item, amount, api_path, consumer): what an endpoint gains from the client files that call it, the best call only.

    endpoints(item, api_path, place): the last one of a path answers for it.
    calls(consumer, api_path, place, slot) are those of client files with a positive
    score. Calls are reduced to the first two callers of a path before they meet an
    endpoint, so a path that everybody calls is no hot key.
    """
    last = endpoints.groupBy("api_path").agg(F.max_by("item", "place").alias("item"))
    once = calls.groupBy("api_path", "consumer").agg(F.min(F.struct("place", "slot")).alias("at"))
    first = once.withColumn("rank", F.row_number().over(Window.partitionBy("api_path").orderBy("at", "consumer"))).where("rank <= 2")
    wanted = F.arrays_overlap(F.split(F.lower("api_path"), "[^a-z0-9]+"), _list(keywords))
    amount = F.lit(min(150.0, 90.0 + weight * 0.6)) + F.when(wanted, 45.0).otherwise(0.0)
    met = first.join(last, "api_path").where("item <> consumer").withColumn("amount", amount)
    best = F.min_by(F.struct("amount", "api_path", "consumer"), F.struct(-F.col("amount"), "at", "api_path"))
    return met.groupBy("item").agg(best.alias("b")).select("item", "b.amount", "b.api_path", "b.consumer")


def selected(kind: Column, path: Column, name: Column, kinds: list[str] = (), globs: list[str] = (), names: list[str] = (), contains: list[str] = ()) -> Column:
    """A selector: every list that is not empty must hold; in globs * spans slashes and case counts."""
    out = F.lit(True)
    if kinds:
        out = out & kind.isin(list(kinds))
    if globs:
        forms = ("^" + "".join({"*": ".*", "?": "."}.get(c) or re.escape(c) for c in g) + "$" for g in globs)
        out = out & path.rlike("|".join(forms))
    if names:
        out = out & name.isin(list(names))
    if contains:
        hits = [F.contains(name, F.lit(c)) for c in contains]
        out = out & F.greatest(*hits, F.lit(False))
    return out


def upsert_skills(known: DataFrame, evidence: DataFrame, keep: int = 10) -> DataFrame:
    """(skill, task_count, confidence, last_task, recent): a skill map after new evidence; suppressed skills stay as they are.

    known(skill, task_count, confidence, last_task, suppressed) has one row a skill,
    evidence(skill, at, task, confidence) any number. The confidence of a skill is a
    fold in the order of time, but it is settled after ROUNDS reinforcements, so only
    so many rows of a skill are gathered, from the first that is not zero on.
    """
    base = known.select("skill", F.col("task_count").alias("before"), F.col("confidence").alias("was"), F.col("last_task").alias("old"), "suppressed")
    rows = evidence.join(base.where("suppressed").select("skill"), "skill", "left_anti")
    facts = rows.groupBy("skill").agg(F.count("*").alias("new"), F.max_by("task", "at").alias("task"), F.min(F.when(F.col("confidence") > 0, F.col("at"))).alias("begin"), F.min("at").alias("first"))
    facts = facts.join(base.select("skill", "before", "was"), "skill", "left").fillna(0, ["before", "was"])
    begin = facts.select("skill", "before", "was", F.when(F.col("was") > 0, F.col("first")).otherwise(F.col("begin")).alias("begin"))
    told = rows.join(begin, "skill")
    earlier = told.where("at < begin").groupBy("skill").agg(F.count("*").alias("earlier"))
    by_time = Window.partitionBy("skill").orderBy("at")
    run = told.where("at >= begin").withColumn("n", F.row_number().over(by_time)).where(F.col("n") <= ROUNDS + 1)
    run = run.groupBy("skill", "before", "was").agg(F.array_sort(F.collect_list(F.struct("n", F.col("confidence").alias("c")))).alias("run")).join(earlier, "skill", "left").fillna(0, ["earlier"])
    step = lambda acc, x: F.when(acc == 0, F.least(F.lit(100), x["c"])).otherwise(F.least(F.lit(100), F.greatest(acc, x["c"]) + F.least(F.lit(10), F.col("before") + F.col("earlier") + x["n"])))
    confidence = run.select("skill", F.aggregate("run", F.col("was").cast("bigint"), lambda acc, x: step(acc, x).cast("bigint")).alias("confidence"))
    newest = rows.withColumn("n", F.row_number().over(Window.partitionBy("skill").orderBy(F.desc("at")))).where(F.col("n") <= keep)
    newest = newest.groupBy("skill").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "task"))), lambda x: x["task"]).alias("recent"))
    grown = facts.join(confidence, "skill", "left").join(newest, "skill")
    out = base.select("skill", "before", "was", "old").join(grown.drop("before", "was"), "skill", "full_outer").fillna(0, ["before", "was", "new"])
    return out.select("skill", (F.col("before") + F.col("new")).cast("bigint").alias("task_count"), F.coalesce("confidence", "was").cast("bigint").alias("confidence"), F.coalesce("task", "old").alias("last_task"), F.coalesce("recent", F.array().cast("array<bigint>")).alias("recent"))


def iso_time(value: Column) -> Column:
    """The instant of an ISO 8601 text, in UTC where it names no zone; null for anything else."""
    form = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:\d{2})?)?$"
    zoned = F.when(value.rlike(r"(Z|[+-]\d{2}:\d{2})$") & value.rlike("[T ]"), value).when(value.rlike("[T ]"), F.concat(value, F.lit("Z"))).otherwise(F.concat(value, F.lit("T00:00:00Z")))
    return F.when(value.rlike(form), zoned.try_cast("timestamp"))


def memory_weight(at: Column, now: Column, most_days: int = 180) -> Column:
    """Half weight for records of more than most_days whole days; a record without a time keeps its whole weight."""
    days = F.floor((F.unix_micros(now) - F.unix_micros(at)) / F.lit(86_400_000_000))
    return F.when(days > most_days, 0.5).otherwise(1.0)
