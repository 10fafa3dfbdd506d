"""Picks out of ranked candidates: role coverage, lanes, priors, lessons, gaps, reason buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Buckets of omission reasons by their lower-case beginnings, in order of precedence.
REASON_BUCKETS = [
    ("related_test", ["related test", "test for"]),
    ("caller_or_reverse_dependency", ["caller of selected symbol", "reverse dependency"]),
    ("direct_evidence", ["direct dependency", "direct content evidence"]),
    ("literal_or_phrase_match", ["keyword phrase match:", "literal definition match:", "quoted literal match:"]),
    ("symbol_or_entrypoint_match", ["matched call:", "matched define:", "matched entrypoint:"]),
    ("side_effect_or_external_match", ["matched env read:", "matched external system:", "matched side effect:"]),
    ("multi_term_path_match", ["multi-term path match"]),
    ("api_route_owner_match", ["api route owner match"]),
    ("api_endpoint_pair", ["api endpoint pair with"]),
    ("api_producer_for_frontend_call", ["api producer for frontend call"]),
    ("generic_public_api_penalty", ["generic public api penalty"]),
    ("weak_filename_only_match", ["weak filename-only match"]),
    ("broad_keyword_match", ["matched domain:", "matched naming keyword:", "matched ranking keyword:", "matched role keyword:"]),
    ("repo_metadata_match", ["workspace match", "release/version metadata", "build/dependency metadata"]),
    ("budget", ["budget"]),
]
#: Fixed value: the lanes of a recommendation, in the order in which they pick.
LANES = ["now", "weak_spot", "breadth"]
#: Paths that never become a prior, by beginning and end, and the events that are looked at. Folders of tools are added by the caller.
NOISY_PREFIXES = [".agent/", ".git/", ".mypy_cache/", "__pycache__/"]
NOISY_SUFFIXES = [".pyc", ".log"]
LAST_EVENTS = 500


def any_prefix(value: Column, prefixes: list[str]) -> Column:
    found = F.lit(False)
    for p in prefixes:
        found = found | value.startswith(p)
    return found


def reason_bucket(reason: Column) -> Column:
    """The bucket of a reason, by the first rule that holds; a reason that no rule knows is its own bucket."""
    low = F.lower(reason)
    out = reason
    for name, prefixes in reversed(REASON_BUCKETS):
        hit = any_prefix(low, prefixes)
        if name == "related_test":
            hit = hit | low.contains("has related tests")
        out = F.when(hit, F.lit(name)).otherwise(out)
    return out


def role_seeds(df: DataFrame, group: str, item: str, order: list[Column], roles: tuple[Column, Column], scope: Column, window: int, look: int = 30) -> DataFrame:
    """(group, item, seed): the items that move before a group's ranked list so that its first `window` hold both roles.

    Nothing moves where the window holds both, where one role is not among the first
    `look`, where the two firsts have different scopes (an empty one agrees with any),
    or with fewer than three items or a window of one. Only the first `look` rows of a
    group are ranked, so a group of any size costs no more than its limit.
    """
    a, b = roles
    place = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    top = df.select(F.col(group), F.col(item), a.alias("_a"), b.alias("_b"), scope.alias("_scope"), place.alias("_place")).where(F.col("_place") <= max(look, window))
    first = lambda role: F.min(F.when(F.col(role) & (F.col("_place") <= look), F.struct("_place", item, "_scope")))
    has = lambda role: F.max(F.coalesce(F.col(role), F.lit(False)) & (F.col("_place") <= window))
    per = top.groupBy(group).agg(F.count("*").alias("n"), has("_a").alias("has_a"), has("_b").alias("has_b"), first("_a").alias("a"), first("_b").alias("b"))
    agree = (F.col("a._scope") == "") | (F.col("b._scope") == "") | (F.col("a._scope") == F.col("b._scope"))
    live = per.where(F.lit(window >= 2) & (F.col("n") >= 3) & F.col("a").isNotNull() & F.col("b").isNotNull() & agree & ~(F.col("has_a") & F.col("has_b")))
    moved = F.array_sort(F.array_distinct(F.array_compact(F.array(F.when(~F.col("has_a"), F.col("a")), F.when(~F.col("has_b"), F.col("b"))))))
    return live.select(group, F.posexplode(moved).alias("seed", "at")).select(group, F.col(f"at.{item}").alias(item), (F.col("seed") + 1).alias("seed"))


def score_gaps(df: DataFrame, group: str, score: str, place: str) -> DataFrame:
    """df with gap: its score less that of the group's last selected row, rounded to tenths.

    place is the position in selection order, null for a row that was not selected; a
    group without a selection has null gaps. One row a group is joined back.
    """
    last = df.where(F.col(place).isNotNull()).groupBy(group).agg(F.max_by(score, place).alias("_last"))
    return df.join(last, group, "left").withColumn("gap", F.bround(F.col(score).cast("double") - F.col("_last"), 1)).drop("_last")


def lane_topics(df: DataFrame, group: str, topic: str, project: str, lanes: str, mastered: str, order: list[Column], limit: int = 3, spread_projects: bool = True) -> DataFrame:
    """(group, lane, topic, project): one topic a lane, in the lanes' order, no topic twice.

    Topics that are not mastered come first, then projects without a pick so far (if
    spread_projects), then `order`. Earlier picks rule out at most len(LANES) - 1 topics,
    so only that many more rows of each (lane, mastered, project) can win; the rest
    is cut before anything is joined, whatever the size of a group.
    """
    rows = df.withColumn("_lane", F.explode(F.array_distinct(lanes))).where(F.col("_lane").isin(LANES))
    w = Window.partitionBy(group, "_lane", mastered, project).orderBy(*order)
    rows = rows.withColumn("_i", F.row_number().over(w)).where(F.col("_i") <= len(LANES))
    rows = rows.withColumn("_o", F.row_number().over(Window.partitionBy(group, "_lane").orderBy(*order)))
    rows = rows.select(F.col(group).alias("g"), F.col(topic).alias("t"), F.col(project).alias("p"), F.col(mastered).alias("m"), F.col("_lane").alias("lane"), F.col("_o").alias("o"))
    picks = rows.select("g").distinct().withColumn("picks", F.array().cast("array<struct<lane:string,t:string,p:string>>"))
    for lane in LANES:
        left = rows.where(F.col("lane") == lane).join(picks, "g").where(~F.exists("picks", lambda x: x["t"] == F.col("t").cast("string")))
        used = F.exists("picks", lambda x: x["p"] == F.col("p").cast("string")) if spread_projects else F.lit(False)
        best = left.groupBy("g").agg(F.min_by(F.struct(F.lit(lane).alias("lane"), F.col("t").cast("string").alias("t"), F.col("p").cast("string").alias("p")), F.struct("m", used.alias("used"), "o")).alias("best"))
        grown = F.when(F.col("best").isNotNull() & (F.size("picks") < limit), F.concat("picks", F.array("best"))).otherwise(F.col("picks"))
        picks = picks.join(best, "g", "left").select("g", grown.alias("picks"))
    out = picks.select("g", F.explode("picks").alias("x"))
    kinds = {f.name: f.dataType for f in df.schema.fields}
    return out.select(F.col("g").alias(group), F.col("x.lane").alias("lane"), F.col("x.t").cast(kinds[topic]).alias(topic), F.col("x.p").cast(kinds[project]).alias(project))


def task_terms(task: Column) -> Column:
    """Lower-case runs of letters and digits of three or more characters, each once."""
    words = F.split(F.regexp_replace(F.lower(task), r"[^\p{L}\p{N}]+", " "), " ")
    return F.array_distinct(F.filter(words, lambda w: F.length(w) >= 3))


def route_priors(df: DataFrame, task: str, path: str, place: str, wanted: str, limit: int = 5, last: int | None = LAST_EVENTS, noisy_folders: tuple[str, ...] = ()) -> DataFrame:
    """(path, score, events, confidence, evidence, last): paths of earlier work on tasks that share terms with `wanted`, out of the last events by place, or of all (last None).

    An event adds the number of shared terms and up to three for terms in the path.
    Evidence is the first three tasks of a path, last its latest; both are looked up
    for the chosen paths alone.
    """
    terms = F.array_distinct(F.filter(F.split(F.regexp_replace(F.lower(F.lit(wanted)), r"[^\p{L}\p{N}]+", " "), " "), lambda w: F.length(w) >= 3))
    noisy = any_prefix(F.col(path), [*NOISY_PREFIXES, *noisy_folders])
    for s in NOISY_SUFFIXES:
        noisy = noisy | F.col(path).endswith(s)
    parts = F.split(F.translate(F.lower(path), "/_-.", "    "), " ")
    bonus = F.least(F.lit(3), F.size(F.array_intersect(F.array_distinct(parts), terms)))
    rows = (df if last is None else df.orderBy(F.desc(place)).limit(last)).select(F.col(path).alias("path"), F.col(task).alias("task"), F.col(place).alias("place"), F.size(F.array_intersect(task_terms(F.col(task)), terms)).alias("shared"), bonus.alias("bonus"))
    rows = rows.where((F.col("shared") > 0) & ~noisy)
    best = rows.groupBy("path").agg(F.sum(F.col("shared") + F.col("bonus")).alias("score"), F.count("*").alias("events"), F.max_by("task", "place").alias("last")).orderBy(F.desc("score"), "path").limit(limit)
    early = rows.join(F.broadcast(best.select("path")), "path").withColumn("i", F.row_number().over(Window.partitionBy("path").orderBy("place"))).where("i <= 3")
    evidence = early.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("i", "task"))).alias("e")).select("path", F.col("e.task").alias("evidence"))
    confidence = F.least(F.lit(0.85), 0.35 + F.col("score") * 0.08 + F.least("events", F.lit(3)) * 0.08)
    return best.join(evidence, "path").select("path", "score", "events", F.bround(confidence, 2).alias("confidence"), "evidence", "last")


def rank_lessons(df: DataFrame, rule: str, confidence: str, accepted: Column, grounded: Column, place: str, concepts: list[str], helpful: list[str], suppressed: list[str], limit: int) -> DataFrame:
    """df's best lessons with score: 30 for accepted, 15 with evidence, 10 a concept and 20 a helpful one in the rule; a suppressed term drops it."""
    low = F.lower(rule)
    score = F.col(confidence) + F.when(accepted, 30).otherwise(0) + F.when(grounded, 15).otherwise(0)
    for points, terms in ((10, concepts), (20, helpful)):
        for t in terms:
            score = score + F.when(low.contains(t.lower()), points).otherwise(0)
    off = F.lit(False)
    for t in suppressed:
        off = off | low.contains(t.lower())
    return df.where(~off).withColumn("score", score.cast("bigint")).orderBy(F.desc("score"), place).limit(limit)
