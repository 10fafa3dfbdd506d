"""Retention by reachability under a size budget, and the registry of blocks that can be asked for again."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WORKTREE = "WORKTREE"
#: Blocks of a registry, and refs that a budget never touches.
MOST_BLOCKS, LEAST_REFS = 200, 2
#: Caches whose single rows are sent to every task; beyond it they are joined by shuffle.
BROADCAST_CACHES = 200_000


def block_registry(selected: DataFrame, symbols: DataFrame, omitted: DataFrame, most: int = MOST_BLOCKS) -> DataFrame:
    """(pack, position, kind, path, name, tokens): what can be retrieved of each pack, the first `most` blocks.

    selected(pack, place, path, tokens) come in their places, each followed by its
    symbols(pack, path, line, name, tokens) in the order of lines, then
    omitted(pack, place, path, tokens). Paths and names break ties.
    """
    own = selected.select("pack", F.lit(0).alias("part"), "place", F.lit(-1).cast("bigint").alias("line"), F.lit("file").alias("kind"), "path", F.lit("").alias("name"), "tokens")
    of = symbols.join(selected.select("pack", "path", "place"), ["pack", "path"]).select("pack", F.lit(0).alias("part"), "place", F.col("line").cast("bigint").alias("line"), F.lit("symbol").alias("kind"), "path", "name", "tokens")
    rest = omitted.select("pack", F.lit(1).alias("part"), "place", F.lit(-1).cast("bigint").alias("line"), F.lit("omitted").alias("kind"), "path", F.lit("").alias("name"), "tokens")
    order = Window.partitionBy("pack").orderBy("part", "place", "path", "line", "name")
    ranked = own.unionByName(of).unionByName(rest).withColumn("position", F.row_number().over(order)).where(F.col("position") <= most)
    return ranked.select("pack", "position", "kind", "path", "name", "tokens")


def retention_plan(states: DataFrame, uses: DataFrame, records: DataFrame, keep_refs: int, max_bytes: int = 0) -> DataFrame:
    """(g, kind, key, bytes, action, reason): what a sweep of each cache g keeps and drops.

    states(g, state, ref, changed, bytes, current): current is false for a state of
    another schema or profile, which goes, and null for one that cannot be read; then
    only states that are not current go and all records stay. The newest worktree
    state and the newest keep_refs others stay. uses(g, state, record) tells what a
    state needs; records(g, record, bytes) that no state kept needs go.

    Beyond max_bytes (0: no limit) the oldest refs go, down to two. A record belongs
    to the newest state that needs it, so what a cut of refs frees is a running sum
    over at most keep_refs + 1 ranks; no state is looked at twice. Up to BROADCAST_CACHES
    caches, nothing is shuffled by cache alone, as a few may hold all rows.
    """
    each = F.broadcast if states.select("g").distinct().count() <= BROADCAST_CACHES else (lambda df: df)
    live = states.where("current")
    turn = Window.partitionBy("g", "tree").orderBy(F.desc("changed"), F.desc("state"))
    ranked = live.withColumn("tree", F.col("ref") == WORKTREE).withColumn("n", F.row_number().over(turn)).where(F.col("n") <= max(1, keep_refs))  # limited before the shuffle
    kept = ranked.where(F.when(F.col("tree"), F.col("n") == 1).otherwise(F.col("n") <= keep_refs)).select("g", "state", F.when(F.col("tree"), 0).otherwise(F.col("n")).alias("rank"), "bytes")
    owner = uses.select("g", "state", "record").distinct().join(kept.select("g", "state", "rank"), ["g", "state"]).groupBy("g", "record").agg(F.min("rank").alias("rank"))
    held = records.join(owner, ["g", "record"], "left")
    sizes = kept.select("g", "rank", "bytes").unionByName(held.where("rank is not null").select("g", "rank", "bytes")).groupBy("g", "rank").agg(F.sum("bytes").alias("bytes"))
    upto = sizes.withColumn("upto", F.sum("bytes").over(Window.partitionBy("g").orderBy("rank")))
    fits = F.max(F.when((F.col("upto") <= max_bytes) | (F.col("rank") <= LEAST_REFS), F.col("rank"))) if max_bytes else F.max("rank")
    cut_at = upto.groupBy("g").agg(fits.alias("last"))
    blind = states.where("current is null").select("g").distinct().withColumn("blind", F.lit(True))
    places = kept.select("g", "state", "rank")
    of_states = states.join(places, ["g", "state"], "left").join(each(cut_at), "g", "left").join(each(blind), "g", "left")
    said = (
        F.when(F.col("current").isNull(), "unreadable").when(~F.col("current"), "stale").when(F.col("blind"), "unreadable neighbours").when(F.col("rank").isNull(), "old").when(F.col("rank") > F.col("last"), "budget").otherwise("retained")
    )
    a = of_states.select("g", F.lit("state").alias("kind"), F.col("state").cast("string").alias("key"), "bytes", said.alias("reason"))
    of_records = held.join(each(cut_at), "g", "left").join(each(blind), "g", "left")
    why = F.when(F.col("blind"), "unreadable neighbours").when(F.col("rank").isNull(), "unreachable").when(F.col("rank") > F.col("last"), "budget").otherwise("reachable")
    b = of_records.select("g", F.lit("record").alias("kind"), F.col("record").cast("string").alias("key"), "bytes", why.alias("reason"))
    action = F.when(F.col("reason").isin("stale", "old", "unreachable", "budget"), "drop").otherwise("keep")
    return a.unionByName(b).select("g", "kind", "key", "bytes", action.alias("action"), "reason")


def report(plan: DataFrame) -> DataFrame:
    """(g, kept, dropped, kept_bytes, dropped_bytes) of a plan: the dry run."""
    out = F.col("action") == "drop"
    return plan.groupBy("g").agg(F.count_if(~out).alias("kept"), F.count_if(out).alias("dropped"), F.sum(F.when(~out, F.col("bytes")).otherwise(0)).alias("kept_bytes"), F.sum(F.when(out, F.col("bytes")).otherwise(0)).alias("dropped_bytes"))


def sweep(items: DataFrame, plan: DataFrame, kind: str, key: str) -> DataFrame:
    """The items(g, key, ...) of a kind that a plan does not drop."""
    gone = plan.where((F.col("kind") == kind) & (F.col("action") == "drop")).select("g", F.col("key").alias("_key"))
    return items.join(gone, (items["g"] == gone["g"]) & (items[key].cast("string") == gone["_key"]), "left_anti")
