"""Joins, diffs, folds and statistics that plans compose."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuscle.shared import cut


def keyed_diff(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """(key, status): added, deleted, modified or unchanged by a full outer equi-join on the key."""
    a, b = old.select(key, F.col(value).alias("_old")), new.select(key, F.col(value).alias("_new"))
    status = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "deleted").when(F.col("_old") != F.col("_new"), "modified").otherwise("unchanged")
    return a.join(b, key, "full_outer").select(key, status.alias("status"))


def latest(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key: an aggregate that combines before the shuffle, no window over hot keys."""
    rest = [c for c in df.columns if c not in key]
    newest = df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return newest.select(*key, "_row.*")


def top_per_group(df: DataFrame, key: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each key with their rank; Spark limits groups before it shuffles."""
    ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order)))
    return ranked.where(F.col("rank") <= k)


def document_frequency(docs: DataFrame, tokens: Column, *keys: str) -> DataFrame:
    """(keys, term, df): documents that contain a term."""
    return docs.select(*keys, F.explode(F.array_distinct(tokens)).alias("term")).groupBy(*keys, "term").agg(F.count("*").alias("df"))


def rarity(total: Column, df: Column) -> Column:
    """Normalised inverse document frequency in 0..1; 1 for corpora of a single document."""
    share = F.log((total + 1) / (df + 1)) / F.log(total + F.lit(1.0))
    return F.when(total <= 1, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)))


def bm25(tf: Column, df: Column, total: Column) -> Column:
    """BM25 with k1 = 1.2 and no length normalisation."""
    return F.log(1 + (total - df + 0.5) / (df + 0.5)) * (tf * 2.2) / (tf + 1.2)


def co_changed(changes: DataFrame, seeds: DataFrame, commit: str, path: str) -> DataFrame:
    """(path, n): how often other paths change in commits that touch a seed. Spark picks the joins: seeds may be many."""
    own = seeds.select(path).distinct()
    touching = changes.join(own, path, "left_semi").select(commit).distinct()
    return changes.join(touching, commit, "left_semi").join(own, path, "left_anti").groupBy(path).agg(F.countDistinct(commit).alias("n"))


def longest_prefix(rows: DataFrame, path: str, prefixes: DataFrame, prefix: str) -> DataFrame:
    """rows with the longest prefix of their path, null if none: an equi-join on every leading part, not a range join."""
    parts = F.split(F.col(path), "/")
    leads = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    hits = rows.select(path).distinct().select(path, F.explode(leads).alias(prefix)).join(prefixes.select(prefix).distinct(), prefix)
    best = hits.groupBy(path).agg(F.max_by(prefix, F.length(prefix)).alias(prefix))
    return rows.join(best, path, "left")


def unique_matches(removed: DataFrame, added: DataFrame, identity: list[str], key: str) -> DataFrame:
    """(before, after): entities whose identity is unique on both sides."""
    one = lambda df, name: df.groupBy(*identity).agg(F.count("*").alias("_n"), F.min(key).alias(name)).where("_n = 1").drop("_n")
    return one(removed, "before").join(one(added, "after"), identity).where("before <> after")


def ambiguous_matches(removed: DataFrame, added: DataFrame, identity: list[str], key: str, most: int = 10) -> DataFrame:
    """(before, after) of identities that are not unique, at most the first `most` of each side."""
    def side(df: DataFrame, name: str) -> DataFrame:
        w = Window.partitionBy(*identity).orderBy(key)
        ranked = df.select(*identity, F.col(key).alias(name), F.row_number().over(w).alias("_r")).where(F.col("_r") <= most)
        return ranked.join(df.groupBy(*identity).agg(F.count("*").alias(f"_n_{name}")), identity).drop("_r")

    return side(removed, "before").join(side(added, "after"), identity).where("not (_n_before = 1 and _n_after = 1)").drop("_n_before", "_n_after")


def merge_intervals(df: DataFrame, key: list[str], start: str, end: str, gap: int = 2) -> DataFrame:
    """Line ranges of each key, merged where they overlap or lie at most gap apart."""
    w = Window.partitionBy(*key).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    flagged = df.withColumn("_new", F.when(F.col(start) <= reach + gap, 0).otherwise(1))
    return flagged.withColumn("_island", F.sum("_new").over(w)).groupBy(*key, "_island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island")


def sessions(df: DataFrame, key: list[str], ts: str, gap_seconds: int) -> DataFrame:
    """(key, session_start, session_end, n): events that follow within less than the gap belong together."""
    return df.groupBy(*key, F.session_window(ts, f"{gap_seconds} seconds").alias("_w")).agg(F.min(ts).alias("session_start"), F.max(ts).alias("session_end"), F.count("*").alias("n")).drop("_w")


def running(df: DataFrame, keys: list[str], order: list[Column], value: str) -> DataFrame:
    """df with rank and spent, the running count and sum of value within each key: a window over parts of a key, never over a key as a whole.

    Rows are dealt in ranges of (keys, order), so that a key's rows lie in consecutive
    parts; what comes before a part is a sum over the parts of its key, of which there
    are no more than keys and partitions together. Rows that are equal in keys and
    order share a part.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(df.repartitionByRange(parts, *keys, *order).withColumn("_part", F.spark_partition_id()))
    per = dealt.groupBy(*keys, "_part").agg(F.count("*").alias("_n"), F.sum(value).alias("_s"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = per.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("_part").alias("_of"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"), F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_s0"))
    same = F.col("_part") == F.col("_of")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    own = Window.partitionBy(*keys, "_part").orderBy(*order)
    met = dealt.join(base, same)
    ranked = met.withColumn("rank", F.row_number().over(own) + F.col("_n0")).withColumn("spent", F.sum(value).over(own.rowsBetween(Window.unboundedPreceding, 0)) + F.col("_s0"))
    return ranked.select(*df.columns, "rank", "spent")


def budget_prefix(df: DataFrame, key: list[str], order: list[Column], tokens: str, budget: int) -> DataFrame:
    """Rows of each key up to the first one that would exceed the budget."""
    return running(df, key, order, tokens).drop("rank").where(F.col("spent") <= budget)
