"""Ordered, stateful selection under a token budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuscle.shared import cut


def greedy_budget(df: DataFrame, group: str, item: str, score: str, tokens: str, budget: int, max_files: int = 40, chunk: int = 1000) -> DataFrame:
    """(group, item, action, spent): items by falling score; one that does not fit is skipped and later ones still may.

    A round takes the first `chunk` rows of each group that lie behind its last one
    looked at and would still fit, and folds them. At most max_files rows of a group
    are ever picked, and every receipt follows from the picks before a row, so no group
    passes through one task: a round ranks only what its limit lets through. Scores
    that are null or no number come last; tokens that are null count as none.
    """
    last = F.col("s").isNull() | F.isnan(F.col("s").cast("double"))
    rows = cut(df.select(F.col(group).alias("g"), F.col(item).alias("i"), F.col(score).alias("s"), F.coalesce(F.col(tokens).cast("bigint"), F.lit(0)).alias("t"), F.monotonically_increasing_id().alias("id")))
    rows = rows.select("g", "i", "t", F.struct(last.alias("last"), F.when(~last, -F.col("s")).alias("s"), "i", "id").alias("k"))
    key = rows.schema["k"].dataType.simpleString()

    def pick(acc: Column, x: Column) -> Column:
        spent, taken = acc["spent"] + x["t"], acc["taken"] + 1
        grown = F.concat(acc["picks"], F.array(F.struct(x["k"].alias("k"), spent.alias("spent"), taken.alias("taken"))))
        fits = (acc["taken"] < max_files) & (spent <= budget)
        return F.struct(F.when(fits, spent).otherwise(acc["spent"]).alias("spent"), F.when(fits, taken).otherwise(acc["taken"]).alias("taken"), F.when(fits, grown).otherwise(acc["picks"]).alias("picks"))

    state = cut(rows.select("g").distinct().selectExpr("g", "0L as spent", "0 as taken", f"cast(null as {key}) as seen", f"cast(array() as array<struct<k:{key},spent:bigint,taken:int>>) as picks"))
    while True:
        open_ = state.where(F.col("taken") < max_files).select(F.col("g").alias("h"), "spent", "taken", "seen")
        ahead = rows.join(open_, F.col("g").eqNullSafe(F.col("h"))).where((F.col("t") <= budget - F.col("spent")) & (F.col("seen").isNull() | (F.col("k") > F.col("seen"))))
        first = ahead.withColumn("n", F.row_number().over(Window.partitionBy("g").orderBy("k"))).where(F.col("n") <= chunk)
        turn = cut(first.groupBy(F.col("g").alias("h")).agg(F.array_sort(F.collect_list(F.struct("k", "t"))).alias("a")))
        if turn.isEmpty():
            break
        grown = state.join(turn, F.col("g").eqNullSafe(F.col("h")), "left")
        grown = grown.withColumn("f", F.aggregate(F.coalesce("a", F.expr(f"cast(array() as array<struct<k:{key},t:bigint>>)")), F.struct("spent", "taken", "picks"), pick))
        state = cut(grown.select("g", "f.spent", "f.taken", F.coalesce(F.try_element_at("a", F.lit(-1))["k"], F.col("seen")).alias("seen"), "f.picks"))
    told = rows.join(state.select(F.col("g").alias("h"), "picks"), F.col("g").eqNullSafe(F.col("h"))).withColumn("at", F.try_element_at(F.filter("picks", lambda p: p["k"] <= F.col("k")), F.lit(-1)))
    action = F.when(F.col("at.k") == F.col("k"), "selected").when(F.col("at.taken") >= max_files, "cap reached").otherwise("over budget")
    return told.select(F.col("g").alias(group), F.col("i").alias(item), action.alias("action"), F.coalesce("at.spent", F.lit(0)).cast("bigint").alias("spent"))


def diverse_top_k(df: DataFrame, group: str, item: str, score: str, terms: str, k: int = 3, weight: float = 70.0) -> DataFrame:
    """(group, item, pick): k rounds of the best score less weight times the largest Jaccard similarity to earlier picks.

    A round is written once, so that the next one does not repeat it twice.
    """
    left = df.select(F.col(group).alias("g"), F.col(item).alias("i"), F.col(score).cast("double").alias("s"), F.array_distinct(terms).alias("t"), F.lit(0.0).alias("near"))
    picks = None
    for pick in range(1, k + 1):
        best = left.groupBy("g").agg(F.max_by(F.struct("i", "t"), F.struct((F.col("s") - weight * F.col("near")).alias("v"), (-F.col("i")).alias("o"))).alias("b"))
        chosen = best.select("g", F.col("b.i").alias("bi"), F.col("b.t").alias("bt"))
        own = chosen.select("g", F.col("bi").alias("i"), F.lit(pick).alias("pick"))
        picks = own if picks is None else picks.unionByName(own)
        union = F.size(F.array_union("t", "bt"))
        similar = F.when(union > 0, F.size(F.array_intersect("t", "bt")) / union).otherwise(0.0)
        if pick < k:
            left = cut(left.join(chosen, "g").where("i <> bi").select("g", "i", "s", "t", F.greatest("near", similar).alias("near")))
    return picks.withColumnsRenamed({"g": group, "i": item})


def bucket_order(df: DataFrame, group: list[str], bucket: str, order: list, places: list[str]) -> DataFrame:
    """df with position: the first item of each bucket moves to the front, in the buckets' order; the rest keep their rank."""
    w = Window.partitionBy(*group)
    first = F.row_number().over(Window.partitionBy(*group, bucket).orderBy(*order)) == 1
    place = F.array_position(F.array(*(F.lit(p) for p in places)), F.col(bucket))
    lead = F.when(first & (place > 0), place).otherwise(len(places) + 1)
    return df.withColumn("_lead", lead).withColumn("position", F.row_number().over(w.orderBy("_lead", *order))).drop("_lead")
