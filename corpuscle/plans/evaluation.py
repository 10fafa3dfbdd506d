"""Retrieval quality: precision, recall, ranks, confusion, comparisons of variants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuscle.functions import classify
from corpuscle.operators import relational as rel
from corpuscle.plans.registry import query, read

RANKED_SQL = "ranked AS (SELECT doc_id, source, lang, length(text) // 4 AS tokens, quality = 1 AS expected, toxic = 1 AS noise, row_number() OVER (PARTITION BY source ORDER BY length(text) DESC, doc_id) AS rank FROM documents JOIN labels USING (doc_id))"


def ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents ranked within their source by size."""
    rows = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id")
    rows = rows.select("doc_id", "source", "lang", F.floor(F.length("text") / 4).alias("tokens"), (F.col("quality") == 1).alias("expected"), (F.col("toxic") == 1).alias("noise"), F.length("text").alias("n"))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n"), "doc_id"))).drop("n")


@query("SET04 EVL01", f"WITH {RANKED_SQL}, m AS (SELECT source, count(*) FILTER (WHERE rank <= 10 AND expected) / count(*) FILTER (WHERE rank <= 10) AS p, count(*) FILTER (WHERE rank <= 10 AND expected) / nullif(count(*) FILTER (WHERE expected), 0) AS r FROM ranked GROUP BY source) SELECT source, p AS precision, r AS recall, CASE WHEN p + r > 0 THEN round(2 * p * r / (p + r), 9) ELSE 0 END AS f1 FROM m")
def precision_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = F.count_if((F.col("rank") <= 10) & F.col("expected"))
    per = ranked(spark, sf_dir).groupBy("source").agg((hit / F.count_if(F.col("rank") <= 10)).alias("precision"), (hit / F.nullif(F.count_if("expected"), F.lit(0))).alias("recall"))
    total = F.col("precision") + F.col("recall")
    return per.withColumn("f1", F.when(total > 0, F.round(2 * F.col("precision") * F.col("recall") / total, 9)).otherwise(0.0))


@query("WIN05", f"WITH {RANKED_SQL}, k(k) AS (VALUES (5), (20), (50)) SELECT source, k, count(*) FILTER (WHERE expected AND rank <= k) / nullif(count(*) FILTER (WHERE expected), 0) AS recall, count(*) FILTER (WHERE expected AND rank <= k) / count(*) FILTER (WHERE rank <= k) AS precision FROM ranked, k GROUP BY source, k")
def precision_recall_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ranked(spark, sf_dir).withColumn("k", F.explode(F.array(F.lit(5), F.lit(20), F.lit(50))))
    hit = F.count_if(F.col("expected") & (F.col("rank") <= F.col("k")))
    return rows.groupBy("source", "k").agg((hit / F.nullif(F.count_if("expected"), F.lit(0))).alias("recall"), (hit / F.count_if(F.col("rank") <= F.col("k"))).alias("precision"))


@query("WIN07", f"""WITH {RANKED_SQL}, m AS (SELECT source, count(*) FILTER (WHERE rank <= 3) AS top, count(*) FILTER (WHERE expected) AS wanted, count(*) FILTER (WHERE noise) AS avoided, count(*) FILTER (WHERE rank <= 3 AND expected) AS hits,
count(*) FILTER (WHERE rank <= 3 AND noise) AS bad, min(rank) FILTER (WHERE rank <= 3 AND expected) AS first FROM ranked GROUP BY source)
SELECT source, CASE WHEN wanted > 0 THEN hits / wanted END AS recall, CASE WHEN wanted > 0 THEN hits / top END AS precision, CASE WHEN wanted > 0 THEN coalesce(1 / first, 0) END AS mrr, CASE WHEN avoided > 0 THEN bad / top END AS noise_rate FROM m""")
def mrr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three of each source: recall, precision, reciprocal rank of the first expected one, and noise; null where nothing is expected or avoided."""
    top = F.col("rank") <= 3
    n, wanted, avoided, hits, bad = F.count_if(top), F.count_if("expected"), F.count_if("noise"), F.count_if(top & F.col("expected")), F.count_if(top & F.col("noise"))
    first = F.coalesce(1 / F.min(F.when(top & F.col("expected"), F.col("rank"))), F.lit(0.0))
    return ranked(spark, sf_dir).groupBy("source").agg(
        F.when(wanted > 0, hits / wanted).alias("recall"), F.when(wanted > 0, hits / n).alias("precision"), F.when(wanted > 0, first).alias("mrr"), F.when(avoided > 0, bad / n).alias("noise_rate")
    )


@query("WIN06", f"""WITH {RANKED_SQL}, e AS (SELECT source, list(rank ORDER BY rank) AS r FROM ranked WHERE expected GROUP BY source) SELECT source, r[1 + CAST(round_even((len(r) - 1) * 0.5, 0) AS INT)] AS median, r[1 + CAST(round_even((len(r) - 1) * 0.9, 0) AS INT)] AS p90, r[1] AS first, r[-1] AS last,
len(list_filter(r, lambda x: x <= 3)) AS b1_3, len(list_filter(r, lambda x: x BETWEEN 4 AND 8)) AS b4_8, len(list_filter(r, lambda x: x BETWEEN 9 AND 20)) AS b9_20, len(list_filter(r, lambda x: x > 20)) AS b21_plus FROM e""")
def rank_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest-index percentiles, half to even, from positions: no group is gathered into an array."""
    own = ranked(spark, sf_dir).where("expected").select("source", F.col("rank").cast("bigint").alias("rank"))
    at = own.withColumn("i", F.row_number().over(Window.partitionBy("source").orderBy("rank")) - 1).join(own.groupBy("source").agg(F.count("*").alias("n")), "source")
    pick = lambda p: F.max(F.when(F.col("i") == F.bround((F.col("n") - 1) * F.lit(p)), F.col("rank")))
    within = lambda lo, hi: F.count_if(F.col("rank").between(lo, hi))
    return at.groupBy("source").agg(pick(0.5).alias("median"), pick(0.9).alias("p90"), F.min("rank").alias("first"), F.max("rank").alias("last"), within(1, 3).alias("b1_3"), within(4, 8).alias("b4_8"), within(9, 20).alias("b9_20"), F.count_if(F.col("rank") > 20).alias("b21_plus"))


@query("AGG14", f"WITH {RANKED_SQL}, t(k) AS (VALUES (5), (10), (20)) SELECT k, source, lang, count(*) FILTER (WHERE rank <= k AND expected) AS tp, count(*) FILTER (WHERE rank <= k AND NOT expected) AS fp, count(*) FILTER (WHERE rank > k AND expected) AS fn, count(*) FILTER (WHERE rank > k AND NOT expected) AS tn FROM ranked, t GROUP BY k, CUBE (source, lang)")
def confusion_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ranked(spark, sf_dir).withColumn("k", F.explode(F.array(F.lit(5), F.lit(10), F.lit(20))))
    taken, e = F.col("rank") <= F.col("k"), F.col("expected")
    cells = [F.count_if(c).alias(n) for n, c in (("tp", taken & e), ("fp", taken & ~e), ("fn", ~taken & e), ("tn", ~taken & ~e))]
    return rows.groupingSets([["k"], ["k", "source"], ["k", "lang"], ["k", "source", "lang"]], "k", "source", "lang").agg(*cells).select("k", "source", "lang", "tp", "fp", "fn", "tn")


@query("AGG16 EVL08", """WITH l AS (SELECT user_id AS case_id, event_type AS variant, arg_max(value >= 50, (ts, event_id)) AS passed FROM events WHERE event_type IN ('view', 'click') GROUP BY 1, 2), a AS (SELECT * FROM l WHERE variant = 'view'), b AS (SELECT * FROM l WHERE variant = 'click')
SELECT CASE WHEN a.case_id IS NULL OR b.case_id IS NULL THEN 'incomplete' WHEN NOT a.passed AND b.passed THEN 'improved' WHEN a.passed AND NOT b.passed THEN 'regressed' ELSE 'unchanged' END AS status, count(*) AS n FROM a FULL JOIN b USING (case_id) GROUP BY 1""")
def variant_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = read(spark, sf_dir, "events").where("event_type in ('view', 'click')").select("user_id", "event_type", "ts", "event_id", (F.col("value") >= 50).alias("passed"))
    last = rel.latest(own, ["user_id", "event_type"], ["ts", "event_id"])
    side = lambda t, n: last.where(F.col("event_type") == t).select("user_id", F.col("passed").alias(n), F.lit(True).alias(f"has_{n}"))
    both = side("view", "a").join(side("click", "b"), "user_id", "full_outer")
    status = F.when(F.col("has_a").isNull() | F.col("has_b").isNull(), "incomplete").when(~F.col("a") & F.col("b"), "improved").when(F.col("a") & ~F.col("b"), "regressed").otherwise("unchanged")
    return both.groupBy(status.alias("status")).agg(F.count("*").alias("n"))


@query("AGG15", """WITH s AS (SELECT event_type AS strategy, count(*) AS runs, avg(CASE WHEN value >= 50 THEN 1.0 ELSE 0 END) AS success, avg(coalesce(value, 0)) AS cost FROM events GROUP BY event_type)
SELECT t.strategy, t.runs, round(t.success * 100 - b.success * 100, 6) AS success_pp, round(b.cost - t.cost, 6) AS cost_saved FROM s t, s b WHERE b.strategy = 'view' AND t.strategy <> 'view'""")
def ab_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = read(spark, sf_dir, "events").groupBy(F.col("event_type").alias("strategy")).agg(F.count("*").alias("runs"), F.avg(F.when(F.col("value") >= 50, 1.0).otherwise(0.0)).alias("success"), F.avg(F.coalesce("value", F.lit(0.0))).alias("cost"))
    base = per.where("strategy = 'view'").select(F.col("success").alias("bs"), F.col("cost").alias("bc"))  # one row
    return per.where("strategy <> 'view'").crossJoin(F.broadcast(base)).select("strategy", "runs", F.round(F.col("success") * 100 - F.col("bs") * 100, 6).alias("success_pp"), F.round(F.col("bc") - F.col("cost"), 6).alias("cost_saved"))


MISS_SQL = f"WITH {RANKED_SQL} SELECT CASE WHEN rank IS NULL THEN 'EXPECTED_NOT_FOUND' WHEN lang = 'es' THEN 'EXPECTED_NOT_SCORED' WHEN tokens <= 20 OR rank > 50 THEN 'EXPECTED_RANKED_LOW' WHEN doc_id % 3 = 0 THEN 'EXPECTED_SKIPPED' ELSE 'NOISE_SELECTED_ABOVE_EXPECTED' END AS failure, count(*) AS n FROM labels l LEFT JOIN ranked USING (doc_id) WHERE quality = 1 AND (rank IS NULL OR rank > 5) GROUP BY 1"


@query("EVL03 AGG13", MISS_SQL)
def miss_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    expected = read(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    rows = expected.join(ranked(spark, sf_dir), "doc_id", "left").where("rank is null or rank > 5")
    score = F.when(F.col("tokens") > 20, F.col("tokens")).otherwise(0)
    status = F.when(F.col("doc_id") % 3 == 0, "over budget").otherwise("selected")
    kind = classify.miss_type(F.col("rank").isNotNull(), F.col("lang") != "es", F.col("rank"), score, status, F.lit(5))
    return rows.groupBy(kind.alias("failure")).agg(F.count("*").alias("n"))


@query("EVL02", f"WITH {RANKED_SQL}, c AS (SELECT source, lang, count(*) FILTER (WHERE expected AND rank <= 20) / count(*) FILTER (WHERE expected) AS recall, sum(tokens) FILTER (WHERE expected AND rank <= 20) / sum(tokens) FILTER (WHERE rank <= 20) AS tp FROM ranked GROUP BY source, lang HAVING count(*) FILTER (WHERE expected) > 0) SELECT lang, count(*) AS cases, round(avg(recall), 9) AS recall, round(avg(tp), 9) AS token_precision, avg(recall) >= 0.6 AND avg(tp) >= 0.5 AS passed FROM c GROUP BY ROLLUP (lang)")
def quality_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    top, e = F.col("rank") <= 20, F.col("expected")
    cases = ranked(spark, sf_dir).groupBy("source", "lang").agg(F.count_if(e).alias("n"), F.count_if(e & top).alias("hit"), F.sum(F.when(e & top, F.col("tokens"))).alias("good"), F.sum(F.when(top, F.col("tokens"))).alias("all")).where("n > 0")
    cases = cases.select("lang", (F.col("hit") / F.col("n")).alias("recall"), (F.col("good") / F.col("all")).alias("tp"))
    return cases.rollup("lang").agg(F.count("*").alias("cases"), F.round(F.avg("recall"), 9).alias("recall"), F.round(F.avg("tp"), 9).alias("token_precision"), ((F.avg("recall") >= 0.6) & (F.avg("tp") >= 0.5)).alias("passed"))


@query("EVL04", f"WITH {RANKED_SQL}, s AS (SELECT source, sum(tokens) AS packed, sum(tokens) FILTER (WHERE expected) AS good, arg_max(tokens, rank) AS last_tokens, arg_max(expected, rank) AS last_expected FROM ranked WHERE rank <= 10 GROUP BY source) SELECT source, CAST(CASE WHEN last_expected THEN 0 ELSE last_tokens END AS BIGINT) AS waste, round((coalesce(good, 0) - CASE WHEN last_expected THEN last_tokens ELSE 0 END) / (packed - last_tokens) - coalesce(good, 0) / packed, 9) AS gain FROM s WHERE packed > last_tokens")
def extra_file_waste(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = ranked(spark, sf_dir).where("rank <= 10").groupBy("source").agg(F.sum("tokens").alias("packed"), F.coalesce(F.sum(F.when(F.col("expected"), F.col("tokens"))), F.lit(0)).alias("good"), F.max_by("tokens", "rank").alias("last_tokens"), F.max_by("expected", "rank").alias("last_expected")).where("packed > last_tokens")
    without = F.col("good") - F.when(F.col("last_expected"), F.col("last_tokens")).otherwise(0)
    return per.select("source", F.when(F.col("last_expected"), 0).otherwise(F.col("last_tokens")).cast("bigint").alias("waste"), F.round(without / (F.col("packed") - F.col("last_tokens")) - F.col("good") / F.col("packed"), 9).alias("gain"))


@query("EVL05 WIN11", f"WITH {RANKED_SQL}, t(k) AS (VALUES (100), (500), (2000)), p AS (SELECT source, k, sum(tokens) FILTER (WHERE tokens >= k) AS kept, sum(tokens) FILTER (WHERE tokens >= k AND expected) AS good FROM ranked, t GROUP BY source, k) SELECT k, count(*) AS records, CAST(sum(kept) AS BIGINT) AS kept, round(avg(good / kept), 9) AS token_precision FROM p WHERE kept > 0 GROUP BY k")
def pruning_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ranked(spark, sf_dir).withColumn("k", F.explode(F.array(F.lit(100), F.lit(500), F.lit(2000)))).where("tokens >= k")
    per = rows.groupBy("source", "k").agg(F.sum("tokens").alias("kept"), F.sum(F.when(F.col("expected"), F.col("tokens"))).alias("good"))
    return per.groupBy("k").agg(F.count("*").alias("records"), F.sum("kept").alias("kept"), F.round(F.avg(F.col("good") / F.col("kept")), 9).alias("token_precision"))


@query("EVL06", f"WITH {RANKED_SQL}, e AS (SELECT DISTINCT source, lang FROM ranked WHERE expected), s AS (SELECT * FROM ranked WHERE rank <= 10) SELECT source, count(*) AS selected, count(e.lang) AS same_package FROM s LEFT JOIN e USING (source, lang) GROUP BY source")
def package_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ranked(spark, sf_dir)
    packages = rows.where("expected").select("source", "lang").distinct().withColumn("hit", F.lit(1))
    return rows.where("rank <= 10").join(packages, ["source", "lang"], "left").groupBy("source").agg(F.count("*").alias("selected"), F.count("hit").alias("same_package"))


@query("RNK12", f"WITH {RANKED_SQL}, f AS (SELECT source, doc_id, lang, expected, count(*) OVER (PARTITION BY source, lang) AS rivals FROM ranked WHERE rank <= 50) SELECT source, CASE WHEN expected AND rivals = 1 THEN 3 WHEN expected AND rivals <= 5 THEN 2 WHEN expected THEN 1 ELSE 0 END AS strength, count(*) AS n FROM f GROUP BY 1, 2")
def owner_strength(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rivals of an anchor count only among the first fifty candidates."""
    top = ranked(spark, sf_dir).where("rank <= 50")
    rows = top.withColumn("rivals", F.count("*").over(Window.partitionBy("source", "lang")))
    strength = F.when(F.col("expected") & (F.col("rivals") == 1), 3).when(F.col("expected") & (F.col("rivals") <= 5), 2).when(F.col("expected"), 1).otherwise(0)
    return rows.groupBy("source", strength.alias("strength")).agg(F.count("*").alias("n"))


@query("EVL09", "WITH c AS (SELECT conv_id, count(*) FILTER (WHERE role = 'user') AS asks, count(*) FILTER (WHERE role = 'assistant') AS answers, count(*) FILTER (WHERE role = 'system') AS notes, sum(length(text)) AS chars FROM conversations GROUP BY conv_id) SELECT conv_id, CAST(greatest(0, 100 - CASE WHEN notes = 0 THEN 35 ELSE 0 END - CASE WHEN answers < asks THEN 15 ELSE 0 END - CASE WHEN chars < 1000 THEN 25 ELSE 0 END - least(20, 5 * asks)) AS BIGINT) AS score FROM c")
def report_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    role = lambda r: F.count_if(F.col("role") == r)
    per = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(role("user").alias("asks"), role("assistant").alias("answers"), role("system").alias("notes"), F.sum(F.length("text")).alias("chars"))
    deduct = F.when(F.col("notes") == 0, 35).otherwise(0) + F.when(F.col("answers") < F.col("asks"), 15).otherwise(0) + F.when(F.col("chars") < 1000, 25).otherwise(0) + F.least(F.lit(20), 5 * F.col("asks"))
    return per.select("conv_id", F.greatest(F.lit(0), 100 - deduct).cast("bigint").alias("score"))
