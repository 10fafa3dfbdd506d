"""Cross-layer and API boosts, selectors, the skill map, and times of memory records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle.operators import related
from corpuscle.plans.corpus import SCORE_SQL, WORDS_SQL, scored
from corpuscle.plans.registry import query, read

KEYWORDS = ["order", "settings", "index"]


def _sql_list(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


PATH_TOKENS_SQL = WORDS_SQL.replace("text", r"regexp_replace(p, '([^/])\.[^./]*$', '\1')", 1)


@query("JON13", f"""WITH s AS (SELECT doc_id, p, CAST(score AS DOUBLE) AS score, p LIKE 'dist/%' OR p LIKE '%.bin' AS skipped FROM ({SCORE_SQL})), t AS (SELECT *, list_distinct({PATH_TOKENS_SQL}) AS tokens FROM s),
d AS (SELECT *, list_filter(tokens, lambda x: length(x) >= 3 AND NOT list_contains({_sql_list(related.NOISE)}, x)) AS dom FROM t), l AS (SELECT min(score) AS least FROM (SELECT score FROM s WHERE score > 0 AND NOT skipped ORDER BY score DESC LIMIT 5)),
terms AS (SELECT DISTINCT unnest(dom) AS term FROM d, l WHERE score >= least AND list_has_any(tokens, {_sql_list(related.ENTRYPOINT_ROLES)}) UNION SELECT k FROM (SELECT unnest({_sql_list(KEYWORDS)}) AS k), l WHERE least IS NOT NULL AND NOT list_contains({_sql_list(related.NOISE)}, k)),
a AS (SELECT list(term) AS terms FROM terms) SELECT doc_id, score + CASE WHEN r THEN 30 ELSE 0 END AS score, r AS related FROM (SELECT *, coalesce(NOT skipped AND list_has_any(tokens, {_sql_list(related.IMPLEMENTATION_ROLES)}) AND list_has_any(dom, terms), false) AS r FROM d, a)""")
def cross_layer_related(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(spark, sf_dir).select("doc_id", "path", "score", (F.col("path").startswith("dist/") | F.col("path").endswith(".bin")).alias("skipped"))
    return related.cross_layer(rows, "doc_id", KEYWORDS).select("doc_id", "score", "related")


API = "concat('/api/', replace(p_name, ' ', '/'), '/', lower(p_type))"


@query("JON11", f"""WITH e AS (SELECT {API} AS api_path, max(p_partkey) AS item FROM part GROUP BY 1), n AS (SELECT p_partkey, {API} AS api_path FROM part),
c AS (SELECT api_path, 1000000 + l_orderkey AS consumer, min((l_orderkey, l_linenumber)) AS slot FROM lineitem JOIN n ON p_partkey = l_partkey WHERE l_returnflag <> 'R' GROUP BY ALL),
m AS (SELECT item, api_path, consumer, slot, 108.0 + CASE WHEN list_has_any(string_split_regex(lower(api_path), '[^a-z0-9]+'), ['ring', 'promo']) THEN 45 ELSE 0 END AS amount FROM c JOIN e USING (api_path) WHERE item <> consumer)
SELECT item, CAST(amount AS DOUBLE) AS amount, api_path, consumer FROM m QUALIFY row_number() OVER (PARTITION BY item ORDER BY amount DESC, slot, api_path, consumer) = 1""")
def api_producers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts answer for the path of their name; orders call the paths of their lines."""
    part = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("item"), F.expr(API).alias("api_path"))
    lines = read(spark, sf_dir, "lineitem").where("l_returnflag <> 'R'").select((1000000 + F.col("l_orderkey")).alias("consumer"), F.col("l_partkey").alias("item"), F.col("l_orderkey").alias("place"), F.col("l_linenumber").alias("slot"))
    calls = lines.join(part, "item").drop("item")
    return related.producer_boosts(part.withColumn("place", F.col("item")), calls, ["ring", "promo"])


@query("FLT03", """SELECT p_type, p_brand, count(*) AS edges, min(l_orderkey) AS first FROM lineitem JOIN part ON l_partkey = p_partkey
WHERE p_type IN ('PROMO', 'SMALL') AND ('parts/' || p_brand || '/' || p_size GLOB 'parts/Brand#1?/*' OR 'parts/' || p_brand || '/' || p_size GLOB '*/4?') AND (contains(p_name, 'ring') OR contains(p_name, 'bolt')) GROUP BY ALL""")
def forbidden_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All edges whose source a selector of types, path globs and name parts picks."""
    part = read(spark, sf_dir, "part").withColumn("path", F.concat(F.lit("parts/"), "p_brand", F.lit("/"), F.col("p_size").cast("string")))
    own = related.selected(F.col("p_type"), F.col("path"), F.col("p_name"), kinds=["PROMO", "SMALL"], globs=["parts/Brand#1?/*", "*/4?"], contains=["ring", "bolt"])
    sources = part.where(own).select(F.col("p_partkey").alias("l_partkey"), "p_type", "p_brand")
    return read(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey").join(sources, "l_partkey").groupBy("p_type", "p_brand").agg(F.count("*").alias("edges"), F.min("l_orderkey").alias("first"))


@query("AGG26", """WITH k AS (SELECT c_custkey AS skill, c_custkey % 5 AS task_count, CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE c_custkey % 40 END AS confidence, -1 AS last_task, c_custkey % 9 = 0 AS suppressed FROM customer),
e AS (SELECT user_id AS skill, event_id AS task, (CASE WHEN event_type = 'view' THEN 0 ELSE CAST(floor(value) AS BIGINT) % 60 END) AS c, ts FROM events),
f AS (SELECT coalesce(k.skill, e.skill) AS skill, coalesce(any_value(task_count), 0) AS before, coalesce(any_value(confidence), 0) AS was, coalesce(bool_or(suppressed), false) AS off, list(task ORDER BY ts DESC) FILTER (WHERE task IS NOT NULL) AS tasks, list(c ORDER BY ts) FILTER (WHERE task IS NOT NULL) AS cs FROM k FULL JOIN e ON k.skill = e.skill GROUP BY 1),
r AS (SELECT *, cs IS NOT NULL AND NOT off AS grown FROM f)
SELECT skill, CAST(before + CASE WHEN grown THEN len(cs) ELSE 0 END AS BIGINT) AS task_count,
 CAST(CASE WHEN grown THEN list_reduce(list_prepend(CAST(was AS BIGINT), cs), lambda acc, x, i: CASE WHEN acc = 0 THEN least(100, x) ELSE least(100, greatest(acc, x) + least(10, before + i)) END) ELSE was END AS BIGINT) AS confidence,
 CASE WHEN grown THEN tasks[1] ELSE -1 END AS last_task, CASE WHEN grown THEN array_to_string(tasks[1:10], ' ') ELSE '' END AS recent FROM r""")
def skill_map_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers stand for the known skills, events for the evidence of a session."""
    known = read(spark, sf_dir, "customer").selectExpr("c_custkey skill", "c_custkey % 5 task_count", "case when c_custkey % 3 = 0 then 0 else c_custkey % 40 end confidence", "-1L last_task", "c_custkey % 9 = 0 suppressed")
    evidence = read(spark, sf_dir, "events").selectExpr("user_id skill", "ts at", "event_id task", "case when event_type = 'view' then 0 else cast(floor(value) as bigint) % 60 end confidence")
    return related.upsert_skills(known, evidence).withColumn("recent", F.array_join(F.transform("recent", lambda x: x.cast("string")), " "))


@query("DTE01 DTE04", """WITH v AS (SELECT event_id % 6 AS form, ts, CASE event_id % 6 WHEN 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ') WHEN 1 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') WHEN 2 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+02:00' WHEN 3 THEN strftime(ts, '%Y-%m-%d') WHEN 4 THEN '2024-13-40T00:00:00Z' ELSE '' END AS s FROM events),
p AS (SELECT form, CASE form WHEN 0 THEN date_trunc('second', ts) WHEN 1 THEN date_trunc('second', ts) WHEN 2 THEN date_trunc('second', ts) - INTERVAL 2 HOUR WHEN 3 THEN date_trunc('day', ts) END AS t FROM v)
SELECT form, count(t) AS parsed, CAST(epoch(min(t)) AS BIGINT) AS first, CAST(epoch(max(t)) AS BIGINT) AS last, sum(CASE WHEN floor((epoch(TIMESTAMP '2024-07-15') - epoch(t)) / 86400) > 180 THEN 0.5 ELSE 1.0 END)::DOUBLE AS weight FROM p GROUP BY form""")
def memory_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times in six spellings, two of them wrong, and the weight that age leaves."""
    ts = F.col("ts")
    forms = ["yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss'+02:00'", "yyyy-MM-dd"]
    said = F.lit("")
    for i, form in enumerate(forms):
        said = F.when(F.col("event_id") % 6 == i, F.date_format(ts, form)).otherwise(said)
    said = F.when(F.col("event_id") % 6 == 4, F.lit("2024-13-40T00:00:00Z")).otherwise(said)
    own = read(spark, sf_dir, "events").select((F.col("event_id") % 6).alias("form"), related.iso_time(said).alias("t"))
    weight = related.memory_weight(F.col("t"), F.lit("2024-07-15 00:00:00+00:00").cast("timestamp"))
    seconds = F.unix_seconds("t")
    return own.groupBy("form").agg(F.count("t").alias("parsed"), F.min(seconds).alias("first"), F.max(seconds).alias("last"), F.sum(weight).alias("weight"))
