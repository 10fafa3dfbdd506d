"""Role coverage, score gaps, lanes, priors, lessons, reason buckets and flattened values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle.functions import values
from corpuscle.operators import picks
from corpuscle.plans.corpus import files
from corpuscle.plans.evaluation import RANKED_SQL, ranked
from corpuscle.plans.ranking import P_SQL
from corpuscle.plans.registry import PATH, TASK, query, read

SCOPE_SQL = "CASE WHEN path LIKE 'packages/web/%' THEN 'packages/web' WHEN path LIKE 'src/core/%' THEN 'src/core' WHEN path LIKE 'src/models/%' THEN 'src/models' ELSE '' END"
CONFIG_SQL = "(doc_id % 9 = 6 AND doc_id % 5 = 2)"
SOURCE_SQL = "((path LIKE 'src/%' OR path LIKE 'packages/%') AND doc_id % 9 IN (1, 3))"


@query("WIN09", f"""WITH {P_SQL}, r AS (SELECT source, doc_id, {SCOPE_SQL} AS scope, {CONFIG_SQL} AS a, {SOURCE_SQL} AS b, row_number() OVER (PARTITION BY source ORDER BY tokens DESC, doc_id) AS i FROM f),
g AS (SELECT source, count(*) AS n, bool_or(a AND i <= 6) AS has_a, bool_or(b AND i <= 6) AS has_b, min(i) FILTER (WHERE a AND i <= 30) AS ia, min(i) FILTER (WHERE b AND i <= 30) AS ib FROM r GROUP BY source),
m AS (SELECT g.*, x.scope AS sa, y.scope AS sb FROM g JOIN r x ON x.source = g.source AND x.i = ia JOIN r y ON y.source = g.source AND y.i = ib WHERE n >= 3 AND NOT (has_a AND has_b) AND (x.scope = '' OR y.scope = '' OR x.scope = y.scope)),
s AS (SELECT source, ia AS i FROM m WHERE NOT has_a UNION SELECT source, ib FROM m WHERE NOT has_b), o AS (SELECT source, i, CAST(row_number() OVER (PARTITION BY source ORDER BY i) AS INT) AS seed FROM s)
SELECT r.source, doc_id, seed FROM r LEFT JOIN o ON o.source = r.source AND o.i = r.i""")
def role_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeds that move to the front; the order is by seed, then as before."""
    f = files(spark, sf_dir).select("source", "doc_id", "path", "tokens")
    seeds = picks.role_seeds(f, "source", "doc_id", [F.desc("tokens"), F.col("doc_id")], (F.expr(CONFIG_SQL), F.expr(SOURCE_SQL)), F.expr(SCOPE_SQL), 6)
    return f.select("source", "doc_id").join(seeds, ["source", "doc_id"], "left")


@query("WIN10", f"WITH {RANKED_SQL}, l AS (SELECT source, max(rank) AS rank FROM ranked WHERE rank <= 10 GROUP BY source), t AS (SELECT source, tokens FROM ranked JOIN l USING (source, rank)) SELECT r.source, doc_id, round_even(CAST(r.tokens AS DOUBLE) / 7 - CAST(t.tokens AS DOUBLE) / 7, 1) AS gap FROM ranked r JOIN t USING (source) WHERE expected AND rank > 10")
def missed_score_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far expected documents that were not selected lie behind the last selected one."""
    rows = ranked(spark, sf_dir).select("source", "doc_id", "expected", (F.col("tokens") / 7.0).alias("score"), F.when(F.col("rank") <= 10, F.col("rank")).alias("place"))
    return picks.score_gaps(rows, "source", "score", "place").where("expected and place is null").select("source", "doc_id", "gap")


LANE_SQL = "CASE o_orderkey % 6 WHEN 0 THEN ['now'] WHEN 1 THEN ['weak_spot', 'breadth'] WHEN 2 THEN ['breadth'] WHEN 3 THEN ['now', 'weak_spot'] WHEN 4 THEN ['later'] ELSE ['now', 'weak_spot', 'breadth'] END"


def _lane_sql() -> str:
    """One step a lane: the best row by (mastered, used project, place) of those whose topic is free."""
    steps, used = [], []
    for i, lane in enumerate(picks.LANES):
        free = "".join(f" AND NOT EXISTS (FROM k{j} WHERE k{j}.g = c.g AND k{j}.t = c.t)" for j in range(i))
        spent = " OR ".join(f"EXISTS (FROM k{j} WHERE k{j}.g = c.g AND k{j}.p = c.p)" for j in range(i)) or "false"
        steps.append(f"k{i} AS (SELECT g, t, p, '{lane}' AS lane FROM (SELECT *, {spent} AS used FROM c WHERE list_contains(lanes, '{lane}'){free}) QUALIFY row_number() OVER (PARTITION BY g ORDER BY m, used, score DESC, t) = 1)")
        used.append(f"SELECT * FROM k{i}")
    return f"WITH c AS (SELECT o_custkey AS g, o_orderkey AS t, o_orderpriority AS p, o_orderstatus = 'P' AS m, o_totalprice AS score, {LANE_SQL} AS lanes FROM orders), {', '.join(steps)} SELECT g AS o_custkey, lane, t AS o_orderkey, p AS o_orderpriority FROM ({' UNION ALL '.join(used)})"


@query("SRT04", _lane_sql())
def lane_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders stand for topics, priorities for projects, pending ones for what is mastered."""
    names = {0: ["now"], 1: ["weak_spot", "breadth"], 2: ["breadth"], 3: ["now", "weak_spot"], 4: ["later"], 5: picks.LANES}
    lanes = F.element_at(F.array(*(F.array(*(F.lit(x) for x in names[i])) for i in range(6))), (F.col("o_orderkey") % 6 + 1).cast("int"))
    rows = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderpriority", (F.col("o_orderstatus") == "P").alias("mastered"), "o_totalprice", lanes.alias("lanes"))
    return picks.lane_topics(rows, "o_custkey", "o_orderkey", "o_orderpriority", "lanes", "mastered", [F.desc("o_totalprice"), F.col("o_orderkey")])


@query("SRT06", rf"""WITH e AS (SELECT doc_id, {PATH} AS path, {TASK} AS task FROM documents), t AS (SELECT *, list_distinct(list_filter(string_split_regex(lower(task), '[^a-z0-9]+'), lambda w: length(w) >= 3)) AS terms, list_distinct(string_split(translate(lower(path), '/_-.', '    '), ' ')) AS parts FROM e),
s AS (SELECT *, len(list_intersect(terms, ['fix', 'user', 'service', 'order', 'tests', 'login'])) AS shared, least(3, len(list_intersect(parts, ['fix', 'user', 'service', 'order', 'tests', 'login']))) AS bonus FROM t),
p AS (SELECT path, CAST(sum(shared + bonus) AS BIGINT) AS score, count(*) AS events, list(task ORDER BY doc_id)[1:3] AS evidence, arg_max(task, doc_id) AS last FROM s WHERE shared > 0 GROUP BY path)
SELECT path, score, events, round(least(0.85, 0.35 + score * 0.08 + least(events, 3) * 0.08), 2)::DOUBLE AS confidence, array_to_string(evidence, '; ') AS evidence, last FROM p ORDER BY score DESC, path LIMIT 5""")
def observer_priors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents").select("doc_id", F.expr(PATH).alias("path"), F.expr(TASK).alias("task"))
    out = picks.route_priors(rows, "task", "path", "doc_id", "Fix user-service & order tests: login", last=None)
    return out.withColumn("evidence", F.array_join("evidence", "; "))


@query("SRT07", "SELECT p_partkey, CAST(p_size * 2 + CASE WHEN p_type = 'PROMO' THEN 30 ELSE 0 END + CASE WHEN p_partkey % 2 = 0 THEN 15 ELSE 0 END + CASE WHEN contains(p_name, 'ring') THEN 10 ELSE 0 END + CASE WHEN contains(p_name, 'red') THEN 10 ELSE 0 END + CASE WHEN contains(p_name, 'bolt') THEN 20 ELSE 0 END AS BIGINT) AS score FROM part WHERE NOT contains(p_name, 'gear') ORDER BY score DESC, p_partkey LIMIT 25")
def lesson_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "part").select("p_partkey", "p_name", (F.col("p_size") * 2).alias("confidence"), "p_type")
    return picks.rank_lessons(rows, "p_name", "confidence", F.col("p_type") == "PROMO", F.col("p_partkey") % 2 == 0, "p_partkey", ["Ring", "red"], ["BOLT"], ["gear"], 25).select("p_partkey", "score")


#: Reasons in many spellings; a document has one of them by its id.
REASONS = [
    "Related test for src/a.py", "src/b has related tests", "Caller of selected symbol f", "reverse dependency of x", "direct dependency of y", "keyword phrase match: a b", "matched entrypoint: main", "matched side effect: disk",
    "Multi-term path match", "api route owner match", "API endpoint pair with z", "api producer for frontend call", "generic public api penalty", "weak filename-only match", "matched role keyword: q", "release/version metadata", "budget exceeded", "modified",
]
REASON_AT = "CASE doc_id % 18 " + " ".join(f"WHEN {i} THEN '{r}'" for i, r in enumerate(REASONS)) + " END"


@query("AGG29", f"""WITH r AS (SELECT lower({REASON_AT}) AS low, {REASON_AT} AS reason FROM documents) SELECT CASE WHEN regexp_matches(low, '^(related test|test for)|has related tests') THEN 'related_test' WHEN regexp_matches(low, '^(caller of selected symbol|reverse dependency)') THEN 'caller_or_reverse_dependency'
WHEN regexp_matches(low, '^direct (dependency|content evidence)') THEN 'direct_evidence' WHEN regexp_matches(low, '^(keyword phrase|literal definition|quoted literal) match:') THEN 'literal_or_phrase_match' WHEN regexp_matches(low, '^matched (call|define|entrypoint):') THEN 'symbol_or_entrypoint_match'
WHEN regexp_matches(low, '^matched (env read|external system|side effect):') THEN 'side_effect_or_external_match' WHEN low LIKE 'multi-term path match%' THEN 'multi_term_path_match' WHEN low LIKE 'api route owner match%' THEN 'api_route_owner_match' WHEN low LIKE 'api endpoint pair with%' THEN 'api_endpoint_pair'
WHEN low LIKE 'api producer for frontend call%' THEN 'api_producer_for_frontend_call' WHEN low LIKE 'generic public api penalty%' THEN 'generic_public_api_penalty' WHEN low LIKE 'weak filename-only match%' THEN 'weak_filename_only_match'
WHEN regexp_matches(low, '^matched (domain|naming keyword|ranking keyword|role keyword):') THEN 'broad_keyword_match' WHEN regexp_matches(low, '^(workspace match|release/version metadata|build/dependency metadata)') THEN 'repo_metadata_match' WHEN low LIKE 'budget%' THEN 'budget' ELSE reason END AS bucket, count(*) AS n FROM r GROUP BY 1 ORDER BY n DESC, bucket""")
def reason_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").groupBy(picks.reason_bucket(F.expr(REASON_AT)).alias("bucket")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "bucket")


FIELD = (
    "CASE event_id % 7 WHEN 0 THEN concat('\"', event_type, ' call\"') WHEN 1 THEN concat('[\"', event_type, '\",\"order view\"]') WHEN 2 THEN concat('[{\"name\":\"', event_type, '\",\"line\":3},\"', CAST(user_id AS STRING), '\"]') "
    "WHEN 3 THEN 'null' WHEN 4 THEN CAST(user_id AS STRING) WHEN 5 THEN '[]' ELSE concat('[', CAST(user_id AS STRING), ',{\"line\":', CAST(event_id % 5 AS STRING), '}]') END"
)


@query("COL02", f"""WITH e AS (SELECT event_id, CAST({FIELD} AS JSON) AS j FROM events), x AS (SELECT event_id, CASE json_type(j) WHEN 'NULL' THEN [] WHEN 'VARCHAR' THEN [j ->> '$'] WHEN 'ARRAY' THEN list_transform(CAST(j AS JSON[]), lambda i: coalesce(i ->> '$.name', CASE WHEN json_type(i) = 'VARCHAR' THEN i ->> '$' ELSE CAST(i AS VARCHAR) END)) ELSE [CAST(j AS VARCHAR)] END AS v FROM e),
w AS (SELECT event_id, v, list_transform(v, lambda i: CASE WHEN contains(lower(i), 'view') THEN 1.25 WHEN contains(lower(i), 'click') THEN 1.0 WHEN contains(lower(i), 'error') THEN 0.5 ELSE 0 END) AS s FROM x)
SELECT event_id, array_to_string(v, '|') AS vals, CASE WHEN list_max(s) > 0 THEN v[list_position(s, list_max(s))] END AS best, CASE WHEN list_max(s) > 0 THEN CAST(list_max(s) AS DOUBLE) END AS weight FROM w""")
def flattened_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = read(spark, sf_dir, "events").select("event_id", values.flat_values(F.expr(FIELD)).alias("v"))
    best = values.best_match(F.col("v"), [("view", 1.25), ("click", 1.0), ("error", 0.5)])
    return own.select("event_id", F.array_join("v", "|").alias("vals"), best["value"].alias("best"), best["weight"].alias("weight"))
