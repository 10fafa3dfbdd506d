"""Adjacency with filters, merged logs, recent paths and what a prune would drop."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuscle.functions import text
from corpuscle.operators import graph
from corpuscle.plans.graphs import BOTH_SQL, EDGES_SQL, edges, node
from corpuscle.plans.history import RECENT_SQL, recent_commits
from corpuscle.plans.corpus import STOP_SQL
from corpuscle.plans.registry import TASK, query, read
from corpuscle.sources import sinks


@query("GRF04", f"WITH {EDGES_SQL}, x AS (SELECT src AS node, dst AS other, type, 'out' AS side FROM edges WHERE src IN ('n7', 's3') UNION ALL SELECT dst, src, type, 'in' FROM edges WHERE dst IN ('n7', 's3') AND src <> dst) SELECT node, other, type, side FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY type, other, side) AS n FROM x WHERE type = 'belongs_to') WHERE n <= 40")
def adjacent_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 40 `belongs_to` edges of two nodes, in either direction."""
    return graph.adjacent(edges(spark, sf_dir), node(spark, "n7", "s3"), "belongs_to", limit=40)


BROWSE_SQL = """en AS (SELECT 'p' || p_partkey AS entity, p_name AS name, p_brand AS language FROM part UNION ALL SELECT 's' || s_suppkey, s_name, 'supply' FROM supplier),
ed AS (SELECT lpad(CAST(l_orderkey AS VARCHAR), 12, '0') || ':' || lpad(CAST(l_linenumber AS VARCHAR), 3, '0') AS key, 'p' || l_partkey AS src, 's' || l_suppkey AS dst, 'tested_by' AS type, CASE WHEN l_quantity > 25 THEN 'high' ELSE 'low' END AS confidence, [l_returnflag, l_linestatus] AS sources FROM lineitem),
hit AS (SELECT ed.* FROM ed JOIN en a ON a.entity = src JOIN en b ON b.entity = dst WHERE confidence = 'high' AND list_contains(sources, 'R') AND (contains(lower(a.name), 'r') AND contains(lower(a.name), 'e') OR contains(lower(b.name), 'r') AND contains(lower(b.name), 'e')) AND (a.language = 'Brand#12' OR b.language = 'Brand#12') ORDER BY key LIMIT 300)"""


@query("FLT11", f"WITH {BROWSE_SQL} SELECT 'edge' AS kind, key AS name, src, dst FROM hit UNION ALL SELECT 'entity', en.name, entity, '' FROM en WHERE entity IN (SELECT src FROM hit UNION SELECT dst FROM hit)")
def edge_browse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of high confidence with a source, all terms in an end's name and an end's brand, and the entities at their ends."""
    part = read(spark, sf_dir, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("entity"), F.col("p_name").alias("name"), F.col("p_brand").alias("language"))
    supplier = read(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("entity"), F.col("s_name").alias("name"), F.lit("supply").alias("language"))
    key = F.concat(F.lpad(F.col("l_orderkey").cast("string"), 12, "0"), F.lit(":"), F.lpad(F.col("l_linenumber").cast("string"), 3, "0"))
    own = read(spark, sf_dir, "lineitem").select(
        key.alias("key"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("src"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("dst"), F.lit("tested_by").alias("type"),
        F.when(F.col("l_quantity") > 25, "high").otherwise("low").alias("confidence"), F.array("l_returnflag", "l_linestatus").alias("sources"),
    )
    found, ends = graph.browse(own, part.unionByName(supplier), "tested_by", "high", "Brand#12", "R", ["R", "e"], 300)
    return found.select(F.lit("edge").alias("kind"), F.col("key").alias("name"), "src", "dst").unionByName(ends.select(F.lit("entity").alias("kind"), "name", F.col("entity").alias("src"), F.lit("").alias("dst")))


@query("SRC07", f"WITH {RECENT_SQL}, l AS (SELECT commit_id, l_partkey AS path, row_number() OVER (ORDER BY ts DESC, commit_id DESC, l_linenumber, l_partkey) AS position FROM recent JOIN lineitem ON commit_id = l_orderkey) SELECT position, commit_id, path FROM l")
def recent_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The paths of the last 200 commits in log order, repeats kept."""
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("commit_id"), F.col("l_partkey").alias("path"), "l_linenumber")
    own = lines.join(F.broadcast(recent_commits(spark, sf_dir)), "commit_id")
    position = F.row_number().over(Window.orderBy(F.desc("ts"), F.desc("commit_id"), "l_linenumber", "path"))  # the lines of 200 commits
    return own.select(position.cast("bigint").alias("position"), "commit_id", "path")


@query("SRC09 SNK09", "WITH a AS (SELECT event_id, event_type, ts, event_id AS place FROM events WHERE event_id % 3 <> 0 ORDER BY place DESC LIMIT 400), b AS (SELECT event_id, 'old' AS event_type, ts, event_id AS place FROM events WHERE event_id % 2 = 0 ORDER BY place DESC LIMIT 400), u AS (SELECT *, 0 AS l FROM a UNION ALL SELECT *, 1 FROM b), o AS (SELECT event_id, event_type, ts FROM u QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY l, place) = 1) SELECT event_id, event_type, ts FROM o ORDER BY ts DESC, event_id DESC LIMIT 400")
def merged_event_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last 400 records of a log and of the one it replaced: the newer one's record of an id wins."""
    own = read(spark, sf_dir, "events").select("event_id", "event_type", "ts", F.col("event_id").alias("place"))
    found = sinks.merged_tail([own.where("event_id % 3 <> 0"), own.where("event_id % 2 = 0").withColumn("event_type", F.lit("old"))], "event_id", ["ts", "event_id"], 400)
    return found.select("event_id", "event_type", "ts")


@query("SNK09", "SELECT event_type, least(count(*), 250) AS kept, greatest(count(*) - 250, 0) AS dropped FROM events GROUP BY event_type")
def pruned_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What keeping the newest 250 records of a type would drop."""
    return sinks.pruned(read(spark, sf_dir, "events"), ["event_type"], ["ts", "event_id"], 250)


@query("GRF05", f"""WITH RECURSIVE {EDGES_SQL}, {BOTH_SQL}, walk(node, hop) AS (SELECT * FROM (VALUES ('c7', 0), ('c11', 0)) UNION SELECT b.dst, hop + 1 FROM walk JOIN both_ways b ON b.src = walk.node WHERE hop < 3), lv AS (SELECT node, min(hop) AS hop FROM walk GROUP BY node),
back(node, hop) AS (SELECT * FROM (SELECT node, hop FROM lv WHERE node IN ('s1', 's2', 'r4') ORDER BY hop, node LIMIT 1) UNION ALL SELECT x.node, back.hop - 1 FROM back JOIN LATERAL (SELECT min(lv.node) AS node FROM lv JOIN both_ways b ON b.src = lv.node AND b.dst = back.node WHERE lv.hop = back.hop - 1) x ON x.node IS NOT NULL WHERE back.hop > 0) SELECT hop, node FROM back""")
def graph_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A shortest path from either of two customers to the nearest of three nodes, within three hops."""
    return graph.shortest_path(edges(spark, sf_dir), ["c7", "c11"], ["s1", "s2", "r4"], 3)


COMMIT_SQL = r"(?i)^\s*([a-z][a-z0-9-]*)(?:\(([^)]{1,80})\))?!?:\s*(.+)$"
TASK_SQL = "concat(CASE doc_id % 8 WHEN 5 THEN 'feat(userService): share handoff' WHEN 7 THEN 'Perf(api)!: ' ELSE '' END, " + TASK + ")"


@query("STR02 STR06", rf"""WITH t AS (SELECT doc_id, {TASK_SQL} AS task FROM documents), m AS (SELECT doc_id, CASE WHEN regexp_matches(task, '{COMMIT_SQL}') THEN lower(regexp_extract(task, '{COMMIT_SQL}', 1)) || ' ' || regexp_replace(lower(regexp_replace(regexp_extract(task, '{COMMIT_SQL}', 2), '([a-z0-9])([A-Z])', '\1 \2', 'g')), '[^a-z0-9]+', ' ', 'g') || ' ' || regexp_extract(task, '{COMMIT_SQL}', 3) ELSE task END AS said FROM t),
w AS (SELECT doc_id, list_filter(string_split_regex(lower(said), '[^a-z0-9]+'), lambda x: length(x) >= 3 AND NOT list_contains({STOP_SQL}, x)) AS terms FROM m)
SELECT array_to_string(terms, ' ') AS terms, array_to_string(list_sort(list_distinct(list_transform(range(1, len(terms)), lambda i: terms[i] || ' ' || terms[i + 1]))), '|') AS phrases, count(*) AS n FROM w GROUP BY 1, 2""")
def commit_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms and two-term phrases of tasks, conventional commits among them: kind, scope and subject count."""
    terms = text.task_terms(F.expr(TASK_SQL))
    found = read(spark, sf_dir, "documents").select(F.array_join(terms, " ").alias("terms"), F.array_join(F.array_sort(text.bigrams(terms)), "|").alias("phrases"))
    return found.groupBy("terms", "phrases").agg(F.count("*").alias("n"))
