"""The property graph of the relational tables: walks, projections, diffs and invariants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle.operators import graph
from corpuscle.operators import relational as rel
from corpuscle.plans.registry import query, read

EDGES_SQL = """edges AS (SELECT 'n' || n_nationkey AS src, 'r' || n_regionkey AS dst, 'belongs_to' AS type FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 'belongs_to' FROM customer
UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 'belongs_to' FROM supplier UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey, 'calls' FROM orders
UNION ALL SELECT 'o' || l_orderkey, 'p' || l_partkey, 'imports' FROM lineitem UNION ALL SELECT 'p' || l_partkey, 's' || l_suppkey, 'tested_by' FROM lineitem)"""
BOTH_SQL = "both_ways AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges)"


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, type) with prefixed keys."""
    spec = [("nation", "n", "n_nationkey", "r", "n_regionkey", "belongs_to"), ("customer", "c", "c_custkey", "n", "c_nationkey", "belongs_to"), ("supplier", "s", "s_suppkey", "n", "s_nationkey", "belongs_to"), ("orders", "o", "o_orderkey", "c", "o_custkey", "calls"), ("lineitem", "o", "l_orderkey", "p", "l_partkey", "imports"), ("lineitem", "p", "l_partkey", "s", "l_suppkey", "tested_by")]
    parts = [read(spark, sf_dir, t).select(F.concat(F.lit(a), F.col(k)).alias("src"), F.concat(F.lit(b), F.col(v)).alias("dst"), F.lit(kind).alias("type")) for t, a, k, b, v, kind in spec]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def node(spark: SparkSession, *names: str) -> DataFrame:
    return spark.createDataFrame([(n,) for n in names], "node string")


@query("AGG07", f"WITH {EDGES_SQL} SELECT type, count(*) AS n, count(DISTINCT src) AS sources, count(DISTINCT dst) AS targets, count(*) - count(DISTINCT src || '>' || dst) AS duplicates FROM edges GROUP BY type")
def graph_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges(spark, sf_dir).groupBy("type").agg(F.count("*").alias("n"), F.countDistinct("src").alias("sources"), F.countDistinct("dst").alias("targets"), (F.count("*") - F.countDistinct(F.concat_ws(">", "src", "dst"))).alias("duplicates"))


@query("GRF04 FLT11", f"WITH {EDGES_SQL} SELECT other, type, side, count(*) AS n FROM (SELECT dst AS other, type, 'out' AS side FROM edges WHERE src = 'n7' UNION ALL SELECT src, type, 'in' FROM edges WHERE dst = 'n7') GROUP BY ALL")
def graph_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.neighbors(edges(spark, sf_dir), node(spark, "n7")).groupBy("other", "type", "side").agg(F.count("*").alias("n"))


@query("GRF10 JON10", f"WITH {EDGES_SQL}, {BOTH_SQL}, one AS (SELECT DISTINCT dst AS node FROM both_ways WHERE src = 'c7' AND dst <> 'c7'), two AS (SELECT DISTINCT b.dst AS node FROM both_ways b JOIN one ON b.src = one.node WHERE b.dst <> 'c7' AND b.dst NOT IN (FROM one)) SELECT node, 1 AS hop FROM one UNION ALL SELECT node, 2 FROM two")
def graph_two_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.two_hop(edges(spark, sf_dir), node(spark, "c7"))


LEVELS_SQL = f"WITH RECURSIVE {EDGES_SQL}, {BOTH_SQL}, walk(node, hop) AS (SELECT 'c7', 0 UNION SELECT b.dst, hop + 1 FROM walk JOIN both_ways b ON b.src = walk.node WHERE hop < 4), lv AS (SELECT node, min(hop) AS hop FROM walk GROUP BY node)"


@query("GRF05", f"{LEVELS_SQL} SELECT hop, count(*) AS n FROM lv GROUP BY hop")
def graph_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.bfs(edges(spark, sf_dir), node(spark, "c7"), 4).groupBy("hop").agg(F.count("*").alias("n"))


@query("GRF05", "SELECT * FROM (VALUES (0, 'c7'), (1, 'n' || (SELECT c_nationkey FROM customer WHERE c_custkey = 7)), (2, 'r' || (SELECT n_regionkey FROM nation WHERE n_nationkey = (SELECT c_nationkey FROM customer WHERE c_custkey = 7)))) t(hop, node)")
def graph_shortest_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = read(spark, sf_dir, "customer").where("c_custkey = 7").join(read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).first()
    return graph.shortest_path(edges(spark, sf_dir), "c7", f"r{key['n_regionkey']}")


@query("GRF09", f"WITH RECURSIVE {EDGES_SQL}, walk(node) AS (SELECT 's3' UNION SELECT e.src FROM walk JOIN edges e ON e.dst = walk.node) SELECT node FROM walk")
def graph_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything that depends on a changed node, to the fixpoint."""
    return graph.dependents_closure(edges(spark, sf_dir), node(spark, "s3"))


@query("GRF07 GRF06", f"WITH {EDGES_SQL}, d AS (SELECT DISTINCT src, dst FROM edges WHERE type IN ('imports', 'tested_by')) SELECT src, dst, count(*) OVER (PARTITION BY src) AS degree FROM d")
def dependency_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.adjacency(edges(spark, sf_dir).where("type in ('imports', 'tested_by')"))


@query("GRF08", f"WITH {EDGES_SQL} SELECT type, src, dst, count(*) AS evidence FROM edges WHERE src = 'p11' OR dst = 'p11' GROUP BY ALL ORDER BY type, src, dst LIMIT 100")
def relationship_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = edges(spark, sf_dir).where("src = 'p11' or dst = 'p11'")
    return own.groupBy("type", "src", "dst").agg(F.count("*").alias("evidence")).orderBy("type", "src", "dst").limit(100)


@query("GRF02", "SELECT p_partkey, score FROM (SELECT p_partkey, sum(CASE WHEN lower(p_type) = t THEN 3 WHEN contains(lower(p_name || ' ' || p_type), t) THEN 1 ELSE 0 END) AS score FROM part, (VALUES ('promo'), ('ring'), ('red')) v(t) GROUP BY p_partkey) WHERE score > 0 ORDER BY score DESC, p_partkey LIMIT 20")
def entity_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.lower(F.concat_ws(" ", "p_name", "p_type"))
    terms = ("promo", "ring", "red")
    score = sum((F.when(F.lower("p_type") == t, 3).when(text.contains(t), 1).otherwise(0) for t in terms), F.lit(0)).cast("bigint")
    return read(spark, sf_dir, "part").select("p_partkey", score.alias("score")).where("score > 0").orderBy(F.desc("score"), "p_partkey").limit(20)


@query("JON02", """SELECT coalesce(a.p_partkey, b.p_partkey) AS entity, CASE WHEN a.p_partkey IS NULL THEN 'added' WHEN b.p_partkey IS NULL THEN 'removed' WHEN a.p_type <> b.p_type OR a.p_size <> b.p_size THEN 'changed' ELSE 'same' END AS status
FROM (SELECT * FROM part WHERE p_partkey % 7 <> 0) a FULL JOIN (SELECT p_partkey, p_type, CASE WHEN p_partkey % 11 = 0 THEN p_size + 1 ELSE p_size END AS p_size FROM part WHERE p_partkey % 5 <> 0) b ON a.p_partkey = b.p_partkey""")
def entity_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part").select("p_partkey", "p_type", "p_size")
    a = part.where("p_partkey % 7 <> 0").select(F.col("p_partkey").alias("a"), F.struct("p_type", "p_size").alias("va"))
    b = part.where("p_partkey % 5 <> 0").withColumn("p_size", F.when(F.col("p_partkey") % 11 == 0, F.col("p_size") + 1).otherwise(F.col("p_size"))).select(F.col("p_partkey").alias("b"), F.struct("p_type", "p_size").alias("vb"))
    status = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("va") != F.col("vb"), "changed").otherwise("same")
    return a.join(b, F.col("a") == F.col("b"), "full_outer").select(F.coalesce("a", "b").alias("entity"), status.alias("status"))


SIDES_SQL = "r AS (SELECT p_partkey AS k, p_brand, p_type, p_size FROM part WHERE p_partkey % 2 = 0), a AS (SELECT p_partkey AS k, p_brand, p_type, p_size FROM part WHERE p_partkey % 2 = 1)"
IDENTITY = ["p_brand", "p_type", "p_size"]


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    part = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), *IDENTITY)
    return part.where("k % 2 = 0"), part.where("k % 2 = 1")


@query("JON03", f"WITH {SIDES_SQL}, x AS (SELECT p_brand, p_type, p_size, min(k) AS before FROM r GROUP BY ALL HAVING count(*) = 1), y AS (SELECT p_brand, p_type, p_size, min(k) AS after FROM a GROUP BY ALL HAVING count(*) = 1) SELECT before, after FROM x JOIN y USING (p_brand, p_type, p_size)")
def unique_alias_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.unique_matches(*_sides(spark, sf_dir), IDENTITY, "k").select("before", "after")


@query("JON03", f"WITH {SIDES_SQL}, x AS (SELECT *, count(*) OVER w AS n, row_number() OVER (w ORDER BY k) AS i FROM r WINDOW w AS (PARTITION BY p_brand, p_type)), y AS (SELECT *, count(*) OVER w AS n, row_number() OVER (w ORDER BY k) AS i FROM a WINDOW w AS (PARTITION BY p_brand, p_type)) SELECT x.k AS before, y.k AS after FROM x JOIN y USING (p_brand, p_type) WHERE x.i <= 10 AND y.i <= 10 AND NOT (x.n = 1 AND y.n = 1)")
def ambiguous_alias_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.ambiguous_matches(*_sides(spark, sf_dir), IDENTITY[:2], "k").select("before", "after")


@query("JON18", "SELECT p_partkey FROM part WHERE p_partkey % 11 = 0 AND NOT EXISTS (FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'R' AND l_orderkey % 17 = 0)")
def invariant_require_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changed entities without a test: an anti join."""
    tested = read(spark, sf_dir, "lineitem").where("l_returnflag = 'R' and l_orderkey % 17 = 0").select(F.col("l_partkey").alias("p_partkey"))
    return read(spark, sf_dir, "part").where("p_partkey % 11 = 0").select("p_partkey").join(tested, "p_partkey", "left_anti")


@query("JON18", "WITH c AS (SELECT l_partkey, count(DISTINCT l_orderkey) AS importers, count(DISTINCT l_orderkey) FILTER (WHERE l_orderkey % 13 = 0) AS updated FROM lineitem WHERE l_partkey % 11 = 0 GROUP BY l_partkey) SELECT l_partkey, importers FROM c WHERE updated = 0")
def invariant_consumer_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = F.when(F.col("l_orderkey") % 13 == 0, F.col("l_orderkey"))
    per = read(spark, sf_dir, "lineitem").where("l_partkey % 11 = 0").groupBy("l_partkey").agg(F.countDistinct("l_orderkey").alias("importers"), F.countDistinct(changed).alias("updated"))
    return per.where("updated = 0").select("l_partkey", "importers")


@query("JON18", "SELECT l_orderkey, l_partkey, l_suppkey FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 2")
def forbid_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    banned = read(spark, sf_dir, "supplier").join(read(spark, sf_dir, "nation").where("n_regionkey = 2"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("l_suppkey"))
    return read(spark, sf_dir, "lineitem").join(banned, "l_suppkey").select("l_orderkey", "l_partkey", "l_suppkey")


@query("JON09 JON15", """WITH seeds AS (SELECT p_partkey AS seed, p_retailprice AS score FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 8), e AS (SELECT DISTINCT l_orderkey AS a, l_partkey AS p FROM lineitem)
SELECT e2.p AS path, max(s.score) AS best, arg_max(s.seed, (s.score, -s.seed)) AS seed, CAST(least(24, 8 + 4 * count(DISTINCT s.seed)) AS BIGINT) AS bonus FROM seeds s JOIN e e1 ON e1.p = s.seed JOIN e e2 ON e2.a = e1.a AND e2.p <> s.seed GROUP BY e2.p""")
def neighbor_boosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight seeds, broadcast, give each neighbour the boost of its best seed."""
    seeds = read(spark, sf_dir, "part").orderBy(F.desc("p_retailprice"), "p_partkey").limit(8).select(F.col("p_partkey").alias("seed"), F.col("p_retailprice").alias("score"))
    e = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("a"), F.col("l_partkey").alias("path")).distinct()
    reached = e.join(F.broadcast(seeds), F.col("path") == F.col("seed")).select("a", "seed", "score")
    hit = e.join(reached, "a").where("path <> seed")
    return hit.groupBy("path").agg(F.max("score").alias("best"), F.max_by("seed", F.struct("score", -F.col("seed"))).alias("seed"), F.expr("cast(least(24, 8 + 4 * count(distinct seed)) as bigint)").alias("bonus"))


@query("JON23", "WITH d AS (SELECT l_partkey AS k, count(DISTINCT l_orderkey) AS fan_in, count(DISTINCT l_suppkey) AS fan_out FROM lineitem GROUP BY 1), s AS (SELECT p_partkey, CAST(CASE WHEN fan_in > 30 THEN 3 ELSE 0 END + CASE WHEN fan_out > 10 THEN 2 ELSE 0 END + CASE WHEN p_size > 25 THEN 1 ELSE 0 END AS BIGINT) AS risk FROM part LEFT JOIN d ON k = p_partkey) SELECT risk, count(*) AS n FROM s GROUP BY risk")
def task_map_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    degree = read(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.countDistinct("l_orderkey").alias("fan_in"), F.countDistinct("l_suppkey").alias("fan_out"))
    points = F.when(F.col("fan_in") > 30, 3).otherwise(0) + F.when(F.col("fan_out") > 10, 2).otherwise(0) + F.when(F.col("p_size") > 25, 1).otherwise(0)
    return read(spark, sf_dir, "part").join(degree, "p_partkey", "left").groupBy(points.cast("bigint").alias("risk")).agg(F.count("*").alias("n"))


@query("STR18", """WITH a AS (SELECT l_orderkey AS k, l_linenumber * 4 AS s, l_linenumber * 4 + l_partkey % 9 AS e FROM lineitem), w AS (SELECT *, max(e) OVER (PARTITION BY k ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM a),
i AS (SELECT *, sum(CASE WHEN s <= reach + 2 THEN 0 ELSE 1 END) OVER (PARTITION BY k ORDER BY s, e) AS island FROM w) SELECT k, min(s) AS s, max(e) AS e FROM i GROUP BY k, island""")
def merged_line_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), (F.col("l_linenumber") * 4).cast("bigint").alias("s"), (F.col("l_linenumber") * 4 + F.col("l_partkey") % 9).alias("e"))
    return rel.merge_intervals(spans, ["k"], "s", "e", 2)


@query("SET03", """WITH a AS (SELECT l_partkey AS p, min(l_shipdate) AS m FROM lineitem WHERE l_orderkey % 2 = 0 GROUP BY 1), b AS (SELECT l_partkey AS p, min(l_shipdate) AS m FROM lineitem WHERE l_orderkey % 2 = 1 GROUP BY 1)
SELECT CASE WHEN a.p IS NULL THEN 'added' WHEN b.p IS NULL THEN 'removed' WHEN a.m <> b.m THEN 'mode_changed' ELSE 'same' END AS status, count(*) AS n FROM a FULL JOIN b USING (p) GROUP BY 1""")
def selection_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = lambda r: read(spark, sf_dir, "lineitem").where(F.col("l_orderkey") % 2 == r).groupBy(F.col("l_partkey").alias("p")).agg(F.min("l_shipdate").alias("m"))
    diff = rel.keyed_diff(side(0), side(1), "p", "m")
    named = F.when(F.col("status") == "deleted", "removed").when(F.col("status") == "modified", "mode_changed").when(F.col("status") == "unchanged", "same").otherwise(F.col("status"))
    return diff.groupBy(named.alias("status")).agg(F.count("*").alias("n"))
