"""The property graph built from records: owners, resolution, quality, change maps and upkeep."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle.operators import architecture as arch
from corpuscle.plans.registry import query, read
from corpuscle.shared import parts_for

TYPE_SQL = "CASE o_orderstatus WHEN 'F' THEN 'module' WHEN 'O' THEN 'config' ELSE 'symbol' END"


@query("JON19", f"""WITH e AS (SELECT 'o' || o_orderkey AS key, {TYPE_SQL} AS kind FROM orders), fl AS (SELECT key FROM e WHERE kind <> 'symbol'),
c AS (SELECT 'o' || l_orderkey AS src, CASE WHEN l_partkey % 10 = 0 THEN 'o' || l_partkey ELSE 'p' || l_partkey END AS dst, l_shipdate AS d, l_orderkey AS k FROM lineitem WHERE l_returnflag <> 'R')
SELECT key, key AS owner FROM fl UNION ALL SELECT dst, arg_min(src, (d, k)) FROM c JOIN fl ON src = fl.key WHERE dst NOT IN (FROM fl) GROUP BY dst""")
def file_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders are files or symbols; a line contains its part, or for every tenth part an order."""
    key = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    entities = read(spark, sf_dir, "orders").select(key("o", "o_orderkey").alias("key"), F.expr(TYPE_SQL).alias("kind"))
    dst = F.when(F.col("l_partkey") % 10 == 0, key("o", "l_partkey")).otherwise(key("p", "l_partkey"))
    kind = F.when(F.col("l_returnflag") == "R", "calls").otherwise("contains")
    edges = read(spark, sf_dir, "lineitem").select(key("o", "l_orderkey").alias("src"), dst.alias("dst"), kind.alias("type"), F.struct("l_shipdate", "l_orderkey").alias("place"))
    return arch.file_owners(entities, edges)


NAMES_SQL = """own AS (SELECT DISTINCT kind, name, path, sha256('repo|' || kind || '|' || name || '|' || path) AS key FROM (SELECT 'module' AS kind, 'm' || o_custkey AS name, 'src/' || o_orderkey || '.py' AS path FROM orders)),
refs AS (SELECT DISTINCT 'module' AS kind, 'm' || o_custkey AS name, 'src/' || o_orderkey || '.py' AS path, 'm' || l_partkey AS target, 'l' || l_linenumber AS anchor, l_shipdate || ':' || l_suppkey AS place FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
ix AS (SELECT name AS target, count(*) AS same, min(key) AS one_key FROM own GROUP BY 1), hit AS (SELECT refs.*, CASE WHEN same IS NULL THEN 'unresolved' WHEN same > 1 THEN 'ambiguous' ELSE 'resolved' END AS resolution, one_key FROM refs LEFT JOIN ix USING (target)),
full_ AS (SELECT sha256('repo|' || kind || '|' || name || '|' || path) AS src, CASE resolution WHEN 'resolved' THEN one_key ELSE sha256('repo|' || resolution || '|' || target || '|') END AS dst, 'imports' AS type, resolution, anchor, place, target FROM hit)"""


def _graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    text = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    orders, lines = read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem")
    own = [F.lit("module").alias("kind"), text("m", "o_custkey").alias("name"), F.concat(text("src/", "o_orderkey"), F.lit(".py")).alias("path")]
    target = text("m", "l_partkey").alias("target")
    place = F.concat_ws(":", F.col("l_shipdate").cast("string"), F.col("l_suppkey").cast("string")).alias("place")
    numbers = lines.select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey", "l_linenumber", "l_shipdate", "l_suppkey")
    parts = parts_for(spark, numbers)
    # lines are shuffled as numbers and become texts after that
    both = numbers.repartition(parts, "o_orderkey").join(orders.select("o_orderkey", "o_custkey").repartition(parts, "o_orderkey"), "o_orderkey")
    finish = lambda rows: rows.select(*own, "target", F.lit("imports").alias("type"), text("l", "l_linenumber").alias("anchor"), place)
    return arch.build_graph(orders.select(*own), both.withColumn("target", target).drop("l_partkey"), "repo", lines.select(target), parts, finish)


@query("GRF01", f"WITH {NAMES_SQL}, k AS (SELECT *, sha256(src || '|' || type || '|' || dst || '|' || anchor) AS edge_key FROM full_) SELECT edge_key, src, dst, type, resolution, max(place) AS place FROM k GROUP BY ALL")
def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines refer to the module of a customer's order by name: one has it, several do, or none does."""
    return _graph(spark, sf_dir)[1]


@query("GRF01", f"WITH {NAMES_SQL} SELECT key, kind, name, path FROM own UNION ALL SELECT DISTINCT dst, resolution, target, '' FROM full_ WHERE resolution <> 'resolved'")
def graph_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graph(spark, sf_dir)[0]


@query("GRF03", """WITH a(asked) AS (VALUES ('Brand#12'), ('SMALL ring'), ('promo Red'), ('part17'), ('nothing')), e AS (SELECT p_partkey AS key, p_type AS kind, lower(p_name) AS display, lower('part' || p_partkey) AS n0, lower(p_brand) AS n1, lower(p_type) AS n2 FROM part),
x AS (SELECT DISTINCT asked, key FROM a JOIN e ON lower(asked) IN (display, n0, n1, n2)), t AS (SELECT asked, unnest(string_split(lower(asked), ' ')) AS term FROM a WHERE asked NOT IN (SELECT asked FROM x)),
h AS (SELECT asked, key, kind, display, sum(CASE WHEN term = display THEN 3 ELSE 1 END) AS score FROM e JOIN t ON contains(display || ' ' || n0 || ' ' || n1 || ' ' || n2, term) GROUP BY ALL)
SELECT asked, key, true AS exact FROM x UNION ALL SELECT asked, key, false FROM (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY asked ORDER BY score DESC, kind, display, key) <= 20)""")
def resolved_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part").select("p_partkey", "p_name", F.concat(F.lit("part"), F.col("p_partkey").cast("string")).alias("id"), "p_brand", "p_type")
    asked = spark.createDataFrame([(n,) for n in ("Brand#12", "SMALL ring", "promo Red", "part17", "nothing")], "asked string")
    return arch.resolve_names(part, "p_partkey", ["p_name", "id", "p_brand", "p_type"], "p_type", "p_name", asked)


SPAN = "l_orderkey AS src, CASE WHEN l_returnflag = 'R' THEN 'calls' ELSE 'imports' END AS type, l_partkey AS dst, l_linestatus AS path"


@query("GRF12", f"""WITH f AS (SELECT {SPAN}, l_linenumber * 4 AS s, CASE WHEN l_suppkey % 3 = 0 THEN l_linenumber * 4 ELSE l_linenumber * 4 + 2 END AS e FROM lineitem WHERE l_orderkey % 5 <> 0), w AS (SELECT {SPAN}, l_linenumber * 4 + l_suppkey % 4 AS s FROM lineitem WHERE l_orderkey % 3 <> 0 AND l_returnflag <> 'R'),
l AS (SELECT * FROM f WHERE type IN (SELECT type FROM w)), a AS (SELECT DISTINCT src, type, dst FROM l), b AS (SELECT DISTINCT src, type, dst FROM w), r AS (SELECT count(*) AS n FROM a JOIN b USING (src, type, dst)),
g AS (SELECT count(*) AS n FROM w WHERE EXISTS (FROM l WHERE l.src = w.src AND l.type = w.type AND l.dst = w.dst AND l.path = w.path AND l.e >= w.s AND l.s <= w.s)) SELECT r.n / (SELECT count(*) FROM a) AS precision, r.n / (SELECT count(*) FROM b) AS recall, g.n / r.n AS grounding FROM r, g""")
def relationship_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem")
    cols = ["l_orderkey as src", "case when l_returnflag = 'R' then 'calls' else 'imports' end as type", "l_partkey as dst", "l_linestatus as path"]
    found = lines.where("l_orderkey % 5 <> 0").selectExpr(*cols, "l_linenumber * 4 as start", "case when l_suppkey % 3 = 0 then null else l_linenumber * 4 + 2 end as end")
    wanted = lines.where("l_orderkey % 3 <> 0 and l_returnflag <> 'R'").selectExpr(*cols, "l_linenumber * 4 + l_suppkey % 4 as start", "cast(null as bigint) as end")
    return arch.relation_quality(found, wanted)


MAP_SQL = """b AS (SELECT 'p' || p_partkey AS key, p_brand AS domain, p_type AS path, CAST(p_size AS BIGINT) AS hash FROM part WHERE p_partkey % 17 <> 0 UNION ALL SELECT 's' || s_suppkey, 'supply', 's', 0 FROM supplier),
h AS (SELECT 'p' || p_partkey AS key, p_brand AS domain, p_type AS path, p_size + CASE WHEN p_partkey % 11 = 0 THEN 1 ELSE 0 END AS hash FROM part WHERE p_partkey % 13 <> 0 UNION ALL SELECT 's' || s_suppkey, 'supply', 's', 0 FROM supplier),
k AS (SELECT coalesce(b.key, h.key) AS key, coalesce(h.domain, b.domain) AS domain, coalesce(h.path, b.path) AS path, CASE WHEN b.key IS NULL THEN 0 WHEN h.key IS NULL THEN 1 WHEN b.hash <> h.hash THEN 2 END AS level FROM b FULL JOIN h ON b.key = h.key),
be AS (SELECT DISTINCT 'p' || l_partkey AS src, 's' || l_suppkey AS dst FROM lineitem WHERE l_orderkey % 97 <> 1), he AS (SELECT DISTINCT 'p' || l_partkey AS src, 's' || l_suppkey AS dst FROM lineitem WHERE l_orderkey % 97 <> 2),
mv AS (SELECT src, dst, 'added' AS status, 0 AS turn FROM (FROM he EXCEPT FROM be) UNION ALL SELECT src, dst, 'removed', 1 FROM (FROM be EXCEPT FROM he)),
al AS (SELECT 'p' || p_partkey AS before, 'p' || (p_partkey + 2) AS after, CASE WHEN p_partkey % 2 = 0 THEN 'confirmed' ELSE 'ambiguous' END AS status FROM part WHERE p_partkey % 101 = 5),
mk AS (SELECT key, level FROM k WHERE level IS NOT NULL UNION ALL SELECT unnest([before, after]), CASE status WHEN 'confirmed' THEN 3 ELSE 4 END FROM al UNION ALL SELECT unnest([src, dst]), 5 FROM mv),
nodes AS (SELECT k.key, domain, path, ['added', 'removed', 'changed', 'alias', 'ambiguous', 'context'][CAST(min(mk.level) AS INT) + 1] AS status FROM mk JOIN k USING (key) GROUP BY ALL ORDER BY domain, path, key LIMIT 500)"""


def _map(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    part, supply = read(spark, sf_dir, "part"), read(spark, sf_dir, "supplier").selectExpr("concat('s', s_suppkey) as key", "'supply' as domain", "'s' as path", "0L as hash")
    side = lambda own, size: own.selectExpr("concat('p', p_partkey) as key", "p_brand as domain", "p_type as path", f"cast({size} as bigint) as hash").unionByName(supply)
    links = lambda cond: read(spark, sf_dir, "lineitem").where(cond).selectExpr("concat('p', l_partkey) as src", "concat('s', l_suppkey) as dst", "'tested_by' as type")
    aliases = part.where("p_partkey % 101 = 5").selectExpr("concat('p', p_partkey) as before", "concat('p', p_partkey + 2) as after", "case when p_partkey % 2 = 0 then 'confirmed' else 'ambiguous' end as status")
    return arch.diff_map(side(part.where("p_partkey % 17 <> 0"), "p_size"), side(part.where("p_partkey % 13 <> 0"), "p_size + case when p_partkey % 11 = 0 then 1 else 0 end"), links("l_orderkey % 97 <> 1"), links("l_orderkey % 97 <> 2"), aliases)


@query("JON24", f"WITH {MAP_SQL} SELECT * FROM nodes")
def change_map_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two states of the parts and of who supplies them."""
    return _map(spark, sf_dir)[0]


@query("JON24", f"WITH {MAP_SQL}, l AS (SELECT src, dst, 'tested_by' AS type, status, turn FROM mv UNION ALL SELECT before, after, 'alias', status, 2 FROM al) SELECT src, dst, type, status FROM l WHERE src IN (SELECT key FROM nodes) AND dst IN (SELECT key FROM nodes) ORDER BY turn, src, dst, type LIMIT 1000")
def change_map_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _map(spark, sf_dir)[1]


@query("STM02", "SELECT l_partkey AS key, count(*) AS lines, sum(l_quantity) AS quantity FROM lineitem GROUP BY l_partkey")
def maintained_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of a part, brought up to date after a tenth of the orders changed; equal to a view built anew."""
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("key"), "l_orderkey", "l_quantity")
    rolled = lambda df: df.groupBy("key").agg(F.count("*").alias("lines"), F.sum("l_quantity").alias("quantity"))
    was = lines.withColumn("l_quantity", F.when(F.col("key") % 10 == 3, F.col("l_quantity") + 1).otherwise(F.col("l_quantity"))).where("key % 40 <> 7")
    manifest = lambda df: df.groupBy("key").agg(F.sum(F.xxhash64("l_orderkey", "l_quantity").cast("decimal(38,0)")).alias("hash"))
    build = lambda keys: rolled(lines if keys is None else lines.join(keys, "key", "left_semi"))
    return arch.maintain(rolled(was), manifest(was), manifest(lines), lambda changed: changed, build)[0]
