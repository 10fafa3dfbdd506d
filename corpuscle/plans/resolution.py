"""Targets of references by the resolution cascade, and upkeep of a view through stale files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle.operators import architecture as arch
from corpuscle.operators import resolution
from corpuscle.plans.registry import query, read

#: In both engines: files and symbols are parts, references are lines, aliases are suppliers.
FILE = "'src/pkg' || CAST({k} % 23 AS STRING) || '/mod' || CAST({k} % 211 AS STRING) || CASE WHEN {k} % 41 = 0 THEN '/__init__.py' ELSE '.py' END"
QUALIFIED = "CASE p_partkey % 4 WHEN 0 THEN 'C' || CAST(p_partkey % 50 AS STRING) || '.m' || CAST(p_size AS STRING) WHEN 1 THEN 'f' || CAST(p_partkey AS STRING) WHEN 2 THEN 'Outer.C' || CAST(p_partkey % 50 AS STRING) || '.m' || CAST(p_size AS STRING) ELSE 'm' || CAST(p_size AS STRING) END"
DISPLAY = "CASE p_partkey % 4 WHEN 1 THEN 'f' || CAST(p_partkey AS STRING) ELSE 'm' || CAST(p_size AS STRING) END"
NAME = """CASE l_orderkey % 9 WHEN 0 THEN 'm' || CAST(l_linenumber * 7 AS STRING) WHEN 1 THEN 'C' || CAST(l_partkey % 50 AS STRING) || '.m' || CAST(l_linenumber * 7 AS STRING) WHEN 2 THEN 'extends f' || CAST(l_partkey AS STRING) || '<T>'
 WHEN 3 THEN '.mod' || CAST(l_partkey % 211 AS STRING) WHEN 4 THEN 'src.pkg' || CAST(l_partkey % 23 AS STRING) || '.mod' || CAST(l_partkey % 211 AS STRING) WHEN 5 THEN 'np.f' || CAST(l_partkey AS STRING) WHEN 6 THEN 'np.lib::f' || CAST(l_partkey AS STRING)
 WHEN 7 THEN 'mod' || CAST(l_partkey % 211 AS STRING) ELSE '"gone' || CAST(l_suppkey AS STRING) || '"' END"""
RELATION = "CASE WHEN l_orderkey % 9 IN (3, 4, 7) THEN 'imports' ELSE 'calls' END"
SCOPE = "CASE WHEN l_partkey % 3 = 0 THEN 'C' || CAST(l_partkey % 50 AS STRING) || '.m1' END"
_EXT = "['', '.py', '.js', '.ts', '.tsx', '.go', '.rs', '.java', '.kt', '.rb', '.php', '/__init__.py', '/index.ts', '/index.js']"

RESOLVE_SQL = rf"""files AS (SELECT DISTINCT {FILE.format(k='p_partkey')} AS path FROM part), sym AS (SELECT p_partkey AS e, {FILE.format(k='p_partkey')} AS path, {DISPLAY} AS d, {QUALIFIED} AS q FROM part),
rel AS (SELECT DISTINCT {FILE.format(k='l_partkey')} AS path, {SCOPE} AS scope, {RELATION} AS relation, {NAME} AS name FROM lineitem),
al AS (SELECT {FILE.format(k='s_suppkey')} AS path, 'np' AS alias, min('x' || CAST(s_suppkey % 3 AS VARCHAR)) AS original FROM supplier GROUP BY 1 UNION ALL SELECT {FILE.format(k='s_suppkey')}, 'np.lib', min('m1') FROM supplier GROUP BY 1),
a AS (SELECT *, trim(string_split(replace(trim(regexp_replace(trim(trim(name), '"'), '^(?:extends|implements|super|trait)\s+', '')), '::', '.'), '<')[1]) AS raw FROM rel),
r AS (SELECT a.*, coalesce((SELECT arg_max(al.original || substr(a.raw, length(al.alias) + 1), length(al.alias)) FROM al WHERE al.path = a.path AND (a.raw = al.alias OR starts_with(a.raw, al.alias || '.'))), a.raw) AS nm FROM a),
fk AS (SELECT DISTINCT path AS e, unnest([path, replace(regexp_replace(path, '\.py$', ''), '/', '.'), regexp_extract(regexp_replace(path, '\.py$', ''), '[^/]*$'), CASE WHEN ends_with(path, '/__init__.py') THEN replace(path, '/__init__.py', '') END]) AS key FROM files),
cand AS (SELECT *, CASE WHEN starts_with(nm, '.') THEN regexp_extract(path, '^(.*)/[^/]*$', 1) || '/' || ltrim(nm, '.') ELSE nm END AS v FROM r WHERE relation = 'imports'),
hits AS (
  SELECT path, scope, relation, name, 0 AS stage, CAST(e AS VARCHAR) AS e FROM r JOIN sym USING (path) WHERE contains(scope, '.') AND NOT contains(raw, '.') AND q = regexp_replace(scope, '\.[^.]*$', '') || '.' || raw
  UNION ALL SELECT path, scope, relation, name, 1, CAST(e AS VARCHAR) FROM r JOIN sym USING (path) WHERE d = raw OR q = raw OR ends_with(q, '.' || raw)
  UNION ALL SELECT path, scope, relation, name, 2, fk.e FROM (SELECT *, unnest(list_distinct(list_concat([nm, v], list_transform({_EXT}, lambda x: replace(v, '.', '/') || x)))) AS key FROM cand) JOIN fk USING (key)
  UNION ALL SELECT path, scope, relation, name, 5, CAST(e AS VARCHAR) FROM r JOIN (SELECT e, d AS n FROM sym UNION SELECT e, q FROM sym) ON n = nm WHERE relation <> 'imports'
  UNION ALL SELECT path, scope, relation, name, 6, CAST(e AS VARCHAR) FROM r JOIN (SELECT e, d AS n FROM sym UNION SELECT e, q FROM sym) ON n = regexp_extract(nm, '[^.]*$') WHERE relation <> 'imports'
  UNION ALL SELECT path, scope, relation, name, 7, CAST(e AS VARCHAR) FROM r JOIN (SELECT e, array_to_string(string_split(q, '.')[i:], '.') AS n FROM sym, range(2, 5) t(i) WHERE len(string_split(q, '.')) >= i) ON n = nm WHERE relation <> 'imports'),
per AS (SELECT path, scope, relation, name, stage, min(e) AS low, max(e) AS high FROM hits GROUP BY path, scope, relation, name, stage),
top AS (SELECT * FROM per QUALIFY row_number() OVER (PARTITION BY path, scope, relation, name ORDER BY stage) = 1)
SELECT r.path, r.scope, r.relation, r.name, CAST(stage AS INTEGER) AS stage, CASE WHEN low IS NULL THEN 'unresolved' WHEN low <> high THEN 'ambiguous' WHEN stage < 2 THEN 'resolved_same_file' ELSE 'resolved' END AS resolution, CASE WHEN low = high THEN low END AS target
FROM r LEFT JOIN top ON r.path = top.path AND r.relation = top.relation AND r.name = top.name AND r.scope IS NOT DISTINCT FROM top.scope"""


@query("JON05 JON06", f"WITH {RESOLVE_SQL}")
def target_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every reference of a line, resolved to a file or a symbol by the first stage of the cascade that knows it."""
    part, line, supplier = (read(spark, sf_dir, t) for t in ("part", "lineitem", "supplier"))
    path = lambda k: F.expr(FILE.format(k=k))
    relations = line.select(path("l_partkey").alias("path"), F.expr(SCOPE).alias("scope"), F.expr(RELATION).alias("relation"), F.expr(NAME).alias("name")).distinct()
    symbols = part.select(F.col("p_partkey").cast("string").alias("entity"), path("p_partkey").alias("path"), F.expr(DISPLAY).alias("display"), F.expr(QUALIFIED).alias("qualified"))
    files = part.select(path("p_partkey").alias("path")).distinct().withColumn("entity", F.col("path"))
    named = lambda alias, original: supplier.select(path("s_suppkey").alias("path"), F.lit(alias).alias("alias"), original.alias("original"))
    aliases = named("np", F.concat(F.lit("x"), (F.col("s_suppkey") % 3).cast("string"))).unionByName(named("np.lib", F.lit("m1")))
    return resolution.resolve(relations, symbols, files, aliases).select("path", "scope", "relation", "name", "stage", "resolution", "target")


STALE_SQL = """imp AS (SELECT DISTINCT l_partkey AS k, l_suppkey AS dep FROM lineitem WHERE l_linenumber = 7 AND l_quantity <= 10), chg AS (SELECT p_partkey AS k FROM part WHERE p_partkey % 40 = 3 OR p_partkey % 400 = 7),
aff(k) AS (SELECT k FROM chg UNION SELECT imp.k FROM aff JOIN imp ON imp.dep = aff.k JOIN part ON p_partkey = imp.k)"""


@query("STM02", f"""WITH RECURSIVE {STALE_SQL}, cold AS (SELECT (SELECT count(*) FROM aff) > 0.4 * (SELECT count(*) FROM part WHERE p_partkey % 400 <> 7) AS cold),
v AS (SELECT p_partkey AS key, p_size + CASE WHEN p_partkey % 40 = 3 THEN 1 ELSE 0 END AS size, (SELECT count(*) FROM imp WHERE imp.k = p_partkey) AS n_imports FROM part WHERE p_partkey % 400 <> 7)
SELECT 'p' || CAST(key AS VARCHAR) AS key, CAST(size AS BIGINT) AS size, n_imports, CASE WHEN cold OR key IN (SELECT k FROM aff) THEN 2 ELSE 1 END AS build FROM v, cold""")
def maintained_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of parts after some changed and some went; each row tells in which build it was made, so a rebuild of all would differ.

    A part imports the namesake part of the supplier of its small seventh lines. Rows of changed
    files and of those that import them, directly or not, are of build 2.
    """
    part = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("path"), "p_size")
    name = lambda c: F.concat(F.lit("p"), F.col(c).cast("string"))
    edges = read(spark, sf_dir, "lineitem").where("l_linenumber = 7 and l_quantity <= 10").select(name("l_partkey").alias("path"), name("l_suppkey").alias("import")).groupBy("path").agg(F.collect_set("import").alias("imports"))  # at most a few lines of a part
    was = part.join(edges, "path", "left")
    now = was.where("k % 400 <> 7").withColumn("p_size", F.when(F.col("k") % 40 == 3, F.col("p_size") + 1).otherwise(F.col("p_size")))
    none = F.array().cast("array<string>")
    manifest = lambda df: df.select("path", F.xxhash64("p_size").alias("hash"), none.alias("symbols"), F.coalesce("imports", none).alias("imports"), none.alias("targets"))

    def build(df: DataFrame, number: int) -> DataFrame:
        return df.select(F.col("path").alias("key"), F.col("p_size").cast("bigint").alias("size"), F.coalesce(F.size("imports"), F.lit(0)).cast("bigint").alias("n_imports"), F.lit(number).alias("build"))

    before, after = manifest(was), manifest(now)
    stale = resolution.stale_files(before, after).select(F.col("path").alias("key"))
    hashed = lambda df: df.select(F.col("path").alias("key"), "hash")
    return arch.maintain(build(was, 1), hashed(before), hashed(after), lambda changed: stale, lambda keys: build(now if keys is None else now.join(keys.withColumnRenamed("key", "path"), "path", "left_semi"), 2))[0]
