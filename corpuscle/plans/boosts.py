"""The whole chain of boosts over the documents of each source."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle.operators import boosts
from corpuscle.operators.related import ENTRYPOINT_ROLES, IMPLEMENTATION_ROLES, NOISE
from corpuscle.plans.corpus import WORDS_SQL
from corpuscle.plans.registry import query, read
from corpuscle.shared import cut

#: The same expressions in both engines: a path of its own for each document, and what is known of it.
FOLDER = "CASE doc_id % 12 WHEN 0 THEN 'src/core' WHEN 1 THEN 'tests/unit' WHEN 2 THEN 'docs/guide' WHEN 3 THEN 'src/pages' WHEN 4 THEN 'tests/web' WHEN 5 THEN 'packages/web' WHEN 6 THEN 'src/services' WHEN 7 THEN 'services/api' WHEN 8 THEN 'config' WHEN 9 THEN 'src/models' WHEN 10 THEN 'apps/admin/api' ELSE 'lib' END"
FILE_NAME = "concat(CASE WHEN doc_id % 12 IN (1, 4) THEN 'test_' ELSE '' END, CASE doc_id % 5 WHEN 0 THEN 'item' WHEN 1 THEN 'main' WHEN 2 THEN 'settingsConfig' WHEN 3 THEN 'userService' ELSE 'orderIndex' END, CAST(doc_id % 30 AS STRING), CASE doc_id % 7 WHEN 0 THEN '.toml' WHEN 1 THEN '.md' WHEN 2 THEN '.conf' ELSE '.py' END)"
PLACE = f"concat({FOLDER}, '/d', CAST(CAST(floor(doc_id / 30) AS BIGINT) AS STRING), '/', {FILE_NAME})"
WORKSPACE = "CASE doc_id % 12 WHEN 5 THEN 'packages/web' WHEN 7 THEN 'services/api' WHEN 10 THEN 'apps/admin' WHEN 11 THEN 'lib' END"
API_PATH = "CASE WHEN doc_id % 12 IN (7, 10) THEN concat('/api/v', CAST(doc_id % 13 AS STRING), CASE WHEN doc_id % 2 = 0 THEN '/order' ELSE '/plain' END) END"
CALLED = ["concat('/api/v', CAST(doc_id % 13 AS STRING), '/order')", "concat('/api/v', CAST(doc_id % 11 AS STRING), '/plain')"]
SCORE = "CAST(doc_id * 37 % 131 AS DOUBLE)"
REASONS = "CASE doc_id % 8 WHEN 0 THEN 'modified' WHEN 1 THEN 'filename keyword match' WHEN 2 THEN 'symbol keyword match' WHEN 3 THEN 'matched define: f' WHEN 4 THEN 'API route owner match: x' WHEN 5 THEN 'config file' ELSE 'other' END"
CHANGED, SKIPPED, CLIENT = "doc_id % 29 = 0", "doc_id % 31 = 1", "doc_id % 6 = 3"
KEYWORDS, WORDS = ["order", "user", "item", "api"], ["admin"]
RATIO = "CASE WHEN right(source, 1) IN ('0', '2', '4') THEN 0.5 ELSE 0.1 END"
STEPS = [(1, "'imports'"), (5, "'calls'"), (12, "'imports'")]


def _sql(values: Sequence[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _oracle() -> str:
    w = boosts.Weights()
    tokens = WORDS_SQL.replace("text", r"regexp_replace(path, '([^/])\.[^./]*$', '\1')", 1)
    starts = lambda values: "list_bool_or(list_transform(reasons, lambda r: " + " OR ".join(f"starts_with(r, '{v}')" for v in values) + "))"
    keys = [k for k in KEYWORDS if k not in NOISE]
    apply = lambda n, zero=False: f"r{n} AS (SELECT r.* REPLACE (" + ("CASE WHEN reason IS NULL THEN score WHEN amount IS NULL THEN 0 ELSE greatest(0, score + amount) END" if zero else "score + coalesce(amount, 0)") + f" AS score, CASE WHEN reason IS NULL THEN reasons ELSE list_append(reasons, reason) END AS reasons) FROM r{n - 1} r LEFT JOIN b{n} USING (g, path))"
    edges = " UNION ALL ".join(f"SELECT a.source AS g, a.path AS src, b.path AS dst, {kind} AS type, 'e' || lpad(CAST(a.doc_id AS VARCHAR), 12, '0') || '{n}' AS edge_key FROM d a JOIN d b ON b.source = a.source AND b.doc_id = a.doc_id + {n}" for n, kind in STEPS)
    route = rf"list_distinct(list_filter(flatten(list_transform(list_filter(string_split(regexp_extract('/' || lower(path), '/api/(.*)$', 1), '/'), lambda p: p <> '' AND NOT starts_with(p, '_')), lambda p: list_filter(string_split_regex(lower(regexp_replace(regexp_replace(p, '^[\[\](){{}}]+|[\[\](){{}}]+$', '', 'g'), '([a-z0-9])([A-Z])', '\1 \2', 'g')), '[^a-zA-Z0-9]+'), lambda t: t <> ''))), lambda t: NOT list_contains({_sql(NOISE)}, t)))"
    return f"""WITH d AS (SELECT source, doc_id, {PLACE} AS path FROM documents), e AS ({edges}), nb AS (SELECT g, src AS a, dst AS b FROM e UNION SELECT g, dst, src FROM e),
n0 AS (SELECT source AS g, doc_id, {PLACE} AS path, {SCORE} AS score, [{REASONS}] AS reasons, {CHANGED} AS changed, {SKIPPED} AS skipped, {WORKSPACE} AS workspace, {API_PATH} AS api_path, CASE WHEN {CLIENT} THEN [{', '.join(CALLED)}] ELSE [] END AS calls, {RATIO} AS ratio FROM documents),
n1 AS (SELECT *, regexp_extract(path, '[^/]*$') AS name, list_distinct({tokens}) AS tokens FROM n0),
r0 AS (SELECT * EXCLUDE (tokens), regexp_replace(name, '(.)\\.[^./]+$', '\\1') AS stem, path LIKE 'tests/%' AS test, regexp_extract(lower(name), '(\\.[^./]+)$', 1) IN ('.toml', '.conf') OR list_has_any(string_split_regex(lower(name), '[^a-z0-9]+'), ['config', 'conf']) AS config,
  list_filter(tokens, lambda t: length(t) >= 3 AND NOT list_contains({_sql(NOISE)}, t)) AS domain, list_has_any(tokens, {_sql(ENTRYPOINT_ROLES)}) AS entry, list_has_any(tokens, {_sql(IMPLEMENTATION_ROLES)}) AS impl, {route} AS route FROM n1),
g1 AS (SELECT e2.g, e2.dst, e2.type FROM (SELECT g, src, dst, type, edge_key FROM e UNION ALL SELECT g, dst, src, type, edge_key FROM e) e2 JOIN r0 ON r0.g = e2.g AND r0.path = e2.src AND changed QUALIFY row_number() OVER (PARTITION BY e2.g, e2.src ORDER BY edge_key, e2.dst) <= {w.graph_neighbors}),
b1 AS (SELECT g, dst AS path, least({w.graph_most}, {w.graph_base} + {w.graph_each} * count(DISTINCT type)) AS amount, 'semantic graph: ' || string_agg(DISTINCT type, ', ' ORDER BY type) || ' from changed file' AS reason FROM g1 GROUP BY g, dst), {apply(1)},
act AS (SELECT DISTINCT g, workspace AS root FROM r1 WHERE changed AND workspace IS NOT NULL UNION SELECT DISTINCT g, 'apps/admin' FROM r1), nd AS (SELECT DISTINCT g, x.root, x.dep FROM r1, (VALUES ('packages/web', 'services/api'), ('lib', 'packages/web')) x(root, dep)),
lv AS (SELECT g, root, min(l) AS l FROM (SELECT g, root, 0 AS l FROM act UNION ALL SELECT g, dep, 1 FROM nd JOIN act USING (g, root) UNION ALL SELECT nd.g, nd.root, 2 FROM nd JOIN act ON act.g = nd.g AND act.root = nd.dep) GROUP BY g, root),
b2 AS (SELECT r1.g, path, [{w.workspace_match}, {w.recall_neighbor}, {w.recall_neighbor / 2}][l + 1] AS amount, 'workspace ' || ['match ', 'dependency ', 'dependent '][l + 1] || workspace AS reason FROM r1 JOIN lv ON lv.g = r1.g AND lv.root = workspace WHERE NOT skipped), {apply(2)},
s3 AS (SELECT g, path, changed, row_number() OVER (PARTITION BY g ORDER BY changed DESC, score DESC, path) AS n FROM r2 WHERE changed OR score >= {w.recall_score} QUALIFY n <= {w.recall_seeds}),
b3 AS (SELECT g, b AS path, {w.recall_neighbor} + CASE WHEN changed THEN {w.changed_seed} ELSE 0 END AS amount, 'recall neighbor of ' || seed AS reason FROM (SELECT nb.g, nb.b, s3.changed, s3.path AS seed, row_number() OVER (PARTITION BY nb.g, nb.b ORDER BY s3.changed DESC, s3.n) AS k FROM nb JOIN s3 ON s3.g = nb.g AND s3.path = nb.a AND nb.b <> nb.a) x
  WHERE k = 1 AND (g, b) IN (SELECT (g, path) FROM r2 WHERE NOT skipped)), {apply(3)},
s4 AS (SELECT g, path, stem, domain, row_number() OVER (PARTITION BY g ORDER BY score DESC, path) AS n FROM r3 WHERE score >= {w.second_score} OR {starts(boosts.SEED_REASONS)} QUALIFY n <= {w.second_seeds}), w4 AS (SELECT *, list_distinct(list_concat(domain, {_sql(keys)})) AS wide FROM s4),
h1 AS (SELECT DISTINCT s4.g, s4.n, nb.b AS path FROM s4 JOIN nb ON nb.g = s4.g AND nb.a = s4.path AND nb.b <> nb.a), h2 AS (SELECT DISTINCT h1.g, h1.n, nb.b AS path FROM h1 JOIN nb ON nb.g = h1.g AND nb.a = h1.path AND nb.b <> nb.a EXCEPT SELECT g, n, path FROM h1 EXCEPT SELECT g, n, path FROM s4),
st AS (SELECT h1.g, h1.n, r3.stem FROM h1 JOIN r3 USING (g, path) UNION SELECT g, n, stem FROM s4 UNION SELECT g, n, unnest(wide) FROM w4),
j4 AS (SELECT h2.g, h2.n, h2.path, w4.path AS seed, r3.config, w4.wide, list_has_any(r3.domain, w4.wide) AS shares, r3.test AND EXISTS (FROM st WHERE st.g = h2.g AND st.n = h2.n AND (contains(r3.stem, st.stem) OR replace(r3.stem, 'test_', '') = st.stem)) AS pair FROM h2 JOIN r3 USING (g, path) JOIN w4 ON w4.g = h2.g AND w4.n = h2.n WHERE NOT r3.skipped),
k4 AS (SELECT *, {w.recall_neighbor / 2} + CASE WHEN shares THEN {w.second_domain} ELSE 0 END AS amount FROM j4 WHERE pair OR shares OR config AND len(wide) > 0), m4 AS (SELECT * FROM k4 QUALIFY row_number() OVER (PARTITION BY g, path ORDER BY amount DESC, n) = 1),
b4 AS (SELECT g, path, amount, CASE WHEN pair THEN 'second-pass related test of ' ELSE 'second-pass recall neighbor of ' END || seed AS reason FROM m4 QUALIFY row_number() OVER (PARTITION BY g ORDER BY amount DESC, n, path) <= {w.second_most}), {apply(4)},
en AS (SELECT g, api_path, max(path) AS path FROM r4 WHERE api_path IS NOT NULL GROUP BY g, api_path), cl AS (SELECT DISTINCT g, path AS consumer, unnest(calls) AS api_path FROM r4 WHERE score > 0),
m5 AS (SELECT en.g, en.path, en.api_path, cl.consumer, {min(w.consumer_most, w.consumer_base + w.cross_layer_related * 0.6)} + CASE WHEN contains(en.api_path, '/order') THEN {w.consumer_keyword} ELSE 0 END AS amount FROM en JOIN cl ON cl.g = en.g AND cl.api_path = en.api_path AND cl.consumer <> en.path),
b5 AS (SELECT g, path, amount, 'API producer for frontend call ' || api_path || ' from ' || consumer AS reason FROM m5 QUALIFY row_number() OVER (PARTITION BY g, path ORDER BY amount DESC, api_path, consumer) = 1), {apply(5)},
a6 AS (SELECT *, list_has_any(route, {_sql(keys)}) AS asked FROM r5 WHERE len(route) > 0), s6 AS (SELECT g, route[1] AS family, path AS seed, route AS sr FROM a6 WHERE NOT skipped AND ({starts(['API route owner match:'])} OR score >= {w.pair_score} AND asked) QUALIFY row_number() OVER (PARTITION BY g, route[1] ORDER BY score DESC, path) = 1),
b6 AS (SELECT a6.g, a6.path, {min(w.pair_most, w.cross_layer_related + w.pair_more)} + CASE WHEN asked THEN {w.pair_keyword} ELSE 0 END AS amount, 'API endpoint pair with /api/' || array_to_string(sr, '/') AS reason FROM a6 JOIN s6 ON s6.g = a6.g AND s6.family = a6.route[1] WHERE seed <> path AND (SELECT count(*) FROM a6 z WHERE z.g = a6.g AND NOT z.skipped) > 1), {apply(6)},
l7 AS (SELECT g, min(score) AS least FROM (SELECT g, score FROM r6 WHERE score > 0 AND NOT skipped QUALIFY row_number() OVER (PARTITION BY g ORDER BY score DESC) <= {w.entry_points}) GROUP BY g),
t7 AS (SELECT DISTINCT r6.g, unnest(domain) AS term FROM r6 JOIN l7 USING (g) WHERE entry AND score >= least UNION SELECT g, unnest({_sql(keys)}) FROM l7),
b7 AS (SELECT g, path, {w.cross_layer_related} AS amount, 'cross-layer related implementation' AS reason FROM r6 WHERE NOT skipped AND impl AND EXISTS (FROM t7 WHERE t7.g = r6.g AND list_contains(r6.domain, t7.term))), {apply(7)},
m8 AS (SELECT g, list_sort(list(score))[count(*) // 2 + 1] AS middle FROM r7 WHERE NOT skipped AND NOT test AND score > 0 GROUP BY g), s8 AS (SELECT r7.g, stem, path FROM r7 JOIN m8 USING (g) WHERE NOT test AND NOT config AND score >= middle),
b8 AS (SELECT t.g, t.path, {w.related_test} AS amount, 'test for high-scoring ' || min(s8.path) AS reason FROM r7 t JOIN s8 ON s8.g = t.g AND (contains(t.stem, s8.stem) OR replace(t.stem, 'test_', '') = s8.stem) WHERE t.test AND NOT list_bool_or(list_transform(t.reasons, lambda r: contains(r, 'test for'))) GROUP BY t.g, t.path), {apply(8)},
n9 AS (SELECT g, path, doc_id % 8 AS n, ratio, {starts(boosts.STRONG_REASONS)} AS strong, {starts(boosts.WEAK_REASONS)} AS weak FROM r8 WHERE doc_id % 3 = 1 AND doc_id % 8 > 0 AND NOT changed),
b9 AS (SELECT g, path, CASE WHEN ratio >= 0.35 AND n >= 4 AND NOT strong OR n >= 6 AND weak AND NOT strong THEN NULL ELSE -least({w.noise_most}, n * {w.noise_each} + greatest(0, n - 2) * {w.noise_more}) END AS amount,
  CASE WHEN ratio >= 0.35 AND n >= 4 AND NOT strong THEN 'repeat noise path suppressed' WHEN n >= 6 AND weak AND NOT strong THEN 'repeat weak-noise path suppressed' ELSE 'history noise penalty -' || CAST(CAST(least({w.noise_most}, n * {w.noise_each} + greatest(0, n - 2) * {w.noise_more}) AS BIGINT) AS VARCHAR) END AS reason FROM n9), {apply(9, True)},
b10 AS (SELECT g, path, CAST(doc_id % 15 AS DOUBLE) AS amount, 'learning feedback miss boost +' || CAST(doc_id % 15 AS VARCHAR) AS reason FROM r9 WHERE doc_id % 10 = 7 AND doc_id % 15 > 0 AND NOT changed), {apply(10)}
SELECT g AS source, path, CAST(score AS DOUBLE) AS score, array_to_string(reasons, '; ') AS reasons FROM r10"""


def chain_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, boosts.Context]:
    docs = read(spark, sf_dir, "documents").select("doc_id", "source")
    own = docs.select(F.col("source").alias("g"), "doc_id", F.expr(PLACE).alias("path"))
    calls = F.when(F.expr(CLIENT), F.array(*(F.expr(c) for c in CALLED)))
    rows = docs.select(F.col("source").alias("g"), F.expr(PLACE).alias("path"), F.expr(SCORE).alias("score"), F.array(F.expr(REASONS)).alias("reasons"), F.expr(CHANGED).alias("changed"), F.expr(SKIPPED).alias("skipped"), F.expr(WORKSPACE).alias("workspace"), F.expr(API_PATH).alias("api_path"), calls.alias("calls"))
    steps = F.array(*(F.struct(F.lit(n).alias("n"), F.expr(kind).alias("type")) for n, kind in STEPS))
    to = own.select("g", F.col("doc_id").alias("to"), F.col("path").alias("dst"))
    key = F.concat(F.lit("e"), F.lpad(F.col("doc_id").cast("string"), 12, "0"), F.col("s.n").cast("string"))
    edges = own.select("g", "doc_id", F.col("path").alias("src"), F.explode(steps).alias("s")).withColumn("to", F.col("doc_id") + F.col("s.n")).join(to, ["g", "to"]).select("g", "src", "dst", "s.type", key.alias("edge_key"))
    edges = cut(edges)  # three passes read them
    groups = docs.select(F.col("source").alias("g"), F.expr(RATIO).alias("generic_ratio")).distinct()
    words = lambda values: F.array(*map(F.lit, values))
    roots = words(["packages/web", "services/api", "apps/admin", "lib"])
    needs = F.array(F.struct(F.lit("packages/web").alias("root"), F.lit("services/api").alias("dep")), F.struct(F.lit("lib").alias("root"), F.lit("packages/web").alias("dep")))
    return boosts.candidates(rows), boosts.Context(
        tasks=groups.select("g", words(KEYWORDS).alias("keywords"), words(WORDS).alias("words"), "generic_ratio"),
        edges=edges,
        near=edges.select("g", F.col("src").alias("a"), F.col("dst").alias("b")),
        workspaces=groups.select("g", F.explode(roots).alias("root")),
        needs=groups.select("g", F.explode(needs).alias("x")).select("g", "x.*"),
        noise=own.where("doc_id % 3 = 1").select("g", "path", (F.col("doc_id") % 8).alias("n")),
        feedback=own.where("doc_id % 10 = 7").select("g", "path", (F.col("doc_id") % 15).alias("amount")),
    )


@query("RNK02 JON10 JON13 JON14", _oracle())
def boost_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and reasons of every document after graph, workspaces, recall, second pass, API consumers and pairs, layers, tests, history and feedback."""
    rows, context = chain_inputs(spark, sf_dir)
    found = boosts.chain(rows, context)
    return found.select(F.col("g").alias("source"), "path", "score", F.array_join("reasons", "; ").alias("reasons"))
