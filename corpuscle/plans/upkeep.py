"""Delta scans, a digest-checked store, retention, matching, compaction and fingerprints."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuscle.functions import excerpts
from corpuscle.operators import matching, retention
from corpuscle.plans.architecture import NAMES_SQL, _graph
from corpuscle.plans.boosts import PLACE
from corpuscle.plans.corpus import TOKENS_SQL
from corpuscle.plans.registry import query, read
from corpuscle.shared import parts_for, shared_folder
from corpuscle.sources import scan, store

# ignore rules of the delta scan, and what each takes, as SQL: the last that holds decides
RULES = ["# generated", "*.conf", "!settings*.conf", "docs/", "/tests/web/**", "!test_item*.py", "lib/d1*"]
EXCLUDE = ["apps/**/order*"]
NAME_SQL = "regexp_extract(path, '[^/]*$')"
RULES_SQL = f"""CASE WHEN starts_with(path, 'lib/d1') THEN true WHEN starts_with({NAME_SQL}, 'test_item') AND ends_with(path, '.py') THEN false WHEN starts_with(path, 'tests/web/') THEN true WHEN starts_with(path, 'docs/') THEN true
 WHEN starts_with({NAME_SQL}, 'settings') AND ends_with(path, '.conf') THEN false WHEN ends_with(path, '.conf') THEN true ELSE false END OR starts_with(path, 'apps/') AND starts_with({NAME_SQL}, 'order')"""
LANGUAGE_SQL = "CASE WHEN ends_with(path, '.py') THEN 'python' WHEN ends_with(path, '.toml') THEN 'toml' WHEN ends_with(path, '.md') THEN 'markdown' END"


@query("SRC02 FLT01 FLT02 SET01", f"""WITH f AS (SELECT doc_id, {PLACE} AS path, text FROM documents WHERE doc_id % 19 <> 4),
t AS (SELECT *, starts_with(path, 'config/') OR doc_id % 10 = 3 OR doc_id % 17 = 2 AS touched FROM f), b AS (SELECT *, CASE WHEN {RULES_SQL} THEN 'ignored' ELSE 'packable' END AS bucket FROM t)
SELECT path, bucket, CASE WHEN bucket = 'packable' THEN {LANGUAGE_SQL} END AS language, CASE WHEN bucket = 'packable' THEN sha256(coalesce(text, '')) END AS hash, CASE WHEN bucket = 'packable' THEN {TOKENS_SQL} ELSE 0 END AS tokens,
  bucket = 'packable' AND {TOKENS_SQL} > 1000 AS too_large, NOT touched AS reused FROM b WHERE touched OR bucket = 'packable'""")
def delta_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree of documents after edits: a changed folder, changed, new and deleted files; the rest comes from the scan before."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.expr(PLACE).alias("path"), F.col("text").cast("binary").alias("content"))
    edited = F.col("path").startswith("config/") | (F.col("doc_id") % 10 == 3)
    before = docs.where("doc_id % 17 <> 2").withColumn("content", F.when(edited, F.lit(b"old")).otherwise(F.col("content")))
    now = docs.where("doc_id % 19 <> 4")
    changed = docs.where("doc_id % 10 = 3 or doc_id % 17 = 2 or doc_id % 19 = 4").select("path").unionByName(spark.createDataFrame([("config",)], "path string"))
    rules = {"exclude": EXCLUDE, "ignore": RULES, "max_tokens": 1000}
    previous = scan.scan(before.select("path", "content"), **rules)
    return scan.scan_changed(now.select("path", "content"), previous, changed, **rules)


@query("SNK07", f"WITH {NAMES_SQL}, k AS (SELECT DISTINCT sha256(src || '|' || type || '|' || dst || '|' || anchor) AS edge_key, resolution FROM full_) SELECT 'entities' AS part, kind, count(*) AS n FROM (SELECT key, kind FROM own UNION ALL SELECT DISTINCT dst, resolution FROM full_ WHERE resolution <> 'resolved') GROUP BY kind UNION ALL SELECT 'edges', resolution, count(*) FROM k GROUP BY resolution")
def published_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph of the lines, written as a version of a store, checked by its digests and read back."""
    entities, edges = _graph(spark, sf_dir)
    root = f"{shared_folder(spark)}/graph-{uuid.uuid4().hex}"
    store.publish({"entities": entities, "edges": edges}, root)
    found, _ = store.load(spark, root)
    per = lambda name, column: found[name].groupBy(F.col(column).alias("kind")).agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "kind", "n")
    return per("entities", "kind").unionByName(per("edges", "resolution"))


KEEP_REFS, MOST_BYTES = 12, 9_000
CACHES_SQL = f"""s AS (SELECT o_custkey % 25 AS g, o_orderkey AS state, CASE WHEN o_orderkey % 4 = 0 THEN 'WORKTREE' ELSE 'ref' END AS ref, o_orderdate AS changed, CAST(100 AS BIGINT) AS bytes, CASE WHEN o_custkey % 25 = 7 AND o_orderkey % 50 = 1 THEN NULL ELSE o_orderkey % 10 <> 5 END AS cur FROM orders),
u AS (SELECT DISTINCT s.g, state, l_partkey AS record FROM s JOIN lineitem ON l_orderkey = state), r AS (SELECT DISTINCT u.g, record, CAST(p_size * 10 AS BIGINT) AS bytes FROM u JOIN part ON p_partkey = record),
k AS (SELECT *, CASE WHEN ref = 'WORKTREE' THEN 0 ELSE n END AS rank FROM (SELECT *, row_number() OVER (PARTITION BY g, ref = 'WORKTREE' ORDER BY changed DESC, state DESC) AS n FROM s WHERE cur) WHERE CASE WHEN ref = 'WORKTREE' THEN n = 1 ELSE n <= {KEEP_REFS} END),
ow AS (SELECT u.g, record, min(rank) AS rank FROM u JOIN k USING (g, state) GROUP BY u.g, record), z AS (SELECT g, rank, sum(bytes) AS b FROM (SELECT g, rank, bytes FROM k UNION ALL SELECT g, rank, bytes FROM r JOIN ow USING (g, record)) GROUP BY g, rank),
c AS (SELECT g, max(rank) FILTER (WHERE upto <= {MOST_BYTES} OR rank <= 2) AS last FROM (SELECT *, sum(b) OVER (PARTITION BY g ORDER BY rank) AS upto FROM z) GROUP BY g), bl AS (SELECT DISTINCT g FROM s WHERE cur IS NULL),
p AS (SELECT s.g, s.bytes, CASE WHEN s.cur IS NULL THEN 'unreadable' WHEN NOT s.cur THEN 'stale' WHEN s.g IN (FROM bl) THEN 'unreadable neighbours' WHEN k.rank IS NULL THEN 'old' WHEN k.rank > last THEN 'budget' ELSE 'retained' END AS reason FROM s LEFT JOIN k USING (g, state) LEFT JOIN c ON c.g = s.g
  UNION ALL SELECT r.g, r.bytes, CASE WHEN r.g IN (FROM bl) THEN 'unreadable neighbours' WHEN ow.rank IS NULL THEN 'unreachable' WHEN ow.rank > last THEN 'budget' ELSE 'reachable' END FROM r LEFT JOIN ow USING (g, record) LEFT JOIN c ON c.g = r.g)"""


@query("SNK08", f"WITH {CACHES_SQL} SELECT g, reason, count(*) AS n, CAST(sum(bytes) AS BIGINT) AS bytes FROM p GROUP BY g, reason")
def retention_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a sweep of the caches of 25 repositories keeps and drops, and why: orders are states, parts their records."""
    orders, lines, part = (read(spark, sf_dir, t) for t in ("orders", "lineitem", "part"))
    current = F.expr("case when o_custkey % 25 = 7 and o_orderkey % 50 = 1 then null else o_orderkey % 10 <> 5 end")
    states = orders.select((F.col("o_custkey") % 25).alias("g"), F.col("o_orderkey").alias("state"), F.when(F.col("o_orderkey") % 4 == 0, retention.WORKTREE).otherwise("ref").alias("ref"), F.col("o_orderdate").alias("changed"), F.lit(100).cast("bigint").alias("bytes"), current.alias("current"))
    parts = parts_for(spark, lines)  # what a task sorts and counts stays the same however many lines there are
    uses = lines.select(F.col("l_orderkey").alias("state"), F.col("l_partkey").alias("record")).repartition(parts, "state").join(states.select("g", "state").repartition(parts, "state"), "state").distinct()
    records = uses.select("g", "record").repartition(parts, "record").distinct().join(part.select(F.col("p_partkey").alias("record"), (F.col("p_size") * 10).cast("bigint").alias("bytes")), "record")
    return retention.retention_plan(states, uses, records, KEEP_REFS, MOST_BYTES).groupBy("g", "reason").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))


@query("SNK03", f"""WITH f AS (SELECT source AS pack, doc_id, {PLACE} AS path, {TOKENS_SQL} AS tokens FROM documents), s AS (SELECT pack, 0 AS part, doc_id AS place, CAST(-1 AS BIGINT) AS line, 'file' AS kind, path, '' AS name, tokens FROM f WHERE doc_id % 3 = 0),
y AS (SELECT pack, 0, doc_id, unnest([1, 2]) AS line, 'symbol', path, 'f' || CAST(doc_id % 7 AS VARCHAR), tokens // 10 FROM f WHERE doc_id % 6 = 0), o AS (SELECT pack, 1, doc_id, CAST(-1 AS BIGINT), 'omitted', path, '', tokens FROM f WHERE doc_id % 3 = 1)
SELECT pack, CAST(row_number() OVER (PARTITION BY pack ORDER BY part, place, path, line, name) AS INTEGER) AS position, kind, path, name, tokens FROM (FROM s UNION ALL FROM y UNION ALL FROM o) QUALIFY position <= {retention.MOST_BLOCKS}""")
def block_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The blocks of each source's pack that can be asked for again: its files, their symbols, and what was left out."""
    f = read(spark, sf_dir, "documents").select(F.col("source").alias("pack"), F.col("doc_id").alias("place"), F.expr(PLACE).alias("path"), F.greatest(F.lit(1), F.floor(F.length("text") / 4)).cast("bigint").alias("tokens"))
    symbols = f.where("place % 6 = 0").select("pack", "path", F.explode(F.array(F.lit(1), F.lit(2))).alias("line"), F.concat(F.lit("f"), (F.col("place") % 7).cast("string")).alias("name"), F.expr("tokens div 10").alias("tokens"))
    return retention.block_registry(f.where("place % 3 = 0"), symbols, f.where("place % 3 = 1"))


PAIRS_SQL = f"""f AS (SELECT source AS g, doc_id, CAST(doc_id * 53 % 400 AS DOUBLE) AS value, {TOKENS_SQL} AS tokens, doc_id % 100 AS rank FROM documents), p AS (SELECT c.g, c.doc_id AS candidate, i.doc_id AS incumbent, c.value - i.value - greatest(0, c.tokens - i.tokens) * 0.04 AS gain, c.tokens - i.tokens AS more, c.rank
  FROM f c JOIN f i ON i.g = c.g WHERE c.doc_id % 17 = 3 AND i.doc_id % 13 = 5), q AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY gain DESC, more, rank, candidate, incumbent) AS n FROM p WHERE gain >= 55),
m(g, n, cs, us) AS (SELECT DISTINCT g, CAST(0 AS BIGINT), CAST([] AS BIGINT[]), CAST([] AS BIGINT[]) FROM q UNION ALL SELECT m.g, x.n, list_append(cs, x.candidate), list_append(us, x.incumbent) FROM m JOIN LATERAL (SELECT min(q.n) AS n, arg_min(q.candidate, q.n) AS candidate, arg_min(q.incumbent, q.n) AS incumbent FROM q WHERE q.g = m.g AND q.n > m.n AND NOT list_contains(m.cs, q.candidate) AND NOT list_contains(m.us, q.incumbent)) x ON x.n IS NOT NULL)"""


@query("EVL05", f"WITH RECURSIVE {PAIRS_SQL} SELECT m.g AS source, candidate, incumbent, gain, CAST(more AS BIGINT) AS more FROM m JOIN q ON q.g = m.g AND q.n = m.n")
def replacement_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which missed file would have taken whose slot in each source, each used once."""
    f = read(spark, sf_dir, "documents").select(F.col("source").alias("g"), F.col("doc_id").alias("id"), (F.col("doc_id") * 53 % 400).alias("value"), F.greatest(F.lit(1), F.floor(F.length("text") / 4)).cast("bigint").alias("tokens"), (F.col("doc_id") % 100).alias("rank"))
    found = matching.greedy_matching(f.where("id % 17 = 3"), f.where("id % 13 = 5"))
    return found.select(F.col("g").alias("source"), "candidate", "incumbent", "gain", "more")


TERMS = ["tion", "ing"]
WINDOW_SQL = f"""f AS (SELECT doc_id, string_split(text, chr(10)) AS l, CASE WHEN doc_id % 3 = 0 THEN 'test' WHEN doc_id % 3 = 1 THEN 'source' ELSE 'config' END AS family, CASE WHEN doc_id % 4 = 0 THEN 'full' WHEN doc_id % 4 = 1 THEN 'skeleton' ELSE 'summary' END AS mode, least(200, {TOKENS_SQL}) AS tokens, doc_id % 25 AS rank, doc_id % 2 = 0 AS anchored FROM documents WHERE text IS NOT NULL),
a AS (SELECT *, CASE WHEN mode = 'full' OR tokens <= 80 THEN NULL WHEN family = 'test' AND tokens >= 120 THEN CASE WHEN rank > 12 THEN 64 ELSE 96 END WHEN family = 'source' AND tokens >= 120 AND (rank > 12 OR NOT anchored) THEN CASE WHEN anchored THEN 96 ELSE 72 END WHEN family = 'config' AND rank > 12 THEN 48 END AS most FROM f),
h AS (SELECT doc_id, most, l, n, greatest(0, n - 2) AS s, least(len(l), n + 6) AS e FROM (SELECT doc_id, most, l, unnest(range(len(l))) AS n FROM a WHERE most IS NOT NULL) WHERE contains(lower(l[n + 1]), 'tion') OR contains(lower(l[n + 1]), 'ing') QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n) <= 8),
g AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS island FROM (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 2 THEN 0 ELSE 1 END AS new FROM h)),
w AS (SELECT doc_id, island, any_value(most) AS most, min(s) AS s, max(e) AS e, array_to_string(any_value(l)[min(s) + 1:max(e)], chr(10)) AS chunk FROM g GROUP BY doc_id, island)"""


@query("RNK10", f"WITH {WINDOW_SQL} SELECT f.doc_id, CAST(count(w.doc_id) AS BIGINT) AS windows, CAST(min(w.s) AS BIGINT) AS first_line, CAST(max(w.e) AS BIGINT) AS last_line FROM a f LEFT JOIN w ON w.doc_id = f.doc_id WHERE f.most IS NOT NULL GROUP BY f.doc_id")
def excerpt_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows around the hits of every payload that is to be compacted, before the allowance cuts them."""
    return _payloads(spark, sf_dir, unbounded=True).select("doc_id", F.size("x.spans").cast("bigint").alias("windows"), F.array_min("x.spans.start").cast("bigint").alias("first_line"), F.array_max("x.spans.end").cast("bigint").alias("last_line"))


def _payloads(spark: SparkSession, sf_dir: str, unbounded: bool = False) -> DataFrame:
    rows = read(spark, sf_dir, "documents").where("text is not null").select(
        "doc_id", "text", F.expr("case doc_id % 3 when 0 then 'test' when 1 then 'source' else 'config' end").alias("family"), F.expr("case doc_id % 4 when 0 then 'full' when 1 then 'skeleton' else 'summary' end").alias("mode"),
        F.least(F.lit(200), F.greatest(F.lit(1), F.floor(F.length("text") / 4))).cast("bigint").alias("tokens"), (F.col("doc_id") % 25).alias("rank"), (F.col("doc_id") % 2 == 0).alias("anchored"),
    )
    most = excerpts.allowance(F.col("family"), F.col("mode"), F.col("tokens"), F.col("rank"), F.col("anchored"), F.lit(False))
    found = rows.withColumn("most", most).where("most is not null")
    return found.withColumn("x", excerpts.excerpts(F.col("text"), F.array(*map(F.lit, TERMS)), F.lit(2**30) if unbounded else F.col("most"), F.lit(""))).drop("text")


@query("RNK10")
def compacted_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every payload before and after compaction; one that would not shrink stays. Tested against a plain loop."""
    made = _payloads(spark, sf_dir)
    shrunk = (F.col("x.tokens") > 0) & (F.col("x.tokens") < F.col("tokens"))
    return made.select("doc_id", "tokens", F.when(shrunk, F.col("x.tokens")).otherwise(F.col("tokens")).cast("bigint").alias("compacted"), F.when(shrunk, F.col("x.excerpt")).alias("excerpt"))


@query("STM08", "SELECT user_id, event_id, before, after FROM (SELECT user_id, event_id, event_type AS after, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) WHERE before IS NULL OR before <> after")
def fingerprint_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events whose type is another than the last one of their user: the batch form of streaming.events.fingerprint_changes."""
    last = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    own = read(spark, sf_dir, "events").select("user_id", "event_id", F.col("event_type").alias("after"), last.alias("before"))
    return own.where("before is null or before <> after").select("user_id", "event_id", "before", "after")
