"""Path and evidence predicates, rule tables, references, memory chains and cache decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle.functions import text
from corpuscle.operators import relational as rel
from corpuscle.plans.corpus import TOKENS_SQL, files
from corpuscle.plans.ranking import P_SQL
from corpuscle.plans.registry import REASON, query, read
from corpuscle.sources import readers, sinks


@query("SRC05", f"WITH {P_SQL} SELECT CASE regexp_extract(path, '[^/](\\.[^./]*)$', 1) WHEN '.py' THEN 'python' WHEN '.md' THEN 'markdown' WHEN '.json' THEN 'json' WHEN '.ts' THEN 'typescript' END AS language, count(*) AS n FROM f GROUP BY 1")
def language_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).groupBy(readers.language(F.col("path")).alias("language")).agg(F.count("*").alias("n"))


@query("FLT04 FLT09", f"WITH {P_SQL} SELECT regexp_matches(path, '(^|/)(tests?|spec)/|test_|\\.test\\.') AS is_test, regexp_matches(path, '\\.(json|toml|ya?ml|cfg)$') AS is_config, {REASON} IN ('Filename keyword match', 'matched role keyword') AS only_weak, count(*) AS n FROM f GROUP BY ALL")
def path_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, reasons = F.col("path"), F.array(F.expr(REASON))
    weak = F.forall(reasons, lambda r: r.isin("Filename keyword match", "matched role keyword"))
    return files(spark, sf_dir).groupBy(p.rlike(r"(^|/)(tests?|spec)/|test_|\.test\.").alias("is_test"), p.rlike(r"\.(json|toml|ya?ml|cfg)$").alias("is_config"), weak.alias("only_weak")).agg(F.count("*").alias("n"))


@query("FLT08", f"WITH {P_SQL}, c AS (SELECT CASE WHEN path LIKE 'tests/%' THEN 'tests' WHEN path LIKE 'docs/%' THEN 'docs' WHEN {REASON} = 'config file' THEN 'config' ELSE 'source' END AS family, doc_id, source, tokens FROM f), r AS (SELECT *, row_number() OVER (PARTITION BY source, family ORDER BY tokens DESC, doc_id) AS i, CASE family WHEN 'tests' THEN 4 WHEN 'docs' THEN 3 WHEN 'config' THEN 2 ELSE 8 END AS cap FROM c) SELECT source, family, count(*) AS kept FROM r WHERE i <= cap GROUP BY source, family")
def family_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cap that depends on the family of the row."""
    p = F.col("path")
    family = F.when(p.startswith("tests/"), "tests").when(p.startswith("docs/"), "docs").when(F.expr(REASON) == "config file", "config").otherwise("source")
    cap = F.when(F.col("family") == "tests", 4).when(F.col("family") == "docs", 3).when(F.col("family") == "config", 2).otherwise(8)
    top = rel.top_per_group(files(spark, sf_dir).withColumn("family", family), ["source", "family"], [F.desc("tokens"), F.col("doc_id")], 8)
    return top.where(F.col("rank") <= cap).groupBy("source", "family").agg(F.count("*").alias("kept"))


@query("FLT12 FLT15", "WITH s AS (SELECT user_id, count(*) FILTER (WHERE event_type = 'error') AS errors, count(*) FILTER (WHERE event_type = 'purchase') AS done, max(ts) AS last_ts FROM events GROUP BY user_id) SELECT user_id, CASE WHEN errors > done THEN 'fix failures' WHEN last_ts < TIMESTAMP '2024-01-29' THEN 'refresh' WHEN done >= 10 THEN 'hand off' ELSE 'continue' END AS action, CASE WHEN errors > done THEN 'blocked' WHEN done > 0 THEN 'active' ELSE 'idle' END AS state FROM s")
def next_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rule that holds, in order of priority."""
    per = read(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("errors"), F.count_if(F.col("event_type") == "purchase").alias("done"), F.max("ts").alias("last_ts"))
    action = F.when(F.col("errors") > F.col("done"), "fix failures").when(F.expr("last_ts < timestamp_ntz'2024-01-29 00:00:00'"), "refresh").when(F.col("done") >= 10, "hand off").otherwise("continue")
    state = F.when(F.col("errors") > F.col("done"), "blocked").when(F.col("done") > 0, "active").otherwise("idle")
    return per.select("user_id", action.alias("action"), state.alias("state"))


@query("JON21", """WITH live AS (SELECT DISTINCT c_custkey AS k FROM customer WHERE c_custkey % 50 = 0), hop AS (SELECT DISTINCT o_orderkey AS o FROM orders WHERE o_custkey IN (FROM live) AND o_orderkey % 2 = 0), ep AS (SELECT DISTINCT l_partkey AS p FROM lineitem WHERE l_orderkey IN (FROM hop)),
linked AS (SELECT p, 'linked' AS kind FROM ep WHERE p % 3 = 0) SELECT p, kind FROM linked UNION ALL SELECT p, 'fallback' FROM ep WHERE NOT EXISTS (FROM linked)""")
def memory_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chained semi-joins; the fallback branch has rows only if the linked one has none."""
    live = read(spark, sf_dir, "customer").where("c_custkey % 50 = 0").select(F.col("c_custkey").alias("o_custkey"))
    hop = read(spark, sf_dir, "orders").where("o_orderkey % 2 = 0").join(live, "o_custkey", "left_semi").select(F.col("o_orderkey").alias("l_orderkey"))
    episodes = read(spark, sf_dir, "lineitem").join(hop, "l_orderkey", "left_semi").select(F.col("l_partkey").alias("p")).distinct()
    linked = episodes.where("p % 3 = 0").withColumn("kind", F.lit("linked"))
    none = linked.limit(1).agg(F.count("*").alias("n")).where("n = 0")
    return linked.unionByName(episodes.crossJoin(F.broadcast(none)).select("p", F.lit("fallback").alias("kind")))


@query("SET05", "WITH b AS (SELECT DISTINCT unnest(string_split_regex(lower(text), '[^a-z0-9]+')) AS term FROM benchmark), d AS (SELECT term, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(string_split_regex(lower(text), '[^a-z0-9]+')) AS term FROM documents WHERE doc_id % 11 = 0) WHERE length(term) >= 3 GROUP BY term) SELECT term, n FROM d WHERE term NOT IN (SELECT term FROM b) ORDER BY n DESC, term LIMIT 12")
def enriched_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most twelve new terms of changed files."""
    words = lambda df, *keys: df.select(*keys, F.explode(F.array_distinct(F.split(F.lower("text"), "[^a-z0-9]+"))).alias("term"))
    known = words(read(spark, sf_dir, "benchmark")).distinct()
    counts = words(read(spark, sf_dir, "documents").where("doc_id % 11 = 0"), "doc_id").where("length(term) >= 3").groupBy("term").agg(F.count("*").alias("n"))
    return counts.join(known, "term", "left_anti").orderBy(F.desc("n"), "term").limit(12)


@query("SET06", "WITH r AS (SELECT host AS rule, min(page_id) AS first_page FROM (SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host FROM pages) GROUP BY 1) SELECT rule, first_page FROM r WHERE rule NOT IN (SELECT regexp_extract(url, '^https?://([^/]+)', 1) FROM pages WHERE page_id % 9 = 0)")
def imported_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct rules in the order of their first place, without those that are known."""
    rules = read(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^https?://([^/]+)", 1).alias("rule"))
    known = rules.where("page_id % 9 = 0").select("rule")
    return rules.groupBy("rule").agg(F.min("page_id").alias("first_page")).join(known, "rule", "left_anti")


@query("SET08", r"WITH r AS (SELECT page_id, list_distinct(regexp_extract_all(url || ' ' || html, '/([a-z]{2}/[0-9]+)', 1)) AS refs FROM pages) SELECT page_id, len(refs) AS n FROM r")
def issue_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = F.array_distinct(F.regexp_extract_all(F.concat_ws(" ", "url", "html"), F.lit("/([a-z]{2}/[0-9]+)"), F.lit(1)))
    return read(spark, sf_dir, "pages").select("page_id", F.size(refs).cast("bigint").alias("n"))


ROLES = [("service", "backend", 3), ("order", "commerce", 2), ("user", "identity", 2), ("settings", "config", 3), ("test", "quality", 1), ("main", "entry", 2)]


@query("STR09 COL07", f"WITH {P_SQL}, rules(term, label, points) AS (VALUES {', '.join(f'''('{t}', '{label}', {p})''' for t, label, p in ROLES)}), s AS (SELECT doc_id, label, sum(points) AS points FROM f JOIN rules ON contains(lower(path), term) GROUP BY doc_id, label), b AS (SELECT doc_id, arg_max(label, (points, label)) AS label FROM s GROUP BY doc_id) SELECT label, count(*) AS n FROM b GROUP BY label")
def role_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A short rule table becomes one expression per label; the best label wins."""
    path = F.lower("path")
    labels = sorted({label for _, label, _ in ROLES})
    points = {label: sum((F.when(path.contains(t), p).otherwise(0) for t, own, p in ROLES if own == label), F.lit(0)) for label in labels}
    best = F.greatest(*(F.when(points[label] > 0, F.struct(points[label].alias("points"), F.lit(label).alias("label"))) for label in labels))
    return files(spark, sf_dir).select(best["label"].alias("label")).where("label is not null").groupBy("label").agg(F.count("*").alias("n"))


GENERIC, DOMAIN = ["bolt", "ring", "gear"], ["red", "blue", "small", "large"]


@query("STR17", "WITH t AS (SELECT p_partkey, list_filter(string_split_regex(lower(p_name), '[^a-z0-9]+'), lambda x: length(x) >= 3) AS t FROM part) SELECT p_partkey, CASE WHEN len(t) = 1 AND list_contains(['bolt', 'ring', 'gear'], t[1]) THEN 'generic' WHEN list_has_any(t, ['red', 'blue', 'small', 'large']) AND len(t) >= 2 THEN 'domain_revealing' WHEN len(t) >= 2 AND NOT list_has_any(t, ['bolt', 'ring', 'gear']) THEN 'domain_revealing' WHEN len(t) > 0 AND len(list_filter(t, lambda x: list_contains(['bolt', 'ring', 'gear'], x))) = len(t) THEN 'generic' ELSE 'neutral' END AS label FROM t")
def public_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    generic, domain = F.array(*map(F.lit, GENERIC)), F.array(*map(F.lit, DOMAIN))
    rows = read(spark, sf_dir, "part").select("p_partkey", F.filter(text.ordered_tokens(F.col("p_name")), lambda x: F.length(x) >= 3).alias("t"))
    stems, n = F.size(F.filter("t", lambda x: F.array_contains(generic, x))), F.size("t")
    label = F.when((n == 1) & (stems == 1), "generic").when(F.arrays_overlap("t", domain) & (n >= 2), "domain_revealing").when((n >= 2) & (stems == 0), "domain_revealing").when((n > 0) & (stems == n), "generic").otherwise("neutral")
    return rows.select("p_partkey", label.alias("label"))


@query("DTE07", "SELECT o_orderkey, CASE WHEN o_orderdate IS NULL THEN 'no snapshot' WHEN floor((epoch(TIMESTAMP '1998-08-02') - epoch(o_orderdate)) / 86400) > 365 THEN 'too old' WHEN o_orderpriority = '1-URGENT' THEN 'branch changed' WHEN o_custkey % 10 = 0 THEN 'dirty' ELSE NULL END AS reason FROM orders")
def cache_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first reason that forbids an incremental run; null allows it."""
    age = F.floor((F.unix_timestamp(F.lit("1998-08-02 00:00:00").cast("timestamp")) - F.unix_timestamp(F.col("o_orderdate").cast("timestamp"))) / 86400)
    reason = F.when(F.col("o_orderdate").isNull(), "no snapshot").when(age > 365, "too old").when(F.col("o_orderpriority") == "1-URGENT", "branch changed").when(F.col("o_custkey") % 10 == 0, "dirty")
    return read(spark, sf_dir, "orders").select("o_orderkey", reason.alias("reason"))


@query("COL06", "WITH e AS (SELECT user_id, event_type, min((ts, event_id)) AS place FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY place) AS i FROM e) SELECT user_id, string_agg(event_type, ',' ORDER BY i) AS kinds FROM r WHERE i <= 3 GROUP BY user_id")
def unique_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three distinct values of each key in order: distinct before gathering."""
    firsts = read(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.min(F.struct("ts", "event_id")).alias("at"))
    top = rel.top_per_group(firsts, ["user_id"], [F.col("at")], 3)
    return top.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "event_type"))), lambda x: x["event_type"]), ",").alias("kinds"))


@query("COL03 STM04", "SELECT event_id, user_id % 7 AS worktree, json_extract_string(props, '$.k') AS k, coalesce(c_mktsegment, 'unknown') AS segment FROM events LEFT JOIN customer ON c_custkey = user_id")
def enriched_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with their identity joined on; the payload stays an open map until it is read."""
    own = read(spark, sf_dir, "events").select("event_id", "user_id", F.from_json("props", "map<string,string>").alias("payload"))
    who = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), "c_mktsegment")
    return own.join(who, "user_id", "left").select("event_id", (F.col("user_id") % 7).alias("worktree"), F.col("payload")["k"].alias("k"), F.coalesce("c_mktsegment", F.lit("unknown")).alias("segment"))


@query("RNK13", f"WITH {P_SQL} SELECT doc_id, CAST(CASE WHEN path LIKE 'fixtures/%' OR path LIKE 'dist/%' THEN 0 ELSE tokens + CASE WHEN doc_id % 11 = 0 THEN 500 ELSE 0 END + CASE WHEN path LIKE 'tests/%' THEN 50 ELSE 0 END END AS BIGINT) AS score FROM f ORDER BY score DESC, doc_id LIMIT 40")
def route_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("path")
    flags = F.col("tokens") + F.when(F.col("doc_id") % 11 == 0, 500).otherwise(0) + F.when(p.startswith("tests/"), 50).otherwise(0)
    score = F.when(p.startswith("fixtures/") | p.startswith("dist/"), 0).otherwise(flags).cast("bigint")
    return files(spark, sf_dir).select("doc_id", score.alias("score")).orderBy(F.desc("score"), "doc_id").limit(40)


@query("MTH07", f"WITH {P_SQL}, r AS (SELECT source, doc_id, tokens, sum(tokens) OVER (PARTITION BY source ORDER BY sha256('seed|' || doc_id), doc_id ROWS UNBOUNDED PRECEDING) AS spent FROM f) SELECT source, count(*) AS n, CAST(sum(tokens) AS BIGINT) AS tokens FROM r WHERE spent <= 5000 GROUP BY source")
def random_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A baseline in hash order, so that runs agree."""
    rows = files(spark, sf_dir).select("source", "doc_id", "tokens", F.sha2(F.concat(F.lit("seed|"), F.col("doc_id")), 256).alias("h"))
    return rel.budget_prefix(rows, ["source"], [F.col("h"), F.col("doc_id")], "tokens", 5000).groupBy("source").agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens"))


@query("SNK06", f"WITH {P_SQL} SELECT doc_id, path || ' | ' || CASE WHEN tokens > 500 THEN 'summary' ELSE 'full' END || ' | ' || tokens AS line FROM f")
def rendered_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    mode = F.when(F.col("tokens") > 500, "summary").otherwise("full")
    return files(spark, sf_dir).select("doc_id", sinks.compact(F.col("path"), mode, F.col("tokens")).alias("line"))


@query("SRT09", f"WITH h AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents), s AS (SELECT doc_id, pos, length(line) // 4 AS tokens, CASE WHEN contains(lower(line), 'the') THEN 100 ELSE 0 END + length(line) // 40 AS score FROM h), r AS (SELECT *, sum(tokens) OVER (PARTITION BY doc_id ORDER BY score DESC, pos ROWS UNBOUNDED PRECEDING) AS spent FROM s) SELECT doc_id, count(*) AS hunks, CAST(sum(tokens) AS BIGINT) AS tokens FROM r WHERE spent <= 300 GROUP BY doc_id")
def hunk_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored line hunks of every text in a token budget, up to the first that does not fit."""
    lines = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    score = F.when(F.lower("line").contains("the"), 100).otherwise(0) + F.floor(F.length("line") / 40)
    rows = lines.select("doc_id", "pos", F.floor(F.length("line") / 4).alias("tokens"), score.alias("score"))
    return rel.budget_prefix(rows, ["doc_id"], [F.desc("score"), F.col("pos")], "tokens", 300).groupBy("doc_id").agg(F.count("*").alias("hunks"), F.sum("tokens").alias("tokens"))


@query("GRF11", f"WITH {P_SQL}, d AS (SELECT source AS district, count(*) AS nodes, CAST(sum(tokens) AS BIGINT) AS weight FROM f GROUP BY source) SELECT district, nodes, weight, row_number() OVER (ORDER BY weight DESC, district) AS rank FROM d QUALIFY rank <= 12")
def graph_districts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    per = files(spark, sf_dir).groupBy(F.col("source").alias("district")).agg(F.count("*").alias("nodes"), F.sum("tokens").alias("weight")).orderBy(F.desc("weight"), "district").limit(12)
    return per.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("weight"), "district")).cast("bigint"))  # twelve rows


@query("RNK11", f"SELECT source, CASE WHEN sum({TOKENS_SQL}) <= 40000 THEN 'full' WHEN sum(least({TOKENS_SQL}, 300)) <= 40000 THEN 'truncated' ELSE 'summary' END AS level FROM documents GROUP BY source")
def budget_fit_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first level of detail whose size fits the budget, for each source at once."""
    per = files(spark, sf_dir).groupBy("source").agg(F.sum("tokens").alias("full"), F.sum(F.least("tokens", F.lit(300))).alias("cut"))
    return per.select("source", F.when(F.col("full") <= 40000, "full").when(F.col("cut") <= 40000, "truncated").otherwise("summary").alias("level"))
