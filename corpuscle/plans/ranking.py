"""Ranking adjustments, routing, selection under budgets, and reference joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle.functions import text
from corpuscle.operators import relational as rel
from corpuscle.operators import selection
from corpuscle.plans.corpus import TOKENS_SQL, files
from corpuscle.plans.registry import PATH, query, read

P_SQL = f"f AS (SELECT doc_id, source, lang, {PATH} AS path, {TOKENS_SQL} AS tokens, text FROM documents)"


@query("MTH02 UDF03", "WITH t AS (SELECT event_type AS term, count(*) AS n, count(*) FILTER (WHERE value >= 60) AS good, count(*) FILTER (WHERE value <= 20) AS bad FROM events GROUP BY event_type), w AS (SELECT term, 0.55 + 0.7 * greatest(0, least(1, ln(10001.0 / (n + 1)) / ln(10001.0))) AS c, good, bad FROM t) SELECT term, round_even(CASE WHEN term = 'view' THEN least(c, 0.25) WHEN term = 'error' THEN least(c, 0.45) WHEN bad > greatest(1, 2 * good) THEN least(c, 0.55) WHEN good >= greatest(2, 2 * bad) THEN least(1.35, c + 0.2) ELSE c END, 3) AS weight FROM w")
def keyword_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base weight by rarity, with caps for generic, ambiguous and learned terms."""
    per = read(spark, sf_dir, "events").groupBy(F.col("event_type").alias("term")).agg(F.count("*").alias("n"), F.count_if(F.col("value") >= 60).alias("good"), F.count_if(F.col("value") <= 20).alias("bad"))
    c = 0.55 + 0.7 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.log(10001.0 / (F.col("n") + 1)) / F.log(F.lit(10001.0))))
    own = per.withColumn("c", c)
    capped = (
        F.when(F.col("term") == "view", F.least("c", F.lit(0.25)))
        .when(F.col("term") == "error", F.least("c", F.lit(0.45)))
        .when(F.expr("bad > greatest(1, 2 * good)"), F.least("c", F.lit(0.55)))
        .when(F.expr("good >= greatest(2, 2 * bad)"), F.least(F.lit(1.35), F.col("c") + 0.2))
        .otherwise(F.col("c"))
    )
    return own.select("term", F.bround(capped, 3).alias("weight"))


@query("RNK03 RNK05", f"WITH {P_SQL} SELECT doc_id, round(CAST(CASE WHEN contains(path, 'Service') AND doc_id % 9 <> 1 AND lang = 'en' THEN greatest(0, tokens * 0.2) WHEN contains(path, 'Service') AND doc_id % 9 <> 1 THEN tokens * 0.35 WHEN doc_id % 9 = 6 AND lang = 'en' THEN greatest(0, tokens * 0.45 - 15) ELSE tokens END AS DOUBLE), 6) AS score FROM f")
def precision_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weak evidence is damped; the first rule that holds decides."""
    f = files(spark, sf_dir)
    by_name, strong, broad = F.col("path").contains("Service"), F.col("doc_id") % 9 == 1, F.col("lang") == "en"
    t = F.col("tokens").cast("double")
    score = F.when(by_name & ~strong & broad, F.greatest(F.lit(0.0), t * 0.2)).when(by_name & ~strong, t * 0.35).when((F.col("doc_id") % 9 == 6) & broad, F.greatest(F.lit(0.0), t * 0.45 - 15)).otherwise(t)
    return f.select("doc_id", F.round(score, 6).alias("score"))


@query("SRT10 AGG08", f"WITH {P_SQL}, r AS (SELECT source, doc_id, tokens, sum(tokens) OVER (PARTITION BY source ORDER BY tokens DESC, doc_id ROWS UNBOUNDED PRECEDING) AS spent FROM f) SELECT source, doc_id, CAST(spent AS BIGINT) AS spent FROM r WHERE spent <= 20000")
def budget_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.budget_prefix(files(spark, sf_dir).select("source", "doc_id", "tokens"), ["source"], [F.desc("tokens"), F.col("doc_id")], "tokens", 20000).select("source", "doc_id", "spent")


@query("RNK07")
def budget_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Skip-greedy selection; no SQL form, tested against a plain loop."""
    return selection.greedy_budget(files(spark, sf_dir), "source", "doc_id", "tokens", "tokens", 20000)


@query("SRT03")
def mmr_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three diverse picks of each source; no SQL form, tested against a plain loop."""
    rows = files(spark, sf_dir).select("source", "doc_id", "tokens", text.path_tokens(F.col("path")).alias("terms"))
    return selection.diverse_top_k(rows, "source", "doc_id", "tokens", "terms")


BUCKET_SQL = "CASE WHEN doc_id % 11 = 0 THEN 'changed' WHEN path LIKE 'tests/%' THEN 'tests' WHEN path LIKE 'docs/%' THEN 'docs' ELSE 'rest' END"


@query("WIN08", f"WITH {P_SQL}, b AS (SELECT *, {BUCKET_SQL} AS bucket FROM f), r AS (SELECT *, row_number() OVER (PARTITION BY source, bucket ORDER BY tokens DESC, doc_id) AS i FROM b), l AS (SELECT *, CASE WHEN i = 1 THEN CASE bucket WHEN 'changed' THEN 1 WHEN 'tests' THEN 2 WHEN 'docs' THEN 3 ELSE 4 END ELSE 4 END AS lead FROM r) SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY lead, tokens DESC, doc_id) AS position FROM l")
def reserved_bucket_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = files(spark, sf_dir).withColumn("bucket", F.expr(BUCKET_SQL))
    out = selection.bucket_order(rows, ["source"], "bucket", [F.desc("tokens"), F.col("doc_id")], ["changed", "tests", "docs"])
    return out.select("source", "doc_id", F.col("position").cast("bigint").alias("position"))


PATTERNS = [("*", "include", 0), ("dist/**", "ignore", 1), ("*.md", "ignore", 2), ("docs/**", "include", 3), ("**/main?.ts", "ignore", 4)]


def glob_regex(pattern: str) -> str:
    """An anchored regular expression of a gitignore-style pattern: ** spans slashes, * and ? do not."""
    out, i = "", 0
    while i < len(pattern):
        if pattern.startswith("**/", i):
            out, i = out + "(.*/)?", i + 3
        elif pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            c = pattern[i]
            out, i = out + ("[^/]*" if c == "*" else "[^/]" if c == "?" else "\\" + c if c in ".+()[]{}^$|\\" else c), i + 1
    return f"^({'' if '/' in pattern else '(.*/)?'}{out})$"


@query("FLT01 FLT02 RNK15", f"WITH {P_SQL}, x(pattern, action, i) AS (VALUES {', '.join(f'''('{glob_regex(p)}', '{a}', {i})''' for p, a, i in PATTERNS)}) SELECT action, count(*) AS n FROM (SELECT doc_id, arg_max(action, i) AS action FROM f JOIN x ON regexp_matches(path, pattern) GROUP BY doc_id) GROUP BY action")
def ignore_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last matching pattern decides; the pattern table is a short list, so each becomes one expression."""
    path = F.col("path")
    best = F.greatest(*(F.when(path.rlike(glob_regex(p)), F.struct(F.lit(i).alias("i"), F.lit(a).alias("action"))) for p, a, i in PATTERNS))
    return files(spark, sf_dir).select(best["action"].alias("action")).where("action is not null").groupBy("action").agg(F.count("*").alias("n"))


@query("JON07 JON08", f"WITH {P_SQL}, s AS (SELECT DISTINCT source, regexp_extract(path, '([^/.]+)[^/]*$', 1) AS stem FROM f WHERE path LIKE 'src/%'), t AS (SELECT DISTINCT source, path, regexp_extract(path, '([^/.]+)[^/]*$', 1) AS stem FROM f WHERE path LIKE 'tests/%') SELECT t.source, path, min(s.stem) AS matched FROM t JOIN s ON t.source = s.source AND (s.stem = t.stem OR 'test_' || s.stem = t.stem) GROUP BY t.source, path")
def related_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stem templates become join keys, so a theta join turns into an equi-join."""
    stem = F.regexp_extract("path", "([^/.]+)[^/]*$", 1)
    f = files(spark, sf_dir).select("source", "path", stem.alias("stem"))
    src = f.where("path like 'src/%'").select("source", "stem").distinct()
    keyed = src.select("source", "stem", F.explode(F.array("stem", F.concat(F.lit("test_"), "stem"))).alias("key"))
    tests = f.where("path like 'tests/%'").select("source", "path", F.col("stem").alias("key")).distinct()
    return tests.join(keyed, ["source", "key"]).groupBy("source", "path").agg(F.min("stem").alias("matched"))


@query("JON04 JON05 JON06", f"WITH {P_SQL}, i AS (SELECT DISTINCT source, path, 'src/models/' || CASE doc_id % 5 WHEN 0 THEN 'main' WHEN 1 THEN 'userService' ELSE 'missing' END || CAST(doc_id % 40 AS VARCHAR) AS target FROM f), c AS (SELECT i.*, e.ext, e.pos FROM i, (VALUES ('', 0), ('.py', 1), ('.ts', 2), ('.json', 3)) e(ext, pos)), h AS (SELECT c.source, c.path, c.target, arg_min(c.target || c.ext, pos) AS hit FROM c JOIN (SELECT DISTINCT source, path FROM f) p ON p.source = c.source AND p.path = c.target || c.ext GROUP BY 1, 2, 3) SELECT i.source, i.path, i.target, h.hit, h.hit IS NOT NULL AS resolved FROM i LEFT JOIN h USING (source, path, target)")
def import_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered candidates by explode and equi-join; the first in order wins, the rest stay unresolved."""
    f = files(spark, sf_dir)
    name = F.when(F.col("doc_id") % 5 == 0, "main").when(F.col("doc_id") % 5 == 1, "userService").otherwise("missing")
    wanted = f.select("source", "path", F.concat(F.lit("src/models/"), name, (F.col("doc_id") % 40).cast("string")).alias("target")).distinct()
    candidates = wanted.select("*", F.posexplode(F.array(*(F.concat("target", F.lit(e)) for e in ("", ".py", ".ts", ".json")))).alias("pos", "hit"))
    known = f.select("source", F.col("path").alias("hit")).distinct()
    hits = candidates.join(known, ["source", "hit"]).groupBy("source", "path", "target").agg(F.min_by("hit", "pos").alias("hit"))
    return wanted.join(hits, ["source", "path", "target"], "left").withColumn("resolved", F.col("hit").isNotNull())


@query("JON16", "WITH c AS (SELECT DISTINCT user_id AS caller, CAST(json_extract_string(props, '$.k') AS BIGINT) AS symbol FROM events WHERE event_type = 'click'), t AS (SELECT DISTINCT CAST(json_extract_string(props, '$.k') AS BIGINT) AS symbol FROM events WHERE event_type = 'signup' AND user_id <= 3) SELECT caller, least(90 * count(DISTINCT symbol), 180) AS boost FROM c JOIN t USING (symbol) GROUP BY caller")
def call_site_boosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = read(spark, sf_dir, "events").select("user_id", "event_type", F.get_json_object("props", "$.k").cast("bigint").alias("symbol"))
    targets = own.where("event_type = 'signup' and user_id <= 3").select("symbol").distinct()
    calls = own.where("event_type = 'click'").select(F.col("user_id").alias("caller"), "symbol").distinct()
    return calls.join(targets, "symbol").groupBy("caller").agg(F.least(90 * F.count("*"), F.lit(180)).alias("boost"))


@query("JON12", f"WITH {P_SQL}, s AS (SELECT source, lang, max(tokens) AS best FROM f GROUP BY source, lang), r AS (SELECT source, lang, arg_max(doc_id, (tokens, -doc_id)) AS seed FROM f GROUP BY source, lang) SELECT f.source, count(*) AS boosted FROM f JOIN s USING (source, lang) JOIN r USING (source, lang) WHERE best >= 90 AND doc_id <> seed GROUP BY f.source")
def family_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = files(spark, sf_dir).select("source", "lang", "doc_id", "tokens")
    seeds = f.groupBy("source", "lang").agg(F.max("tokens").alias("best"), F.max_by("doc_id", F.struct("tokens", -F.col("doc_id"))).alias("seed")).where("best >= 90")
    return f.join(F.broadcast(seeds), ["source", "lang"]).where("doc_id <> seed").groupBy("source").agg(F.count("*").alias("boosted"))


@query("JON22", f"WITH {P_SQL} SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) THEN tokens + 100 ELSE tokens END AS score FROM f")
def pull_request_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = read(spark, sf_dir, "labels").where("quality = 1").select("doc_id").distinct().withColumn("hit", F.lit(100))
    return files(spark, sf_dir).join(listed, "doc_id", "left").select("doc_id", (F.col("tokens") + F.coalesce("hit", F.lit(0))).alias("score"))


@query("JON25 JON26", "SELECT b.item_id, CASE WHEN d.doc_id IS NULL THEN 'missing' WHEN sha256(d.text) <> sha256(CASE WHEN b.item_id % 3 = 0 THEN d.text || 'x' ELSE d.text END) THEN 'stale' ELSE 'current' END AS state FROM benchmark b LEFT JOIN documents d ON d.doc_id = b.item_id * 7")
def registry_staleness(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = read(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("now"), F.sha2(F.concat("text", F.lit("x")), 256).alias("other"))
    stored = read(spark, sf_dir, "benchmark").select("item_id", (F.col("item_id") * 7).alias("doc_id")).join(now, "doc_id", "left")
    old = F.when(F.col("item_id") % 3 == 0, F.col("other")).otherwise(F.col("now"))
    return stored.select("item_id", F.when(F.col("now").isNull(), "missing").when(F.col("now") != old, "stale").otherwise("current").alias("state"))


@query("JON27 STR15", "WITH c AS (SELECT doc_id AS claim, doc_id * 3 AS doc_id, 1 + doc_id % 4 AS a, 1 + doc_id % 6 AS b FROM documents), j AS (SELECT c.*, d.text, len(string_split(d.text, chr(10))) AS n FROM c LEFT JOIN documents d USING (doc_id)) SELECT CASE WHEN text IS NULL THEN 'missing file' WHEN a > b THEN 'bad span' WHEN b > n THEN 'past end' WHEN NOT contains(lower(array_to_string(list_slice(string_split(text, chr(10)), a, b), chr(10))), 'the') THEN 'unsupported' ELSE 'valid' END AS verdict, count(*) AS n FROM j GROUP BY 1")
def citation_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    claims = docs.select((F.col("doc_id") * 3).alias("doc_id"), (1 + F.col("doc_id") % 4).cast("int").alias("a"), (1 + F.col("doc_id") % 6).cast("int").alias("b"))
    j = claims.join(docs.select("doc_id", F.split("text", "\n").alias("lines")), "doc_id", "left")
    span = F.lower(F.array_join(F.slice("lines", F.col("a"), F.greatest(F.col("b") - F.col("a") + 1, F.lit(0))), "\n"))
    verdict = F.when(F.col("lines").isNull(), "missing file").when(F.col("a") > F.col("b"), "bad span").when(F.col("b") > F.size("lines"), "past end").when(~span.contains("the"), "unsupported").otherwise("valid")
    return j.groupBy(verdict.alias("verdict")).agg(F.count("*").alias("n"))


@query("RNK17 DTE02", "WITH u AS (SELECT user_id, count(DISTINCT CAST(ts AS DATE)) AS tasks, count(*) FILTER (WHERE event_type = 'error') AS friction, max(ts) AS last_ts, count(DISTINCT event_type) AS systems FROM events GROUP BY user_id) SELECT user_id, CAST(greatest(0, least(100, 30 + CASE WHEN floor((epoch(TIMESTAMP '2024-02-03') - epoch(last_ts)) / 86400) <= 7 THEN 20 ELSE 10 END + least(20, 5 * greatest(0, tasks - 1)) + least(20, 10 * friction) + least(15, 5 * greatest(0, systems - 1)) - CASE WHEN user_id % 5 = 0 THEN 40 ELSE 0 END)) AS BIGINT) AS score FROM u")
def topic_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = read(spark, sf_dir, "events").groupBy("user_id").agg(F.countDistinct(F.to_date("ts")).alias("tasks"), F.count_if(F.col("event_type") == "error").alias("friction"), F.max("ts").alias("last_ts"), F.countDistinct("event_type").alias("systems"))
    days = F.floor((F.unix_timestamp(F.lit("2024-02-03 00:00:00").cast("timestamp")) - F.unix_micros(F.col("last_ts").cast("timestamp")) / 1e6) / 86400)
    score = 30 + F.when(days <= 7, 20).otherwise(10) + F.least(F.lit(20), 5 * F.greatest(F.lit(0), F.col("tasks") - 1)) + F.least(F.lit(20), 10 * F.col("friction")) + F.least(F.lit(15), 5 * F.greatest(F.lit(0), F.col("systems") - 1)) - F.when(F.col("user_id") % 5 == 0, 40).otherwise(0)
    return per.select("user_id", F.greatest(F.lit(0), F.least(F.lit(100), score)).cast("bigint").alias("score"))


@query("MTH03 RNK14", "SELECT p_partkey, round(1 / (1 + exp(-((s - 45) / 15))), 9) AS confidence FROM (SELECT p_partkey, p_size + CASE WHEN p_type = 'PROMO' THEN 20 ELSE 0 END - CASE WHEN contains(p_name, 'bolt') THEN 15 ELSE 0 END + p_partkey % 10 / 10.0 AS s FROM part)")
def skill_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("p_size") + F.when(F.col("p_type") == "PROMO", 20).otherwise(0) - F.when(F.col("p_name").contains("bolt"), 15).otherwise(0) + (F.col("p_partkey") % 10) / 10.0
    return read(spark, sf_dir, "part").select("p_partkey", F.round(1 / (1 + F.exp(-((s - 45) / 15))), 9).alias("confidence"))


@query("STR10 STR13", r"SELECT page_id, len(list_distinct(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1))) AS links, len(regexp_extract_all(html, '<p>')) AS paragraphs FROM pages")
def page_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = F.array_distinct(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1)))
    return read(spark, sf_dir, "pages").select("page_id", F.size(links).cast("bigint").alias("links"), F.size(F.regexp_extract_all("html", F.lit("(<p>)"), F.lit(1))).cast("bigint").alias("paragraphs"))


@query("MTH05", f"WITH {P_SQL} SELECT doc_id, round(least(35, 1200.0 / greatest(tokens, 40)) + 10 / (1 + log2(1 + doc_id % 50)), 9) AS score FROM f")
def evidence_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    density = F.least(F.lit(35.0), 1200.0 / F.greatest(F.col("tokens"), F.lit(40)))
    return files(spark, sf_dir).select("doc_id", F.round(density + 10 / (1 + F.log2(1 + F.col("doc_id") % 50)), 9).alias("score"))


@query("SRT08", f"WITH {P_SQL}, u AS (SELECT 0 AS pri, doc_id AS id, tokens FROM f WHERE doc_id % 11 = 0 UNION ALL SELECT 1, doc_id, tokens FROM f WHERE path LIKE 'tests/%' UNION ALL SELECT 2, doc_id, tokens FROM f WHERE path LIKE 'docs/%') SELECT pri, id, tokens FROM u ORDER BY pri, tokens DESC, id LIMIT 25")
def focus_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = files(spark, sf_dir)
    parts = [f.where(c).select(F.lit(i).alias("pri"), F.col("doc_id").alias("id"), "tokens") for i, c in enumerate(("doc_id % 11 = 0", "path like 'tests/%'", "path like 'docs/%'"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).orderBy("pri", F.desc("tokens"), "id").limit(25)


@query("JON20", "WITH k AS (SELECT p_name AS key, min(p_partkey) AS owner, count(*) AS n FROM part GROUP BY p_name) SELECT p.p_partkey, CASE WHEN k.n = 1 THEN k.owner END AS owner FROM part p LEFT JOIN k ON k.key = p.p_name")
def declared_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that occur twice stay unresolved."""
    part = read(spark, sf_dir, "part").select("p_partkey", "p_name")
    keys = part.groupBy("p_name").agg(F.min("p_partkey").alias("owner"), F.count("*").alias("n")).where("n = 1").drop("n")
    return part.join(keys, "p_name", "left").select("p_partkey", "owner")


@query("RNK18")
def pack_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From scan to receipts: buckets, ordered score, greedy selection and the tokens of each action, for every source."""
    from corpuscle.plans.corpus import bucketed, scored

    open_files = bucketed(spark, sf_dir).where("bucket = 'packable'").select("doc_id")
    rows = scored(spark, sf_dir).select("doc_id", "source", "tokens", "score").join(open_files, "doc_id")
    receipts = selection.greedy_budget(rows, "source", "doc_id", "score", "tokens", 20000)
    return receipts.join(rows.select("doc_id", "tokens"), "doc_id").groupBy("source", "action").agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens"))
