"""Scans, classifiers, term statistics and task matching over the document corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle.functions import classify, secrets, text
from corpuscle.operators import relational as rel
from corpuscle.plans.registry import PATH, REASON, TASK, query, read
from corpuscle.shared import bound_batches, parts_for, table

TOKENS_SQL = "greatest(1, length(text) // 4)"
WORDS_SQL = r"list_filter(string_split_regex(lower(regexp_replace(text, '([a-z0-9])([A-Z])', '\1 \2', 'g')), '[^a-zA-Z0-9]+'), lambda t: t <> '')"


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return docs.select("doc_id", "source", "lang", "text", F.expr(PATH).alias("path"), text.estimate_tokens(F.col("text")).alias("tokens"))


BUCKETS_SQL = f"""SELECT CASE WHEN p LIKE 'dist/%' THEN 'ignored' WHEN p LIKE '%.bin' OR contains(left(text, 1024), chr(1)) THEN 'binary' ELSE 'packable' END AS bucket,
 {TOKENS_SQL} AS tokens, doc_id, source FROM (SELECT *, {PATH} AS p FROM documents)"""


def bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ignore rules first, then the binary test on suffix and first kilobyte."""
    found = files(spark, sf_dir)
    binary = F.col("path").endswith(".bin") | F.contains(F.substring("text", 1, 1024), F.lit("\x01"))
    return found.withColumn("bucket", F.when(F.col("path").startswith("dist/"), "ignored").when(binary, "binary").otherwise("packable"))


@query("SRC01 SRC03 SRC04 STR08", f"SELECT bucket, count(*) AS n_files, CAST(sum(CASE WHEN bucket = 'packable' THEN tokens ELSE 0 END) AS BIGINT) AS tokens, count(*) FILTER (WHERE bucket = 'packable' AND tokens > 1000) AS n_large FROM ({BUCKETS_SQL}) GROUP BY bucket")
def scan_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = F.when(F.col("bucket") == "packable", F.col("tokens")).otherwise(0)
    return bucketed(spark, sf_dir).groupBy("bucket").agg(F.count("*").alias("n_files"), F.sum(own).alias("tokens"), F.count_if(own > 1000).alias("n_large"))


@query("AGG10 FLT07", f"SELECT source, lang, count(*) AS n_files, CAST(sum({TOKENS_SQL}) AS BIGINT) AS tokens FROM documents GROUP BY ROLLUP (source, lang)")
def token_totals_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).rollup("source", "lang").agg(F.count("*").alias("n_files"), F.sum("tokens").alias("tokens"))


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = read(spark, sf_dir, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("hash"))
    changed = F.when(F.col("doc_id") % 11 == 0, F.concat("hash", F.lit("x"))).otherwise(F.col("hash"))
    return docs.where("doc_id % 7 <> 0"), docs.where("doc_id % 5 <> 0").withColumn("hash", changed)


SNAPSHOTS_SQL = """old AS (SELECT doc_id, sha256(coalesce(text, '')) AS hash FROM documents WHERE doc_id % 7 <> 0),
new AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN sha256(coalesce(text, '')) || 'x' ELSE sha256(coalesce(text, '')) END AS hash FROM documents WHERE doc_id % 5 <> 0)"""
DIFF_SQL = f"""WITH {SNAPSHOTS_SQL} SELECT doc_id, CASE WHEN old.hash IS NULL THEN 'added' WHEN new.hash IS NULL THEN 'deleted' WHEN old.hash <> new.hash THEN 'modified' ELSE 'unchanged' END AS status
FROM old FULL JOIN new USING (doc_id)"""


@query("JON01", DIFF_SQL)
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.keyed_diff(*snapshots(spark, sf_dir), "doc_id", "hash")


@query("SRC02 SET01", f"SELECT count(*) FILTER (WHERE status = 'unchanged') AS reused, count(*) FILTER (WHERE status IN ('added', 'modified')) AS rescanned, count(*) FILTER (WHERE status = 'deleted') AS dropped FROM ({DIFF_SQL})")
def incremental_scan_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = snapshots(spark, sf_dir)
    status = rel.keyed_diff(old, new, "doc_id", "hash")
    changed = status.where("status in ('added', 'modified')")
    reused, rescanned = old.join(changed, "doc_id", "left_anti").join(new.select("doc_id"), "doc_id", "left_semi"), new.join(changed, "doc_id", "left_semi")
    counts = [df.agg(F.count("*").alias(name)) for df, name in ((reused, "reused"), (rescanned, "rescanned"), (status.where("status = 'deleted'"), "dropped"))]
    return counts[0].crossJoin(counts[1]).crossJoin(counts[2])  # three single rows


@query("SRC08 SNK02 MTH06", "WITH leaves AS (SELECT source, doc_id // 64 AS leaf, sha256(string_agg(CAST(doc_id AS VARCHAR) || ':' || sha256(coalesce(text, '')), '' ORDER BY doc_id)) AS h FROM documents GROUP BY source, leaf), mid AS (SELECT source, leaf // 64 AS mid, sha256(string_agg(h, '' ORDER BY leaf)) AS h FROM leaves GROUP BY source, mid) SELECT source, sha256(string_agg(h, '' ORDER BY mid)) AS root FROM mid GROUP BY source")
def merkle_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hash tree of fan-out 64 for each source: no level gathers more than its children."""
    docs = read(spark, sf_dir, "documents").select("source", "doc_id", F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.sha2(F.coalesce("text", F.lit("")), 256)).alias("h"))

    def level(df: DataFrame, keys: list[str], order: str) -> DataFrame:
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "h"))), lambda x: x["h"]), "")
        return df.groupBy(*keys).agg(F.sha2(joined, 256).alias("h"))

    leaves = level(docs.withColumn("leaf", F.expr("doc_id div 64")), ["source", "leaf"], "doc_id")
    mid = level(leaves.withColumn("mid", F.expr("leaf div 64")), ["source", "mid"], "leaf")
    return level(mid, ["source"], "mid").withColumnRenamed("h", "root")


@query("AGG03 STR01", f"SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct({WORDS_SQL})) AS term FROM documents) GROUP BY term")
def term_document_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.document_frequency(files(spark, sf_dir), text.ordered_tokens(F.col("text")))


@query("MTH01 AGG03", f"WITH df AS (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct({WORDS_SQL})) AS term FROM documents) GROUP BY term), n AS (SELECT count(*) AS n FROM documents) SELECT term, df, round(greatest(0, least(1, ln((n + 1) / (df + 1)) / ln(n + 1.0))), 9) AS rarity FROM df, n")
def term_rarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = files(spark, sf_dir)
    total = docs.agg(F.count("*").alias("n"))
    return rel.document_frequency(docs, text.ordered_tokens(F.col("text"))).crossJoin(F.broadcast(total)).select("term", "df", F.round(rel.rarity(F.col("n"), F.col("df")), 9).alias("rarity"))


@query("STR03", f"WITH t AS (SELECT doc_id, {WORDS_SQL} AS t FROM documents), b AS (SELECT unnest(list_distinct(list_transform(generate_series(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1]))) AS bigram FROM t) SELECT bigram, count(*) AS df FROM b GROUP BY bigram")
def bigram_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases meet uncombined: a map of all phrases of a task's texts would grow with its share of the table."""
    found = files(spark, sf_dir).select(F.explode_outer(text.text_bigrams(F.col("text"))).alias("bigram")).where("bigram is not null")
    return found.repartition(parts_for(spark, table(spark, sf_dir, "documents")), "bigram").groupBy("bigram").agg(F.count("*").alias("df"))


def rarity_by_workspace(docs: DataFrame, items: Column, name: str) -> DataFrame:
    """(source, item, df, rarity) of every item for each source, and for all of them under a null source; only documents with terms count.

    docs(source, text). Counts for all sources are sums of those of each, which both
    branches read from one shuffle. How many documents have a term is told by a single
    search in each text. The outer explode infers no filter that would cut texts
    into terms a second time.
    """
    source = F.coalesce("source", F.lit("(root)")).alias("source")
    each = docs.select(source, F.explode_outer(items).alias(name)).groupBy("source", name).agg(F.count("*").alias("df"))
    n = docs.where(F.col("text").rlike("[a-zA-Z0-9]")).select(source).groupBy("source").agg(F.count("*").alias("n"))  # a row for each source
    every = n.agg(F.sum("n").alias("n")).where("n is not null")
    rarity = F.round(rel.rarity(F.col("n"), F.col("df")), 9).alias("rarity")
    own = each.join(n, "source").where(F.col(name).isNotNull()).select("source", name, "df", rarity)
    total = each.groupBy(name).agg(F.sum("df").alias("df")).where(F.col(name).isNotNull()).crossJoin(F.broadcast(every))  # one row
    return own.unionByName(total.select(F.lit(None).cast("string").alias("source"), name, "df", rarity))


RARITY_SQL = f"""WITH d AS (SELECT coalesce(source, '(root)') AS source, list_distinct({WORDS_SQL}) AS t FROM documents), k AS (SELECT * FROM d WHERE len(t) > 0),
n AS (SELECT source, count(*) AS n FROM k GROUP BY GROUPING SETS ((), (source))), x AS (SELECT source, term, count(*) AS df FROM (SELECT source, unnest(t) AS term FROM k) GROUP BY GROUPING SETS ((term), (source, term)))
SELECT x.source, term, df, round(CASE WHEN n <= 1 THEN 1 ELSE greatest(0, least(1, ln((n + 1) / (df + 1)) / ln(n + 1.0))) END, 9) AS rarity FROM x JOIN n ON x.source IS NOT DISTINCT FROM n.source"""


@query("AGG03 MTH02", RARITY_SQL)
def workspace_rarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rarity_by_workspace(files(spark, sf_dir).select("source", "text"), F.array_distinct(text.ordered_tokens(F.col("text"))), "term")


BIGRAM_RARITY_SQL = f"""WITH d AS (SELECT coalesce(source, '(root)') AS source, {WORDS_SQL} AS w FROM documents), k AS (SELECT source, list_distinct(list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1])) AS t FROM d WHERE len(w) > 0),
n AS (SELECT source, count(*) AS n FROM k GROUP BY GROUPING SETS ((), (source))), x AS (SELECT source, bigram, count(*) AS df FROM (SELECT source, unnest(t) AS bigram FROM k) GROUP BY GROUPING SETS ((bigram), (source, bigram)))
SELECT x.source, bigram, df, round(CASE WHEN n <= 1 THEN 1 ELSE greatest(0, least(1, ln((n + 1) / (df + 1)) / ln(n + 1.0))) END, 9) AS rarity FROM x JOIN n ON x.source IS NOT DISTINCT FROM n.source"""


@query("AGG03 STR03 MTH02", BIGRAM_RARITY_SQL)
def workspace_bigram_rarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rarity_by_workspace(files(spark, sf_dir).select("source", "text"), text.text_bigrams(F.col("text")), "bigram")


STOP_SQL = "[" + ", ".join(f"'{w}'" for w in text.STOPWORDS) + "]"


def terms_sql(column: str) -> str:
    return f"list_filter(string_split_regex(lower({column}), '[^a-z0-9]+'), lambda w: length(w) >= 3 AND NOT list_contains({STOP_SQL}, w))"


@query("STR02", f"SELECT item_id, len(t) AS n_terms, array_to_string(t, ' ') AS terms FROM (SELECT item_id, {terms_sql('text')} AS t FROM benchmark)")
def task_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = text.task_terms(F.col("text"))
    return read(spark, sf_dir, "benchmark").select("item_id", F.size(terms).cast("bigint").alias("n_terms"), F.array_join(terms, " ").alias("terms"))


MATCH_SQL = f"""WITH q AS (SELECT item_id, unnest(list_distinct({terms_sql('text')})) AS term FROM benchmark),
d AS (SELECT doc_id, unnest(list_distinct({WORDS_SQL})) AS term FROM documents), n AS (SELECT count(*) AS n FROM documents),
df AS (SELECT term, count(*) AS df FROM d GROUP BY term),
w AS (SELECT term, greatest(0, least(1, ln((n + 1) / (df + 1)) / ln(n + 1.0))) * 0.7 + 0.55 AS w FROM df, n),
s AS (SELECT item_id, doc_id, count(*) AS hits, sum(CAST(round(w * 1e6) AS BIGINT)) AS score FROM q JOIN d USING (term) JOIN w USING (term) GROUP BY item_id, doc_id)"""


#: Rows of (item, term) that are sent to every task; beyond it the join shuffles.
BROADCAST_ASKED = 200_000


def task_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, doc_id, hits, score): documents that share terms with an item, weights in millionths.

    Only terms that an item asks for are shuffled, by document: a document's terms lie
    together, so scores are summed where they are, no term is a key, and what leaves a
    task are its best rows of each item. Beyond BROADCAST_ASKED the terms themselves meet.
    Scores are summed in partitions that follow the table's size.
    """
    docs = files(spark, sf_dir)
    wanted = read(spark, sf_dir, "benchmark").select("item_id", F.explode(F.array_distinct(text.task_terms(F.col("text")))).alias("term"))
    held = docs.select("doc_id", F.explode(F.array_distinct(text.ordered_tokens(F.col("text")))).alias("term")).join(wanted.select("term").distinct(), "term", "left_semi")
    few = wanted.count() <= BROADCAST_ASKED
    parts = parts_for(spark, table(spark, sf_dir, "documents"))
    held = held.repartition(parts, "doc_id") if few else held
    total = docs.agg(F.count("*").alias("n"))
    weight = held.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(total)).select("term", F.round((rel.rarity(F.col("n"), F.col("df")) * 0.7 + 0.55) * 1e6).cast("bigint").alias("w"))
    asked = wanted.join(weight, "term")
    met = held.join(F.broadcast(asked), "term") if few else held.join(asked, "term").repartition(parts, "item_id", "doc_id")
    return met.groupBy("item_id", "doc_id").agg(F.count("*").alias("hits"), F.sum("w").alias("score"))


@query("COL01 RNK01 SRT01", MATCH_SQL + "SELECT item_id, doc_id, hits, CAST(score AS BIGINT) AS score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s QUALIFY rank <= 10")
def task_match_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = rel.top_per_group(task_matches(spark, sf_dir), ["item_id"], [F.desc("score"), F.col("doc_id")], 10)
    return top.withColumn("rank", F.col("rank").cast("bigint"))


SCORE_SQL = f"""SELECT doc_id, p, CASE WHEN p LIKE 'dist/%' OR p LIKE '%.bin' THEN -100 ELSE
 (CASE WHEN p LIKE 'docs/%' THEN 0.5 ELSE 1 END) * (CASE WHEN doc_id % 11 = 0 THEN 100 ELSE 0 END + CASE WHEN contains(lower(p), 'service') THEN 60 ELSE 0 END + CASE WHEN contains(lower(text), 'ation') THEN 20 ELSE 0 END)
 + CASE WHEN p LIKE 'tests/%' AND doc_id % 11 = 0 THEN 30 ELSE 0 END END AS score FROM (SELECT *, {PATH} AS p FROM documents)"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Additive clauses, then a dampener that multiplies what came before it, then a later clause: order is meaning."""
    found = files(spark, sf_dir)
    flag = lambda c, v: F.when(c, F.lit(v)).otherwise(F.lit(0.0))
    changed, p = F.col("doc_id") % 11 == 0, F.col("path")
    added = flag(changed, 100.0) + flag(F.contains(F.lower(p), F.lit("service")), 60.0) + flag(F.contains(F.lower("text"), F.lit("ation")), 20.0)
    damped = added * F.when(p.startswith("docs/"), 0.5).otherwise(1.0)
    score = F.when(p.startswith("dist/") | p.endswith(".bin"), F.lit(-100.0)).otherwise(damped + flag(p.startswith("tests/") & changed, 30.0))
    return found.withColumn("score", score).withColumn("changed", changed)


@query("RNK01 RNK02", f"SELECT doc_id, p AS path, CAST(score AS DOUBLE) AS score FROM ({SCORE_SQL})")
def task_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select("doc_id", "path", "score")


ROUTE_SQL = f"""WITH s AS (SELECT doc_id, p AS path, doc_id % 11 = 0 AS changed, CAST(score AS DOUBLE) AS score FROM ({SCORE_SQL})), n AS (SELECT greatest(48, least(120, 32 + 4 * greatest(1, count(*)))) AS n FROM documents WHERE doc_id % 11 = 0),
r AS (SELECT *, row_number() OVER (ORDER BY changed DESC, score DESC, path DESC, doc_id DESC) AS rank FROM s) SELECT doc_id, CASE WHEN rank <= n THEN score ELSE 1000 END AS score, CASE WHEN rank <= n THEN rank END AS rank FROM r, n WHERE rank <= n OR changed"""


@query("SRT02 RNK09", ROUTE_SQL)
def route_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rows of one order, as many as the changed rows allow, and the changed rows that the limit left out, at a score of 1000."""
    from pyspark.sql import Window

    found = scored(spark, sf_dir).select("doc_id", "path", "score", "changed")
    changed = read(spark, sf_dir, "documents").where("doc_id % 11 = 0").agg(F.greatest(F.lit(48), F.least(F.lit(120), 32 + 4 * F.greatest(F.lit(1), F.count("*")))).alias("n"))  # one row
    order = [F.desc("changed"), F.desc("score"), F.desc("path"), F.desc("doc_id")]
    top = found.orderBy(*order).limit(120).withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("bigint"))  # at most 120 rows
    top = top.crossJoin(F.broadcast(changed)).where("rank <= n").select("doc_id", "score", "rank")
    missed = found.where("changed").select("doc_id").join(F.broadcast(top.select("doc_id")), "doc_id", "left_anti")
    return top.unionByName(missed.select("doc_id", F.lit(1000.0).alias("score"), F.lit(None).cast("bigint").alias("rank")))


DOMAINS = [("grammar", ["the", "and", "of", "that"]), ("romance", ["les", "la", "el", "de"]), ("german", ["der", "die", "und", "ein"]), ("endings", ["ing", "tion", "er", "ed"])]


@query("MTH04", f"""WITH dom(domain, term) AS (VALUES {', '.join(f"('{d}', '{t}')" for d, ts in DOMAINS for t in ts)}), tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({WORDS_SQL}) AS term FROM documents) GROUP BY doc_id, term),
n AS (SELECT count(DISTINCT domain) AS n FROM dom), df AS (SELECT term, count(DISTINCT domain) AS df FROM dom GROUP BY term)
SELECT doc_id, domain, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.2) / (tf + 1.2)), 6) AS score FROM dom JOIN tf USING (term) JOIN df USING (term), n GROUP BY doc_id, domain""")
def bm25_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    dom = spark.createDataFrame([(d, t) for d, ts in DOMAINS for t in ts], "domain string, term string")
    df = dom.groupBy("term").agg(F.countDistinct("domain").alias("df"))
    lexicon = dom.join(df, "term").withColumn("n", F.lit(len(DOMAINS)))
    words = files(spark, sf_dir).select("doc_id", F.explode(text.ordered_tokens(F.col("text"))).alias("term")).join(F.broadcast(lexicon.select("term").distinct()), "term", "left_semi")
    tf = words.groupBy("doc_id", "term").agg(F.count("*").alias("tf"))
    return tf.join(F.broadcast(lexicon), "term").groupBy("doc_id", "domain").agg(F.round(F.sum(rel.bm25(F.col("tf"), F.col("df"), F.col("n"))), 6).alias("score"))


PARTS = "list_filter(string_split(lower(p), '/'), lambda x: x <> '')"
NAME = f"{PARTS}[-1]"


def _any(*names: str) -> str:
    return f"list_has_any({PARTS}, [{', '.join(repr(n) for n in names)}])"


FAMILY_SQL = rf"""CASE WHEN {_any('docs', 'doc')} OR {NAME} LIKE 'readme%' OR regexp_matches({NAME}, '[^.]\.(md|mdx|rst)$') THEN 'docs'
 WHEN {_any('fixtures', 'fixture')} THEN 'fixtures' WHEN {_any('examples', 'example', 'samples', 'templates')} THEN 'examples' WHEN {_any('test', 'tests', 'spec', 'e2e')} THEN 'test'
 WHEN {_any('dist', 'build', 'generated')} THEN 'generated' WHEN regexp_matches({NAME}, '(\.test\.tsx?|\.spec\.tsx?|_test\.go|_test\.py)$') THEN 'test'
 WHEN regexp_matches({NAME}, '[^.]\.(toml|yaml|yml|json|ini|cfg)$') THEN 'config' WHEN regexp_matches({NAME}, '[^.]\.(py|ts|tsx|js|jsx|go|java)$') THEN 'source' ELSE 'other' END"""


@query("FLT05", f"SELECT {FAMILY_SQL} AS family, count(*) AS n, CAST(sum({TOKENS_SQL}) AS BIGINT) AS tokens FROM (SELECT *, {PATH} AS p FROM documents) GROUP BY family")
def path_family_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).groupBy(classify.path_family(F.col("path")).alias("family")).agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens"))


REASON_SQL = f"""CASE doc_id % 9 WHEN 0 THEN 'filename' WHEN 1 THEN 'symbol' WHEN 2 THEN 'content' WHEN 3 THEN 'semantic' WHEN 4 THEN 'graph' WHEN 5 THEN 'history' WHEN 6 THEN 'metadata' WHEN 7 THEN 'summary' ELSE 'other' END"""


@query("FLT06 AGG12", f"SELECT {REASON_SQL} AS family, count(*) AS selected, count(*) FILTER (WHERE quality = 1) AS expected, count(*) FILTER (WHERE quality = 1) / count(*) AS precision FROM documents JOIN labels USING (doc_id) GROUP BY family")
def reason_family_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents").select("doc_id", F.expr(REASON).alias("reason")).join(read(spark, sf_dir, "labels"), "doc_id")
    hit = F.count_if(F.col("quality") == 1)
    return rows.groupBy(classify.reason_family(F.col("reason")).alias("family")).agg(F.count("*").alias("selected"), hit.alias("expected"), (hit / F.count("*")).alias("precision"))


MODULE_SQL = "CASE WHEN regexp_matches(p, '^(src|tests|docs|apps|packages|services|libs)/.') THEN string_split(p, '/')[1] || '/' || string_split(p, '/')[2] ELSE string_split(p, '/')[1] END"


@query("FLT07 AGG10 AGG11", f"SELECT {MODULE_SQL} AS module, doc_id, {TOKENS_SQL} AS tokens, row_number() OVER (PARTITION BY {MODULE_SQL} ORDER BY {TOKENS_SQL} DESC, doc_id) AS rank FROM (SELECT *, {PATH} AS p FROM documents) QUALIFY rank <= 8")
def module_rollup_top_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = files(spark, sf_dir).select(classify.module_of(F.col("path")).alias("module"), "doc_id", "tokens")
    return rel.top_per_group(rows, ["module"], [F.desc("tokens"), F.col("doc_id")], 8).withColumn("rank", F.col("rank").cast("bigint"))


@query("AGG10 FLT07", rf"""SELECT CASE WHEN contains(regexp_replace({NAME}, '\.[^./]*$', ''), 'config') THEN 'config' WHEN regexp_matches({NAME}, '[^.]\.(md|rst|txt)$') THEN 'doc'
 WHEN {_any('test', 'tests', 'spec', 'specs')} OR {NAME} LIKE 'test\_%' ESCAPE '\' OR regexp_matches(regexp_replace({NAME}, '\.[^./]*$', ''), '(_test|\.test)$') THEN 'test'
 WHEN regexp_matches(regexp_replace({NAME}, '\.[^./]*$', ''), 'main|app|cli|server|index|routes|router|api') THEN 'entrypoint' ELSE 'file' END AS category, count(*) AS n, min(doc_id) AS first FROM (SELECT *, {PATH} AS p FROM documents) GROUP BY category""")
def semantic_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).groupBy(classify.category(F.col("path")).alias("category")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))


@query("FLT10 SRT05", f"""SELECT CASE WHEN regexp_matches({REASON}, 'caller') OR regexp_matches(lower(p), '^tests?/|/tests/|route|controller|api/|schema|migration|model') THEN 'high'
 WHEN regexp_matches(lower({REASON}), 'direct dependency|config') OR regexp_matches(lower(p), 'config|\\.env|deploy|settings') OR {TOKENS_SQL} > 150 THEN 'medium' ELSE 'low' END AS risk, count(*) AS n FROM (SELECT *, {PATH} AS p FROM documents) GROUP BY risk""")
def omission_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = files(spark, sf_dir).withColumn("reasons", F.array(F.expr(REASON)))
    return rows.groupBy(classify.omission_risk(F.col("path"), F.col("reasons"), F.col("tokens")).alias("risk")).agg(F.count("*").alias("n"))


@query("FLT13 STR06", f"SELECT CASE doc_id % 8 WHEN 0 THEN 'fix' WHEN 3 THEN 'docs' END AS kind, CASE doc_id % 8 WHEN 0 THEN 'auth' WHEN 3 THEN '' END AS scope, count(*) AS n FROM documents GROUP BY 1, 2")
def commit_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = read(spark, sf_dir, "documents").select(text.conventional_commit(F.expr(TASK)).alias("c"))
    return parsed.groupBy(F.col("c.kind").alias("kind"), F.col("c.scope").alias("scope")).agg(F.count("*").alias("n"))


def _kind_sql() -> str:
    counts = [(k, " + ".join(f"CAST(contains(t, '{s}') AS INT)" for s in signals)) for k, signals in classify.TASK_KINDS]
    rows = " UNION ALL ".join(f"SELECT doc_id, '{k}' AS kind, {len(counts) - i} AS pri, {c} AS n FROM t" for i, (k, c) in enumerate(counts))
    return f"WITH t AS (SELECT doc_id, lower({TASK}) AS t FROM documents), k AS ({rows}), b AS (SELECT doc_id, arg_max(kind, n * 100 + pri) AS kind, sum(n) AS total FROM k GROUP BY doc_id) SELECT CASE WHEN total = 0 THEN 'general' ELSE kind END AS kind, count(*) AS n FROM b GROUP BY 1"


@query("FLT13", _kind_sql())
def task_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").groupBy(classify.task_kind(F.expr(TASK))["kind"].alias("kind")).agg(F.count("*").alias("n"))


@query("FLT14", "SELECT CASE doc_id % 8 WHEN 1 THEN 'review' WHEN 4 THEN 'audit' WHEN 5 THEN 'share' WHEN 7 THEN 'repo_overview' ELSE 'coding_task' END AS intent, count(*) AS n FROM documents GROUP BY 1")
def intent_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").groupBy(classify.context_intent(F.expr(TASK)).alias("intent")).agg(F.count("*").alias("n"))


@query("STR14", r"WITH u AS (SELECT page_id, regexp_extract(regexp_replace(url, '^(https?://)([^/]+)/', '\1\2/api/'), '/api/[A-Za-z0-9_./${}\[\]-]+') AS a FROM pages) SELECT page_id, regexp_replace(a, '[/,;)]+$', '') AS api_path FROM u")
def api_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.regexp_replace("url", "^(https?://)([^/]+)/", "$1$2/api/")
    return read(spark, sf_dir, "pages").select("page_id", text.api_path(url).alias("api_path"))


PREFIXES = ["en", "en/1", "fr", "de/2", "es", "en/12"]


@query("JON14", rf"""WITH p AS (SELECT page_id, regexp_replace(regexp_extract(url, '^https?://[^/]+/([a-z]+/[0-9])', 1), '/([0-9])', '/\1') AS path FROM pages), x(prefix) AS (VALUES {', '.join(f"('{x}')" for x in PREFIXES)})
SELECT page_id, path, (SELECT arg_max(prefix, length(prefix)) FROM x WHERE p.path = prefix OR starts_with(p.path, prefix || '/')) AS workspace FROM p""")
def longest_prefix_workspace(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^https?://[^/]+/([a-z]+/[0-9])", 1).alias("path"))
    return rel.longest_prefix(pages, "path", spark.createDataFrame([(p,) for p in PREFIXES], "workspace string"), "workspace").select("page_id", "path", "workspace")


@query("AGG28", "WITH l AS (SELECT doc_id, trim(unnest(string_split(text, chr(10)))) AS line FROM documents) SELECT doc_id, line, count(*) AS n FROM l WHERE line <> '' GROUP BY doc_id, line HAVING count(*) > 1")
def repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line")).select("doc_id", F.trim("line").alias("line"))
    return lines.where("line <> ''").groupBy("doc_id", "line").agg(F.count("*").alias("n")).where("n > 1")


@query("AGG28", "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents), f AS (SELECT doc_id, line, min(pos) AS pos FROM l WHERE regexp_matches(line, '(?i)error|license|rights|password|token') GROUP BY doc_id, line) SELECT doc_id, line, pos - 1 AS pos FROM f QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY pos) <= 40")
def output_compression_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 40 distinct lines of interest of every text, with their places."""
    lines = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).where(F.col("line").rlike("(?i)error|license|rights|password|token"))
    firsts = lines.groupBy("doc_id", "line").agg(F.min("pos").cast("bigint").alias("pos"))
    return rel.top_per_group(firsts, ["doc_id"], [F.col("pos")], 40).drop("rank")


@query("STR20 DTE05 MTH06", "SELECT item_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS task, left(sha256(trim(regexp_replace(text, '\\s+', ' ', 'g'))), 16) AS task_hash FROM benchmark")
def task_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    task = text.normalized(F.col("text"))
    return read(spark, sf_dir, "benchmark").select("item_id", task.alias("task"), F.substring(F.sha2(task, 256), 1, 16).alias("task_hash"))


GENERIC_SQL = "[" + ", ".join(f"'{w}'" for w in text.GENERIC_TERMS) + "]"


@query("STR05", rf"WITH w AS (SELECT unnest(list_distinct(string_split_regex(lower(text), '[^a-z]+'))) AS word FROM documents) SELECT DISTINCT word, CASE WHEN list_contains({GENERIC_SQL}, word) THEN NULL WHEN word LIKE '%ies' AND length(word) > 5 THEN left(word, length(word) - 3) || 'y' WHEN regexp_matches(word, '(sses|xes|ches|shes)$') AND length(word) > 5 THEN left(word, length(word) - 2) WHEN word LIKE '%s' AND NOT regexp_matches(word, '(ss|us|is)$') THEN left(word, length(word) - 1) END AS singular FROM w WHERE length(word) >= 5 AND word LIKE '%s'")
def singular_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = read(spark, sf_dir, "documents").select(F.explode(F.array_distinct(F.split(F.lower("text"), "[^a-z]+"))).alias("word")).where("length(word) >= 5 and word like '%s'").distinct()
    return words.select("word", text.singular(F.col("word")).alias("singular"))


@query("STR04", f"SELECT doc_id % 8 AS kind, CASE doc_id % 8 WHEN 2 THEN 'order index|user service' ELSE '' END AS phrases, count(*) AS n FROM documents GROUP BY 1, 2")
def literal_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents").select((F.col("doc_id") % 8).alias("kind"), F.array_join(text.literal_phrases(F.expr(TASK)), "|").alias("phrases"))
    return rows.groupBy("kind", "phrases").agg(F.count("*").alias("n"))


@query("STR07", r"SELECT doc_id, regexp_replace(regexp_replace(text, 'AKIA[0-9A-Z]{16}', '[REDACTED:aws-access-key]', 'g'), '((?i)(?:api[_-]?key|token|secret|password|passwd|auth[_-]?key)\s*[=:]\s*[\"'']?\s*)[A-Za-z0-9+/\-_]{40,}', '\1[REDACTED:api-key]', 'g') AS text FROM documents")
def secret_redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patterns in a fixed order: an earlier one wins where two overlap, and placeholders stay."""
    bound_batches(spark)
    return read(spark, sf_dir, "documents").select("doc_id", secrets.redacted("text")["text"].alias("text"))


@query("STR07")
def secret_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each secret, in the order of the patterns; no SQL form, tested on a small fixture."""
    bound_batches(spark)
    found = files(spark, sf_dir).select("doc_id", "path", F.posexplode(secrets.found("text")).alias("pos", "w"))
    said = F.concat("path", F.lit(": "), "w.label", F.lit(" detected (line "), F.col("w.line").cast("string"), F.lit(")"))
    return found.select("doc_id", "pos", "w.label", "w.line", said.alias("warning"))
