"""Change history, event logs and threads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuscle.operators import overlap
from corpuscle.operators import relational as rel
from corpuscle.plans.registry import query, read
from corpuscle.shared import parts_for

CHANGES_SQL = "changes AS (SELECT o_orderkey AS commit_id, o_orderdate AS ts, l_partkey AS path FROM orders JOIN lineitem ON o_orderkey = l_orderkey)"
RECENT_SQL = "recent AS (SELECT o_orderkey AS commit_id, o_orderdate AS ts FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 200)"


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(commit_id, ts, path): a commit is an order, a changed path one of its parts.

    Both meet by commit in as many partitions as the table's size asks for, so that what
    a task sorts and counts stays the same however large the history is.
    """
    lines = read(spark, sf_dir, "lineitem")
    parts = parts_for(spark, lines)
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("commit_id"), F.col("o_orderdate").alias("ts")).repartition(parts, "commit_id")
    return orders.join(lines.select(F.col("l_orderkey").alias("commit_id"), F.col("l_partkey").alias("path")).repartition(parts, "commit_id"), "commit_id")


def recent_commits(spark: SparkSession, sf_dir: str, n: int = 200) -> DataFrame:
    """The last n commits in log order."""
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("commit_id"), F.col("o_orderdate").alias("ts")).orderBy(F.desc("ts"), F.desc("commit_id")).limit(n)


@query("SRC06 SRC07", f"WITH {RECENT_SQL} SELECT commit_id, l_partkey AS path, count(*) AS n FROM recent JOIN lineitem ON commit_id = l_orderkey GROUP BY commit_id, l_partkey")
def recently_modified(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("commit_id"), F.col("l_partkey").alias("path"))
    return lines.join(F.broadcast(recent_commits(spark, sf_dir).select("commit_id")), "commit_id").groupBy("commit_id", "path").agg(F.count("*").alias("n"))


@query("SRC12", f"WITH {CHANGES_SQL} SELECT commit_id, count(DISTINCT path) AS n_paths FROM changes WHERE path % 10 <> 0 GROUP BY commit_id, ts HAVING count(DISTINCT path) <= 4 ORDER BY ts DESC, commit_id DESC LIMIT 50")
def history_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest 50 commits that change at most four allowed paths."""
    per = changes(spark, sf_dir).where("path % 10 <> 0").groupBy("commit_id", "ts").agg(F.countDistinct("path").alias("n_paths")).where("n_paths <= 4")
    return per.orderBy(F.desc("ts"), F.desc("commit_id")).limit(50).select("commit_id", "n_paths")


@query("AGG01", f"WITH {CHANGES_SQL}, c AS (SELECT path, count(DISTINCT commit_id) AS churn FROM changes GROUP BY path), t AS (SELECT max(churn) AS edge FROM (SELECT churn, row_number() OVER (ORDER BY churn DESC) AS r, count(*) OVER () AS n FROM c) WHERE r = greatest(1, n // 10)) SELECT path, churn FROM c, t WHERE churn >= edge")
def churn_top_decile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths at or above the value at a tenth of the ranked counts; ranks come from a histogram of counts."""
    churn = changes(spark, sf_dir).groupBy("path").agg(F.countDistinct("commit_id").alias("churn"))
    histogram = churn.groupBy("churn").agg(F.count("*").alias("n"))
    reach = histogram.select("churn", F.sum("n").over(Window.orderBy(F.desc("churn")).rowsBetween(Window.unboundedPreceding, 0)).alias("upto"), F.sum("n").over(Window.partitionBy()).alias("total"))
    edge = reach.where("upto >= greatest(1, total div 10)").agg(F.max("churn").alias("edge"))
    return churn.crossJoin(F.broadcast(edge)).where("churn >= edge").select("path", "churn")


@query("AGG02 RNK04", f"WITH {CHANGES_SQL}, seeds AS (SELECT p_partkey FROM part WHERE p_size <= 10), s AS (SELECT DISTINCT commit_id FROM changes WHERE path IN (FROM seeds)) SELECT path, count(DISTINCT commit_id) AS n FROM changes WHERE commit_id IN (FROM s) AND path NOT IN (FROM seeds) GROUP BY path")
def co_changed_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each path was changed together with a small part."""
    seeds = read(spark, sf_dir, "part").where("p_size <= 10").select(F.col("p_partkey").alias("path"))
    return rel.co_changed(changes(spark, sf_dir).drop("ts"), seeds, "commit_id", "path")


NOISE_SQL = "least(45, 6 * n + 4 * greatest(0, n - 2))"


@query("AGG05 RNK04", f"WITH e AS (SELECT user_id AS path, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY user_id) SELECT path, n, CAST({NOISE_SQL} AS BIGINT) AS penalty, n >= 6 AS suppressed FROM e")
def noise_history_penalty(spark: SparkSession, sf_dir: str) -> DataFrame:
    noise = read(spark, sf_dir, "events").where("event_type = 'error'").groupBy(F.col("user_id").alias("path")).agg(F.count("*").alias("n"))
    return noise.select("path", "n", F.expr(NOISE_SQL).cast("bigint").alias("penalty"), (F.col("n") >= 6).alias("suppressed"))


@query("AGG04", "WITH c AS (SELECT user_id AS term, count(*) FILTER (WHERE value >= 60) AS good, count(*) FILTER (WHERE value <= 20) AS bad FROM events GROUP BY user_id) SELECT term, good, bad, CASE WHEN good >= 2 AND good >= greatest(2, 2 * bad) THEN 'positive' WHEN bad >= 2 AND bad > greatest(1, 2 * good) THEN 'ambiguous' ELSE 'none' END AS kind FROM c")
def learned_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = read(spark, sf_dir, "events").groupBy(F.col("user_id").alias("term")).agg(F.count_if(F.col("value") >= 60).alias("good"), F.count_if(F.col("value") <= 20).alias("bad"))
    kind = F.when(F.expr("good >= 2 and good >= greatest(2, 2 * bad)"), "positive").when(F.expr("bad >= 2 and bad > greatest(1, 2 * good)"), "ambiguous").otherwise("none")
    return counts.withColumn("kind", kind)


@query("AGG06", "SELECT event_type, count(*) AS n, round(sum(CASE WHEN event_type = 'purchase' THEN value ELSE 0 END), 4) AS packed, greatest(0, round(sum(CASE WHEN event_type IN ('purchase', 'view') THEN value ELSE 0 END), 4) - round(sum(CASE WHEN event_type = 'purchase' THEN value ELSE 0 END), 4)) AS saved, min(ts) AS first_ts, max(ts) AS last_ts FROM events GROUP BY event_type")
def event_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = F.round(F.sum(F.when(F.col("event_type") == "purchase", F.col("value")).otherwise(0)), 4)
    raw = F.round(F.sum(F.when(F.col("event_type").isin("purchase", "view"), F.col("value")).otherwise(0)), 4)
    return read(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), packed.alias("packed"), F.greatest(F.lit(0.0), raw - packed).alias("saved"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query("SRC09 SRC10 SNK01 SNK09", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE json_valid(props) QUALIFY row_number() OVER (ORDER BY ts DESC, event_id DESC) <= 500")
def event_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last 500 well-formed records, one per id, payload read from JSON."""
    parsed = read(spark, sf_dir, "events").select("event_id", "ts", F.from_json("props", "k bigint").alias("p")).where("p is not null")
    once = rel.latest(parsed, ["event_id"], ["ts"])
    return once.orderBy(F.desc("ts"), F.desc("event_id")).limit(500).select("event_id", "p.k")


@query("WIN01 STM07", "SELECT user_id, event_id, event_type FROM events WHERE event_type <> 'signup' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_thread_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finished rows are dropped before the fold, so an older active row of a finished thread survives."""
    active = read(spark, sf_dir, "events").where("event_type <> 'signup'").select("user_id", "event_id", "event_type", "ts")
    return rel.latest(active, ["user_id"], ["ts", "event_id"]).drop("ts")


@query("WIN02 STM05", "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(value, (ts, event_id)) AS value FROM events WHERE event_type = 'purchase' GROUP BY user_id")
def event_fold_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = read(spark, sf_dir, "events").where("event_type = 'purchase'").select("user_id", "event_id", "value", "ts")
    return rel.latest(own, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "value")


@query("JON17", """WITH t AS (SELECT DISTINCT user_id AS thread, user_id % 7 AS worktree, CAST(json_extract_string(props, '$.k') AS BIGINT) AS file FROM events WHERE event_type = 'click'),
p AS (SELECT a.thread AS a, b.thread AS b, count(*) AS overlap FROM t a JOIN t b ON a.worktree = b.worktree AND a.file = b.file AND a.thread < b.thread GROUP BY 1, 2) SELECT a, b, overlap FROM p""")
def thread_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Threads of a worktree that share a file at least, and how many they share."""
    own = read(spark, sf_dir, "events").where("event_type = 'click'").select(F.col("user_id").alias("thread"), (F.col("user_id") % 7).alias("worktree"), F.get_json_object("props", "$.k").cast("bigint").alias("file"))
    return overlap.shared_items(own, "worktree", "thread", "file").select("a", "b", "overlap")


@query("STM01", """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS island FROM g) SELECT user_id, min(ts) AS session_start, max(ts) AS session_end, count(*) AS n FROM i GROUP BY user_id, island""")
def session_debounce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.sessions(read(spark, sf_dir, "events"), ["user_id"], "ts", 1800)


@query("WIN03 SET02", f"""WITH {CHANGES_SQL}, c AS (SELECT DISTINCT o_custkey AS task, o_orderkey AS run, o_orderdate AS ts FROM orders), p AS (SELECT *, lag(run) OVER (PARTITION BY task ORDER BY ts, run) AS prev FROM c),
h AS (SELECT p.task, p.run, count(*) FILTER (WHERE b.path IS NOT NULL) AS hits, count(*) AS predicted FROM p JOIN (SELECT DISTINCT commit_id, path FROM changes) a ON a.commit_id = p.prev LEFT JOIN (SELECT DISTINCT commit_id, path FROM changes) b ON b.commit_id = p.run AND b.path = a.path GROUP BY 1, 2) SELECT * FROM h""")
def accuracy_vs_previous_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("task"), F.col("o_orderkey").alias("run"), F.col("o_orderdate").alias("ts"))
    prev = runs.withColumn("prev", F.lag("run").over(Window.partitionBy("task").orderBy("ts", "run"))).where("prev is not null")
    paths = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("commit"), F.col("l_partkey").alias("path")).distinct()
    predicted = prev.join(paths.withColumnRenamed("commit", "prev"), "prev")
    actual = paths.select(F.col("commit").alias("run"), "path", F.lit(1).alias("hit"))
    return predicted.join(actual, ["run", "path"], "left").groupBy("task", "run").agg(F.count("hit").alias("hits"), F.count("*").alias("predicted"))


@query("WIN04 RNK06", "SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 6) AS moving FROM events WHERE value IS NOT NULL")
def rolling_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-9, 0)
    return read(spark, sf_dir, "events").where("value is not null").select("event_id", F.round(F.avg("value").over(w), 6).alias("moving"))


@query("AGG09 AGG18 AGG30", "SELECT user_id, count(*) AS n, round(avg(value), 6) AS mean, avg(value) >= 50 AS passed FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 10) GROUP BY user_id")
def last_ten_averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    tail = rel.top_per_group(read(spark, sf_dir, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 10)
    return tail.groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), (F.avg("value") >= 50).alias("passed"))


@query("AGG17 AGG23", "SELECT event_type, user_id, count(*) AS n, CAST(least(0.95, 0.5 + 0.05 * count(*)) AS DOUBLE) AS confidence FROM events GROUP BY event_type, user_id QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY count(*) DESC, user_id) <= 5")
def frequent_insights(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = read(spark, sf_dir, "events").groupBy("event_type", "user_id").agg(F.count("*").alias("n"))
    return rel.top_per_group(counts, ["event_type"], [F.desc("n"), F.col("user_id")], 5).select("event_type", "user_id", "n", F.least(F.lit(0.95), 0.5 + 0.05 * F.col("n")).alias("confidence"))


@query("AGG19", "WITH s AS (SELECT user_id AS skill, max(CASE event_type WHEN 'view' THEN 1 WHEN 'signup' THEN 2 WHEN 'click' THEN 3 WHEN 'purchase' THEN 4 ELSE 5 END) AS p FROM events GROUP BY user_id) SELECT skill, CASE p WHEN 1 THEN 'recommended_only' WHEN 2 THEN 'ignored' WHEN 3 THEN 'used_helpful' WHEN 4 THEN 'used_noisy' ELSE 'bad_recommendation' END AS status FROM s")
def precedence_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*(F.lit(x) for x in ("recommended_only", "ignored", "used_helpful", "used_noisy", "bad_recommendation")))
    place = F.array_position(F.array(*(F.lit(x) for x in ("view", "signup", "click", "purchase", "error"))), F.col("event_type"))
    return read(spark, sf_dir, "events").groupBy(F.col("user_id").alias("skill")).agg(F.max(place).alias("p")).select("skill", F.get(names, (F.col("p") - 1).cast("int")).alias("status"))


@query("AGG22", "SELECT user_id AS skill, greatest(0, least(1, round(avg(v), 6))) AS success FROM (SELECT user_id, value / 100 AS v FROM events WHERE event_type = 'purchase' UNION ALL SELECT user_id, 0.5 AS v FROM events WHERE event_type = 'click') WHERE v <> 0 GROUP BY user_id HAVING sum(v) > 0")
def skill_success(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = read(spark, sf_dir, "events")
    both = own.where("event_type = 'purchase'").select("user_id", (F.col("value") / 100).alias("v")).unionByName(own.where("event_type = 'click'").select("user_id", F.lit(0.5).alias("v")))
    return both.where("v <> 0").groupBy(F.col("user_id").alias("skill")).agg(F.sum("v").alias("total"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.round(F.avg("v"), 6))).alias("success")).where("total > 0").drop("total")


@query("DTE01 DTE02 DTE03 DTE04 RNK16", """WITH a AS (SELECT user_id, (epoch(TIMESTAMP '2024-01-31') - epoch(ts)) / 86400.0 AS age FROM events WHERE event_type = 'error')
SELECT user_id, round(least(60, sum(18 * greatest(0.25, 1 - age / 180))), 6) AS boost, CAST(min(greatest(0, floor(age))) AS BIGINT) AS age_days FROM a WHERE age >= 0 AND age <= 180 GROUP BY user_id""")
def feedback_decay_boosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    age = (F.unix_timestamp(F.lit("2024-01-31 00:00:00").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp")) / 1e6) / 86400
    own = read(spark, sf_dir, "events").where("event_type = 'error'").select("user_id", age.alias("age")).where("age between 0 and 180")
    return own.groupBy("user_id").agg(F.round(F.least(F.lit(60.0), F.sum(18 * F.greatest(F.lit(0.25), 1 - F.col("age") / 180))), 6).alias("boost"), F.min(F.greatest(F.lit(0), F.floor("age"))).cast("bigint").alias("age_days"))


@query("AGG20", "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, count(DISTINCT user_id) AS users FROM events WHERE ts IS NULL OR ts >= TIMESTAMP '2024-01-23' GROUP BY event_type")
def weekly_analytics(spark: SparkSession, sf_dir: str) -> DataFrame:
    recent = read(spark, sf_dir, "events").where("ts is null or ts >= timestamp_ntz'2024-01-23 00:00:00'")
    return recent.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.countDistinct("user_id").alias("users"))


@query("AGG24", """WITH l AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS status FROM events GROUP BY user_id) SELECT status, count(*) AS n FROM l GROUP BY status""")
def weak_spots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.latest(read(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id"), ["user_id"], ["ts", "event_id"]).groupBy(F.col("event_type").alias("status")).agg(F.count("*").alias("n"))


@query("AGG25", """SELECT user_id, count(DISTINCT event_id) FILTER (WHERE event_type = 'purchase') AS proofs, count(DISTINCT props) AS artifacts,
CASE WHEN count(DISTINCT event_id) FILTER (WHERE event_type = 'purchase') >= 10 THEN 'demonstrated' WHEN count(*) FILTER (WHERE event_type = 'click') > 0 THEN 'practising' ELSE 'new' END AS status FROM events GROUP BY user_id""")
def competency_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    proof = F.when(F.col("event_type") == "purchase", F.col("event_id"))
    counts = read(spark, sf_dir, "events").groupBy("user_id").agg(F.countDistinct(proof).alias("proofs"), F.countDistinct("props").alias("artifacts"), F.count_if(F.col("event_type") == "click").alias("clicks"))
    return counts.select("user_id", "proofs", "artifacts", F.when(F.col("proofs") >= 10, "demonstrated").when(F.col("clicks") > 0, "practising").otherwise("new").alias("status"))


@query("AGG27 AGG31", """WITH k AS (SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS subject, user_id AS task, value, ts, event_id FROM events), g AS (SELECT subject, count(DISTINCT task) AS tasks, count(*) AS files, arg_max(task, (ts, event_id)) AS latest_task FROM k GROUP BY subject HAVING count(DISTINCT task) >= 2)
SELECT subject, tasks, latest_task, CAST(least(100, 35 + 12 * tasks + least(20, 2 * files)) AS BIGINT) AS score FROM g WHERE subject % 10 <> 0""")
def initiative_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = read(spark, sf_dir, "events").select(F.get_json_object("props", "$.k").cast("bigint").alias("subject"), F.col("user_id").alias("task"), "ts", "event_id")
    grouped = own.groupBy("subject").agg(F.countDistinct("task").alias("tasks"), F.count("*").alias("files"), F.max_by("task", F.struct("ts", "event_id")).alias("latest_task")).where("tasks >= 2")
    dismissed = own.where("subject % 10 = 0").select("subject").distinct()
    return grouped.join(dismissed, "subject", "left_anti").select("subject", "tasks", "latest_task", F.expr("cast(least(100, 35 + 12 * tasks + least(20, 2 * files)) as bigint)").alias("score"))


@query("WIN12 SET07", "SELECT source, id, ts, rank FROM (SELECT *, row_number() OVER (PARTITION BY who ORDER BY ts DESC, source, id DESC) AS rank FROM (SELECT 'event' AS source, event_id AS id, user_id AS who, ts FROM events UNION ALL SELECT 'commit', o_orderkey, o_custkey, o_orderdate FROM orders)) WHERE rank <= 5")
def timeline_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events").select(F.lit("event").alias("source"), F.col("event_id").alias("id"), F.col("user_id").alias("who"), "ts")
    commits = read(spark, sf_dir, "orders").select(F.lit("commit").alias("source"), F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("who"), F.col("o_orderdate").alias("ts"))
    return rel.top_per_group(events.unionByName(commits), ["who"], [F.desc("ts"), F.col("source"), F.desc("id")], 5).select("source", "id", "ts", F.col("rank").cast("bigint").alias("rank"))


@query("SNK08 WIN13", "WITH r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS r FROM events), k AS (SELECT event_id FROM r WHERE r <= 3) SELECT event_type, count(*) AS dropped FROM events WHERE event_id NOT IN (FROM k) GROUP BY event_type")
def retention_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = read(spark, sf_dir, "events")
    kept = rel.top_per_group(own, ["event_type"], [F.desc("ts"), F.desc("event_id")], 3).select("event_id")
    return own.join(F.broadcast(kept), "event_id", "left_anti").groupBy("event_type").agg(F.count("*").alias("dropped"))


@query("STM06", """WITH l AS (SELECT user_id, event_id, event_type, ts, CASE WHEN event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) THEN 0 ELSE 1 END AS new FROM events),
i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM l), c AS (SELECT user_id, event_type, run, count(*) AS n FROM i GROUP BY 1, 2, 3) SELECT user_id, max(n) AS longest, max(n) FILTER (WHERE event_type = 'error') >= 3 AS blocked FROM c GROUP BY user_id""")
def repeated_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A task is blocked by three equal failures in a row: gaps and islands over lag."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    flagged = read(spark, sf_dir, "events").withColumn("new", F.when(F.col("event_type") == F.lag("event_type").over(w), 0).otherwise(1))
    runs = flagged.withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0))).groupBy("user_id", "event_type", "run").agg(F.count("*").alias("n"))
    return runs.groupBy("user_id").agg(F.max("n").alias("longest"), (F.max(F.when(F.col("event_type") == "error", F.col("n"))) >= 3).alias("blocked"))


@query("COL04 MTH06", "SELECT event_id, coalesce(event_type, 'unknown') AS type, left(sha256(CAST(event_id AS VARCHAR) || '|' || coalesce(event_type, '') || '|' || coalesce(props, '')), 20) AS stable_id FROM events")
def normalized_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpuscle.functions.text import identity

    return read(spark, sf_dir, "events").select("event_id", F.coalesce("event_type", F.lit("unknown")).alias("type"), identity(F.col("event_id"), F.col("event_type"), F.col("props")).alias("stable_id"))


@query("STM03", "SELECT path, max(ts) AS last_ts FROM (SELECT l_partkey AS path, l_shipdate AS ts FROM lineitem) GROUP BY path")
def changed_path_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("path")).agg(F.max("l_shipdate").alias("last_ts"))


@query("DTE06 AGG21", "SELECT o_orderpriority, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') AS done, round(100.0 * count(*) FILTER (WHERE o_orderstatus = 'F') / nullif(count(*), 0), 4) AS pct, count(*) FILTER (WHERE o_orderstatus <> 'F' AND CAST(o_orderdate AS DATE) < DATE '1998-01-01') AS overdue FROM orders GROUP BY o_orderpriority")
def project_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = F.col("o_orderstatus") == "F"
    overdue = ~done & (F.to_date("o_orderdate") < F.lit("1998-01-01").cast("date"))
    return read(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.count_if(done).alias("done"), F.round(100.0 * F.count_if(done) / F.nullif(F.count("*"), F.lit(0)), 4).alias("pct"), F.count_if(overdue).alias("overdue"))
