"""Site-relative line deduplication with DataFrame functions only.

A line is boilerplate on a host if the share of the host's pages that contain it
exceeds a ratio, and it is on a least number of its pages, so that a few copies of
a document on a small host keep their lines. Lines are compared after trimming spaces; blank lines count
nowhere and stay. Lines travel as two independent 64-bit hashes.

Counting explodes each page's distinct lines to (host, line) and aggregates with
map-side combination, so a line that a third of all pages carry is a handful of
rows per task. Boilerplate is small by its definition: a host has at most its mean
number of lines per page, divided by the ratio, of such lines. They are gathered
for each host. If they are few in all they go to every task and no text moves;
otherwise those of heavy hosts do, and only texts of hosts with less than a
ten-thousandth of the pages move.

Defined results: a null text stays null and has no lines; a null host is a host of
its own, written as the empty string; hosts of fewer than min_pages pages lose
nothing; repeated rows count as pages of their own; an empty table gives no rows.
Extra columns are kept, but with details a column named _lines is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscle.llm.common import cut, join_facts

RATIO, MIN_PAGES, MIN_COPIES = 0.05, 5, 4
#: Boilerplate rows that are sent to every task (about 50 bytes each); beyond it the join shuffles.
BROADCAST_ROWS = 200_000


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _key(line: Column) -> Column:
    return F.struct(F.xxhash64(F.trim(line)).alias("h1"), F.xxhash64(F.lit(1), F.trim(line)).alias("h2"))


def boilerplate(pages: DataFrame, text_column: str, host_column: str, ratio: float = RATIO, min_pages: int = MIN_PAGES, min_copies: int = MIN_COPIES) -> tuple[DataFrame, int]:
    """(host, total, bad) for every host, and the number of all pages.

    bad is null, or holds a host's n boilerplate lines in n buckets by h1, so that a line
    is looked for in the one or two of its bucket: array<array<struct(h1, h2)>>.
    """
    rows = pages.select(F.coalesce(F.col(host_column).cast("string"), F.lit("")).alias("host"), F.col(text_column).cast("string").alias("text"))
    totals = cut(rows.groupBy("host").agg(F.count("*").alias("total")))  # a row for each host
    every = totals.agg(F.coalesce(F.sum("total"), F.lit(0))).first()[0]
    own = F.array_distinct(F.transform(F.filter(_lines(F.col("text")), lambda x: F.trim(x) != ""), _key))
    lines = rows.where("text is not null").select("host", F.explode(own).alias("line")).select("host", "line.h1", "line.h2").groupBy("host", "h1", "h2").agg(F.count("*").alias("n")).where(F.col("n") >= min_copies)
    judged = join_facts(lines, totals.where(F.col("total") >= min_pages).withColumn("pages", F.col("total")), ["host"], "total", every)
    lines = cut(judged.where(F.col("n") > F.lit(ratio) * F.col("pages")).select("host", "h1", "h2"))
    sizes = lines.groupBy("host").agg(F.count("*").cast("int").alias("buckets"))
    own = lines.join(sizes, "host").groupBy("host", F.pmod("h1", F.col("buckets")).cast("int").alias("bucket")).agg(F.collect_list(F.struct("h1", "h2")).alias("held"))
    every_bucket = sizes.select("host", F.explode(F.sequence(F.lit(0), F.col("buckets") - 1)).alias("bucket")).join(own, ["host", "bucket"], "left")
    held = F.coalesce("held", F.array().cast("array<struct<h1: bigint, h2: bigint>>"))
    bad = every_bucket.groupBy("host").agg(F.transform(F.array_sort(F.collect_list(F.struct("bucket", held.alias("held")))), lambda x: x["held"]).alias("bad"))
    return cut(totals.join(bad, "host", "left")), every


def drop_boilerplate(pages: DataFrame, text_column: str = "text", host_column: str = "source", ratio: float = RATIO, min_pages: int = MIN_PAGES, min_copies: int = MIN_COPIES, details: bool = True) -> DataFrame:
    """The input with boilerplate lines gone from its text, and with details a column _lines(host, n_lines, n_dropped)."""
    names = [c for c in pages.columns if not details or c.lower() != "_lines"]
    found, every = boilerplate(pages, text_column, host_column, ratio, min_pages, min_copies)
    rows = pages.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"), F.coalesce(F.col(host_column).cast("string"), F.lit("")).alias("host"), F.col(text_column).cast("string").alias("text"))
    if found.agg(F.coalesce(F.sum(F.size(F.coalesce("bad", F.array()))), F.lit(0))).first()[0] <= BROADCAST_ROWS:
        rows = rows.join(F.broadcast(found.where("bad is not null").drop("total")), "host", "left")
    else:
        rows = join_facts(rows, found, ["host"], "total", every)
    bucket = lambda x: F.get("bad", F.pmod(F.xxhash64(F.trim(x)), F.size("bad")).cast("int"))
    kept = F.filter(_lines(F.col("text")), lambda x: (F.trim(x) == "") | ~F.array_contains(bucket(x), _key(x)))
    rows = rows.withColumn("kept", F.when(F.col("bad").isNotNull() & F.col("text").isNotNull(), kept))
    whole = F.when(F.col("kept").isNull(), F.col("text")).otherwise(F.array_join("kept", "\n"))
    n_lines = F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size(_lines(F.col("text"))))
    n_kept = F.when(F.col("kept").isNull(), n_lines).otherwise(F.size("kept"))
    info = F.struct("host", n_lines.cast("bigint").alias("n_lines"), (n_lines - n_kept).cast("bigint").alias("n_dropped"))
    return rows.select(*(whole.alias(c) if c == text_column else F.col("row")[c].alias(c) for c in names), *([info.alias("_lines")] if details else []))


ORACLE_SQL = f"""
WITH rows AS (SELECT doc_id, coalesce(source, '') AS host, text, string_split(text, chr(10)) AS lines FROM documents),
own AS (SELECT host, unnest(list_distinct(list_filter(list_transform(lines, lambda x: trim(x)), lambda x: x <> ''))) AS line FROM rows WHERE text IS NOT NULL),
totals AS (SELECT host, count(*) AS total FROM rows GROUP BY host),
bad AS (SELECT host, list(line) AS bad FROM (SELECT host, line FROM own JOIN totals USING (host) GROUP BY host, line, total HAVING count(*) >= {MIN_COPIES} AND total >= {MIN_PAGES} AND count(*) > {RATIO} * total) GROUP BY host),
kept AS (SELECT r.*, list_filter(lines, lambda x: trim(x) = '' OR bad IS NULL OR NOT list_contains(bad, trim(x))) AS kept FROM rows r LEFT JOIN bad USING (host))
SELECT doc_id, host, coalesce(len(lines), 0) AS n_lines, coalesce(len(lines) - len(kept), 0) AS n_dropped, array_to_string(kept, chr(10)) AS text FROM kept
"""
