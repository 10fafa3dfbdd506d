"""What all parts use: reading tables, cutting lineage, joins without hot keys."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key with more than 1/HOT of all rows is joined by broadcast: at most HOT such keys exist.
HOT = 10_000
#: A key with fewer rows than this is not hot, however few rows there are.
HOT_ROWS = 10_000
#: A table up to this size whose files make too few tasks is dealt out to all cores.
SPREAD_BYTES = 256 << 20
#: Bytes of a table of texts whose words or phrases meet in one partition.
PART_BYTES = 4 << 20
#: Rows and bytes that go to a Python worker in one Arrow batch.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, which all executors share.

    Only a local master may leave it unset and get a temporary one: a cluster's
    executors could not share it.
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints"))
    return context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the shared checkpoint folder, so that a lost executor costs no recomputation."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def spread(df: DataFrame) -> DataFrame:
    """A small table of one or a few files, dealt out evenly; any other table as it is.

    A file with a single row group is one task, however many cores there are. Only
    tables of at most SPREAD_BYTES move, and of these only the columns in use.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size <= SPREAD_BYTES and df.rdd.getNumPartitions() < cores else df


def parts_for(spark: SparkSession, df: DataFrame) -> int:
    """As many partitions as keep what one task aggregates from a table's texts the same, however large the table is."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small in bytes, so that very long texts do not add up in a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def join_facts(rows: DataFrame, facts: DataFrame, keys: list[str], weight: str, total: int) -> DataFrame:
    """rows inner-joined with facts, one per key; weight is the key's number of rows, total that of all rows.

    Heavy keys, of which there are at most HOT, never move: their facts go to every
    task. The rest is a shuffle join in which no key holds more than 1/HOT of the rows.
    """
    heavy = facts.where(F.col(weight) > total / HOT)
    light = facts.where(F.col(weight) <= total / HOT).drop(weight)
    moved = rows.join(F.broadcast(heavy.select(*keys)), keys, "left_anti").join(light, keys)
    return rows.join(F.broadcast(heavy.drop(weight)), keys).unionByName(moved)


def hot_keys(rows: DataFrame, key: str) -> DataFrame | None:
    """The keys, at most HOT, with more than 1/HOT of the rows and more than HOT_ROWS; None if there are none.

    Hashes are counted first, a few for each such key there may be, and only keys
    whose hash has that many rows are counted themselves: no table of all keys is shuffled.
    """
    hashed = F.pmod(F.xxhash64(key), F.lit(4 * HOT)).cast("int")
    sizes = cut(rows.groupBy(hashed.alias("_h")).agg(F.count("*").alias("_n")))
    most = max((sizes.agg(F.sum("_n")).first()[0] or 0) / HOT, HOT_ROWS)
    full = [r["_h"] for r in sizes.where(F.col("_n") > most).select("_h").collect()]  # at most HOT
    if not full:
        return None
    wanted = F.broadcast(rows.sparkSession.createDataFrame([(h,) for h in full], "_h int"))
    found = cut(rows.select(key, hashed.alias("_h")).join(wanted, "_h", "left_semi").groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > most).select(key))
    return None if found.isEmpty() else found
