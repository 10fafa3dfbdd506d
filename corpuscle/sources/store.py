"""A store of named tables in versions: data first, digests read back, the manifest last."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Hashes in hex are half as large in it as in Spark's default.
CODEC = "zstd"
MANIFEST = "version bigint, name string, path string, n bigint, digest string, parts int"


class Damaged(RuntimeError):
    """No version of a store can be read whole."""


def _sums(df: DataFrame) -> list[Column]:
    hashed = F.xxhash64(*(F.col(f"`{c}`") for c in df.columns)) if df.columns else F.lit(0)
    return [F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(hashed.cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).cast("string").alias("digest")]


def digest(df: DataFrame) -> tuple[int, str]:
    """Rows and an order-free sum of the hashes of all columns: one aggregate that combines before it shuffles."""
    row = df.agg(*_sums(df)).first()
    return row["n"], row["digest"]


def _write(df: DataFrame, path: str) -> tuple[int, str]:
    """Write a table and return its digest as read back, which must be that of the rows that were written."""
    seen = Observation()
    df.observe(seen, *_sums(df)).write.mode("overwrite").option("compression", CODEC).parquet(path)  # no manifest names this folder yet
    back = digest(df.sparkSession.read.parquet(path))
    if back != (seen.get["n"], seen.get["digest"]):
        raise Damaged(f"{path} reads back differently from what was written")
    return back


def _manifest(spark: SparkSession, root: str, version: int, rows: list[tuple]) -> None:
    done = [(version, *r, len(rows)) for r in rows]
    spark.createDataFrame(done, MANIFEST).coalesce(1).write.mode("error").json(f"{root}/manifests/{version:012d}")


def publish(tables: dict[str, DataFrame], root: str) -> int:
    """Write a new version of all tables and return its number. Until the manifest is there, readers see the version before."""
    spark = next(iter(tables.values())).sparkSession
    version = _next(spark, root)
    rows = []
    for name, df in tables.items():
        path = f"data/{name}/{version:012d}"
        rows.append((name, path, *_write(df, f"{root}/{path}")))
    _manifest(spark, root, version, rows)
    return version


def _next(spark: SparkSession, root: str) -> int:
    """A number above those of all manifests, torn ones too."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/manifests")
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in files.listStatus(folder)] if files.exists(folder) else []
    return max((int(n) for n in names if n.isdigit()), default=0) + 1


def versions(spark: SparkSession, root: str) -> list[tuple[int, list]]:
    """(version, manifest rows) of the versions whose manifest is whole, the newest first: a row for each table of each version."""
    try:
        rows = spark.read.schema(MANIFEST).option("recursiveFileLookup", True).json(f"{root}/manifests").collect()
    except AnalysisException:  # nothing was published yet
        return []
    found: dict[int, list] = {}
    for r in rows:
        if r["version"] is not None:
            found.setdefault(r["version"], []).append(r)
    return sorted(((v, sorted(rs, key=lambda r: r["name"])) for v, rs in found.items() if len(rs) == rs[0]["parts"]), reverse=True, key=lambda x: x[0])


def _intact(spark: SparkSession, root: str, row) -> bool:
    try:
        return digest(spark.read.parquet(f"{root}/{row['path']}")) == (row["n"], row["digest"])
    except PySparkException:  # a folder or a file that is missing or torn
        return False


def load(spark: SparkSession, root: str, rebuild: dict[str, Callable[[], DataFrame]] | None = None) -> tuple[dict[str, DataFrame], int]:
    """The tables of the newest version that can be read whole, and its number.

    A table whose digest is another than the manifest's is damaged. With rebuild, what
    it can build is written again in a new version that keeps the intact tables where
    they are; otherwise the version before is tried.
    """
    for version, rows in versions(spark, root):
        good = {r["name"]: r for r in rows if _intact(spark, root, r)}
        lost = [r["name"] for r in rows if r["name"] not in good]
        if lost and not all(n in (rebuild or {}) for n in lost):
            continue
        if lost:
            version = _next(spark, root)
            kept = [(r["name"], r["path"], r["n"], r["digest"]) for r in good.values()]
            for name in lost:
                path = f"data/{name}/{version:012d}"
                kept.append((name, path, *_write(rebuild[name](), f"{root}/{path}")))
            _manifest(spark, root, version, kept)
            rows = next(rs for v, rs in versions(spark, root) if v == version)
        return {r["name"]: spark.read.parquet(f"{root}/{r['path']}") for r in rows}, version
    raise Damaged(f"no whole version in {root}")
