"""Named queries with their DuckDB equivalents and the operators they cover."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpuscle.shared import spread, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
OPERATORS: dict[str, tuple[str, ...]] = {}

#: The same expressions in both engines: a pseudo path for a document, its content hash, and a pseudo task.
PATH = (
    "concat(CASE doc_id % 12 WHEN 0 THEN 'src/core' WHEN 1 THEN 'tests/unit' WHEN 2 THEN 'docs/guide' WHEN 3 THEN 'fixtures/data' WHEN 4 THEN 'examples/app' WHEN 5 THEN 'packages/web' "
    "WHEN 6 THEN 'dist/js' WHEN 7 THEN 'services/api' WHEN 8 THEN 'config' WHEN 9 THEN 'src/models' WHEN 10 THEN 'apps/admin/api' ELSE 'lib' END, '/', "
    "CASE doc_id % 5 WHEN 0 THEN 'test_item' WHEN 1 THEN 'main' WHEN 2 THEN 'settingsConfig' WHEN 3 THEN 'userService' ELSE 'orderIndex' END, CAST(doc_id % 40 AS STRING), "
    "CASE doc_id % 7 WHEN 0 THEN '.py' WHEN 1 THEN '.md' WHEN 2 THEN '.json' WHEN 3 THEN '.ts' WHEN 4 THEN '.test.ts' WHEN 5 THEN '.bin' ELSE '' END)"
)
TASK = (
    "concat(CASE doc_id % 8 WHEN 0 THEN 'fix(auth): login errors' WHEN 1 THEN 'review the pull request' WHEN 2 THEN 'refactor user-service and `order index`' WHEN 3 THEN 'docs: update guide' "
    "WHEN 4 THEN 'security review of uploads' WHEN 5 THEN 'share handoff notes' WHEN 6 THEN 'add classes for queries' ELSE 'explain repo' END, ' ', source)"
)
REASON = (
    "CASE doc_id % 9 WHEN 0 THEN 'Filename keyword match' WHEN 1 THEN 'symbol keyword match' WHEN 2 THEN 'content keyword match: x' WHEN 3 THEN 'matched call: f' WHEN 4 THEN 'direct dependency of y' "
    "WHEN 5 THEN 'historically co-changed' WHEN 6 THEN 'config file' WHEN 7 THEN 'matched role keyword' ELSE 'modified' END"
)


def query(ops: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        OPERATORS[f.__name__] = tuple(ops.split())
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; one with whole texts is dealt to all cores even where its files are too few."""
    found = table(spark, sf_dir, name)
    return spread(found) if name in ("documents", "pages") else found
