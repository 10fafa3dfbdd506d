"""Extension points: external judges, enrichment commands, writers, indexes of many projects, golden comparison."""

from __future__ import annotations

import json
import subprocess
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WRITERS: dict[str, Callable[[DataFrame, str], None]] = {
    "parquet": lambda df, path: df.write.mode("overwrite").parquet(path),
    "json": lambda df, path: df.write.mode("overwrite").json(path),
    "csv": lambda df, path: df.write.mode("overwrite").option("header", True).csv(path),
    "orc": lambda df, path: df.write.mode("overwrite").orc(path),
}


def writer(name: str, write: Callable[[DataFrame, str], None]) -> None:
    """Register an output adapter."""
    WRITERS[name] = write


def command_judge(df: DataFrame, command: list[str], key: str, value: str, timeout: int = 30) -> DataFrame:
    """(key, verdict, detail): one run of an external command for each Arrow batch.

    The command reads one JSON object per line (key, value) and answers one per line
    (verdict, detail). A failure, a time-out or a missing answer gives `error`.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            lines = "".join(json.dumps({"key": str(k), "value": v}) + "\n" for k, v in zip(batch[key], batch[value], strict=True))
            try:
                said = subprocess.run(command, input=lines, capture_output=True, text=True, timeout=timeout, check=True).stdout.splitlines()
                answers = [json.loads(x) for x in said]
            except (OSError, subprocess.SubprocessError, ValueError):
                answers = []
            answers = answers if len(answers) == len(batch) else [{"verdict": "error"}] * len(batch)
            yield pd.DataFrame({key: batch[key], "verdict": [a.get("verdict", "error") for a in answers], "detail": [a.get("detail") for a in answers]})

    return df.select(key, F.col(value).cast("string").alias(value)).mapInPandas(run, f"{key} {kind}, verdict string, detail string")


def project_index(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """Rows of several projects with their folder; folders that cannot be read are left out."""
    frames = []
    for path in paths:
        try:
            frames.append(spark.read.schema(schema).parquet(path).withColumn("project", F.lit(path)))
        except Exception as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
    out = spark.createDataFrame([], schema).withColumn("project", F.lit(""))
    for frame in frames:
        out = out.unionByName(frame)
    return out


def golden_compare(actual: DataFrame, golden: DataFrame) -> DataFrame:
    """(side, n): rows that only one side has, repeats counted; none if the results are equal."""
    extra, missing = actual.exceptAll(golden), golden.exceptAll(actual)
    return extra.agg(F.count("*").alias("n")).withColumn("side", F.lit("extra")).unionByName(missing.agg(F.count("*").alias("n")).withColumn("side", F.lit("missing"))).where("n > 0").select("side", "n")


def trigger_phrases(name: Column, description: Column, most: int = 12) -> Column:
    """Distinct trigger phrases of a skill: its name's words joined, quoted phrases, and what follows `use when` or `use for`."""
    plain = F.trim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", " "))
    quoted = F.regexp_extract_all(F.lower(description), F.lit('"([^"]{3,60})"'), F.lit(1))
    told = F.regexp_extract_all(F.lower(description), F.lit(r"use (?:when|for) ([a-z0-9 ]{3,60})"), F.lit(1))
    phrases = F.transform(F.concat(F.array(plain), quoted, told), lambda p: F.trim(p))
    return F.slice(F.array_distinct(F.filter(phrases, lambda p: p != "")), 1, most)
