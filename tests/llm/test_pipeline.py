"""The pipeline against a brute-force version of its exact stages, and the registered queries."""

import re

import pytest

import __spark_entry__ as entry_point
import corpus_pipeline
from corpuscle.llm import queries


def test_stages_keep_columns_and_take_effect(spark, tmp_path):
    lines = ["Plain first line of text number {0} with the usual words and {1} more", "Shared footer of this site"]
    texts = ["\n".join(lines).format(i, i * i) for i in range(40)] + [None, "", "12345 !!!", "\n".join(lines).format(1, 1)]
    texts[5] += '\ntoken = "abcdef0123456789abcdef0123456789"'
    rows = [(i, t, "en", "site", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "ordinary prose about a helper value " * 30)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    df = spark.read.parquet(f"{tmp_path}/documents.parquet")
    names, kept = df.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, df, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        df = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = {r["doc_id"]: r for r in df.collect()}
        assert name == "packing" or df.columns == names
    assert set(kept["language_id"]) == set(range(40)) | {43}
    assert not any("Shared footer" in r["text"] for r in kept["line_dedup"].values())
    assert all(r["n_chars"] == len(r["text"]) for r in kept["line_dedup"].values())
    assert 43 not in kept["simhash"] and 1 in kept["simhash"]
    assert re.search(r"\[secret\]", kept["secrets"][5]["text"]) and "abcdef0123456789" not in kept["secrets"][5]["text"]
    assert set(kept["packing"]) == set(kept["secrets"])


def test_every_query_is_registered():
    names = entry_point.queries()
    assert {f"op{n}" for n in range(1, 14)} == {k.split("_")[0] for k in queries.QUERIES} and "pipeline" in names
    assert set(entry_point.oracle_sql()) <= set(names)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracles(spark, name):
    duckdb = pytest.importorskip("duckdb")
    base = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS FROM '{base}/{t}.parquet'")
    want = con.sql(queries.ORACLES[name])
    got = queries.QUERIES[name](spark, base).select(*want.columns)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want.fetchall(), key=repr)


def test_stages_take_odd_rows_columns_and_empty_tables(spark, tmp_path):
    rng_text = "The plain words of a page about the shore and other things with a hash "
    rows = [(None, rng_text * 3, None, None, 1), (1, rng_text * 3, "en", "s", 2), (1, rng_text * 3, "en", "s", 2), (2, None, None, "s", None), (3, "", "en", None, 0), (4, rng_text * 4000, "en", "s", 3), (5, "token = abcdef0123456789\n" * 40, "en", "s", 4)]
    names = ["row", "k", "worker", "host", "kept", "_base", "_lines", "_score", "_lang", "fp", "node"]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", *(f"'{n}' as {n}" for n in names))
    spark.createDataFrame([(1, "ordinary prose about a helper value " * 30)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for some in (docs, docs.where("false")):
        df = some
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, df, str(tmp_path))
            assert name == "packing" or out.columns == docs.columns
            df = corpus_pipeline.cut(out)
        assert df.count() == 0 if some is not docs else df.count() > 0


def test_run_is_the_stages_in_turn(spark, tmp_path):
    texts = [f"A plain page number {i} about the shore, the hash and other things of page {i * 7}" for i in range(40)] + ["A plain page number 3 about the shore, the hash and other things of page 21", "9 9 9"]
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "ordinary prose about a helper value " * 30)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    df = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        df = corpus_pipeline.cut(stage(spark, df, str(tmp_path)))
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(repr, got.collect())) == sorted(map(repr, df.collect())) and {r["doc_id"] for r in got.collect()} >= set(range(40)) - {40, 41}
