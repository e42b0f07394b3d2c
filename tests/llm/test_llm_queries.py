"""Registered queries against SQL or brute force, and the pipeline stage by stage, on the smallest tables."""

import os
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from siftline.llm import queries as Q
from siftline.llm.common import table

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "embeddings", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_same_rows(spark, duck, name):
    df = Q.queries()[name](spark, SF)
    plain = lambda x: None if x is None else round(float(x), 9) if isinstance(x, (int, float)) or hasattr(x, "is_signed") else str(x)
    key = lambda r: tuple((x is not None, str(x)) for x in r)
    got = sorted((tuple(map(plain, r)) for r in df.collect()), key=key)
    expected = sorted((tuple(map(plain, r)) for r in duck.sql(f"SELECT {', '.join(df.columns)} FROM ({Q.oracle_sql()[name]})").fetchall()), key=key)
    assert got == expected


def test_every_operator_is_registered():
    assert [n.split("_")[0] for n in Q.queries()] == [f"op{k}" for k in range(1, 14)]


def test_held_out_rows_follow_the_ids(spark):
    import zlib

    out = Q.op9_quality(spark, SF).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in out)
    assert all(r["predicted"] == int(r["score"] >= 0.3) for r in out)


def test_language_accuracy(spark):
    out = Q.op7_language(spark, SF).join(table(spark, SF, "documents").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in out) >= 0.95 * len(out)


def test_pipeline(spark):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    seen = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == columns, name
        docs = out.cache()
        seen.append(docs.count())
        assert seen[-1] <= seen[-2]
        assert Counter(r["doc_id"] for r in docs.select("doc_id").collect()).most_common(1)[0][1] == 1
    assert seen[-1] < seen[0] and seen[-1] > 0.5 * seen[0]
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    text = last.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "decoded"))), lambda x: x["decoded"]), "").alias("t"))
    assert text.join(docs, "doc_id").where("t <> text").count() == 0 and text.count() == seen[-1]


def test_pipeline_stages_on_an_empty_table(spark):
    docs = table(spark, SF, "documents").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0, name


def test_pipeline_stages_with_odd_rows(spark):
    docs = table(spark, SF, "documents")
    odd = spark.createDataFrame([(None, "Some words of a text that has no id at all.", None, None, None), (10**9, None, "en", "s", 0), (10**9 + 1, "", None, None, None)], docs.schema).withColumn("score", F.lit(1))
    mixed = docs.withColumn("score", F.lit(0)).union(odd)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, mixed, SF)
        assert out.count() >= 0 and (name == corpus_pipeline.STAGES[-1][0] or out.columns == mixed.columns), name
