"""A corpus pipeline of five stages, each written as Parquet and read again by the next."""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm import containment, langid, minhash, pieces, quality
from siftline.llm.common import learnable, shared_dir, ship, table
from siftline.llm.queries import tokenizer_path


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is 0.3 or more."""
    ship(spark)
    taught = quality.labelled(docs.where(learnable(F.col("doc_id"))), table(spark, sf_dir, "labels"))
    return docs.where(quality.score(F.col("text"), quality.fit(taught)) >= 0.3)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that lie near a centroid of some language."""
    ship(spark)
    model = langid.fit(docs.where(learnable(F.col("doc_id"))))
    return docs.where(~langid.verdict(F.col("text"), model)["rejected"])


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the least doc_id, of each group of near duplicates; rows without words all stay."""
    ship(spark)
    return minhash.one_of_each(docs, shingle_words=5, percent=80)


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, those without a doc_id among them."""
    return containment.without_items(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, chunk, ids, n_tokens, decoded: the SentencePiece ids of each chunk, and their text."""
    ship(spark)
    path = tokenizer_path("piece_bpe_32k.model")
    out = pieces.encode(docs, path, decoded=True)
    return out.select("doc_id", "chunk", "ids", F.size("ids").alias("n_tokens"), "decoded")


STAGES = [
    ("quality classifier", good_quality),
    ("language ID", known_language),
    ("MinHash near-dedup", one_of_each_group),
    ("benchmark decontamination", without_benchmarks),
    ("SentencePiece encoding", encoded),
]

#: classifiers, connected components and encoding can't be put into SQL; tests compare with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.option("compression", "zstd").parquet(f"{base}/{k}")
        docs = spark.read.parquet(f"{base}/{k}")
    return docs
