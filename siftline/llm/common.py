"""Shared pieces: written intermediate tables, Python shipping, id folds."""

import os
import re
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: rows and bytes that go to a Python worker at once, for texts of some kB; set where the session has Spark's defaults
_BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "2000"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864", "8388608")}
#: so that freed arrays of a worker go back to the machine at once
_MALLOC = {"MALLOC_MMAP_THRESHOLD_": "262144", "MALLOC_TRIM_THRESHOLD_": "262144", "MALLOC_ARENA_MAX": "2"}


#: a Spark setting: the shuffle files of a finished query are deleted, not kept until the driver forgets the query
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it, and bound what they hold: smaller Arrow
    batches than Spark's default (a setting that the session has changed stays) and eager freeing."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])
    for name, value in _MALLOC.items():
        env.setdefault(name, value)
    for name, (default, smaller) in _BATCHES.items():
        if (spark.conf.get(name, None) or "").removesuffix("b") == default:
            spark.conf.set(name, smaller)


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where it is unset, a local session (tests) gets a temporary one; a cluster must name one."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        conf = "file://" + tempfile.mkdtemp(prefix="spark-siftline-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", conf)
    return conf.rstrip("/")


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write df below the shared folder and read it back: cuts the lineage and survives lost executors.

    The shuffle files of the write go when it has ended, since the table stands for them.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        # a query of its own, which nothing else runs again
        df.select("*").write.options(**({"compression": "zstd"} | options)).parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables of `written` that nothing reads any more: what comes after them must be written too."""
    for df in tables:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if re.search("-[0-9a-f]{32}$", folder):
                jvm, conf = df.sparkSession._jvm, df.sparkSession._jsparkSession.sessionState().newHadoopConf()
                path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(folder))
                path.getFileSystem(conf).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def learnable(doc_id: Column) -> Column:
    """True for the four fifths of ids that a model may learn from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 != 0


def released(batches):
    """The batches of a task; after the last one Arrow gives back the memory that it holds in store."""
    import pyarrow as pa

    try:
        yield from batches
    finally:
        pa.default_memory_pool().release_unused()
