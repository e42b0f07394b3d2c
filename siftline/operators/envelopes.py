"""Envelopes: validation, digests, identities, and chunks of log records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.functions.scans import HOT_ROWS
from siftline.operators import packing
from siftline.operators.packing import REQUEST_BYTES

MAX_PAYLOAD = 256 << 20
#: fixed values: resource attributes that make up an identity; a caller adds the attributes of its own product
IDENTITY_KEYS = (
    "service.name",
    "service.namespace",
    "service.instance.id",
    "service.version",
    "deployment.environment.name",
    "host.id",
    "host.name",
    "process.pid",
    "process.executable.name",
    "process.executable.path",
    "process.executable.build_id.gnu",
    "process.executable.build_id.go",
    "process.runtime.name",
    "process.runtime.version",
    "container.id",
    "container.name",
    "k8s.cluster.name",
    "k8s.namespace.name",
    "k8s.node.name",
    "k8s.pod.name",
    "k8s.pod.uid",
    "k8s.container.name",
    "k8s.deployment.name",
    "k8s.replicaset.name",
    "k8s.statefulset.name",
    "k8s.daemonset.name",
    "k8s.job.name",
    "k8s.cronjob.name",
)
_CONTROL = r"[\x00-\x1F\x7F\u0080-\u009F]"


def _text(c: Column, most: int, least: int = 1) -> Column:
    return F.coalesce(F.octet_length(c).between(least, most) & F.is_valid_utf8(c) & ~c.rlike(_CONTROL), F.lit(False))


def with_reason(envelopes: DataFrame) -> DataFrame:
    """Add reason: the first rule that an envelope breaks, null for a valid one."""
    resource = F.coalesce("resource", F.expr("cast(map() AS map<string,string>)"))
    entries = F.forall(F.map_entries(resource), lambda e: _text(e["key"], 256) & _text(e["value"], 4096, 0))
    rules = [
        ("version", F.col("version") == 1), ("id", F.col("id").rlike(r"\A[0-9a-f]{32}\z")), ("kind", F.col("kind").rlike(r"\A[a-z][a-z0-9._-]{0,63}\z")), ("schema", _text(F.col("schema"), 256)),
        ("encoding", _text(F.col("encoding"), 128)), ("captured_at", F.col("captured_at_unix_nano") > 0), ("payload", F.octet_length("payload").between(1, MAX_PAYLOAD)), ("resource", (F.cardinality(resource) <= 128) & entries),
    ]
    reason = F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in rules])
    return envelopes.withColumn("reason", reason)


def validate_envelopes(envelopes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid envelopes, and the others with the first rule that they break."""
    rows = with_reason(envelopes)
    return rows.where("reason IS NULL").drop("reason"), rows.where("reason IS NOT NULL")


def payload_digest(envelopes: DataFrame) -> DataFrame:
    return envelopes.withColumn("digest", F.sha2("payload", 256))


def split_corrupt(envelopes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Envelopes whose payload has its stored digest, and the corrupt others."""
    ok = F.coalesce(F.sha2("payload", 256) == F.col("digest"), F.lit(False))
    return envelopes.where(ok), envelopes.where(~ok)


def resource_identity(resource: Column, more_keys: tuple[str, ...] = ()) -> Column:
    """The identity attributes of a map, IDENTITY_KEYS and more_keys; null if one of them is over 4096 bytes, no UTF-8 or has control characters."""
    kept = F.map_filter(F.coalesce(resource, F.expr("cast(map() AS map<string,string>)")), lambda k, v: k.isin(*IDENTITY_KEYS, *more_keys))
    return F.when(F.forall(F.map_values(kept), lambda v: _text(v, 4096, 0)), kept)


def common_identity(rows: DataFrame, batch: str, attrs: str = "resource_attrs", more_keys: tuple[str, ...] = ()) -> DataFrame:
    """batch, identity: the identity that all resources of a batch share, else null.

    attrs is array<struct<key,value>>; a repeated identity key and a null value leave the batch without identity.
    """
    own = F.filter(attrs, lambda a: a["key"].isin(*IDENTITY_KEYS, *more_keys))
    keys = F.transform(own, lambda a: a["key"])
    good = (F.size(F.array_distinct(keys)) == F.size(keys)) & F.forall(own, lambda a: _text(a["value"], 4096, 0))
    text = F.when(good, F.to_json(F.array_sort(own)))
    out = rows.select(batch, text.alias("_t")).groupBy(batch).agg(F.min("_t").alias("lo"), F.max("_t").alias("hi"), F.count("*").alias("n"), F.count("_t").alias("m"))
    same = (F.col("lo") == F.col("hi")) & (F.col("n") == F.col("m"))
    return out.select(batch, F.when(same, F.map_from_entries(F.from_json("lo", "array<struct<key:string,value:string>>"))).alias("identity"))


def pack_logs(records: DataFrame, request: str = "request_id", order: str = "record_idx", size: str = "size_bytes", max_bytes: int = REQUEST_BYTES, group: str | None = None, header: str | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Add chunk: records of a request, in wire order, to chunks of max_bytes; from a record that fits none on the rest fails (chunk -1).

    group names the resource and scope of a record, header how many bytes they take: once for each run of a group, and again in every
    chunk that such a run goes on in.
    """
    return packing.packed(records, request, order, size, max_bytes or REQUEST_BYTES, "stop", group, header, hot_rows)


def batch_records(records: DataFrame, stream: str = "path", order: str = "offset", size: str = "size_bytes", max_bytes: int = 512 << 10, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Add chunk: records of a file to batches of max_bytes; a larger record is a batch of its own."""
    return packing.packed(records, stream, order, size, max_bytes, "alone", hot_rows=hot_rows)


def chunk_id(envelope_id: Column, index: Column, chunks: Column) -> Column:
    """The envelope's id if it was not split, else 32 hexadecimal digits of sha256(`id:index`)."""
    return F.when(chunks <= 1, envelope_id).otherwise(F.substring(F.sha2(F.concat(envelope_id, F.lit(":"), index.cast("string")), 256), 1, 32))
