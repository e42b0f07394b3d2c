"""Scrape targets from tables of files, pods and DNS records, and what they add to points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.functions import labels as L

_NO_LABELS = "cast(map() AS map<string,string>)"


def _url(address: Column, path: Column | str = "/metrics") -> Column:
    path = F.lit(path) if isinstance(path, str) else path
    return F.when(address.rlike(r"\A[a-z]+://"), address).otherwise(F.concat(F.lit("http://"), address, path))


def targets_from_file_sd(files: DataFrame) -> DataFrame:
    """(content: JSON list of {targets, labels}) -> job, instance, url, labels. Content that cannot be read gives nothing."""
    schema = "array<struct<targets:array<string>,labels:map<string,string>>>"
    groups = files.select(F.explode(F.from_json("content", schema, {"mode": "PERMISSIVE"})).alias("g"))
    rows = groups.select(F.explode("g.targets").alias("instance"), F.coalesce("g.labels", F.expr(_NO_LABELS)).alias("l")).where("instance IS NOT NULL")
    extra = F.map_filter("l", lambda k, v: k != "job")
    return rows.select(F.coalesce(F.col("l")["job"], F.lit("unknown")).alias("job"), "instance", _url(F.col("instance")).alias("url"), extra.alias("labels"))


def targets_from_pods(pods: DataFrame, job: str = "", default_port: int = 0) -> DataFrame:
    """Running pods with an address that ask for it by annotation -> job, instance, url, labels.

    The port annotation counts if it is an integer, else default_port; port 0 skips the pod. The job is the namespace by default.
    """
    a = F.col("annotations")
    port = F.coalesce(F.when(a["prometheus.io/port"].rlike(r"\A[0-9]+\z"), a["prometheus.io/port"].try_cast("int")), F.lit(default_port))
    path = F.coalesce(F.when(a["prometheus.io/path"] != "", a["prometheus.io/path"]), F.lit("/metrics"))
    path = F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))
    rows = pods.where((F.col("phase") == "Running") & (F.coalesce("pod_ip", F.lit("")) != "") & (a["prometheus.io/scrape"] == "true")).withColumn("_port", port).where("_port <> 0")
    instance = F.concat("pod_ip", F.lit(":"), F.col("_port").cast("string"))
    meta = {"namespace": "namespace", "pod_name": "pod_name", "pod_node_name": "node_name", "pod_ip": "pod_ip"}
    own = F.create_map(*[x for k, c in meta.items() for x in (F.lit(f"__meta_kubernetes_{k}"), F.coalesce(c, F.lit("")))])
    named = F.transform(F.map_entries(F.coalesce("labels", F.expr(_NO_LABELS))), lambda e: F.struct(F.concat(F.lit("__meta_kubernetes_pod_label_"), L.sanitize_label_name(e["key"])).alias("key"), e["value"].alias("value")))
    # names that become equal keep the first in the order of keys
    named = F.array_sort(named)
    first = F.filter(named, lambda e, i: (i == 0) | (F.get(named, i - 1)["key"] != e["key"]))
    return rows.select(F.lit(job).alias("job") if job else F.col("namespace").alias("job"), instance.alias("instance"), _url(instance, path).alias("url"), F.map_concat(own, F.map_from_entries(first)).alias("labels"))


def targets_from_dns_records(records: DataFrame) -> DataFrame:
    """(name, type, host, port, query_port) of resolved records -> job, instance, url, labels; SRV carries its port, A and AAAA need query_port."""
    kind = F.upper(F.coalesce("type", F.when(F.coalesce("query_port", F.lit(0)) == 0, "SRV").otherwise("A")))
    port = F.when(kind == "SRV", F.col("port")).otherwise(F.col("query_port"))
    host = F.when(kind == "AAAA", F.concat(F.lit("["), F.col("host"), F.lit("]"))).otherwise(F.regexp_replace("host", r"\.\z", ""))
    rows = records.withColumns({"_port": port, "_host": host, "_kind": kind}).where("_port > 0")
    instance = F.concat("_host", F.lit(":"), F.col("_port").cast("string"))
    srv = F.create_map(F.lit("__meta_dns_name"), F.col("name"), F.lit("__meta_dns_srv_record_target"), F.col("host"), F.lit("__meta_dns_srv_record_port"), F.col("_port").cast("string"))
    labels = F.when(F.col("_kind") == "SRV", srv).otherwise(F.create_map(F.lit("__meta_dns_name"), F.col("name")))
    return rows.select(F.col("name").alias("job"), instance.alias("instance"), _url(instance).alias("url"), labels.alias("labels"))


def union_targets(*targets: DataFrame) -> DataFrame:
    """All targets, nothing removed."""
    out = targets[0]
    for t in targets[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def attribute_to_target(points: DataFrame, targets: DataFrame, on: str = "target_id") -> DataFrame:
    """Points whose resource becomes their target's: service.name, service.instance.id and the extra labels. Points without target are dropped."""
    base = F.create_map(F.lit("service.name"), F.col("job"), F.lit("service.instance.id"), F.col("instance"))
    extra = F.map_filter(F.coalesce("labels", F.expr(_NO_LABELS)), lambda k, v: ~k.isin("service.name", "service.instance.id"))
    return points.drop("resource").join(targets.select(on, F.map_concat(base, extra).alias("resource")), on)


#: fixed values: machine names, and the names of their architectures
ARCHITECTURES = {
    "x86_64": "amd64",
    "amd64": "amd64",
    "aarch64": "arm64",
    "arm64": "arm64",
    "armv6l": "arm32",
    "armv7l": "arm32",
    "i386": "x86",
    "i486": "x86",
    "i586": "x86",
    "i686": "x86",
    "ia64": "ia64",
    "ppc": "ppc32",
    "ppc64": "ppc64",
    "ppc64le": "ppc64",
    "s390x": "s390x",
}


def fill_missing_attributes(rows: DataFrame, inventory: DataFrame, with_machine_id: bool = False, on: str = "host") -> DataFrame:
    """resource gets the detected attributes of its host that it lacks; host.id only where asked for, host.arch only for a known machine. Hosts without inventory stay as they are."""
    detected = F.map_filter("detected", lambda k, v: v.isNotNull() & (v != "") & (F.lit(with_machine_id) | (k != "host.id")))
    arch = F.create_map(*[F.lit(x) for kv in ARCHITECTURES.items() for x in kv])
    detected = F.transform_values(detected, lambda k, v: F.when(k == "host.arch", arch[F.lower(v)]).otherwise(v))
    detected = F.map_filter(detected, lambda k, v: v.isNotNull())
    found = rows.join(inventory.select(on, detected.alias("_detected")), on, "left")
    own = F.coalesce("resource", F.expr(_NO_LABELS))
    missing = F.map_filter(F.coalesce("_detected", F.expr(_NO_LABELS)), lambda k, v: ~F.array_contains(F.map_keys(own), k))
    return found.withColumn("resource", F.map_concat(missing, own)).drop("_detected")
