"""Column helpers for labels, identities, texts and numbers of telemetry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def key_of(labels: Column) -> Column:
    """Injective text of a label map, whatever the order of its entries. A null map reads as an empty one."""
    return F.coalesce(F.to_json(F.array_sort(F.map_entries(labels))), F.lit("[]"))


def series_key(name: Column, resource: Column, attrs: Column) -> Column:
    """Identity of a series: its name, resource and attributes."""
    return F.to_json(F.array(F.coalesce(name, F.lit("")), key_of(resource), key_of(attrs)))


def label_get(name: Column, attrs: Column, resource: Column, label: str) -> Column:
    """Value of a label: `__name__` is the name, then attributes, then the resource; a missing label is empty."""
    if label == "__name__":
        return F.coalesce(name, F.lit(""))
    return F.coalesce(attrs[label], resource[label], F.lit(""))


def as_integer(v: Column) -> Column:
    """The integer of a whole number of size below 9.2e18, else null."""
    return F.when((v == F.expr("0D") + F.when(v >= 0, F.floor(v)).otherwise(F.ceil(v))) & (F.abs(v) < 9.2e18), v.cast("bigint"))


def finite(v: Column) -> Column:
    """Neither null, NaN nor infinite."""
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))


def sanitize_label_name(s: Column) -> Column:
    """Each code point other than ASCII letters, digits and underscore becomes an underscore."""
    return F.regexp_replace(s, "[^a-zA-Z0-9_]", "_")


def bounded_text(s: Column, max_bytes: int) -> Column:
    """Control characters become U+FFFD; the text is cut to max_bytes bytes at the border of a character."""
    clean = F.regexp_replace(s, r"[\x00-\x1F\x7F\u0080-\u009F]", "�")
    raw = clean.cast("binary")
    # a cut inside a character leaves an incomplete end of one to three bytes
    cuts = [F.try_validate_utf8(F.substring(raw, 1, max_bytes - k).cast("string")) for k in range(4)]
    return F.when(F.octet_length(clean) <= max_bytes, clean).otherwise(F.coalesce(*cuts))


def valid_dns_label(s: Column) -> Column:
    """1 to 63 lower-case letters, digits and inner hyphens."""
    return F.coalesce(s.rlike(r"\A[a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?\z"), F.lit(False))


def valid_dns_subdomain(s: Column) -> Column:
    """DNS labels joined by points, 253 bytes at most."""
    return F.coalesce(F.octet_length(s) <= 253, F.lit(False)) & F.coalesce(F.forall(F.split(s, r"\."), valid_dns_label), F.lit(False))


def valid_uid(s: Column) -> Column:
    return F.coalesce(s.rlike(r"\A[A-Za-z0-9-]{1,128}\z"), F.lit(False))


def image_name(image: Column) -> Column:
    """An image reference without digest and tag."""
    return F.regexp_replace(F.split(image, "@", 2)[0], r":[^/:]*\z", "")


def image_digest(image: Column) -> Column:
    """What follows the last @, empty without one."""
    return F.when(image.contains("@"), F.substring_index(image, "@", -1)).otherwise("")


def mask_secret(s: Column) -> Column:
    return F.when(F.coalesce(s, F.lit("")) == "", "").otherwise("***")


def keys_only(m: Column) -> Column:
    """Sorted names of a map whose values must not be shown."""
    return F.array_sort(F.map_keys(m))


def exp_bucket_index(v: Column, scale: int) -> Column:
    """Index of the exponential bucket with upper bound v: ceil(log2(v) * 2^scale) - 1, exact for powers of two."""
    near = F.round(F.log2(v))
    exact = F.pow(F.lit(2.0), near) == v
    return F.when(exact, near * float(2**scale) - 1).otherwise(F.ceil(F.log2(v) * float(2**scale)) - 1).cast("bigint")


def fnv1a32(data: Column, seed: int, length: int = 16) -> Column:
    """32-bit FNV-1a over the little-endian bytes of a 32-bit seed and then length bytes of data."""
    h = 2166136261
    for shift in (0, 8, 16, 24):
        h = ((h ^ ((seed >> shift) & 255)) * 16777619) & 0xFFFFFFFF
    digits = F.hex(data)
    at = F.sequence(F.lit(0), F.lit(length - 1))
    byte = lambda i: F.conv(F.substring(digits, i * 2 + 1, F.lit(2)), 16, 10).cast("bigint")
    return F.aggregate(at, F.lit(h).cast("bigint"), lambda acc, i: (acc.bitwiseXOR(byte(i)) * F.lit(16777619).cast("bigint")).bitwiseAND(F.lit(0xFFFFFFFF).cast("bigint")))


def decode_octal_escapes(s: Column) -> Column:
    r"""`\ooo` escapes of a kernel file become their bytes, read as UTF-8."""
    parts = F.regexp_extract_all(s, F.lit(r"(?s)\\[0-3][0-7]{2}|.[^\\]*"), F.lit(0))
    as_hex = F.transform(parts, lambda p: F.when(p.rlike(r"\A\\[0-3][0-7]{2}\z"), F.lpad(F.conv(F.substring(p, 2, 3), 8, 16), 2, "0")).otherwise(F.hex(p.cast("binary"))))
    return F.decode(F.unhex(F.array_join(as_hex, "")), "UTF-8")


def any_value_to_string(value: Column) -> Column:
    """struct<stringValue,boolValue,intValue,doubleValue> as text; other kinds are empty.

    Doubles are plain decimals, never in scientific notation, whole ones without a point.
    """
    d = value["doubleValue"].cast("double")
    plain = F.regexp_replace(F.when(d.isNotNull(), F.format_string("%.17f", d)), r"\.?0+\z", "")
    short = F.when(d.isNotNull(), plain)
    short = F.when(as_integer(d).isNotNull(), as_integer(d).cast("string")).when((F.abs(d) >= 1e-3) & (F.abs(d) < 1e7), d.cast("string")).otherwise(short)
    return F.coalesce(value["stringValue"], value["boolValue"].cast("string"), value["intValue"].cast("string"), short, F.lit(""))
