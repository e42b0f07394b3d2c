"""Benchmark decontamination: size-partitioned MinHash containment search, JVM-side.

Items are partitioned by the number of their shingles. Each partition has a hash threshold of
its own, and a text's MinHash sketch for the partition is the set of its shingle hashes up to
that threshold. An item with n shingles lies in a document if at least ceil(t * n) of them do,
so at most m = n - ceil(t * n) are missing: the threshold is the largest (m+1)-th least
hash of the partition's items, which leaves no contained item without a common hash. Of an
item's s sketched hashes a document that contains it holds s - m at least; pairs that reach this
are confirmed on the exact sets. A document's sketches are nested, so one pass over its hashes up to the
largest threshold probes all partitions.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.llm.common import written

#: runs of characters other than ASCII punctuation, space and control characters
WORD_BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: broadcast the item side up to so many rows (a row is two numbers)
BROADCAST_ROWS = 200_000


def words(text: Column) -> Column:
    """Words of a text with A-Z lower-cased; null and empty texts have none."""
    low = F.translate(F.coalesce(text.cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(low, WORD_BREAKS), lambda w: w != "")


def _hashed_words(df: DataFrame) -> DataFrame:
    """text -> h, the hashes of its words; a column of its own, so that they are taken once."""
    return df.withColumn("h", F.transform(words(F.col("text")), lambda x: F.xxhash64(x))).drop("text")


def _runs(size: int) -> Column:
    """Hashes of the runs of size words, from column h."""
    at = F.when(F.size("h") >= size, F.sequence(F.lit(1), F.size("h") - size + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(F.lit(size), *[F.element_at("h", i + k) for k in range(size)]))


def item_shingles(items: DataFrame, size: int) -> DataFrame:
    """(item_id, text) -> item_id, length, n, h: one row per distinct shingle.

    An item with fewer words than size is one shingle of its own length; one without words has none.
    """
    w = _hashed_words(items.select(F.col("item_id").cast("long").alias("item_id"), "text"))
    parts = []
    for length in range(1, size + 1):
        own = w.where((F.size("h") >= size) if length == size else (F.size("h") == length))
        parts.append(own.select("item_id", F.lit(length).alias("length"), F.explode(_runs(length)).alias("h")))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    out = out.where("item_id IS NOT NULL").distinct()
    n = out.groupBy("item_id").agg(F.count("*").alias("n"))
    return out.join(n, "item_id").select("item_id", "length", "n", "h")


def _text_keys(text: Column) -> list[Column]:
    """128 bits that stand for a text."""
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2")]


def sketches(shingles: DataFrame, percent: int) -> DataFrame:
    """(item_id, length, n, h) -> part, item_id, length, n, h, cut, needed: the sketched hashes of each item.

    part: the item's size class, cut: its partition's threshold, needed: how many of the item's sketched hashes a document
    that contains it must hold.
    """
    missing = f"(n - ({percent} * n + 99) div 100)"
    part = F.col("length") * 64 + F.floor(F.log2("n"))
    ranked = shingles.withColumn("part", part.cast("int")).withColumn("i", F.row_number().over(Window.partitionBy("item_id").orderBy("h")))
    cuts = ranked.where(f"i = {missing} + 1").groupBy("part").agg(F.max("h").alias("cut"))
    kept = ranked.join(cuts, "part").where("h <= cut")
    return kept.select("part", "item_id", "length", "n", "h", "cut", (F.count("*").over(Window.partitionBy("item_id")) - F.expr(missing)).alias("needed"))


def _up_to(hashes: Column, top: int) -> Column:
    return F.filter(hashes, lambda h: h <= F.lit(top))


def _found(docs: DataFrame, items: DataFrame, size: int, percent: int) -> DataFrame:
    """doc_id, k1, k2, item_id, n, n_shared: the items that lie in each document's text, which k1 and k2 stand for."""
    shingles = written(item_shingles(items, size), "items")
    sketch = written(sketches(shingles, percent), "sketch")
    # the largest threshold for each length of shingles: one row for each of at most size lengths
    tops = {r["length"]: r["top"] for r in sketch.groupBy("length").agg(F.max("cut").alias("top")).limit(size).collect()}
    probes, small = sketch.select("h", "item_id", "needed"), sketch.count() <= BROADCAST_ROWS
    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    none = F.array().cast("array<bigint>")
    low = F.concat(*[_up_to(_runs(length), top) for length, top in sorted(tops.items())]) if tops else none
    found = _hashed_words(whole.select(*_text_keys(F.col("text")), "text")).select("k1", "k2", F.explode(low).alias("h")).join(F.broadcast(probes) if small else probes, "h")
    pairs = found.distinct().groupBy("k1", "k2", "item_id").agg(F.count("*").alias("hits"), F.max("needed").alias("needed"))
    pairs = written(pairs.where("hits >= needed").select("k1", "k2", "item_id"), "candidates")

    # the exact sets of the candidates
    sets = written(shingles.groupBy("item_id", "n").agg(F.collect_set("h").alias("item_set")), "item-sets")
    every = F.concat(*[_runs(length) for length in sorted(tops)]) if tops else none
    chosen = whole.select("doc_id", *_text_keys(F.col("text")), "text").join(pairs.select("k1", "k2").distinct(), ["k1", "k2"], "left_semi")
    chosen = _hashed_words(chosen).select("doc_id", "k1", "k2", every.alias("doc_set"))
    both = chosen.join(pairs, ["k1", "k2"]).join(sets, "item_id").withColumn("n_shared", F.size(F.array_intersect("doc_set", "item_set")))
    return both.where(100 * F.col("n_shared") >= percent * F.col("n")).select("doc_id", "k1", "k2", "item_id", "n", "n_shared")


def contained_items(docs: DataFrame, items: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, text) x (item_id, text) -> doc_id, item_id, n_item, n_shared for the items that lie in a document.

    That is 100 * n_shared >= percent * n_item, over distinct shingles of size words. Items without words, or with
    a null item_id, lie in no document. Rows that repeat a doc_id are reported once with their largest n_shared, and so are
    all rows with a null doc_id. Other columns are ignored. An empty table on either side gives no rows.
    """
    found = _found(docs, items, size, percent)
    return found.groupBy("doc_id", "item_id").agg(F.max("n").alias("n_item"), F.max("n_shared").cast("long").alias("n_shared"))


def without_items(docs: DataFrame, items: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """docs without the rows whose text holds an item, whatever their doc_id. Columns of any name are left as they are."""
    found = written(_found(docs, items, size, percent).select("k1", "k2").distinct(), "leaks")
    k1, k2 = _text_keys(docs["text"])
    return docs.join(found, (k1 == found["k1"]) & (k2 == found["k2"]), "left_anti")
