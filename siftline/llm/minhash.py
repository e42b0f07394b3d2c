"""MinHash near-duplicates with circulant signatures.

Two fixed permutations make every signature coordinate: the first places a shingle
in a ring of 2^20 cells, the second is read from that place onwards, so coordinate k
is the second permutation shifted by k. The k values of a shingle are one contiguous
slice of memory.

Texts with equal shingle sets form one node. Nodes meet in 40 bands of 6 coordinates.
Every node is first compared with the least node of its best band, then with that of its
other bands. The bands alone would miss a few links (of pairs of likeness 0.8 about 3 in
10,000: the bands share coordinates), so a second, exact step follows: with all shingles
in the order of their hashes, two nodes alike enough share c of their first
n - ceil(percent * n / 100) + c. Nodes that share so many and still belong to different
components are compared with each other if they share one of their rarest shingles. So
no group of copies is expanded into all pairs, no link between two components is missed,
and every one is confirmed on the full sets.
"""

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftline.llm import bytetext
from siftline.llm.common import discard, written
from siftline.llm.graph import components, extended

CELLS, LENGTH, BANDS, ROWS = 1 << 20, 128, 40, 6
_SLICE = 8192


def _tables() -> tuple[np.ndarray, np.ndarray]:
    random = np.random.RandomState(7)
    ring = random.permutation(CELLS).astype(np.int32)
    picks = np.stack([random.permutation(LENGTH)[:ROWS] for _ in range(BANDS)])
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([ring, ring[: LENGTH - 1]]), LENGTH), picks


def _shingles(texts: pa.Array, size: int):
    """(low, high, hashes, text numbers) for runs of texts; words are parted by ASCII white space, A-Z lower-cased."""
    data, offsets = bytetext.buffer_of(texts)
    for low, high in bytetext.groups(offsets):
        part = bytetext.LOWER[data[offsets[low] : offsets[high]]]
        starts, ends, doc = bytetext.runs((~bytetext.SPACES)[part].view(np.uint8), offsets[low : high + 1] - offsets[low])
        yield low, high, *bytetext.shingle_hashes(bytetext.hashes(part, starts, ends), doc, high - low, size)


def signatures(h: np.ndarray, doc: np.ndarray, n: int, ring: np.ndarray) -> np.ndarray:
    """n x LENGTH least values; a text without shingles keeps the largest int."""
    out = np.full((n, LENGTH), np.iinfo(np.int32).max, np.int32)
    cells = (h & np.uint64(CELLS - 1)).astype(np.int64)
    for low in range(0, len(h), _SLICE):
        d = doc[low : low + _SLICE]
        first = np.flatnonzero(np.concatenate(([True], d[1:] != d[:-1])))
        least = np.minimum.reduceat(ring[cells[low : low + _SLICE]], first, axis=0)
        out[d[first]] = np.minimum(out[d[first]], least)
    return out


def _names(h: np.ndarray, doc: np.ndarray, n: int) -> list[pa.Array]:
    """The sets' own names: two sums of their mixed hashes, whatever the order."""
    sums = [np.zeros(n, np.uint64) for _ in range(2)]
    for k, s in enumerate(sums):
        np.add.at(s, doc, bytetext.mix(h + np.uint64((1 + k) * 0x20761D6478BD642F)))
    return [pa.array(s.view(np.int64)) for s in sums]


def _sketch(size: int, percent: int):
    def run(batches):
        ring, picks = _tables()
        for batch in batches:
            ids, fetch, texts = (batch.column(k) for k in range(3))
            for low, high, h, doc in _shingles(texts, size):
                n = high - low
                counts = np.bincount(doc, minlength=n)
                sums = _names(h, doc, n)
                values = signatures(h, doc, n, ring)
                keys = np.empty((n, BANDS), np.uint64)
                for b, pick in enumerate(picks):
                    key = np.full(n, b, np.uint64)
                    for k in pick:
                        key = bytetext.mix(key * np.uint64(0xD6E8FEB86659FD93) + values[:, k].astype(np.uint64))
                    keys[:, b] = key
                bands = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * BANDS), pa.array(keys.ravel().view(np.int64)))
                # the shingles of a text come in the order of their hashes
                overlap = (percent * counts + 99) // 100
                first = counts - overlap + np.minimum(8 + counts // 16, overlap)
                place = np.arange(len(h)) - np.repeat(np.cumsum(counts) - counts, counts)
                least = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(first))).astype(np.int32)), pa.array(h[place < first[doc]].view(np.int64)))
                yield pa.RecordBatch.from_arrays([ids.slice(low, n), fetch.slice(low, n), pa.array(counts), *sums, bands, least], names=["doc_id", "fetch", "n_shingles", "d1", "d2", "bands", "least"])

    return run


def _sets(size: int):
    def run(batches):
        for batch in batches:
            for low, high, h, doc in _shingles(batch.column(0), size):
                counts = np.bincount(doc, minlength=high - low)
                ends = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(counts), *_names(h, doc, high - low), pa.ListArray.from_arrays(pa.array(ends), pa.array(h.view(np.int64)))], names=["n_shingles", "d1", "d2", "shingles"])

    return run


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose full sets are alike enough, a written table. Only sets of the pairs' ends are moved."""
    pairs = written(pairs.select("a", "b"), "minhash-pairs")
    if pairs.isEmpty():
        return pairs
    ends = written(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "minhash-ends")
    sets = sets.join(ends, "node", "left_semi")
    one = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    two = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    both = pairs.join(one, "a").join(two, "b").withColumn("shared", F.size(F.array_intersect("sa", "sb")))
    return written(both.where(100 * F.col("shared") >= percent * (F.size("sa") + F.size("sb") - F.col("shared"))).select("a", "b"), "minhash-links")


def _across(nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(node, root) -> pairs (a, b) of different roots that can be alike enough.

    With all shingles in one order, the rarest first, two nodes alike enough share one of their first
    n - ceil(percent * n / 100) + 1 shingles, and the first one shared leaves room for the overlap needed. Their sizes
    lie in the same class or in neighbouring ones. Of the nodes of a shingle only those outside of its commonest
    root look for partners, so that a large component is not paired with itself.
    """
    own = sets.join(nodes, "node").select("node", "root", F.size("shingles").cast("long").alias("n"), F.explode("shingles").alias("h"))
    # counted by partial sums and joined back: a shingle of many nodes is no single task's
    often = written(own.groupBy("h").agg(F.count("*").alias("df")).where("df > 1"), "minhash-often")
    own = own.join(often, "h")
    # shingles that no other node has come first in the order; they are left out but keep their places
    per_node = Window.partitionBy("node")
    own = own.withColumn("i", F.col("n") - F.count("*").over(per_node) + F.row_number().over(per_node.orderBy("df", "h")))
    first = own.where(f"i <= n - ({percent} * n + 99) div 100 + 1").select("h", "node", "root", "n", "i", F.floor(F.log(100 / percent, F.col("n")) + 1e-9).alias("class") if percent < 100 else F.col("n").alias("class"))
    first = written(first, "minhash-first")
    common = first.groupBy("h", "root").agg(F.count("*").alias("c")).groupBy("h").agg(F.max_by("root", F.struct("c", "root")).alias("main"), F.count("*").alias("roots")).where("roots > 1").select("h", "main")
    first = written(first.join(written(common, "minhash-common"), "h"), "minhash-first")
    one = first.where("root <> main").select("h", *[F.col(c).alias(f"{c}1") for c in ("node", "root", "n", "i")], F.explode(F.array(F.col("class") - 1, F.col("class"), F.col("class") + 1)).alias("class"))
    two = first.select("h", "class", *[F.col(c).alias(f"{c}2") for c in ("node", "root", "n", "i")])
    room = "(1 + least(n1 - i1, n2 - i2))"
    pairs = one.join(two, ["h", "class"]).where(f"root1 <> root2 AND 100 * {room} >= {percent} * (n1 + n2 - {room})")
    return pairs.select(F.least("node1", "node2").alias("a"), F.greatest("node1", "node2").alias("b")).distinct()


_NAME = ["n_shingles", "d1", "d2"]


def _grouped(docs: DataFrame, shingle_words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text) -> facts: doc_id, fetch and the name of the row's set; groups: the name of a set, its group.

    A set goes by its own 128-bit name and size, and has a number of its own while links are looked for, so rows that
    share a doc_id don't meet. fetch is a hash of doc_id and text, by which a set's text is found again.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("fetch", F.xxhash64("doc_id", "text")).select("doc_id", "fetch", "text")
    sketch = rows.mapInArrow(_sketch(shingle_words, percent), "doc_id long, fetch long, n_shingles long, d1 long, d2 long, bands array<long>, least array<long>")
    sketch = written(sketch, "minhash")
    linked = sketch.where("n_shingles > 0")
    # numbers are written once
    nodes = linked.groupBy(*_NAME).agg(F.min("fetch").alias("fetch"), F.any_value("bands").alias("bands"))
    nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()), "minhash-nodes")

    bands = nodes.select("node", F.explode("bands").alias("key"))
    met = bands.groupBy("key").agg(F.min("node").alias("head"), F.count("*").alias("met")).where("met > 1").select("key", "head")
    # only bands that hold two nodes or more go on
    bands = written(bands.join(written(met, "minhash-heads"), "key"), "minhash-bands")

    # shingles that are among the first of two sets or more, and the nodes that have enough of them: no others can link
    # a set goes by one 64-bit name here: should two sets share it, both stay candidates
    name = F.xxhash64(*reversed(_NAME)).alias("s")
    firsts = linked.select(name, F.explode("least").alias("h"))

    def shared(rows: DataFrame) -> DataFrame:
        return rows.join(rows.groupBy("h").agg(F.count("*").alias("c")).where("c > 1").select("h"), "h")

    # counted twice, since most shingles stand in one row only: over all rows, then over those left with copies taken as one
    several = written(shared(firsts).distinct(), "minhash-several")
    meet = written(shared(several).join(nodes.select(name, "node", "n_shingles"), "s").select("h", "node", "n_shingles"), "minhash-meet")
    facts, named = written(sketch.select("doc_id", "fetch", *_NAME), "minhash-facts"), written(nodes.select("node", "fetch", *_NAME), "minhash-names")
    discard(several, sketch, nodes)
    # a partner has at least o shingles, the overlap needed, so both have at least so many among the first
    o = f"(({percent} * n_shingles + 99) div 100)"
    wanted = meet.groupBy("node", "n_shingles").agg(F.count("*").alias("c")).where(f"c >= least(8 + {o} div 16, ({percent} * {o} + 99) div 100)").select("node")
    wanted = written(wanted, "minhash-wanted")
    wanted = wanted.join(named, "node")
    # rows of other texts can come along; they have other names
    texts = rows.join(wanted.select("fetch"), "fetch", "left_semi").select("text")
    sets = texts.mapInArrow(_sets(shingle_words), "n_shingles long, d1 long, d2 long, shingles array<long>").join(wanted.drop("fetch"), _NAME)
    sets = written(sets.groupBy("node").agg(F.any_value("shingles").alias("shingles")), "minhash-sets")

    # a shingle that no other node has is in no intersection: it bounds every likeness of its node
    alone = sets.select("node", F.explode("shingles").alias("h")).groupBy("h").agg(F.count("*").alias("c"), F.min("node").alias("node")).where("c = 1")
    alone = alone.groupBy("node").agg(F.count("*").alias("alone"))
    sizes = sets.select("node", F.size("shingles").cast("long").alias("n")).join(alone, "node", "left").select("node", "n", (F.col("n") - F.coalesce("alone", F.lit(0))).alias("most"))
    sizes = written(sizes.where(f"100 * most >= {percent} * n"), "minhash-sizes")
    bands = bands.drop("head").join(sizes, "node")
    met = bands.groupBy("key").agg(F.min("node").alias("head"), F.count("*").alias("met")).where("met > 1").select("key", "head")
    bands = written(bands.join(written(met, "minhash-heads"), "key"), "minhash-bands")

    def may_link(n: str, most: str, m: str, most2: str) -> str:
        return f"100 * least({most}, {most2}) >= {percent} * ({n} + {m} - least({most}, {most2}))"

    heads = bands.where("node <> head").groupBy("node", "head", "n", "most").agg(F.count("*").alias("bands"))
    heads = heads.join(sizes.select(F.col("node").alias("head"), F.col("n").alias("n2"), F.col("most").alias("most2")), "head")
    heads = written(heads.where(may_link("n", "most", "n2", "most2")).select("node", "head", "bands"), "minhash-pairs")

    best = heads.groupBy("node").agg(F.max(F.struct("bands", (-F.col("head")).alias("least"))).alias("x")).select(F.col("node").alias("b"), (-F.col("x.least")).alias("a"))
    roots = components(_confirmed(best, sets, percent))

    def apart(pairs: DataFrame) -> DataFrame:
        """Those of the pairs whose ends have different roots so far."""
        for end in "ab":
            pairs = pairs.join(roots.select(F.col("node").alias(end), F.col("root").alias(f"r{end}")), end, "left")
        return pairs.where("coalesce(ra, a) <> coalesce(rb, b)").select("a", "b")

    rest = heads.select(F.col("head").alias("a"), F.col("node").alias("b")).join(best, ["a", "b"], "left_anti")
    roots = extended(roots, _confirmed(apart(rest), sets, percent))

    # nodes that meet in one of their first shingles and are still apart
    placed = meet.join(sizes.select("node"), "node").join(roots, "node", "left").select("h", "node", F.coalesce("root", "node").alias("root"))
    open_keys = placed.groupBy("h").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1").select("h")
    apart_nodes = written(placed.join(open_keys, "h", "left_semi").select("node", "root").distinct(), "minhash-apart")
    if not apart_nodes.isEmpty():
        roots = extended(roots, _confirmed(_across(apart_nodes, sets, percent), sets, percent))

    discard(sets, meet)
    groups = named.join(roots, "node", "left").select(*_NAME, F.coalesce("root", "node").alias("group"))
    return facts, written(groups, "minhash-groups")


def near_duplicates(docs: DataFrame, shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, text) -> doc_id, n_shingles, component_id, kept, one row per row of docs.

    Linked are rows with 100 * shared shingles >= percent * all shingles. component_id is the least
    doc_id reachable, kept says doc_id = component_id. Rows without words link with nothing and are
    kept. A null doc_id takes no part in linking: its component_id is null and it is kept. Rows that
    repeat a doc_id are rows of their own, each in the component of its text. Other columns are ignored. An empty table gives none.
    """
    facts, groups = _grouped(docs.where("doc_id IS NOT NULL"), shingle_words, percent)
    named = facts.drop("fetch").join(groups, _NAME, "left")
    least = written(named.where("group IS NOT NULL").groupBy("group").agg(F.min("doc_id").alias("least")), "minhash-least")
    out = named.join(least, "group", "left").select("doc_id", "n_shingles", F.coalesce("least", "doc_id").alias("component_id"))
    alone = docs.where("doc_id IS NULL").select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("fetch"), F.col("text").cast("string").alias("text"))
    alone = alone.mapInArrow(_sketch(shingle_words, percent), "doc_id long, fetch long, n_shingles long, d1 long, d2 long, bands array<long>, least array<long>")
    out = out.unionByName(alone.select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def one_of_each(docs: DataFrame, shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """docs (doc_id, text, more) with one row of each group of near duplicates: the one with the least doc_id.

    Rows are told apart by doc_id and text, so of rows that repeat both one stays, and rows with a null doc_id take
    part; they stay only where no other row of the group has one. Of different texts that share the least doc_id the one with the least
    hash stays. Rows without words all stay. Columns of any name are left as they are. docs may be read again, in any order.
    """
    facts, groups = _grouped(docs, shingle_words, percent)
    own = facts.where("n_shingles > 0").groupBy("doc_id", "fetch", *_NAME).agg(F.count("*").alias("times")).join(groups, _NAME)
    own = written(own.select("doc_id", "fetch", "times", "group"), "minhash-own")
    best = own.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fetch")).alias("x"))
    own = written(own.join(best, "group").withColumn("stays", F.col("doc_id").eqNullSafe(F.col("x.doc_id")) & (F.col("fetch") == F.col("x.fetch"))), "minhash-stays")
    tag = "_" + uuid.uuid4().hex
    keyed = docs.withColumn(tag, F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")))

    def found(rows: DataFrame, how: str) -> DataFrame:
        keys = rows.select(F.col("doc_id").alias(f"{tag}d"), F.col("fetch").alias(f"{tag}f"))
        return keyed.join(keys, (keyed[tag] == keys[f"{tag}f"]) & keyed["doc_id"].cast("long").eqNullSafe(keys[f"{tag}d"]), how)

    again = own.where("stays AND times > 1")
    if again.isEmpty():
        out = found(own.where("NOT stays"), "left_anti")
    else:
        # of rows that repeat each other one stays
        out = found(own.where("NOT stays OR times > 1"), "left_anti").unionByName(found(again, "left_semi").dropDuplicates(["doc_id", tag]))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
