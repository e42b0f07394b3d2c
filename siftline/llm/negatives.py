"""Hard negatives by a secondary sort.

Anchors meet all rows in blocks: a task holds one block of anchors and one of rows and
multiplies them. A first pass finds each anchor's positives. A second one packs the scores
of what can still matter, the positives and each block's first negatives of every window,
into keys (anchor, descending score, positives first, id). repartitionAndSortWithinPartitions
puts each anchor's keys in order, and an iterator goes over them once: a positive opens a
window of scores, a negative inside an open window is given out, so no anchor's list is held.
"""

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftline.llm.common import written

#: anchor's row, inverted score, 0 for a positive and 1 for a negative, 1 for a null id, id, the anchor's id: bytes compare as the fields do
KEY = np.dtype([("row", ">u8"), ("score", ">u8"), ("kind", "u1"), ("null", "u1"), ("id", ">u8"), ("anchor", ">u8")])
_KEY = ">QQBBQQ"
_SIGN = 1 << 63
#: products up to this bound are exact in doubles
_EXACT = 1 << 52
_SLICE = 256
OUT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def _matrix(vectors: pa.ChunkedArray, dims: int) -> np.ndarray:
    return vectors.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), dims)


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products, exact: in doubles where they fit, else in Python integers, cut to 64 bits."""
    largest = lambda m: max(abs(int(m.max(initial=0))), abs(int(m.min(initial=0))))
    if largest(a) * largest(b) * max(1, a.shape[1]) < _EXACT:
        return np.rint(a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if not a.shape[1]:
        return np.zeros((len(a), len(b)), np.int64)
    whole = a.astype(object) @ b.astype(object).T
    return np.clip(whole, -(_SIGN - 1), _SIGN - 1).astype(np.int64)


def _ordered(scores: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each line the places of the valid cells, higher scores first, then lower places; the scores in that order; how many are valid."""
    n = scores.shape[1]
    counts = valid.sum(axis=1)
    if np.abs(scores).max(initial=0) < (1 << 62) // max(1, n):
        # one sort of whole numbers: the score, then the place
        packed = np.where(valid, scores * n + (n - 1 - np.arange(n)), np.iinfo(np.int64).min)
        packed = np.sort(packed, axis=1)[:, ::-1]
        return n - 1 - packed % n, packed // n, counts
    order = np.stack([np.lexsort((-scores[k], ~valid[k])) for k in range(len(scores))]) if len(scores) else np.zeros(scores.shape, np.int64)
    return order, np.take_along_axis(scores, order, axis=1), counts


def _by_id(table: pa.Table) -> pa.Table:
    """Rows of a block by id, null last, so that places break ties as ids do."""
    return table.sort_by([("id", "ascending")])


def _positives(n_positives: int) -> Callable:
    def run(key, anchors: pa.Table, rows: pa.Table) -> pa.Table:
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), pa.array([], pa.int64()))]
        if len(anchors) and len(rows):
            dims, rows = key[0].as_py(), _by_id(rows)
            a, b = _matrix(anchors["vector"], dims), _matrix(rows["vector"], dims)
            (a_row, a_label), (b_row, b_label) = ((t["row"].to_numpy(), t["label"].to_numpy()) for t in (anchors, rows))
            for label in np.unique(a_label):
                left, right = np.flatnonzero(a_label == label), np.flatnonzero(b_label == label)
                for low in range(0, len(left) if len(right) else 0, _SLICE):
                    own = left[low : low + _SLICE]
                    place, score, counts = _ordered(_scores(a[own], b[right]), a_row[own][:, None] != b_row[right])
                    line, k = np.nonzero(np.arange(min(n_positives, len(right))) < counts[:, None])
                    out.append((a_row[own][line], score[line, k], rows["id"].combine_chunks().take(pa.array(right[place[line, k]]))))
        rows_, scores, ids = zip(*out)
        return pa.table({"anchor_row": np.concatenate(rows_), "score": np.concatenate(scores), "id": pa.concat_arrays(ids)})

    return run


def _keys(row: np.ndarray, score: np.ndarray, kind: int, ids: pa.Array, anchor: np.ndarray) -> np.ndarray:
    flip = lambda x: x.astype(np.int64).view(np.uint64) ^ np.uint64(_SIGN)
    out = np.zeros(len(row), KEY)
    out["row"], out["score"], out["kind"], out["anchor"] = flip(row), ~flip(score), kind, flip(anchor)
    out["null"], out["id"] = ids.is_null().to_numpy(zero_copy_only=False), flip(ids.fill_null(0).to_numpy(zero_copy_only=False))
    return out


def _packed(keys: list[np.ndarray]) -> pa.Table:
    # concatenate turns the fields into native byte order
    keys = np.concatenate(keys).astype(KEY) if keys else np.zeros(0, KEY)
    offsets = np.arange(len(keys) + 1, dtype=np.int32) * KEY.itemsize
    return pa.table({"key": pa.Array.from_buffers(pa.binary(), len(keys), [None, pa.py_buffer(offsets), pa.py_buffer(keys.tobytes())])})


def _negatives(n_negatives: int, low: int, high: int) -> Callable:
    def run(key, anchors: pa.Table, rows: pa.Table) -> pa.Table:
        keys = []
        if len(anchors) and len(rows):
            dims, rows = key[0].as_py(), _by_id(rows)
            a, b = _matrix(anchors["vector"], dims), _matrix(rows["vector"], dims)
            a_row, a_id, a_label, b_label = anchors["row"].to_numpy(), anchors["id"].to_numpy(), anchors["label"].to_numpy(), rows["label"].to_numpy()
            ids, marks = rows["id"].combine_chunks(), anchors["positive_scores"].to_pylist()
            for start in range(0, len(a), _SLICE):
                own = np.arange(start, min(start + _SLICE, len(a)))
                place, score, counts = _ordered(_scores(a[own], b), a_label[own][:, None] != b_label)
                for line, k in enumerate(own):
                    found, m = -score[line, : counts[line]], set()
                    for mark in set(marks[k]):
                        # whole scores s with low * mark <= 100 * s <= high * mark
                        first, last = high * mark // 100, -(-low * mark // 100)
                        begin = int(np.searchsorted(found, -first))
                        m.update(range(begin, min(begin + n_negatives, int(np.searchsorted(found, -last, "right")))))
                    if m:
                        at = np.fromiter(m, np.int64)
                        keys.append(_keys(np.full(len(at), a_row[k]), -found[at], 1, ids.take(pa.array(place[line, at])), np.full(len(at), a_id[k])))
        return _packed(keys)

    return run


def _positive_keys(batches):
    for x in batches:
        keys = _keys(x["anchor_row"].to_numpy(), x["score"].to_numpy(), 0, x["id"], x["anchor_id"].to_numpy())
        yield from _packed([keys]).to_batches()


def _anchor_of(key: bytes) -> int:
    return (int.from_bytes(key[:8], "big") * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) >> 33


def _streamed(n_positives: int, n_negatives: int, low: int, high: int) -> Callable:
    """Over sorted keys: at most n_positives open windows are held, whatever an anchor's number of rows."""

    def run(records: Iterator) -> Iterator[tuple]:
        anchor, opened, windows = None, 0, []
        for key, _ in records:
            row, score, kind, null, id_, anchor_id = struct.unpack(_KEY, key)
            if row != anchor:
                anchor, opened, windows = row, 0, []
            score, id_ = (~score & 0xFFFFFFFFFFFFFFFF) - _SIGN, None if null else id_ - _SIGN
            if not kind:
                if opened < n_positives:
                    opened += 1
                    windows.append([id_, score, 0])
                continue
            closed = False
            for window in windows:
                if 100 * score < low * window[1]:
                    closed = True  # scores only fall from here
                elif 100 * score <= high * window[1]:
                    window[2] += 1
                    closed |= window[2] == n_negatives
                    yield anchor_id - _SIGN, window[0], window[2], id_, window[1], score
            if closed:
                windows = [w for w in windows if w[2] < n_negatives and 100 * score >= low * w[1]]

    return run


def mine(rows: DataFrame, n_positives: int = 5, n_negatives: int = 3, low: int = 50, high: int = 95, anchor_block: int = 2048, row_block: int = 4096) -> DataFrame:
    """(id, label, vector array<long>, anchor boolean) -> anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    A row's score is its integer inner product with the anchor; higher scores come first, ties by smaller id, a
    null id last. An anchor's positives are its first n_positives other rows of its label; for each, the first
    n_negatives rows of other labels with low * positive <= 100 * negative <= high * positive are given, rank from 1.
    Rows with a null label or vector, or a null component, take no part. Rows that repeat an id are rows of their own,
    as anchors too. Only vectors of equal length are compared. Scores beyond 64 bits count as the
    nearest 64-bit integer. An anchor without an id is none. Other columns are ignored. An empty table gives none.
    """
    spark = rows.sparkSession
    # ids of rows are written once, so they stay when a task runs again
    base = rows.where("label IS NOT NULL AND vector IS NOT NULL AND forall(vector, x -> x IS NOT NULL)")
    base = base.select(F.monotonically_increasing_id().alias("row"), F.col("id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), F.col("vector").cast("array<long>").alias("vector"), (F.coalesce("anchor", F.lit(False)) & F.col("id").isNotNull()).alias("anchor"))
    base = written(base, "negatives-rows").withColumn("dims", F.size("vector"))
    n_rows, n_anchors = base.agg(F.count("*"), F.count_if("anchor")).first()
    block = lambda n, size: F.pmod(F.xxhash64("row"), F.lit(max(1, -(-n // size)))).cast("int")
    every = lambda n, size: F.explode(F.sequence(F.lit(0), F.lit(max(1, -(-n // size)) - 1)))
    blocks = ["dims", "anchors", "rows"]

    def met(anchors: DataFrame, run: Callable, schema: str) -> DataFrame:
        left = anchors.withColumn("anchors", block(n_anchors, anchor_block)).withColumn("rows", every(n_rows, row_block))
        right = base.drop("anchor").withColumn("rows", block(n_rows, row_block)).withColumn("anchors", every(n_anchors, anchor_block))
        left, right = left.toDF(*left.columns), right.toDF(*right.columns)  # columns of their own, though both come from base
        return left.groupBy(*blocks).cogroup(right.groupBy(*blocks)).applyInArrow(run, schema)

    anchors = base.where("anchor").drop("anchor")
    best = met(anchors, _positives(n_positives), "anchor_row long, score long, id long")
    order = Window.partitionBy("anchor_row").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    best = written(best.withColumn("k", F.row_number().over(order)).where(F.col("k") <= n_positives).drop("k"), "negatives-positives")
    marks = best.groupBy(F.col("anchor_row").alias("row")).agg(F.collect_list("score").alias("positive_scores"))
    keys = met(anchors.join(marks, "row"), _negatives(n_negatives, low, high), "key binary")
    named = best.join(anchors.select(F.col("row").alias("anchor_row"), F.col("id").alias("anchor_id")), "anchor_row")
    keys = keys.unionByName(named.select("anchor_row", "score", "id", "anchor_id").mapInArrow(_positive_keys, "key binary"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = keys.rdd.map(lambda r: (bytes(r[0]), None)).repartitionAndSortWithinPartitions(tasks, partitionFunc=_anchor_of)
    return spark.createDataFrame(ordered.mapPartitions(_streamed(n_positives, n_negatives, low, high)), OUT, verifySchema=False)
