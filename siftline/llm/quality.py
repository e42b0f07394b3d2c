"""Quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader.

A word is a maximal run of letters, digits and other non-ASCII bytes, or a maximal run
of punctuation. A repeated word's bigram is the same for all words. Unigrams and bigrams are hashed into 2^18 features with value
count / sqrt(number of n-grams), so a score is one sparse dot product.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm import bytetext

BITS = 18
_SAME = np.uint64(0x5DEECE66D5DEECE6)
#: 1: ASCII letters, digits and non-ASCII bytes; 2: punctuation; 0: white space and control bytes
_KINDS = np.array([1 if b >= 128 or chr(b).isalnum() else 0 if b <= 32 or b == 127 else 2 for b in range(256)], np.uint8)


def _features(texts: pa.Array):
    """(low, high, feature numbers, text numbers) for runs of texts."""
    data, offsets = bytetext.buffer_of(texts)
    shift = np.uint64(64 - BITS)
    for low, high in bytetext.groups(offsets):
        part = bytetext.LOWER[data[offsets[low] : offsets[high]]]
        starts, ends, doc = bytetext.runs(_KINDS[part], offsets[low : high + 1] - offsets[low])
        one = bytetext.hashes(part, starts, ends)
        inside = doc[1:] == doc[:-1]
        two = bytetext.mix(one[:-1] * np.uint64(0xD6E8FEB86659FD93) + one[1:])[inside]
        two[(one[1:] == one[:-1])[inside]] = _SAME  # a word twice in a row, whichever it is
        yield low, high, np.concatenate([one >> shift, two >> shift]).astype(np.int32), np.concatenate([doc, doc[1:][inside]])


def _extract(batches):
    for batch in batches:
        for low, high, f, doc in _features(batch.column(0)):
            f = f[np.argsort(doc, kind="stable")]
            ends = np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=high - low)))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(ends), pa.array(f)), batch.column(1).slice(low, high - low)], names=["features", "y"])


def follow_the_leader(features: list, y: np.ndarray, epochs: int = 3, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1) -> np.ndarray:
    """FTRL-proximal with a step size per coordinate; the last weight is the bias."""
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weight(i: np.ndarray) -> np.ndarray:
        w = (np.sign(z[i]) * l1 - z[i]) / ((beta + np.sqrt(n[i])) / alpha + l2)
        return np.where(np.abs(z[i]) > l1, w, 0.0)

    # features and their counts in two arrays of 32-bit integers, not in thousands of small ones
    n_all = sum(map(len, features))
    index, count, ends = np.empty(n_all, np.int32), np.empty(n_all, np.int32), np.zeros(len(features) + 1, np.int64)
    for k, f in enumerate(features):
        i, c = np.unique(f, return_counts=True)
        ends[k + 1] = ends[k] + len(i)
        index[ends[k] : ends[k + 1]], count[ends[k] : ends[k + 1]] = i, c
    for _ in range(epochs):
        for k, (f, t) in enumerate(zip(features, y, strict=True)):
            i = np.append(index[ends[k] : ends[k + 1]], 1 << BITS)
            x = np.append(count[ends[k] : ends[k + 1]] / np.sqrt(max(1, len(f))), 1.0)
            w = weight(i)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - t) * x
            z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha * w
            n[i] += g * g
    return weight(np.arange((1 << BITS) + 1)).astype(np.float32)


def fit(labelled: DataFrame, max_rows: int = 4000) -> np.ndarray:
    """(doc_id, text, y) -> weights, learned from at most max_rows rows.

    The rows are chosen by a hash of doc_id and text with a threshold set from their count, so the
    sample spreads over the whole table. Rows with a null y are ignored; without rows all weights are 0.
    """
    labelled = labelled.where("y IN (0, 1)").select("text", F.col("y").cast("double").alias("y"), F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)).alias("h"))
    total = labelled.count()
    if not total:
        return np.zeros((1 << BITS) + 1, np.float32)
    chosen = labelled.where(F.col("h") < int(min(1.0, 0.95 * max_rows / total) * (1 << 30))) if total > max_rows else labelled
    rows = chosen.select("text", "y").mapInArrow(_extract, "features array<int>, y double").limit(max_rows).toArrow()
    y = rows["y"].to_numpy()
    features = [np.asarray(x.values) for x in rows["features"]]
    # an order of its own, whatever the order of the partitions
    order = sorted(range(len(y)), key=lambda k: (int(features[k].sum(dtype=np.int64)) * 2654435761 % (1 << 32), len(features[k]), y[k]))
    return follow_the_leader([features[k] for k in order], y[order])


def score(text, weights: np.ndarray):
    """Column of scores from 0 to 1; null and empty texts get the bias's score."""

    @F.arrow_udf("double")
    def scores(texts: pa.Array) -> pa.Array:
        out = np.empty(len(texts))
        for low, high, f, doc in _features(texts):
            n = np.bincount(doc, minlength=high - low)
            dot = np.bincount(doc, weights[f], minlength=high - low) / np.sqrt(np.maximum(1, n))
            out[low:high] = 1 / (1 + np.exp(-np.clip(dot + weights[-1], -35, 35)))
        pa.default_memory_pool().release_unused()
        return pa.array(out)

    return scores(text)


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, y) for the documents with one agreed quality label."""
    y = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").groupBy(F.col("doc_id")).agg(F.min("quality").alias("y"), F.max("quality").alias("_y")).where("y = _y").select("doc_id", "y")
    return docs.select("doc_id", "text").join(y, "doc_id")


def classify(docs: DataFrame, weights: np.ndarray, threshold: float = 0.3) -> DataFrame:
    """docs with columns score and predicted (replacing any of these names), all rows kept.

    predicted is 1 where score >= threshold. Null and empty texts get the score of the bias alone.
    """
    out = docs.withColumn("score", score(F.col("text"), weights))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
