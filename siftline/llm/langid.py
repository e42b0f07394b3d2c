"""Language identification by nearest centroid.

A text's vector holds the TF-IDF weights of its byte trigrams, hashed into 8192 cells,
with log term frequency and unit length. Each language has several centroids, found by
spherical k-means; a text gets the language of the centroid with the largest cosine and
is rejected where that cosine is far below what the language's own texts have.
"""

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.llm import bytetext

BITS = 13
_CELLS = 1 << BITS
_PIECE = 4 << 20


@dataclass
class Model:
    idf: np.ndarray
    centroids: np.ndarray
    langs: list
    least: np.ndarray


def letters(text: Column) -> Column:
    """Lower case, each run of other characters than letters one space, a space at both ends; empty without letters."""
    out = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{M}]+", " ")), F.lit(" "))
    return F.when(out.rlike(r"\p{L}"), out).otherwise(F.lit(""))


def _counts(texts: pa.Array):
    """(low, high, counts of each cell) for runs of texts; long texts are counted in pieces."""
    data, offsets = bytetext.buffer_of(texts)
    for low, high in bytetext.groups(offsets, most_texts=256):
        n = high - low
        counts = np.zeros(n * _CELLS, np.int64)
        for a in range(offsets[low], offsets[high], _PIECE):
            b = min(a + _PIECE + 2, offsets[high])
            x = data[a:b].astype(np.uint32)
            if len(x) < 3:
                continue
            grams = x[:-2] | x[1:-1] << np.uint32(8) | x[2:] << np.uint32(16)
            cells = (grams * np.uint32(2654435761)) >> np.uint32(32 - BITS)
            at = np.arange(a, b - 2)
            doc = np.searchsorted(offsets[low : high + 1], at, "right") - 1
            inside = at + 2 < offsets[low + doc + 1]
            counts += np.bincount(doc[inside] * _CELLS + cells[inside], minlength=n * _CELLS)
        yield low, high, counts.reshape(n, _CELLS)


def _vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(counts, dtype=np.float32) * idf
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)


def _frequencies(batches):
    total, n = np.zeros(_CELLS, np.int64), 0
    for batch in batches:
        for low, high, counts in _counts(batch.column(0)):
            total += (counts > 0).sum(axis=0)
            n += high - low
    if n:
        yield pa.RecordBatch.from_arrays([pa.array(np.append(np.arange(_CELLS), -1)), pa.array(np.append(total, n))], names=["cell", "n"])


def _clusters(v: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means; begins with texts far from each other."""
    picks = [0]
    while len(picks) < min(k, len(v)):
        picks.append(int(np.argmin((v @ v[picks].T).max(axis=1))))
    centres = v[picks]
    for _ in range(10):
        own = (v @ centres.T).argmax(axis=1)
        centres = np.stack([v[own == c].sum(axis=0) if (own == c).any() else centres[c] for c in range(len(centres))])
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-9)
    return centres


def fit(docs: DataFrame, max_rows: int = 1200, centroids: int = 4, slack: float = 0.25) -> Model | None:
    """(doc_id, text, lang) -> model, or None without rows to learn from.

    Document frequencies count every row. Centroids come from at most max_rows rows, shared evenly
    among the languages and chosen by a hash of doc_id and text; more languages than rows are refused. A text is rejected below slack
    times the cosine that all but one in a hundred of a language's sample texts have with its centroids. Rows with a null
    lang, and texts without letters, teach nothing.
    """
    rows = docs.where("lang IS NOT NULL").select(F.col("lang").cast("string").alias("lang"), letters(F.col("text")).alias("text"), F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)).alias("h")).where("text <> ''")
    sizes = {x["lang"]: x["n"] for x in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(max_rows + 1).collect()}
    if len(sizes) > max_rows:
        raise ValueError("more languages than max_rows: each one needs a row to learn from")
    if not sizes:
        return None
    found = rows.select("text").mapInArrow(_frequencies, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    # the last cell counts the texts
    df = np.zeros(_CELLS + 1, np.int64)
    df[found["cell"].to_numpy()] = found["n"].to_numpy()
    idf = (np.log((1 + df[-1]) / (1 + df[:-1])) + 1).astype(np.float32)

    def embed(batches):
        for batch in batches:
            for low, high, counts in _counts(batch.column(0)):
                v = _vectors(counts, idf)
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(low, high - low), pa.ListArray.from_arrays(pa.array(np.arange(high - low + 1, dtype=np.int32) * _CELLS), pa.array(v.ravel()))], names=["lang", "v"])

    each = max(1, max_rows // len(sizes))
    share = F.coalesce(*[F.when(F.col("lang") == lang, F.lit(int(min(1.0, 0.9 * each / n) * (1 << 30)))) for lang, n in sizes.items()], F.lit(0))
    sample = rows.where(F.col("h") < share).select("text", "lang").mapInArrow(embed, "lang string, v array<float>").limit(max_rows).toArrow()
    langs = np.array(sample["lang"].to_pylist())
    values = np.asarray(sample["v"].combine_chunks().flatten()).reshape(len(langs), _CELLS) if len(langs) else np.zeros((0, _CELLS), np.float32)
    centres, names, least = [], [], []
    for lang in sorted(sizes):
        v = values[langs == lang]
        if len(v):
            v = v[np.lexsort(v[:, :8].T)]
            c = _clusters(v, centroids)
            centres.append(c)
            names += [lang] * len(c)
            # not the least one, which a single odd text would set
            least += [slack * float(np.quantile((v @ c.T).max(axis=1), 0.01))] * len(c)
    return Model(idf, np.concatenate(centres), names, np.array(least)) if centres else None


def verdict(text: Column, model: Model | None) -> Column:
    """struct<lang_pred, score, rejected> of a text; score is the cosine, 0 to 1.

    Null texts, texts without letters, and every text where there is no model, are `und` with score 0
    and rejected. rejected also marks texts too far from every centroid of their language.
    """

    @F.arrow_udf("lang_pred string, score double, rejected boolean")
    def predict(texts: pa.Array) -> pa.Array:
        langs, best = np.full(len(texts), "und", object), np.zeros(len(texts))
        rejected = np.ones(len(texts), bool)
        for low, high, counts in _counts(texts) if model else ():
            cosine = _vectors(counts, model.idf) @ model.centroids.T
            top = cosine.argmax(axis=1)
            some = counts.any(axis=1)
            best[low:high] = np.where(some, np.clip(cosine.max(axis=1), 0, 1), 0)
            langs[low:high] = np.where(some, np.array(model.langs, object)[top], "und")
            rejected[low:high] = ~some | (cosine.max(axis=1) < model.least[top])
        pa.default_memory_pool().release_unused()
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(best), pa.array(rejected)], names=["lang_pred", "score", "rejected"])

    return predict(letters(text))


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs with the columns lang_pred, score and rejected of verdict, which replace same-named ones; all others stay."""
    name = "verdict_" + uuid.uuid4().hex
    out = docs.withColumn(name, verdict(F.col("text"), model))
    return out.withColumns({k: F.col(name)[k] for k in ("lang_pred", "score", "rejected")}).drop(name)
