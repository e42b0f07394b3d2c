"""Token ids as files of independently decodable blocks, coded by static range ANS.

Block layout, little endian (one block per row of the Parquet table, which carries the
block's place in the order and commits whole or not at all):

    4 bytes  magic "RAN1"
    u32      crc32 of all that follows
    u32      lanes L, u32 steps per checkpoint C
    u64      ids N, u64 documents D
    D x u64  ids of each document
    u32      checkpoints K, then K x (u64 word position, L x u64 states)
    u64      words W, then W x u32 words

Ids are dealt to L interleaved lanes (id i to lane i mod L), each a 64-bit state with a
32-bit renormalisation. A checkpoint holds all states and the place in the words, so the
steps that follow it can be decoded without those before. All blocks share one frequency
table, scaled to 2^20, made from the counts of every id of every document.
"""

import os
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftline.llm import bytetext, spans
from siftline.llm.common import released, written

SCALE, LANES, STEPS = 20, 512, 128
_LOW = np.uint64(1 << 31)


def frequency_table(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frequencies that sum to 2^20 (an id that occurs has 1 at least) and their running sum."""
    total = counts.sum()
    if not total:
        counts, total = np.ones_like(counts), len(counts)
    freq = np.where(counts > 0, np.maximum(1, counts * (1 << SCALE) // total), 0).astype(np.int64)
    order = np.argsort(-freq, kind="stable")
    over, k = int(freq.sum()) - (1 << SCALE), 0
    while over > 0:
        cut = min(over, int(freq[order[k]]) * 3 // 4)
        freq[order[k]] -= cut
        over, k = over - cut, k + 1
    freq[order[0]] -= over
    return freq.astype(np.uint64), np.concatenate(([0], np.cumsum(freq))).astype(np.uint64)


def encode(ids: np.ndarray, lengths: np.ndarray, freq: np.ndarray, start: np.ndarray) -> bytes:
    """One block. Lanes run from the last step to the first, so that decoding runs forwards."""
    n = len(ids)
    steps = -(-n // LANES)
    state = np.full(LANES, _LOW, np.uint64)
    words, marks = [], []
    f_all, s_all = freq[ids], start[ids]
    shift = np.uint64(63 - SCALE)
    for t in range(steps - 1, -1, -1):
        f, s = f_all[t * LANES : (t + 1) * LANES], s_all[t * LANES : (t + 1) * LANES]
        x = state[: len(f)]
        big = x >= f << shift
        words.append((x[big] & np.uint64(0xFFFFFFFF)).astype(np.uint32)[::-1])
        x = np.where(big, x >> np.uint64(32), x)
        q = x // f
        state[: len(f)] = (q << np.uint64(SCALE)) + (x - q * f) + s
        if t % STEPS == 0:
            marks.append((sum(map(len, words)), state.copy()))
    flow = np.concatenate(words)[::-1] if words else np.zeros(0, np.uint32)
    body = [struct.pack("<IIQQ", LANES, STEPS, n, len(lengths)), lengths.astype("<u8").tobytes(), struct.pack("<I", len(marks))]
    for place, x in reversed(marks):
        body += [struct.pack("<Q", len(flow) - place), x.astype("<u8").tobytes()]
    body += [struct.pack("<Q", len(flow)), flow.astype("<u4").tobytes()]
    body = b"".join(body)
    return b"RAN1" + struct.pack("<I", zlib.crc32(body)) + body


def decode(block: bytes, freq: np.ndarray, start: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """ids and the ids of each document. All checkpoints of a block are decoded side by side."""
    if block[:4] != b"RAN1" or struct.unpack_from("<I", block, 4)[0] != zlib.crc32(block[8:]):
        raise ValueError("damaged block")
    lanes, span, n, docs = struct.unpack_from("<IIQQ", block, 8)
    at = 32
    lengths = np.frombuffer(block, "<u8", docs, at).astype(np.int64)
    at += 8 * docs
    (k,) = struct.unpack_from("<I", block, at)
    marks = np.frombuffer(block, np.dtype([("at", "<u8"), ("x", "<u8", (lanes,))]), k, at + 4)
    at += 4 + marks.nbytes
    (w,) = struct.unpack_from("<Q", block, at)
    flow = np.append(np.frombuffer(block, "<u4", w, at + 8), np.uint32(0)).astype(np.uint64)
    x, place = marks["x"].astype(np.uint64), marks["at"].astype(np.int64)
    out = np.zeros((k, span, lanes), np.uint16 if len(freq) <= 1 << 16 else np.uint32)
    mask, steps = np.uint64((1 << SCALE) - 1), -(-n // lanes)
    for t in range(min(span, steps)):
        live = np.arange(len(x)) * span + t < steps
        if not live.all():
            x, place = x[live], place[live]  # only the last run is shorter
        if (len(x) - 1) * span + t == steps - 1 and n % lanes:
            used = np.ones(x.shape, bool)
            used[-1, n % lanes :] = False
        else:
            used = None
        low = x & mask
        s = symbol[low.astype(np.int64)]
        out[: len(x), t] = s
        y = freq[s] * (x >> np.uint64(SCALE)) + low - start[s]
        small = y < _LOW
        if used is not None:
            small &= used
        nth = np.cumsum(small, axis=1)
        y = np.where(small, (y << np.uint64(32)) | flow[np.minimum(place[:, None] + nth - 1, w)], y)
        x = y if used is None else np.where(used, y, x)
        place = place + nth[:, -1]
    return out.reshape(-1)[:n].astype(np.int64), lengths


def symbols(freq: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(freq)), freq.astype(np.int64)).astype(np.int32)


def _tokenise(make: Callable[[], Callable[[list], list]], end_id: int, vocabulary: int):
    """Per document its place in the partition, the ids before it there, and its ids as 16-bit or 32-bit integers;
    per partition one more row (kind 1) with its counts of ids."""
    kind = "<u2" if vocabulary <= 1 << 16 else "<u4"
    width = int(kind[2])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_texts = make()
        counts, part, seq, before = np.zeros(vocabulary, np.int64), None, 0, 0
        for batch in released(batches):
            _, offsets = bytetext.buffer_of(batch.column(2))
            for low, high in bytetext.groups(offsets, _BLOCK):
                rows = batch.slice(low, high - low)
                part = rows.column(0)[0].as_py()
                found = encode_texts(rows.column(2).fill_null("").to_pylist())
                sizes = np.fromiter(map(len, found), np.int64, len(found))
                ids = np.full(int(sizes.sum()) + len(found), end_id, kind)
                ends = np.cumsum(sizes + 1)
                inside = np.ones(len(ids), bool)
                inside[ends - 1] = False
                ids[inside] = np.concatenate(found)
                counts += np.bincount(ids, minlength=vocabulary)
                binary = pa.Array.from_buffers(pa.large_binary(), len(found), [None, pa.py_buffer(np.concatenate(([0], ends)).astype(np.int64) * width), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(found), np.int32)), rows.column(0), pa.array(seq + np.arange(len(found))), pa.array(before + ends - sizes - 1), rows.column(1), binary.cast(pa.binary())], names=["kind", "part", "seq", "before", "doc_id", "ids"])
                seq, before = seq + len(found), before + len(ids)
        if part is not None:
            yield pa.RecordBatch.from_pylist([{"kind": 1, "part": part, "seq": seq, "before": before, "doc_id": None, "ids": counts.astype("<i8").tobytes()}], schema=pa.schema([("kind", pa.int32()), ("part", pa.int32()), ("seq", pa.int64()), ("before", pa.int64()), ("doc_id", pa.int64()), ("ids", pa.binary())]))

    return run


def _sum_counts(vocabulary: int):
    def run(batches):
        total = np.zeros(vocabulary, np.int64)
        for batch in batches:
            for x in batch.column(0):
                total += np.frombuffer(x.as_py(), "<i8")
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["id", "n"])

    return run


def _head_crc(part: int, before: int, docs: int, ids: int, doc_ids: pa.Array) -> int:
    """Over all that stands beside a block."""
    return zlib.crc32(struct.pack("<qqqq", part, before, docs, ids) + doc_ids.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes() + doc_ids.is_null().to_numpy(zero_copy_only=False).tobytes())


def _write_table(spark: SparkSession, path: str, counts: np.ndarray) -> None:
    """The shared frequency table, one row: how often each id stands in the file, and a crc32 of that. Its size is the vocabulary's."""
    raw = counts.astype("<i8").tobytes()
    spark.createDataFrame([(len(counts), bytearray(zlib.compress(raw)), zlib.crc32(raw))], "vocabulary long, counts binary, crc long").coalesce(1).write.parquet(f"{path}/table")


def _read_table(spark: SparkSession, path: str) -> np.ndarray:
    row = spark.read.parquet(f"{path}/table").first()
    raw = zlib.decompress(bytes(row["counts"]))
    if zlib.crc32(raw) != row["crc"] or len(raw) != 8 * row["vocabulary"]:
        raise ValueError("damaged frequency table")
    return np.frombuffer(raw, "<i8").astype(np.int64)


def write_token_file(docs: DataFrame, path: str, make: Callable[[], Callable[[list], list]], end_id: int, vocabulary: int, block_ids: int = 1 << 20) -> np.ndarray:
    """Encode every text of (doc_id, text), append end_id, write blocks in ascending doc_id order to path.

    make() gives, inside a task, a function from texts to arrays of ids. Null texts are empty. Rows with a
    null doc_id come first; rows of one doc_id follow each other by a hash of their text, so their order is
    always the same and a hot id is spread over partitions. A document longer than block_ids has a block of
    its own. Other columns are ignored. path/blocks has the blocks, path/table the frequency table, so the path is all that a
    reader needs. Returns the counts of ids. An empty table writes no block.
    """
    kind = "<u2" if vocabulary <= 1 << 16 else "<u4"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = ["doc_id", F.xxhash64("text"), F.xxhash64(F.lit(1), "text")]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).select(F.spark_partition_id().alias("part"), "doc_id", "text")
    tokens = written(ordered.mapInArrow(_tokenise(make, end_id, vocabulary), "kind int, part int, seq long, before long, doc_id long, ids binary"), "tokens")
    found = tokens.where("kind = 1").select("ids").mapInArrow(_sum_counts(vocabulary), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(vocabulary, np.int64)
    counts[found["id"].to_numpy()] = found["n"].to_numpy()
    freq, start = frequency_table(counts)

    def blocks(batches):
        ids, held, size, first, last = [], [], 0, None, None

        def block():
            lengths = np.array([len(i) for i in ids])
            columns = {"part": first[0], "before": first[2], "docs": len(ids), "ids": int(lengths.sum()), "doc_ids": held}
            columns |= {"crc": _head_crc(*list(columns.values())[:4], pa.array(held, pa.int64())), "block": encode(np.concatenate(ids), lengths, freq, start)}
            return pa.RecordBatch.from_pylist([columns], schema=pa.schema([("part", pa.int32()), ("before", pa.int64()), ("docs", pa.int64()), ("ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("crc", pa.int64()), ("block", pa.binary())]))

        for batch in batches:
            for part, seq, before, doc, x in zip(*(batch.column(k).to_pylist() for k in range(4)), batch.column(4), strict=True):
                new = np.frombuffer(x.as_buffer(), kind).astype(np.int64)
                # a block holds neighbours in the order only
                if ids and (size + len(new) > block_ids or (part, seq - 1) != last):
                    yield block()
                    ids, held, size = [], [], 0
                if not ids:
                    first = part, seq, before
                last = part, seq
                ids.append(new)
                held.append(doc)
                size += len(new)
        if ids:
            yield block()

    out = tokens.where("kind = 0").select("part", "seq", "before", "doc_id", "ids").mapInArrow(blocks, "part int, before long, docs long, ids long, doc_ids array<long>, crc long, block binary")
    out.write.option("compression", "none").parquet(f"{path}/blocks")
    _write_table(docs.sparkSession, path, counts)
    return counts


def read_token_file(spark: SparkSession, path: str, counts: np.ndarray | None = None) -> DataFrame:
    """Blocks of path -> doc_id, start (ids of all documents before it in the file), ids (binary, u32 each), n_tokens.

    counts, those that write_token_file gave, spare the look at path/table. A block, or what stands beside it, that has changed is an error.
    """
    freq, start = frequency_table(_read_table(spark, path) if counts is None else counts)

    def run(batches):
        symbol = symbols(freq)
        for batch in released(batches):
            heads = zip(*(batch.column(c).to_pylist() for c in ("part", "before", "docs", "ids", "crc")), strict=True)
            for first, head, doc_ids, block in zip(batch["start"].to_pylist(), heads, batch["doc_ids"], batch["block"], strict=True):
                if _head_crc(*head[:4], doc_ids.values) != head[4]:
                    raise ValueError("damaged head of a block")
                ids, lengths = decode(block.as_py(), freq, start, symbol)
                ends = np.cumsum(lengths)
                for low, high in _decoded_runs(ends):
                    begin = ends[low] - lengths[low]
                    offsets = np.concatenate(([0], ends[low:high] - begin)) * 4
                    raw = pa.Array.from_buffers(pa.binary(), high - low, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(ids[begin : ends[high - 1]].astype("<u4"))])
                    yield pa.RecordBatch.from_arrays([doc_ids.values[low:high], pa.array(first + ends[low:high] - lengths[low:high]), pa.array(lengths[low:high]), raw], names=["doc_id", "start", "n_tokens", "ids"])

    files = spark.read.parquet(f"{path}/blocks")
    # one row per partition that wrote, so both the window and the broadcast are bounded by the number of partitions
    sums = files.groupBy("part").agg(F.sum("ids").alias("n"))
    sums = sums.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    placed = files.join(F.broadcast(sums), "part").select((F.col("base") + F.col("before")).alias("start"), "part", "before", "docs", "ids", "crc", "doc_ids", "block")
    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def _decoded_runs(ends: np.ndarray, most: int = 1 << 19):
    """Runs of whole documents of at most so many ids."""
    low = 0
    while low < len(ends):
        begin = ends[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(ends, begin + most, "right")))
        yield low, high
        low = high


#: kinds of bytes. 0: ASCII white space, 1: ASCII letters, 2: digits, 3: punctuation, 4: all others
_KINDS = np.array([0 if b in b" \t\n\v\f\r" else 4 if b < 32 or b > 126 else 2 if chr(b).isdigit() else 1 if chr(b).isalpha() else 3 for b in range(256)], np.uint8)
_C3 = 0xC3  # leads the letters U+00C0 to U+00FF, but for the two signs U+00D7 and U+00F7
_BLOCK = 4 << 20


def _units(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Units of texts, lower-cased, and each unit's text number: runs of letters, single digits, runs of punctuation.

    A word with any other character, an apostrophe or a special token's begin is one unit, as it stands.
    """
    kinds = _KINDS[data]
    low = bytetext.LOWER[data]
    if len(data) and (kinds == 4).any():
        lead = np.flatnonzero(data[:-1] == _C3)
        second = data[lead + 1]
        lead = lead[(second >= 0x80) & (second < 0xC0) & (second != 0x97) & (second != 0xB7)]
        kinds[lead] = kinds[lead + 1] = 1
        upper = lead[data[lead + 1] < 0x9F] + 1
        low[upper] += 32
    odd = kinds == 4
    odd |= data == 0x27
    odd[:-1] |= (data[:-1] == 0x3C) & (data[1:] == 0x7C)
    if odd.any():
        starts, ends, _ = bytetext.runs((kinds != 0).view(np.uint8), offsets)
        seen = np.concatenate(([0], np.cumsum(odd)))
        odd_word = seen[ends] > seen[starts]
        inside = np.zeros(len(data) + 1, np.int8)
        inside[starts[odd_word]] += 1
        inside[ends[odd_word]] -= 1
        inside = np.cumsum(inside[:-1], dtype=np.int8).view(bool)
        kinds[inside] = 5
        low[inside] = data[inside]
    # each digit stands alone: neighbours get kinds of their own
    digits = np.flatnonzero(kinds == 2)
    kinds[digits] = 6 + digits % 2
    starts, ends, doc = bytetext.runs(kinds, offsets)
    return spans.units_of(low, starts, ends), doc


def _pieces(data: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of a long text that end behind white space."""
    out, a = [], 0
    while a < len(data):
        b = a + _BLOCK
        if b < len(data):
            near = np.flatnonzero(_KINDS[data[b : b + 4096]] == 0)
            if not len(near):
                near = np.flatnonzero(_KINDS[data[b:]] == 0)
            b = b + int(near[0]) + 1 if len(near) else len(data)
        out.append((a, min(b, len(data))))
        a = b
    return out


class _WordTable:
    """The library's ids of each distinct unit, met by this worker so far."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.table = spans.SpanTable(self._encode_units)

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_units(self, units: list[bytes]) -> list[list[int]]:
        """Units go to the library in lines of 2000: the id that ends a unit says so. Where the ends of a
        line are not as many as its units (odd words are among them), its units go one by one."""
        out = []
        lines = [[w.decode(errors="replace") for w in units[k : k + 2000]] for k in range(0, len(units), 2000)]
        plain = [[w for w in line if w.isalnum() or (w.isascii() and "'" not in w and "<|" not in w and w.isprintable())] for line in lines]
        for line, chosen, ids in zip(lines, plain, self._encode([" ".join(p) for p in plain]), strict=True):
            ends = np.flatnonzero(self.ends_word[ids]) + 1 if ids else np.zeros(0, np.int64)
            if len(ends) == len(chosen):
                cuts = ends.tolist()
                known = dict(zip(chosen, [ids[a:b] for a, b in zip([0, *cuts], cuts)], strict=True))
            else:
                known = {}
            rest = [w for w in line if w not in known]
            known.update(zip(rest, self._encode(rest), strict=True))
            out += [known[w] for w in line]
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        data, offsets = bytetext.buffer_of(pa.array(texts, pa.large_string()))
        out = []
        for low, high in bytetext.groups(offsets, _BLOCK):
            part, ends = data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
            if len(part) > _BLOCK:  # one long text
                out.append(np.concatenate([self.table.look_up(_units(part[a:b], np.array([0, b - a]))[0])[0] for a, b in _pieces(part)]))
                continue
            units, doc = _units(part, ends)
            ids, sizes = self.table.look_up(units)
            per_doc = np.bincount(doc, sizes, minlength=high - low).astype(np.int64)
            out += np.split(ids, np.cumsum(per_doc)[:-1])
        return out


@lru_cache(2)
def _word_table(path: str) -> _WordTable:
    """Kept by a worker for its later tasks."""
    return _WordTable(path)


def word_bpe(path: str) -> Callable[[], Callable[[list], list]]:
    """make() for a tokenizers file that lower-cases, and parts letters, single digits, punctuation and white space before it looks for pairs.

    The library encodes each distinct unit once; the ids of a text are those of its units.
    """
    return lambda: _word_table(path).encode
