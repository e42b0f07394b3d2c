"""Vectorised words and word hashes over the byte buffer of an Arrow string column.

A word's hash is a polynomial over random 64-bit byte values, taken from prefix
sums, so no Python string is made for a word. Buffers are hashed in blocks, which
bounds the memory whatever the length of a text.
"""

import numpy as np
import pyarrow as pa

_BLOCK = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE_VALUES = np.random.RandomState(20240229).randint(1, 2**63 - 1, 256, dtype=np.int64).astype(np.uint64)
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)
#: \x20 and \x09-\x0D
SPACES = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(max(n, _BLOCK), base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def buffer_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in a row, and where each text begins (one more entry: the end). Null reads as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = (texts if pa.types.is_large_binary(texts.type) else texts.cast(pa.large_string())).fill_null("")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def groups(offsets: np.ndarray, most_bytes: int = 1 << 20, most_texts: int = 4096):
    """Runs (low, high) of whole texts of at most so many bytes; one long text is a run of its own."""
    low, n = 0, len(offsets) - 1
    while low < n:
        high = int(np.searchsorted(offsets, offsets[low] + most_bytes, "right")) - 1
        high = min(max(high, low + 1), low + most_texts, n)
        yield low, high
        low = high


def runs(kinds: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of one kind other than 0 within a text: start, end, text number."""
    if not len(kinds):
        return (np.zeros(0, np.int64),) * 3
    change = np.empty(len(kinds) + 1, bool)
    change[0] = change[-1] = True
    np.not_equal(kinds[1:], kinds[:-1], out=change[1:-1])
    change[offsets] = True
    edges = np.flatnonzero(change)
    starts, ends = edges[:-1], edges[1:]
    keep = kinds[starts] != 0
    starts, ends = starts[keep], ends[keep]
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end]."""
    out = np.empty(len(starts), np.uint64)
    low = 0
    while low < len(starts):
        first = starts[low]
        high = max(int(np.searchsorted(ends, first + _BLOCK, "right")), low + 1)
        last = int(ends[high - 1])
        power, inverse = _power_tables(last - first)
        sums = np.zeros(last - first + 1, np.uint64)
        np.cumsum(_BYTE_VALUES[data[first:last]] * power[: last - first], out=sums[1:])
        a, b = starts[low:high] - first, ends[low:high] - first
        out[low:high] = mix((sums[b] - sums[a]) * inverse[a] + (b - a).astype(np.uint64))
        low = high
    return out


def shingle_hashes(words: np.ndarray, doc: np.ndarray, n_docs: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of the size-word shingles of each text, ordered by text and hash, and their text numbers.

    A text with fewer words has its whole sequence as one shingle; without words it has none.
    """
    counts = np.bincount(doc, minlength=n_docs)
    first = np.concatenate(([0], np.cumsum(counts)))[:-1]
    all_hashes, all_docs = [], []
    for length in range(1, size + 1):
        if length < size:
            at = first[counts == length]
        else:
            at = np.arange(max(0, len(words) - size + 1))
            at = at[doc[at] == doc[at + size - 1]]
        if len(at):
            h = np.full(len(at), length, np.uint64)
            for k in range(length):
                h = mix(h * np.uint64(0xD6E8FEB86659FD93) + words[at + k])
            all_hashes.append(h)
            all_docs.append(doc[at])
    if not all_hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h, d = np.concatenate(all_hashes), np.concatenate(all_docs)
    order = np.lexsort((h, d))
    h, d = h[order], d[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    return h[keep], d[keep]
