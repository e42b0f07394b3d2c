"""Ids of the distinct units (words, parts of words) that a worker has met, kept as Arrow and numpy arrays."""

from collections.abc import Callable
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def units_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """data[start:end] as binary values. The runs are in order and don't overlap; what lies between them is left out."""
    sizes = ends - starts
    if len(starts) and (starts[0] != 0 or ends[-1] != len(data) or (starts[1:] != ends[:-1]).any()):
        inside = np.zeros(len(data) + 1, np.int8)
        inside[starts] += 1
        inside[ends] -= 1
        data = data[np.cumsum(inside[:-1], dtype=np.int8).view(bool)]
    offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def gathered(pool: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """pool[begin:begin + size] of all spans, one after the other."""
    ends = np.cumsum(sizes)
    at = np.ones(int(ends[-1]) if len(ends) else 0, np.int64)
    if not len(at):
        return pool[:0]
    # a running sum of steps: 1 inside of a span, the way to the next one's begin between two
    full = sizes > 0
    begins, sizes, ends = begins[full], sizes[full], ends[full]
    at[0] = begins[0]
    at[ends[:-1]] = begins[1:] - begins[:-1] - sizes[:-1] + 1
    return pool[np.cumsum(at, out=at)]


def _longer(values: np.ndarray, n: int) -> np.ndarray:
    """At least n cells, by doubling."""
    return values if n <= len(values) else np.concatenate([values, np.zeros(max(n, 2 * len(values)) - len(values), values.dtype)])


class SpanTable:
    """encode() turns a list of byte strings into lists of ids. Up to so many units are kept, then it begins anew."""

    def __init__(self, encode: Callable[[list[bytes]], list], most: int = 1_000_000):
        self.encode, self.most = encode, most
        self.forget()

    def forget(self) -> None:
        self.units = pa.array([], pa.large_binary())
        self.begins, self.pool = np.zeros(1 << 12, np.int64), np.zeros(1 << 14, np.int32)

    def _add(self, new: pa.Array) -> None:
        found = self.encode(new.to_pylist())
        n, sizes = len(self.units), np.fromiter(map(len, found), np.int64, len(found))
        used, total = int(self.begins[n]), int(sizes.sum())
        self.begins = _longer(self.begins, n + 1 + len(found))
        self.begins[n + 1 : n + 1 + len(found)] = used + np.cumsum(sizes)
        self.pool = _longer(self.pool, used + total)
        self.pool[used : used + total] = np.fromiter(chain.from_iterable(found), np.int32, total)
        self.units = pa.concat_arrays([self.units, new])

    def look_up(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all units, one after the other, and how many each unit has."""
        coded = units.dictionary_encode()
        at = pc.index_in(coded.dictionary, value_set=self.units)
        if at.null_count:
            new = coded.dictionary.filter(at.is_null())
            if len(self.units) + len(new) > self.most:
                self.forget()
                at, new = pa.nulls(len(at), pa.int32()), coded.dictionary
            place = len(self.units)
            self._add(new)
            at = at.to_numpy(zero_copy_only=False)
            unknown = np.isnan(at)
            at = np.where(unknown, 0, at).astype(np.int64)
            at[unknown] = place + np.arange(len(new))
        else:
            at = at.to_numpy(zero_copy_only=False).astype(np.int64)
        k = at[coded.indices.to_numpy(zero_copy_only=False)]
        begins = self.begins[k]
        sizes = self.begins[k + 1] - begins
        return gathered(self.pool, begins, sizes), sizes
