"""SentencePiece encoding and decoding as a max-plus scan.

A segmentation is a path over (position, last piece). A path's weight is the sum of its
pieces' weights, and -infinity where two neighbours may not stand together. For a unigram
model the weights are the scores and all neighbours may meet. For a BPE model all weights
are 0 and two pieces may meet only if merging their joined text gives just these two
pieces; exactly one path then has a weight above -infinity, and it is the model's own
encoding. Either way a position needs one best last piece for each state it is entered by.

Long documents are cut into chunks. A chunk's transfer matrix has a weight for each pair
of a state at its left cut (how far the piece over the cut reaches, and which piece it is)
and a state at its right cut. Matrices are multiplied in groups of up to 32 until one per
document is left; then the states at the cuts are traced back down the same groups, and
each chunk is encoded on its own between two known states.
"""

import re
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftline.llm import bytetext, spans
from siftline.llm.common import released, written

SPACE = "▁"
FANOUT = 32
#: pairs of pieces, of about 200 bytes each, and units, of about 40, that a worker keeps
_PAIRS, _UNITS = 200_000, 800_000
#: texts are encoded in groups of about so many bytes
_GROUP = 1 << 20
_STATE = 1 << 24  # a state is reach * _STATE + piece + 1


class Pieces:
    """A SentencePiece model file of kind BPE or unigram whose normaliser is the identity."""

    def __init__(self, path: str):
        self.path = path

    def __reduce__(self):
        return Pieces, (self.path,)

    @cached_property
    def _model(self):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(self.path, "rb") as f:
            model.ParseFromString(f.read())
        if model.normalizer_spec.precompiled_charsmap or model.normalizer_spec.remove_extra_whitespaces or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only models with the identity normaliser are read here")
        return model

    @cached_property
    def bpe(self) -> bool:
        return self._model.trainer_spec.model_type == 2

    @cached_property
    def scores(self) -> dict[str, float]:
        return {p.piece: p.score for p in self._model.pieces if p.type in (1, 4)}

    @cached_property
    def names(self) -> list[str]:
        return [p.piece for p in self._model.pieces]

    @cached_property
    def bytes_ids(self) -> dict[int, int]:
        return {int(p.piece[3:5], 16): k for k, p in enumerate(self._model.pieces) if p.type == 6}

    @cached_property
    def unknown(self) -> int:
        return next(k for k, p in enumerate(self._model.pieces) if p.type == 2)

    @cached_property
    def ids(self) -> dict[str, int]:
        """Pieces that a path may use. For BPE those that merging really makes."""
        own = {p.piece: k for k, p in enumerate(self._model.pieces) if p.type in (1, 4)}
        return {s: k for s, k in own.items() if len(self._merged(s)) == 1} if self.bpe else own

    @cached_property
    def longest(self) -> int:
        return max(map(len, self.ids))

    @cached_property
    def _prefixes(self) -> dict[str, bool]:
        """True for pieces, False for what only begins one."""
        out = {s[:k]: False for s in self.ids for k in range(1, len(s))}
        return out | dict.fromkeys(self.ids, True)

    @cached_property
    def _tree(self) -> dict:
        """Pieces by their characters; what a node stands for lies under the empty text."""
        root: dict = {}
        for s in self.ids:
            node = root
            for c in s:
                node = node.setdefault(c, {})
            node[""] = s
        return root

    @cached_property
    def _runs(self) -> frozenset[str]:
        """Runs of spaces; they tie in score."""
        return frozenset(s for s in self.ids if not s.strip(SPACE))

    @cached_property
    def _lowest(self) -> float:
        """Weight of a character without a piece."""
        return min(self.scores.values()) - 10

    @cached_property
    def splitter(self) -> re.Pattern | None:
        """Cuts a text where no piece can reach over; None if a space may stand inside a piece."""
        if any(SPACE in s.lstrip(SPACE) for s in self.scores):
            return None
        alone = "" if any("\n" in s for s in self.scores) else "\n"
        return re.compile(f"{SPACE}+[^{SPACE}{alone}]*|[^{SPACE}{alone}]+" + (f"|{alone}" if alone else ""))

    @cached_property
    def _neighbours(self) -> tuple[np.ndarray, np.ndarray]:
        """A number for each character that stands beside another in some piece (0: none), and which two numbers may
        stand side by side. A space is written as such."""
        pairs = {s[k : k + 2].replace(SPACE, " ") for s in self.ids for k in range(len(s) - 1)}
        number = np.zeros(0x110000, np.int16)
        chars = sorted({ord(c) for p in pairs for c in p})
        number[chars] = np.arange(1, len(chars) + 1)
        beside = np.zeros((len(chars) + 1, len(chars) + 1), bool)
        if pairs:
            beside[number[[ord(p[0]) for p in pairs]], number[[ord(p[1]) for p in pairs]]] = True
        return number, beside

    def units(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Normal texts (spaces as such) cut where no piece can reach over: the units, and each one's text number."""
        data, offsets = bytetext.buffer_of(texts)
        if not len(data):
            return pa.array([], pa.large_binary()), np.zeros(0, np.int64)
        number, beside = self._neighbours
        own = number[np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)]
        leads = np.flatnonzero((data & 0xC0) != 0x80)  # where characters begin
        cut = np.ones(len(leads), bool)
        cut[1:] = ~beside[own[:-1], own[1:]]
        first = offsets[:-1][offsets[:-1] < offsets[1:]]
        cut[np.searchsorted(leads, first)] = True
        starts = leads[cut]
        ends = np.append(starts[1:], len(data))
        return spans.units_of(data, starts, ends), np.searchsorted(offsets, starts, "right") - 1

    def _merged(self, s: str, steps: list | None = None) -> list[str]:
        """Merges of a short text, the highest score first and the leftmost of equals."""
        parts, scores = list(s), self.scores
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                score = scores.get(parts[k] + parts[k + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, k
            if at < 0:
                break
            if steps is not None:
                steps.append((parts[at], parts[at + 1]))
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    @cached_property
    def _meets(self) -> dict[tuple[str, str], bool]:
        return {}

    @cached_property
    def _halves(self) -> dict[str, tuple[str, str]]:
        """The two pieces that the last merge of a piece joins."""
        return {piece: self._last_merge(piece) for piece in self.ids if len(piece) > 1}

    def _last_merge(self, piece: str) -> tuple[str, str]:
        steps: list = []
        self._merged(piece, steps)
        return steps[-1]

    def meet(self, a: str, b: str) -> bool:
        """May b follow a? Undoes the merges on both sides of the border, the latest first, and asks each
        time whether the two pieces at the border would have been merged before that."""
        found = self._meets.get((a, b))
        if found is not None:
            return found
        if len(self._meets) > _PAIRS:
            self._meets.clear()
        if a in self._runs or b in self._runs:
            found = self._merged(a + b) == [a, b]
        else:
            halves, scores = self._halves, self.scores
            x, y, limit = a, b, None  # limit: (score, strict) that a merge over the border must beat
            found = True
            while True:
                score = scores.get(x + y)
                if score is not None and (limit is None or score > limit[0] or (score == limit[0] and limit[1])):
                    found = False
                    break
                left, right = halves.get(x), halves.get(y)
                if left is None and right is None:
                    break
                # of equal scores the left one is merged first
                if right is None or (left is not None and scores[x] < scores[y]):
                    limit, x = (scores[x], False), left[1]
                else:
                    limit, y = (scores[y], True), right[0]
        self._meets[a, b] = found
        return found

    def paths(self, s: str, begin: int, last: str | None, end: int, over: int) -> tuple[list, list]:
        """Best last piece, and weight, at each position from begin, entered after piece last.

        Positions beyond end (up to over) are only reached by a piece that begins before end.
        """
        known, scores, bpe, meets = self._prefixes, self.scores, self.bpe, self._meets
        best: list = [None] * (over + 1)
        weight = [0.0] * (over + 1)
        best[begin] = last or ""
        lowest = self._lowest
        for a in range(begin, min(end, over)):
            before = best[a]
            if before is None:
                continue
            p = a + 1
            while p <= over:
                piece = s[a:p]
                whole = known.get(piece)
                if whole is None and p > a + 1:
                    break
                if bpe:
                    if best[p] is None and (whole or (p == a + 1 and piece not in scores)):
                        ok = True if not whole or not before else meets.get((before, piece))
                        if self.meet(before, piece) if ok is None else ok:
                            best[p] = piece
                elif whole or p == a + 1:
                    w = weight[a] + (scores[piece] if whole else lowest)
                    if best[p] is None or w > weight[p]:
                        best[p], weight[p] = piece, w
                if whole is None:
                    break
                p += 1
        return best, weight

    def trace(self, best: list, begin: int, p: int) -> list[str]:
        out = []
        while p > begin:
            out.append(best[p])
            p -= len(best[p])
        return out[::-1]

    def numbers(self, pieces: list[str]) -> list[int]:
        """Ids; a character without a piece is its UTF-8 bytes, or the unknown id where there are none."""
        out = []
        for s in pieces:
            k = self.ids.get(s)
            if k is not None:
                out.append(k)
            elif self.bytes_ids:
                out += [self.bytes_ids[b] for b in s.encode()]
            else:
                out.append(self.unknown)
        return out

    def segment(self, s: str) -> list[int]:
        """Ids of a text that is entered at its begin and left at its end."""
        if not self.bpe:
            best, _ = self.paths(s, 0, None, len(s), len(s))
            return self.numbers(self.trace(best, 0, len(s)))
        whole = self.ids.get(s)
        if whole is not None:
            return [whole]
        # paths() for one entry of a BPE model, whose weights are all 0
        root, meets, n = self._tree, self._meets, len(s)
        best: list = [None] * (n + 1)
        best[0] = ""
        for a in range(n):
            before, node, p = best[a], root, a
            while p < n:
                node = node.get(s[p])
                if node is None:
                    break
                p += 1
                piece = node.get("")
                if piece and best[p] is None:
                    ok = meets.get((before, piece)) if before else True
                    if self.meet(before, piece) if ok is None else ok:
                        best[p] = piece
            if best[a + 1] is None:
                best[a + 1] = s[a]  # a character without a piece
        return self.numbers(self.trace(best, 0, n))

    def normal(self, text: str) -> str:
        return SPACE + text.replace(" ", SPACE) if text else ""

    @cached_property
    def _written(self) -> pa.Array:
        """What each id stands for, as bytes."""
        values = {k: bytes([b]) for b, k in self.bytes_ids.items()}
        return pa.array([values.get(k) or s.replace(SPACE, " ").encode() for k, s in enumerate(self.names)], pa.large_binary())

    def decode(self, ids: pa.Array, first: np.ndarray) -> pa.Array:
        """Texts of lists of ids; bytes that are not UTF-8 become U+FFFD. first: drop the space that encoding put in front."""
        flat, sizes = ids.flatten(), ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        joined = self._written.take(flat)
        data, ends = bytetext.buffer_of(joined)
        at = ends[np.concatenate(([0], np.cumsum(sizes)))]
        out = pa.Array.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(np.ascontiguousarray(at)), pa.py_buffer(np.ascontiguousarray(data))])
        try:
            out = out.cast(pa.large_string())
        except pa.ArrowInvalid:
            out = pa.array([x.decode(errors="replace") for x in out.to_pylist()], pa.large_string())
        led = pc.and_(pc.starts_with(out, " "), pa.array(first))
        return pc.if_else(led, pc.utf8_slice_codeunits(out, 1), out)

    def state(self, reach: int, piece: str) -> int:
        """A single unknown character has the numbers above those of the pieces."""
        k = self.ids.get(piece)
        return reach * _STATE + (k + 1 if k is not None else len(self.names) + 1 + ord(piece))

    def piece_of(self, state: int) -> str | None:
        k = state % _STATE - 1
        return None if k < 0 else self.names[k] if k < len(self.names) else chr(k - len(self.names))

    def entries(self, context: str, s: str) -> list[int]:
        """States in which a chunk s may be entered after the text context."""
        if not context:
            return [0]
        out = []
        for reach in range(min(self.longest, len(s) + 1)):
            for back in range(1, min(self.longest - reach, len(context)) + 1):
                piece = context[len(context) - back :] + s[:reach]
                if piece in self.ids or len(piece) == 1:
                    out.append(self.state(reach, piece))
        return out

    def exits(self, s: str, begin: int, last: str | None, n: int, final: bool) -> dict[int, tuple[float, list]]:
        """State at the right cut -> (weight, pieces from begin) for chunk s[:n], entered at begin."""
        if begin >= n:
            return {self.state(begin - n, last): (0.0, [])} if not final or begin == n else {}
        # before the first place that no piece can reach over, all depends on the entry
        best, weight = self.paths(s, begin, last, n, n if final else len(s))
        out = {}
        for p in [n] if final else range(n, len(s) + 1):
            if best[p] is not None and p - len(best[p]) < n:
                out[self.state(p - n, best[p])] = (weight[p], best)
        return out

    def matrix(self, context: str, s: str, n: int, final: bool) -> dict[tuple[int, int], float]:
        """Transfer weights of a chunk. Between its first and last free place the path is the same for all entries."""
        free = self._free(s, n)
        out = {}
        heads: dict[int, float] = {}
        for entry in self.entries(context, s):
            reach, piece = entry // _STATE, self.piece_of(entry)
            if free and reach <= free[0]:
                best, weight = self.paths(s, reach, piece, free[0], free[0])
                if reach == free[0] or best[free[0]] is not None:
                    heads[entry] = weight[free[0]]
            else:
                for leave, (w, _) in self.exits(s, reach, piece, n, final).items():
                    out[entry, leave] = w
        if heads:
            middle = 0.0 if self.bpe else sum(self.paths(x, 0, None, len(x), len(x))[1][-1] for x in self.splitter.findall(s[free[0] : free[-1]]))
            tail = s[free[-1] :]
            for leave, (w, _) in self.exits(tail, 0, None, n - free[-1], final).items():
                for entry, h in heads.items():
                    out[entry, leave] = h + middle + w
        return out

    def _free(self, s: str, n: int) -> list[int]:
        """First and last place before n that no piece can reach over."""
        if self.splitter is None:
            return []
        places = [m.start() for m in self.splitter.finditer(s, 0, n) if m.start()]
        return [places[0], places[-1]] if places else []

    def between(self, s: str, n: int, entry: int, leave: int, final: bool) -> tuple[list[int], str, list[int]]:
        """The pieces that begin in chunk s[:n], from state entry to state leave: ids up to the first place that no
        piece reaches over, the text from there to the last one, ids from the last one."""
        begin, last = entry // _STATE, self.piece_of(entry)
        end = n + leave // _STATE
        free = self._free(s, n)
        if begin >= n:
            return [], "", []
        if not free or begin > free[0]:
            best = self.exits(s, begin, last, n, final)[leave][1]
            return self.numbers(self.trace(best, begin, end)), "", []
        best, _ = self.paths(s, begin, last, free[0], free[0])
        tail = self.exits(s[free[-1] :], 0, None, n - free[-1], final)[leave][1]
        return self.numbers(self.trace(best, begin, free[0])), s[free[0] : free[-1]], self.numbers(self.trace(tail, 0, end - free[-1]))


def product(one: dict, two: dict) -> dict:
    """Max-plus product of two sparse matrices."""
    rows: dict[int, list] = {}
    for (a, b), w in two.items():
        rows.setdefault(a, []).append((b, w))
    out: dict = {}
    for (a, m), v in one.items():
        for b, w in rows.get(m, ()):
            if v + w > out.get((a, b), -float("inf")):
                out[a, b] = v + w
    return out


def backtrace(matrices: list[dict], entry: int, leave: int) -> list[tuple[int, int]]:
    """(entry, leave) of each of the matrices on the best path from entry to leave."""
    reached = [{entry: 0.0}]
    for m in matrices:
        now: dict = {}
        for (a, b), w in m.items():
            if a in reached[-1] and reached[-1][a] + w > now.get(b, -float("inf")):
                now[b] = reached[-1][a] + w
        reached.append(now)
    out = []
    for k in range(len(matrices) - 1, -1, -1):
        before = max((a for a, b in matrices[k] if b == leave and a in reached[k]), key=lambda a: (reached[k][a] + matrices[k][a, leave], -a))
        out.append((before, leave))
        leave = before
    return out[::-1]


@lru_cache(2)
def _loaded(path: str) -> tuple[Pieces, spans.SpanTable]:
    """A model, kept by a worker for its later tasks, and the units that its task has met so far."""
    model = Pieces(path)
    return model, spans.SpanTable(lambda units: [model.segment(u.decode().replace(" ", SPACE)) for u in units], _UNITS)


def _ended(batches, path: str):
    """The batches of a task; after the last one the worker gives back the units and Arrow's memory, so that later stages find room."""
    try:
        yield from batches
    finally:
        _loaded(path)[1].forget()
        pa.default_memory_pool().release_unused()


def _encode_texts(path: str, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids of normal texts (spaces as such), one after the other, and how many each text has."""
    model, table = _loaded(path)
    units, doc = model.units(texts)
    ids, sizes = table.look_up(units)
    return ids, np.bincount(doc, sizes, minlength=len(texts)).astype(np.int64)


def _cut(chunk_chars: int, longest: int):
    """Chunks of texts, with up to so many characters of what stands before and after each of them."""

    def run(batches):
        for batch in released(batches):
            for doc_id, text, row_id in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for low in range(0, len(text), 64 * chunk_chars):
                    rows = [
                        {"doc_id": doc_id, "row_id": row_id, "chunk": at // chunk_chars, "final": at + chunk_chars >= len(text), "own": text[at : at + chunk_chars], "after": text[at + chunk_chars : at + chunk_chars + longest], "before": text[max(0, at - longest) : at]}
                        for at in range(low, min(low + 64 * chunk_chars, len(text)), chunk_chars)
                    ]
                    yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("doc_id", pa.int64()), ("row_id", pa.int64()), ("chunk", pa.int64()), ("final", pa.bool_()), *[(c, pa.string()) for c in ("own", "after", "before")]]))

    return run


_MATRIX = "m array<struct<a:long,b:long,w:double>>"


def _unpack(rows) -> dict:
    return {(r["a"], r["b"]): r["w"] for r in rows}


def _pack(m: dict) -> list[dict]:
    return [{"a": int(a), "b": int(b), "w": float(w)} for (a, b), w in m.items()]


def encode(docs: DataFrame, model_path: str, chunk_chars: int = 1 << 15, decoded: bool = False) -> DataFrame:
    """(doc_id, text) -> doc_id, row_id, chunk, text, ids, with decoded also the column of decode(); each document's chunks from 0 on.

    A piece belongs to the chunk in which it begins, and a chunk's text is what its pieces cover: the chunks' texts
    (and ids), joined in order, are the document's. Null and empty texts give one chunk without ids. row_id is another
    one for each row of docs, so rows that repeat a doc_id (also a null one) stay apart. Other columns are
    ignored. A model with a piece of more than 64 characters is refused when a task loads it.
    """
    longest = 64  # characters of context at each side; a piece must not be longer
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))

    def whole(batches):
        model, _ = _loaded(model_path)
        if model.longest > longest:
            raise ValueError("a piece of the model is longer than the context of a chunk")
        for batch in _ended(batches, model_path):
            _, offsets = bytetext.buffer_of(batch.column("text"))
            for low, high in bytetext.groups(offsets, _GROUP):
                part = batch.slice(low, high - low)
                texts = pc.replace_substring(part.column("text").cast(pa.large_string()), SPACE, " ")
                front = pc.if_else(pc.equal(pc.binary_length(texts), 0), "", " ").cast(pa.large_string())
                ids, sizes = _encode_texts(model_path, pc.binary_join_element_wise(front, texts, pa.scalar("", pa.large_string())))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("row_id"), pa.array(np.zeros(len(lists), np.int64)), part.column("text"), lists], names=["doc_id", "row_id", "chunk", "text", "ids"])

    back = _decode(model_path) if decoded else lambda batches: batches
    out_schema = "doc_id long, row_id long, chunk long, text string, ids array<int>" + (", decoded string" if decoded else "")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), (2 * F.monotonically_increasing_id()).alias("row_id"))
    giant = F.char_length("text") > chunk_chars
    short = rows.where(~giant).mapInArrow(lambda batches: back(whole(batches)), out_schema)
    # the rows of both branches have ids of their own, and those of giant documents are fixed by being written
    cut_schema = "doc_id long, row_id long, chunk long, final boolean, own string, after string, before string"
    cut = written(rows.where(giant).withColumn("row_id", F.col("row_id") + 1).mapInArrow(_cut(chunk_chars, longest), cut_schema), "pieces-cut")

    def texts(row, model: Pieces) -> tuple[str, str, int]:
        """context, chunk with what follows, and the chunk's length, in normal form."""
        norm = lambda t: t.replace(" ", SPACE)
        own = (SPACE if row["chunk"] == 0 else "") + norm(row["own"])
        context = "" if row["chunk"] == 0 else (SPACE if len(row["before"]) < longest else "") + norm(row["before"])
        n = len(own)
        return context, own + ("" if row["final"] else norm(row["after"])[: model.longest - 1]), n

    def matrices(batches):
        model, _ = _loaded(model_path)
        for batch in released(batches):
            for row in batch.to_pylist():
                context, s, n = texts(row, model)
                yield pa.RecordBatch.from_pylist([{"row_id": row["row_id"], "chunk": row["chunk"], "m": _pack(model.matrix(context, s, n, row["final"]))}], schema=pa.schema([("row_id", pa.int64()), ("chunk", pa.int64()), ("m", pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64()), ("w", pa.float64())])))]))

    def multiply(key, group):
        row = sorted(group.to_pylist(), key=lambda r: r["chunk"])
        m = _unpack(row[0]["m"])
        for r in row[1:]:
            m = product(m, _unpack(r["m"]))
        return pa.Table.from_pylist([{"row_id": key[0].as_py(), "chunk": key[1].as_py(), "m": _pack(m)}], schema=group.schema.remove(3))

    def down(key, group):
        row = sorted(group.to_pylist(), key=lambda r: r["chunk"])
        states = backtrace([_unpack(r["m"]) for r in row], row[0]["entry"], row[0]["leave"])
        return pa.Table.from_pylist([{"row_id": r["row_id"], "chunk": r["chunk"], "entry": a, "leave": b} for r, (a, b) in zip(row, states, strict=True)], schema=pa.schema([("row_id", pa.int64()), ("chunk", pa.int64()), ("entry", pa.int64()), ("leave", pa.int64())]))

    levels = [written(cut.mapInArrow(matrices, f"row_id long, chunk long, {_MATRIX}"), "pieces-matrix")]
    while not levels[-1].where("chunk > 0").isEmpty():
        grouped = levels[-1].withColumn("up", F.expr(f"chunk div {FANOUT}"))
        levels.append(written(grouped.groupBy("row_id", "up").applyInArrow(multiply, f"row_id long, chunk long, {_MATRIX}"), "pieces-matrix"))
    # one matrix per document: from the start to the only end that its last chunk allows
    best = F.array_max(F.transform("m", lambda x: F.struct(x.w.alias("w"), x.b.alias("b"))))
    states = levels[-1].select("row_id", "chunk", F.lit(0).cast("long").alias("entry"), best.b.alias("leave"))
    for level in levels[-2::-1]:
        grouped = level.withColumn("up", F.expr(f"chunk div {FANOUT}")).join(states.select("row_id", F.col("chunk").alias("up"), "entry", "leave"), ["row_id", "up"])
        states = written(grouped.groupBy("row_id", "up").applyInArrow(down, "row_id long, chunk long, entry long, leave long"), "pieces-states")

    def chunks(batches):
        model, _ = _loaded(model_path)
        for batch in _ended(batches, model_path):
            # what lies between the free places of some 64 chunks is looked up at once
            for low in range(0, batch.num_rows, 64):
                rows = batch.slice(low, 64).to_pylist()
                parts, covered = [], []
                for row in rows:
                    _, s, n = texts(row, model)
                    parts.append(model.between(s, n, row["entry"], row["leave"], row["final"]))
                    covered.append((row["own"] + row["after"])[max(0, row["entry"] // _STATE - (row["chunk"] == 0)) : len(row["own"]) + row["leave"] // _STATE])
                flat, sizes = _encode_texts(model_path, pa.array([middle.replace(SPACE, " ") for _, middle, _ in parts], pa.large_string()))
                inner = np.split(flat, np.cumsum(sizes)[:-1])
                ids = [np.concatenate([head, i, tail]).astype(np.int32) for (head, _, tail), i in zip(parts, inner, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64()) for c in ("doc_id", "row_id", "chunk")] + [pa.array(covered, pa.string()), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "row_id", "chunk", "text", "ids"])

    long = cut.join(states, ["row_id", "chunk"]).select("doc_id", "row_id", "chunk", "final", "own", "after", "before", "entry", "leave").mapInArrow(lambda batches: back(chunks(batches)), out_schema)
    return short.unionByName(long)


def _decode(model_path: str):
    def run(batches):
        model, _ = _loaded(model_path)
        for batch in batches:
            for low in range(0, batch.num_rows, 1024):
                part = batch.slice(low, 1024)
                first = pc.equal(part.column("chunk"), 0).fill_null(False)
                decoded = model.decode(part.column("ids"), first).cast(pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, decoded], names=[*part.schema.names, "decoded"])

    return run


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """Rows of encode -> the same with a last column decoded: the text of the pieces that begin in the chunk.

    The decoded chunks of a document, joined in order, are its text (U+2581 reads as a space). A null ids is empty.
    """
    schema = T.StructType([*(f for f in encoded.schema if f.name != "decoded"), T.StructField("decoded", T.StringType())])
    return encoded.drop("decoded").mapInArrow(lambda batches: _decode(model_path)(released(batches)), schema)
