"""Byte-level BPE encoding and decoding by SQL inside each task.

A text is cut into the matches of the tokenizer's pattern. Each distinct match that is no token itself
goes once per worker to DuckDB: rows (word, position, token) are joined with the merge table, and a recursive
query contracts the pair of least rank, leftmost first, until a word has no pair left. Decoding is an ordered
aggregation over (document, position, token). Texts never leave their task.
"""

import base64
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from siftline.llm import bytetext
from siftline.llm.common import released
from siftline.llm.spans import SpanTable, units_of

_TEXTS, _SLICE = 1 << 22, 1 << 23
_OTHER, _LETTER, _NUMBER, _SPACE = range(4)
#: what may follow an apostrophe that begins a match: fixed values of the pattern
_ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
#: words longer than this are cut where no token can lie across; parts that stay longer are contracted by runs
_LONG = 64
#: rounds of one recursive query; rows of all its rounds are held, so it is asked again for what is left
_ROUNDS = 24

#: One round contracts the leftmost pair of least rank of each word. A row knows the token after it, so pairs are
#: found by one join with the merge table; the row after the pair gives its own neighbour and goes.
CONTRACT = """
WITH RECURSIVE state AS (
  SELECT word, pos, token, next_pos, next_token, 0 AS round FROM words
  UNION ALL
  (WITH best AS (
     SELECT word, min(merged * 4294967296 + pos) AS least FROM state JOIN merges ON a = token AND b = next_token WHERE round < ROUNDS GROUP BY word),
   hit AS (SELECT word, least >> 32 AS merged, pos AS place, next_pos AS gone FROM best JOIN state USING (word) WHERE pos = least & 4294967295),
   pair AS (SELECT hit.*, next_pos AS after_pos, next_token AS after_token FROM hit JOIN state USING (word) WHERE pos = gone)
   SELECT word, pos, CASE WHEN pos = place THEN merged ELSE token END, CASE WHEN pos = place THEN after_pos ELSE next_pos END,
          CASE WHEN pos = place THEN after_token WHEN next_pos = place THEN merged ELSE next_token END, round + 1
   FROM state JOIN pair USING (word) WHERE pos <> gone)),
last AS (SELECT word, max(round) AS round FROM state GROUP BY word)
SELECT word, pos, token, next_pos, next_token, round = ROUNDS AS open FROM state JOIN last USING (word, round) ORDER BY word, pos
"""

#: The same for long parts, where one contraction a round would be too slow: of the pairs of least rank every other one of
#: a run, the first included, is contracted, or the leftmost alone if a contraction could make a pair of lower rank.
#: The pairs taken don't touch, so one round does what that many rounds of one contraction each would.
CONTRACT_RUNS = """
WITH RECURSIVE state AS (
  SELECT word, pos, token, 0 AS round FROM words
  UNION ALL
  SELECT word, pos, CASE WHEN hit THEN merged ELSE token END, round + 1
  FROM (
    SELECT *, lag(hit, 1, false) OVER (PARTITION BY word ORDER BY pos) AS gone
    FROM (
      SELECT *, fits AND CASE WHEN alone THEN pos = min(CASE WHEN fits THEN pos END) OVER (PARTITION BY word)
                              ELSE (nth - coalesce(max(CASE WHEN NOT fits THEN nth END) OVER (PARTITION BY word ORDER BY pos), 0)) % 2 = 1 END AS hit
      FROM (
        SELECT f.*, bool_or(fits AND least(coalesce(x.merged, f.merged), coalesce(y.merged, f.merged), coalesce(z.merged, f.merged)) < f.merged) OVER (PARTITION BY word) AS alone
        FROM (
          SELECT p.*, m.merged, coalesce(m.merged = min(m.merged) OVER (PARTITION BY p.word), false) AS fits, min(m.merged) OVER (PARTITION BY p.word) AS least_rank
          FROM (SELECT *, row_number() OVER w AS nth, lag(token) OVER w AS token_before, lead(token) OVER w AS next_token, lead(token, 2) OVER w AS token_after
                FROM state WHERE round < ROUNDS WINDOW w AS (PARTITION BY word ORDER BY pos)) p
          LEFT JOIN merges m ON m.a = p.token AND m.b = p.next_token) f
        LEFT JOIN merges x ON fits AND x.a = f.token_before AND x.b = f.merged
        LEFT JOIN merges y ON fits AND y.a = f.merged AND y.b = f.token_after
        LEFT JOIN merges z ON fits AND z.a = f.merged AND z.b = f.merged
        WHERE least_rank IS NOT NULL)))
  WHERE NOT gone),
last AS (SELECT word, max(round) AS round FROM state GROUP BY word)
SELECT word, pos, token, round = ROUNDS AS open FROM state JOIN last USING (word, round) ORDER BY word, pos
"""

DECODE = "SELECT doc, string_agg(chars, '' ORDER BY pos) AS chars FROM tokens JOIN vocabulary USING (token) GROUP BY doc ORDER BY doc"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


@lru_cache(1)
def kinds() -> np.ndarray:
    r"""The kind of each code point, as the tokenizer library's own regular expressions tell \p{L}, \p{N} and \s."""
    import tiktoken

    points = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    single = {bytes([b]): b for b in range(256)}
    out = np.zeros(0x110000, np.uint8)
    for kind, pattern in ((_LETTER, r"\p{L}"), (_NUMBER, r"\p{N}"), (_SPACE, r"\s")):
        ids = tiktoken.Encoding("kinds", pat_str=pattern, mergeable_ranks=single, special_tokens={}).encode_ordinary(points)
        out[np.frombuffer(bytes(ids).decode().encode("utf-32-le"), np.uint32)] = kind
    return out


def matches(data: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the pattern's matches begin in the bytes of texts that begin at offsets (one more entry: the end), and how many each text has.

    White space before other characters keeps its last one apart, which a blank lends to the match after it.
    """
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(len(offsets) - 1, np.int64)
    text = data.decode()
    plain = len(text) == len(data)
    points = np.frombuffer(data, np.uint8) if plain else np.frombuffer(text.encode("utf-32-le"), np.uint32)
    kind = kinds()[points]
    if plain:
        at = None
        texts = offsets[:-1]
    else:
        at = np.concatenate(([0], np.cumsum(1 + (points >= 0x80).astype(np.int8) + (points >= 0x800) + (points >= 0x10000), dtype=np.int64)))
        texts = np.searchsorted(at, offsets[:-1])
    n = len(points)
    texts = texts[texts < n]
    first = np.zeros(n + 1, bool)
    first[texts] = first[n] = True
    space = kind == _SPACE
    begins = np.ones(n, bool)
    # two neighbours of one kind stay together, but for the last white space before something else
    begins[1:] = kind[1:] != kind[:-1]
    ends = np.ones(n, bool)
    ends[:-1] = ~first[1:n] & ~space[1:]
    ends[-1] = False
    begins |= space & ends
    # a blank belongs to what follows
    begins[1:] &= space[1:] | (points[:-1] != 32)
    begins |= first[:n]
    # an apostrophe that begins a match takes one of the endings
    quotes = np.flatnonzero((points == 39) & begins)
    if len(quotes):
        closes = np.searchsorted(texts, quotes, "right")
        closes = np.append(texts, n)[closes]
        for ending in _ENDINGS:
            size = len(ending)
            fits = quotes + size < closes
            for k, letter in enumerate(ending):
                fits &= points[np.minimum(quotes + 1 + k, n - 1)] == ord(letter)
            hit = quotes[fits]
            for k in range(size):
                begins[hit + 1 + k] = False
            after = hit + 1 + size
            begins[after[after < n]] = True
    starts = np.flatnonzero(begins)
    starts = starts if plain else at[starts]
    return starts, np.diff(np.searchsorted(starts, offsets))


class Merger:
    """ids of byte strings, by the ranks of a file."""

    def __init__(self, path: str):
        import duckdb

        self.ranks = read_ranks(path)
        rows = [(self.ranks[t[:k]], self.ranks[t[k:]], rank) for t, rank in self.ranks.items() for k in range(1, len(t)) if t[:k] in self.ranks and t[k:] in self.ranks]
        a, b, merged = (np.array(x, np.int32) for x in zip(*rows)) if rows else (np.zeros(0, np.int32),) * 3
        self.lengths = sorted({len(t) for t in self.ranks if len(t) > 1})
        self.db = duckdb.connect()
        self.db.execute("SET threads = 1")
        self.db.execute("SET memory_limit = '600MB'")
        self.db.register("given", pa.table({"a": a.astype(np.int64), "b": b.astype(np.int64), "merged": merged.astype(np.int64)}))
        self.db.execute("CREATE TABLE merges AS SELECT * FROM given")
        self.db.register("given", pa.table({"token": pa.array(list(self.ranks.values()), pa.int32()), "chars": pa.array([t.decode("latin-1") for t in self.ranks])}))
        self.db.execute("CREATE TABLE vocabulary AS SELECT * FROM given")
        self.db.unregister("given")
        self.table = SpanTable(self.encode_words, most=700_000)

    def parts(self, word: bytes) -> list[bytes]:
        """The word cut where no token stands across: no merge can join what lies on both sides."""
        if len(word) <= _LONG:
            return [word]
        cover = np.zeros(len(word) + 1, np.int64)
        for n in self.lengths:
            for i in range(len(word) - n + 1):
                if word[i : i + n] in self.ranks:
                    cover[i + 1] += 1
                    cover[i + n] -= 1
        cuts = [0, *(np.flatnonzero(np.cumsum(cover)[1 : len(word)] == 0) + 1).tolist(), len(word)]
        return [word[i:j] for i, j in zip(cuts, cuts[1:])]

    def encode_words(self, words: list[bytes]) -> list:
        out, parts, owner = [[self.ranks[w]] if w in self.ranks else [] for w in words], [], []
        for k, word in enumerate(words):
            if not out[k]:
                cut = self.parts(word)
                parts += cut
                owner += [k] * len(cut)
        long = np.fromiter((len(p) > _LONG for p in parts), bool, len(parts))
        for some, query in ((~long, CONTRACT), (long, CONTRACT_RUNS)):
            places = np.flatnonzero(some)
            # rows of all rounds together stay below some millions
            cells = np.cumsum([len(parts[k]) * min(len(parts[k]), _ROUNDS) for k in places]) // 1_000_000
            for block in np.split(places, np.flatnonzero(np.diff(cells)) + 1) if len(places) else []:
                for k, ids in zip(block, self._contract([parts[k] for k in block], query)):
                    parts[k] = ids
        for k, ids in zip(owner, parts):
            out[k] = out[k] + ids
        return out

    def _contract(self, parts: list[bytes], query: str) -> list[list[int]]:
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        token = single[np.frombuffer(b"".join(parts), np.uint8)]
        word, pos = np.repeat(np.arange(len(parts)), sizes), np.arange(len(token)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        final = pos == np.repeat(sizes, sizes) - 1
        state = pa.table({"word": word, "pos": pos, "token": token, "next_pos": np.where(final, -1, pos + 1), "next_token": np.where(final, -1, np.append(token[1:], -1))})
        done = []
        while len(state):
            self.db.register("words", state)
            found = self.db.sql(query.replace("ROUNDS", str(_ROUNDS))).to_arrow_table()
            is_open = found["open"].to_numpy()
            done.append([found[c].to_numpy()[~is_open] for c in ("word", "token")])
            state = found.filter(found["open"]).drop_columns("open")
        self.db.unregister("words")
        word, token = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(word, kind="stable")
        ends = np.searchsorted(word[order], np.arange(len(parts)), "right")
        return [ids.tolist() for ids in np.split(token[order], ends[:-1])]

    def encode(self, data: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and how many each has."""
        starts, counts = matches(data, offsets)
        if not len(starts):
            return np.zeros(0, np.int32), counts
        ids, sizes = self.table.look_up(units_of(np.frombuffer(data, np.uint8), starts, np.append(starts[1:], len(data))))
        total = np.concatenate(([0], np.cumsum(sizes)))
        ends = np.cumsum(counts)
        return ids, total[ends] - total[ends - counts]

    def decode(self, ids: np.ndarray, sizes: np.ndarray) -> list[bytes]:
        """The bytes of each run of ids; ids that are no tokens stand for nothing."""
        self.db.register("tokens", pa.table({"doc": np.repeat(np.arange(len(sizes)), sizes), "pos": np.arange(len(ids)), "token": ids}))
        found = self.db.sql(DECODE).to_arrow_table()
        self.db.unregister("tokens")
        out = [b""] * len(sizes)
        for doc, chars in zip(found["doc"].to_pylist(), found["chars"].to_pylist()):
            out[doc] = chars.encode("latin-1")
        return out


@lru_cache(2)
def _merger(path: str) -> Merger:
    return Merger(path)


def slices(data: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Parts of one text of about so many bytes, cut before white space that follows something else: a match begins there in any case."""
    low = 0
    while low < len(data):
        high = min(low + most, len(data))
        while high < len(data):
            window = data[high - 1 : high + most]
            cut = np.flatnonzero(bytetext.SPACES[window[1:]] & (window[:-1] < 128) & ~bytetext.SPACES[window[:-1]])
            if len(cut):
                high += int(cut[0])
                break
            high = min(high + most, len(data))
        yield low, high
        low = high


def _encoded(path: str, decoded: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merger = _merger(path)
        for batch in released(batches):
            data, offsets = bytetext.buffer_of(batch.column(1))
            for low, high in bytetext.groups(offsets, _TEXTS):
                raw = data[offsets[low] : offsets[high]].tobytes()
                ends = offsets[low : high + 1] - offsets[low]
                try:
                    raw.decode()
                except UnicodeDecodeError:
                    texts = [raw[i:j].decode(errors="replace").encode() for i, j in zip(ends, ends[1:])]
                    raw, ends = b"".join(texts), np.concatenate(([0], np.cumsum([len(t) for t in texts])))
                if len(raw) > 2 * _SLICE:
                    # one long text
                    found = [merger.encode(raw[i:j], np.array([0, j - i])) for i, j in slices(np.frombuffer(raw, np.uint8), _SLICE)]
                    ids, sizes = np.concatenate([f[0] for f in found]), np.array([sum(int(f[1][0]) for f in found)])
                    back = [b"".join(merger.decode(f[0], f[1])[0] for f in found)] if decoded else None
                else:
                    ids, sizes = merger.encode(raw, ends)
                    back = merger.decode(ids, sizes) if decoded else None
                at = np.concatenate(([0], np.cumsum(sizes))) * 4
                binary = pa.Array.from_buffers(pa.large_binary(), high - low, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(ids, "<u4"))])
                columns = [batch.column(0).slice(low, high - low), pa.array(sizes), binary.cast(pa.binary())] + ([pa.array(back, pa.binary())] if decoded else [])
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids", "decoded"][: len(columns)])

    return run


def encode(docs: DataFrame, path: str, decoded: bool = False) -> DataFrame:
    """(doc_id, text) -> doc_id, n_tokens, ids and, if wanted, decoded: one row per row of docs.

    ids are little-endian unsigned 32-bit integers, as the library gives them without special tokens; decoded is what they
    decode to, in bytes. Null and empty texts have no ids. Malformed bytes of a text read as U+FFFD, a run of them as several.
    Null and repeated doc_ids are kept as they are; other columns are ignored; an empty table gives none. A text of any
    length is worked on in slices; its ids make one row.
    """
    ids = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return ids.mapInArrow(_encoded(path, decoded), "doc_id long, n_tokens long, ids binary" + (", decoded binary" if decoded else ""))


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids) -> doc_id, decoded binary. Null ids and those that are not in the vocabulary stand for nothing."""

    def run(batches):
        merger = _merger(path)
        for batch in released(batches):
            _, offsets = bytetext.buffer_of(batch.column(1).cast(pa.large_binary()).fill_null(b""))
            for low, high in bytetext.groups(offsets, _TEXTS):
                part = batch.slice(low, high - low)
                ids = [np.frombuffer(x.as_py() or b"", "<u4").astype(np.int64) for x in part.column(1)]
                back = merger.decode(np.concatenate(ids), np.fromiter(map(len, ids), np.int64, len(ids)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(back, pa.binary())], names=["doc_id", "decoded"])

    return encoded.select(encoded["doc_id"].cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, decoded binary")
