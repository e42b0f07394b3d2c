"""Byte pairs against the library, and round trips."""

import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from siftline.llm import bytepairs

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bytepairs.read_ranks(PATH), special_tokens={})


@pytest.fixture(scope="module")
def merger():
    return bytepairs.Merger(PATH)


def same(merger, library, texts):
    raw = [t.encode() for t in texts]
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in raw]))).astype(np.int64)
    ids, sizes = merger.encode(b"".join(raw), offsets)
    got = [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])]
    assert got == library.encode_ordinary_batch(texts)
    assert merger.decode(ids, sizes) == raw


def test_ids_of_mixed_scraps(merger, library):
    r = random.Random(1)
    scraps = ["'s", "'t", "'re", "'ve", "'ll", "'d", "'m", "'M", "'r", "'", " ", "  ", "\n", "\t", "a", "bc", "S", "5", "٣", ".", "!?", "é", "𝒳", "中文", "​", "'x", "stuff", "\r\n", "\x85", "\x1c", "\xa0", "　"]
    same(merger, library, ["".join(r.choice(scraps) for _ in range(r.randint(0, 12))) for _ in range(5000)])


def test_kinds_of_all_characters(merger, library):
    points = [chr(c) for c in [*range(0xD800), *range(0xE000, 0x110000)] if c % 7 == 0 or c < 0x3000]
    same(merger, library, ["a" + c + "5" + c + " " + c + c + "." for c in points])


def test_long_words(merger, library):
    r = random.Random(2)
    letters = lambda s, n: "".join(r.choice(s) for _ in range(n))
    same(merger, library, ["a" * 1000, "ab" * 700, " " * 501 + "x", "=-" * 300, "中文字" * 200, "e" * 1501, "thequickbrownfox" * 60, letters("abcdefghijklmnopqrstuvwxyz", 3000), letters("etaoin", 900), letters("aAbB0-_ ", 2000), letters("es", 400), "\n" * 99 + " x", letters("etaoin", 64), letters("etaoin", 65)])


def test_both_queries_agree(merger):
    r = random.Random(3)
    words = ["".join(r.choice("etaoinsh r") for _ in range(r.randint(1, 60))).encode() for _ in range(300)] + [b"\xff\xfe\x00", bytes(range(256))]
    assert merger._contract(words, bytepairs.CONTRACT) == merger._contract(words, bytepairs.CONTRACT_RUNS)


def test_slices_are_cut_where_a_match_begins(merger):
    r = random.Random(4)
    text = "".join(r.choice(["word", " ", "  ", "\n", "'s", "é", "5"]) for _ in range(4000)).encode()
    cut = list(bytepairs.slices(np.frombuffer(text, np.uint8), 50))
    assert len(cut) > 40 and cut[0][0] == 0 and cut[-1][1] == len(text) and all(a[1] == b[0] for a, b in zip(cut, cut[1:]))
    whole = merger.encode(text, np.array([0, len(text)]))[0].tolist()
    assert [i for a, b in cut for i in merger.encode(text[a:b], np.array([0, b - a]))[0].tolist()] == whole


def test_table(spark, library, monkeypatch):
    rows = [(1, "Hello  world's end", "x"), (1, "Hello  world's end", "y"), (2, "", "x"), (3, None, None), (None, "no id", "x"), (4, "<|endoftext|>", "x"), (5, "long text " * 30_000 + "naïve" * 400, "x"), (6, " ", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    key = lambda x: (str(x[0]), x[1])
    out = bytepairs.encode(df, PATH, decoded=True)
    got = sorted(((r["doc_id"], bytes(r["decoded"]).decode(), r["n_tokens"], np.frombuffer(bytes(r["ids"]), "<u4").tolist()) for r in out.collect()), key=key)
    want = sorted(((i, t or "", len(library.encode_ordinary(t or "")), library.encode_ordinary(t or "")) for i, t, _ in rows), key=key)
    assert got == want
    back = sorted((str(r["doc_id"]), bytes(r["decoded"]).decode()) for r in bytepairs.decode(bytepairs.encode(df, PATH), PATH).collect())
    assert back == sorted((str(i), t or "") for i, t, _ in rows)
    assert bytepairs.encode(df.limit(0), PATH).count() == 0
    broken = bytepairs.encode(spark.sql("SELECT 7L AS doc_id, CAST(X'61FF62' AS STRING) AS text"), PATH, decoded=True).first()
    assert bytes(broken["decoded"]).decode() == "a�b"
    odd = spark.createDataFrame([(1, bytearray(np.array([40, 50256, 2**31, 11], "<u4").tobytes())), (2, None)], "doc_id long, ids binary")
    assert [bytes(r["decoded"]) for r in bytepairs.decode(odd, PATH).orderBy("doc_id").collect()] == [library.decode_bytes([40, 11]), b""]


def test_long_texts_in_slices(spark, library, monkeypatch):
    monkeypatch.setattr(bytepairs, "_SLICE", 500)
    text = "some words, 's and  more\n" * 300
    run = bytepairs._encoded(PATH, True)
    import pyarrow as pa

    (out,) = run(iter([pa.RecordBatch.from_arrays([pa.array([1]), pa.array([text])], names=["doc_id", "text"])]))
    assert np.frombuffer(out["ids"][0].as_py(), "<u4").tolist() == library.encode_ordinary(text) and out["decoded"][0].as_py().decode() == text
