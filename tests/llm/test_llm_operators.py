"""Operators against brute force on small tables: nulls, empty and long texts, ties, repeated rows, empty tables, extra columns."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siftline.llm import containment, graph, langid, licenses, minhash, pages, pieces, quality, rans, revisit, weighted
from siftline.llm.common import shared_dir

DOC = "doc_id long, text string"
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
lower = lambda s: re.sub("[A-Z]", lambda m: m[0].lower(), s)


def prose(seed, n=300):
    r = random.Random(seed)
    return " ".join(r.choice(["thing", "Able", "the", "of", "and", "river", "stone", "cloud"]) + str(r.randint(0, 60)) for _ in range(n))


def edited(text, seed, n):
    r = random.Random(seed)
    w = text.split()
    for _ in range(n):
        w[r.randrange(len(w))] = f"new{r.random()}"
    return " ".join(w)


@pytest.fixture(scope="module")
def corpus():
    """Copies, near copies of every likeness, a shared passage, short, empty, null and long texts."""
    texts = [None, "", "  \n ", "one", "One", "two words", "!!! ???", prose(1, 30000)]
    for k in range(8):
        base = prose(100 + k, 120)
        texts += [base, base, base.upper(), *[edited(base, j, j) for j in range(1, 12)]]
    texts += [prose(50, 80) + " " + prose(200 + k, 60) for k in range(20)]
    return [(k * 3 + 1, t) for k, t in enumerate(texts)]


def shingles(text, size, split=lambda s: s.encode().split()):
    w = split(lower(text or ""))
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def components(ids, links):
    up = {i: i for i in ids}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("size", [4, 5])
def test_near_duplicates(spark, corpus, size):
    df = spark.createDataFrame([(i, t, "x", True) for i, t in corpus], DOC + ", node string, kept boolean")
    got = {r["doc_id"]: r for r in minhash.near_duplicates(df, size).collect()}
    sets = {i: shingles(t, size) for i, t in corpus}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    expected = components(sets, links)
    assert len(links) > 60
    for i in sets:
        assert (got[i]["n_shingles"], got[i]["component_id"], got[i]["kept"]) == (len(sets[i]), expected[i], expected[i] == i)


def test_near_duplicates_odd_rows(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], DOC)).collect() == []
    t = prose(1, 50)
    out = minhash.near_duplicates(spark.createDataFrame([(None, t), (5, t), (5, t), (4, t)], DOC)).collect()
    assert sorted(((r["doc_id"] or 0), (r["component_id"] or 0), r["kept"]) for r in out) == [(0, 0, True), (4, 4, True), (5, 4, False), (5, 4, False)]


def test_near_duplicates_without_a_band(spark):
    """Pairs of likeness 0.8 (40 of 50 words) that share none of the 40 bands are linked."""
    words = lambda s, kind, n: [f"w{s}{kind}{i}" for i in range(n)]
    docs = [(2 * k + j, " ".join(words(s, "c", 40) + words(s, kind, 5))) for k, s in enumerate((8771, 14251, 15095, 20259)) for j, kind in enumerate("ab")]
    bands = [set(b) for batch in minhash._sketch(1, 80)([pa.RecordBatch.from_pylist([{"doc_id": i, "fetch": i, "text": t} for i, t in docs])]) for b in batch.column("bands").to_pylist()]
    assert not any(bands[i] & bands[i + 1] for i in range(0, 8, 2))
    out = minhash.near_duplicates(spark.createDataFrame(docs, DOC), shingle_words=1).collect()
    assert {r["doc_id"]: r["component_id"] for r in out} == {i: i // 2 * 2 for i, _ in docs}


def test_signature_coordinates_are_shifts():
    ring, _ = minhash._tables()
    h = np.arange(1, 2000, dtype=np.uint64)
    s = minhash.signatures(h, np.zeros(len(h), np.int64), 1, ring)
    cells = (h & np.uint64(minhash.CELLS - 1)).astype(int)
    order = ring[:, 0]
    for k in (0, 1, 77):
        assert s[0, k] == min(order[(cells + k) % minhash.CELLS])


def test_components(spark):
    r = random.Random(2)
    links = [(r.randrange(200), r.randrange(200)) for _ in range(120)] + [(k, k + 1) for k in range(300, 360)] + [(7, 7), (1, 2), (2, 1)]
    got = {x["node"]: x["root"] for x in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    expected = components({x for link in links for x in link}, links)
    assert all(got.get(i, i) == e for i, e in expected.items())
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_contained_items(spark, corpus):
    items = [(1, " ".join(prose(50, 80).split()[10:40])), (2, "one"), (3, None), (4, "!!"), (5, "missing words never seen in any text"), (6, " ".join(prose(100, 120).split()[:25])), (None, "two words")]
    docs = [*corpus, (9000, "Prefix " + items[0][1].upper() + ", suffix"), (None, items[0][1])]
    got = {(r["doc_id"], r["item_id"]): (r["n_item"], r["n_shared"]) for r in containment.contained_items(spark.createDataFrame([(*d, 1) for d in docs], DOC + ", h int"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    split = WORD.findall
    expected = {}
    for item, t in items:
        w = split(lower(t or ""))
        own = shingles(t, 5, split)
        for d, x in docs:
            dw = split(lower(x or ""))
            size = min(5, len(w))
            there = {tuple(dw[i : i + size]) for i in range(len(dw) - size + 1)} if size else set()
            if own and item is not None and 100 * len(own & there) >= 80 * len(own):
                expected[d, item] = (len(own), len(own & there))
    assert got == expected and len(got) > 20
    assert (None, 1) in expected  # a row without an id is searched too
    left = containment.without_items(spark.createDataFrame([(*d, 1, 2) for d in docs], DOC + ", k1 int, _found int"), spark.createDataFrame(items, "item_id long, text string"))
    assert {r["doc_id"] for r in left.collect()} == {d for d, _ in docs} - {d for d, _ in expected} and left.columns == ["doc_id", "text", "k1", "_found"]
    none = spark.createDataFrame([], DOC)
    assert containment.contained_items(none, spark.createDataFrame(items, "item_id long, text string")).count() == 0
    assert containment.contained_items(spark.createDataFrame(docs, DOC), spark.createDataFrame([], "item_id long, text string")).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_sketches_lose_no_item(spark, seed):
    """Items of all sizes with as many words changed as may be: every one that brute force finds is found."""
    r = random.Random(seed)
    items = [(k, " ".join(f"w{r.randrange(4000)}" for _ in range(n))) for k, n in enumerate([1, 2, 4, 5, 6, 8, 9, 10, 14, 20, 33, 60, 120, 250])]
    docs = []
    for k in range(120):
        w = r.choice(items)[1].split()
        for _ in range(r.randint(0, 1 + len(w) // 25)):
            w[r.randrange(len(w))] = "changed"
        docs.append((k, f"before {k} " + " ".join(w) + f" after {k}"))
    got = {(x["doc_id"], x["item_id"]) for x in containment.contained_items(spark.createDataFrame(docs, DOC), spark.createDataFrame(items, "item_id long, text string")).collect()}
    expected = set()
    for item, t in items:
        own, size = shingles(t, 5, WORD.findall), min(5, len(t.split()))
        for d, x in docs:
            w = WORD.findall(x)
            there = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}
            if 100 * len(own & there) >= 80 * len(own):
                expected.add((d, item))
    assert got == expected and 60 < len(got)


def test_one_of_each(spark):
    a, b = prose(1, 60), prose(2, 60)
    rows = [(5, a), (5, a), (4, edited(a, 1, 1)), (None, a), (None, b), (None, b), (9, None), (8, ""), (None, ""), (7, prose(3, 50))]
    out = minhash.one_of_each(spark.createDataFrame([(*x, 1, True) for x in rows], DOC + ", node int, kept boolean"))
    assert out.columns == ["doc_id", "text", "node", "kept"]
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in out.collect()) == sorted([(4, rows[2][1]), (0, b), (9, ""), (8, ""), (0, ""), (7, rows[-1][1])])
    assert minhash.one_of_each(spark.createDataFrame([], DOC)).count() == 0


def test_components_of_a_chain_take_few_rounds(spark, monkeypatch):
    """A chain of 1,000 links in the worst numbering for a walk to the least neighbour, and a star around its largest node."""
    names = []
    keep = graph.written
    monkeypatch.setattr(graph, "written", lambda df, name, **kw: names.append(name) or keep(df, name, **kw))
    links = [(k, k + 1) for k in range(1000)] + [(5000, k) for k in range(2000, 2400)]
    got = {x["node"]: x["root"] for x in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(1001)} | {k: 2000 for k in range(2000, 2400)} | {5000: 2000}
    assert names.count("cc-map") <= 12
    more = graph.extended(graph.components(spark.createDataFrame([(1, 2), (5, 6)], "a long, b long")), spark.createDataFrame([(6, 2), (8, 9), (9, 0)], "a long, b long"))
    assert {x["node"]: x["root"] for x in more.collect()} == {1: 1, 2: 1, 5: 1, 6: 1, 0: 0, 8: 0, 9: 0}


def test_license_scan(spark):
    texts = [None, "", "ALL rights-reserved. all rights reserved", "CC BY-NC 4.0 and cc by", "GNU General Public License, version 3", "general public", "all rights all rights reserved" * 3, "x " * 5000 + "cc by", "Permission is hereby granted, free of charge ... THE SOFTWARE IS PROVIDED \"AS IS\"", "permission is hereby granted free of charge"]
    df = spark.createDataFrame([(i, t, 9) for i, t in enumerate(texts)], DOC + ", hits int")
    got = {r["doc_id"]: r for r in licenses.scan(df).collect()}
    for i, t in enumerate(texts):
        w = WORD.findall(lower(t or ""))
        at, found = [], set()
        for p in licenses.BASE:
            q = p.phrases[0].split()
            places = [k for k in range(len(w)) if w[k : k + len(q)] == q]
            at += places
            found |= {p.label} if places else set()
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(found)))
        assert 0 <= r["score"] <= 1 and set(r["base_labels"].split(",")) <= set(r["labels"].split(",")) | {""}
    assert got[4]["labels"] == "gpl,gpl-3.0" and got[8]["labels"] == "mit" and got[9]["labels"] == "" and 0 < got[9]["score"] < 1
    assert licenses.scan(spark.createDataFrame([], DOC)).count() == 0


def jaccard(a, b):
    a, b = (Counter(WORD.findall(lower(t))) for t in (a, b))
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def test_weighted_fingerprints(spark, corpus):
    got = {r["doc_id"]: r for r in weighted.compared(spark.createDataFrame([(*d, "z") for d in corpus], DOC + ", which string")).collect()}
    order = sorted(corpus, key=lambda d: -d[0])
    off = []
    for k, (i, t) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        e = t[: len(t) - len(t) // 3] + nxt[: len(t) // 3]
        r = got[i]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(e.encode()).hexdigest()
        assert (r["near_edited"] == 1) or e != t
        digits = lambda f: [f[k : k + 6] for k in range(0, len(f), 6)]
        for name, other in (("near_edited", r["edited_fingerprint"]), ("near_next", got[order[(k + 1) % len(order)][0]]["fingerprint"])):
            # likeness is what the returned fingerprints show
            both = list(zip(digits(r["fingerprint"]), digits(other), strict=False))
            assert r[name] == (sum(a == b for a, b in both) / weighted.SAMPLES if both else float(bool(r["fingerprint"]) == bool(other)))
        if WORD.search(t) and WORD.search(e) and WORD.search(nxt):
            off += [(jaccard(t, e), r["near_edited"]), (jaccard(t, nxt), r["near_next"])]
    off = np.array(off)
    assert abs((off[:, 0] - off[:, 1]).mean()) < 0.03 and np.abs(off[:, 0] - off[:, 1]).mean() < 0.07
    by_text = defaultdict(set)
    for i, t in corpus:
        by_text[t or ""].add(got[i]["fingerprint"])
    assert all(len(v) == 1 for v in by_text.values())
    assert weighted.compared(spark.createDataFrame([], DOC)).count() == 0
    lone = weighted.compared(spark.createDataFrame([(1, "abc def")], DOC)).collect()[0]
    assert lone["near_next"] == 1 and lone["edited_sha256"] == hashlib.sha256(b"abc dab").hexdigest()
    odd = weighted.compared(spark.createDataFrame([(None, "a b c"), (2, None), (2, "q r s t")], DOC)).collect()
    assert sorted((r["doc_id"] or 0, r["n_chars"]) for r in odd) == [(0, 5), (2, 0), (2, 7)]


@pytest.mark.parametrize("n", [0, 1, 511, 512, 513, 70_000])
def test_rans_block(n):
    r = np.random.RandomState(n)
    ids = np.minimum((r.pareto(0.7, n) * 3).astype(np.int64), 49407)
    freq, start = rans.frequency_table(np.bincount(ids, minlength=49408))
    assert freq.sum() == 1 << rans.SCALE
    block = rans.encode(ids, np.array([n]), freq, start)
    assert (rans.decode(block, freq, start, rans.symbols(freq))[0] == ids).all()
    with pytest.raises(ValueError, match="damaged"):
        rans.decode(block[:20] + bytes([block[20] ^ 1]) + block[21:], freq, start, rans.symbols(freq))


def test_token_file(spark, corpus):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    odd = [(2, "a\x1cb c"), (5, "naïve é <|endoftext|> it's 123"), (10**6, "日本語 テキスト")]
    docs = [*corpus, *odd]
    path = f"{shared_dir(spark)}/test-token-file-{random.random()}"
    counts = rans.write_token_file(spark.createDataFrame([(*d, 1) for d in docs], DOC + ", ids int"), path, rans.word_bpe(P.path("word_bpe_49k.json")), 1, 49408, block_ids=3000)
    got = {r["doc_id"]: r for r in rans.read_token_file(spark, path, counts).collect()}
    at = 0
    for i, x in sorted(docs):
        ids = t.encode(x or "", add_special_tokens=False).ids + [1]
        assert (got[i]["start"], got[i]["n_tokens"], bytes(got[i]["ids"])) == (at, len(ids), np.array(ids, "<u4").tobytes())
        at += len(ids)
    empty = path + "-empty"
    assert rans.read_token_file(spark, empty, rans.write_token_file(spark.createDataFrame([], DOC), empty, rans.word_bpe(P.path("word_bpe_49k.json")), 1, 49408)).count() == 0
    assert rans.read_token_file(spark, empty).count() == 0
    # the path alone is enough, and what stands beside a block is guarded too
    assert {r["doc_id"]: bytes(r["ids"]) for r in rans.read_token_file(spark, path).collect()} == {k: bytes(r["ids"]) for k, r in got.items()}
    for change in ("before + 1 AS before", "transform(doc_ids, x -> x + 1) AS doc_ids"):
        name = change.rsplit(" ", 1)[1]
        bad = f"{path}-{name}"
        blocks = spark.read.parquet(f"{path}/blocks")
        blocks.selectExpr(*[c if c != name else change for c in blocks.columns]).write.parquet(f"{bad}/blocks")
        spark.read.parquet(f"{path}/table").write.parquet(f"{bad}/table")
        with pytest.raises(Exception, match="damaged head"):
            rans.read_token_file(spark, bad).count()


@pytest.mark.parametrize("chunk", [70, 400])
def test_pieces_equal_the_library(spark, corpus, chunk):
    P = pytest.importorskip("public_tokenizers")
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    r = random.Random(4)
    texts = [t for _, t in corpus[:40] if len(t or "") < 5000] + ["  a   b\n\n c ", "中文字符测试没有空格" * 20, "a" * 300 + " " * 90 + "x", "😀 \x00 é", "====----" * 40, "".join(r.choice("abehtingr") for _ in range(1500))]
    docs = list(enumerate(texts))
    out = pieces.decode(pieces.encode(spark.createDataFrame([(*d, 0) for d in docs], DOC + ", chunk int"), path, chunk), path).collect()
    ids, back = defaultdict(list), defaultdict(str)
    for row in sorted(out, key=lambda x: (x["doc_id"], x["chunk"])):
        ids[row["doc_id"]] += row["ids"]
        back[row["doc_id"]] += row["decoded"]
    for i, t in docs:
        assert ids[i] == sp.encode(t or "") and back[i] == (t or "")
    assert pieces.encode(spark.createDataFrame([], DOC), path).count() == 0
    # repeated rows, and rows without an id, stay apart; each chunk's text is what its ids decode to
    odd = spark.createDataFrame([(1, texts[-1]), (1, texts[-1]), (None, "ab cd"), (None, "ab cd"), (None, None)], DOC)
    both = pieces.encode(odd, path, chunk, decoded=True).collect()
    assert len({x["row_id"] for x in both}) == 5 and all(x["decoded"] == x["text"] for x in both)
    assert sorted(sum((x["ids"] for x in both if x["doc_id"] is None), [])) == sorted(2 * sp.encode("ab cd"))


def test_unigram_pieces_have_the_best_sum(tmp_path):
    P = pytest.importorskip("public_tokenizers")
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    with open(P.path("piece_bpe_32k.model"), "rb") as f:
        model.ParseFromString(f.read())
    model.trainer_spec.model_type = 1
    for p in model.pieces:
        p.score = max(p.score, -40000) / 4096
    (tmp_path / "u.model").write_bytes(model.SerializeToString())
    sp = sentencepiece.SentencePieceProcessor(model_file=str(tmp_path / "u.model"))
    m = pieces.Pieces(str(tmp_path / "u.model"))
    for k in range(30):
        t = prose(k, 12)
        s = m.normal(t)
        best, weight = m.paths(s, 0, None, len(s), len(s))
        assert abs(weight[-1] - sum(sp.GetScore(i) for i in sp.encode(t))) < 1e-3
        # the product of the chunks' matrices has the same weight
        cuts = [0, len(s) // 3, 2 * len(s) // 3, len(s)]
        total = None
        for a, b in zip(cuts, cuts[1:]):
            one = m.matrix(s[max(0, a - 64) : a], s[a : b + m.longest - 1] if b < len(s) else s[a:b], b - a, b == len(s))
            total = one if total is None else pieces.product(total, one)
        assert abs(max(total.values()) - weight[-1]) < 1e-6


def test_language(spark):
    r = random.Random(1)
    kinds = {"aa": ["bana", "kolo", "miru"], "bb": ["xyst", "quor", "vend"], "cc": ["éàè", "ñandu", "çava"]}
    text = lambda lang, n: " ".join("".join(r.choices(kinds[lang], k=2)) for _ in range(n))
    taught = [(k, text(lang, 40), lang) for k, lang in enumerate(list(kinds) * 30)] + [(900, "junk", None), (901, None, "aa"), (902, "123 !!", "bb")]
    model = langid.fit(spark.createDataFrame(taught, DOC + ", lang string"))
    asked = [(k, text(lang, 25), lang) for k, lang in enumerate(list(kinds) * 10)]
    odd = [(500, None, None), (501, "", None), (502, "12 34 !?", None), (503, "中文" * 500, None), (504, text("aa", 60000), "aa")]
    got = {x["doc_id"]: x for x in langid.identify(spark.createDataFrame([(*a, 0.5) for a in asked + odd], DOC + ", lang string, score double"), model).collect()}
    assert all(got[i]["lang_pred"] == lang for i, _, lang in asked)
    assert [got[i]["lang_pred"] for i in (500, 501, 502)] == ["und"] * 3 and got[503]["rejected"] and got[504]["lang_pred"] == "aa"
    assert all(0 <= x["score"] <= 1 for x in got.values())
    assert langid.fit(spark.createDataFrame([], DOC + ", lang string")) is None
    assert [x["lang_pred"] for x in langid.identify(spark.createDataFrame([(1, "abc")], DOC), None).collect()] == ["und"]
    assert langid.identify(spark.createDataFrame([], DOC), model).count() == 0


def test_language_hits_the_nearest_centroid(spark):
    """Against cosines taken one by one."""
    docs = [(k, prose(k, 50) if k % 2 else "ßüö " * (k + 3), "x" if k % 2 else "y") for k in range(40)]
    model = langid.fit(spark.createDataFrame(docs, DOC + ", lang string"))
    for x in langid.identify(spark.createDataFrame(docs, DOC + ", lang string").select("doc_id", "text", langid.letters(F.col("text")).alias("t")), model).collect():
        c = Counter()
        b = x["t"].encode()
        for i in range(len(b) - 2):
            g = b[i] | b[i + 1] << 8 | b[i + 2] << 16
            c[((g * 2654435761) & 0xFFFFFFFF) >> (32 - langid.BITS)] += 1
        v = np.zeros(1 << langid.BITS)
        for k, n in c.items():
            v[k] = np.log1p(n) * model.idf[k]
        cosine = model.centroids @ (v / np.linalg.norm(v))
        assert abs(cosine.max() - x["score"]) < 1e-4 and model.langs[int(cosine.argmax())] == x["lang_pred"]


def test_quality(spark):
    r = random.Random(3)
    good = lambda k: prose(k, r.randint(5, 80))
    bad = lambda k: " | ".join(prose(k, r.randint(5, 80)).split())
    rows = [(k, bad(k) if k % 4 == 0 else good(k)) for k in range(400)]
    docs = spark.createDataFrame([(*x, 7) for x in rows], DOC + ", y int")
    labels = spark.createDataFrame([(k, int(k % 4 != 0)) for k in range(300)] + [(5, 0), (6, None), (None, 1), (7000, 1)], "doc_id long, quality int")
    weights = quality.fit(quality.labelled(docs, labels))
    out = {x["doc_id"]: x for x in quality.classify(docs, weights).where("doc_id >= 300").collect()}
    assert np.mean([x["predicted"] == int(k % 4 != 0) for k, x in out.items()]) > 0.97
    odd = quality.classify(spark.createDataFrame([(1, None), (2, ""), (3, prose(1, 60000))], DOC), weights).collect()
    assert odd[0]["score"] == odd[1]["score"] and all(0 <= x["score"] <= 1 for x in odd)
    none = quality.fit(spark.createDataFrame([], DOC + ", y int"))
    assert not none.any() and quality.classify(spark.createDataFrame([], DOC), none).count() == 0


PAGE = "<html><head><title>T</title><script>var t='</p>';</script></head><body><header>Site</header><nav><ul><li><a href='/x'>x</a></ul></nav>{0}<footer>&copy; f</footer>"


def test_page_blocks():
    body = "<article><h1>T &amp; t</h1><p><b>One\n  two.<br><p>three<div class='ad'>AD</div><form>q</form><section id=comments><p>c</section><ul><li>a<li>b</ul><!-- no --></article><aside>s</aside>"
    assert [b[0] for b in pages.blocks_of(PAGE.format(body))] == ["T & t", "One two.", "three", "a", "b"]
    assert pages.blocks_of("") == [] and pages.blocks_of("plain &lt;text") [0][0] == "plain <text"
    assert [b[0] for b in pages.blocks_of("<article><p>cut <b>off</b> mid <a href='x")] == ["cut off mid <a href='x"]
    assert [b[0] for b in pages.blocks_of("<article><div class='notice-text'><p>Real</p></div><div class='notice-box'><p>Notice</p></div><article><p>a reader's comment</p></article></article>")] == ["Real"]
    assert [b[0] for b in pages.blocks_of("<nav>n</nav><main><article><p>in</p></article><section><p>outside</p></section></main><div>d</div>")] == ["in", "outside"]
    assert [b[0] for b in pages.blocks_of("<p>a<script>if (x<y) '</p>'</script>b</p><svg><text>c</text></svg><select><p>d")] == ["a b", "d"]
    assert [b[0] for b in pages.blocks_of("<p title='a>b'>c</p><p title=\"'\">d <x='>e</p>")] == ["c", "d e"]


def test_long_odd_pages_take_little_time():
    import time

    begin = time.process_time()
    for page in ("<div>x" * 170_000, "<a " * 350_000, "<a \"" * 260_000, "<a '\">" * 170_000, "<select>" * 130_000, "<!-- " * 200_000, "<p><b>x" * 150_000, "</div>" * 170_000, "<article>" * 110_000 + "x", "&" * (1 << 20)):
        pages.read_page(page)
    assert time.process_time() - begin < 60
    blocks, elements = pages.read_page("<div>x" * 1000)
    assert len(blocks) == 1000 and sorted((lo, hi) for _, lo, hi, _ in elements) == [(k, 1000) for k in range(1000)]


@pytest.mark.parametrize("most", [0, 200_000])
def test_page_text_equals_brute_force(spark, monkeypatch, most):
    """All subtrees of all pages counted in plain dictionaries, with one walk up the elements for each block."""
    monkeypatch.setattr(pages, "BROADCAST_ROWS", most)
    r = random.Random(4)
    rows = []
    for k in range(150):
        host = r.choice(["a", "b", "c", "d"])
        same = [f"<div><p>{host} template {j}</p><span>of {j}</span></div>" for j in range(3) if r.random() < 0.8]
        own = "".join(f"<section><p>{prose(r.randrange(60), 8)}</p></section>" for _ in range(r.randint(1, 4)))
        inner = r.choice(["", "<p>Read more of this site</p>"])
        page = "".join(same) + (f"<article>{own}{inner}</article>" if r.random() < 0.5 else own) + f"<nav>{k}</nav>"
        rows.append((k, f"http://{host}/{k}", page))
    read = {k: (u, *pages.read_page(p)) for k, u, p in rows}
    content = {k: "\n".join(t for t, good in blocks if good) for k, (_, blocks, _) in read.items()}
    seen, size = defaultdict(set), defaultdict(set)
    for k, (u, _, elements) in read.items():
        size[u[7]].add(content[k])
        for h, *_ in elements:
            seen[u[7], h].add(content[k])
    expected = {}
    for k, (u, blocks, elements) in read.items():
        often = [e for e in elements if len(seen[u[7], e[0]]) >= 3 and len(seen[u[7], e[0]]) >= 0.2 * len(size[u[7]])]
        hit = lambda i, inside: any(lo <= i < hi and x == inside for _, lo, hi, x in often)
        sure, doubt = ([hit(i, x) for i in range(len(blocks))] for x in (False, True))
        doubtful = sum(len(t) for (t, good), s, d in zip(blocks, sure, doubt) if good and d and not s)
        cut = 2 * doubtful < sum(len(t) for t, good in blocks if good)
        gone = [s or (d and cut) for s, d in zip(sure, doubt)]
        expected[k] = ("\n".join(t for (t, good), g in zip(blocks, gone) if good and not g), sum(gone), sum(not good and not g for (_, good), g in zip(blocks, gone)))
    got = {x["page_id"]: (x["text"], x["n_template_blocks"], x["n_rule_blocks"]) for x in pages.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == expected
    # the counting stage changes pages that the rules alone leave as they are
    assert sum(got[k][0] != content[k] for k in got) > 50


def test_site_templates(spark):
    """Without an article, what recurs on a host's pages goes; what only copies share stays."""
    page = lambda k: f"<body><div id=top><p>Welcome to the site</p></div><div><p>text {k}</p></div></body>"
    rows = [(k, f"http://h.example/{k}", page(k)) for k in range(30)] + [(100 + k, f"http://copy.example/{k}", page(0)) for k in range(30)] + [(200, "http://other.example/", page(7)), (201, None, None), (202, "x", "")]
    got = {r["page_id"]: r for r in pages.main_text(spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, host int")).collect()}
    assert len(got) == len(rows)
    assert got[3]["text"] == "text 3" and got[100]["text"] == "Welcome to the site\ntext 0" and got[200]["text"] == "Welcome to the site\ntext 7"
    assert (got[201]["text"], got[201]["n_chars"], got[202]["text"]) == ("", 0, "")
    assert pages.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_site_templates_of_small_hosts(spark):
    """One rule for all hosts: a fifth of the pages with different text, and three at least."""
    page = lambda k, top=True: f"<body>{'<div id=x><p>Welcome</p></div>' if top else ''}<div><p>text {k}</p></div></body>"
    rows = [(f"h{n}", k, page(k)) for n in (2, 3, 15, 25) for k in range(n)]
    rows += [("few", k, page(k, k < 4)) for k in range(25)] + [("copies", k, page(min(k, 4), k > 1)) for k in range(40)]
    got = {r["url"]: r["text"] for r in pages.main_text(spark.createDataFrame([(k, f"http://{h}/{k}", p) for h, k, p in rows], "page_id long, url string, html string")).collect()}
    assert [got[f"http://h{n}/1"] for n in (2, 3, 15, 25)] == ["Welcome\ntext 1", "text 1", "text 1", "text 1"]
    assert got["http://few/1"] == "Welcome\ntext 1" and got["http://copies/3"] == "text 3"


def test_templates_in_articles(spark):
    """Boilerplate in plain elements of an article goes; copied articles with small edits keep their text."""
    page = lambda k: f"<article><h1>Head {k}</h1><p>{prose(k, 40)}</p><p>Read us daily.</p><ul><li>Write to us<li>all rights {k}</ul></article>"
    copy = lambda k: f"<article><h1>Head</h1><p>{prose(7, 40)}</p><p>edit {k}</p></article>"
    rows = [(k, f"http://a.example/{k}", page(k)) for k in range(6)] + [(10 + k, f"http://b.example/{k}", copy(k)) for k in range(6)]
    got = {r["page_id"]: r["text"] for r in pages.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[2] == f"Head 2\n{prose(2, 40)}\nall rights 2" and got[12] == f"Head\n{prose(7, 40)}\nedit 2"


def test_revisits(spark):
    schema = "record_id long, url string, at long, kind string, etag string, last_modified string, headers map<string,string>"
    r = random.Random(8)
    urls = ["http://a.example/x/", "https://www.A.example:443/x?utm_source=q#f", "http://a.example/y?b=2&a=1", "http://a.example/y?a=1&b=2", None]
    rows = [(k, r.choice(urls), r.choice([None, *range(60)]), r.choice(["response", "revisit"]), r.choice([None, '"1"', 'W/"1"', '"2"']), r.choice([None, "m"]), r.choice([None, {"date": str(k), "server": "s", "etag": "e"}])) for k in range(300)]
    got = {x["record_id"]: x for x in revisit.resolve(spark.createDataFrame(rows, schema), ranges=7).collect()}
    key = {None: None, urls[0]: "a.example/x", urls[1]: "a.example/x", urls[2]: "a.example/y?a=1&b=2", urls[3]: "a.example/y?a=1&b=2"}
    strip = lambda e: e[2:] if e and e.startswith("W/") else e
    assert set(got) == {x[0] for x in rows if x[3] == "revisit"}
    for k, url, at, kind, etag, lm, headers in rows:
        if kind != "revisit":
            continue
        best = max((x for x in rows if x[3] == "response" and url and at is not None and key[x[1]] == key[url] and x[2] is not None and x[2] <= at), key=lambda x: (x[2], x[0]), default=None)
        same = None
        if best:
            same = strip(etag) == strip(best[4]) if etag and best[4] else lm == best[5] if lm and best[5] else None
        verdict = "missing" if not best else "unverified" if same is None else "match" if same else "mismatch"
        merged = (best[6] or {}) | {n: v for n, v in (headers or {}).items() if n in revisit.PERMITTED} if verdict in ("match", "unverified") else headers or {}
        assert (got[k]["response_id"], got[k]["verdict"], got[k]["headers"]) == (best and best[0], verdict, merged)
    assert revisit.resolve(spark.createDataFrame([], schema)).count() == 0


def test_repeated_records_and_odd_urls(spark):
    schema = "record_id long, url string, at long, kind string, etag string, last_modified string, headers map<string,string>"
    rows = 2 * [(1, "http://a.example/x", 1, "response", '"1"', None, {"server": "s"})] + 2 * [(2, "http://a.example/x", 5, "revisit", '"1"', None, None)]
    rows += [(3, "dns:alpha.example", 1, "response", '"1"', None, None), (4, "dns:beta.example", 5, "revisit", '"1"', None, None), (5, "dns:alpha.example", 5, "revisit", '"1"', None, None), (6, "x", 7, None, None, None, None)]
    out = sorted((r["record_id"], r["response_id"] or 0, r["verdict"], len(r["headers"])) for r in revisit.resolve(spark.createDataFrame(rows, schema)).collect())
    assert out == [(2, 1, "match", 1), (2, 1, "match", 1), (4, 0, "missing", 0), (5, 3, "match", 0)]


def test_near_duplicates_with_clashing_ids_in_any_order(spark):
    """Rows that share a doc_id are rows of their own: both links below are found, whichever row comes first."""
    a, b = prose(901, 80), prose(902, 80)
    rows = [(1, a), (1, b), (2, a + " more"), (3, b + " more"), (4, "few"), (4, a), (5, None), (None, a), (2, a + " more")]
    expected = sorted([(1, 1), (1, 1), (2, 1), (3, 1), (4, 4), (4, 1), (5, 5), (None, None), (2, 1)], key=str)
    for order in (rows, rows[::-1], rows[3:] + rows[:3]):
        for parts in (1, 4):
            out = minhash.near_duplicates(spark.createDataFrame(order, DOC).repartition(parts), shingle_words=4, percent=80)
            assert sorted(((r["doc_id"], r["component_id"]) for r in out.collect()), key=str) == expected


def test_one_of_each_whatever_the_partitions(spark):
    """The rows that stay depend on ids and texts only; docs is computed anew, in other partitions, each time it is read."""
    a, b = prose(911, 90), prose(912, 90)
    rows = [(1, a, "x"), (1, b, "y"), (2, edited(a, 1, 1), "x"), (3, b, "x"), (3, b, "x"), (7, "", "x"), (7, "", "x"), (None, a, "x"), (None, prose(913, 50), "x"), (None, prose(913, 50), "x"), (8, prose(914, 50), "z"), (9, prose(914, 50), "z")]
    expected = sorted([(1, a, "x"), (1, b, "y"), (7, "", "x"), (7, "", "x"), (None, prose(913, 50), "x"), (8, prose(914, 50), "z")], key=str)
    r = random.Random(3)
    for parts in (1, 3, 8):
        r.shuffle(rows)
        docs = spark.createDataFrame(rows, DOC + ", fetch string").repartition(parts, F.rand())
        assert sorted(map(tuple, minhash.one_of_each(docs).collect()), key=str) == expected


def plain_ftrl(rows, y, epochs, alpha=0.3, beta=1.0, l1=0.02, l2=0.1):
    """Follow the regularised leader, feature by feature in dictionaries."""
    z, n = defaultdict(float), defaultdict(float)

    def weight(i):
        return 0.0 if abs(z[i]) <= l1 else (np.sign(z[i]) * l1 - z[i]) / ((beta + n[i] ** 0.5) / alpha + l2)

    bias = 1 << quality.BITS
    for _ in range(epochs):
        for f, t in zip(rows, y):
            x = {i: c / max(1, len(f)) ** 0.5 for i, c in Counter(f).items()} | {bias: 1.0}
            w = {i: weight(i) for i in x}
            p = 1 / (1 + np.exp(-max(-35, min(35, sum(w[i] * v for i, v in x.items())))))
            for i, v in x.items():
                g = (p - t) * v
                z[i] += g - ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / alpha * w[i]
                n[i] += g * g
    return {i: weight(i) for i in [*z]}


def test_quality_training_against_plain_python():
    r = random.Random(4)
    rows = [[r.randrange(60) * 997 for _ in range(r.randint(0, 40))] for _ in range(80)]
    y = np.array([float(sum(f) % 3 == 0) for f in rows])
    got = quality.follow_the_leader([np.array(f, np.int32) for f in rows], y, epochs=2)
    expected = plain_ftrl(rows, y, 2)
    full = np.zeros(len(got))
    for i, w in expected.items():
        full[i] = w
    assert np.allclose(got, full, atol=1e-5) and (got != 0).sum() > 20


def test_quality_scores_against_plain_sums(spark):
    weights = np.random.RandomState(5).normal(size=(1 << quality.BITS) + 1).astype(np.float32)
    texts = ["", None, "one", "one one one two", prose(31, 400), "é ü words, and-more!", prose(32, 5000)]
    expected = []
    for t in texts:
        f = np.concatenate([x for _, _, x, _ in quality._features(pa.array([t], pa.string()))] or [np.zeros(0, np.int32)])
        dot = sum(float(weights[i]) for i in f) / max(1, len(f)) ** 0.5 + float(weights[-1])
        expected.append(1 / (1 + np.exp(-max(-35, min(35, dot)))))
    out = quality.classify(spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], DOC + ", score string"), weights).collect()
    assert np.allclose([r["score"] for r in sorted(out, key=lambda r: r["doc_id"])], expected, atol=1e-4)
    assert all(r["predicted"] == int(r["score"] >= 0.3) for r in out)
