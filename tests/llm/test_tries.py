"""Prefix tries against plain Python: nulls, ties, repeated rows, hot first turns, copies, long and empty conversations."""

import hashlib
import random

import pytest

from siftline.llm import tries

ROW = "conv_id long, turn long, role string, text string, j string, head long"


def plain(rows, empty=()):
    lists = {c: [] for c in empty}
    for c, t, r, x in rows:
        if c is not None:
            lists.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    whole = {c: tuple((r, x) for _, _, r, x in sorted(v)) for c, v in lists.items()}
    members, children = {}, {}
    for c, w in whole.items():
        for d in range(len(w) + 1):
            members.setdefault(w[:d], []).append(c)
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)
    leaves, saved, out = {}, {}, []
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[x] for x in children.get(p, [])) or 1
        saved[p] = sum(saved[x] for x in children.get(p, [])) + ((len(members[p]) - 1) * len(p[-1][1]) if p else 0)
        ends = ",".join(str(c) for c in sorted(members[p]) if whole[c] == p)
        out.append((min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(children.get(p, [])), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def made(spark, rows, empty=(), **more):
    df = spark.createDataFrame([(*r, "x", 7) for r in rows], ROW)
    turns = tries.numbered(df)
    ids = turns.select("conv_id").distinct()
    if empty:
        ids = ids.union(spark.createDataFrame([(c,) for c in empty], "conv_id long"))
    return sorted(map(tuple, tries.trie(turns, ids, **more).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()), key=str)


def talks():
    r = random.Random(3)
    rows = []
    for c in range(-3, 60):
        n = r.randint(1, 7)
        # a hot first turn, few texts, so that heads are shared
        rows += [(c, t, "user" if t % 2 else "bot", "hello" if t == 0 and c % 3 else r.choice(["a", "bb", "", "é𝒳"])) for t in range(n)]
    rows += [(c, t, "user", f"copy {t}") for c in range(100, 120) for t in range(5)]
    rows += [(c, t, "user", f"copy {t}") for c in (130, 131) for t in range(4)]
    rows += [(c, t, "bot", f"long {t}") for c in (200, 201) for t in range(300)] + [(201, 300, "bot", "end"), (202, 0, "bot", "long 0")]
    rows += [(300, None, None, None), (300, 1, "", None), (300, 1, "", None), (300, 1, "a", "b"), (300, None, "z", "first"), (None, 1, "user", "lost"), (301, 1, "1:a", "b"), (302, 1, "1", ":ab")]
    return rows


@pytest.mark.parametrize("container_turns", [20_000, 40, 0])
def test_against_plain_python(spark, container_turns):
    rows = talks()
    random.Random(container_turns).shuffle(rows)
    empty = [-50, 999, 1000]
    got = made(spark, rows, empty, container_turns=container_turns)
    assert got == plain(rows, empty) and len(got) > 400


def test_one_conversation_and_none(spark):
    one = [(5, t, "user", str(t)) for t in range(4)]
    assert made(spark, one) == plain(one)
    assert made(spark, []) == []
    assert made(spark, [(None, 1, "a", "b")]) == []
    assert made(spark, [], [4, 9]) == plain([], [4, 9])


def test_one_conversation_with_most_rows_goes_by_ranges(spark):
    rows = [(1, t // 2, "user", str(t % 5)) for t in range(3000)] + [(c, 0, "user", "0") for c in range(2, 300)]
    df = tries.numbered(spark.createDataFrame([(*r, "x", 7) for r in rows], ROW))
    assert sorted(r["j"] for r in df.where("conv_id = 1").collect()) == list(range(1, 3001))
    assert made(spark, rows, container_turns=500) == plain(rows)


def test_suffix_sums_over_blocks(spark):
    n = 3 * tries._BLOCK + 5
    df = spark.range(n).selectExpr("id % 2 AS k", "id AS j", "id % 7 AS v")
    got = {(r["k"], r["j"]): r["rest"] for r in tries._suffix_sums(df, ["k"], "v").collect()}
    rest = [0, 0]
    for j in reversed(range(n)):
        rest[j % 2] += j % 7
        assert got[j % 2, j] == rest[j % 2]
