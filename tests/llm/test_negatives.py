"""Hard negatives against plain Python."""

import random

import pytest

from siftline.llm import negatives

ROW = "id long, label long, vector array<long>, anchor boolean, rank string"


def plain(rows, n_positives=5, n_negatives=3, low=50, high=95):
    rows = [r for r in rows if r[1] is not None and r[2] is not None and None not in r[2]]
    out = []
    for i, (aid, alabel, avector, anchor, _) in enumerate(rows):
        if not anchor or aid is None:
            continue
        scored = [(max(-(2**63 - 1), min(2**63 - 1, sum(x * y for x, y in zip(avector, v)))), id_, label) for j, (id_, label, v, *_) in enumerate(rows) if j != i and len(v) == len(avector)]
        scored.sort(key=lambda x: (-x[0], x[1] is None, x[1] or 0))
        for ps, pid, _ in [x for x in scored if x[2] == alabel][:n_positives]:
            fit = [x for x in scored if x[2] != alabel and low * ps <= 100 * x[0] <= high * ps][:n_negatives]
            out += [(aid, pid, k + 1, nid, ps, ns) for k, (ns, nid, _) in enumerate(fit)]
    return sorted(out, key=str)


def table(spark, rows):
    return spark.createDataFrame(rows, ROW)


def mined(df, **more):
    return sorted(map(tuple, negatives.mine(df, **more).collect()), key=str)


@pytest.mark.parametrize("blocks", [{}, {"anchor_block": 7, "row_block": 20}])
def test_against_plain_python(spark, blocks):
    r = random.Random(5)
    rows = [(k, r.randint(0, 3), [r.randint(-20, 60) for _ in range(4)], k % 5 == 0, "x") for k in range(150)]
    # ties, zero and negative scores, copies of an anchor, ids that repeat, other lengths, nulls
    rows += [(200 + k, k % 3, [10, 10, 10, 10], k % 4 == 0, None) for k in range(30)] + [(300 + k, k % 2, [0, 0, 0, 0], True, None) for k in range(3)]
    rows += [rows[0], rows[5], (5, 1, [30, 30, 30, 30], True, None), (None, 1, [9, 9, 9, 9], True, None), (None, 0, [10, 10, 10, 10], False, None)]
    rows += [(400, 0, [1, 2], True, None), (401, 0, [100, 7], False, None), (402, 1, [60, 5], False, None), (403, 1, [], True, None), (404, 1, [], False, None), (405, 2, [], None, None)]
    rows += [(500, None, [1, 1, 1, 1], True, None), (501, 1, None, True, None), (502, 1, [1, None, 1, 1], True, None), (None, None, None, None, None)]
    got = mined(table(spark, rows), **blocks)
    assert got == plain(rows) and len(got) > 100
    r.shuffle(rows)
    assert mined(table(spark, rows), **blocks) == got


def test_scores_beyond_doubles_and_beyond_64_bits(spark):
    big = 2**30
    rows = [(0, 0, [big, 1], True, ""), (1, 0, [big, 3], False, ""), (2, 0, [big, 2], False, ""), (3, 1, [big * 9 // 10, 5], False, ""), (4, 1, [big * 9 // 10, 6], False, ""), (5, 1, [2**62, 0], False, ""), (6, 0, [2**62, 2], False, "")]
    assert mined(table(spark, rows)) == plain(rows) != []
    assert mined(table(spark, rows), high=100) == plain(rows, high=100) != plain(rows)


def test_hot_vector_and_label(spark):
    rows = [(k, 0 if k < 250 else k % 4, [3, 4, 5] if k % 3 else [k % 11, 2, 7], k % 50 == 0, "") for k in range(400)]
    assert mined(table(spark, rows), anchor_block=4, row_block=50) == plain(rows) != []


def test_other_windows_and_counts(spark):
    r = random.Random(9)
    rows = [(k, r.randint(0, 2), [r.randint(0, 9) for _ in range(3)], k % 3 == 0, "") for k in range(60)]
    for more in ({"n_positives": 1, "n_negatives": 7}, {"low": 0, "high": 100}, {"n_positives": 100, "n_negatives": 1, "low": 90, "high": 99}):
        assert mined(table(spark, rows), **more) == plain(rows, **more)


def test_none_and_few(spark):
    assert mined(table(spark, [])) == []
    assert mined(table(spark, [(0, 1, [1], True, "")])) == []
    assert mined(table(spark, [(0, 1, [2], False, ""), (1, 0, [1], False, "")])) == []
