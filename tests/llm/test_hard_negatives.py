"""Hard negatives against all integer products, with bounds that discard and blocks that cut."""

import math
import random

import numpy as np
import pytest

from mnemoria.llm import hard_negatives as hn

SCHEMA = "`x.y` int, vec_id long, score string, embedding array<float>, label int, c string, n int, r int, rb int"


def _row(i, v, label):
    return (1, i, "s", v, label, "c", 2, 3, 4)


def _rows(seed, width=12, n=420):
    rng = np.random.default_rng(seed)
    scale = 0.7 ** np.arange(width)  # a few directions hold nearly all
    basis = np.linalg.qr(rng.normal(size=(width, width)))[0]
    v = (rng.normal(size=(n, width)) * scale) @ basis
    v[40:160] = v[40]  # a hot vector
    v[200:230] = np.round(v[200:230] * 2) / 2  # ties
    rows = [_row(k, [float(np.float32(x)) for x in v[k]], int(rng.integers(0, 3)) if k % 5 else 0) for k in range(n)]
    odd = [None, [], [None] * width, [math.nan] * width, [math.inf] + [0.0] * (width - 1), [1.0] * (width - 1), [0.0] * width, [-1e-30] * width]
    rows += [_row(n + 50 + k, x, 1) for k, x in enumerate(odd)]
    rows += [_row(n + 70, rows[3][3], None), _row(None, rows[3][3], 1), rows[50], rows[100], _row(100, rows[7][3], 2), _row(-50, rows[9][3], 1)]
    random.Random(seed).shuffle(rows)
    return rows, width


def _brute(rows, width):
    one = {}
    for _, i, _, v, label, *_ in rows:
        if i is None or label is None or v is None or len(v) != width or any(x is None or not math.isfinite(x) for x in v):
            continue
        r = ((label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * x) for x in v])
        one[i] = min(one.get(i, r), r)
    out = set()
    for a, (label, v) in one.items():
        if a % 50:
            continue
        score = {i: sum(x * y for x, y in zip(v, w, strict=True)) for i, (_, w) in one.items() if i != a}
        order = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in order if one[i][0] == label][:5]:
            inside = [i for i in order if one[i][0] != label and 50 * score[p] <= 100 * score[i] <= 95 * score[p]]
            out |= {(a, p, k, i, score[p], score[i]) for k, i in enumerate(inside[:3], 1)}
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_all_products(spark, seed, monkeypatch):
    for name, n in (("ROWS_BLOCK", 150), ("ANCHORS_BLOCK", 4), ("ROWS_PART", 40), ("ANCHORS_PART", 3)):
        monkeypatch.setattr(hn, name, n)
    rows, width = _rows(seed)
    got = hn.mine(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    columns = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    assert len(got) == len(set(got)) and {tuple(r[c] for c in columns) for r in got} == _brute(rows, width)


def test_nothing_and_little(spark):
    assert hn.mine(spark.createDataFrame([], SCHEMA)).count() == 0
    assert hn.mine(spark.createDataFrame([_row(0, [1.0, 2.0], 1)], SCHEMA)).count() == 0
    assert hn.mine(spark.createDataFrame([_row(0, [], 1), _row(50, None, 1)], SCHEMA)).count() == 0
    assert hn.mine(spark.createDataFrame([_row(50, [0.0, 0.0], 1), _row(1, [0.0, 0.0], 1), _row(2, [0.0, 0.0], 2)], SCHEMA)).collect() == [(50, 1, 1, 2, 0, 0)]


def test_scores_beyond_a_long(spark):
    rows = [_row(50, [1e30, 0.0], 1), _row(1, [1e30, 1.0], 1), _row(2, [1.0, 1.0], 2)]
    assert hn.mine(spark.createDataFrame(rows, SCHEMA)).count() == 0
    big, low = [float(np.float32(1e12)), 0.0], [1.0, 0.5]
    got = hn.mine(spark.createDataFrame([_row(50, big, 1), _row(1, [1.0, 0.0], 1), _row(2, [0.75, 0.5], 2), _row(3, low, 2)], SCHEMA)).collect()
    p = math.floor(256 * big[0]) * 256
    assert [tuple(r) for r in got] == [(50, 1, 1, 2, p, p * 3 // 4)]


def test_bounds_discard():
    """On vectors with a few strong directions few pairs get to the last component, and none that counts is lost."""
    rng = np.random.default_rng(5)
    ints = np.floor(256 * rng.normal(size=(2000, 32)) * 0.6 ** np.arange(32))
    order = np.argsort(-ints.var(axis=0))
    turn = hn.Rotation(np.eye(32)[:, order], [2, 4, 8, 32])
    side = hn.Side(np.arange(2000), np.zeros(2000, int), ints, turn)
    scores = ints @ ints.T
    floor = np.sort(scores, axis=1)[:, -6]
    x, y = hn.survivors(side, side, np.arange(300), np.arange(2000), turn, floor[:, None], np.full((2000, 1), np.inf), False)
    want = {(i, j) for i in range(300) for j in np.flatnonzero(scores[i] >= floor[i])}
    assert want <= set(zip(x.tolist(), y.tolist(), strict=True)) and len(x) < 2 * len(want)
    early = hn.Rotation(turn.matrix, [2, 4, 8])
    at_8 = hn.survivors(hn.Side(side.ids, side.labels, ints, early), side, np.arange(300), np.arange(2000), early, floor[:, None], np.full((2000, 1), np.inf), False)
    assert len(at_8[0]) < 300 * 2000 * 0.2
