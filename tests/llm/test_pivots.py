"""The pivot index against all pairs: recall, components and links of groups, odd vectors."""

import math
import random

import numpy as np
import pytest

from mnemoria.llm import pivots

SCHEMA = "`x.y` int, vec_id long, v string, embedding array<float>, label int, id string, n int, near int, pivot int, block int"


def _row(i, v):
    return (1, i, "s", v, 2, "c", 2, 3, 4, 5)


def _floats(v):
    return [float(np.float32(x)) for x in v]


def _rows(seed, width=24, n=700):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, width))
    v[100:250] = v[100] + 0.12 * rng.normal(size=(150, width)) * np.linalg.norm(v[100]) / math.sqrt(width)  # a hot group of near copies
    v[250:300] = v[250]  # a hot vector
    v[300:340] = v[340:380] + 0.45 * rng.normal(size=(40, width))  # about the threshold
    for k in range(401, 430):  # a chain
        v[k] = v[k - 1] + 0.3 * rng.normal(size=width) * np.linalg.norm(v[k - 1]) / math.sqrt(width)
    v[450] = 3e30 * v[451]
    v[452] = -v[453]
    rows = [_row(k * 2, _floats(x)) for k, x in enumerate(v)]
    odd = [None, [], [None] * width, [math.nan] * width, [math.inf] * width, [0.0] * width, [1.0, 0.1], [1.0, 0.11]]
    rows += [_row(5001 + k, x) for k, x in enumerate(odd)] + [_row(None, rows[3][3]), _row(None, None), rows[110], rows[260]]
    random.Random(seed).shuffle(rows)
    return rows


def _brute(rows):
    one = {}
    for r in rows:
        if r[1] is not None and r[3] and all(x is not None and math.isfinite(x) for x in r[3]) and any(r[3]):
            one[r[1]] = np.array(r[3]) / np.linalg.norm(np.array(r[3]))
    ids = sorted(one)
    links = {i: {j for j in ids if j != i and len(one[i]) == len(one[j]) and one[i] @ one[j] >= 0.9} for i in ids}
    component = {}
    for i in ids:
        stack = [i]
        while stack:
            k = stack.pop()
            if k not in component:
                component[k] = i
                stack += links[k]
    return links, component


@pytest.mark.parametrize("block", [4096, 60])
def test_recall_and_components(spark, block, monkeypatch):
    monkeypatch.setattr(pivots, "BLOCK", block)
    monkeypatch.setattr(pivots, "PART", 512 if block > 512 else 25)
    rows = _rows(block)
    got = pivots.near_vectors(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert sorted((r["vec_id"] is None, r["vec_id"] or 0) for r in got) == sorted((r[1] is None, r[1] or 0) for r in rows)
    links, component = _brute(rows)
    n = {r["vec_id"]: r["n_links"] for r in got}
    assert all(n[i] == 0 for i in n if i not in links) and all(n[i] <= len(x) for i, x in links.items())
    assert sum(n[i] for i in links) >= 0.99 * sum(map(len, links.values()))
    assert all(n[i] == len(links[i]) for i in [k * 2 for k in range(100, 300)])  # the hot groups, whole
    same = {r["vec_id"]: r["component_id"] for r in got}
    assert sum(same[i] == component[i] for i in links) >= 0.99 * len(links)
    for r in got:
        assert r["kept"] == (r["vec_id"] == r["component_id"])
        if r["vec_id"] is not None and r["vec_id"] not in links:
            assert (r["component_id"], r["kept"], r["n_links"]) == (r["vec_id"], True, 0)


@pytest.mark.parametrize("width", [8, 64])
def test_recall_near_the_threshold(spark, width):
    """Pairs whose cosine is 0.9 to 0.93, the hardest ones, among vectors of even directions."""
    rng = np.random.default_rng(width)
    v = rng.normal(size=(3000, width))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    for k in range(0, 3000, 10):
        across = rng.normal(size=width)
        across -= across @ v[k] * v[k]
        c = rng.uniform(0.9, 0.93)
        v[k + 1] = c * v[k] + math.sqrt(1 - c * c) * across / np.linalg.norm(across)
    got = {r["vec_id"]: r["n_links"] for r in pivots.near_vectors(spark.createDataFrame([_row(k, x.tolist()) for k, x in enumerate(v)], SCHEMA)).collect()}
    v = v.astype(np.float32).astype(float)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    want = (v @ v.T >= 0.9).sum(axis=1) - 1
    assert all(got[k] <= want[k] for k in got) and sum(got.values()) >= 0.95 * want.sum()


def test_nothing_and_little(spark):
    assert pivots.near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0
    assert [tuple(r) for r in pivots.near_vectors(spark.createDataFrame([_row(4, [1.0, 2.0])], SCHEMA)).collect()] == [(4, 0, 4, True)]
    got = pivots.near_vectors(spark.createDataFrame([_row(4, [1.0, 2.0]), _row(7, [1.0, 2.1]), _row(9, [2.0, -1.0])], SCHEMA)).collect()
    assert {tuple(r) for r in got} == {(4, 1, 4, True), (7, 1, 4, False), (9, 0, 9, True)}


def test_shared():
    rng = np.random.default_rng(1)
    a, b = (np.sort(np.stack([rng.permutation(40)[:6] for _ in range(n)]), axis=1) for n in (7, 9))
    for p in (0, 11, 39):
        got = pivots.shared(a, b, p)
        assert got.tolist() == [[sum(1 + 256 * (q < p) for q in set(x) & set(y)) for y in b.tolist()] for x in a.tolist()]
