"""Both ways of matching names against brute force."""

import random

import pytest

from mnemoria.operators.matching import match_names


def _brute(texts, names):
    known = {}
    for n in sorted(filter(None, names), reverse=True):
        known[n.lower()] = n
    out = set()
    for i, t in texts:
        low, at = (t or "").lower(), 0
        while at < len(low):
            best = max((k for k in known if low.startswith(k, at)), key=len, default=None)
            if best:
                out.add((i, known[best], at + 1))
            at += len(best) if best else 1
    return out


LONG = "long " * 30 + "end"


@pytest.mark.parametrize("most", [10**6, 0])
@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, most, seed):
    r = random.Random(seed)
    some = lambda n: "".join(r.choice("abAß张. ") for _ in range(n))
    names = [some(r.randint(1, 9)) for _ in range(60)] + ["Ab", "aB", None, "", LONG, LONG[:70], "张三丰", "张三"]
    texts = [(n, some(r.randint(0, 400))) for n in range(40)] + [(97, None), (98, ""), (99, "x" + LONG + LONG[:-1] + "张三丰张三")]
    got = match_names(spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame([(n,) for n in names] * 2, "name string"), most).collect()
    assert len(got) == len(set(got)) and {tuple(g) for g in got} == _brute(texts, names)


@pytest.mark.parametrize("most", [10**6, -1])
def test_nothing_to_match(spark, most):
    texts, none = spark.createDataFrame([(1, "a")], "id long, text string"), spark.createDataFrame([], "name string")
    assert match_names(texts, none, most).collect() == []
    assert match_names(texts.limit(0), texts.selectExpr("text as name"), most).collect() == []
