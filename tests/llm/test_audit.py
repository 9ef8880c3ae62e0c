"""The filter audit against counting document by document, order by order."""

import collections
import itertools
import random
import re

import pytest

from mnemoria.llm import filter_audit

SCHEMA = "`a.b` string, step int, doc_id long, part string, text string, source string, good string, mask long, key string"
LABELS = "doc_id long, quality int, toxic int, part string"


def _rows(seed):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(70)] + ["Up", "$1"]
    texts = [None, "", " \n", "a|b", "É" * 80, "x " * 60_000, "a\x0bb\x0cc\rd\x1ce f"]
    texts += [" ".join(rng.choice(words[: rng.choice([20, 68, 72])]) for _ in range(rng.choice([10, 49, 50, 51, 90]))) for _ in range(40)]
    texts += [rng.choice(texts[7:]) for _ in range(20)]
    ids = [None if k % 23 == 5 else k // 2 if k % 17 == 3 else k for k in range(len(texts))]
    docs = [("x", 1, i, "p", t, [None, "", "s", "t"][k % 4], "g", 3, "k") for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
    docs += docs[10:12]  # repeated rows
    labels = [(rng.choice([None, *ids]), rng.choice([0, 1, None]), rng.choice([0, 1, None]), "z") for _ in range(60)]
    return docs, labels


def _brute(docs, labels):
    told = collections.defaultdict(lambda: [False, False])
    for i, q, x, _ in labels:
        told[i][0] |= q == 1
        told[i][1] |= x == 1
    least = {}
    for d in docs:
        if d[2] is not None:
            least[d[4] or ""] = min(d[2], least.get(d[4] or "", d[2]))
    each = collections.defaultdict(list)
    for d in docs:
        t = d[4] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": d[2] is not None and d[2] > least[t]}
        each[d[5] or ""].append(("".join(f for f in "ABCDE" if fails[f]), *(told[d[2]] if d[2] is not None else (False, False))))
    out = {}
    for part, rows in each.items():
        total = collections.Counter()
        for order in map("".join, itertools.permutations("ABCDE")):
            left = rows
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[0]]
                left = [r for r in left if f not in r[0]]
                total[f] += len(gone)
                out[part, order, step] = [len(left), len(gone), sum(f in r[0] for r in rows) - len(gone), sum(r[0] == f for r in rows), sum(r[1] for r in gone), sum(r[2] for r in gone)]
        for (p, order, step), x in out.items():
            if p == part:
                x.append(total[order[step - 1]])
    return out


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("parts", [1024, 1])
def test_audit(spark, seed, parts, monkeypatch):
    monkeypatch.setattr(filter_audit, "PARTS_AT_ONCE", parts)
    docs, labels = _rows(seed)
    got = filter_audit.audit(spark.createDataFrame(docs, SCHEMA).repartition(3), spark.createDataFrame(labels, LABELS)).collect()
    assert len(got) == 600 * len({d[5] or "" for d in docs})
    assert {(r["part"], r["filter_order"], r["step"]): [r[c] for c in filter_audit.COUNTS] for r in got} == _brute(docs, labels)


def test_audit_of_nothing(spark):
    assert filter_audit.audit(spark.createDataFrame([], SCHEMA), spark.createDataFrame([], LABELS)).count() == 0
    one = filter_audit.audit(spark.createDataFrame(_rows(1)[0][:1], SCHEMA), spark.createDataFrame([], LABELS))
    assert one.count() == 600 and {(r["filter_order"], r["n"]) for r in one.groupBy("filter_order").agg({"removed": "sum"}).toDF("filter_order", "n").collect()} == {(o, 1) for o in filter_audit.ORDERS}


def test_table():
    table = filter_audit.first_failures()
    assert table.shape == (32, 120) and (table[0] == 0).all() and (table[31] == 1).all()
    assert table[0b00101][filter_audit.ORDERS.index("BCAED")] == 2
