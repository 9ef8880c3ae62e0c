"""The stored index against the scan: scores and ranks, phrases, segments, removals, pruned reads."""

import random
import re

import pytest
from pyspark.sql import functions as F

from mnemoria.errors import StoreError
from mnemoria.operators.search import search_bm25
from mnemoria.sources import text_index
from mnemoria.sources.text_index import TextIndex

SCHEMA = "id long, content string, wing string, room string, created_at long"
TERMS = [["license", "there"], ["aaa"], ["na na"], ["日本語"], ["ab", "banana split"], ["sRc1"], ["nothing like it"], ["İx", "x😀y", "the", "bananana"], ["xy"]]


def _rows(seed, ids):
    rng = random.Random(seed)
    words = ["license", "there", "the", "na", "banana", "split", "日本語", "aaaa", "ab", "x😀y", "ix", "İx", "\n", "LICENSE"]
    out = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(0, 30))), rng.choice(["en", "fr", None]), rng.choice(["src1", "src12", None]), k) for k in ids]
    return out + [(ids[-1] + 1, None, "en", "src1", 1), (ids[-1] + 2, "", "", "", 1), (ids[-1] + 3, "a" * 5000 + "na" * 3000, "en", "banana", 1), (ids[-1] + 4, "aa", "a", "licensethere", 1), (None, "license", "en", "r", 1)]


def _same(index, mem, terms, k=20, where=None):
    keep = ["id", "bm25", "score_compat"] + ["rank"] * (k is not None)
    want = search_bm25(mem.filter("id is not null"), terms, k, where).select(*keep).collect()
    assert sorted(index.search(terms, k, where).select(*keep).collect()) == sorted(want)
    return want


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    text_index.BLOCK_ROWS, before = 37, text_index.BLOCK_ROWS
    mem = spark.createDataFrame(_rows(1, range(200)), SCHEMA).repartition(3).persist()
    index = TextIndex(spark, f"file://{tmp_path_factory.mktemp('index')}")
    index.append(mem)
    text_index.BLOCK_ROWS = before
    return index, mem


@pytest.mark.parametrize("terms", TERMS)
def test_same_rows_as_the_scan(built, terms):
    found = _same(*built, terms)
    assert bool(found) == (terms not in (["nothing like it"], ["xy"]))
    _same(*built, terms, None, (F.col("wing") == "en") & (F.col("room") == "src1"))


def test_a_query_reads_its_own_lists(built, tmp_path):
    index, _ = built
    scan = index.postings(["license"])
    plan = scan._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*part#\d+ IN ", plan) and re.search(r"PushedFilters: \[[^\]]*In\(gram", plan)
    assert len(text_index.cover("license")) == 3
    assert scan.select("part").distinct().count() <= 3 and scan.select("gram").distinct().count() == 3
    search = index.search(["license"])._jdf.queryExecution().toString()
    assert "content" not in search.split("== Physical Plan ==")[1]


def test_segments_and_removals(spark, tmp_path):
    index = TextIndex(spark, f"file://{tmp_path}/index")
    with pytest.raises(StoreError):
        index.search(["the"])
    one, two, three = (spark.createDataFrame(_rows(k, ids), SCHEMA) for k, ids in ((1, range(40)), (2, range(100, 130)), (3, range(20, 30))))
    index.append(one)
    index.append(two)
    pinned = TextIndex(spark, index.root, index.latest())
    both = one.union(two)
    _same(index, both, ["the", "banana"])
    index.remove(spark.createDataFrame([(3,), (105,), (None,), (9999,)], "id long"))
    left = both.filter("id not in (3, 105)")
    _same(index, left, ["the", "banana"])
    index.append(three, replace=True)  # in place of what its ids had
    _same(index, left.join(three.select("id"), "id", "left_anti").union(three), ["the", "banana"])
    index.append(one.filter("id = 3"))
    assert 3 in {r["id"] for r in index.documents().collect()}
    _same(pinned, both, ["the", "banana"])
    with pytest.raises(StoreError):
        index.append(one.filter("id = 4").union(one.filter("id = 4")))
    _same(pinned, both, ["license"])


def test_an_empty_table(spark, tmp_path):
    index = TextIndex(spark, f"file://{tmp_path}/index")
    index.append(spark.createDataFrame([], SCHEMA))
    assert index.search(["the"]).count() == 0


def test_apart():
    import numpy as np

    assert text_index.apart(np.array([0, 1, 2, 3, 7, 8]), 3).tolist() == [0, 3, 7]
    assert text_index.apart(np.array([0, 3, 6]), 3).tolist() == [0, 3, 6]


def test_lists_are_packed():
    import numpy as np

    rng = np.random.default_rng(1)
    lists = [np.unique(rng.integers(0, 10**top, 50)) for top in (1, 3, 6, 9, 14)] + [np.array([0]), np.array([127, 128, 2**40])]
    starts = np.cumsum([0, *map(len, lists)])[:-1]
    data, at = text_index.packed(np.concatenate(lists), starts)
    assert all((text_index.unpacked(data[a:b].tobytes()) == x).all() for a, b, x in zip(at[:-1], at[1:], lists, strict=True))
    text = " ".join(rng.choice(["license", "there", "tion", "memory", "plan"], 50_000))
    rows = text_index.block_postings([1], [(text, "en", "src1")], 0)
    assert rows.nbytes < 3 * len(text)  # 12 bytes a letter and more before
