"""The pipeline's stages with extra columns of any name and type; decontamination of repetitive texts."""

import random
import time

import pytest
from pyspark.sql import functions as F

from mnemoria.llm import decontam
from test_llm import _brute_overlaps, _text

#: Names with dots and back quotes, names that the stages use themselves, columns without an order.
EXTRA = {
    "a.b": "'x'", "`q`": "1", "__text": "'t'", "text_read": "'r'", "lang_pred": "'p'", "lang_score": "0.5D", "_lang_pred": "'p'", "kept": "false", "row": "3", "key": "'k'", "n": "2", "th": "4",
    "component_id": "9", "m": "map('k', 1)", "s": "named_struct('c.d', 1, 'e', array(1))", "deep": "array(map('k', 2))", "none": "cast(null as string)",
}


def test_stages_keep_any_columns(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(4)
    texts = [_text(rng, 80, [f"w{k}" for k in range(300)]) for _ in range(8)]
    rows = [(k, t, "en", "s", len(t)) for k, t in enumerate(texts)] + [(20, texts[1], "en", "s", 5), (21, None, None, None, None), (22, "", "en", "s", 0), (3, texts[3], "en", "s", 1), (3, texts[3], "fr", "s", 1), (None, texts[4], "en", "s", 1), (30, texts[6] + " mail a@b.co", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").select("*", *[F.expr(c).alias(n) for n, c in EXTRA.items()])
    names = docs.columns
    spark.createDataFrame([(1, texts[7])], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == names
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = sorted((r[0] is None, r[0] or 0) for r in docs.select("doc_id").collect())
    some = [(False, k) for k in range(8)]
    assert kept["language_id"] == sorted([*some, (False, 3), (False, 3), (False, 20), (False, 30), (True, 0)])
    assert kept["near_dedup"] == [*some, (True, 0)]  # 30 is a near copy of 6, 3 stays once
    assert kept["mask_pii"] == kept["decontaminate"] == [x for x in kept["near_dedup"] if x != (False, 7)]
    assert docs.select("`a.b`", "s.`c.d`").distinct().count() == 1
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == len(kept["mask_pii"])


@pytest.mark.parametrize("length", [1024, 1])
def test_repetitive_texts_against_all_diagonals(spark, length, monkeypatch):
    monkeypatch.setattr(decontam, "LEAST_STRETCH", length)
    rng = random.Random(length)
    items = [(1, "na " * 40), (2, "na " * 11), (3, "na hey " * 9), (4, _text(rng, 30, ["na", "hey", "ho"])), (5, _text(rng, 14, ["na", "hey"])), (6, "na na na na na na")]
    texts = [(k, _text(rng, rng.randint(1, 150), ["na", "hey", "ho"][: 1 + k % 3] + ["x"] * (k % 4 == 0))) for k in range(40)]
    texts += [(50, "x " * 200 + items[3][1] + " x" * 130), (51, "na " * 9), (52, "na " * 5), (53, items[4][1])]
    got = decontam.contaminated(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]): r["run"] for r in got} == _brute_overlaps(texts, items)


def test_a_long_repetitive_text(spark):
    """A diagonal at each of 200,000 places."""
    start = time.perf_counter()
    got = decontam.contaminated(spark.createDataFrame([(1, "na " * 200_000), (2, "words of another kind")], "doc_id long, text string"), spark.createDataFrame([(5, "na " * 40)], "item_id long, text string")).collect()
    assert [(r["doc_id"], r["item_id"], r["run"]) for r in got] == [(1, 5, 40)]
    assert time.perf_counter() - start < 120


def test_without(spark, monkeypatch):
    rows = [(None if k % 50 == 7 else k, f"t{k}", k) for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `a.b` long")
    for gone in ([], [3, 299, 5000], list(range(0, 300, 2))):
        ids = spark.createDataFrame([(k,) for k in gone], "doc_id long")
        want = sorted((str(r[0]), r[1]) for r in rows if r[0] not in set(gone))
        for words in (1 << 18, 2):  # two words are soon full: all rows are looked up then
            monkeypatch.setattr(decontam, "FILTER_WORDS", words)
            assert sorted((str(r[0]), r[1]) for r in decontam.without(docs, ids).collect()) == want


def test_cleared_tables_go(spark):
    from mnemoria.llm.common import cleared, materialize

    kept = []
    with cleared(kept):
        one, two = materialize(spark.range(3), "one"), materialize(spark.range(4), "two")
        kept.append(two)
    assert two.count() == 4
    with pytest.raises(Exception):
        spark.read.parquet(one._written_to).count()
