"""The writable store: appends, upserts, deletes, expiry, and a batch that is taken back."""

import pytest
from pyspark.sql import functions as F

from mnemoria.errors import StoreError
from mnemoria.operators import hooks
from mnemoria.operators.plugins import Stages, Tools, rerank
from mnemoria.plans import pql
from mnemoria.sources.store import Store

ROWS = [(k, f"text {k}", None if k % 3 else 100 * k) for k in range(40)]


@pytest.fixture
def store(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/store")
    s.append("memories", spark.createDataFrame(ROWS, "id long, content string, expires_at long"))
    return s


def _rows(df):
    return {r["id"]: r["content"] for r in df.collect()}


def test_append_and_upsert(spark, store):
    store.upsert("memories", spark.createDataFrame([(3, "new", None), (3, "newer", None), (99, "added", None), (None, "no key", None)], "id long, content string, expires_at long"))
    got = _rows(store.read("memories"))
    assert got == {**{k: t for k, t, _ in ROWS}, 3: "newer", 99: "added"}
    assert store.read("memories").count() == 41


def test_a_delete_rewrites_nothing(spark, store, tmp_path):
    before = {p: p.stat().st_mtime_ns for p in tmp_path.rglob("*.parquet")}
    store.delete("memories", spark.createDataFrame([(5,), (None,), (5,), (1000,)], "id long"))
    assert all(p.exists() and p.stat().st_mtime_ns == t for p, t in before.items())
    assert set(_rows(store.read("memories"))) == set(range(40)) - {5}
    store.append("memories", spark.createDataFrame([(5, "again", None)], "id long, content string, expires_at long"))
    assert _rows(store.read("memories"))[5] == "again"  # the delete vector is older than the row


def test_readers_stay_on_their_version(spark, store):
    first = store.latest()
    pinned, lazy = store.at(first), store.read("memories")
    store.upsert("memories", spark.createDataFrame([(1, "one", None)], "id long, content string, expires_at long"))
    store.delete("memories", spark.createDataFrame([(2,)], "id long"))
    old, new = {k: t for k, t, _ in ROWS}, {**{k: t for k, t, _ in ROWS if k != 2}, 1: "one"}
    assert _rows(pinned.read("memories")) == _rows(lazy) == old and _rows(store.read("memories")) == new
    assert store.latest() == first + 2 and _rows(store.at(first + 1).read("memories")) == {**old, 1: "one"}
    with pytest.raises(StoreError):
        pinned.append("memories", lazy)
    store.compact("memories")
    assert _rows(store.read("memories")) == new and _rows(pinned.read("memories")) == old
    entry = store.state()["tables"]["memories"]
    assert len(entry["adds"]) == 1 and not entry["deletes"]
    store.vacuum()
    assert _rows(store.read("memories")) == new
    with pytest.raises(StoreError):
        pinned.read("memories")


@pytest.mark.parametrize("step", range(9))
def test_a_failure_between_any_two_steps(spark, tmp_path, monkeypatch, step):
    """Each write of files and of versions fails once; what a reader sees is one version or another, never a mixture."""
    from mnemoria.sources import log, store as module

    s = Store(spark, f"file://{tmp_path}/s")
    rows = lambda ids, word: spark.createDataFrame([(k, word) for k in ids], "id long, content string")
    with s.transaction() as t:
        t.append("a", rows(range(4), "old"))
        t.append("b", rows(range(4), "old"))
    before = s.latest()
    calls = [0]

    def failing(f):
        def run(*args):
            calls[0] += 1
            if calls[0] == step + 1:
                raise OSError("no space left")
            return f(*args)

        return run

    monkeypatch.setattr(module.Transaction, "_write", failing(module.Transaction._write))
    monkeypatch.setattr(log.Folder, "write", failing(log.Folder.write))
    monkeypatch.setattr(log.Folder, "rename", failing(log.Folder.rename))

    def change():
        with s.transaction() as t:
            t.upsert("a", rows([3, 9], "new"))
            t.delete("b", rows([0], ""))
            t.insert_new("b", rows([1, 7], "new"))
            t.upsert("c", rows([1], "new"))

    old, new = ({k: "old" for k in range(4)}, {k: "old" for k in range(4)}), ({0: "old", 1: "old", 2: "old", 3: "new", 9: "new"}, {1: "old", 2: "old", 3: "old", 7: "new"})
    try:
        change()
        failed = False
    except (StoreError, OSError):
        failed = True
    assert failed == (step < 7)  # five file sets, the draft of the version and its rename
    assert (_rows(s.read("a")), _rows(s.read("b"))) == (old if failed else new) and s.exists("c") == (not failed)
    assert s.latest() == before + (not failed)
    if failed:
        change()
        assert (_rows(s.read("a")), _rows(s.read("b"))) == new
    s.vacuum()
    assert (_rows(s.read("a")), _rows(s.read("b"))) == new and len(list((tmp_path / "s" / "data").iterdir())) == 7


def test_writers_at_once(spark, store):
    """Of two writers from one version an append goes after the other, a delete fails."""
    more = spark.createDataFrame([(100, "x", None)], "id long, content string, expires_at long")
    one, two, three = store.transaction(), store.transaction(), store.transaction()
    one.append("memories", more)
    two.append("memories", more)
    three.delete("memories", more)
    one.commit()
    two.commit()
    with pytest.raises(StoreError):
        three.commit()
    assert store.read("memories").count() == 42
    with store.transaction() as t:
        t.set_property("memories", "embedder", "hashing-64")
    store.append("memories", more)
    assert store.properties("memories") == {"embedder": "hashing-64"}


def test_delete_all_and_write_again(spark, store):
    store.delete("memories", store.read("memories"))
    assert store.read("memories").count() == 0
    store.insert_new("memories", spark.createDataFrame(ROWS[:3], "id long, content string, expires_at long"))
    store.insert_new("memories", spark.createDataFrame([(1, "other", None), (7, "x", None)], "id long, content string, expires_at long"))
    assert _rows(store.read("memories")) == {0: "text 0", 1: "text 1", 2: "text 2", 7: "x"}


def test_expire(store):
    store.expire("memories", 1000)
    assert set(_rows(store.read("memories"))) == {k for k, _, e in ROWS if e is None or e >= 1000}


def test_missing_table(store):
    with pytest.raises(StoreError) as e:
        store.read("nothing")
    assert e.value.to_dict()["status"] == 500


def test_batch_is_taken_back(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/s")
    embed = lambda rows: rows.select("id", F.array(F.length("content").cast("double")).alias("embedding"))
    first = spark.createDataFrame([(1, "a"), (2, "bb"), (3, "bb")], "id long, content string")
    s.sink_batch(first, embed)
    assert s.read("vectors").count() == 2

    def broken(rows):
        raise RuntimeError("no model")

    with pytest.raises(StoreError):
        s.sink_batch(spark.createDataFrame([(3, "bb"), (4, "c")], "id long, content string"), broken)
    assert set(_rows(s.read("memories"))) == {1, 2, 3} and s.read("verbatim").count() == 5
    s.sink_batch(spark.createDataFrame([(5, "bb"), (6, "d")], "id long, content string"), embed)
    assert s.read("vectors").count() == 3 and set(_rows(s.read("memories"))) == {1, 2, 3, 5, 6}
    s.delete("memories", spark.createDataFrame([(6,)], "id long"))
    s.rebuild(embed)
    assert {r["id"] for r in s.read("vectors").select("id").collect()} == {1, 2, 3, 5}


def test_stages(spark):
    rows = spark.createDataFrame([(1, "cafÃ©\x00", "en", "a/b?"), (2, "café", "en", "x"), (3, "John Smith", "fr", "y")], "id long, content string, wing string, room string")
    stages = Stages.default()
    out = {r["id"]: r for r in stages.run(rows).collect()}
    assert set(out) == {1, 3} and out[1]["content"] == "café" and out[3]["scene"] == "John Smith" and out[1]["path"] == "en/a/b%3F"
    stages.register("upper", lambda df: df.withColumn("content", F.upper("content")), after="repair").remove("dedup")
    assert list(stages.stages)[:3] == ["repair", "upper", "hash"] and stages.run(rows, ["upper"]).count() == 3
    for bad in (lambda: stages.run(rows, ["nothing"]), lambda: stages.remove("dedup"), lambda: stages.register("x", None, after="dedup")):
        with pytest.raises(StoreError):
            bad()


def test_tools(spark):
    tools = Tools().register("count", lambda df: df.agg(F.count("*").alias("n")), "public").register("all", lambda df, k: df.limit(k), "system")
    rows = spark.range(5)
    assert tools.call("count", rows, level="public").first()["n"] == 5 and tools.call("all", rows, k=2).count() == 2
    assert tools.names("user") == ["count"]
    for name, level in (("all", "user"), ("none", "system")):
        with pytest.raises(StoreError):
            tools.call(name, rows, level=level)


def test_rerank_falls_back(spark):
    rows = spark.createDataFrame([(1, "license there", 0.5, 1), (2, "other words entirely", 1.0, 1)], "id long, text string, rrf_score double, n_sources long")
    assert [r["id"] for r in rerank(rows, "license", "not registered").orderBy("rank").collect()] == [r["id"] for r in rerank(rows, "license").orderBy("rank").collect()]


def test_hooks(spark):
    turns = [(1, 0, "user", "please remember my name"), (1, 1, "assistant", "noted\n<tool_call>\nx\n```"), (1, 2, "user", "ok"), (1, 3, "assistant", "<tool_call>\nx\n```"), (2, 0, "assistant", "hello out there"), (2, 1, "user", None)]
    got = {(r["conv_id"], r["turn"]): (r["content"], r["reply_to"]) for r in hooks.turns_to_store(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).collect()}
    assert got == {(1, 0): ("please remember my name", None), (1, 1): ("noted", "please remember my name"), (2, 0): ("hello out there", None)}
    found = spark.createDataFrame([(1, "first", 1.0, "bm25", 0), (2, "second", 0.5, "graph", 1)], "id long, text string, score double, sources string, rank long")
    assert hooks.pre_process(found, "system").first()["prompt"] == "system\n\n[1] (bm25) first\n[2] (graph) second"
    assert hooks.pre_process(found.limit(0), "system").first()["prompt"] == "system"


def test_commands(spark):
    mem = spark.createDataFrame([(k, f"John Smith wrote license {k}. And more of it.", "en", f"r{k % 2}", 1_700_000_000 + k) for k in range(8)], "id long, content string, wing string, room string, created_at long")
    assert pql.run(mem, "STATUS").collect() == [("en", 8, 2, 1_700_000_007)]
    assert pql.run(mem, "CHECKPOINT").count() == 8
    assert {r["wing"] for r in pql.run(mem, "COMPRESS").collect()} == {"en"}
    assert "John Smith" in pql.run(mem, "REFLECT").first()["context"]
    assert pql.run(mem, "CONSOLIDATE").count() == 0
    assert pql.run(mem, '{"action": "find", "query": "license", "top_k": 2}').count() == 2
    pql.register(spark)
    assert spark.sql("SELECT action, top_k FROM pql_parse('FIND x top_k=4')").collect() == [("find", 4)]
    with pytest.raises(StoreError):
        pql.run(mem, '{"action": "drop"}')
