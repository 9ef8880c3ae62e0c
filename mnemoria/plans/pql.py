"""The small query language: FIND text [in wing[/room]] [top_k=N], ADD text [TO wing/room], and jobs.

REFLECT gives the context of a reflection, CONSOLIDATE the pairs of entity names to merge, COMPRESS the
extractive summaries of old groups, STATUS the counts of each wing, CHECKPOINT the rows written to a store.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import StoreError
from ..operators import graph, ingest, jobs
from ..operators.search import search_bm25
from ..sources.store import Store, scratch
from ..sources.tables import NOW

JOBS = ("REFLECT", "CONSOLIDATE", "COMPRESS", "STATUS", "CHECKPOINT")


def parse(text: str) -> dict:
    """The action and its arguments; JSON objects pass through. Unknown text is an error."""
    text = text.strip()
    if text.startswith("{"):
        return json.loads(text)
    word, _, rest = text.partition(" ")
    word = word.upper()
    if word in JOBS:
        return {"action": word.lower()}
    if word == "FIND":
        out = {"action": "find", "top_k": 10, "scope": None}
        if m := re.search(r"\s*\btop_k=(\d+)", rest):
            out["top_k"], rest = int(m[1]), rest[: m.start()] + rest[m.end() :]
        if m := re.search(r"\s+in\s+(\S+)$", rest):
            out["scope"], rest = m[1], rest[: m.start()]
        return out | {"query": rest.strip()}
    if word == "ADD":
        content, _, place = rest.rpartition(" TO ")
        wing, _, room = place.partition("/") if content else ("default", "", "general")
        return {"action": "add", "content": content or rest, "wing": wing or "default", "room": room or "general"}
    raise StoreError("VALIDATION_INVALID_PARAM", f"unknown command: {word}")


def _find(mem: DataFrame, cmd: dict) -> DataFrame:
    where = None
    if cmd.get("scope"):
        parts = zip(("wing", "room"), cmd["scope"].split("/"), strict=False)
        where = reduce(lambda a, b: a & b, [F.col(c) == v for c, v in parts])
    return search_bm25(mem, cmd["query"].split(), cmd.get("top_k", 10), where).select("id", "rank", "bm25")


def _add(mem: DataFrame, cmd: dict) -> DataFrame:
    last = mem.agg(F.coalesce(F.max("id"), F.lit(-1)).alias("m"), F.coalesce(F.max("created_at"), F.lit(0)).alias("t"))
    row = last.select((F.col("m") + 1).alias("id"), F.lit(cmd["content"]).alias("content"), F.lit(cmd["wing"]).alias("wing"), F.lit(cmd["room"]).alias("room"), (F.col("t") + 1).alias("created_at"))
    return mem.unionByName(row)


def _reflect(mem: DataFrame, cmd: dict) -> DataFrame:
    from ..operators.reflect import reflect_context

    e = ingest.extract_entities(mem, "id", "content")
    hot = e.groupBy("name").agg(F.max("type").alias("type"), F.sum("freq").alias("n")).filter("n >= 2")
    rel = e.join(mem.select("id", "room"), "id").select(F.col("name").alias("subject"), F.lit("related_to").alias("predicate"), F.col("room").alias("object")).distinct()
    scenes = mem.groupBy(F.col("room").alias("name")).agg(F.min_by(F.substring("content", 1, 200), "id").alias("summary"), F.min("created_at").alias("created_at"), F.max("created_at").alias("updated_at"))
    return reflect_context(rel, hot, scenes.filter("name is not null"), mem.select(F.md5(F.col("id").cast("string").cast("binary")).alias("k"), "content"))


def _consolidate(mem: DataFrame, cmd: dict) -> DataFrame:
    return graph.name_pairs(ingest.extract_entities(mem, "id", "content").select("name").distinct(), 0.85)


def _compress(mem: DataFrame, cmd: dict) -> DataFrame:
    old = jobs.compress_select(mem, cmd.get("now", NOW))
    return jobs.extractive_summary(old.select("wing", "room", "id", "content"), ["wing", "room"])


def _status(mem: DataFrame, cmd: dict) -> DataFrame:
    return mem.groupBy("wing").agg(F.count("*").alias("n"), F.count_distinct("room").alias("rooms"), F.max("created_at").alias("last"))


def _checkpoint(mem: DataFrame, cmd: dict, store: Store | None = None) -> DataFrame:
    store = store or scratch(mem.sparkSession)
    store.upsert("memories", mem)
    return store.read("memories")


COMMANDS: dict[str, Callable[[DataFrame, dict], DataFrame]] = {"find": _find, "add": _add, "reflect": _reflect, "consolidate": _consolidate, "compress": _compress, "status": _status, "checkpoint": _checkpoint}


def run(mem: DataFrame, text: str) -> DataFrame:
    """The result of a command over memories (id, content, wing, room, created_at)."""
    cmd = parse(text)
    if cmd.get("action") not in COMMANDS:
        raise StoreError("VALIDATION_INVALID_PARAM", f"unknown action: {cmd.get('action')}")
    return COMMANDS[cmd["action"]](mem, cmd)


def register(spark: SparkSession) -> None:
    """The SQL table function pql_parse(text): (action, query, scope, top_k), for commands kept in tables."""
    from pyspark.sql.functions import udtf

    @udtf(returnType="action string, query string, scope string, top_k int")
    class PqlParse:
        def eval(self, text: str):
            cmd = parse(text)
            yield cmd["action"], cmd.get("query", cmd.get("content")), cmd.get("scope"), cmd.get("top_k")

    spark.udtf.register("pql_parse", PqlParse)
