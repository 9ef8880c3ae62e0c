"""Ingest and annotation operators."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .entities import MOST_ENTITIES, entity_score, extract_entities, has_han

__all__ = ["entity_score", "extract_entities"]

#: Keywords of the fact types (a word listed twice counts twice), in the order of ties.
FACT_TYPES = {
    "observation": ["观察", "发现", "看到", "注意到", "感觉", "觉得", "现象", "情况", "状态", "天气", "今天", "外面", "这里", "那里"],
    "experience": ["做过", "去过", "吃过", "用过", "看过", "听过", "试过", "去过", "完成了", "做了", "经历了", "参加了", "体验了", "之前", "曾经", "以前"],
    "world": ["是", "属于", "位于", "定义", "指", "叫做", "就是", "指代", "概念", "方法", "原理", "规则", "标准", "系统", "机制", "结构", "功能", "分类"],
    "opinion": ["喜欢", "不喜欢", "觉得", "认为", "建议", "想要", "希望", "偏好", "愿意", "倾向", "应该", "最好", "推荐", "更愿意", "推荐", "我建议", "我觉得", "更喜欢", "不太喜欢", "个人认为", "我个人觉得"],
    "causation": ["因为", "所以", "导致", "造成", "引发", "引起", "使得", "促使", "源于", "起因", "结果", "于是", "因此", "由此", "从而", "以致", "触发", "带来", "产生", "诱发", "由于", "因而", "故此", "以至于", "正因为"],
}
BASE_TRUST = {"world": 0.9, "observation": 0.7, "experience": 0.8, "opinion": 0.5, "causation": 0.6}
FIRST_PERSON = ["我是", "我叫", "我的", "我姓", "我住在", "我工作", "我今年", "我来自", "我喜欢", "我住", "我在", "我平时", "我觉得", "我最近", "我每天", "我主要", "我一直", "我一般", "我经常", "我负责", "我养", "我有", "我需要", "我想", "我打算", "我在用", "我用", "我吃", "我去", "我来", "我做过", "我用过", "我吃过", "我去过", "我试过", "我用了", "我做了", "我完成了"]
AUTHORITY_RANK = {"critical": 0, "high": 1, "medium": 2, "low": 3}
TOOL_MARK = r"(?i)<tool_call>|<function_call>|```tool|```function"


def dedup_exact(df: DataFrame, content: str, *order: str) -> DataFrame:
    """The first row of each text by the order; a hot text is pre-aggregated, not sorted."""
    key = F.sha2(F.col(content).cast("binary"), 256)
    first = df.groupBy(key.alias("content_hash")).agg(F.min(F.struct(*order)).alias("o"))
    return first.select("content_hash", "o.*")


def fact_type(c: Column) -> Column:
    """The class with the most keywords, the first of equals; none: observation.

    Every keyword has a Han letter, so texts without one are not searched.
    """
    counts = F.array(*[reduce(lambda a, b: a + b, [F.when(c.contains(w), 1).otherwise(0) for w in ws]) for ws in FACT_TYPES.values()])
    kinds = F.array(*[F.lit(k) for k in FACT_TYPES])
    # the counts are made once, and not for each use
    most = F.get(F.transform(F.array(counts), lambda n: F.get(kinds, (F.array_position(n, F.array_max(n)) - 1).cast("int"))), 0)
    return F.when(has_han(c), most).otherwise("observation")


def first_person(c: Column) -> Column:
    """Whether a text speaks of its author; like all of these phrases, such a text has Han letters."""
    return F.when(has_han(c), reduce(lambda a, b: a | b, [c.contains(p) for p in FIRST_PERSON])).otherwise(False)


def authority(c: Column, kind: Column, n_entities: Column) -> Column:
    return _authority(first_person(c), kind, n_entities)


def _authority(own: Column, kind: Column, n_entities: Column) -> Column:
    return (
        F.when(own, "critical")
        .when(((kind == "world") & (n_entities >= 1)) | (n_entities >= 3) | (kind == "experience"), "high")
        .when((n_entities < 1) & (kind == "opinion"), "low")
        .otherwise("medium")
    )


def trust_score(kind: Column, n_entities: Column, n_chars: Column) -> Column:
    base = F.lit(0.5)
    for k, v in BASE_TRUST.items():
        base = F.when(kind == k, v).otherwise(base)
    bonus = F.when(n_chars.between(50, 500), 0.1).when(n_chars < 20, -0.15).when(n_chars > 2000, -0.05).otherwise(0.0)
    return F.round(F.greatest(F.lit(0.1), F.least(F.lit(1.0), base + F.least(F.lit(0.15), n_entities * 0.03) + bonus)), 2)


def summary_head(c: Column, most: int = 200) -> Column:
    """The first characters, up to the last sentence end beyond the middle."""
    head = F.substring(c, 1, most)
    back = F.reverse(head)
    ends = [F.when(F.instr(back, p) > 0, most - F.instr(back, p) + 1).otherwise(0) for p in ("。", "？", "！", "\n")]
    last = F.greatest(*ends)
    return F.when(F.length(c) <= most, c).when(last - 1 > most // 2, F.substring(head, F.lit(1), last)).otherwise(head)


def annotate(mem: DataFrame) -> DataFrame:
    """memories with scene (first entity or general), n_entities, fact_type, authority, trust_score.

    What a text alone tells is worked out where it is read: before the join, which need not carry it, and
    once, where a filter over the result would repeat it for each of its uses.
    """
    e = extract_entities(mem, "id", "content").groupBy("id").agg(F.least(F.lit(MOST_ENTITIES), F.count("*")).alias("n_entities"), F.min_by("name", "pos").alias("first"))
    c = F.col("content")
    out = mem.withColumns({"fact_type": fact_type(c), "_own": first_person(c), "_chars": F.length(c)}).join(e, "id", "left").withColumn("n_entities", F.coalesce("n_entities", F.lit(0)))
    out = out.withColumn("authority", _authority(F.col("_own"), F.col("fact_type"), F.col("n_entities")))
    return out.withColumn("trust_score", trust_score(F.col("fact_type"), F.col("n_entities"), F.col("_chars"))).withColumn("scene", F.coalesce("first", F.lit("general"))).drop("first", "_own", "_chars")


def registry_count(mentions: DataFrame, threshold: int = 3) -> DataFrame:
    """(name, type, count, state): the last type wins, candidates are confirmed at the threshold."""
    return mentions.groupBy("name").agg(F.max_by("type", F.struct("id", "pos")).alias("type"), F.sum("freq").alias("count")).select("name", "type", "count", F.when(F.col("count") >= threshold, "confirmed").otherwise("candidate").alias("state"))


def clean_llm_response(c: Column) -> Column:
    """Lines from a tool mark to a closing fence are dropped, then the ends are trimmed."""
    start = F.struct(F.lit(False).alias("inside"), F.array().cast("array<string>").alias("kept"))

    def step(acc: Column, line: Column) -> Column:
        opens = line.rlike(TOOL_MARK)
        closes = acc["inside"] & (F.trim(line) == "```")
        inside = F.when(opens, True).when(closes, False).otherwise(acc["inside"])
        keep = ~opens & ~acc["inside"]
        return F.struct(inside.alias("inside"), F.when(keep, F.concat(acc["kept"], F.array(line))).otherwise(acc["kept"]).alias("kept"))

    kept = F.aggregate(F.split(c, "\n"), start, step)["kept"]
    return F.regexp_replace(F.array_join(kept, "\n"), r"^[ \t\n\r]+|[ \t\n\r]+$", "")


def chunk_turns(rows: DataFrame, size: int = 2) -> DataFrame:
    """conversations (conv_id, turn, role, text): consecutive chunks of non-empty turns as text."""
    said = rows.filter(F.trim(F.coalesce("text", F.lit(""))) != "")
    k = F.floor((F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1) / size)
    line = F.concat(F.lit("["), F.col("role"), F.lit("]: "), F.col("text"), F.lit("\n"))
    lines = said.withColumn("chunk", k).withColumn("line", line)
    return lines.groupBy("conv_id", "chunk").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "line"))), lambda x: x["line"]), "").alias("text"), F.count("*").alias("n_turns"))


def retain_every_n(rows: DataFrame, n: int = 2) -> DataFrame:
    """A session's turns so far, each time their number is a multiple of n: (conv_id, emitted, n_chars)."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = rows.select("conv_id", F.count("*").over(w).alias("emitted"), F.sum(F.length("text")).over(w).alias("n_chars"))
    return out.filter(F.col("emitted") % n == 0)


def scene_summary(rows: DataFrame, most: int = 5000) -> DataFrame:
    """(scene, id, summary) -> (scene, summary): texts appended in order unless already contained.

    Equal texts count once, by their first id. A scene's texts then stream by in order and only its summary is
    held; once it is full, no text is looked at. A null text adds nothing.
    """
    kind = rows.schema["scene"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, text, out, kept = None, None, [], pa.string()

        def made() -> pa.RecordBatch:
            ready = pa.RecordBatch.from_arrays([pa.array([s for s, _ in out], kept), pa.array([t for _, t in out], pa.string())], ["scene", "summary"])
            out.clear()
            return ready

        for batch in batches:
            kept = batch.schema.field(0).type
            for scene, summary in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if text is None or scene != at:
                    if text is not None:
                        out.append((at, text))
                    at, text = scene, ""
                if summary and len(text) < most and summary not in text:
                    text = (f"{text}\n{summary}" if text else summary)[:most]
            yield made()
        if text is not None:
            out.append((at, text))
            yield made()

    once = rows.groupBy("scene", "summary").agg(F.min("id").alias("id"))
    ordered = once.repartition("scene").sortWithinPartitions("scene", "id", "summary").select("scene", "summary")
    return ordered.mapInArrow(run, f"scene {kind}, summary string")
