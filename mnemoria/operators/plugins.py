"""Seams for models, and registries of rerankers, pipeline stages and tools.

A model is a function; what it must do is said at each seam. Rows go to it in Arrow batches.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import StoreError
from ..functions.text import path_escape, repair_mojibake, repair_nul
from . import fusion, ingest
from .search import ranked

#: call(prompt, response_format) -> text of an answer, or None.
LanguageModel = Callable[[str, dict], "str | None"]
JSON_OBJECT = {"type": "json_object"}


def ask(model: LanguageModel, prompt: Column, tries: int = 3) -> Column:
    """The model's answer to each prompt; null after `tries` failures."""

    @F.pandas_udf("string")
    def answer(prompts: pd.Series) -> pd.Series:
        def one(text: str) -> str | None:
            for _ in range(tries):
                try:
                    return model(text, JSON_OBJECT)
                except Exception:  # noqa: BLE001  a model may fail in any way; the caller sees a null
                    continue
            return None

        return prompts.map(one)

    return answer(prompt)


def parsed(answer: Column, schema: str) -> Column:
    """A JSON answer without its fences as a struct; broken JSON has null fields."""
    return F.from_json(F.regexp_replace(F.trim(answer), r"^```[a-z]*\n|\n```$", ""), schema)


# --- extraction

EXTRACTED = (
    "entities array<struct<name:string,type:string>>, relations array<struct<subject:string,predicate:string,object:string>>, "
    "summary string, time_range struct<start:string,end:string>, fact_type string, confidence double, authority string, trust_score double"
)
#: What a model is asked for.
EXTRACT = (
    "Extract from the messages below and answer in JSON: entities (name, type: person, org, location or product), relations (subject, predicate, object), "
    "time_range (start, end), summary (150 characters at most), fact_type (observation, experience, world, opinion or causation), confidence (0 to 1).\n"
)


def llm_extract(mem: DataFrame, model: LanguageModel) -> DataFrame:
    """(id, n_entities, summary, fact_type, confidence, authority, trust_score, entities, relations, time_range, made_by).

    made_by is `model`, or `rules` for a row whose answer fails or is no JSON object: it takes its annotations from
    the rules, and only such rows are extracted by rules. What an answer leaves out gets its default, an
    empty summary the head of the text. A null text is asked as an empty one.
    """
    text = F.coalesce("content", F.lit(""))
    asked = mem.select("id", text.alias("content")).withColumn("answer", ask(model, F.concat(F.lit(EXTRACT), F.to_json(F.array(text)))))
    plain = F.trim(F.regexp_replace(F.trim("answer"), r"^```[^\n]*\n|```$", ""))
    asked = asked.withColumn("said", F.when(F.json_object_keys(plain).isNotNull(), F.from_json(plain, EXTRACTED)))
    head = ingest.summary_head(F.col("content"))
    kind = F.coalesce("said.fact_type", F.lit("observation"))
    n = F.coalesce(F.size("said.entities"), F.lit(0))
    none = lambda name: F.coalesce(f"said.{name}", F.array().cast(dict(asked.select("said.*").dtypes)[name])).alias(name)
    rest = [none("entities"), none("relations"), F.col("said.time_range").alias("time_range")]
    answered = asked.filter("said is not null").select(
        "id", n.cast("long").alias("n_entities"), F.coalesce(F.nullif("said.summary", F.lit("")), head).alias("summary"), kind.alias("fact_type"), F.coalesce("said.confidence", F.lit(0.7)).alias("confidence"),
        F.coalesce("said.authority", ingest.authority(F.col("content"), kind, n)).alias("authority"), F.coalesce("said.trust_score", ingest.trust_score(kind, n, F.length("content"))).alias("trust_score"), *rest, F.lit("model").alias("made_by"),
    )
    ruled = ingest.annotate(asked.filter("said is null")).select(
        "id", F.col("n_entities").cast("long").alias("n_entities"), head.alias("summary"), "fact_type", F.lit(None).cast("double").alias("confidence"), "authority", "trust_score", *rest, F.lit("rules").alias("made_by"),
    )
    return answered.unionByName(ruled)


# --- rerankers: (candidates (id, text, rrf_score, n_sources), query) -> (id, score)

Reranker = Callable[[DataFrame, str], DataFrame]
RERANKERS: dict[str, Reranker] = {}
#: Letters of a text that a cross-encoder sees.
ENCODER_CHARS = 512


def cross_encoder(logits: Callable[[str, list[str]], list[float]]) -> Reranker:
    """A reranker from a model that gives a logit for each (query, text); the score is its sigmoid."""

    def rerank(candidates: DataFrame, query: str) -> DataFrame:
        @F.pandas_udf("double")
        def score(texts: pd.Series) -> pd.Series:
            return pd.Series([1 / (1 + math.exp(-x)) for x in logits(query, texts.fillna("").tolist())], dtype="float64")

        return candidates.select("id", F.round(score(F.substring("text", 1, ENCODER_CHARS)), 6).alias("score"))

    return rerank


def llm_reranker(model: LanguageModel) -> Reranker:
    """A reranker that asks a model for a number from 0 to 1; the fused score where it gives none."""

    def rerank(candidates: DataFrame, query: str) -> DataFrame:
        prompt = F.concat(F.lit(f"query: {query}\ntext: "), F.substring("text", 1, 1000))
        score = parsed(ask(model, prompt), "score double")["score"]
        bounded = F.when(score.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))  # both skip nulls
        return candidates.select("id", F.coalesce(bounded, "rrf_score").alias("score"))

    return rerank


def _heuristic(candidates: DataFrame, query: str) -> DataFrame:
    return fusion.rerank_heuristic(candidates, query).select("id", "score")


RERANKERS["heuristic"] = _heuristic


def rerank_by(reranker: Reranker, candidates: DataFrame, query: str, k: int = 10) -> DataFrame:
    """(id, text, score, rrf_score, rank): the k best by a reranker's scores."""
    scored = reranker(candidates, query)
    return ranked(scored.join(candidates.select("id", "text", "rrf_score"), "id"), k, F.desc("score"), F.asc("id"))


def rerank(candidates: DataFrame, query: str, strategy: str = "heuristic", k: int = 10) -> DataFrame:
    """rerank_by with a registered strategy; one that is not registered falls back on heuristic."""
    return rerank_by(RERANKERS.get(strategy, RERANKERS["heuristic"]), candidates, query, k)


# --- stages of ingest: DataFrame -> DataFrame, in the order they were registered

Stage = Callable[[DataFrame], DataFrame]


def repair_document(c: Column) -> Column:
    """NUL characters first, then mojibake."""
    return repair_mojibake(repair_nul(c))


class Stages:
    """Named stages over memories (id, content, ...); `default()` has those of ingest."""

    def __init__(self) -> None:
        self.stages: dict[str, Stage] = {}

    def register(self, name: str, stage: Stage, after: str | None = None) -> Stages:
        if after is not None and after not in self.stages:
            raise StoreError("PIPELINE_STAGE_NOT_FOUND", after)
        names = [n for n in self.stages if n != name]
        at = names.index(after) + 1 if after else len(names)
        names.insert(at, name)
        self.stages = {n: stage if n == name else self.stages[n] for n in names}
        return self

    def remove(self, name: str) -> Stages:
        if name not in self.stages:
            raise StoreError("PIPELINE_STAGE_NOT_FOUND", name)
        del self.stages[name]
        return self

    def run(self, rows: DataFrame, only: list[str] | None = None) -> DataFrame:
        for name in only if only is not None else list(self.stages):
            if name not in self.stages:
                raise StoreError("PIPELINE_STAGE_NOT_FOUND", name)
            rows = self.stages[name](rows)
        return rows

    @classmethod
    def default(cls) -> Stages:
        def hashed(rows: DataFrame) -> DataFrame:
            return rows.withColumn("content_hash", F.sha2(F.col("content").cast("binary"), 256))

        def first(rows: DataFrame) -> DataFrame:
            one = rows.groupBy("content_hash").agg(F.min("id").alias("id"))
            return rows.join(one, ["content_hash", "id"], "left_semi").select(*rows.columns)

        out = cls()
        out.register("repair", lambda rows: rows.withColumn("content", repair_document(F.col("content"))))
        out.register("hash", hashed).register("dedup", first).register("annotate", ingest.annotate)
        return out.register("path", lambda rows: rows.withColumn("path", F.concat_ws("/", path_escape(F.col("wing")), path_escape(F.col("room")))))


# --- tools: named functions with a level that a front end may check

LEVELS = ("public", "readonly", "user", "system")


class Tools:
    def __init__(self) -> None:
        self.tools: dict[str, tuple[Callable[..., DataFrame], str]] = {}

    def register(self, name: str, tool: Callable[..., DataFrame], level: str = "user") -> Tools:
        if level not in LEVELS:
            raise StoreError("VALIDATION_INVALID_PARAM", level)
        self.tools[name] = tool, level
        return self

    def names(self, level: str = "system") -> list[str]:
        """Tools that a caller of this level may use."""
        return sorted(n for n, (_, own) in self.tools.items() if LEVELS.index(own) <= LEVELS.index(level))

    def call(self, name: str, *args, level: str = "system", **params) -> DataFrame:
        if name not in self.tools:
            raise StoreError("VALIDATION_INVALID_PARAM", f"no tool {name}")
        tool, own = self.tools[name]
        if LEVELS.index(own) > LEVELS.index(level):
            raise StoreError("AUTH_INSUFFICIENT", f"{name} needs {own}")
        return tool(*args, **params)
