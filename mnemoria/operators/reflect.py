"""Reflection: the context for a model, and its answer applied to the graph and to the beliefs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import beliefs, graph
from .plugins import LanguageModel, ask, parsed

ANSWER = (
    "insights array<string>, gaps array<string>, cross_scene_links array<string>, disposition map<string,string>, "
    "kg_updates array<struct<action:string,subject:string,type:string,predicate:string,object:string,weight:double>>, "
    "mental_model_updates array<struct<category:string,key:string,value:string,confidence_delta:double>>"
)
#: Beliefs fade by this at each reflection.
DECAY = 0.98
CONTEXT_CHARS, HOT, SCENES, SAMPLES, RELATIONS = 4000, 5, 10, 5, 3


def reflect_context(relations: DataFrame, hot: DataFrame, scenes: DataFrame, samples: DataFrame) -> DataFrame:
    """One row (context): hot entities with their first relations, the newest scenes, some memories.

    relations (subject, predicate, object); hot (name, type, n), of which the HOT largest are taken; scenes
    (name, summary, created_at, updated_at), the SCENES last updated; samples (k, content) in order of k.
    """
    most = hot.orderBy(F.desc("n"), "name").limit(HOT)
    of = Window.partitionBy("name").orderBy("subject", "predicate", "object")
    near = graph.touching(relations, most.select("name")).withColumn("r", F.row_number().over(of)).filter(F.col("r") <= RELATIONS)
    said = F.concat_ws(" ", "subject", "predicate", "object")
    near = near.groupBy("name").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", said.alias("s")))), lambda x: x["s"]), "; ").alias("rel"))
    a = most.join(near, "name").select(F.lit(0).alias("part"), F.struct((-F.col("n")).alias("x"), F.col("name").alias("y")).alias("k"), F.concat(F.lit("实体: "), "name", F.lit(" ("), "type", F.lit(") ["), "rel", F.lit("]")).alias("line"))
    b = scenes.orderBy(F.desc("updated_at"), "name").limit(SCENES)
    b = b.select(F.lit(1).alias("part"), F.struct((-F.col("updated_at")).alias("x"), F.col("name").alias("y")).alias("k"), F.concat(F.lit("场景: "), "name", F.lit(" ("), F.col("created_at").cast("string"), F.lit(") ["), F.substring(F.coalesce("summary", F.lit("")), 1, 200), F.lit("]")).alias("line"))
    c = samples.orderBy("k").limit(SAMPLES)
    c = c.select(F.lit(2).alias("part"), F.struct(F.lit(0).cast("long").alias("x"), F.col("k").cast("string").alias("y")).alias("k"), F.concat(F.lit("记忆: "), F.substring("content", 1, 200)).alias("line"))
    rows = a.union(b).union(c)  # HOT + SCENES + SAMPLES rows at most
    lines = F.transform(F.sort_array(F.collect_list(F.struct("part", "k", "line"))), lambda x: x["line"])
    return rows.agg(F.substring(F.array_join(lines, "\n"), 1, CONTEXT_CHARS).alias("context"))


def reflect(context: DataFrame, model: LanguageModel) -> DataFrame:
    """context (context) -> (answer): the model's answer as a struct; without one all parts are null."""
    return context.select(parsed(ask(model, F.col("context")), ANSWER).alias("answer"))


def reflect_apply(answers: DataFrame, entities: DataFrame, relations: DataFrame, evidence: DataFrame) -> dict[str, DataFrame]:
    """An answer laid over the store: entities (name, type), relations, evidence and beliefs after decay.

    entities (name, type): the first type of a name stays. relations (subject, predicate, object, weight):
    weights of equal relations add up, 1 if none is given; updates without an end or a predicate are left
    out. evidence (category, key, seq, value, delta): updates come after what is there, in their order; the
    beliefs folded from it fade by DECAY. log has the numbers of what was applied.
    """
    kg = answers.select(F.posexplode(F.coalesce("answer.kg_updates", F.expr("array()"))).alias("at", "u")).select("at", "u.*")
    new = kg.filter("action = 'add_entity' and subject is not null").select(F.col("subject").alias("name"), F.coalesce("type", F.lit("unknown")).alias("type"), (F.col("at") + 1).alias("o"))
    every = entities.select("name", "type", F.lit(0).alias("o")).union(new)
    names = every.groupBy("name").agg(F.min_by("type", "o").alias("type"))
    added = kg.filter("action = 'add_relation' and subject is not null and predicate is not null and object is not null")
    rel = graph.relation_accumulate(relations.select("subject", "predicate", "object", "weight").union(added.select("subject", "predicate", "object", F.coalesce("weight", F.lit(1.0)))))
    mm = answers.select(F.posexplode(F.coalesce("answer.mental_model_updates", F.expr("array()"))).alias("at", "u")).select("at", "u.*")
    last = evidence.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("last")).scalar()
    more = mm.select(F.coalesce("category", F.lit("belief")).alias("category"), F.coalesce("key", F.lit("")).alias("key"), (last + F.col("at") + 1).alias("seq"), F.coalesce("value", F.lit("")).alias("value"), F.coalesce("confidence_delta", F.lit(0.1)).alias("delta"))
    proof = evidence.select("category", "key", "seq", "value", "delta").union(more)
    log = kg.agg(F.count_if(F.col("action").isin("add_entity", "add_relation")).alias("kg_updates_applied"), mm.agg(F.count("*")).scalar().alias("mental_model_updates"))
    return {"entities": names, "relations": rel, "evidence": proof, "beliefs": beliefs.belief_decay(beliefs.belief_fold(proof), DECAY), "log": log}


def compress_llm(texts: DataFrame, model: LanguageModel, fallback: DataFrame) -> DataFrame:
    """texts (wing, room, text) -> (wing, room, summary, key_facts, method): a model's summary, or the fallback's.

    fallback (wing, room, summary) is used where the model gives no JSON or an empty summary.
    """
    said = parsed(ask(model, F.substring("text", 1, 4000)), "summary string, key_facts array<string>")
    rows = texts.select("wing", "room", said.alias("a")).join(fallback.withColumnRenamed("summary", "plain"), ["wing", "room"], "left")
    good = F.coalesce("a.summary", F.lit("")) != ""
    return rows.select("wing", "room", F.when(good, F.col("a.summary")).otherwise(F.col("plain")).alias("summary"), F.coalesce(F.when(good, F.col("a.key_facts")), F.expr("cast(array() as array<string>)")).alias("key_facts"), F.when(good, "llm").otherwise("heuristic").alias("method"))

