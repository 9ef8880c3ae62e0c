"""Knowledge-graph operators over relations (subject, predicate, object, weight)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import GARBAGE
from ..functions.text import words
from . import setjoin

#: Predicates that say little, and those of causes.
WEAK = ["co_occurs_with", "related_to"]
CAUSAL = ["cause", "effect", "prevent", "enable"]
TYPE_WEIGHT = {"causal": 0.9, "semantic_knn": 0.7, "cooccurrence": 0.5}


def undirected(rel: DataFrame) -> DataFrame:
    """Each relation from both ends: (entity, other, predicate); two equi-joins instead of one OR."""
    return rel.select(F.col("subject").alias("entity"), F.col("object").alias("other"), "predicate").union(rel.select(F.col("object").alias("entity"), F.col("subject").alias("other"), "predicate"))


def touching(rel: DataFrame, names: DataFrame) -> DataFrame:
    """The relations of each name (name), from either end: the name, then the relation's columns."""
    first = rel.join(names, F.col("subject") == F.col("name")).select("name", *rel.columns)
    other = rel.filter("not subject <=> object").join(names, F.col("object") == F.col("name")).select("name", *rel.columns)
    return first.union(other)


def entity_get(entities: DataFrame, names: DataFrame) -> DataFrame:
    """The entities (name, ...) of the names (name); names that are unknown give nothing."""
    return entities.join(names.select("name").distinct(), "name", "left_semi")


def entity_delete(entities: DataFrame, rel: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities and relations without the names and without the relations that touch them."""
    gone = names.select("name").distinct()
    left = rel.join(gone, F.col("subject") == F.col("name"), "left_anti")
    return entities.join(gone, "name", "left_anti"), left.join(gone, F.col("object") == F.col("name"), "left_anti")


def relation_delete_pair(rel: DataFrame, pairs: DataFrame) -> DataFrame:
    """Relations without those from s to o of the pairs (s, o), whatever their predicate."""
    p = pairs.select(F.col("s").alias("subject"), F.col("o").alias("object")).distinct()
    return rel.join(p, ["subject", "object"], "left_anti").select(*rel.columns)


def is_noise(name: Column, garbage: list[str] = GARBAGE) -> Column:
    """Whether a name is no entity: listed, short, a number with letters, a setting, a count, or three plain words at most."""
    number = F.regexp_replace(name, "[.:]", "").rlike(r"^\p{Nd}+$")
    return (
        name.isin(garbage)
        | (F.length(name) < 2)
        | (name.rlike(r"^\p{Nd}") & ~number)
        | name.rlike("[=:条个种位]")
        | (name.rlike(r"^[\p{L}\p{N}_\s\-.+()\[\]/]+$") & (F.size(words(name)) <= 3))
    )


def noisy_entities(entities: DataFrame, keep: DataFrame, garbage: list[str] = GARBAGE) -> DataFrame:
    """The names (name) of entities that are noise and are not in keep (name); a null name is none."""
    return entities.filter(is_noise(F.col("name"), garbage)).select("name").distinct().join(keep, "name", "left_anti")


def merge_types(mentions: DataFrame) -> DataFrame:
    """mentions (name, type) -> (name, type, n_types): the most frequent type, the last by name of equals."""
    c = mentions.groupBy("name", "type").agg(F.count("*").alias("n"))
    return c.groupBy("name").agg(F.max_by("type", F.struct("n", "type")).alias("type"), F.count("*").alias("n_types"))


def symbols(entities: DataFrame, rel: DataFrame) -> DataFrame:
    """(file, name, type, n_callers, n_callees) from `contains` and `calls` relations of code symbols (name, type)."""
    calls = rel.filter("predicate = 'calls'")
    out = calls.groupBy(F.col("subject").alias("name")).agg(F.count("*").alias("n_callees"))
    into = calls.groupBy(F.col("object").alias("name")).agg(F.count("*").alias("n_callers"))
    inside = rel.filter("predicate = 'contains'").select(F.col("subject").alias("file"), F.col("object").alias("name"))
    rows = inside.join(entities, "name").join(into, "name", "left").join(out, "name", "left")
    return rows.select("file", "name", "type", F.coalesce("n_callers", F.lit(0)).alias("n_callers"), F.coalesce("n_callees", F.lit(0)).alias("n_callees"))


def neighbors(rel: DataFrame) -> DataFrame:
    return undirected(rel).filter("entity <> other").distinct()


def relation_accumulate(rows: DataFrame) -> DataFrame:
    return rows.groupBy("subject", "predicate", "object").agg(F.sum("weight").alias("weight"))


def _sets(rel: DataFrame) -> DataFrame:
    return undirected(rel).select("entity", F.col("other").alias("mid"))


def similar_entities(rel: DataFrame, k: int = 5) -> DataFrame:
    """(entity, other, jaccard, rank) by the Jaccard index of neighbour sets, from shared neighbours."""
    return setjoin.top_jaccard(_sets(rel), k)


def graph_expand(rel: DataFrame, seeds: DataFrame, k: int = 5) -> DataFrame:
    """(seed, node, score, type) from seeds (seed): neighbours .8; causes two steps on .6 * 1/2 * .7; similar .6 * sim.

    A node keeps its best kind (neighbour, cause, similar), then its best score.
    """
    e = undirected(rel)
    near = seeds.join(e, seeds.seed == e.entity).select("seed", F.col("other").alias("node"), F.lit(0.8).alias("score"), F.lit("cooccurrence").alias("type"), F.lit(0).alias("p"))
    cause = undirected(rel.filter(F.col("predicate").isin(CAUSAL)))
    step = seeds.join(cause, seeds.seed == cause.entity).select("seed", F.col("other").alias("mid")).distinct()
    two = step.join(e, step.mid == e.entity).select("seed", F.col("other").alias("node"), F.lit(0.6 * 0.5 * 0.7).alias("score"), F.lit("causal").alias("type"), F.lit(1).alias("p"))
    sim = similar_entities(rel, k)
    like = seeds.join(sim, seeds.seed == sim.entity).select("seed", F.col("other").alias("node"), (F.col("jaccard") * 0.6).alias("score"), F.lit("semantic_knn").alias("type"), F.lit(2).alias("p"))
    every = near.union(two).union(like).filter("node <> seed")
    best = every.groupBy("seed", "node").agg(F.min(F.struct("p", (-F.col("score")).alias("neg"), "type")).alias("b"))
    return best.select("seed", "node", F.round(-F.col("b.neg"), 6).alias("score"), "b.type")


def consolidate_link(rel: DataFrame, least: int = 2) -> DataFrame:
    """Unordered pairs that are not adjacent but share at least two neighbours: (a, b, n_common)."""
    adjacent = undirected(rel).select(F.col("entity").alias("a"), F.col("other").alias("b")).distinct()
    return setjoin.common_pairs(_sets(rel), least).join(adjacent, ["a", "b"], "left_anti")


def redirect(rel: DataFrame, mapping: DataFrame) -> DataFrame:
    """Both endpoints through mapping (old, new); self-loops that arise go; weights add up."""
    m1, m2 = mapping.select(F.col("old").alias("subject"), F.col("new").alias("s")), mapping.select(F.col("old").alias("object"), F.col("new").alias("o"))
    moved = rel.join(m1, "subject", "left").join(m2, "object", "left").select(F.coalesce("s", "subject").alias("subject"), "predicate", F.coalesce("o", "object").alias("object"), "weight")
    return relation_accumulate(moved.filter("subject <> object"))


def name_pairs(names: DataFrame, low: float, high: float | None = None) -> DataFrame:
    """Pairs a < b of names (name) whose bigram Jaccard index is in [low, high): (a, b, sim).

    Candidates share a bigram among the rarest of each name: with similarity t, two sets must meet in
    the first |set| - ceil(t |set|) + 1 bigrams of one common order (here by ascending frequency).
    """
    from ..functions.text import bigram_set, set_jaccard

    n = names.select("name", bigram_set(F.col("name")).alias("g"))
    freq = n.select(F.explode("g").alias("gram")).groupBy("gram").agg(F.count("*").alias("freq"))
    w = Window.partitionBy("name").orderBy("freq", "gram")
    size = F.count("*").over(Window.partitionBy("name"))
    rows = n.select("name", F.explode("g").alias("gram")).join(freq, "gram").withColumn("r", F.row_number().over(w)).withColumn("n", size)
    prefix = rows.filter(F.col("r") <= F.col("n") - F.ceil(F.col("n") * low - 1e-9) + 1).select("name", "gram", "n")
    a, b = prefix.toDF("a", "gram", "na"), prefix.toDF("b", "gram", "nb")
    cand = a.join(b, "gram").filter("a < b").filter((F.least("na", "nb") >= low * F.greatest("na", "nb") - 1e-9)).select("a", "b").distinct()
    sets = n.select("name", "g")
    out = cand.join(sets.toDF("a", "ga"), "a").join(sets.toDF("b", "gb"), "b").select("a", "b", F.round(set_jaccard(F.col("ga"), F.col("gb")), 6).alias("sim")).filter(F.col("sim") >= low)
    return out if high is None else out.filter(F.col("sim") < high)
