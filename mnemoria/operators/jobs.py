"""Batch jobs: compression, extractive summaries, personas, audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import CJK, entity_density, sentences, stability_signal, summary_tokens
from . import blocks
from .search import small

#: Topics by pattern, in this order.
TOPICS = [
    ("中医|中药|针灸|脉诊|方剂|体质", "中医"), ("编程|代码|Python|开发|架构|算法", "编程"), ("投资|股票|基金|理财|A股|市场", "投资"), ("林草|林业|草原|生态|碳汇|GEF", "林草"),
    ("玄学|八字|紫微|六爻|奇门|风水", "玄学"), ("AI|人工智能|大模型|Agent|LLM|模型", "AI"), ("健身|运动|跑步|训练|营养", "健身"), ("阅读|读书|书|文章|论文", "阅读"),
]


def compress_select(mem: DataFrame, now: int, days: int = 7, least: int = 3, limit: int | None = None) -> DataFrame:
    """Old rows of (wing, room) groups of at least `least`; the limit takes the first in order, if given."""
    old = mem.filter(F.col("created_at") < now - days * 86400)
    if limit is not None:
        old = old.orderBy("wing", "room", "created_at", "id").limit(limit)
    big = old.groupBy("wing", "room").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    return old.join(big, (old.wing.eqNullSafe(big.wing)) & (old.room.eqNullSafe(big.room))).select(old["*"], "n")


#: Terms whose weights go to every task; rarer ones are joined.
MOST_TERMS = 500_000


def summarize(rows: DataFrame, by: list[str], shortest: int, weights: tuple[float, float, float], signal: Column, top: int, most: int, block_rows: int = blocks.BLOCK_ROWS, most_terms: int = MOST_TERMS) -> DataFrame:
    """Extractive summary of rows (by..., id, content): (by..., summary, n_sent, signal of the best five).

    Sentences are scored by smoothed tf-idf within the group, place and a signal; the best ones are
    joined in their order and cut. Ids are unique in a group. Texts and words are read where they are: numbers
    of sentences, counts of terms and scores are what tasks exchange, and of terms beyond the most_terms
    most frequent the words themselves. The counts and the best sentences' places are computed at once.
    """
    cut = F.filter(sentences(F.col("content")), lambda s: F.length(s) >= shortest)
    # filters that the planner finds would cut the texts again, so it gets none to move: outer explodes, filters after them
    per = rows.select(*by, "id", F.size(cut).alias("m")).localCheckpoint().filter("m > 0")
    # the number of a sentence in its group: rows of the group before it, then its place in the row
    before = blocks.running_sum(per, by, "id", F.col("m"), "before", blocks.quantiles(per, "id", block_rows)).drop("m")
    total = per.groupBy(*by).agg(F.sum("m").alias("n"))
    s = rows.select(*by, "id", F.posexplode_outer(cut).alias("k", "s")).filter("s is not null")
    tokens = summary_tokens(F.col("s"))
    terms = s.select(*by, F.explode_outer(F.array_distinct(tokens)).alias("term")).filter("term is not null").groupBy(*by, "term").agg(F.count("*").alias("df")).localCheckpoint()
    idf = terms.join(total, by).select(*by, "term", "df", (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1).alias("idf"))
    n_terms = terms.count()
    least = 0 if n_terms <= most_terms else terms.approxQuantile("df", [1 - most_terms / n_terms], 1e-4)[0]
    often = F.broadcast(idf.filter(F.col("df") > least).drop("df"))
    # in two steps: beside explode the signal would be worked out for each word
    tok = s.select(*by, "id", "k", signal.alias("signal"), tokens.alias("terms")).select(*by, "id", "k", "signal", F.explode_outer("terms").alias("term")).filter("term is not null")
    sentence = [*by, "id", "k"]
    known = [F.sum("idf").alias("weight"), F.count("*").alias("tokens"), F.max("signal").alias("signal")]
    each = tok.join(often, [*by, "term"]).groupBy(*sentence).agg(*known)
    if least:
        rare = tok.join(often, [*by, "term"], "left_anti").join(idf.filter(F.col("df") <= least), [*by, "term"]).groupBy(*sentence).agg(*known)
        each = each.union(rare).groupBy(*sentence).agg(F.sum("weight").alias("weight"), F.sum("tokens").alias("tokens"), F.max("signal").alias("signal"))
    a, b, c = weights
    full = each.join(before, [*by, "id"]).join(total, by).withColumn("i", F.col("before") + F.col("k"))
    full = full.withColumn("score", F.round(a * F.col("weight") / F.col("tokens") + b * (1 - 0.3 * F.col("i") / F.col("n")) + c * F.col("signal"), 9))
    w = Window.partitionBy(*by).orderBy(F.desc("score"), "i")
    best = full.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= top).select(*sentence, "i", "n", "r", "signal").localCheckpoint()
    said = rows.join(small(best), [*by, "id"]).select(*by, "i", "n", "r", "signal", F.get(cut, F.col("k")).alias("s"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "s"))), lambda x: x["s"]), "；")
    out = said.groupBy(*by).agg(joined.alias("j"), F.max("n").alias("n_sent"), F.avg(F.when(F.col("r") <= 5, F.col("signal"))).alias("signal"))
    return out.select(*by, F.when(F.length("j") > most, F.concat(F.substring("j", 1, most - 3), F.lit("..."))).otherwise(F.col("j")).alias("summary"), "n_sent", F.round("signal", 6).alias("signal"))


def extractive_summary(rows: DataFrame, by: list[str]) -> DataFrame:
    return summarize(rows, by, 5, (0.5, 0.2, 0.3), entity_density(F.col("s")), 10, 300).drop("signal")


def persona_topic(c: Column) -> Column:
    out = F.coalesce(F.nullif(F.substring(F.regexp_extract(c, "([一-鿿]{4,})", 1), 1, 10), F.lit("")), F.lit("general"))
    every = [p for pattern, _ in TOPICS for p in pattern.split("|")]
    for pattern, topic in reversed(TOPICS):
        out = F.when(c.rlike(pattern), topic).otherwise(out)
    # one scan for Han letters and the Latin names tells whether any topic needs to be tried
    return F.when(c.rlike("|".join([CJK, *(p for p in every if p.isascii())])) | c.isNull(), out).otherwise("general")


def persona_distill(rows: DataFrame) -> DataFrame:
    """rows (topic, id, content) -> (topic, summary, n_sent, n, confidence)."""
    out = summarize(rows, ["topic"], 8, (0.4, 0.2, 0.4), stability_signal(F.col("s")), 5, 200)
    n = rows.groupBy("topic").agg(F.count("*").alias("n"))
    level = F.when((F.col("n") >= 5) & (F.col("signal") > 0.5), "high").when((F.col("n") >= 3) & (F.col("signal") > 0.3), "medium").otherwise("low")
    return out.join(n, "topic").select("topic", "summary", "n_sent", "n", level.alias("confidence"))


def persona_get(personas: DataFrame, levels: list[str]) -> DataFrame:
    """Personas (topic, confidence, evidence) of some levels, by the text of the level, then by evidence."""
    w = Window.orderBy(F.desc("confidence"), F.desc("evidence"), "topic")  # one row for each topic
    rows = personas.filter(F.col("confidence").isin(levels))
    return rows.select("topic", "confidence", "evidence", (F.row_number().over(w) - 1).cast("long").alias("rank"))


#: Hours between runs; reflection runs each day at REFLECT_AT in ZONE.
EVERY_HOURS = {"consolidate": 4, "compress": 24, "persona": 24, "expire": 6}
ZONE, REFLECT_AT = "Asia/Shanghai", 2


def next_runs(rows: DataFrame) -> DataFrame:
    """rows (now, ...) -> their columns, job and next_run: times are epoch seconds."""
    local = F.convert_timezone(F.lit("UTC"), F.lit(ZONE), F.convert_timezone(None, F.lit("UTC"), F.timestamp_seconds("now").cast("timestamp_ntz")))
    early = F.expr(f"interval {REFLECT_AT} hours")
    next_day = F.date_add(F.to_date(local - early), 1).cast("timestamp_ntz") + early
    two = F.convert_timezone(F.lit(ZONE), F.lit("UTC"), next_day)
    epoch = F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), two)
    hours = F.lit(0)
    for job, h in EVERY_HOURS.items():
        hours = F.when(F.col("job") == job, h).otherwise(hours)
    every = rows.select("*", F.explode(F.array(*[F.lit(j) for j in ("reflect", *EVERY_HOURS)])).alias("job"))
    return every.withColumn("next_run", F.when(F.col("job") == "reflect", epoch).otherwise(F.col("now") + hours * 3600))


#: Points of a layer, and the total from which an audit passes.
LAYER_POINTS, PASS_FROM = 20, 90


def audit(vectors: DataFrame, annotated: DataFrame, entities: DataFrame) -> DataFrame:
    """(layer, score, most, finding): five layers, then the total with its verdict.

    The graph's layer has 15 points at most: 10 if there are entities, 5 less 5 for each name of several types.
    """
    names = entities.groupBy(F.lower("name").alias("n")).agg(F.count_distinct("type").alias("t"))
    clashes = names.agg(F.count_if(F.col("t") > 1).alias("clashes"), F.count("*").alias("names"))
    a = annotated.agg(F.count("*").alias("n"), F.count_distinct("wing").alias("wings"), F.avg(F.when(F.col("n_entities") > 0, 1.0).otherwise(0.0)).alias("cover"))
    one = a.select("*", vectors.agg(F.count("*")).scalar().alias("v"), clashes.select(F.struct("names", "clashes")).scalar().alias("g"))
    ratio = F.when(F.col("n") > 0, F.col("v") / F.col("n")).otherwise(0.0)
    layers = {
        "table": F.when(F.col("n") > 0, 20).otherwise(0),
        "vectors": 12 + F.when(ratio >= 0.99, 8).when(ratio >= 0.8, 5).otherwise(0),
        "kg": F.when(F.col("g.names") > 0, 10).otherwise(0) + F.greatest(F.lit(0), 5 - 5 * F.col("g.clashes")),
        "scenes": 10 + F.when(F.col("wings") > 1, 10).otherwise(0),
        "l1": F.floor(20 * F.coalesce("cover", F.lit(0.0))),
    }
    rows = one.select(F.inline(F.array(*[F.struct(F.lit(k).alias("layer"), x.cast("long").alias("score")) for k, x in layers.items()])))
    finding = F.when(F.col("score") < LAYER_POINTS, F.concat("layer", F.lit(": "), F.col("score").cast("string"), F.lit(f" of {LAYER_POINTS}"))).otherwise("")
    total = F.sum("score").alias("score")
    verdict = rows.agg(total).select(F.lit("total").alias("layer"), "score", F.lit(len(layers) * LAYER_POINTS).cast("long").alias("most"), F.when(F.col("score") >= PASS_FROM, "pass").otherwise("fail").alias("finding"))
    return rows.select("layer", "score", F.lit(LAYER_POINTS).cast("long").alias("most"), finding.alias("finding")).union(verdict)
