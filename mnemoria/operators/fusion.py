"""Fusion of channels, classification of queries, reranking and budgets.

Channel rows are (channel, id, text, score, rank); all order is by (score desc, id).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import CJK, cjk_chars, words
from .search import ranked

#: Channel weights, the constant of reciprocal ranks, and the patterns of query classes.
WEIGHTS = {"semantic": 1.0, "bm25": 1.0, "graph": 0.8, "temporal": 0.6}
RRF_K = 30
TEMPORAL = "(?i)上周|上个月|昨天|前天|今天|明天|下周|最近|刚才|之前|以前|去年|前年|今年|明年|[0-9]{4}年|[0-9]{1,2}月|[0-9]{1,2}日|last[ \\t\\n]+week|yesterday|tomorrow|today|ago|recent"
QUESTION = "(?i)为什么|怎么|如何|什么是|是什么|请问|能不能|可以吗|是不是|对不对|why|how|what|when|where|who|can you|is it|are there"
ENTITY = "[一-鿿]{2,4}(先生|女士|博士|教授|医生|老师)|[A-Z][a-z]+[ \\t\\n]+[A-Z][a-z]+"


def default_weight(channel: Column) -> Column:
    out = F.lit(1.0)
    for name, w in WEIGHTS.items():
        out = F.when(channel == name, w).otherwise(out)
    return out


def rrf_fuse(channels: DataFrame, k: int = 20, weights: DataFrame | None = None, by: list[str] = ()) -> DataFrame:
    """Weighted reciprocal rank fusion: (id, score, sources, n_sources), scores divided by the best.

    weights: (channel, w), broadcast; by: columns that name a query, each fused on its own.
    """
    by = list(by)
    if weights is None:
        rows = channels.withColumn("w", default_weight(F.col("channel")))
    else:
        on = ["channel", *[c for c in by if c in weights.columns]]
        rows = channels.join(F.broadcast(weights), on, "left").withColumn("w", F.coalesce("w", F.lit(1.0)))
    fused = rows.groupBy(*by, "id").agg(F.sum(F.col("w") / (RRF_K + F.col("rank") + 1)).alias("raw"), F.sort_array(F.collect_set("channel")).alias("s"))
    fused = fused.withColumn("raw", F.round("raw", 12))
    if by:
        order = Window.partitionBy(*by).orderBy(F.desc("raw"), "id")
        top = fused.withColumn("rank", (F.row_number().over(order) - 1).cast("long")).filter(F.col("rank") < k)
        most = F.max("raw").over(Window.partitionBy(*by))
    else:
        top = ranked(fused, k, F.desc("raw"), F.asc("id"))
        most = F.max("raw").over(Window.partitionBy(F.lit(1)))
    return top.select(*by, "id", F.round(F.col("raw") / most, 6).alias("score"), F.array_join("s", ",").alias("sources"), F.size("s").cast("long").alias("n_sources"), "rank")


#: The order in which the texts and metadata of channels are put together.
CHANNEL_ORDER = ["semantic", "bm25", "graph", "temporal"]


def rrf_fuse_text(channels: DataFrame, k: int = 20, weights: DataFrame | None = None) -> DataFrame:
    """rrf_fuse over (channel, id, rank, text, metadata): also the texts and metadata of an id's channels.

    Different texts are joined by line feeds, in the order of the channels; of equal metadata keys the last
    channel's value stays. Only the k rows that are returned are put together.
    """
    top = rrf_fuse(channels, k, weights)
    place = F.array_position(F.lit(CHANNEL_ORDER), F.col("channel"))
    rows = channels.join(top.select("id"), "id").select("id", F.struct(place.alias("place"), "channel", F.coalesce("text", F.lit("")).alias("text"), "metadata").alias("x"))
    # an id has one row for each channel at most
    own = rows.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("x.place", "x.channel", "x.text", F.coalesce(F.map_entries("x.metadata"), F.array()).alias("m")))).alias("xs"))
    texts = F.array_join(F.array_distinct(F.transform("xs", lambda x: x["text"])), "\n")
    empty = F.create_map().cast("map<string,string>")
    keep = lambda acc, m: F.map_concat(F.map_filter(acc, lambda key, _: ~F.array_contains(F.transform(m, lambda e: e["key"]), key)), F.map_from_entries(m))
    metadata = F.aggregate(F.transform("xs", lambda x: x["m"]), empty, keep)
    return top.join(own.select("id", texts.alias("text"), metadata.alias("metadata")), "id")


def interleave_fuse(channels: DataFrame, k: int = 20) -> DataFrame:
    """Round robin by rank, then channel name; the first place of an id counts."""
    size = channels.groupBy("channel").agg(F.count("*").alias("size"))
    first = channels.groupBy("id").agg(F.min(F.struct("rank", "channel")).alias("at")).select("id", "at.*")
    out = first.join(F.broadcast(size), "channel").select("id", F.round(1 - F.col("rank") / F.col("size"), 6).alias("score"), F.col("channel").alias("source"), F.col("rank").alias("r"))
    return ranked(out, k, F.asc("r"), F.asc("source"), F.asc("id")).drop("r")


def recency_decay(score: Column, age_days: Column, halflife: float = 90.0, missing: float = 30.0) -> Column:
    return score * F.pow(F.lit(0.5), F.greatest(F.lit(0.0), F.coalesce(age_days, F.lit(missing))) / halflife)


def query_classify(query: Column) -> Column:
    """temporal, entity, keyword or semantic; the rules are tried in this order."""
    units = F.size(cjk_chars(query)) + F.size(words(query))
    question, entity = query.rlike(QUESTION), query.rlike(ENTITY)
    return (
        F.when(F.coalesce(F.trim(query), F.lit("")) == "", "semantic")
        .when(query.rlike(TEMPORAL), "temporal")
        .when(units.between(9, 15) & ~question & entity, "entity")
        .when((units <= 15) & ~question, "keyword")
        .when((units <= 8) & entity, "entity")
        .otherwise("semantic")
    )


def adaptive_weight(kind: Column, channel: str) -> Column:
    """The channel's weight for a class of query."""
    factors = {"temporal": {"temporal": 1.6, "graph": 0.7}, "entity": {"graph": 1.5, "temporal": 0.7}, "keyword": {"bm25": 1.5, "semantic": 0.7}, "semantic": {"semantic": 1.3, "bm25": 0.8}}
    out = F.lit(WEIGHTS[channel])
    for name, by in factors.items():
        if channel in by:
            out = F.when(kind == name, WEIGHTS[channel] * by[channel]).otherwise(out)
    return out


def search_details(fused: DataFrame) -> DataFrame:
    """(source, n, percent): results that each channel contributed to, of all results."""
    total = fused.agg(F.count("*").alias("total"))
    each = fused.select(F.explode(F.split("sources", ",")).alias("source")).groupBy("source").agg(F.count("*").alias("n"))
    return each.join(F.broadcast(total)).select("source", "n", F.round(100.0 * F.col("n") / F.col("total"), 1).alias("percent"))


def rerank_heuristic(candidates: DataFrame, query: str, keep: int = 10) -> DataFrame:
    """candidates (id, text, rrf_score, n_sources) -> (id, score, rrf_score, rank).

    0.45 saturated tf-idf + 0.15 share of channels + 0.25 fused score + 0.15 length factor.
    """
    k1, b = 1.2, 0.75
    terms = sorted({w for w in query.lower().split()})
    docs = candidates.withColumn("tokens", F.concat(words(F.lower("text")), cjk_chars(F.col("text"))))
    docs = docs.withColumn("n_tokens", F.size("tokens").cast("double"))
    tf = docs.select("id", "n_tokens", F.explode("tokens").alias("term")).filter(F.col("term").isin(terms)).groupBy("id", "n_tokens", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    stats = docs.agg(F.count("*").alias("n"), F.avg("n_tokens").alias("avg"))
    asked = candidates.sparkSession.createDataFrame([(t,) for t in terms], "term string")
    idf = asked.join(df, "term", "left").join(F.broadcast(stats)).select("term", "avg", (F.log((F.col("n") + 1) / (F.coalesce("df", F.lit(0)) + 1)) + 1).alias("idf"))
    total = idf.agg(F.sum("idf").alias("total"))
    sat = tf.join(F.broadcast(idf), "term").groupBy("id").agg(F.sum(F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("n_tokens") / F.col("avg")))).alias("sat"))
    n = F.length("text")
    length = F.when(n < 20, 0.3).when(n > 2000, 0.7).otherwise(1.0)
    scored = docs.join(sat, "id", "left").join(F.broadcast(total)).select(
        "id", F.round(0.45 * F.coalesce("sat", F.lit(0.0)) / F.col("total") + 0.15 * F.least(F.lit(1.0), F.col("n_sources") / 4.0) + 0.25 * F.col("rrf_score") + 0.15 * length, 6).alias("score"), "rrf_score"
    )
    return ranked(scored, keep, F.desc("score"), F.asc("id"))


def budget_trim(results: DataFrame, budget: int = 4000) -> DataFrame:
    """results (id, text, rank): the best that fit; if not even one does, the first, cut, with '...'."""
    w = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = results.withColumn("used", F.sum(F.length("text")).over(w)).withColumn("first", F.row_number().over(Window.orderBy("rank")) == 1)
    cut = F.concat(F.substring("text", 1, budget), F.lit("..."))
    fits = F.col("used") <= budget
    return run.filter(fits | F.col("first")).select("id", "rank", F.when(fits, F.col("text")).otherwise(cut).alias("text"))


def context_items(results: DataFrame, budget: int = 2000, items: int = 5) -> DataFrame:
    """results (id, text, sources, rank): numbered, cut to a share of the budget, until it is used up."""
    share = budget // items
    short = F.when(F.length("text") > share, F.concat(F.substring("text", 1, share), F.lit("..."))).otherwise(F.col("text"))
    top = results.filter(F.col("rank") < items).select("id", "rank", F.concat(F.lit("["), (F.col("rank") + 1).cast("string"), F.lit("] ("), F.col("sources"), F.lit(") "), short).alias("line"))
    used = F.sum(F.length("line")).over(Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, -1))
    return top.withColumn("used", F.coalesce(used, F.lit(0))).filter(F.col("used") < budget).select("id", "rank", "line")


def provider_format_items(results: DataFrame, budget: int = 2000) -> DataFrame:
    """results (id, text, score, rank): '[score] text' lines; the line that overflows is cut."""
    line = F.concat(F.lit("["), F.format_string("%.2f", F.col("score")), F.lit("] "), F.col("text"))
    lines = results.select("id", "rank", line.alias("line"))
    used = F.coalesce(F.sum(F.length("line")).over(Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return lines.withColumn("left", F.lit(budget) - used).filter(F.col("left") > 0).select("id", "rank", F.expr("substring(line, 1, cast(left as int))").alias("line"))


CJK_RANGE = CJK
