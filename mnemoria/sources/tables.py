"""Sources: the Parquet tables, and the memory store's relations as views of them.

Times are epoch seconds (long); `NOW` is a literal, never the clock.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

START = 1_704_067_200  # 2024-01-01
NOW = 1_709_251_200  # 2024-03-01
EVENTS_NOW = 1_706_659_200  # 2024-01-31


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as memories: id, content, wing, room, created_at."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("id"), F.col("text").alias("content"), F.col("lang").alias("wing"), F.col("source").alias("room"), (F.lit(START) + F.col("doc_id") * 3600).alias("created_at"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events with ts as epoch seconds."""
    e = table(spark, sf_dir, "events")
    return e.withColumn("at", F.unix_timestamp(F.col("ts").cast("timestamp")))


def place_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(subject, predicate, object, weight): suppliers and nations located_in / part_of, nations cause the next."""
    n, r, s = (table(spark, sf_dir, t) for t in ("nation", "region", "supplier"))
    one = F.lit(1.0).alias("weight")
    in_nation = s.join(F.broadcast(n), s.s_nationkey == n.n_nationkey).select(F.col("s_name").alias("subject"), F.lit("located_in").alias("predicate"), F.col("n_name").alias("object"), one)
    in_region = n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey).select(F.col("n_name").alias("subject"), F.lit("part_of").alias("predicate"), F.col("r_name").alias("object"), one)
    m = n.select((F.col("n_nationkey") - 1).alias("k"), F.col("n_name").alias("next"))
    causes = n.join(m, n.n_nationkey == m.k).select(F.col("n_name").alias("subject"), F.lit("cause").alias("predicate"), F.col("next").alias("object"), one)
    return in_nation.union(in_region).union(causes)


def brand_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands that share an order, as co_occurs_with edges (subject < object), weighted by their orders."""
    pairs = order_pairs(spark, sf_dir, "p_brand").groupBy("subject", "object").agg(F.count("*").alias("weight"))
    return pairs.select("subject", F.lit("co_occurs_with").alias("predicate"), "object", F.col("weight").cast("double").alias("weight"))


def order_pairs(spark: SparkSession, sf_dir: str, attribute: str) -> DataFrame:
    """Pairs subject < object of distinct part attributes in one order.

    An order holds few lines, so the array of its attributes is short and pairs are made inside the row.
    """
    line, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    named = line.select("l_orderkey", "l_partkey").join(part.select("p_partkey", F.col(attribute).alias("name")), F.col("l_partkey") == F.col("p_partkey"))
    sets = named.groupBy("l_orderkey").agg(F.sort_array(F.collect_set("name")).alias("names"))
    pairs = F.flatten(F.transform("names", lambda a: F.transform(F.filter("names", lambda b: a < b), lambda b: F.struct(a.alias("subject"), b.alias("object")))))
    return sets.select("l_orderkey", F.inline(pairs))
