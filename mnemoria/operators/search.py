"""Retrieval channels. A channel is (id, text, score, rank, channel): rank from 0, ties by id."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import occurrences, trigram_similarity

K1, B = 1.2, 0.75
LEAST_IDF = 1e-6


def ranked(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first k rows and their rank from 0; the window sees k rows only."""
    return df.orderBy(*order).limit(k).withColumn("rank", (F.row_number().over(Window.orderBy(*order)) - 1).cast("long"))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two float arrays, in double."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def search_semantic(vectors: DataFrame, query: DataFrame, k: int, where: Column | None = None) -> DataFrame:
    """Exact nearest vectors by cosine: vectors (vec_id, embedding), query (one embedding), broadcast."""
    rows = vectors if where is None else vectors.filter(where)
    q = query.select(F.col("embedding").alias("q")).limit(1)
    scored = rows.join(F.broadcast(q)).select("vec_id", F.greatest(F.lit(0.0), cosine(F.col("embedding"), F.col("q"))).alias("s"))
    return ranked(scored.select("vec_id", F.round("s", 6).alias("score")), k, F.desc("score"), F.asc("vec_id"))


def small(df: DataFrame, most_rows: int = 100_000) -> DataFrame:
    """df, to be broadcast if it has most_rows rows at most; else the planner chooses."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df


#: Vectors and queries of a block, in knn.
VECTOR_BLOCK, QUERY_BLOCK = 4096, 1024
#: Queries of a block whose scores are held at once.
QUERIES_AT_ONCE = 128


def _blocks(df: DataFrame, id_col: str, rows: int) -> DataFrame:
    """(block, ids, matrix): vectors of length 1 in blocks of some rows, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                m = np.array(part.column(1).to_pylist(), np.float64).reshape(part.num_rows, -1)
                norm = np.linalg.norm(m, axis=1, keepdims=True)
                m = m / np.where(norm > 0, norm, 1)
                ids = part.column(0).cast(pa.int64()).to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array([ids.tobytes()], pa.binary()), pa.array([m.tobytes()], pa.binary())], ["ids", "matrix"])

    kept = df.filter(F.col(id_col).isNotNull() & F.col("embedding").isNotNull())
    return kept.select(id_col, F.col("embedding").cast("array<double>")).mapInArrow(run, "ids binary, matrix binary")


def knn(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """For each query (query_id, embedding) its k nearest vectors. The queries are a stated set.

    Blocks of vectors meet blocks of queries in a matrix product each, which keeps k of a block for each
    query; the rest is never a row. A vector of zeros is like nothing (0).
    """
    q = _blocks(queries, "query_id", QUERY_BLOCK).withColumn("qb", F.row_number().over(Window.orderBy("ids")))  # few rows of many queries
    n = q.agg(F.count("*")).scalar()
    v = _blocks(vectors, "vec_id", VECTOR_BLOCK).select("ids", "matrix", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), n.cast("int")))).alias("qb"))
    pairs = v.join(q.select("qb", F.col("ids").alias("query_ids"), F.col("matrix").alias("query_matrix")), "qb").select("ids", "matrix", "query_ids", "query_matrix")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):  # read where they lie: a batch's blocks are not copied, and few queries' scores are held
                ids, matrix, query_ids, query_matrix = (np.frombuffer(c[row].as_buffer(), t) for c, t in zip(batch.columns, (np.int64, np.float64) * 2, strict=True))
                vectors_t, asked = matrix.reshape(len(ids), -1).T, query_matrix.reshape(len(query_ids), -1)
                for at in range(0, len(query_ids), QUERIES_AT_ONCE):
                    few_ids = query_ids[at : at + QUERIES_AT_ONCE]
                    scores = np.round(np.maximum(0.0, asked[at : at + QUERIES_AT_ONCE] @ vectors_t), 6)
                    best = np.lexsort((np.broadcast_to(ids, scores.shape), -scores))[:, :k]
                    found = [few_ids.repeat(best.shape[1]), ids[best].ravel(), np.take_along_axis(scores, best, axis=1).ravel()]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["query_id", "vec_id", "score"])

    few = pairs.mapInArrow(run, "query_id long, vec_id long, score double")
    # a cut for each salt keeps a query's rows from meeting in one task before they are few
    part = Window.partitionBy("query_id", F.pmod(F.xxhash64("vec_id"), F.lit(16))).orderBy(F.desc("score"), F.asc("vec_id"))
    few = few.withColumn("r", F.row_number().over(part)).filter(F.col("r") <= k).drop("r")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return few.withColumn("rank", (F.row_number().over(w) - 1).cast("long")).filter(F.col("rank") < k)


def _hashed(df: DataFrame, id_col: str, rows: int) -> DataFrame:
    """(ids, matrix, hashes): vectors in blocks of some rows with their buckets, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                m, h = (np.array(part.column(k).to_pylist(), np.float64).reshape(part.num_rows, -1) for k in (1, 2))
                ids = part.column(0).cast(pa.int64()).to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (ids, m, h)], ["ids", "matrix", "hashes"])

    return df.select(id_col, "embedding", "hashes").mapInArrow(run, "ids binary, matrix binary, hashes binary")


def ann_knn(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """For each query its k nearest by Euclidean distance among the vectors that share one of four buckets.

    Buckets are of random projections. There is no radius: on unit vectors the order is that of the
    cosine. A query with fewer than k candidates is compared with all vectors. Blocks of vectors meet blocks of
    queries, as in knn; rows are ordered by their buckets first, so blocks that share none are left out, and a
    pair that shares a bucket is an element of a matrix, never a row.
    """
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector, vector_to_array

    tables = 4
    known = F.col("embedding").isNotNull()
    v = vectors.filter(known & F.col("vec_id").isNotNull()).select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).withColumn("features", array_to_vector("embedding"))
    q = queries.filter(known & F.col("query_id").isNotNull()).select("query_id", F.col("embedding").cast("array<double>").alias("embedding")).withColumn("features", array_to_vector("embedding"))
    model = BucketedRandomProjectionLSH(inputCol="features", outputCol="hashes", bucketLength=1.0, numHashTables=tables, seed=7).fit(v)
    buckets = F.array(*[vector_to_array(F.col("hashes")[i])[0] for i in range(tables)])

    def blocks(df: DataFrame, id_col: str, rows: int) -> DataFrame:
        return _hashed(model.transform(df).select(id_col, "embedding", buckets.alias("hashes")).sortWithinPartitions("hashes"), id_col, rows)

    right = blocks(q, "query_id", QUERY_BLOCK).withColumn("qb", F.row_number().over(Window.orderBy("ids")))  # few rows of many queries
    n = right.agg(F.count("*")).scalar()
    left = blocks(v, "vec_id", VECTOR_BLOCK).select("*", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), n.cast("int")))).alias("qb"))
    pairs = left.join(right.toDF("query_ids", "query_matrix", "query_hashes", "qb"), "qb").select("ids", "matrix", "hashes", "query_ids", "query_matrix", "query_hashes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, m, h, query_ids, qm, qh in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids, query_ids = np.frombuffer(ids, np.int64), np.frombuffer(query_ids, np.int64)
                m, h, qm, qh = (np.frombuffer(x).reshape(len(of), -1) for x, of in ((m, ids), (h, ids), (qm, query_ids), (qh, query_ids)))
                met = np.zeros((len(query_ids), len(ids)), bool)
                for t in range(tables):
                    for bucket in np.intersect1d(h[:, t], qh[:, t]):
                        met[np.ix_(qh[:, t] == bucket, h[:, t] == bucket)] = True
                if not met.any():
                    continue
                square = np.einsum("ij,ij->i", qm, qm)[:, None] - 2 * (qm @ m.T) + np.einsum("ij,ij->i", m, m)
                square[~met] = np.inf
                # some more than the k nearest by products, whose rounding depends on the lengths; then exactly
                last = np.partition(square, min(k, len(ids)) - 1, axis=1)[:, min(k, len(ids)) - 1, None]
                slack = 1e-12 * (np.einsum("ij,ij->i", qm, qm)[:, None] + np.einsum("ij,ij->i", m, m).max()) + 2e-6 * np.sqrt(np.maximum(last, 0)) + 1e-12
                at, near = np.nonzero(met & (square <= last + slack))
                exact = np.concatenate([np.sqrt(((qm[at[i : i + 65536]] - m[near[i : i + 65536]]) ** 2).sum(axis=1)) for i in range(0, len(at), 65536)])
                exact = np.round(exact, 6)
                order = np.lexsort((ids[near], exact, at))
                at, near, exact = at[order], near[order], exact[order]
                place = np.arange(len(at)) - np.searchsorted(at, at)
                few = place < k
                found = [query_ids[at[few]], ids[near[few]], exact[few]]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["query_id", "vec_id", "distance"])

    def nearest(few: DataFrame) -> DataFrame:
        part = Window.partitionBy("query_id", F.pmod(F.xxhash64("vec_id"), F.lit(16))).orderBy("distance", "vec_id")
        few = few.withColumn("r", F.row_number().over(part)).filter(F.col("r") <= k).drop("r")
        w = Window.partitionBy("query_id").orderBy("distance", "vec_id")
        return few.withColumn("rank", (F.row_number().over(w) - 1).cast("long")).filter(F.col("rank") < k)

    near = nearest(pairs.mapInArrow(run, "query_id long, vec_id long, distance double"))
    enough = near.groupBy("query_id").agg(F.count("*").alias("n")).filter(F.col("n") >= k).select("query_id")
    short = queries.select("query_id", F.col("embedding").alias("q")).join(enough, "query_id", "left_anti")
    # on unit vectors the cosine gives the same order; the few queries that lack candidates go against all
    exact = knn(vectors, short.select("query_id", F.col("q").alias("embedding")), k)
    square = F.aggregate(F.zip_with("embedding", "q", lambda a, b: (a.cast("double") - b.cast("double")) * (a.cast("double") - b.cast("double"))), F.lit(0.0), lambda t, x: t + x)
    found = exact.select("query_id", "vec_id").join(vectors.select("vec_id", "embedding"), "vec_id").join(queries.select("query_id", F.col("embedding").alias("q")), "query_id")
    exact = nearest(found.select("query_id", "vec_id", F.round(F.sqrt(square), 6).alias("distance")))
    return near.join(enough, "query_id", "left_semi").union(exact).select("query_id", "vec_id", "distance", "rank")


def bm25(rows: DataFrame, n_terms: int) -> DataFrame:
    """rows with f<i> (frequency), n<i> (documents), d, n and avgdl -> the same with bm25 and score_compat."""
    parts = []
    for i in range(n_terms):
        idf = F.log((F.col("n") - F.col(f"n{i}") + 0.5) / (F.col(f"n{i}") + 0.5))
        idf = F.when(idf <= 0, LEAST_IDF).otherwise(idf)
        f = F.col(f"f{i}")
        parts.append(idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("d") / F.col("avgdl"))))
    out = rows.withColumn("bm25", F.round(reduce(lambda a, b: a + b, parts, F.lit(0.0)), 6))
    return out.withColumn("score_compat", F.round(1 / (1 + F.col("bm25")), 6))


def search_bm25(mem: DataFrame, terms: list[str], k: int | None = 20, where: Column | None = None) -> DataFrame:
    """Phrases as substrings over content, wing and room; (id, content, bm25, score_compat, rank).

    One scan makes term frequencies and lengths; document counts and the mean length are one row, which
    is broadcast back. For tables without a stored index (sources.text_index), which reads a few lists
    instead. Terms under three characters match nothing. score_compat is 1 / (1 + bm25).
    """
    terms = [t.lower() for t in terms if len(t) >= 3]
    cols = ("content", "wing", "room")
    none = F.lit(0)
    length = reduce(lambda a, b: a + b, [F.coalesce(F.greatest(F.length(c) - 2, none), none) for c in cols])
    tf = [reduce(lambda a, b: a + b, [F.coalesce(occurrences(F.col(c), t), none) for c in cols]).alias(f"f{i}") for i, t in enumerate(terms)]
    rows = mem.select("id", "content", "wing", "room", length.cast("double").alias("d"), *tf)
    stats = rows.agg(F.count("*").alias("n"), F.avg("d").alias("avgdl"), *[F.count_if(F.col(f"f{i}") > 0).alias(f"n{i}") for i in range(len(terms))])
    hit = reduce(lambda a, b: a | b, [F.col(f"f{i}") > 0 for i in range(len(terms))], F.lit(False))
    hits = rows.join(F.broadcast(stats)).filter(hit if where is None else hit & where)
    out = bm25(hits, len(terms)).select("id", "content", "bm25", "score_compat")
    return out if k is None else ranked(out, k, F.desc("bm25"), F.asc("id"))


def search_temporal(mem: DataFrame, now: int, start: int, end: int, terms: list[str] = (), rate: float = 0.1, k: int = 20) -> DataFrame:
    """Rows of a time range with any of the terms, by exp(-rate * age in days)."""
    rows = mem.filter(F.col("created_at").between(start, end))
    if terms:
        rows = rows.filter(reduce(lambda a, b: a | b, [F.lower("content").contains(t.lower()) for t in terms]))
    age = F.greatest(F.lit(0.0), (F.lit(now) - F.col("created_at")) / 86400.0)
    return ranked(rows.select("id", "content", F.round(F.exp(-rate * age), 6).alias("score")), k, F.desc("score"), F.asc("id"))


def graph_entity_match(queries: DataFrame, names: DataFrame) -> DataFrame:
    """Leftmost-longest matches of entity names in query texts: (query_id, name, pos).

    Names of any number are scanned once; the queries go to them. A match is dropped if a longer one starts
    at the same place, or if it starts inside a match that begins earlier.
    """
    hits = names.select("name").join(small(queries), F.lower("text").contains(F.lower("name")))
    at = hits.select("query_id", "name", F.length("name").alias("n"), F.instr(F.lower("text"), F.lower("name")).alias("pos"))
    best = at.withColumn("r", F.row_number().over(Window.partitionBy("query_id", "pos").orderBy(F.desc("n"), "name"))).filter("r = 1")
    before = F.max(F.col("pos") + F.col("n")).over(Window.partitionBy("query_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1))
    return best.withColumn("end", before).filter(F.col("end").isNull() | (F.col("pos") >= F.col("end"))).select("query_id", "name", F.col("pos").cast("long").alias("pos"))


def fuzzy_search_tags(queries: DataFrame, tags: DataFrame, threshold: float = 0.3, k: int = 5) -> DataFrame:
    """For each query (query) the tags (tag) of at least that trigram similarity, best first.

    Only pairs that share a trigram are compared: the join is on the trigram.
    """
    from ..functions.text import trigram_set

    q = queries.select("query", F.explode(trigram_set(F.col("query"))).alias("g"))
    t = tags.select("tag", F.explode(trigram_set(F.col("tag"))).alias("g"))
    pairs = q.join(t, "g").select("query", "tag").distinct()
    sim = pairs.select("query", "tag", F.round(trigram_similarity(F.col("query"), F.col("tag")), 6).alias("sim")).filter(F.col("sim") >= threshold)
    w = Window.partitionBy("query").orderBy(F.desc("sim"), "tag")
    return sim.withColumn("rank", (F.row_number().over(w) - 1).cast("long")).filter(F.col("rank") < k)


def fuzzy_match_tag(queries: DataFrame, tags: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The one tag that matches: exact first, else the most similar above (not at) the threshold."""
    best = fuzzy_search_tags(queries, tags, threshold, 1)
    return best.filter((F.col("sim") > threshold) | (F.lower(F.trim("query")) == F.lower(F.trim("tag")))).select("query", "tag", "sim")
