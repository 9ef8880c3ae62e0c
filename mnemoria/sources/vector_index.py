"""A stored vector index: a coarse quantiser with inverted lists of compressed residuals.

Centroids are fitted by k-means on a bounded sample; their number is the square root of the number of vectors,
up to MOST_LISTS. A vector goes to the list of its nearest centroid, a folder of its own, as what the centroid
leaves over, one signed byte for each component and one scale. A query looks into the lists of its nearest
centroids only. Lists are cut into blocks, and a block meets the queries that look into it in one matrix
product, which hands on a few candidates for each; their exact vectors are joined, and the cosine in double
precision decides.

How many lists to look into is measured when the index is built: for some vectors the true neighbours are
found by comparing them with all, and `probes` is the number of lists that holds the wanted share of those. So
it follows the size and the shape of the table: few lists where vectors cluster, many where they are even.

Vectors are compared by direction. Null, empty and zero vectors, those with null or non-finite components or
of another length than most, and rows without id are not indexed. Ids are keys. Appends go to the same
centroids as a segment of their own, removals are a list of ids; a log has the versions (see `log`).
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import StoreError
from ..operators.search import knn
from .log import Log

MOST_LISTS, SAMPLE_ROWS, ITERATIONS = 16_384, 200_000, 8
#: Vectors whose true neighbours say how many lists to look into, how many neighbours, and the share to hold.
MEASURED, MEASURED_K, WANTED = 200, 10, 0.95
#: Rows of a block of a list; candidates of a block, and of all, for each neighbour wanted.
BLOCK, CANDIDATES = 16_384, 3


def _usable(v: Column) -> Column:
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.coalesce(v.isNotNull() & ~odd & F.exists(v, lambda x: x != 0), F.lit(False))


def directions(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, v): usable vectors, scaled to length 1."""
    v = F.col("v")
    rows = vectors.filter(_usable(F.col(vector_col)) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    scaled = rows.withColumn("v", F.transform(v, lambda x: x / F.array_max(F.transform(v, lambda y: F.abs(y)))))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return scaled.withColumn("norm", norm).select("id", F.transform(v, lambda x: x / F.col("norm")).alias("v"))


def _matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _nearest(v: np.ndarray, centroids: np.ndarray, k: int) -> np.ndarray:
    """The numbers of the k nearest centroids of each row, nearest first."""
    distance = (centroids**2).sum(axis=1) - 2 * (v @ centroids.T)
    if k < len(centroids):
        few = np.argpartition(distance, k - 1, axis=1)[:, :k]
    else:
        few = np.broadcast_to(np.arange(len(centroids)), distance.shape)
    return np.take_along_axis(few, np.argsort(np.take_along_axis(distance, few, axis=1), axis=1, kind="stable"), axis=1)


def _parts(batches: Iterator[pa.RecordBatch], centroids: np.ndarray) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    step = max(1, (1 << 21) // len(centroids))
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            yield part, _matrix(part.column(1), centroids.shape[1])


def encoded(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(id, v) -> (list, id, code, scale)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, v in _parts(batches, centroids):
            own = _nearest(v, centroids, 1)[:, 0]
            rest = v - centroids[own]
            scale = np.maximum(np.abs(rest).max(axis=1), 1e-30) / 127
            codes = np.round(rest / scale[:, None]).astype(np.int8)
            yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), part.column(0), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(scale)], ["list", "id", "code", "scale"])

    return rows.mapInArrow(run, "list int, id long, code binary, scale double")


def looked_into(queries: DataFrame, centroids: np.ndarray, probes: int) -> DataFrame:
    """(id, v) -> (id, v, lists): the lists of the nearest centroids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, v in _parts(batches, centroids):
            lists = _nearest(v, centroids, probes).astype(np.int32)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.ListArray.from_arrays(np.arange(0, lists.size + 1, lists.shape[1], dtype=np.int32), lists.ravel())], ["id", "v", "lists"])

    return queries.mapInArrow(run, "id long, v array<double>, lists array<int>")


class VectorIndex:
    def __init__(self, spark: SparkSession, root: str, version: int | None = None):
        self.spark, self.root, self.version = spark, root.rstrip("/"), version
        self.log = Log(spark, self.root)

    def latest(self) -> int:
        return self.log.latest() if self.version is None else self.version

    def state(self) -> dict:
        found = self.log.read(self.latest())
        if not found:
            raise StoreError("STORAGE_READ_FAILED", "nothing is indexed")
        return found

    def _centroids(self, state: dict) -> np.ndarray:
        """A row for each list."""
        found = self.spark.read.parquet(f"{self.root}/{state['centroids']}").orderBy("list").toArrow()
        return _matrix(found.column("v"), state["width"])

    def build(self, vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> None:
        """Fit, index all vectors and measure how many lists to look into."""
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector

        path = f"segment-{uuid.uuid4().hex}"
        lengths = vectors.filter(_usable(F.col(vector_col))).groupBy(F.size(vector_col).alias("n")).count()
        usual = lengths.orderBy(F.desc("count"), "n").first()
        if usual is None:
            raise StoreError("EMPTY_CONTENT", "no vector to index")
        width = usual["n"]
        self._write_vectors(vectors.filter(F.size(vector_col) == width), path, id_col, vector_col)
        rows = self.spark.read.parquet(f"{self.root}/{path}/vectors")
        n = rows.count()
        lists = max(1, min(MOST_LISTS, round(math.sqrt(n))))
        sample = rows.select(array_to_vector("v").alias("v")) if n <= SAMPLE_ROWS else rows.orderBy(F.xxhash64("id")).limit(SAMPLE_ROWS).select(array_to_vector("v").alias("v"))
        if lists > 1:
            centroids = np.stack(KMeans(k=lists, featuresCol="v", seed=7, maxIter=ITERATIONS, initMode="random").fit(sample).clusterCenters())
        else:
            centroids = _matrix(rows.limit(1).toArrow().column("v"), width)
        self.spark.createDataFrame(list(enumerate(centroids.tolist())), "list int, v array<double>").write.parquet(f"{self.root}/{path}/centroids")
        self._write_codes(rows, path, centroids)
        state = {"width": width, "lists": len(centroids), "centroids": f"{path}/centroids", "segments": [[path, 1]], "gone": []}
        state["probes"] = self._measured(rows, path, centroids)
        self.log.commit(self.latest() + 1, state)

    def _write_vectors(self, vectors: DataFrame, path: str, id_col: str, vector_col: str) -> None:
        directions(vectors, id_col, vector_col).write.parquet(f"{self.root}/{path}/vectors")
        if self.spark.read.parquet(f"{self.root}/{path}/vectors").groupBy("id").count().filter("count > 1").limit(1).count():
            raise StoreError("STORAGE_DUPLICATE", "an id stands in several rows")

    def _write_codes(self, rows: DataFrame, path: str, centroids: np.ndarray) -> None:
        # rebalancing splits the rows of a large list into several files
        encoded(rows, centroids).hint("rebalance", F.col("list")).write.partitionBy("list").parquet(f"{self.root}/{path}/codes")

    def _measured(self, rows: DataFrame, path: str, centroids: np.ndarray) -> int:
        """The number of lists that hold WANTED of the true neighbours of some vectors."""
        some = rows.orderBy(F.xxhash64("id")).limit(MEASURED)
        true = knn(rows.select(F.col("id").alias("vec_id"), F.col("v").alias("embedding")), some.select(F.col("id").alias("query_id"), F.col("v").alias("embedding")), MEASURED_K)
        held = true.join(self.spark.read.parquet(f"{self.root}/{path}/codes").select(F.col("id").alias("vec_id"), "list"), "vec_id")
        ranked = looked_into(some, centroids, len(centroids)).select(F.col("id").alias("query_id"), F.posexplode("lists").alias("place", "list"))
        places = np.sort([r["place"] for r in held.join(ranked, ["query_id", "list"]).select("place").collect()])  # MEASURED * MEASURED_K at most
        return int(places[math.ceil(WANTED * len(places)) - 1]) + 1

    def append(self, vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> None:
        """More vectors, in the lists of the centroids that are there."""
        base, state = self.latest(), self.state()
        path = f"segment-{uuid.uuid4().hex}"
        self._write_vectors(vectors.filter(F.size(vector_col) == state["width"]), path, id_col, vector_col)
        self._write_codes(self.spark.read.parquet(f"{self.root}/{path}/vectors"), path, self._centroids(state))
        self.log.commit(base + 1, {**state, "segments": [*state["segments"], [path, base + 1]]})

    def remove(self, ids: DataFrame) -> None:
        """Take rows (id) out of all segments written so far."""
        base, state = self.latest(), self.state()
        path = f"gone-{uuid.uuid4().hex}"
        ids.select(F.col("id").cast("long").alias("id")).filter("id is not null").distinct().write.parquet(f"{self.root}/{path}")
        self.log.commit(base + 1, {**state, "gone": [*state["gone"], [path, base + 1]]})

    def _table(self, state: dict, name: str, schema: str) -> DataFrame:
        rows = reduce(DataFrame.unionByName, [self.spark.read.schema(schema).parquet(f"{self.root}/{p}/{name}").withColumn("segment", F.lit(n)) for p, n in state["segments"]])
        if not state["gone"]:
            return rows.drop("segment")
        gone = reduce(DataFrame.unionByName, [self.spark.read.schema("id long").parquet(f"{self.root}/{p}").withColumn("until", F.lit(n)) for p, n in state["gone"]])
        last = gone.groupBy("id").agg(F.max("until").alias("until"))
        return rows.join(last, "id", "left").filter("until is null or until < segment").drop("until", "segment")

    def search(self, queries: DataFrame, k: int, probes: int | None = None) -> DataFrame:
        """queries (query_id, embedding) -> (query_id, vec_id, score, rank): the k nearest that were found.

        score is the cosine, not below 0, rounded to six places; ties go to the smaller id.
        """
        state = self.state()
        centroids, width = self._centroids(state), state["width"]
        probes = min(probes or state["probes"], len(centroids))
        q = directions(queries.filter(F.size("embedding") == width), "query_id")
        codes = self._table(state, "codes", "list int, id long, code binary, scale double")
        asked = looked_into(q, centroids, probes).select("id", "v", F.explode("lists").alias("list"))
        sizes = codes.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))  # a row for each list
        left = asked.join(F.broadcast(sizes), "list").select("id", "v", "list", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
        right = codes.join(F.broadcast(sizes), "list").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).drop("blocks")
        most = CANDIDATES * k

        def near(key: tuple, a: pa.Table, b: pa.Table) -> pa.Table:
            if not len(a) or not len(b):
                return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "about": pa.array([], pa.float64())})
            ids, ask, v = b.column("id").to_numpy(), a.column("id").to_numpy(), _matrix(a.column("v"), width)
            rest = np.frombuffer(b"".join(b.column("code").to_pylist()), np.int8).reshape(-1, width) * b.column("scale").to_numpy()[:, None]
            about = v @ (centroids[key[0].as_py()] + rest).T
            few = np.argpartition(-about, most - 1, axis=1)[:, :most] if most < len(ids) else np.broadcast_to(np.arange(len(ids)), about.shape)
            return pa.table({"query_id": ask.repeat(few.shape[1]), "vec_id": ids[few].ravel(), "about": np.take_along_axis(about, few, axis=1).ravel()})

        found = left.groupBy("list", "block").cogroup(right.groupBy("list", "block")).applyInArrow(near, "query_id long, vec_id long, about double")
        first = Window.partitionBy("query_id").orderBy(F.desc("about"), "vec_id")
        few = found.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= most).drop("n", "about")
        exact = self._table(state, "vectors", "id long, v array<double>").select(F.col("id").alias("vec_id"), F.col("v").alias("w"))
        pairs = few.join(exact, "vec_id").join(q.select(F.col("id").alias("query_id"), "v"), "query_id")
        dot = F.aggregate(F.zip_with("v", "w", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
        scored = pairs.select("query_id", "vec_id", F.round(F.greatest(F.lit(0.0), dot), 6).alias("score"))
        best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return scored.withColumn("rank", (F.row_number().over(best) - 1).cast("long")).filter(F.col("rank") < k)
