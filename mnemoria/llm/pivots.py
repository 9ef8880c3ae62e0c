"""Near duplicates among embeddings by a pivot-permutation index.

Reference points (pivots) are drawn from the vectors. A vector is described by its LENGTH nearest pivots, in
order; near vectors see the same pivots near. Inverted lists hold the vectors of a pivot, and two vectors are
candidates if their descriptions share LEAST_SHARED pivots. Only candidates are verified, by their cosine in
double precision. A pair that shares s pivots also shares one of the LENGTH - s + 1 rarest of each, so a vector
stands in the lists of those only: frequent pivots have short lists, and nothing is lost by that.

Pivots grow in number with the square root of the table, up to MOST_PIVOTS; they are the only thing that is
fitted on a sample, and every vector is indexed. What the description misses is lost: recall against brute
force is measured by the tests.

Equal vectors are one class, looked up once, whatever their number. Lists are cut into blocks, and two blocks
meet in one task. There the shared pivots of all pairs are counted in a table of pivots by rows, and a pair
counts only in the list of its rarest shared pivot, so it is verified once. A task does not hand on pairs: it
sums the links of each vector and returns a forest of edges with the same components, at most one edge for each
vector. So a group of near copies sends on as many rows as it has members for each block.

Defined cases: vectors that are null, empty or zero, or hold null or non-finite components, link with nothing,
and neither do rows without id (no component, kept). Vectors of different lengths do not link. Rows that repeat
an id with one vector give a row each and count once; with several vectors, the smallest of them stands for the
id, before it is looked at whether it can link. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_stream, forget, materialize, read
from .components import connected_components
from .vectors import finite, matrix

LENGTH, LEAST_SHARED = 16, 4
#: Pivots: this many times the square root of the number of vectors; at most so many (17 MB at 64 dimensions).
PIVOTS_PER_ROOT, MOST_PIVOTS = 8, 32_768
#: Pivots are taken from this many times their number, and are less alike than linked vectors by APART.
DRAWN, APART = 2, 0.1
#: Cosines with pivots that a task holds at once.
AT_ONCE = 1 << 21
#: Vectors of a block of a list, and of a table within a task.
BLOCK, PART = 4_096, 512
#: Above this share of candidates whole matrices are multiplied, below pair by pair.
DENSE = 1 / 16


def _vectors(column: pa.Array, width: int) -> np.ndarray:
    return matrix(column, width).astype(np.float64)


def _normed(v: np.ndarray) -> np.ndarray:
    """Scaled to length 1; first by the largest component, so that no square overflows or vanishes."""
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def spread(v: np.ndarray, n: int, cosine: float) -> np.ndarray:
    """The first n rows of v, vectors of length 1, that are not as near as cosine to a row taken before."""
    taken = np.zeros((0, v.shape[1]))
    for at in range(0, len(v), PART):
        part = v[at : at + PART]
        part = part[(part @ taken.T < cosine).all(axis=1)]
        free, near = np.ones(len(part), bool), part @ part.T >= cosine
        for k in range(len(part)):
            if free[k]:
                free[k + 1 :] &= ~near[k, k + 1 :]
        taken = np.concatenate([taken, part[free]])
        if len(taken) >= n:
            break
    return taken[:n]


def pivots_of(classes: DataFrame, width: int, n: int, cosine: float) -> np.ndarray:
    """At most n vectors of that length as reference points: of those with the smallest hashes of their ids.

    A group of near copies gives one pivot: among many that are alike, the nearest ones would be chance.
    """
    found = classes.orderBy(F.xxhash64("id"), "id").limit(DRAWN * n).select("v").toArrow()
    return spread(_normed(_vectors(found.column("v").combine_chunks(), width)), n, cosine - APART)


def described(classes: DataFrame, pivots: np.ndarray) -> DataFrame:
    """(id, v, near): the numbers of the LENGTH nearest pivots, nearest first; ties by number."""
    width, length, step = pivots.shape[1], min(LENGTH, len(pivots)), max(1, AT_ONCE // len(pivots))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                cosine = _normed(_vectors(part.column(1), width)) @ pivots.T
                few = np.argpartition(-cosine, length - 1, axis=1)[:, :length] if length < len(pivots) else np.broadcast_to(np.arange(length), cosine.shape)
                order = np.lexsort((few, -np.take_along_axis(cosine, few, axis=1)))
                near = np.take_along_axis(few, order, axis=1).astype(np.int32)
                lists = pa.ListArray.from_arrays(np.arange(0, near.size + 1, length, dtype=np.int32), near.ravel())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), lists], ["id", "v", "near"])

    return arrow_stream(classes.select("id", "v"), run, "id long, v array<double>, near array<int>")


def shared(a: np.ndarray, b: np.ndarray, pivot: int) -> np.ndarray:
    """For each row of a and of b: the pivots that both have, plus 256 for each of them below pivot.

    Pivots are numbered by rank, the rarest first.
    """
    known, local = np.unique(a, return_inverse=True)
    table = np.zeros((len(known) + 1, len(a)), np.uint16)
    table[local.ravel(), np.repeat(np.arange(len(a)), a.shape[1])] = 1
    table[: np.searchsorted(known, pivot)] *= 257
    at = np.searchsorted(known, b)
    at[at == len(known)] = 0
    at = np.where(known[at] == b, at, len(known))
    out = table[at[:, 0]].copy()
    for k in range(1, b.shape[1]):
        out += table[at[:, k]]
    return out.T


def forest(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest node that the links (x, y) lead to."""
    label = np.arange(n)
    while True:
        least = label.copy()
        np.minimum.at(least, x, label[y])
        np.minimum.at(least, y, label[x])
        least = least[least]
        if (least == label).all():
            return label
        label = least


def linked(va: np.ndarray, vb: np.ndarray, candidates: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """The candidates (rows x columns, true or not) whose cosine is high enough; vectors of length 1."""
    if candidates.mean() > DENSE:
        return np.nonzero(candidates & (va @ vb.T >= cosine))
    x, y = np.nonzero(candidates)
    keep = np.einsum("ij,ij->i", va[x], vb[y]) >= cosine
    return x[keep], y[keep]


def _cell(width: int, length: int, least: int, cosine: float):
    """Links within a list, or between two blocks of it: (id, links, other)."""

    def run(key: tuple, t: pa.Table) -> pa.Table:
        pivot, one, two = (k.as_py() for k in key)
        t = t.sort_by("id")
        ids, sizes, block = (t.column(c).to_numpy() for c in ("id", "n", "block"))
        near, v = matrix(t.column("near"), length), _normed(matrix(t.column("v"), width))
        links, label = np.zeros(len(ids), np.int64), np.arange(len(ids))
        parts = [(np.flatnonzero(block == b)[at : at + PART]) for b in sorted({one, two}) for at in range(0, int((block == b).sum()), PART)]
        for p, a in enumerate(parts):
            for b in parts[p:]:
                if one != two and block[a[0]] == block[b[0]]:
                    continue
                s = shared(near[a], near[b], pivot)
                candidates = (s < 256) & (s >= least)
                if a is b:
                    candidates &= np.arange(len(a))[:, None] < np.arange(len(b))
                x, y = linked(v[a], v[b], candidates, cosine)
                if len(x):
                    x, y = a[x], b[y]
                    np.add.at(links, x, sizes[y])
                    np.add.at(links, y, sizes[x])
                    label = forest(len(ids), np.concatenate([x, np.arange(len(ids))]), np.concatenate([y, label]))
        hit = links > 0
        return pa.table({"id": ids[hit], "links": links[hit], "other": ids[label[hit]]})

    return run


def _links_of_width(classes: DataFrame, width: int, n: int, cosine: float) -> DataFrame:
    """(id, links, other) over the classes of one length, some rows for an id; n: their number."""
    pivots = pivots_of(classes, width, min(MOST_PIVOTS, max(1, math.ceil(PIVOTS_PER_ROOT * math.sqrt(n)))), cosine)
    length = min(LENGTH, len(pivots))
    least = min(LEAST_SHARED, length)
    seen = materialize(described(classes, pivots), "described")
    counts = seen.select(F.explode("near").alias("p")).groupBy("p").count().collect()  # a row for each pivot
    rank = np.zeros(len(pivots), np.int32)
    rank[[r["p"] for r in sorted(counts, key=lambda r: (r["count"], r["p"]))]] = np.arange(len(counts))

    def renumber(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ranks = np.sort(rank[matrix(batch.column(1), length)], axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(np.arange(0, ranks.size + 1, length, dtype=np.int32), ranks.ravel())], ["id", "ranks"])

    ranked = arrow_stream(seen.select("id", "near"), renumber, "id long, ranks array<int>")
    entries = materialize(ranked.select("id", F.col("ranks").alias("near"), F.explode(F.slice("ranks", 1, length - least + 1)).alias("pivot")), "lists")
    blocks = entries.groupBy("pivot").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))  # a row for each pivot
    placed = entries.join(F.broadcast(blocks), "pivot").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    cells = placed.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("with"))
    cells = cells.select("pivot", F.least("block", "with").alias("one"), F.greatest("block", "with").alias("two"), "block", "id", "near")
    full = cells.join(classes.select("id", "v", "n"), "id")
    found = materialize(full.groupBy("pivot", "one", "two").applyInArrow(_cell(width, length, least, cosine), "id long, links long, other long"), "links")
    forget(seen, entries)
    return found


def near_vectors(vectors: DataFrame, cosine: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept), a row for each row of vectors."""
    v = F.col(vector_col)
    rows = materialize(vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.cast("array<double>").alias("v")), "rows")
    one = rows.filter("vec_id is not null").groupBy("vec_id").agg(F.min("v").alias("v"))
    able = one.filter(finite(F.col("v")) & F.exists("v", lambda x: x != 0))
    classes = materialize(able.groupBy("v").agg(F.min("vec_id").alias("id"), F.count("*").alias("n")), "classes")
    widths = classes.groupBy(F.size("v").alias("width")).count().collect()  # a row for each length of vector
    found = [_links_of_width(classes.filter(F.size("v") == r["width"]), r["width"], r["count"], cosine) for r in widths if r["count"] > 1]

    spark = vectors.sparkSession
    links = spark.createDataFrame([], "id long, links long, other long")
    for f in found:
        links = links.unionByName(f)
    comps = connected_components(links.filter("id <> other").select(F.col("id").alias("u"), F.col("other").alias("v")))
    known = classes.join(links.groupBy("id").agg(F.sum("links").alias("links")), "id", "left").join(comps.withColumnRenamed("node", "id"), "id", "left")
    known = materialize(known.select("v", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("component_id")), "known")
    # a hot vector is on the left side only, where a skewed join splits it
    told = able.join(known, "v").select("vec_id", "n_links", "component_id")
    out = materialize(rows.select("vec_id").join(told, "vec_id", "left"), "out")
    forget(rows, classes, known, *found)
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("vec_id")).alias("kept"))


def op12_pivot_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(read(spark, sf_dir, "embeddings"))


#: The same from the rules alone, over all pairs.
SQL = """WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS u, b.vec_id AS w FROM v a, v b WHERE a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
r AS (SELECT vec_id AS u, vec_id AS w FROM embeddings UNION SELECT r.u, l.w FROM r JOIN l ON r.w = l.u),
c AS (SELECT u, min(w) AS component_id FROM r GROUP BY u), n AS (SELECT u, count(*) AS n FROM l GROUP BY u)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM embeddings e LEFT JOIN c ON c.u = e.vec_id LEFT JOIN n ON n.u = e.vec_id"""
