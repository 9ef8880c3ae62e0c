"""Hard negatives: for each anchor and each of its nearest rows of the same label, the best rows of other
labels whose score lies in a band below the positive's.

Components are whole numbers (256 times the input, rounded down), scores their inner products. An orthogonal
rotation to the principal components leaves inner products as they are and moves what matters to the front:
the products of the leading components are added up in a few cuts, and what the rest can add is at most the
product of the two residual norms. With a slack for rounding this bounds the score from both sides, so a pair
that cannot enter an anchor's best any more, or misses every band, is discarded after a few components. What
is left is verified by integer products, so the rotation decides how fast the result comes and not what it is.

Anchors are a stated set, searched against all rows. Rows and anchors are dealt into blocks by their ids, every
block of rows meets every block of anchors in one task, and a task hands on an anchor's few best. Rows of one
label and one vector score alike, so only the first of them by id can ever be returned: more than
N_POSITIVES + 1 of them are not searched, whatever their number. They are still anchors.

Defined cases: rows with a null label or vector, or with a null or non-finite component, take no part, nor do
rows without id, empty vectors and vectors of another length than most have. Of rows that repeat an id the
smallest by label and components stands for it. An anchor without rows of its label, or a positive without
rows in its band, gives no row. Scores beyond a long are set to its ends. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import forget, materialize, read
from .vectors import block, finite, matrix, usual_length

N_POSITIVES, N_NEGATIVES = 5, 3
#: A negative's score is at least LOW and at most HIGH hundredths of the positive's.
LOW, HIGH = 50, 95
#: Rows and anchors of a block, and of a matrix within a task.
ROWS_BLOCK, ANCHORS_BLOCK, ROWS_PART, ANCHORS_PART = 16_384, 8_192, 1_024, 512
#: Shares of the variance at which partial products are held against their bounds.
SHARES = (0.5, 0.75, 0.9)
#: Above this share of pairs left, whole matrices are multiplied; below, pair by pair.
DENSE = 1 / 16
LONG_MAX = (1 << 63) - 1


@dataclass
class Rotation:
    """An orthogonal matrix and the numbers of leading components after which bounds are looked at."""

    matrix: np.ndarray
    cuts: list[int]

    @property
    def width(self) -> int:
        return len(self.matrix)


def rotation(rows: DataFrame, width: int) -> Rotation:
    """Principal components of all rows (column c)."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector

    if rows.limit(2).count() < 2:
        return Rotation(np.eye(width), [width])
    model = PCA(k=width, inputCol="v", outputCol="o").fit(rows.select(array_to_vector("c").alias("v")))
    found, shares = np.linalg.qr(model.pc.toArray())[0], np.cumsum(np.nan_to_num(model.explainedVariance.toArray()))
    if not np.isfinite(found).all():
        return Rotation(np.eye(width), [width])
    return Rotation(found, sorted({min(width, int(np.searchsorted(shares, s)) + 1) for s in SHARES} | {width}))


class Side:
    """Rows as whole numbers, rotated, with their norms and the norms of what lies behind each cut."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, ints: np.ndarray, turn: Rotation):
        self.ids, self.labels, self.ints, self.turned = ids, labels, ints, ints @ turn.matrix
        behind = np.cumsum(self.turned[:, ::-1] ** 2, axis=1)[:, ::-1]
        self.rest = [np.sqrt(behind[:, c]) if c < turn.width else np.zeros(len(ids)) for c in turn.cuts]
        # two rotations and a product round by a few d * eps each; d ** 1.5 also covers the sums of rounded parts
        self.slack = np.sqrt(4 * turn.width**1.5 * np.finfo(float).eps) * np.linalg.norm(ints, axis=1)


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer products of rows that stand side by side; as Python's integers where a long could overflow."""
    if not a.size:
        return np.zeros(len(a), np.int64)
    if float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < 2.0**55:
        return np.einsum("ij,ij->i", a.astype(np.int64), b.astype(np.int64))
    return np.array([max(-LONG_MAX, min(LONG_MAX, sum(int(x) * int(y) for x, y in zip(p, q, strict=True)))) for p, q in zip(a, b, strict=True)], object)


def survivors(a: Side, b: Side, i: np.ndarray, j: np.ndarray, turn: Rotation, floors: np.ndarray, ceilings: np.ndarray, other_labels: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows i of a and j of b that may lie between floors[x, k] and ceilings[x, k] for some k.

    Bounds are looked at after each cut; what fails there is not multiplied any further.
    """

    def possible(low: np.ndarray, high: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.any([(high >= floors[at, k].reshape(-1, *[1] * (high.ndim - 1))) & (low <= ceilings[at, k].reshape(-1, *[1] * (low.ndim - 1))) for k in range(floors.shape[1])], axis=0)

    alive = a.labels[i][:, None] != b.labels[j] if other_labels else np.ones((len(i), len(j)), bool)
    part, done, pairs = np.zeros(alive.shape), 0, None
    for k, cut in enumerate(turn.cuts):
        lead = slice(done, cut)
        if pairs is None:
            part += a.turned[i, lead] @ b.turned[j, lead].T
            far = np.outer(a.rest[k][i], b.rest[k][j]) + np.outer(a.slack[i], b.slack[j])
            alive &= possible(part - far, part + far, i)
            if alive.mean() < DENSE:
                x, y = np.nonzero(alive)
                pairs, part = (i[x], j[y]), part[x, y]
        else:
            x, y = pairs
            part = part + np.einsum("ij,ij->i", a.turned[x, lead], b.turned[y, lead])
            far = a.rest[k][x] * b.rest[k][y] + a.slack[x] * b.slack[y]
            left = possible(part - far, part + far, x)
            pairs, part = (x[left], y[left]), part[left]
        done = cut
    if pairs is None:
        x, y = np.nonzero(alive)
        pairs = i[x], j[y]
    return pairs


class Best:
    """The first k (score, id) of each owner: higher scores first, then smaller ids."""

    def __init__(self, owners: int, k: int):
        self.k, self.floor = k, np.full(owners, -np.inf)
        self.owner, self.score, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, owner: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        owner, score, ids = np.concatenate([self.owner, owner]), np.concatenate([self.score, score.astype(np.int64)]), np.concatenate([self.ids, ids])
        order = np.lexsort((ids, -score, owner))
        owner = owner[order]
        place = np.arange(len(owner)) - np.searchsorted(owner, owner)
        keep = place < self.k
        self.owner, self.score, self.ids = owner[keep], score[order][keep], ids[order][keep]
        last = place[keep] == self.k - 1
        self.floor[self.owner[last]] = self.score[last]


def _parts(a: np.ndarray, n: int) -> Iterator[np.ndarray]:
    return (a[at : at + n] for at in range(0, len(a), n))


def nearest_of_label(a: Side, b: Side, turn: Rotation, k: int) -> pa.Table:
    """(anchor_id, vec_id, score): the k best rows of b of each anchor's label, the anchor itself included."""
    best = Best(len(a.ids), k)
    no_ceiling = np.full((len(a.ids), 1), np.inf)
    for label in np.unique(a.labels):
        for j in _parts(np.flatnonzero(b.labels == label), ROWS_PART):
            for i in _parts(np.flatnonzero(a.labels == label), ANCHORS_PART):
                x, y = survivors(a, b, i, j, turn, best.floor[:, None], no_ceiling, False)
                best.add(x, exact(a.ints[x], b.ints[y]), b.ids[y])
    return pa.table({"anchor_id": a.ids[best.owner], "vec_id": best.ids, "score": best.score})


def best_in_bands(a: Side, b: Side, turn: Rotation, positives: np.ndarray, k: int) -> pa.Table:
    """(anchor_id, positive_score, negative_id, negative_score): the k best of other labels in each band.

    positives: the different scores of an anchor's positives, NaN beyond their number.
    """
    n = positives.shape[1]
    best = [Best(len(a.ids), k) for _ in range(n)]
    lowest, ceilings = positives * (LOW / 100), np.nan_to_num(positives * (HIGH / 100), nan=-np.inf)
    lowest = np.nan_to_num(lowest, nan=np.inf)
    exact_positives = np.array([[0 if np.isnan(x) else int(x) for x in row] for row in positives], object).reshape(positives.shape)
    for j in _parts(np.arange(len(b.ids)), ROWS_PART):
        for i in _parts(np.arange(len(a.ids)), ANCHORS_PART):
            floors = np.maximum(lowest, np.stack([x.floor for x in best], axis=1)) if n else lowest
            x, y = survivors(a, b, i, j, turn, floors, ceilings, True)
            score = exact(a.ints[x], b.ints[y])
            for m in range(n):
                p = exact_positives[x, m] if score.dtype == object else exact_positives[x, m].astype(np.int64)
                inside = (LOW * p <= 100 * score) & (100 * score <= HIGH * p) & ~np.isnan(positives[x, m])
                inside = inside.astype(bool)
                best[m].add(x[inside], score[inside], b.ids[y[inside]])
    out = [pa.table({"anchor_id": a.ids[t.owner], "positive_score": exact_positives[t.owner, m].astype(np.int64), "negative_id": t.ids, "negative_score": t.score}) for m, t in enumerate(best)]
    return pa.concat_tables(out)


def _column(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


def _floor(x: Column) -> Column:
    """The whole number below a double, as a double; doubles from 2 ** 53 on are whole."""
    return F.when(F.abs(x) < 2.0**53, F.floor(x).cast("double")).otherwise(x)


def _met(rows: DataFrame, anchors: DataFrame, blocks: tuple[int, int], fn, schema: str) -> DataFrame:
    """fn over each block of rows with each block of anchors."""
    r, a = blocks
    each = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    left = anchors.select("*", each(r, "rb"), block("vec_id", a).alias("ab"))
    right = rows.select("*", block("vec_id", r).alias("rb"), each(a, "ab"))
    return left.groupBy("rb", "ab").cogroup(right.groupBy("rb", "ab")).applyInArrow(fn, schema)


def mine(vectors: DataFrame, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", anchor_every: int = 50, relabel_every: int = 7, n_labels: int = 10) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Anchors are the rows whose id is divisible by anchor_every. Where an id is divisible by relabel_every, the
    label counts as (label + 1) % n_labels.
    """
    v, i = F.col(vector_col), F.col(id_col).cast("long")
    label = F.when(i % relabel_every == 0, (F.col(label_col) + 1) % n_labels).otherwise(F.col(label_col)).cast("long")
    usable = vectors.filter(i.isNotNull() & F.col(label_col).isNotNull() & finite(v))
    rows = usable.select(i.alias("vec_id"), label.alias("label"), F.transform(v, lambda x: _floor(x.cast("double") * 256)).alias("c"))
    width = usual_length(rows, "c")
    spark = vectors.sparkSession
    if width is None:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    rows = rows.filter(F.size("c") == width).groupBy("vec_id").agg(F.min(F.struct("label", "c")).alias("r")).select("vec_id", "r.*")
    rows = materialize(rows, "vectors")
    alike = Window.partitionBy("label", "c").orderBy("vec_id")
    searched = materialize(rows.withColumn("n", F.row_number().over(alike)).filter(F.col("n") <= N_POSITIVES + 1).drop("n"), "searched")
    anchors = rows.filter(F.col("vec_id") % anchor_every == 0)
    turn = rotation(searched, width)
    blocks = -(-searched.count() // ROWS_BLOCK), max(1, -(-anchors.count() // ANCHORS_BLOCK))

    def side(t: pa.Table) -> Side:
        return Side(_column(t, "vec_id"), _column(t, "label"), matrix(t.column("c"), width), turn)

    def positives_of(left: pa.Table, right: pa.Table) -> pa.Table:
        return nearest_of_label(side(left), side(right), turn, N_POSITIVES + 1)

    def negatives_of(left: pa.Table, right: pa.Table) -> pa.Table:
        scores = left.column("scores").to_pylist()
        padded = np.array([s + [np.nan] * (N_POSITIVES - len(s)) for s in scores], np.float64).reshape(len(scores), N_POSITIVES)
        return best_in_bands(side(left), side(right), turn, padded, N_NEGATIVES)

    near = _met(searched, anchors, blocks, positives_of, "anchor_id long, vec_id long, score long").filter("vec_id <> anchor_id")
    first = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "vec_id")
    positives = near.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= N_POSITIVES)
    positives = materialize(positives.select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")

    banded = anchors.join(positives.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.collect_set("positive_score").alias("scores")), "vec_id")
    found = _met(searched, banded, blocks, negatives_of, "anchor_id long, positive_score long, negative_id long, negative_score long")
    first = Window.partitionBy("anchor_id", "positive_score").orderBy(F.desc("negative_score"), "negative_id")
    found = found.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= N_NEGATIVES)
    out = materialize(positives.join(found, ["anchor_id", "positive_score"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"), "negatives")
    forget(rows, searched, positives)
    return out


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(read(spark, sf_dir, "embeddings"))


#: The same from the rules alone.
SQL = """WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS c FROM embeddings
WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_dot_product(a.c, b.c)::BIGINT AS score FROM r a, r b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, (row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score QUALIFY rank <= 3"""
