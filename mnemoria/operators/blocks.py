"""Places, running sums and order statistics of large groups, without sorting a group in one task.

Rows go into blocks between quantiles of all rows. What a block needs of others are sums over whole
blocks, so the rows of a group meet no further than in a block.
"""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows that a block should have, and the greatest number of quantiles, which the driver holds.
BLOCK_ROWS, MOST_BLOCKS = 1_000_000, 1024


def quantiles(rows: DataFrame, column: str, block_rows: int = BLOCK_ROWS) -> list[float]:
    """Ascending different values of a numeric column with about block_rows rows from one to the next; one pass."""
    known = rows.filter(F.col(column).isNotNull())
    n = min(MOST_BLOCKS, -(-known.count() // block_rows))
    if n < 2:
        return []
    return sorted(set(known.approxQuantile(column, [k / n for k in range(1, n)], 1 / (4 * n))))


def block(value: Column, bounds: list[float]) -> Column:
    """2 k + 1 between the k-th and the next bound, 2 k on the k-th itself, 1 below all; null: 0.

    A value of very many rows is a bound, so it is a block of its own, in which all values are equal.
    """
    if not bounds:
        return F.when(value.isNull(), 0).otherwise(1)
    at, steps = F.array(*[F.lit(float(b)) for b in bounds]), [1 << k for k in range(len(bounds).bit_length() - 1, -1, -1)]
    v = value.cast("double")
    upto = F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), lambda k, s: F.when(F.get(at, k + s - 1) <= v, k + s).otherwise(k))
    on = lambda k: 2 * k + F.when(F.get(at, k - 1) == v, 0).otherwise(1)
    return F.when(value.isNull(), 0).otherwise(F.get(F.transform(F.array(upto), on), 0))


def block_of(value: float, bounds: list[float]) -> int:
    """`block` of one value that is not null."""
    k = bisect.bisect_right(bounds, value)
    return 2 * k + (0 if k and bounds[k - 1] == value else 1)


def running_sum(rows: DataFrame, by: list[str], order: str, weight: Column, name: str, bounds: list[float]) -> DataFrame:
    """rows with `name`, the sum of the weights that stand before each in its group, by an ascending number that is unique in it.

    bounds are `quantiles` of that number. A null number stands first.
    """
    cut = rows.withColumn("_block", block(F.col(order), bounds)).withColumn("_weight", weight)
    sums = cut.groupBy(*by, "_block").agg(F.sum("_weight").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select(*[F.col(b).alias(f"_by{i}") for i, b in enumerate(by)], F.col("_block").alias("_of"), before.alias("_before"))
    same = F.col("_block") == F.col("_of")
    for i, b in enumerate(by):
        same &= F.col(b).eqNullSafe(F.col(f"_by{i}"))
    inside = F.sum("_weight").over(Window.partitionBy(*by, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_weight")
    return cut.withColumn("_inside", inside).join(sums, same).withColumn(name, F.col("_before") + F.col("_inside")).select(*rows.columns, name)


def running_count(rows: DataFrame, by: list[str], order: str, name: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """rows with `name`, the place (from 0) of each in its group by an ascending number that is unique in it."""
    return running_sum(rows, by, order, F.lit(1), name, quantiles(rows, order, block_rows))


def nth_values(rows: DataFrame, by: list[str], value: str, places: dict[str, Column], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(by..., a column for each place): the value at a place (from 0, of `n` rows) of each group's sorted values, nulls first.

    Equal values are counted first. The blocks' sums say which one holds a place; only such blocks are sorted.
    """
    c = rows.groupBy(*by, value).agg(F.count("*").alias("_c"))
    c = c.withColumn("_block", block(F.col(value), quantiles(c, value, block_rows)))
    sums = c.groupBy(*by, "_block").agg(F.sum("_c").alias("_n"))
    whole, upto = Window.partitionBy(*by), Window.partitionBy(*by).orderBy("_block")
    sums = sums.withColumn("n", F.sum("_n").over(whole)).withColumn("_end", F.sum("_n").over(upto)).withColumn("_start", F.col("_end") - F.col("_n"))
    asked = F.array(*[F.struct(F.lit(k).alias("what"), p.cast("long").alias("at")) for k, p in places.items()])
    wanted = F.filter(asked, lambda x: (x["at"] >= F.col("_start")) & (x["at"] < F.col("_end")))
    held = sums.withColumn("_asked", wanted).filter(F.size("_asked") > 0)
    held = held.select(*[F.col(b).alias(f"_by{i}") for i, b in enumerate(by)], F.col("_block").alias("_of"), "_start", "_asked")
    same = F.col("_block") == F.col("_of")
    for i, b in enumerate(by):
        same &= F.col(b).eqNullSafe(F.col(f"_by{i}"))
    end = F.col("_start") + F.sum("_c").over(Window.partitionBy(*by, "_block").orderBy(value))
    met = c.join(held, same).withColumn("_to", end).select(*by, value, "_to", "_c", F.explode("_asked").alias("_ask"))
    met = met.filter((F.col("_ask.at") < F.col("_to")) & (F.col("_ask.at") >= F.col("_to") - F.col("_c")))
    return met.groupBy(*by).agg(*[F.max(F.when(F.col("_ask.what") == k, F.col(value))).alias(k) for k in places])


def _inside(first: str, second: str):
    """For groups of a block: (by..., d), pairs that ascend in `first` and descend in `second`."""
    from .evaluation import inversions

    def run(group: pa.Table, by: list[str]) -> pa.Table:
        a, b = (np.unique(group[c].to_numpy(), return_inverse=True)[1] for c in (first, second))
        d = float(inversions(b[np.lexsort((b, a))]))
        return pa.table({**{k: group[k].slice(0, 1) for k in by}, "d": pa.array([d])})

    return run


def _across(group: pa.Table, by: list[str]) -> pa.Table:
    """Pairs whose blocks ascend in rb and descend in pb, from the counts of block pairs."""
    rb, pb = (np.unique(group[c].to_numpy(), return_inverse=True)[1] for c in ("rb", "pb"))
    m = np.zeros((rb.max() + 1, pb.max() + 1))
    m[rb, pb] = group["c"].to_numpy()
    above = np.cumsum(m[:, ::-1], axis=1)[:, ::-1] - m  # of the same rb, greater pb
    earlier = np.cumsum(above, axis=0) - above
    return pa.table({**{k: group[k].slice(0, 1) for k in by}, "d": pa.array([float((m * earlier).sum())])})


def discordant(rows: DataFrame, by: list[str], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """rows (by..., p, r), no nulls -> (by..., d): parts whose sum is the number of pairs that p and r order differently.

    Pairs of one block of r, then pairs of one block of p and different ones of r, are counted in that block;
    all other pairs by counts of the (at most 2048 squared) pairs of blocks. Blocks of one value need no count.
    """
    cut = rows.select(*by, "p", "r", block(F.col("r"), quantiles(rows, "r", block_rows)).alias("rb"), block(F.col("p"), quantiles(rows, "p", block_rows)).alias("pb"))
    out = T.StructType([*rows.select(*by).schema.fields, T.StructField("d", T.DoubleType())])
    in_r, in_p = _inside("r", "p"), _inside("rb", "p")
    one = cut.filter("rb % 2 = 1").groupBy(*by, "rb").applyInArrow(lambda g: in_r(g, by), out)
    two = cut.filter("pb % 2 = 1").groupBy(*by, "pb").applyInArrow(lambda g: in_p(g, by), out)
    counts = cut.groupBy(*by, "rb", "pb").agg(F.count("*").alias("c"))
    return one.union(two).union(counts.groupBy(*by).applyInArrow(lambda g: _across(g, by), out))
