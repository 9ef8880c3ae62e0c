"""What the training-data operators share: reading, shared storage, Arrow batches.

Written tables go to the folder that the cluster names in ``spark.checkpoint.dir``; every executor
sees it, so a lost executor costs a task and not the result. A temporary folder is used only on a
local master without that setting.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows and bytes of an Arrow batch while a table is written: documents are of unbounded length, so batches
#: hold few of them.
ROWS_PER_BATCH, BYTES_PER_BATCH = 512, 8_000_000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this session; fails on a cluster that names none."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = "file://" + tempfile.mkdtemp(prefix="mnemoria-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


@contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of bounded rows and bytes; the session's own settings come back afterwards."""
    ours = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(ROWS_PER_BATCH), "spark.sql.execution.arrow.maxBytesPerBatch": str(BYTES_PER_BATCH)}
    before = {k: spark.conf.get(k) for k in ours}
    try:
        for k, v in ours.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: lineage ends here.

    The table is deleted by `forget`, or when the driver's Python ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/mnemoria/{label}-{uuid.uuid4().hex}"
    with _small_batches(spark):
        df.write.option("compression", "zstd").parquet(path)
    atexit.register(_delete, spark, path)
    written = spark.read.schema(df.schema).parquet(path)
    written._written_to = path
    if _open:
        _open[-1].append(written)
    return written


#: Tables materialized in each `cleared` block that has not ended.
_open: list[list[DataFrame]] = []


@contextmanager
def cleared(kept: list[DataFrame]) -> Iterator[None]:
    """Delete the tables that are materialized inside, at the end; not those in kept by then."""
    own: list[DataFrame] = []
    _open.append(own)
    try:
        yield
    finally:
        _open.pop()
        forget(*[t for t in own if not any(t is k for k in kept)])


def forget(*tables: DataFrame) -> None:
    """Delete materialized tables that nothing reads any more."""
    for t in tables:
        _delete(t.sparkSession, t._written_to)


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001  the session has gone: the folder's owner cleans up
        pass


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """mapInArrow by slices of some rows each; fn, which takes columns by place, turns one slice into some batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, max(1, batch.num_rows), ROWS_PER_BATCH):
                yield from fn(batch.slice(at, ROWS_PER_BATCH))

    if any(set(".`") & set(c) for c in df.columns):  # mapInArrow would take such a name apart
        df = df.toDF(*[f"c{k}" for k in range(len(df.columns))])
    return df.mapInArrow(run, schema)


def arrow_stream(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow for functions that keep state over the batches of a partition."""
    return df.mapInArrow(fn, schema)


def gathered(batches: Iterator[pa.RecordBatch], column: int, n_bytes: int) -> Iterator[pa.RecordBatch]:
    """The same rows in larger batches, of about n_bytes in a text column; one text may be longer."""
    held, size = [], 0
    for batch in batches:
        at, sizes = 0, np.cumsum(np.diff(_offsets(batch.column(column))))
        while at < batch.num_rows:
            done = int(sizes[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(sizes, done + n_bytes - size, side="right")))
            held.append(batch.slice(at, to - at))
            size += int(sizes[to - 1]) - done
            at = to
            if size >= n_bytes or at < batch.num_rows:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size = [], 0
    if held and (rows := pa.Table.from_batches(held).combine_chunks().to_batches()):
        yield rows[0]


def _offsets(column: pa.Array) -> np.ndarray:
    wide = column.cast(pa.large_binary())
    return np.frombuffer(wide.buffers()[1], np.int64)[wide.offset : wide.offset + len(wide) + 1] if len(wide) else np.zeros(1, np.int64)


def columns_of(df: DataFrame) -> list[Column]:
    """All columns of df, whatever their names: a dot in a name is no struct field."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def unused(df: DataFrame, name: str) -> str:
    """The name, with underscores before it until no column of df has it."""
    while name.lower() in {c.lower() for c in df.columns}:
        name = "_" + name
    return name


def id_bucket(id_col: str, mod: int) -> Column:
    """crc32 of the id as text, modulo mod; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % F.lit(mod)


def texts_of(column: pa.Array) -> list[str]:
    """Python strings of an Arrow column; null is the empty text."""
    return ["" if x is None else x for x in column.to_pylist()]


def bytes_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of an Arrow string column without decoding; null is empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]
