"""A stored full-text index: trigram posting lists with positions, for phrases as substrings.

A segment is the index of the rows of one append. It has posting lists, cut by the trigram into PARTS folders
and sorted in each, and a narrow table of documents (id, length, what filters need). A list is a row for each
block of documents that a task read together: the places of one trigram in the block's texts laid end to end,
as differences in bytes of seven bits. Where each text begins is one more row of a block, in a folder of its own.
Trigrams are numbers, three code points of 21 bits, so nothing is hashed and nothing is confused.

A phrase is looked up by the trigrams at every third place and at its end: the scan is cut to their folders
and, by the statistics of the files, to their rows. Lists of a block meet in one task, which shifts the
positions by the trigrams' places and intersects them; what comes out is the number of times that a phrase
stands in a document, without its text. Document frequencies are counts of those, lengths come from the table
of documents, so scores are those of a scan.

Appends add a segment, removals a list of ids that are gone from all segments before; a log has the versions
(see `log`), so a reader sees an append whole or not at all. Ids are keys: rows of a null id are not indexed,
and an append that repeats an id within itself fails. Null columns have no text.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..errors import StoreError
from ..operators.search import bm25, ranked
from .log import Log

#: Folders of posting lists of a segment: a prime.
PARTS = 61
#: Documents and characters of a block, at most; one text may be longer.
BLOCK_ROWS, BLOCK_CHARS = 2048, 4_000_000
FIELDS = ("content", "wing", "room")
_BITS = 21
#: In place of a trigram, for the ids of a block and the beginnings of their texts; in folder PARTS.
NO_GRAM = -1
POSTINGS = "part int, gram long, block long, places binary"


def grams_at(text: str) -> np.ndarray:
    """The trigram that starts at each place of a text, as a number."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return c[:-2] | c[1:-1] << _BITS | c[2:] << 2 * _BITS if len(c) > 2 else np.zeros(0, np.int64)


def cover(term: str) -> list[tuple[int, int]]:
    """(place, trigram) of every third place of a phrase and of its end: together they are the phrase."""
    every = grams_at(term)
    return [(k, int(every[k])) for k in sorted({*range(0, len(every), 3), len(every) - 1})]


def _lists(ends: np.ndarray, values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(values))


def packed(values: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending lists, which begin at starts in values -> their bytes, and where each list's begin (and the end).

    A list is its first value and then differences, seven bits a byte, the high bit set where more follow.
    """
    d = np.diff(values, prepend=0)
    d[starts] = values[starts]
    n = np.ones(len(d), np.int64)
    for bits in range(7, 64, 7):
        more = d >> bits > 0
        if not more.any():
            break
        n += more
    ends = np.cumsum(n)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    for k in range(int(n.max(initial=0))):
        has = n > k
        out[ends[has] - n[has] + k] = d[has] >> 7 * k & 127 | (n[has] > k + 1) * 128
    return out, np.append((ends - n)[starts], len(out))


def unpacked(data: bytes) -> np.ndarray:
    """One list of `packed`."""
    b = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(b < 128)
    first = np.append(0, ends[:-1] + 1)
    at = np.arange(len(b)) - np.repeat(first, ends - first + 1)
    return np.cumsum(np.add.reduceat((b & 127).astype(np.int64) << 7 * at, first))


def block_postings(ids: list[int], texts: list[tuple[str | None, ...]], block: int) -> pa.RecordBatch:
    """The posting lists of some documents; texts has the columns of each."""
    grams = [grams_at(text or "") for columns in texts for text in columns]
    sizes = np.array([len(g) for g in grams], np.int64)
    begins = np.cumsum(sizes + 3) - sizes - 3  # two letters have no trigram, and a gap keeps phrases apart
    gram = np.concatenate(grams)
    place = np.arange(len(gram)) + np.repeat(begins - (np.cumsum(sizes) - sizes), sizes)
    order = np.argsort(gram, kind="stable")  # within a trigram by place
    gram, place = gram[order], place[order]
    starts = np.flatnonzero(np.diff(gram, prepend=-1))
    data, at = packed(place, starts)
    owners = np.frombuffer(np.asarray(ids, np.int64).tobytes() + begins.tobytes(), np.uint8)
    known = np.append(gram[starts], NO_GRAM)
    at = np.append(at, len(data) + len(owners))
    lists = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(known), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(np.concatenate([data, owners]))])
    folder = np.append(gram[starts] % PARTS, PARTS)
    columns = [pa.array(folder.astype(np.int32)), pa.array(known), pa.array(np.full(len(known), block)), lists.cast(pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["part", "gram", "block", "places"])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list]]:
    """Rows of (id, columns) in groups of bounded number and length."""
    ids, texts, size = [], [], 0
    for batch in batches:
        for i, *columns in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            ids.append(i)
            texts.append(tuple(columns))
            size += sum(len(t or "") for t in columns)
            if len(ids) >= BLOCK_ROWS or size >= BLOCK_CHARS:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    task = TaskContext.get().partitionId()
    for k, (ids, texts) in enumerate(_blocks(batches)):
        yield block_postings(ids, texts, task << 32 | k)


def apart(starts: np.ndarray, length: int) -> np.ndarray:
    """Of sorted places the ones that a reader from left to right takes, each after the end of the one before."""
    if len(starts) < 2 or (np.diff(starts) >= length).all():
        return starts
    out, end = [], -1
    for s in starts.tolist():
        if s >= end:
            out.append(s)
            end = s + length
    return np.asarray(out, starts.dtype)


def _counter(terms: list[str]):
    """Lists of one block -> (id, f): how often each phrase stands in each document that has one."""
    covers = [cover(t) for t in terms]

    def run(t: pa.Table) -> pa.Table:
        at = dict(zip(t.column("gram").to_pylist(), t.column("places").to_pylist(), strict=True))
        owners = np.frombuffer(at.pop(NO_GRAM), np.int64)
        n = len(owners) // (1 + len(FIELDS))
        every, begins = owners[:n], owners[n:]
        at = {gram: unpacked(data) for gram, data in at.items()}
        f = np.zeros((n, len(terms)), np.int32)
        for k, (term, places) in enumerate(zip(terms, covers, strict=True)):
            if all(g in at for _, g in places):
                starts = reduce(lambda a, b: np.intersect1d(a, b, assume_unique=True), [at[g] - offset for offset, g in places])
                columns = np.searchsorted(begins, apart(starts, len(term)), "right") - 1
                np.add.at(f[:, k], columns // len(FIELDS), 1)
        hit = np.flatnonzero(f.any(axis=1))
        return pa.table({"id": every[hit], "f": _lists(np.arange(1, len(hit) + 1) * len(terms), f[hit].ravel())})

    return run


class TextIndex:
    def __init__(self, spark: SparkSession, root: str, version: int | None = None):
        self.spark, self.root, self.version = spark, root.rstrip("/"), version
        self.log = Log(spark, self.root)

    def latest(self) -> int:
        return self.log.latest() if self.version is None else self.version

    def _state(self) -> dict:
        return self.log.read(self.latest()) or {"segments": [], "gone": []}

    def _commit(self, base: int, state: dict) -> None:
        self.log.commit(base + 1, state)

    def append(self, rows: DataFrame, replace: bool = False) -> None:
        """Index rows (id, content, wing, room, and columns for filters). replace: instead of their ids' rows before."""
        base, state = self.latest(), self._state()
        number, path = base + 1, f"segment-{uuid.uuid4().hex}"
        rows = rows.filter(F.col("id").isNotNull()).withColumn("id", F.col("id").cast("long"))
        length = reduce(lambda a, b: a + b, [F.coalesce(F.greatest(F.length(c) - 2, F.lit(0)), F.lit(0)) for c in FIELDS])
        rows.select("id", length.cast("double").alias("d"), *[c for c in rows.columns if c not in ("id", "content")]).write.parquet(f"{self.root}/{path}/docs")
        docs = self.spark.read.parquet(f"{self.root}/{path}/docs")
        if docs.groupBy("id").count().filter("count > 1").limit(1).count():
            raise StoreError("STORAGE_DUPLICATE", "an id stands in several rows")
        lists = rows.select("id", *[F.lower(c).alias(c) for c in FIELDS]).mapInArrow(_postings, POSTINGS)
        # rebalancing splits a folder's rows into files of even size, whatever their number
        lists.hint("rebalance", F.col("part")).sortWithinPartitions("part", "gram").write.partitionBy("part").option("compression", "zstd").parquet(f"{self.root}/{path}/postings")
        gone = state["gone"]
        if replace and state["segments"]:
            docs.select("id").write.parquet(f"{self.root}/{path}/gone")
            gone = [*gone, [f"{path}/gone", number - 0.5]]
        self._commit(base, {"segments": [*state["segments"], [path, number]], "gone": gone, "schema": docs.schema.jsonValue()})

    def remove(self, ids: DataFrame) -> None:
        """Take rows (id) out of all segments written so far."""
        base, state = self.latest(), self._state()
        path = f"gone-{uuid.uuid4().hex}"
        ids.select(F.col("id").cast("long").alias("id")).filter("id is not null").distinct().write.parquet(f"{self.root}/{path}")
        self._commit(base, {**state, "gone": [*state["gone"], [path, base + 1]]})

    def documents(self) -> DataFrame:
        """(id, d, columns for filters, segment) of the rows that are there."""
        state = self._state()
        if not state["segments"]:
            raise StoreError("STORAGE_READ_FAILED", "nothing is indexed")
        schema = StructType.fromJson(state["schema"])
        docs = reduce(DataFrame.unionByName, [self.spark.read.schema(schema).parquet(f"{self.root}/{p}/docs").withColumn("segment", F.lit(n)) for p, n in state["segments"]])
        if not state["gone"]:
            return docs
        gone = reduce(DataFrame.unionByName, [self.spark.read.parquet(f"{self.root}/{p}").withColumn("until", F.lit(float(n))) for p, n in state["gone"]])
        last = gone.groupBy("id").agg(F.max("until").alias("until"))
        return docs.join(last, "id", "left").filter("until is null or until < segment").drop("until")

    def _lists(self, wanted: Column) -> DataFrame:
        lists = [self.spark.read.schema(POSTINGS).parquet(f"{self.root}/{p}/postings").filter(wanted).withColumn("segment", F.lit(n)) for p, n in self._state()["segments"]]
        return reduce(DataFrame.unionByName, lists)

    def postings(self, terms: list[str]) -> DataFrame:
        """The posting lists that phrases need, from their folders only."""
        grams = sorted({g for t in terms for _, g in cover(t)})
        return self._lists(F.col("part").isin(sorted({g % PARTS for g in grams})) & F.col("gram").isin(grams))

    def frequencies(self, terms: list[str]) -> DataFrame:
        """(segment, id, f): how often each phrase stands in each document that has one of them."""
        count = _counter(terms)

        def run(key: tuple, t: pa.Table) -> pa.Table:
            out = count(t)
            return out.append_column("segment", pa.array([key[0].as_py()] * len(out), pa.int32()))

        lists = self.postings(terms).union(self._lists(F.col("part") == PARTS))
        return lists.groupBy("segment", "block").applyInArrow(run, "id long, f array<int>, segment int")

    def search(self, terms: list[str], k: int | None = 20, where: Column | None = None) -> DataFrame:
        """As search.search_bm25, without the texts: (id, bm25, score_compat, rank if k, columns for filters)."""
        terms = [t.lower() for t in terms if len(t) >= 3]
        docs = self.documents()
        if not terms:
            hits = docs.withColumn("f", F.array().cast("array<int>")).limit(0)
        else:
            hits = docs.join(self.frequencies(terms), ["segment", "id"])
        each = hits.select("*", *[F.col("f")[i].alias(f"f{i}") for i in range(len(terms))])
        stats = docs.agg(F.count("*").alias("n"), F.avg("d").alias("avgdl"))
        found = each.agg(F.count("*").alias("hits"), *[F.count_if(F.col(f"f{i}") > 0).alias(f"n{i}") for i in range(len(terms))])
        scored = bm25(each.join(F.broadcast(stats.join(found))), len(terms))
        out = (scored if where is None else scored.filter(where)).drop("f", "n", "avgdl", "hits", "segment", *[f"{c}{i}" for i in range(len(terms)) for c in "fn"])
        return out if k is None else ranked(out, k, F.desc("bm25"), F.asc("id"))
