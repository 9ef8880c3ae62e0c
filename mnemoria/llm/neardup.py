"""Near-duplicate groups: universal hash minima, banding, signature and exact verification, components.

Words are runs without ASCII white space, A-Z lower-cased. A document's set holds its distinct shingles
(as 64-bit hashes); a shorter text is one shingle; no words, no set. Texts of one word sequence are one
class, stood for by its smallest id. Classes that agree on all rows of a band share a bucket. Inside
buckets, the pivot (the member that shares most buckets) is tried against every other member; this
settles most groups with as many pairs as they have members. A bucket whose members are all of one
component then needs no more pairs. Members of the other buckets are open: their shingles are put in
one order, rarest first, and only open texts of different components that share a shingle among the
first few of both are tried. How few follows from the threshold: a linked pair cannot miss all of
them, nor have them so late that what comes after is too little. So no link between open texts is
lost, and texts just below the threshold, whose rare shingles differ, are not tried pair by pair. A
pair is first held against its signatures, then confirmed on the full sets.

With 32 bands of 5 rows a pair at the threshold shares no bucket with probability 3e-6.

Defined cases: null or empty text, or white space alone: empty set, n_shingles 0, its own component;
a null id is never linked; rows that repeat an id are one document, and if their texts differ, the words
of the smallest key stand for it; no rows give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_map, arrow_stream, bytes_of, materialize, read
from .components import connected_components

BANDS, ROWS = 32, 5
#: A pair whose signatures agree on less than threshold - SIGMAS standard deviations is dropped.
SIGMAS = 5.5
#: Shingles in one Arrow batch, or one text's.
SHINGLES_PER_BATCH = 100_000
#: Words whose hashes a worker keeps.
MEMO_WORDS = 200_000

_MUL = np.uint64(0x9E3779B97F4A7C15)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_words: dict[bytes, int] = {}


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def words_of(raw: bytes) -> list[bytes]:
    """Words of a UTF-8 text: bytes.lower changes A-Z alone, bytes.split cuts at ASCII white space."""
    return raw.lower().split()


def shingle_set(words: list[bytes], size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles."""
    if not words:
        return np.zeros(0, np.uint64)
    fresh = set(words).difference(_words)
    _words.update((w, xxhash.xxh3_64_intdigest(w)) for w in fresh)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    if len(_words) > MEMO_WORDS:
        _words.clear()
    size = min(size, len(h))
    code = np.full(len(h) - size + 1, size, np.uint64)
    for k in range(size):
        code = code * _MUL + h[k : len(h) - size + 1 + k]
    return np.unique(_mix(code))


def universal_hashes(bands: int = BANDS, rows: int = ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers (odd) and summands of the hash functions a * x + b modulo 2 ** 32."""
    rng = np.random.default_rng(20240229)
    a = rng.integers(0, 1 << 31, bands * rows, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    return a, rng.integers(0, 1 << 32, bands * rows, dtype=np.uint32)


def minima(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for k in range(0, len(x), 2048):
        part = a[:, None] * x[None, k : k + 2048]
        part += b[:, None]
        np.minimum(least, part.min(axis=1), out=least)
    return least


def profiles(docs: DataFrame, size: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, key, n_shingles, bands, sig): key names the word sequence, sig has 8 bits of each minimum."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        a, b = universal_hashes()
        salt = np.arange(1, BANDS + 1, dtype=np.uint64) * _MIX1
        seen: dict[bytes, tuple] = {}
        rows = []
        for raw in bytes_of(batch.column(1)):
            words = words_of(raw)
            key = xxhash.xxh3_128_digest(b" ".join(words)) if words else None
            if key not in seen:
                s = shingle_set(words, size)
                if len(s):
                    m = minima(s, a, b)
                    code = salt.copy()
                    for r in range(ROWS):
                        code = code * _MUL + m[r::ROWS]
                    seen[key] = (key, len(s), _mix(code).view(np.int64), (m & np.uint32(255)).astype(np.uint8).tobytes())
                else:
                    seen[key] = (None, 0, None, None)
            rows.append(seen[key])
        keys, n, bands, sigs = zip(*rows, strict=True) if rows else ((),) * 4
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(keys, pa.binary()), pa.array(n, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(sigs, pa.binary())], ["doc_id", "key", "n_shingles", "bands", "sig"])

    return arrow_map(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), run, "doc_id long, key binary, n_shingles long, bands array<long>, sig binary")


def _with_keys(texts: DataFrame) -> DataFrame:
    """(doc_id, text) -> (doc_id, key, text), with the keys of `profiles`."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        words = [words_of(raw) for raw in bytes_of(batch.column(1))]
        keys = [xxhash.xxh3_128_digest(b" ".join(w)) if w else None for w in words]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), batch.column(1)], ["doc_id", "key", "text"])

    return arrow_map(texts, run, "doc_id long, key binary, text string")


def _signature_filter(pairs: DataFrame, percent: int) -> DataFrame:
    """(u, v, su, sv) -> (u, v) of the pairs whose signatures do not rule the link out."""
    n = BANDS * ROWS
    t = percent / 100
    least = (t - SIGMAS * (t * (1 - t) / n) ** 0.5) * n

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        su, sv = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, n) for k in (2, 3))
        keep = pa.array((su == sv).sum(axis=1) >= least)
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["u", "v"])

    return arrow_map(pairs, run, "u long, v long")


def _exact_filter(pairs: DataFrame, size: int, percent: int) -> DataFrame:
    """(u, v, tu, tv) -> the linked (u, v), on the full sets; v's set is kept while v repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, None
        for batch in batches:
            ids, keep = batch.column(1).to_pylist(), []
            for v, tu, tv in zip(ids, bytes_of(batch.column(2)), bytes_of(batch.column(3)), strict=True):
                if v != last or held is None:
                    last, held = v, shingle_set(words_of(tv), size)
                other = shingle_set(words_of(tu), size)
                both = len(np.intersect1d(other, held, assume_unique=True))
                keep.append(100 * both >= percent * (len(other) + len(held) - both))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["u", "v"])

    return arrow_stream(pairs, run, "u long, v long")


def _exploded(texts: DataFrame, size: int) -> DataFrame:
    """(doc, n, shingle): one row for each shingle of each text; n is the size of its set."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        docs, sets, held = [], [], 0

        def out() -> pa.RecordBatch:
            n = np.array([len(s) for s in sets], np.int64)
            doc = np.repeat(np.array(docs, np.int64), n)
            return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(np.repeat(n, n)), pa.array(np.concatenate(sets).view(np.int64))], ["doc", "n", "shingle"])

        for doc, raw in zip(batch.column(0).to_pylist(), bytes_of(batch.column(1)), strict=True):
            docs.append(doc)
            sets.append(shingle_set(words_of(raw), size))
            held += len(sets[-1])
            if held > SHINGLES_PER_BATCH:
                yield out()
                docs, sets, held = [], [], 0
        if docs:
            yield out()

    return arrow_map(texts.select("doc_id", "text"), run, "doc long, n long, shingle long")


def _prefixes(exploded: DataFrame, percent: int) -> DataFrame:
    """(doc, n, shingle, pos): shingles of two texts at least, rarest first, as far as a linked pair needs.

    A linked pair shares percent of each of its sets, so its first common shingle has at least that much
    of either set at or after it. Shingles of one text come first of all and take part in no pair.
    """
    shared = exploded.groupBy("shingle").agg(F.count("*").alias("df")).filter("df > 1")
    own = Window.partitionBy("doc")
    placed = exploded.join(shared, "shingle").withColumn("pos", F.col("n") - F.count("*").over(own) + F.row_number().over(own.orderBy("df", "shingle")) - 1)
    return placed.filter(100 * (F.col("n") - F.col("pos")) >= percent * F.col("n")).select("doc", "n", "shingle", "pos")


def _mixed(entries: DataFrame) -> DataFrame:
    """(shingle, main, least): shingles of several components, the one of most entries, the smallest set's size."""
    each = entries.groupBy("shingle", "comp").agg(F.count("*").alias("k"), F.min("n").alias("least"))
    found = each.groupBy("shingle").agg(F.max(F.struct("k", "comp")).alias("top"), F.min("least").alias("least"), F.count("*").alias("comps"))
    return found.filter("comps > 1").select("shingle", F.col("top.comp").alias("main"), "least")


def _prefix_pairs(entries: DataFrame, percent: int) -> DataFrame:
    """(u, v) of different components that share a shingle of (doc, comp, n, shingle, pos) early enough.

    The common part holds at least percent / (100 + percent) of the sizes' sum and lies at or after the
    first common shingle. Of two components one at least is not the shingle's main one, so the members
    of the main component are never held against each other.
    """

    def enough(rest: Column, sizes: Column) -> Column:
        return rest * (100 + percent) >= sizes * percent

    other = F.greatest("least", F.ceil(F.col("n") * percent / 100))
    early = entries.join(_mixed(entries), "shingle").filter(enough(F.col("n") - F.col("pos"), F.col("n") + other))
    early = materialize(early.select(*entries.columns), "early")
    both = early.join(_mixed(early), "shingle")
    a, b = both.filter("comp <> main").alias("a"), both.alias("b")
    same = (F.col("a.shingle") == F.col("b.shingle")) & (F.col("a.comp") != F.col("b.comp"))
    once = (F.col("b.comp") == F.col("b.main")) | (F.col("a.doc") < F.col("b.doc"))
    near = 100 * F.least("a.n", "b.n") >= percent * F.greatest("a.n", "b.n")
    rest = F.least(F.col("a.n") - F.col("a.pos"), F.col("b.n") - F.col("b.pos"))
    joined = a.join(b, same & once & near & enough(rest, F.col("a.n") + F.col("b.n")))
    return joined.select(F.least("a.doc", "b.doc").alias("u"), F.greatest("a.doc", "b.doc").alias("v")).distinct()


def links(prof: DataFrame, docs: DataFrame, size: int, percent: int, id_col: str, text_col: str) -> DataFrame | None:
    """(node, component) over the classes' representatives; None if no two texts share a bucket."""
    classes = prof.filter("key is not null and doc_id is not null and key = own_key").groupBy("key").agg(F.min("doc_id").alias("doc_id"))
    prof = prof.filter("key = own_key")
    reps = prof.join(classes.select("doc_id").distinct().hint("merge"), "doc_id", "left_semi")
    banded = reps.select(F.col("doc_id").alias("doc"), F.explode("bands").alias("bucket")).distinct()
    shared = banded.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    members = materialize(banded.join(shared, "bucket"), "members")
    if members.isEmpty():
        return None
    degree = members.groupBy("doc").agg(F.sum("n").alias("degree"))
    members = materialize(members.join(degree, "doc").select("bucket", "doc", "degree"), "members")
    sought = members.select(F.col("doc").alias("doc_id")).distinct()
    # the same plan at every size: a small list of ids is not broadcast where a large one would not be
    sigs = materialize(prof.join(sought.hint("merge"), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("sig").alias("sig"), F.min("n_shingles").alias("n")), "sigs")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).join(sought.hint("merge"), "doc_id", "left_semi")
    # an id's text is the one that its key names
    named = _with_keys(texts).join(prof.select("doc_id", "key").distinct().hint("merge"), ["doc_id", "key"], "left_semi")
    texts = materialize(named.select("doc_id", "text").dropDuplicates(["doc_id"]), "texts")

    def linked(pairs: DataFrame) -> DataFrame:
        """The linked ones of the pairs (u, v), by signatures and then by full sets."""
        s = sigs.select(F.col("doc_id").alias("u"), F.col("sig").alias("su"), F.col("n").alias("nu"))
        t = sigs.select(F.col("doc_id").alias("v"), F.col("sig").alias("sv"), F.col("n").alias("nv"))
        likely = pairs.join(s, "u").join(t, "v").filter(100 * F.least("nu", "nv") >= percent * F.greatest("nu", "nv"))
        likely = _signature_filter(likely.select("u", "v", "su", "sv"), percent)
        a = texts.select(F.col("doc_id").alias("u"), F.col("text").alias("tu"))
        b = texts.select(F.col("doc_id").alias("v"), F.col("text").alias("tv"))
        return materialize(_exact_filter(likely.join(a, "u").join(b, "v").select("u", "v", "tu", "tv"), size, percent), "links")

    top = members.groupBy("bucket").agg(F.max(F.struct("degree", (-F.col("doc")).alias("neg"))).alias("top"))
    pivots = top.select("bucket", (-F.col("top.neg")).alias("pivot"))
    # the pivot is v: rows of one pivot come together when the texts are joined
    tried = members.join(pivots, "bucket").filter("doc <> pivot").select(F.col("doc").alias("u"), F.col("pivot").alias("v")).distinct()
    edges = linked(tried)
    comps = connected_components(edges)

    current = members.join(comps.withColumnRenamed("node", "doc"), "doc", "left").select("bucket", "doc", F.coalesce("component", "doc").alias("comp"))
    mixed = current.groupBy("bucket").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).filter("a <> b").select("bucket")
    left = materialize(current.join(mixed.hint("merge"), "bucket", "left_semi").select("doc", "comp").distinct(), "open")
    if left.isEmpty():
        return comps
    sought = left.select(F.col("doc").alias("doc_id")).hint("merge")
    exploded = materialize(_exploded(texts.join(sought, "doc_id", "left_semi"), size), "shingles")
    entries = materialize(_prefixes(exploded, percent).join(left.hint("merge"), "doc"), "prefixes")
    more = linked(materialize(_prefix_pairs(entries, percent), "pairs"))
    return comps if more.isEmpty() else connected_components(edges.union(more))


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row for each row of docs."""
    prof = materialize(profiles(docs, size, id_col, text_col), "profiles")
    each = prof.filter("key is not null and doc_id is not null").groupBy("doc_id").agg(F.min("key").alias("first"), F.max("key").alias("last"))
    odd = materialize(each.filter("first <> last").select("doc_id", "first"), "odd")
    prof = prof.join(odd, "doc_id", "left").withColumn("own_key", F.col("key")).withColumn("key", F.coalesce("first", "key")).drop("first")
    comps = links(prof, docs, size, percent, id_col, text_col)
    classes = prof.filter("key is not null and doc_id is not null").groupBy("key").agg(F.min("doc_id").alias("rep"))
    if comps is not None:
        classes = classes.join(comps.withColumnRenamed("node", "rep"), "rep", "left").select("key", F.coalesce("component", "rep").alias("rep"))
    # a hot key is on the left side only, where a skewed join splits it
    out = prof.select("doc_id", "key", "n_shingles").join(classes, "key", "left")
    component = F.coalesce(F.when(F.col("doc_id").isNotNull(), F.col("rep")), F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def op2_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"), size=4, percent=80)
