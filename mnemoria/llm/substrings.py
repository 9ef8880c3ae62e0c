"""Removal of long strings that occur more than once, by sorted suffixes around shared anchors.

A byte goes if a WINDOW-byte string that covers it also starts anywhere else. Each window owns the
smallest hash of its GRAM-byte grams (the leftmost of equal ones), so equal windows own an equal gram at
the same place: its anchor. The windows of one anchor occurrence are consecutive, and the bytes that they
cover are its context. Anchors whose gram occurs once have no repeated window. Equal contexts (by a
128-bit hash of their bytes) are one class with a count. Where an anchor has several classes, the suffixes
that start at the anchor and the reversed prefixes before it are put in order by deep-shallow sorting;
common prefixes with the neighbours then say for which windows two classes agree.

No more than HOT_CLASSES classes are sorted together. An anchor with more of them, as in a passage that
stands in ever new surroundings, is refined: its windows fall into parts of WIDTHS[0] starts, and a part
goes by the bytes that all its windows have in common, as equal windows do. Parts with equal bytes are
one class again, so windows inside the passage need no sorting, and surroundings that differ part ways.
What is still hot is cut into narrower parts, down to single windows, where equal keys are equal strings.

Defined cases: a null text is the empty text; a text shorter than the window loses nothing; a repeated
row is a document of its own, so all of its windows are repeated; no rows give no rows; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, arrow_stream, bytes_of, forget, materialize, read
from .suffixsort import deep_shallow, sorted_lcps

WINDOW, GRAM = 400, 200
SPAN = WINDOW - GRAM  # a window starts 0 to SPAN bytes before its anchor
#: Windows handled at a time; longer texts are cut between windows, which changes no anchor.
CHUNK = 1 << 22
HOT_CLASSES = 2048
#: Starts of windows that share one key when a hot anchor is refined, round by round.
WIDTHS = (64, 16, 4, 1)
#: Groups up to this size are compared by pairs, larger ones offset by offset.
SMALL_GROUP = 24

_BASE = 0x5851F42D4C957F2D
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTES = np.random.default_rng(4004).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_powers: dict[int, np.ndarray] = {}
_POSITION = np.uint64((1 << 23) - 1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(12, (n - 1).bit_length())
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        have = _powers[base] = np.cumprod(steps)
    return have[:n]


def digest(context: bytes | memoryview, first: int) -> bytes:
    """128 bits that name a context whose first window starts `first` bytes from the anchor."""
    return xxhash.xxh3_128_digest(context, seed=-first)


def anchors_of(raw: bytes) -> tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """For each anchor of a text: its gram's hash, its context's digest, its place, first and last window."""
    parts = []
    for at in range(0, len(raw) - WINDOW + 1, CHUNK):
        b = np.frombuffer(raw, np.uint8, min(CHUNK + WINDOW - 1, len(raw) - at), at)
        n = len(b)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTES[b] * _power(_BASE, n), out=sums[1:])
        inverse = _power(_INVERSE, n + 1)
        grams = _mix((sums[GRAM:] - sums[:-GRAM]) * inverse[: n - GRAM + 1])
        ranked = (grams & ~_POSITION) | np.arange(len(grams), dtype=np.uint64)
        # sliding minimum over SPAN + 1 grams: of the rest of a block and of the start of the next
        w = SPAN + 1
        padded = np.full(-(-len(ranked) // w) * w, np.uint64(0xFFFFFFFFFFFFFFFF))
        padded[: len(ranked)] = ranked
        block = padded.reshape(-1, w)
        ahead = np.minimum.accumulate(block, axis=1).ravel()
        behind = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
        windows = n - WINDOW + 1
        owner = (np.minimum(behind[:windows], ahead[w - 1 : w - 1 + windows]) & _POSITION).astype(np.int64)
        first = np.concatenate([[0], np.flatnonzero(np.diff(owner)) + 1])
        last = np.concatenate([first[1:] - 1, [windows - 1]])
        place = owner[first]
        parts.append((grams[place].view(np.int64), place + at, first + at, last + at))
    grams, place, first, last = (np.concatenate(x) if parts else np.zeros(0, np.int64) for x in (zip(*parts, strict=True) if parts else [[]] * 4))
    view = memoryview(raw)
    return grams, [digest(view[a : b + WINDOW], a - q) for a, b, q in zip(first.tolist(), last.tolist(), place.tolist(), strict=True)], place, first, last


def repeated_windows(group: list[tuple[int, int, int, bytes]]) -> list[list[tuple[int, int]]]:
    """Which windows of each class are repeated.

    A class is (count, first window, last window, context), windows relative to the anchor (-SPAN to 0).
    The answer has ranges (first, last) of repeated windows, relative too. Two classes share the windows
    whose bytes before the anchor are in their common suffix there and whose other bytes are in the
    common prefix from the anchor on.
    """
    done = [[(a, b)] if n > 1 else [] for n, a, b, _ in group]
    if len(group) == 1:
        return done
    right = [c[-a:] for _, a, _, c in group]
    left = [c[:-a][::-1] if a else b"" for _, a, _, c in group]
    orders = [deep_shallow(left), deep_shallow(right)]
    common = [sorted_lcps(s, o) for s, o in zip((left, right), orders, strict=True)]
    ranks = [np.empty(len(group), np.int64), np.empty(len(group), np.int64)]
    for r, o in zip(ranks, orders, strict=True):
        r[o] = np.arange(len(group))
    if len(group) <= SMALL_GROUP:

        def shared(k: int, x: int, y: int) -> int:
            i, j = sorted((int(ranks[k][x]), int(ranks[k][y])))
            return min(common[k][i + 1 : j + 1])

        for x in range(len(group)):
            for y in range(x):
                before, after = shared(0, x, y), shared(1, x, y)
                a = max(-before, group[x][1], group[y][1])
                b = min(after - WINDOW, group[x][2], group[y][2])
                if a <= b:
                    done[x].append((a, b))
                    done[y].append((a, b))
        return done
    first, last = np.array([g[1] for g in group]), np.array([g[2] for g in group])
    count = np.array([g[0] for g in group])
    lcp_left, lcp_right = np.array(common[0]), np.array(common[1])
    for start in range(-SPAN, 1):
        inside = np.flatnonzero((first <= start) & (start <= last) & (count == 1))
        if not len(inside):
            continue
        whole = np.flatnonzero((first <= start) & (start <= last))
        kinds = np.cumsum(lcp_left < -start)[ranks[0][whole]] * (len(group) + 1) + np.cumsum(lcp_right < start + WINDOW)[ranks[1][whole]]
        _, which, n = np.unique(kinds, return_inverse=True, return_counts=True)
        for k in whole[(n[which] > 1) & (count[whole] == 1)]:
            ranges = done[k]
            if ranges and ranges[-1][1] == start - 1:
                ranges[-1] = (ranges[-1][0], start)
            else:
                ranges.append((start, start))
    return done


def _anchor_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, th, h, ctx, place, first, last)"""
    names = ["doc_id", "th", "h", "ctx", "place", "first", "last"]

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        found = [anchors_of(raw) for raw in bytes_of(batch.column(2))]
        times = np.array([len(f[0]) for f in found], np.int64)
        index = pa.array(np.repeat(np.arange(len(found)), times))
        cols = [np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in (0, 2, 3, 4)]
        yield pa.RecordBatch.from_arrays([batch.column(0).take(index), batch.column(1).take(index), pa.array(cols[0]), pa.array([d for f in found for d in f[1]], pa.binary()), *(pa.array(c.astype(np.int32)) for c in cols[1:])], names)

    return arrow_map(docs.select("doc_id", "th", "text"), run, "doc_id long, th long, h long, ctx binary, place int, first int, last int")


_CLASS = "key long, tag binary, n long, first int, last int, context binary"
_CLASS_KINDS = {"key": pa.int64(), "tag": pa.binary(), "n": pa.int64(), "first": pa.int32(), "last": pa.int32(), "context": pa.binary()}


def _context_rows(texts: DataFrame) -> DataFrame:
    """(text, items) -> (key, tag, n, first, last, context, hot): the classes of anchors, with their bytes."""
    kinds = {**_CLASS_KINDS, "hot": pa.bool_()}

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows = []
        for raw, items in zip(bytes_of(batch.column(0)), batch.column(1).to_pylist(), strict=True):
            for x in items:
                q, a, b = x["place"], x["first"], x["last"]
                rows.append((x["h"], x["ctx"], x["n"], a - q, b - q, raw[a : b + WINDOW], x["classes"] > HOT_CLASSES))
        cols = zip(*rows, strict=True) if rows else [()] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds.values(), strict=True)], list(kinds))

    return arrow_map(texts.select("text", "items"), run, f"{_CLASS}, hot boolean")


def _parts(classes: DataFrame, width: int) -> DataFrame:
    """Classes (h, ctx, n, first, last, context) cut into parts: (h, ctx) and a class of _CLASS.

    A part has `width` neighbouring starts of windows; its key is made of the bytes that they all cover.
    """
    kinds = {"h": pa.int64(), "ctx": pa.binary(), **_CLASS_KINDS}

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows = []
        for h, ctx, n, first, last, context in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            for part in range(-last // width, -first // width + 1):
                high, low = -part * width, -part * width - width + 1
                core = context[high - first : low + WINDOW - first]
                key = xxhash.xxh3_64_intdigest(core, seed=part) ^ (h & (1 << 64) - 1)
                a, b = max(first, low), min(last, high)
                own = context[a - first : b + WINDOW - first]
                rows.append((h, ctx, key - (1 << 64) if key >> 63 else key, digest(own, a), n, a, b, own))
        cols = zip(*rows, strict=True) if rows else [()] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds.values(), strict=True)], list(kinds))

    return arrow_map(classes.select("h", "ctx", "n", "first", "last", "context"), run, f"h long, ctx binary, {_CLASS}")


def _sorted_groups(classes: DataFrame) -> DataFrame:
    """(key, tag, from, to) from classes of _CLASS, no more than HOT_CLASSES of a key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, out = None, [], []

        def close() -> None:
            for (tag, *_), ranges in zip(held, repeated_windows([x[1:] for x in held]), strict=True):
                out.extend((key, tag, a, b) for a, b in ranges)

        def batch_of() -> pa.RecordBatch:
            cols = zip(*out, strict=True) if out else [()] * 4
            made = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.binary(), pa.int32(), pa.int32()), strict=True)], ["key", "tag", "from", "to"])
            out.clear()
            return made

        for batch in batches:
            for k, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if k != key:
                    if held:
                        close()
                    key, held = k, []
                held.append(row)
            yield batch_of()
        if held:
            close()
        yield batch_of()

    ordered = classes.select(*_CLASS_KINDS).repartition("key").sortWithinPartitions("key")
    return arrow_stream(ordered, run, "key long, tag binary, from int, to int")


def _refined(hot: DataFrame) -> DataFrame | None:
    """(h, ctx, from, to) of the repeated windows of hot anchors' classes (h, ctx, n, first, last, context)."""
    found: DataFrame | None = None
    for width in WIDTHS:
        parts = materialize(_parts(hot, width), "parts")
        alike = parts.groupBy("key", "tag").agg(F.sum("n").alias("n"), F.first(F.struct("first", "last", "context")).alias("one"))
        alike = materialize(alike.select("key", "tag", "n", "one.*"), "alike")
        # both sides of a join on a hot key are plain tables, so that a skewed join can split it
        several = materialize(alike.groupBy("key").agg(F.count("*").alias("classes")), "several")
        classes = materialize(alike.join(several, "key"), "classes")
        alone = classes.filter("classes = 1 and n > 1").select("key", "tag", F.col("first").alias("from"), F.col("last").alias("to"))
        done = alone.union(_sorted_groups(classes.filter((F.col("classes") > 1) & (F.col("classes") <= HOT_CLASSES))))
        done = materialize(done.groupBy("key", "tag").agg(F.collect_set(F.struct("from", "to")).alias("ranges")), "windows")
        here = materialize(parts.join(done, ["key", "tag"]).select("h", "ctx", F.explode("ranges").alias("r")).select("h", "ctx", "r.*"), "refined")
        found = here if found is None else found.union(here)
        forget(alike, classes, done)
        still = several.filter(F.col("classes") > HOT_CLASSES)
        if width == 1 or still.isEmpty():
            break
        hot = materialize(parts.join(still.select("key"), "key").select("h", "ctx", "n", "first", "last", "context"), "hot")
        forget(parts, several)
    return found


def _cut(texts: DataFrame) -> DataFrame:
    """(doc_id, th, text, spans) -> (doc_id, th, n_removed, n_spans, kept, kept_sha256): spans are [from, to)."""
    names = ["doc_id", "th", "n_removed", "n_spans", "kept", "kept_sha256"]

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows = []
        for raw, spans in zip(bytes_of(batch.column(2)), batch.column(3).to_pylist(), strict=True):
            parts, at, n_spans = [], 0, 0
            for a, b in sorted((s["from"], s["to"]) for s in spans):
                if a > at or not n_spans:
                    n_spans += 1
                    parts.append(raw[at:a])
                at = max(at, b)
            kept = b"".join([*parts, raw[at:]])
            rows.append((len(raw) - len(kept), n_spans, kept, hashlib.sha256(kept).hexdigest()))
        cols = zip(*rows, strict=True) if rows else [()] * 4
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.binary(), pa.string()), strict=True))], names)

    return arrow_map(texts.select("doc_id", "th", "text", "spans"), run, "doc_id long, th long, n_removed long, n_spans long, kept binary, kept_sha256 string")


def repeated_spans(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs: (doc_id, th, text). The removed spans by (doc_id, th), and the texts that have any anchor in common."""
    # both sides of a join on a hot key are plain tables, so that a skewed join can split it
    every = materialize(_anchor_rows(docs), "anchors")
    often = materialize(every.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h"), "often")
    rows = materialize(every.join(often, "h").select(*every.columns), "repeated")
    forget(every, often)
    ids = rows.select("doc_id", "th").distinct()
    same = lambda a, b: a["doc_id"].eqNullSafe(b["doc_id"]) & (a["th"] == b["th"])
    texts = materialize(docs.join(ids, same(docs, ids), "left_semi"), "texts")

    rep = F.min(F.struct("doc_id", "th", "place", "first", "last")).alias("rep")
    alike = materialize(rows.groupBy("h", "ctx").agg(F.count("*").alias("n"), rep), "alike")
    several = materialize(alike.groupBy("h").agg(F.count("*").alias("classes")), "several")
    classes = materialize(alike.join(several, "h"), "classes")
    forget(alike, several)
    # an anchor with one class of contexts: its windows are all repeated
    alone = classes.filter("classes = 1 and n > 1").select("h", "ctx", (F.col("rep.first") - F.col("rep.place")).alias("from"), (F.col("rep.last") - F.col("rep.place")).alias("to"))
    item = F.struct("h", "ctx", "n", "classes", "rep.place", "rep.first", "rep.last")
    items = classes.filter("classes > 1").groupBy(F.col("rep.doc_id").alias("doc_id"), F.col("rep.th").alias("th")).agg(F.collect_list(item).alias("items"))
    one = texts.dropDuplicates(["doc_id", "th"])
    contexts = materialize(_context_rows(one.join(items, same(one, items)).select("text", "items")), "contexts")
    found = alone.union(_sorted_groups(contexts.filter("not hot")))
    hot = contexts.filter("hot")
    if not hot.isEmpty():
        found = found.union(_refined(hot.withColumnsRenamed({"key": "h", "tag": "ctx"})))
    found = materialize(found.groupBy("h", "ctx").agg(F.collect_set(F.struct("from", "to")).alias("ranges")), "windows")
    forget(classes, contexts)

    hits = rows.join(found, ["h", "ctx"]).select("doc_id", "th", "place", F.explode("ranges").alias("r"))
    span = F.struct((F.col("place") + F.col("r.from")).alias("from"), (F.col("place") + F.col("r.to") + WINDOW).alias("to"))
    return hits.groupBy("doc_id", "th").agg(F.collect_set(span).alias("spans")), texts


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept), one row for each row of docs.

    kept is null where nothing is removed: the text stands as it is.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))
    spans, texts = repeated_spans(docs)
    one = texts.dropDuplicates(["doc_id", "th"])
    cut = _cut(one.join(spans, one["doc_id"].eqNullSafe(spans["doc_id"]) & (one["th"] == spans["th"])).select(one["doc_id"], one["th"], "text", "spans"))
    every = docs.select("doc_id", "th", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("sha"))
    none = F.lit(0).cast("long")
    return every.join(cut, every["doc_id"].eqNullSafe(cut["doc_id"]) & (every["th"] == cut["th"]), "left").select(
        every["doc_id"], "n_bytes", F.coalesce("n_removed", none).alias("n_removed"), F.coalesce("n_spans", none).alias("n_spans"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"), "kept"
    )


def op4_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read(spark, sf_dir, "documents")).drop("kept")
