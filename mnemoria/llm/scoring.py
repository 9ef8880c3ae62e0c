"""Language-model scores: context-tree weighting over bytes, and a word unigram base.

The tree has all contexts of 0 to DEPTH bytes. A byte is eight binary decisions, and every (context,
decision) is a node with a Krichevsky-Trofimov estimator. Weighting is done exactly, bottom-up, on the
counts of the whole training part: P_w = (P_e + product of the children's P_w) / 2. To score, the
estimates of a byte's contexts are mixed along the path with the weights P_e / (2 P_w); a node never
seen predicts 1/2. Contexts of the last two bytes are kept together, so that each task weights whole
subtrees. The weighted nodes of depth 2 and more stay in a table, by bucket of the last two bytes; those
of depths 0 and 1 (65,536 at most for each) are broadcast. A block of documents asks for its distinct
codes, bucket by bucket, and adds up the answers along its texts, which it carries compressed.

Words are known by 64-bit hashes. Counts of words that make up more than a HOT_WORDS-th of all tokens
(HOT_WORDS words at most) are broadcast; a block asks for the counts of its other distinct words where
their bucket of the vocabulary is.

Defined cases: a null text is the empty text (the end token alone); without training documents every
base probability is 1 and each byte has 8 bits; repeated rows are learned from and scored as often as
they occur; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blobs import SCHEMA, add_up, merge, pack, unpack, unzip_bytes, unzip_keys, unzip_numbers, zip_bytes, zip_keys, zip_numbers
from .common import arrow_map, arrow_stream, bytes_of, id_bucket, materialize, read

#: Bytes of the longest context: 2 to 7.
DEPTH = 5
HOT_WORDS = 200_000
#: Bytes of text in a block, about.
BLOCK_BYTES = 12_000_000
#: Ends a text; no UTF-8 text has this byte.
END = b"\xff"
#: Elements that a task gathers before it adds them up.
GATHER = 4_000_000
#: Places of the worker's memo of scored (context, byte) pairs.
MEMO_BITS = 20
#: The end token's key among the words' hashes.
END_KEY = np.uint64(0xFFFFFFFFFFFFFFFF)

_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _lgamma(x: np.ndarray) -> np.ndarray:
    """ln Gamma for x > 0 by Stirling's series at x + 7."""
    shift = sum(np.log(x + k) for k in range(7))
    y = x + 7
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


def log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov probability of a zeros and b ones."""
    return _lgamma(a + 0.5) + _lgamma(b + 0.5) - math.log(math.pi) - _lgamma(a + b + 1)


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of (DEPTH bytes before, byte) for each byte and end of the texts, and where each text starts.

    The byte is the lowest 8 bits, the one before it the next; before a text there are zero bytes.
    """
    pad = b"\0" * DEPTH
    flat = np.frombuffer(b"".join(pad + t + END for t in texts), np.uint8).astype(np.uint64)
    code = np.zeros(len(flat) - DEPTH if texts else 0, np.uint64)
    for k in range(DEPTH + 1 if texts else 0):
        code = code << _U(8) | flat[k : len(flat) - DEPTH + k]
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    starts = np.cumsum(sizes + DEPTH) - sizes - DEPTH
    keep = np.ones(len(code), bool)
    for k in range(DEPTH):  # codes that end inside the padding of the next text
        keep[starts[1:] - DEPTH + k] = False
    return code[keep], np.cumsum(sizes) - sizes


def _decisions(code: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each of the eight decisions of a code's byte: the node's number (1 to 255) and the bit."""
    s = code & _U(255)
    for j in range(8):
        yield (_U(1) << _U(j)) | (s >> _U(8 - j)), (s >> _U(7 - j)) & _U(1)


def _parents(keys: np.ndarray, depth: int) -> np.ndarray:
    """Keys (context << 8 | node) of one level up: without the oldest byte of the context."""
    return keys & _U((1 << 8 * depth) - 1)


def weigh(codes: np.ndarray, n: np.ndarray, down_to: int) -> tuple[list[tuple[int, np.ndarray, np.ndarray, np.ndarray]], tuple[np.ndarray, np.ndarray]]:
    """Weighted nodes from counted codes: (depth, keys, (zeros, ones), weight) from DEPTH to down_to.

    The second result has what the level above needs: keys there and (zeros, ones, sum of ln P_w).
    """
    keys, vals = [], []
    for node, bit in _decisions(codes):
        keys.append((codes >> _U(8)) << _U(8) | node)
        vals.append(np.stack([n * (bit == 0), n * (bit == 1), np.zeros(len(n))], axis=1))
    keys, vals = add_up(np.concatenate(keys), np.concatenate(vals).astype(float))
    levels = []
    for depth in range(DEPTH, down_to - 1, -1):
        own = log_kt(vals[:, 0], vals[:, 1])
        if depth == DEPTH:
            weighted, weight = own, np.ones(len(own))
        else:
            weighted = np.logaddexp(own, vals[:, 2]) - math.log(2)
            weight = np.exp(own - math.log(2) - weighted)
        levels.append((depth, keys, vals[:, :2], weight))
        up = np.stack([vals[:, 0], vals[:, 1], weighted], axis=1)
        keys, vals = add_up(_parents(keys, depth) if depth else keys, up)
    return levels, (keys, vals)


def _code_bucket(codes: np.ndarray, bits: int) -> np.ndarray:
    """The last two bytes of the context keep a subtree together."""
    return (_mix((codes >> _U(8)) & _U(0xFFFF)) >> _U(64 - bits)).astype(np.int64)


Levels = dict[int, tuple[np.ndarray, np.ndarray]]


class Tree:
    """What scoring needs: P(1) and weight for all nodes of depth 0 and 1, and the table of the others."""

    def __init__(self, top_p: np.ndarray, top_w: np.ndarray, bits: int, nodes: DataFrame | None):
        self.top_p, self.top_w, self.bits, self.nodes = top_p, top_w, bits, nodes

    def without_nodes(self) -> Tree:
        return Tree(self.top_p, self.top_w, self.bits, None)

    def log10(self, codes: np.ndarray) -> np.ndarray:
        """log10 of each code's byte after its context; for few codes, reads their buckets' nodes."""
        out, bucket = np.zeros(len(codes)), _code_bucket(codes, self.bits)
        for b in np.unique(bucket).tolist():
            rows = self.nodes.filter(F.col("bucket") == b).select("kind", "keys", "vals").collect()
            levels = {int(r["kind"][1:]): unpack(bytes(r["keys"]), bytes(r["vals"])) for r in rows}
            out[bucket == b] = self.log10_in(levels, codes[bucket == b])
        return out

    def log10_in(self, levels: Levels, codes: np.ndarray) -> np.ndarray:
        """log10 for codes of one bucket: levels has the keys and (P(1), weight) of its nodes by depth."""
        total = np.zeros(len(codes))
        context = codes >> _U(8)
        for node, bit in _decisions(codes):
            key = context << _U(8) | node
            p = np.full(len(codes), 0.5)
            for depth in range(DEPTH, -1, -1):
                k = key & _U((1 << 8 * (depth + 1)) - 1)
                if depth < 2:
                    k = k + _U(depth << 16)
                    q, w = self.top_p[k], self.top_w[k]
                elif depth in levels and len(levels[depth][0]):
                    keys, vals = levels[depth]
                    at = np.minimum(np.searchsorted(keys, k), len(keys) - 1)
                    q, w = vals[at, 0], np.where(keys[at] == k, vals[at, 1], 0.0)
                else:
                    continue
                p = w * q + (1 - w) * p
            total += np.log10(np.where(bit == 1, p, 1 - p))
        return total


def _train_rows(docs: DataFrame, buckets: int) -> DataFrame:
    """Blobs of words ('w': count) and of codes ('g': count) of all training texts."""
    bits = buckets.bit_length() - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: list[tuple[np.ndarray, np.ndarray]] = []
        codes: list[np.ndarray] = []
        counted: list[tuple[np.ndarray, np.ndarray]] = []
        n_words = n_codes = 0

        def flush_words() -> Iterator[pa.RecordBatch]:
            k, v = add_up(np.concatenate([k for k, _ in words]), np.concatenate([v for _, v in words])[:, None])
            words.clear()
            yield pack("w", k, v, (k >> _U(64 - bits)).astype(np.int64))

        def count_codes() -> None:
            k, v = np.unique(np.concatenate(codes), return_counts=True)
            codes.clear()
            counted.append((k, v.astype(float)[:, None]))

        def flush_codes() -> Iterator[pa.RecordBatch]:
            k, v = add_up(np.concatenate([k for k, _ in counted]), np.concatenate([v for _, v in counted]))
            counted.clear()
            yield pack("g", k, v, _code_bucket(k, bits))

        for batch in batches:
            texts = [t.lower() for t in bytes_of(batch.column(0))]
            count = Counter()
            for t in texts:
                count.update(t.split())
            k = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in count), np.uint64, len(count))
            words += [(k, np.fromiter(count.values(), float, len(count))), (np.array([END_KEY]), np.array([float(len(texts))]))]
            n_words += len(k) + 1
            for a in range(0, len(texts), 64):
                c, _ = grams(texts[a : a + 64])
                codes.append(c)
                n_codes += len(c)
                if n_codes >= GATHER:
                    count_codes()
                    n_codes = 0
                    if sum(len(k) for k, _ in counted) >= GATHER:
                        yield from flush_codes()
            if n_words >= GATHER:
                yield from flush_words()
                n_words = 0
        if codes:
            count_codes()
        if counted:
            yield from flush_codes()
        if words:
            yield from flush_words()

    return arrow_stream(docs.select("text"), run, SCHEMA)


def fit(docs: DataFrame) -> tuple[Tree, DataFrame, int, int]:
    """From training texts: the tree, the vocabulary's blobs, the number of tokens and of distinct ones."""
    spark = docs.sparkSession
    buckets = _bucket_count(spark)
    bits = buckets.bit_length() - 1

    def then(kind: str, bucket: int, keys: np.ndarray, vals: np.ndarray) -> Iterator[pa.RecordBatch]:
        if kind == "w":
            yield pack("w", keys, vals, np.full(len(keys), bucket))
            yield pack("n", np.zeros(1, np.uint64), np.array([[vals.sum(), len(keys)]]), np.zeros(1, np.int64))
            return
        levels, (up_keys, up) = weigh(keys, vals[:, 0], 2)
        for depth, k, counts, weight in levels:
            n = counts.sum(axis=1)
            yield pack(f"d{depth}", k, np.stack([(counts[:, 1] + 0.5) / (n + 1), weight], axis=1), np.full(len(k), bucket))
        yield pack("u", up_keys, up, np.zeros(len(up_keys), np.int64))

    counted = materialize(merge(_train_rows(docs, buckets), then), "counted")
    totals = [unpack(bytes(r["keys"]), bytes(r["vals"]))[1][0] for r in counted.filter("kind = 'n'").select("keys", "vals").collect()]
    tokens, distinct = (int(sum(t[k] for t in totals)) for k in (0, 1))

    # depths 1 and 0: 65,536 keys at most
    def keep(kind: str, bucket: int, keys: np.ndarray, vals: np.ndarray) -> Iterator[pa.RecordBatch]:
        yield pack(kind, keys, vals, np.full(len(keys), bucket))

    top_p, top_w = np.full(2 << 16, 0.5), np.zeros(2 << 16)
    for r in merge(counted.filter("kind = 'u'"), keep).toLocalIterator():
        keys, vals = unpack(bytes(r["keys"]), bytes(r["vals"]))
        for depth in (1, 0):
            own = log_kt(vals[:, 0], vals[:, 1])
            weighted = np.logaddexp(own, vals[:, 2]) - math.log(2)
            at = keys + _U(depth << 16)
            top_p[at] = (vals[:, 1] + 0.5) / (vals[:, 0] + vals[:, 1] + 1)
            top_w[at] = np.exp(own - math.log(2) - weighted)
            keys, vals = add_up(_parents(keys, depth), np.stack([vals[:, 0], vals[:, 1], weighted], axis=1)) if depth else (keys, vals)
    return Tree(top_p, top_w, bits, counted.filter("kind like 'd%'")), counted.filter("kind = 'w'"), tokens, distinct


def _bucket_count(spark: SparkSession) -> int:
    """A power of two, at least the shuffle partitions of the session."""
    return 1 << max(5, (int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length())


def _hot_words(vocabulary: DataFrame, tokens: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys and counts of the words above a HOT_WORDS-th of all tokens: HOT_WORDS words at most."""
    least = tokens / HOT_WORDS

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for keys, vals in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            k, v = unpack(keys, vals)
            some = v[:, 0] > least
            yield pack("h", k[some], v[some], np.zeros(int(some.sum()), np.int64))

    parts = [unpack(bytes(r["keys"]), bytes(r["vals"])) for r in arrow_map(vocabulary.select("keys", "vals"), run, SCHEMA).collect()]
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0)
    keys, vals = add_up(np.concatenate([k for k, _ in parts]), np.concatenate([v for _, v in parts]))
    return keys, vals[:, 0]


class _Memo:
    """Scores of codes by place; a code that takes another's place drives it out. levels: the bucket's nodes."""

    def __init__(self, tree: Tree):
        self.tree, self.levels, self.keys, self.vals = tree, {}, np.full(1 << MEMO_BITS, END_KEY), np.zeros(1 << MEMO_BITS)

    def log10(self, codes: np.ndarray) -> np.ndarray:
        at = _mix(codes) >> _U(64 - MEMO_BITS)
        out = self.vals[at]
        miss = np.flatnonzero(self.keys[at] != codes)
        if len(miss):
            new, back = np.unique(codes[miss], return_inverse=True)
            values = self.tree.log10_in(self.levels, new)
            out[miss] = values[back]
            at = _mix(new) >> _U(64 - MEMO_BITS)
            self.keys[at], self.vals[at] = new, values
        return out


_BLOCK = "block long, kind int, bucket int, doc_id binary, keys binary, docs binary, sums binary"
_BLOCK_NAMES = ["block", "kind", "bucket", "doc_id", "keys", "docs", "sums"]
_BLOCK_KINDS = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]


def _block_batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = zip(*rows, strict=True) if rows else [()] * 7
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, _BLOCK_KINDS, strict=True)], _BLOCK_NAMES)


def _block_codes(texts: list[bytes], bits: int, places: bool = True) -> tuple[list[tuple[np.ndarray, np.ndarray, np.ndarray]], np.ndarray, np.ndarray, np.ndarray]:
    """The codes of a block: (distinct, place of each, starts of texts) for each 64 texts; all distinct
    codes in order; their order by bucket; where each bucket starts in it."""
    parts = []
    for a in range(0, len(texts), 64):
        codes, starts = grams(texts[a : a + 64])
        if places:
            new, back = np.unique(codes, return_inverse=True)
            parts.append((new, back.astype(np.uint32), starts))
        else:
            parts.append((np.unique(codes),))
    codes = np.unique(np.concatenate([p[0] for p in parts])) if parts else np.zeros(0, np.uint64)
    bucket = _code_bucket(codes, bits)
    order = np.argsort(bucket, kind="stable")
    return parts, codes, order, np.searchsorted(bucket[order], np.arange((1 << bits) + 1))


def _block_words(texts: list[bytes]) -> tuple[dict[bytes, int], np.ndarray]:
    """The distinct words of a block by number, and their keys; the last key is the end token's."""
    index: dict[bytes, int] = {}
    for t in texts:
        for w in t.split():
            if w not in index:
                index[w] = len(index)
    return index, np.append(np.fromiter(map(xxhash.xxh3_64_intdigest, index), np.uint64, len(index)), END_KEY)


def _among(keys: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each key is in the sorted table, and where."""
    if not len(table):
        return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return table[at] == keys, at


def score(docs: DataFrame, tree: Tree, vocabulary: DataFrame, tokens: int, distinct: int) -> DataFrame:
    """docs (doc_id, held_out, text) -> the scores of every row.

    A block is some Arrow batches of documents. Its own row (kind 2) carries what is known at once and the
    texts; rows of kind 1 ask for the counts of its distinct rarer words and rows of kind 3 for the scores
    of its distinct codes, bucket by bucket; the answers (kinds 1 and 0) meet the block again.
    bits_per_byte is the code length by the model over the bytes and the end.
    """
    spark = docs.sparkSession
    buckets = _bucket_count(spark)
    bits = buckets.bit_length() - 1  # 5 or more
    hot_keys, hot_counts = _hot_words(vocabulary, tokens)
    shared = spark.sparkContext.broadcast((tree.without_nodes(), hot_keys, hot_counts))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, hot_keys, _ = shared.value
        block = TaskContext.get().partitionId() << 40

        def blocks() -> Iterator[tuple[list, list, list[bytes]]]:
            ids, held, texts, size = [], [], [], 0
            for batch in batches:
                for i, h, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), bytes_of(batch.column(2)), strict=True):
                    ids.append(i)
                    held.append(h)
                    texts.append(t.lower())
                    size += len(t) + 1
                    if size >= BLOCK_BYTES:
                        yield ids, held, texts
                        ids, held, texts, size = [], [], [], 0
            if texts:
                yield ids, held, texts

        for raw_ids, raw_held, texts in blocks():
            held = np.array(raw_held, float)
            ids = np.array([0 if x is None else x for x in raw_ids], np.int64)
            null = np.array([x is None for x in raw_ids], float)
            lengths = np.array([len(t) for t in texts], "<i8")
            rows = [(block, 2, 0, ids.tobytes(), zip_bytes(b"".join(texts)), lengths.tobytes(), np.stack([held, null], axis=1).tobytes())]
            _, codes, by_bucket, first = _block_codes(texts, bits, places=False)
            for b, (x, y) in enumerate(zip(first, first[1:], strict=False)):
                if y > x:
                    rows.append((block, 3, b, None, zip_keys(codes[by_bucket[x:y]]), None, None))
            keys = np.unique(_block_words(texts)[1])
            keys = keys[~_among(keys, hot_keys)[0]]
            cuts = np.searchsorted(keys >> _U(64 - bits), np.arange(buckets + 1, dtype=np.uint64))
            rows += [(block, 1, b, None, zip_keys(keys[x:y]), None, None) for b, (x, y) in enumerate(zip(cuts, cuts[1:], strict=False)) if y > x]
            yield _block_batch(rows)
            block += 1

    asked = materialize(arrow_stream(docs.select("doc_id", "held_out", "text"), ask, _BLOCK), "asked")
    none = F.lit(None).cast("binary")
    # the tree's nodes (kinds -4 to -2, by depth) and the vocabulary (kind 0) come first in their bucket
    counts = vocabulary.select(F.lit(0).cast("long").alias("block"), F.lit(0).alias("kind"), "bucket", none.alias("doc_id"), "keys", none.alias("docs"), F.col("vals").alias("sums"))
    nodes = tree.nodes.select(F.lit(0).cast("long").alias("block"), (-F.substring("kind", 2, 1).cast("int")).alias("kind"), "bucket", none.alias("doc_id"), "keys", none.alias("docs"), F.col("vals").alias("sums"))
    together = nodes.union(counts).union(asked.filter("kind in (1, 3)")).repartition("bucket").sortWithinPartitions("bucket", "kind")

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, keys, vals = None, np.zeros(0, np.uint64), np.zeros(0)
        memo = _Memo(shared.value[0])
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                if r["bucket"] != at:
                    at, keys, vals = r["bucket"], np.zeros(0, np.uint64), np.zeros(0)
                    memo.levels = {}
                if r["kind"] < 0:
                    memo.levels[-r["kind"]] = unpack(r["keys"], r["sums"])
                    continue
                if r["kind"] == 3:
                    rows.append((r["block"], 0, r["bucket"], None, None, None, zip_numbers(memo.log10(unzip_keys(r["keys"])))))
                    continue
                if r["kind"] == 0:
                    keys, vals = unpack(r["keys"], r["sums"])
                    vals = vals[:, 0]
                    continue
                found, place = _among(unzip_keys(r["keys"]), keys)
                counts = np.zeros(len(found))
                counts[found] = vals[place[found]]
                rows.append((r["block"], 1, r["bucket"], None, r["keys"], None, zip_numbers(counts)))
            yield _block_batch(rows)

    answers = arrow_stream(together, answer, _BLOCK)
    by_block = asked.filter("kind = 2").union(answers).repartition("block").sortWithinPartitions("block", F.desc("kind"))
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"]

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, hot_keys, hot_counts = shared.value
        ids, own, texts = np.zeros(0, np.int64), np.zeros((0, 2)), []
        parts, codes, by_bucket, first = _block_codes([], bits)
        logs, rare = np.zeros(0), []

        def word_sums() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """For each text its tokens, its known tokens, and the sum of log10(count + 1)."""
            index, keys = _block_words(texts)
            count = np.zeros(len(keys))
            for table, counts in [(hot_keys, hot_counts), *rare]:
                found, place = _among(keys, table)
                count[found] = counts[place[found]]
            which = [np.fromiter(map(index.__getitem__, t.split()), np.int64) for t in texts]
            n = np.array([len(w) for w in which], np.int64)
            doc, which = np.repeat(np.arange(len(texts)), n), np.concatenate([np.zeros(0, np.int64), *which])
            end = len(index)
            known = np.bincount(doc, weights=count[which] > 0, minlength=len(texts)) + (count[end] > 0)
            sums = np.bincount(doc, weights=np.log10(count + 1)[which], minlength=len(texts)) + np.log10(count[end] + 1)
            return n + 1, known.astype(np.int64), sums

        def close() -> pa.RecordBatch:
            n, known, sums = word_sums()
            base = sums - n * math.log10(tokens + distinct + 1)
            model = np.concatenate([np.zeros(0), *(np.add.reduceat(logs[np.searchsorted(codes, new)][back], starts) for new, back, starts in parts)])
            coded = np.array([len(t) + 1 for t in texts])  # the end is coded as well
            arrays = [pa.array(ids, pa.int64(), mask=own[:, 1] > 0), pa.array(own[:, 0] > 0), pa.array(n), pa.array(known), pa.array(np.full(len(ids), tokens))]
            return pa.RecordBatch.from_arrays([*arrays, pa.array(base), pa.array(model), pa.array(-model / math.log10(2) / np.maximum(1, coded), pa.float64())], names)

        for batch in batches:
            for r in (x for k in range(batch.num_rows) for x in batch.slice(k, 1).to_pylist()):
                if r["kind"] == 2:
                    yield close()
                    ids = np.frombuffer(r["doc_id"], "<i8")
                    own = np.frombuffer(r["sums"], "<f8").reshape(-1, 2)
                    text, ends = unzip_bytes(r["keys"]), np.cumsum(np.frombuffer(r["docs"], "<i8")).tolist()
                    texts = [text[a:b] for a, b in zip([0, *ends], ends, strict=False)]
                    parts, codes, by_bucket, first = _block_codes(texts, bits)
                    logs, rare = np.full(len(codes), np.nan), []  # every code is answered
                elif r["kind"] == 0:
                    logs[by_bucket[first[r["bucket"]] : first[r["bucket"] + 1]]] = unzip_numbers(r["sums"], "<f8")
                else:
                    rare.append((unzip_keys(r["keys"]), unzip_numbers(r["sums"], "<f8")))
        yield close()

    return arrow_stream(by_block, finish, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double")


def op6_ctw(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), (id_bucket("doc_id", 7) == 2).alias("held_out"), "text")
    return score(docs, *fit(docs.filter(~F.col("held_out"))))
