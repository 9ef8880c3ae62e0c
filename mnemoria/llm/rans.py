"""Token ids in a binary format coded with a static range asymmetric numeral system (rANS).

One frequency table of all ids serves every block. A block holds the ids of whole documents, coded in
`lanes` interleaved states of 64 bits that renormalise by 32-bit words, so that a block decodes on its
own and its lanes decode together. A block carries checkpoints (the states and the place in the words
after a fixed number of steps): a reader may start at any of them, and the segments between them are
decoded side by side.

The files are a table of (part, block, head, body) rows and nothing else is needed to read them. Row
(-1, -1) is the frequency table: head 'RNT1', bits u32, entries u32, crc32 of the body; the body has each
id (u16) and its frequency (u32). Other rows are blocks, little-endian: the head has magic 'RNS2', ids
u64 before it in its part, ids u64, documents u32, lanes u32, steps between checkpoints u32, checkpoints
u32, words u64, bytes of the document list u64, crc32 of the document list and of the ids (u32 each);
the body has the document list (zstd of: null flags u8, doc_ids i64, lengths u64), the initial states
(lanes x u64), for each checkpoint its word offset u64 and states (lanes x u64), and the words (u32).

Defined cases: a null text is the empty text (its end id alone); no rows give no blocks; repeated rows
are stored as often as they occur; documents with a null id come first; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_map, arrow_stream, forget, gathered, materialize, read
from .tokens import BATCH_BYTES, encoder

END_ID = 0
#: Precision of the table: frequencies add up to 2 ** SCALE_BITS.
SCALE_BITS = 22
#: Ids after which a block is closed; the document that crosses it is kept whole.
BLOCK_IDS = 1 << 21
LANES = 2048
#: Steps (of one id for each lane) from one checkpoint to the next.
CHECKPOINT_STEPS = 256
#: Documents in an Arrow batch of ids.
ROWS_OUT = 512
#: Ids that are decoded side by side at most, in segments.
DECODE_WIDTH = 1 << 14

_HEAD = struct.Struct("<4sQQIIIIQQII")
_TABLE = struct.Struct("<4sIII")
_LOW = 1 << 31


def frequency_table(counts: np.ndarray, scale_bits: int = SCALE_BITS) -> np.ndarray:
    """Frequencies of sum 2 ** scale_bits: in proportion, and at least 1 for each id that occurs."""
    total, size = int(counts.sum()), 1 << scale_bits
    freq = np.zeros(len(counts), np.int64)
    if not total:
        return freq
    seen = np.flatnonzero(counts)
    freq[seen] = np.maximum(1, np.floor(counts[seen] * (size / total))).astype(np.int64)
    order = seen[np.argsort(-freq[seen], kind="stable")]
    k = 0
    while (gap := size - int(freq.sum())) != 0:
        i = order[k % len(order)]
        change = gap if gap > 0 else -min(-gap, max(0, int(freq[i]) // 2))
        freq[i] += change
        k += 1
    return freq


def write_table(freq: np.ndarray, scale_bits: int = SCALE_BITS) -> tuple[bytes, bytes]:
    """Head and body of the table's row."""
    seen = np.flatnonzero(freq)
    body = seen.astype("<u2").tobytes() + freq[seen].astype("<u4").tobytes()
    return _TABLE.pack(b"RNT1", scale_bits, len(seen), zlib.crc32(body)), body


def read_table(head: bytes, body: bytes) -> tuple[np.ndarray, int]:
    magic, bits, n, crc = _TABLE.unpack(head)
    if magic != b"RNT1" or len(body) != 6 * n or zlib.crc32(body) != crc:
        raise ValueError("not a frequency table of this format")
    freq = np.zeros(1 << 16, np.int64)
    freq[np.frombuffer(body, "<u2", n)] = np.frombuffer(body, "<u4", n, 2 * n)
    return freq, bits


def ids_in(head: bytes) -> int:
    return _HEAD.unpack(head)[2]


@dataclass
class Block:
    """A block's parts, read from its head and body."""

    head: bytes
    body: bytes

    def __post_init__(self) -> None:
        magic, self.start, self.n, self.docs, self.lanes, self.every, self.marks, self.n_words, self.listed, self.crc_docs, self.crc_ids = _HEAD.unpack(self.head)
        if magic != b"RNS2" or len(self.body) != self.listed + 8 * self.lanes + self.marks * (8 + 8 * self.lanes) + 4 * self.n_words:
            raise ValueError("not a block of this format")

    def documents(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Null flags, doc_ids and lengths."""
        if zlib.crc32(self.body[: self.listed]) != self.crc_docs:
            raise ValueError("checksum of a document list does not hold")
        raw = pa.Codec("zstd").decompress(self.body[: self.listed], 17 * self.docs, asbytes=True)
        return np.frombuffer(raw, np.uint8, self.docs) > 0, np.frombuffer(raw, "<i8", self.docs, self.docs), np.frombuffer(raw, "<u8", self.docs, 9 * self.docs).astype(np.int64)

    def entry(self, checkpoint: int) -> tuple[int, np.ndarray]:
        """The place in the words and the states at a checkpoint; 0 is the start."""
        at = self.listed + checkpoint * (8 + 8 * self.lanes) - (8 if checkpoint else 0)
        place = struct.unpack_from("<Q", self.body, at)[0] if checkpoint else 0
        return place, np.frombuffer(self.body, "<u8", self.lanes, at + (8 if checkpoint else 0))

    def words(self) -> np.ndarray:
        return np.frombuffer(self.body, "<u4", self.n_words, len(self.body) - 4 * self.n_words)


class Coder:
    def __init__(self, freq: np.ndarray, scale_bits: int = SCALE_BITS):
        self.bits = scale_bits
        self.freq = freq.astype(np.uint64)
        self.start = (np.cumsum(freq) - freq).astype(np.uint64)
        self.top = (self.freq << np.uint64(63 - scale_bits)).astype(np.uint64)  # a state from here on must shed a word
        self._slots: np.ndarray | None = None

    def encode(self, ids: np.ndarray, doc_ids: list[int | None], lengths: list[int], start: int = 0, lanes: int = LANES, every: int = CHECKPOINT_STEPS) -> tuple[bytes, bytes]:
        """Head and body of a block that holds whole documents."""
        n = len(ids)
        lanes = max(1, min(lanes, n))
        steps = -(-n // lanes)
        states = np.full(lanes, _LOW, np.uint64)
        words: list[np.ndarray] = []  # from the last step to the first, each reversed
        marks: list[tuple[int, np.ndarray]] = []
        emitted = 0
        bits, w32 = np.uint64(self.bits), np.uint64(32)
        for step in range(steps - 1, -1, -1):
            s = ids[step * lanes : (step + 1) * lanes]
            k = len(s)  # the last step may be short
            x, f = states[:k], self.freq[s]
            shed = np.flatnonzero(x >= self.top[s])
            if len(shed):
                out = x[shed]
                words.append(out.astype("<u4")[::-1])  # the low 32 bits
                emitted += len(out)
                x[shed] = out >> w32
            q = x // f
            x -= q * f
            x += q << bits
            x += self.start[s]
            if step and step % every == 0:
                marks.append((emitted, states.copy()))
        body = np.concatenate(words)[::-1] if words else np.zeros(0, "<u4")
        marks = [(len(body) - at, s) for at, s in reversed(marks)]
        listed = b"".join([np.array([x is None for x in doc_ids], np.uint8).tobytes(), np.array([x or 0 for x in doc_ids], "<i8").tobytes(), np.array(lengths, "<u8").tobytes()])
        listed = pa.Codec("zstd").compress(listed, asbytes=True)
        head = _HEAD.pack(b"RNS2", start, n, len(doc_ids), lanes, every, len(marks), len(body), len(listed), zlib.crc32(listed), zlib.crc32(ids.astype("<u4").tobytes()))
        return head, b"".join([listed, states.astype("<u8").tobytes(), *(struct.pack("<Q", at) + s.astype("<u8").tobytes() for at, s in marks), body.tobytes()])

    def decode(self, block: Block, first: int = 0, last: int | None = None) -> np.ndarray:
        """The ids of a block's segments first..last (all: with the checksum verified).

        Segment k runs from checkpoint k to the next; all segments are decoded side by side, each with its
        own states and its own place in the words.
        """
        last = block.marks if last is None else last
        if self._slots is None:
            self._slots = np.repeat(np.arange(len(self.freq), dtype=np.uint16), self.freq.astype(np.int64))
        lanes, every, words = block.lanes, block.every, block.words()
        out = np.empty(max(0, min(block.n, (last + 1) * every * lanes) - first * every * lanes), np.uint16)
        whole = -(-block.n // lanes)
        bits, mask, w32, low = np.uint64(self.bits), np.uint64((1 << self.bits) - 1), np.uint64(32), np.uint64(_LOW)
        group = max(1, DECODE_WIDTH // lanes)
        for a in range(first, last + 1, group):
            segments = np.arange(a, min(a + group, last + 1))
            entries = [block.entry(int(k)) for k in segments]
            place, states = np.array([p for p, _ in entries], np.int64), np.stack([s for _, s in entries])
            steps = np.minimum(every, whole - segments * every)  # the last segment of a block may be shorter
            for step in range(int(steps.max())):
                n = int((steps > step).sum())
                at = (int(segments[n - 1]) * every + step) * lanes
                k = min(lanes, block.n - at) if n == 1 else lanes  # and its last step may be narrower
                if n > 1 and at + lanes > block.n:
                    self._step(states[: n - 1], place[: n - 1], words, out, (segments[: n - 1] * every + step) * lanes - first * every * lanes, (bits, mask, w32, low))
                    self._step(states[n - 1 : n, : block.n - at], place[n - 1 : n], words, out, np.array([at - first * every * lanes]), (bits, mask, w32, low))
                else:
                    self._step(states[:n, :k], place[:n], words, out, (segments[:n] * every + step) * lanes - first * every * lanes, (bits, mask, w32, low))
            ends = [block.entry(int(k) + 1) if k < block.marks else (block.n_words, np.full(lanes, low)) for k in segments]
            if any(p != q or (s != t).any() for p, s, (q, t) in zip(place.tolist(), states, ends, strict=True)):
                raise ValueError("a segment does not end where the next one starts")
        if first == 0 and last == block.marks and zlib.crc32(out.astype("<u4").tobytes()) != block.crc_ids:
            raise ValueError("checksum of a block does not hold")
        return out

    def _step(self, x: np.ndarray, place: np.ndarray, words: np.ndarray, out: np.ndarray, at: np.ndarray, constants: tuple) -> None:
        """One id from each lane of each segment; x and place are changed."""
        bits, mask, w32, low = constants
        slot = x & mask
        s = self._slots[slot]
        for row, a in zip(s, at.tolist(), strict=True):
            out[a : a + len(row)] = row
        slot -= self.start[s]
        np.right_shift(x, bits, out=x)
        x *= self.freq[s]
        x += slot
        need = x < low
        flat, counts = np.flatnonzero(need), need.sum(axis=1)
        if len(flat):
            read = np.concatenate([words[p : p + n] for p, n in zip(place.tolist(), counts.tolist(), strict=True)])
            if len(read) < len(flat):
                raise ValueError("a block has too few words")
            low_x = x.reshape(-1)[flat] if x.flags.c_contiguous else x.ravel()[flat]
            low_x <<= w32
            low_x |= read
            if x.flags.c_contiguous:
                x.reshape(-1)[flat] = low_x
            else:
                x[np.divmod(flat, x.shape[1])] = low_x
            place += counts


def token_rows(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, counts): ids of 16 bits with the end id.

    Each task ends with a row that has counts alone: how often each possible id occurs in its rows.
    """
    names = ["doc_id", "ids", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, np.int64)
        for batch in gathered(batches, 1, BATCH_BYTES):
            ids, ends = encoder(tokenizer_path, keep_space=True).encode_column(batch.column(1), END_ID)
            total += np.bincount(ids, minlength=1 << 16)
            packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends * 2), pa.py_buffer(ids)])
            for at in range(0, len(packed), ROWS_OUT):  # a batch of binary has less than 2 GB
                some = packed.slice(at, ROWS_OUT)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, ROWS_OUT).cast(pa.int64()), some.cast(pa.binary()), pa.nulls(len(some), pa.list_(pa.int64()))], names)
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([total.tolist()], pa.list_(pa.int64()))], names)

    return arrow_stream(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), run, "doc_id long, ids binary, counts array<long>")


def count_ids(rows: DataFrame) -> np.ndarray:
    """How often each of the 65,536 possible ids occurs, from the tasks' counts."""
    each = rows.filter("counts is not null").select(F.posexplode("counts").alias("id", "n")).filter("n > 0")
    counts = np.zeros(1 << 16, np.int64)
    for r in each.groupBy("id").agg(F.sum("n").alias("n")).collect():
        counts[r["id"]] = r["n"]
    return counts


def write_blocks(rows: DataFrame, freq: np.ndarray) -> DataFrame:
    """The frequency table and the blocks, in ascending doc_id order, as files of the shared folder.

    (part, block, head, body): part orders the files, block the blocks of a file.
    """
    spark, table = rows.sparkSession, freq.astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part = Coder(table), TaskContext.get().partitionId()
        number, start, doc_ids, held, size = 0, 0, [], [], 0

        def block() -> pa.RecordBatch:
            head, body = coder.encode(np.frombuffer(b"".join(held), "<u2"), doc_ids, [len(x) // 2 for x in held], start)
            return pa.RecordBatch.from_arrays([pa.array([part]), pa.array([number]), pa.array([head], pa.binary()), pa.array([body], pa.binary())], ["part", "block", "head", "body"])

        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                doc_ids.append(doc_id)
                held.append(ids)
                size += len(ids) // 2
                if size >= BLOCK_IDS:
                    yield block()
                    number, start, doc_ids, held, size = number + 1, start + size, [], [], 0
        if held:
            yield block()

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(parts, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "ids")
    schema = "part long, block long, head binary, body binary"
    head, body = write_table(freq)
    first = spark.createDataFrame([(-1, -1, bytearray(head), bytearray(body))], schema)
    return materialize(arrow_stream(ordered, run, schema).union(first), "blocks")


def read_blocks(blocks: DataFrame) -> DataFrame:
    """Documents from the files alone: (doc_id, start, n_tokens, ids_crc32).

    The table is one row of 65,536 entries at most. Where a part starts follows from the heads of its
    blocks, one row for each part.
    """
    kept = blocks.filter("part = -1").select("head", "body").first()
    table, bits = read_table(bytes(kept["head"]), bytes(kept["body"]))

    def count(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        n = [ids_in(h) for h in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], ["part", "n"])

    sizes = arrow_map(blocks.filter("part >= 0").select("part", "head"), count, "part long, n long").groupBy("part").agg(F.sum("n").alias("n"))
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(table, bits)
        for batch in batches:
            for r in batch.to_pylist():
                block = Block(r["head"], r["body"])
                null, doc_ids, counts = block.documents()
                raw = coder.decode(block).astype("<u4").tobytes()
                ends = np.cumsum(counts)
                crcs = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip((ends - counts).tolist(), ends.tolist(), strict=True)]
                arrays = [pa.array(np.full(len(crcs), r["part"])), pa.array(doc_ids, mask=null), pa.array(ends - counts + block.start), pa.array(counts), pa.array(crcs, pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, ["part", "doc_id", "start", "n_tokens", "ids_crc32"])

    found = arrow_stream(blocks.filter("part >= 0").select("part", "head", "body"), run, "part long, doc_id long, start long, n_tokens long, ids_crc32 long")
    return found.join(F.broadcast(before), "part").select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def store_tokens(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Tokenise, count, write: the files' rows."""
    rows = materialize(token_rows(docs, tokenizer_path), "ids")
    blocks = write_blocks(rows.filter("ids is not null").select("doc_id", "ids"), frequency_table(count_ids(rows)))
    forget(rows)
    return blocks


def op8_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return read_blocks(store_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")))
