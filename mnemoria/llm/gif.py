"""GIF media columns: LZW streams, palettes, disposal and transparency, timed frames, colour histograms.

`decode_gif` reads any GIF87a/89a (global and local palettes, interlacing, disposal 0 to 3, transparent
index, delays) into composed frames. `encode_gif` writes frames of palette indices. A payload of bytes is
stored losslessly as the indices of timed frames that are 64 pixels wide. Index 0, which pads payloads,
is transparent, and each frame gives way to the background before the next one (disposal 2), so what a
frame shows are the payload's own bytes. `gif_frames` stores, for each document, its timed frames with
the colour histogram of what they show after palette, transparency and disposal.

Defined cases: a null text is the empty text (64 zero bytes); long texts become several frames; no rows
give no rows; equal payloads give equal media; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, bytes_of, materialize, read

WIDTH = 64
#: Rows of a full frame; 64 x 4096 bytes.
FRAME_ROWS = 4096
#: Hundredths of a second that each frame is shown; what becomes of it then; the index that is not shown.
DELAY, DISPOSAL, TRANSPARENT = 4, 2, 0
#: Index i has 3 bits of red, 3 of green and 2 of blue.
PALETTE = np.array([((i >> 5) * 255 // 7, (i >> 2 & 7) * 255 // 7, (i & 3) * 85) for i in range(256)], np.uint8)
HISTOGRAM_BITS = 2


@dataclass
class Frame:
    """One composed frame: indices of its own rectangle, and the whole canvas in RGBA."""

    left: int
    top: int
    indices: np.ndarray
    palette: np.ndarray
    delay: int
    disposal: int
    transparent: int | None
    canvas: np.ndarray | None = None


def _pack_codes(codes: np.ndarray, widths: np.ndarray) -> bytes:
    """Codes as a stream of bits, lowest bit first."""
    ends = np.cumsum(widths)
    at = (ends - widths).astype(np.int64)
    out = np.zeros(int(ends[-1]) // 8 + 4, np.uint8)
    shifted = codes.astype(np.uint32) << (at & 7).astype(np.uint32)
    for k in range(3):
        # bits do not overlap, so adding is or
        out[: len(out)] += np.bincount((at >> 3) + k, weights=(shifted >> np.uint32(8 * k)) & 0xFF, minlength=len(out)).astype(np.uint8)
    return out[: (int(ends[-1]) + 7) // 8].tobytes()


def _widths(first: int, min_bits: int, n: int) -> np.ndarray:
    """Widths of n codes after a clear: code k is read when the table has first + max(0, k - 1) entries."""
    entries = first + np.maximum(0, np.arange(n) - 1) + (np.arange(n) > 0)
    width = np.full(n, min_bits + 1, np.int64)
    for b in range(min_bits + 1, 12):
        width[entries > (1 << b)] = b + 1
    return np.minimum(width, 12)


def lzw_encode(data: bytes, min_bits: int = 8) -> bytes:
    """LZW with variable widths; a clear code whenever the table is full."""
    clear, end = 1 << min_bits, (1 << min_bits) + 1
    first = end + 1
    codes: list[int] = []
    cuts: list[int] = []  # number of codes before each clear code
    if data:
        table: dict[int, int] = {}
        get, add = table.get, codes.append
        entries = first
        w = data[0]
        for c in data[1:]:
            k = w << 8 | c
            x = get(k)
            if x is not None:
                w = x
                continue
            add(w)
            if entries < 4096:
                table[k] = entries
                entries += 1
            else:
                cuts.append(len(codes))
                table.clear()
                entries = first
            w = c
        add(w)
    code_arr = np.asarray(codes, np.int64)
    out, widths, at = [], [], 0
    for cut in [*cuts, len(codes)]:
        part = code_arr[at:cut]
        out += [np.array([clear]), part]
        w_all = _widths(first, min_bits, len(part) + 1)
        widths += [np.array([w_all_prev if at else min_bits + 1]), w_all[: len(part)]]
        w_all_prev = int(w_all[-1])  # the clear or end code after this part has the width of one more code
        at = cut
    out.append(np.array([end]))
    widths.append(np.array([w_all_prev]))
    return _pack_codes(np.concatenate(out), np.concatenate(widths))


def lzw_decode(stream: bytes, min_bits: int, most: int) -> bytes:
    """The symbols of a code stream, `most` at most; clear codes may stand anywhere."""
    clear, end = 1 << min_bits, (1 << min_bits) + 1
    first = end + 1
    n_bits = 8 * len(stream)
    padded = np.frombuffer(stream + b"\0\0\0\0", np.uint8).astype(np.uint32)
    run_widths = _widths(first, min_bits, 4096 - first + 1)
    run_at = np.cumsum(run_widths) - run_widths

    def unpack(at: np.ndarray, widths: np.ndarray) -> np.ndarray:
        byte = at >> 3
        return ((padded[byte] | padded[byte + 1] << 8 | padded[byte + 2] << 16) >> (at & 7).astype(np.uint32)) & ((1 << widths) - 1).astype(np.uint32)

    base = [bytes([i]) for i in range(clear)] + [b"", b""]
    out: list[bytes] = []
    bit, size = 0, 0
    while bit + min_bits < n_bits and size < most:
        # all codes up to a full table, as if no clear code came, then as far as one does; a full table
        # keeps 12 bits until a clear code comes
        n = int(np.searchsorted(run_at + run_widths, n_bits - bit, side="right"))
        at, widths = bit + run_at[:n], run_widths[:n]
        codes = unpack(at, widths)
        stops = np.flatnonzero((codes == clear) | (codes == end))
        if not len(stops) and n == len(run_at):
            extra = np.arange(int(run_at[-1] + run_widths[-1]) + bit, n_bits - 11, 12)
            at, widths = np.concatenate([at, extra]), np.concatenate([run_widths, np.full(len(extra), 12)])
            codes = unpack(at, widths)
            stops = np.flatnonzero((codes == clear) | (codes == end))
        stop = int(stops[0]) if len(stops) else len(codes)
        table = base.copy()
        append, keep = table.append, out.append
        prev, full, known = b"", False, len(out)
        for code in codes[:stop].tolist():
            if code < len(table):
                entry = table[code]
            elif code == len(table) and prev:
                entry = prev + prev[:1]
            else:
                raise ValueError("broken code stream")
            keep(entry)
            if not full and prev:
                append(prev + entry[:1])
                full = len(table) == 4096
            prev = entry
        size += sum(map(len, out[known:]))
        if stop == len(codes) or codes[stop] == end:
            break
        bit = int(at[stop] + widths[stop])
    return b"".join(out)[:most]


def _blocks(data: bytes) -> bytes:
    return b"".join(bytes([len(data[k : k + 255])]) + data[k : k + 255] for k in range(0, len(data), 255)) + b"\0"


def encode_gif(frames: list[np.ndarray], palette: np.ndarray = PALETTE, delay: int = DELAY, disposal: int = 1, transparent: int | None = None) -> bytes:
    """Frames of palette indices (rows x columns, all from the top left) as a GIF89a."""
    height, width = max(f.shape[0] for f in frames), max(f.shape[1] for f in frames)
    bits = max(2, int(len(palette) - 1).bit_length())
    table = np.zeros((1 << bits, 3), np.uint8)
    table[: len(palette)] = palette
    out = [b"GIF89a", struct.pack("<HHBBB", width, height, 0x80 | 0x70 | bits - 1, 0, 0), table.tobytes()]
    for f in frames:
        flags = disposal << 2 | (transparent is not None)
        out.append(struct.pack("<BBBBHBB", 0x21, 0xF9, 4, flags, delay, transparent or 0, 0))
        out.append(struct.pack("<BHHHHB", 0x2C, 0, 0, f.shape[1], f.shape[0], 0))
        out.append(bytes([bits]) + _blocks(lzw_encode(f.astype(np.uint8).tobytes(), bits)))
    return b"".join([*out, b"\x3b"])


def decode_gif(data: bytes, compose: bool = True) -> list[Frame]:
    """All frames in order; compose: with the canvas after each frame is drawn."""
    return list(frames_of(data, compose))


def frames_of(data: bytes, compose: bool = True) -> Iterator[Frame]:
    """The frames one by one, as decode_gif gives them."""
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    width, height, flags, _, _ = struct.unpack_from("<HHBBB", data, 6)
    at = 13
    palette = np.zeros((0, 3), np.uint8)
    if flags & 0x80:
        n = 2 << (flags & 7)
        palette = np.frombuffer(data, np.uint8, 3 * n, at).reshape(n, 3)
        at += 3 * n

    def sub_blocks(at: int) -> tuple[bytes, int]:
        parts = []
        while size := data[at]:
            parts.append(data[at + 1 : at + 1 + size])
            at += 1 + size
        return b"".join(parts), at + 1

    canvas = np.zeros((height, width, 4) if compose else (0, 0, 4), np.uint8)
    delay, disposal, transparent = 0, 0, None
    while data[at] != 0x3B:
        if data[at] == 0x21:
            label = data[at + 1]
            body, at = sub_blocks(at + 2)
            if label == 0xF9:
                f, delay, index = struct.unpack("<BHB", body[:4])
                disposal, transparent = f >> 2 & 7, index if f & 1 else None
            continue
        if data[at] != 0x2C:
            raise ValueError("unknown block")
        left, top, w, h, f = struct.unpack_from("<HHHHB", data, at + 1)
        at += 10
        colours = palette
        if f & 0x80:
            n = 2 << (f & 7)
            colours = np.frombuffer(data, np.uint8, 3 * n, at).reshape(n, 3)
            at += 3 * n
        bits = data[at]
        stream, at = sub_blocks(at + 1)
        pixels = np.zeros(w * h, np.uint8)
        got = np.frombuffer(lzw_decode(stream, bits, w * h), np.uint8)
        pixels[: len(got)] = got
        pixels = pixels.reshape(h, w)
        if f & 0x40:  # interlaced: every 8th row from 0, from 4, every 4th from 2, every 2nd from 1
            order = np.concatenate([np.arange(a, h, s) for a, s in ((0, 8), (4, 8), (2, 4), (1, 2))])
            straight = np.empty_like(pixels)
            straight[order] = pixels
            pixels = straight
        frame = Frame(left, top, pixels, colours, delay, disposal, transparent)
        if compose:
            before = canvas.copy() if disposal == 3 else None
            area = canvas[top : top + h, left : left + w]
            shown = np.ones((h, w), bool) if transparent is None else pixels != transparent
            shown = shown[: area.shape[0], : area.shape[1]]
            rgba = np.dstack([colours[np.minimum(pixels, len(colours) - 1)], np.full((h, w), 255, np.uint8)])[: area.shape[0], : area.shape[1]]
            area[shown] = rgba[shown]
            frame.canvas = canvas.copy()
            if disposal == 2:
                area[:] = 0
            elif disposal == 3:
                canvas = before
        yield frame
        delay, disposal, transparent = 0, 0, None


def colour_histogram(frame: Frame, bits: int = HISTOGRAM_BITS) -> np.ndarray:
    """Pixels of the canvas after a frame by the top bits of red, green and blue; what is not shown does not count."""
    rgb = frame.canvas[frame.canvas[:, :, 3] > 0] >> np.uint8(8 - bits)
    cell = rgb[:, 0].astype(np.int64) << 2 * bits
    cell |= rgb[:, 1].astype(np.int64) << bits
    cell |= rgb[:, 2]
    return np.bincount(cell, minlength=1 << 3 * bits)


def payload_to_gif(payload: bytes) -> bytes:
    """A payload of a positive multiple of 64 bytes as the indices of timed frames."""
    pixels = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    return encode_gif([pixels[k : k + FRAME_ROWS] for k in range(0, len(pixels), FRAME_ROWS)], disposal=DISPOSAL, transparent=TRANSPARENT)


def gif_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): the padded UTF-8 bytes of each text as a GIF, in the shared folder."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        sizes, media = [], []
        for raw in bytes_of(batch.column(1)):
            sizes.append(len(raw))
            media.append(payload_to_gif(raw + b"\0" * (-len(raw) % WIDTH if raw else WIDTH)))
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return materialize(arrow_map(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), run, "doc_id long, n_bytes long, media binary"), "gif")


FRAMES = "array<struct<frame:int,start:int,delay:int,disposal:int,transparent:int,width:int,height:int,histogram:array<long>>>"
_FRAME = pa.struct([*((n, pa.int32()) for n in ("frame", "start", "delay", "disposal", "transparent", "width", "height")), ("histogram", pa.list_(pa.int64()))])


def gif_frames(media: DataFrame) -> DataFrame:
    """Decode stored media into a table: (doc_id, n_bytes, payload and media digests, frames).

    frames has a row for each timed frame: number, start and delay in hundredths of a second, disposal,
    transparent index, size, and the colour histogram of the composed canvas.
    """
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "frames"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.list_(_FRAME)]

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows = []
        for data in batch.column(2).to_pylist():
            sha, size, tail, start, timed = hashlib.sha256(), 0, b"", 0, []
            for k, f in enumerate(frames_of(data)):
                own = f.indices.tobytes()
                sha.update(own)
                size, tail = size + len(own), (tail + own[-WIDTH:])[-WIDTH:]
                timed.append({"frame": k, "start": start, "delay": f.delay, "disposal": f.disposal, "transparent": f.transparent, "width": f.indices.shape[1], "height": f.indices.shape[0], "histogram": colour_histogram(f)})
                start += f.delay
            rows.append((size, sha.hexdigest(), zlib.crc32(tail), len(data), hashlib.sha256(data).hexdigest(), timed))
        cols = list(zip(*rows, strict=True)) if rows else [()] * len(names)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", "n_bytes", *names])

    return materialize(arrow_map(media, run, f"doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, frames {FRAMES}"), "frames")


def gif_features(frames: DataFrame) -> DataFrame:
    """The digests, and from the stored frames their number, the duration and the histogram over all of them."""
    zero = F.array_repeat(F.lit(0).cast("long"), 1 << 3 * HISTOGRAM_BITS)
    shown = F.aggregate("frames", zero, lambda acc, f: F.zip_with(acc, f["histogram"], lambda a, b: a + b))
    lasts = F.aggregate("frames", F.lit(0), lambda acc, f: F.greatest(acc, f["start"] + f["delay"]))
    feature = F.concat(F.lit("frames="), F.size("frames"), F.lit(";cs="), lasts, F.lit(";rgb="), F.array_join(shown.cast("array<string>"), ","))
    return frames.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", F.size("frames").cast("long").alias("n_frames"), feature.alias("feature"))


def op3_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gif_features(gif_frames(gif_media(read(spark, sf_dir, "documents"))))
