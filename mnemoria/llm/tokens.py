"""Token ids by the tokenizers library, with an exact memo of the pieces that texts are made of.

Both tokenizers used here split a text into runs of letters, of digits, of other signs and white space
before they merge; no token spans two runs, and a run takes one space before it at most. So the ids of a
text are the ids of its runs in order. Texts are cut at spaces, and Arrow numbers the distinct pieces of
a batch; a piece seen for the first time is cut into runs, and the vocabulary's merges encode each run
seen for the first time. The ids of a batch are then gathered from the memo by NumPy.

Where that reasoning does not hold, the library encodes the whole piece or the whole text: special
tokens, three white spaces in a row or two at the end (with spaces kept), contractions, control signs
that Python and the tokenizer class differently, characters that normalise together, and letters beyond
U+0500. A memo is emptied after a batch that leaves more in it than MEMO_PIECES, MEMO_RUNS or MEMO_BYTES.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of texts that are encoded together, about; a longer text is encoded alone.
BATCH_BYTES = 8_000_000
#: Pieces whose ids are gathered at a time.
GATHER_PIECES = 1 << 18
#: Most entries of the memos of pieces and of runs, and most bytes of the pieces in all.
MEMO_PIECES, MEMO_RUNS, MEMO_BYTES = 500_000, 125_000, 20_000_000

#: How byte-level vocabularies write a byte. Printable Latin-1 bytes stand for themselves,
#: the others for the characters from 256 on, in order.
_PRINTED = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_OTHERS = [b for b in range(256) if b not in _PRINTED]
_BYTE_CHARS = {**{b: chr(b) for b in _PRINTED}, **{b: chr(256 + k) for k, b in enumerate(_OTHERS)}}

_SPACE = _BYTE_CHARS[0x20]

_RUNS = re.compile(r" ?[^\W\d_]+| ?[0-9]+| ?(?:[^\w\s]|_)+|\s")  # with spaces kept
_SOLID = re.compile(r"[^\W\d_]+|[0-9]|(?:[^\w\s]|_)+")
_NOT_ASCII = re.compile(r"[^\x00-\x7f]+")
#: Python and the tokenizer class these differently.
_CONTROL = re.compile("[\x1c-\x1f\x85]")
#: For RE2: white space of either, three in a row or two at the end.
_WHITE = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_ODD = rf"{_WHITE}{{3}}|{_WHITE}{{2}}\z"


class PieceEncoder:
    """Encodes texts to ids of 16 bits (both vocabularies are below 65,536).

    keep_space: a piece carries the space before it (byte-level vocabulary) or not (word vocabulary,
    which drops white space and case, so that every space is a boundary).
    """

    def __init__(self, path: str, keep_space: bool):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        if self.tokenizer.get_vocab_size() > 65_536:
            raise ValueError("this encoder keeps ids in 16 bits")
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.merges = self.tokenizer.model.tokenize
        self.two_bytes = [k.to_bytes(2, "little") for k in range(1 << 16)]
        self.keep_space = keep_space
        self.find = (_RUNS if keep_space else _SOLID).findall
        self._empty()

    def _empty(self) -> None:
        self.known = pa.array([], pa.large_string())  # pieces; the k-th has its ids in slot self.slots[k]
        self.slots = np.zeros(0, np.int32)
        self.heads: dict[str, int] = {}  # first pieces of texts, with spaces kept: their slots
        self.runs: dict[str, bytes] = {}
        self.starts, self.lens, self.ids = np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, "<u2")

    def _store(self, values: list[bytes]) -> np.ndarray:
        """Slots for some ids."""
        lens = np.fromiter(map(len, values), np.int32, len(values)) // 2
        starts = len(self.ids) + np.cumsum(lens, dtype=np.int32) - lens
        first = len(self.starts)
        self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(values), "<u2")])
        self.starts, self.lens = np.concatenate([self.starts, starts]), np.concatenate([self.lens, lens])
        return np.arange(first, first + len(values), dtype=np.int32)

    def _whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u2").tobytes()

    def _plain(self, piece: str) -> bool:
        """Whether the runs of a piece can be encoded one by one."""
        if "'" in piece or not piece.isprintable() and _CONTROL.search(piece):
            return False
        if piece.isascii():
            return True
        if max(piece) >= "\u0500" or not "".join(_NOT_ASCII.findall(piece)).isalpha():
            return False
        return self.keep_space or "\u0130" not in piece and "\u03a3" not in piece and unicodedata.is_normalized("NFC", piece)

    def _run(self, run: str) -> bytes:
        """A run's ids by the vocabulary's merges."""
        word = run if self.keep_space else run.lower()
        if not word.isascii() or not word.isprintable():
            word = word.encode().decode("latin-1").translate(_BYTE_CHARS)
        elif word[0] == " ":  # other printed ASCII signs stand for themselves
            word = _SPACE + word[1:]
        two = self.two_bytes
        ids = self.runs[run] = b"".join([two[t.id] for t in self.merges(word)])
        return ids

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        runs, find, plain, whole, run, out = self.runs.get, self.find, self._plain, self._whole, self._run, []
        for p in pieces:
            if p.isascii() and p.strip(" ").isalpha():  # most are one run
                out.append(runs(p) or run(p))
            elif plain(p):
                cut = find(p)
                out.append((runs(cut[0]) or run(cut[0])) if len(cut) == 1 else b"".join([runs(r) or run(r) for r in cut]))
            else:
                out.append(whole(p))
        return out

    def _slots_of(self, texts: pa.Array, end: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Slots of all pieces of the texts, and where each text ends among them."""
        odd = pa.array(np.zeros(len(texts), bool))
        if self.keep_space:
            odd = pc.match_substring_regex(texts, _ODD)
        for s in self.special:
            odd = pc.or_(odd, pc.match_substring(texts, s))
        rest = pc.if_else(odd, pa.scalar("", pa.large_string()), texts)
        split = pc.split_pattern(rest if self.keep_space else pc.ascii_lower(rest), " ")
        values, offsets = split.values, split.offsets.to_numpy()
        offsets = offsets[: len(texts) + 1]
        values = values.slice(int(offsets[0]), int(offsets[-1] - offsets[0])).dictionary_encode()
        offsets = offsets - offsets[0]
        found = pc.index_in(values.dictionary, value_set=self.known)
        slots = np.zeros(len(values.dictionary), np.int32)
        missing = np.flatnonzero(found.is_null().to_numpy(zero_copy_only=False))
        hit = np.flatnonzero(found.is_valid().to_numpy(zero_copy_only=False))
        slots[hit] = self.slots[found.drop_null().to_numpy()]
        if len(missing):
            new = values.dictionary.take(pa.array(missing))
            strings = new.to_pylist()
            slots[missing] = self._store(self._pieces([" " + p for p in strings] if self.keep_space else strings))
            self.known = pa.concat_arrays([self.known, new])
            self.slots = np.concatenate([self.slots, slots[missing]])
        codes = values.indices.to_numpy()
        at = slots[codes]
        if self.keep_space:
            heads = values.dictionary.take(pa.array(codes[offsets[:-1]])).to_pylist()
            new = list(set(heads).difference(self.heads))
            self.heads.update(zip(new, self._store(self._pieces(new)).tolist(), strict=True))
            at[offsets[:-1]] = [self.heads[h] for h in heads]
        odd = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        if len(odd):
            at[offsets[odd]] = self._store([self._whole(t) for t in texts.take(pa.array(odd)).to_pylist()])
        if end is None:
            return at, offsets[1:]
        last = self._store([self.two_bytes[end]])[0]
        return np.insert(at, offsets[1:], last), offsets[1:] + np.arange(1, len(texts) + 1)

    def _gather(self, at: np.ndarray) -> np.ndarray:
        """The ids in these slots, one after another."""
        parts = [np.zeros(0, "<u2")]
        for k in range(0, len(at), GATHER_PIECES):
            some = at[k : k + GATHER_PIECES]
            lens = self.lens[some]
            place = np.repeat(self.starts[some] - np.cumsum(lens, dtype=np.int32) + lens, lens)
            place += np.arange(len(place), dtype=np.int32)
            parts.append(self.ids[place])
        return np.concatenate(parts)

    def encode_column(self, texts: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and where each text starts and the last ends; null is empty.

        end: an id that is appended to each text.
        """
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        sizes = np.cumsum(pc.binary_length(texts).to_numpy())
        ids, ends, at = [np.zeros(0, "<u2")], [np.zeros(1, np.int64)], 0
        while at < len(texts):
            done = sizes[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(sizes, done + BATCH_BYTES, side="right")))
            slots, last = self._slots_of(texts.slice(at, to - at), end)
            ids.append(self._gather(slots))
            sums = np.concatenate([[0], np.cumsum(self.lens[slots], dtype=np.int64)])
            ends.append(sums[last] + ends[-1][-1])
            if len(self.runs) > MEMO_RUNS:
                self.runs = {}
            if len(self.starts) > MEMO_PIECES or self.known.nbytes > MEMO_BYTES:
                self._empty()
            pa.default_memory_pool().release_unused()  # else each worker keeps its largest batch
            at = to
        return np.concatenate(ids), np.concatenate(ends)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text, as little-endian bytes."""
        ids, ends = self.encode_column(pa.array(texts, pa.string()))
        return [ids[a:b].tobytes() for a, b in zip(ends, ends[1:], strict=False)]


@lru_cache(maxsize=4)
def encoder(path: str, keep_space: bool) -> PieceEncoder:
    """One encoder for each Python worker; its memo outlives a task."""
    return PieceEncoder(path, keep_space)
