"""Training-data operators against brute force, with null, empty, long, repeated and clashing input."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from mnemoria.llm import chat, components, decontam, gif, langid, neardup, packing, pii, rans, scoring, substrings, suffixsort, tokens
from mnemoria.llm.tokens import PieceEncoder

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, block string, h string, key string, th string, seed string"


def _text(rng, words=60, vocab=None):
    return " ".join(rng.choice(vocab or [a + b for a in ("lo", "mi", "ta", "re", "so") for b in ("n", "st", "ra", "e", "ing")]) for _ in range(words))


@pytest.fixture(scope="module")
def rows():
    """Nulls, empties, near and exact copies, a repeated row, a long text, odd characters."""
    rng = random.Random(7)
    base = [_text(rng, 120, [f"w{k}" for k in range(400)]) for _ in range(12)]
    out = [(k, t) for k, t in enumerate(base)]
    near = base[0].split()
    near[60] = "changed"
    out += [(20, " ".join(near)), (21, base[1]), (22, base[1]), (22, base[1]), (23, None), (24, ""), (25, " \n"), (26, "one two"), (27, "ONE two"), (None, base[2]), (28, "é" * 50_000 + base[3]), (29, "It's 't  x y\x1cz İ ΑΣ. 日本"), (30, base[4][:450] + " tail " + base[5][100:600])]
    langs = ["en", "fr", None]
    return [(i, t, langs[k % 3], "s", None if t is None else len(t), "a", "b", "c", "d", "e") for k, (i, t) in enumerate(out)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def _ids(name, text, end):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    return np.array([*t.encode(text or "", add_special_tokens=False).ids, end], "<u4")


def test_packing(docs, empty, rows):
    path = public_tokenizers.path("word_bpe_49k.json")
    got = packing.pack(packing.token_pieces(docs, path)).collect()
    want = collections.Counter()
    for r in rows:
        ids = _ids("word_bpe_49k.json", r[1], 1)
        for k in range(0, len(ids), 4096):
            want[r[0], k // 4096, k, len(ids[k : k + 4096]), zlib.crc32(ids[k : k + 4096].tobytes())] += 1
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    by = collections.defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096
    assert packing.pack(packing.token_pieces(empty, path)).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_bin_completion(seed):
    rng = random.Random(seed)
    counts = collections.Counter(rng.randint(1, 40) for _ in range(60))
    groups = packing.bin_completion(dict(counts), 50)
    used = collections.Counter()
    for filling, n in groups:
        assert sum(length * k for length, k in filling) <= 50
        for length, k in filling:
            used[length] += k * n
    assert used == counts
    assert sum(n for _, n in groups) <= sum(n for _, n in packing.best_fit(dict(counts), 50))
    assert packing.bin_completion({}, 50) == []


@pytest.mark.parametrize(("name", "keep"), [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
def test_piece_encoder(name, keep, rows):
    encoder = PieceEncoder(public_tokenizers.path(name), keep)
    texts = [r[1] or "" for r in rows] + ["<|endoftext|> a<|startoftext|>b", " lead", "trail ", "a  b", "x\ny", "ab12 3c", "½ ² a_b __", "é x", "'s don't", "aΣ bΣ. ΣΑΣ"]
    for text, ids in zip(texts, encoder.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u2").tolist() == _ids(name, text, 0)[:-1].tolist(), text


@pytest.mark.parametrize(("name", "keep"), [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
def test_piece_encoder_on_odd_texts(name, keep, monkeypatch):
    """Any mixture of letters, digits, signs and white space; memos that are emptied often; several batches."""
    monkeypatch.setattr(tokens, "BATCH_BYTES", 300)
    monkeypatch.setattr(tokens, "MEMO_PIECES", 200)
    monkeypatch.setattr(tokens, "GATHER_PIECES", 7)
    rng, encoder, library = random.Random(1), PieceEncoder(public_tokenizers.path(name), keep), Tokenizer.from_file(public_tokenizers.path(name))
    parts = ["a", "b", "The", "word", " ", " ", "  ", "\n", "\t", "\xa0", "\u2009", ".", ",", "'s", "'", "1", "23", "²", "½", "é", "e\u0301", "Σ", "İ", "日", "-", "_", "<|endoftext|>", "\x1c", "\x85", "😀", "ß", "Ⅷ"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 9))) for _ in range(6000)] + ["x \xa0\xa0y", "10 \u2009\u2009km"]
    for text, ids, want in zip(texts, encoder.encode(texts), library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(ids, "<u2").tolist() == want.ids, text


def test_tokens(spark, docs, empty, rows, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    ids = [(r[0], _ids("byte_bpe_50k.json", r[1], 0)) for r in rows]
    ids.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1].astype("<u2").tobytes()))
    want, at = [], 0
    for k, i in ids:
        want.append((k, at, len(i), zlib.crc32(i.tobytes())))
        at += len(i)
    got = rans.read_blocks(rans.store_tokens(docs, path)).collect()
    order = lambda x: (x[1], x[2])
    assert sorted(((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in got), key=order) == sorted(want, key=order)
    assert rans.read_blocks(rans.store_tokens(empty, path)).count() == 0
    # the files alone are enough
    stored = rans.store_tokens(docs, path)
    stored.write.parquet(str(tmp_path / "copy"))
    again = rans.read_blocks(spark.read.parquet(str(tmp_path / "copy"))).collect()
    assert sorted(again, key=lambda r: r["start"]) == sorted(got, key=lambda r: r["start"])


def test_op8_starts_follow_the_ids(spark, docs, tmp_path):
    docs.filter("doc_id is not null").select("doc_id", "text").write.parquet(str(tmp_path / "documents.parquet"))
    out = rans.op8_tokens(spark, str(tmp_path)).orderBy("start").collect()
    assert [r["doc_id"] for r in out] == sorted(r["doc_id"] for r in out)
    assert [r["start"] for r in out] == [0, *np.cumsum([r["n_tokens"] for r in out])[:-1].tolist()]


def test_rans_round_trip():
    rng = np.random.default_rng(3)
    for n in (1, 2, 700, 5000, 3 * 512, 3 * 512 + 1, 3 * 512 - 1, 40_000):
        ids = np.minimum(500, rng.geometric(0.05, n)).astype(np.uint16)
        table = rans.write_table(rans.frequency_table(np.bincount(ids, minlength=65536), 16), 16)
        coder = rans.Coder(*rans.read_table(*table))
        head, body = coder.encode(ids, [None, -7], [1, n - 1], 11, lanes=64, every=8)
        block = rans.Block(head, body)
        assert (coder.decode(block) == ids).all() and block.start == 11
        null, doc_ids, lengths = block.documents()
        assert null.tolist() == [True, False] and doc_ids[1] == -7 and lengths.tolist() == [1, n - 1]
        for k in range(block.marks + 1):  # every checkpoint is a place to start from
            assert (coder.decode(block, k, k) == ids[512 * k : 512 * (k + 1)]).all()
        for place in (-1, 5):
            broken = bytearray(body)
            broken[place] ^= 1
            with pytest.raises(ValueError):
                coder.decode(rans.Block(head, bytes(broken)))
                rans.Block(head, bytes(broken)).documents()
    with pytest.raises(ValueError):
        rans.read_table(table[0], table[1][:-1] + b"x")


def _linked(a, b):
    return bool(a) and bool(b) and 100 * len(a & b) >= 80 * len(a | b)


def _components(sets):
    comp = {k: k for k in sets}

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and _linked(sets[a], sets[b]):
                x, y = find(a), find(b)
                comp[max(x, y)] = min(x, y)
    return {k: find(k) for k in sets}


@pytest.mark.parametrize("size", [4, 5])
def test_near_duplicates(docs, empty, rows, size):
    def shingles(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()

    sets = {r[0]: shingles(r[1]) for r in rows if r[0] is not None}
    want = _components(sets)
    got = neardup.near_duplicates(docs, size).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[r["doc_id"]]), want[r["doc_id"]], want[r["doc_id"]] == r["doc_id"])
    assert neardup.near_duplicates(empty, size).count() == 0


def test_near_duplicates_in_a_crowd(spark):
    """Many copies with edits of their own, some linked through others only."""
    rng = random.Random(5)
    base, texts = [f"b{k}" for k in range(80)], []
    for k in range(60):
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = f"x{k}_{rng.randrange(99)}"
        texts.append((k, " ".join(w)))
    sets = {k: {tuple(t.split()[j : j + 4]) for j in range(77)} for k, t in texts}
    got = neardup.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string"), 4).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == _components(sets)


@pytest.mark.parametrize("size", [4, 5])
def test_prefixes_lose_no_link(spark, size):
    """Copies of copies of unequal lengths around the threshold: every linked pair is tried, far fewer than all are."""
    rng = random.Random(11)
    texts = [[f"b{k}" for k in range(60)]]
    for _ in range(70):
        w = list(rng.choice(texts))
        for _ in range(rng.randint(0, 5)):
            at = rng.randrange(len(w))
            w[at : at + rng.choice((0, 1, 1, 2))] = [f"x{rng.randrange(40)}" for _ in range(rng.choice((0, 1, 1)))]
        texts.append(w)
    texts += [["a"], ["a", "b", "c", "d"], []]
    rows = [(k, " ".join(w)) for k, w in enumerate(texts)]
    sets = {k: {tuple(w[j : j + size]) for j in range(max(1, len(w) - size + 1))} if w else set() for k, w in enumerate(texts)}
    exploded = neardup._exploded(spark.createDataFrame(rows, "doc_id long, text string"), size)
    assert exploded.count() == sum(map(len, sets.values()))
    entries = neardup._prefixes(exploded, 80)
    linked = {(a, b) for a in sets for b in sets if a < b and _linked(sets[a], sets[b])}
    tried = {(r["u"], r["v"]) for r in neardup._prefix_pairs(entries.withColumn("comp", F.col("doc")), 80).collect()}
    assert linked <= tried and len(tried) < 0.5 * len(sets) * (len(sets) - 1) / 2
    comp = F.pmod("doc", F.lit(3)).cast("long")
    tried = {(r["u"], r["v"]) for r in neardup._prefix_pairs(entries.withColumn("comp", comp), 80).collect()}
    assert {(a, b) for a, b in linked if a % 3 != b % 3} <= tried and all(a % 3 != b % 3 for a, b in tried)


def test_components(spark):
    edges = [(k, k + 1) for k in range(1, 30)] + [(100, k) for k in range(101, 120)] + [(5, 3)]
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**dict.fromkeys(range(1, 31), 1), **dict.fromkeys(range(100, 120), 100)}
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_gif(docs, empty, rows):
    frames = gif.gif_frames(gif.gif_media(docs))
    got = {(r["doc_id"], r["n_bytes"]): r for r in gif.gif_features(frames).collect()}
    stored = {(r["doc_id"], r["n_bytes"]): r["frames"] for r in frames.collect()}
    for r in rows:
        raw = (r[1] or "").encode()
        payload = raw + b"\0" * (-len(raw) % 64 if raw else 64)
        g = got[r[0], len(raw)]
        assert (g["payload_bytes"], g["payload_sha256"], g["tail_crc32"]) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        media = gif.payload_to_gif(payload)
        assert (g["media_bytes"], g["media_sha256"]) == (len(media), hashlib.sha256(media).hexdigest())
        # what is shown: the colours of all bytes but the transparent zeros, by 2 bits each
        shown = np.zeros(64, int)
        for byte, n in collections.Counter(payload).items():
            if byte:
                red, green, blue = (int(c) >> 6 for c in gif.PALETTE[byte])
                shown[red << 4 | green << 2 | blue] += n
        timed = stored[r[0], len(raw)]
        assert [f["height"] for f in timed] == [min(4096, len(payload) // 64 - k) for k in range(0, len(payload) // 64, 4096)]
        assert [(f["frame"], f["start"], f["delay"], f["disposal"], f["transparent"], f["width"]) for f in timed] == [(k, 4 * k, 4, 2, 0, 64) for k in range(len(timed))]
        assert np.sum([f["histogram"] for f in timed], axis=0).tolist() == shown.tolist()
        assert g["feature"] == f"frames={len(timed)};cs={4 * len(timed)};rgb={','.join(map(str, shown.tolist()))}"
    assert gif.gif_features(gif.gif_frames(gif.gif_media(empty))).count() == 0


def test_gif_format():
    # a well-known 10 x 10 sample: red, blue and white squares, 2-bit codes
    stream = bytes.fromhex("8C2D99872A1CDC33A00275EC95FAA8DE608C04914C01")
    pixels = gif.lzw_decode(stream, 2, 100)
    assert pixels[:10] == bytes([1, 1, 1, 1, 1, 2, 2, 2, 2, 2]) and len(pixels) == 100
    assert gif.lzw_encode(pixels, 2) == stream
    red = np.array([[0, 1], [2, 3]], np.uint8)
    palette = np.array([[255, 0, 0], [0, 255, 0], [0, 0, 255], [9, 9, 9]], np.uint8)
    first = np.full((2, 2), 1, np.uint8)
    for disposal, corner in ((1, [0, 255, 0, 255]), (2, [0, 0, 0, 0]), (3, [0, 0, 0, 0])):
        frames = gif.decode_gif(gif.encode_gif([first, red], palette, delay=7, disposal=disposal, transparent=3))
        assert [f.delay for f in frames] == [7, 7]
        assert frames[1].canvas[1, 1].tolist() == corner  # the transparent pixel shows what was there
        assert frames[1].canvas[0, 0].tolist() == [255, 0, 0, 255]
    assert gif.colour_histogram(frames[1]).sum() == 3


def test_suffix_sort():
    rng = random.Random(1)
    for _ in range(300):
        base = bytes(rng.choice(b"ab") for _ in range(40))
        s = [base[: rng.randint(0, 40)] + bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 3))) for _ in range(rng.randint(0, 12))]
        assert [s[k] for k in suffixsort.deep_shallow(s)] == sorted(s)


def _repeats(texts):
    seen = collections.Counter(t[k : k + 400] for t in texts for k in range(len(t) - 399))
    for t in texts:
        gone = np.zeros(len(t) + 1, int)
        for k in range(len(t) - 399):
            if seen[t[k : k + 400]] > 1:
                gone[k] += 1
                gone[k + 400] -= 1
        gone = np.cumsum(gone)[:-1] > 0
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        yield len(t), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest()


def test_repeats(docs, empty, rows):
    rows = [r for r in rows if r[0] != 28]  # brute force is slow on the long one
    want = collections.Counter((r[0], *x) for r, x in zip(rows, _repeats([(r[1] or "").encode() for r in rows]), strict=True))
    got = substrings.remove_repeats(docs.filter("doc_id is null or doc_id <> 28")).collect()
    assert collections.Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == want
    assert substrings.remove_repeats(empty).count() == 0


def test_repeats_in_many_surroundings(spark, monkeypatch):
    """A shared passage in new surroundings each time, some of them shared by two; both ways of grouping."""
    rng = random.Random(9)
    passage = _text(rng, 75)
    texts = [_text(rng, 30) + passage + _text(rng, 30) for _ in range(40)] + ["a" * 1500]
    texts += [texts[3][:-50] + _text(rng, 40), texts[4][20:] + "x"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = [(k, *x) for k, x in enumerate(_repeats([t.encode() for t in texts]))]
    for hot, small in ((2048, 24), (2048, 1), (1, 24)):
        monkeypatch.setattr(substrings, "SMALL_GROUP", small)
        groups = [(1, -k % 200 - 0, 0, t[: (k % 200) + 400].encode()) for k, t in enumerate([passage[:100] + _text(rng, 80) for _ in range(3)])]
        assert len(substrings.repeated_windows(groups)) == 3
        monkeypatch.setattr(substrings, "HOT_CLASSES", hot)
        got = substrings.remove_repeats(df).orderBy("doc_id").collect()
        assert [(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got] == want


def test_chat_rows(spark):
    rows = [(1, 0, "user", "hi <s>[INST]\\b"), (1, 1, "assistant", "</s>[INST] ok [/INST]"), (1, 2, "user", None), (2, 0, None, "x"), (2, 0, "assistant", "same place"), (2, 0, "assistant", "same place"), (None, 5, "assistant", "é\\l[")]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, node string")
    m = chat.thread(df)
    got = {r["conv_id"]: r for r in chat.digest(chat.format_paths(m, chat.best_paths(m))).collect()}
    assert set(got) == {1, 2, None}
    for c in got:
        turns = sorted(((r[1], r[2] or "", r[3] or "") for r in rows if r[0] == c), key=lambda x: x)
        learned = "".join(t for _, role, t in turns if role == "assistant")
        assert got[c]["n_turns"] == len(turns)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in turns).encode()).hexdigest()
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())
    assert chat.best_paths(chat.thread(df.limit(0))).count() == 0


def test_reply_trees(spark):
    """Two branches and a circle: the branch with the better mean score wins; rank 2 is the other."""
    msgs = [(1, 1, None, 0.0, "user", "root"), (1, 2, 1, 1.0, "assistant", "good"), (1, 3, 1, 0.0, "assistant", "bad"), (1, 4, 2, 1.0, "user", "more"), (1, 8, 9, 5.0, "user", "circle"), (1, 9, 8, 5.0, "user", "circle")]
    df = spark.createDataFrame(msgs, "conv_id long, node long, parent long, score double, role string, text string")
    paths = chat.best_paths(df, 2).collect()
    by = collections.defaultdict(dict)
    for p in paths:
        by[p["rank"]][p["place"]] = p["node"]
    assert {k: [v[i] for i in sorted(v)] for k, v in by.items()} == {1: [1, 2, 4], 2: [1, 3]}


def test_scores(spark, docs, empty, rows):
    held = {k: k is not None and zlib.crc32(str(k).encode()) % 7 == 2 for k in (r[0] for r in rows)}
    d = docs.select("doc_id", scoring.id_bucket("doc_id", 7).eqNullSafe(2).alias("held_out"), "text")
    fitted = scoring.fit(d.filter("not held_out"))
    got = scoring.score(d, *fitted).collect()
    count = collections.Counter()
    for r in rows:
        if not held[r[0]]:
            count.update((r[1] or "").encode().lower().split())
            count[None] += 1
    n, v = sum(count.values()), len(count)
    want = []
    for r in rows:
        w = [*(r[1] or "").encode().lower().split(), None]
        want.append((str(r[0]), held[r[0]], len(w), sum(count[x] > 0 for x in w), n, round(sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w), 4)))
    assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in got) == sorted(want)
    assert all(r["score"] < 0 for r in got)
    text = {r[0]: (r[1] or "").encode() for r in rows}
    assert all(abs(r["bits_per_byte"] * (len(text[r["doc_id"]]) + 1) + r["score"] * math.log2(10)) < 1e-6 for r in got)
    # the model is a distribution: the probabilities of all bytes after a context add up to 1
    for context in (b"\0\0\0\0", b"w12 ", b"\xffzq\x01"):
        code = int.from_bytes(context, "big") << 8
        assert abs((10 ** fitted[0].log10(np.arange(code, code + 256, dtype=np.uint64))).sum() - 1) < 1e-9
    assert scoring.score(empty.select("doc_id", F.lit(True).alias("held_out"), "text"), *scoring.fit(empty)).count() == 0
    assert scoring.score(d, *scoring.fit(empty)).count() == len(rows)


def test_weighting_by_hand():
    """Weights of a small tree against the recursion written out."""
    codes, n = np.array([5 << 8 | 200, 5 << 8 | 10, 7 << 8 | 200], np.uint64), np.array([3.0, 1.0, 2.0])
    levels, _ = scoring.weigh(codes, n, 0)
    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1)
    # first decision: 200 is a one, 10 a zero; contexts 5 (1 zero, 3 ones) and 7 (0, 2); all depths down to 1 have the same contexts
    weighted = {c: kt(a, b) for c, (a, b) in {5: (1, 3), 7: (0, 2)}.items()}
    for _ in range(scoring.DEPTH - 1):
        weighted = {c: np.logaddexp(kt(*{5: (1, 3), 7: (0, 2)}[c]), w) - math.log(2) for c, w in weighted.items()}
    root = np.logaddexp(kt(1, 5), sum(weighted.values())) - math.log(2)
    depth, keys, counts, weight = levels[-1]
    k = keys.tolist().index(1)
    assert depth == 0 and counts[k].tolist() == [1.0, 5.0]
    assert abs(weight[k] - math.exp(kt(1, 5) - math.log(2) - root)) < 1e-9


def _brute_overlaps(texts, items):
    """All documents and items, every diagonal, from the definition."""
    dense = "[\u3040-\u30ff\u4e00-\u9fff]"

    def tokens(t):
        return re.findall(r"[^\W_]+", re.sub(f"({dense})", r" \1 ", (t or "").lower()))

    def seeds(w, at):
        return {(k, *(w[at + j] for j in m)) for k, m in enumerate(decontam.MASKS) if at + m[-1] < len(w)}

    out = {}
    for doc, text in texts:
        d = tokens(text)
        for item, t in items:
            w = tokens(t)
            if not w:
                continue
            best = 0
            for diagonal in range(-len(w) + 1, len(d)):
                pairs = [(i, diagonal + i) for i in range(len(w)) if 0 <= diagonal + i < len(d)]
                if len(w) < decontam.SHORTEST:
                    fits = len(pairs) == len(w) and all(w[i] == d[j] for i, j in pairs) and (len(w) >= decontam.LEAST_EXACT or len(d) == len(w))
                    best = max(best, len(w) if fits else 0)
                elif any(seeds(w, i) & seeds(d, j) for i, j in pairs):
                    here = 0
                    for i, j in pairs:
                        here = max(0, here + (1 if w[i] == d[j] else -1))
                        best = max(best, here)
            least = len(w) if len(w) < decontam.SHORTEST else min(decontam.LEAST_RUN, math.ceil(len(w) * decontam.LEAST_SHARE))
            if best >= least:
                out[doc, item] = best
    return out


def test_decontamination(spark, docs, empty, tmp_path):
    rng = random.Random(2)
    vocab = [f"q{j}" for j in range(60)]
    items = [(k, _text(rng, rng.randint(8, 40), vocab)) for k in range(20)] + [(30, "too short"), (31, None), (32, "one of seven words in a row"), (33, "今天天气很好我们去公园吧"), (34, "five words are enough here"), (35, ""), (36, "a b c d")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    texts = [(k, _text(rng, rng.randint(1, 60), vocab)) for k in range(25)]
    for k in range(25, 60):
        w = (items[k % 20][1] or "").split()
        for _ in range(rng.randint(0, 8)):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        a = rng.randrange(len(w))
        texts.append((k, _text(rng, rng.randint(0, 5), vocab) + " " + " ".join(w[a // 2 :]).upper() + ", " + _text(rng, rng.randint(0, 20), vocab)))
    texts += [(70, None), (71, ""), (72, "so One of seven; words in a row, then"), (73, "他说今天天气很好我们去公园吧。"), (74, "too short"), (75, "this is too short indeed"), (76, "five words are enough here"), (77, "a b c d"), (78, "a b c d e")]
    found = texts + [(25, texts[25][1])]
    got = decontam.contaminated(spark.createDataFrame(found, "doc_id long, text string").repartition(3), bench).collect()
    want = _brute_overlaps(texts, items)
    assert {(r["doc_id"], r["item_id"]): r["run"] for r in got} == want and len(got) == len(want)
    assert {(72, 32), (73, 33), (74, 30), (76, 34), (77, 36)} <= set(want) and not any(d in (75, 78) for d, _ in want)
    spark.createDataFrame(found, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    assert {(r["doc_id"], r["item_id"]): r["run"] for r in decontam.op7_decontam(spark, str(tmp_path)).collect()} == want
    assert decontam.contaminated(docs, bench).count() == 0
    assert decontam.contaminated(empty, bench).count() == 0
    assert decontam.contaminated(docs, bench.limit(0)).count() == 0


def test_decontamination_of_a_long_text(spark):
    """200,000 tokens in one document, without any broadcast."""
    rng = random.Random(6)
    items = [(k, _text(rng, 40, [f"z{j}" for j in range(5000)])) for k in range(50)]
    text = " ".join([_text(rng, 100_000, [f"y{j}" for j in range(50_000)]), items[7][1], _text(rng, 100_000, [f"y{j}" for j in range(50_000)])])
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        got = decontam.contaminated(spark.createDataFrame([(1, text)], "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert [(r["doc_id"], r["item_id"], r["n_equal"]) for r in got] == [(1, 7, 40)]


def test_decontamination_is_native(spark, docs):
    bench = spark.createDataFrame([(1, _text(random.Random(1)))], "item_id long, text string")
    plan = decontam.contaminated(docs, bench)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_language(spark, docs, empty):
    words = {"en": "the of and with this that from have".split(), "de": "der die das und nicht mit auch sich".split(), "fr": "le la les des dans pour avec une".split(), "es": "el los las una para con por que".split()}
    rng = random.Random(4)
    rows = [(k, _text(rng, rng.randint(4, 40), words[lang]), lang) for k, lang in enumerate(list(words) * 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("held_out", langid.held_out_rows())
    out = langid.predict(df, langid.train(df.filter("not held_out")), ["lang", "held_out"]).filter("held_out").collect()
    assert out and sum(r["lang"] == r["lang_pred"] for r in out) / len(out) > 0.97
    assert all(0 <= r["lang_score"] <= 1 for r in out)
    odd = {r["doc_id"]: r["lang_pred"] for r in langid.predict(docs, langid.train(df), ["doc_id"]).collect()}
    assert odd[23] == odd[24] == odd[25] == langid.UND
    signs = spark.createDataFrame([(1, "½"), (2, "② Ⅷ"), (3, "123 _"), (4, "日"), (5, "½ a")], "doc_id long, text string")
    assert {r["doc_id"]: r["lang_pred"] == langid.UND for r in langid.predict(signs, langid.train(df), ["doc_id"]).collect()} == {1: True, 2: True, 3: True, 4: False, 5: False}
    assert langid.train(empty) is None
    assert {r["lang_pred"] for r in langid.predict(docs, None, ["doc_id"]).collect()} == {langid.UND}


def _brute_spans(text):
    kinds = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))
    out = []
    for k, (kind, pattern) in enumerate(kinds):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")) or kind == "card" and not (14 <= len(digits) <= 19 and pii.luhn(digits)) or kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), k, kind, m.end()))
    return ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in sorted(out))


def test_pii(docs, empty, spark):
    rng = random.Random(3)
    parts = ["a", "@", ".", "1", "22", "+", " ", "-", "(", ")", "x.y", "4111 1111 1111 1111", "é", "%", "255.1"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(3000)] + [None, "", "a" * 100_000 + "@b.c", "1." * 50_000, "0" * 6000 + ".1.1.1"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.pii_spans(df).collect():
        want = _brute_spans(texts[r["doc_id"]] or "") if r["doc_id"] < 3002 else None
        if want is not None:
            assert r["base_sha256"] == hashlib.sha256(want.encode()).hexdigest(), texts[r["doc_id"]]
    assert [x[0] for x in pii.find_spans("iban GB82 WEST 1234 5698 7654 32, not GB83 WEST 1234 5698 7654 32")] == ["iban"]
    assert pii.redact_text("mail a@b.co or 10.0.0.1") == "mail <EMAIL> or <IP>"
    assert pii.redact(docs).columns == docs.columns and pii.redact(docs).count() == docs.count()
    assert pii.pii_spans(empty).count() == 0


def test_pipeline(spark, tmp_path, rows):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    plain = spark.createDataFrame([r[:5] for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    item = rows[6][1]
    plain.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item[:300])], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = {r["doc_id"] for r in docs.select("doc_id").collect()}
    assert {23, 24, 25} & kept["language_id"] == set() and {0, 26, 29} <= kept["language_id"]
    assert {20, 21, 22, 27} & kept["near_dedup"] == set() and {0, 1, 26} <= kept["near_dedup"]
    assert 6 not in kept["decontaminate"] and kept["near_dedup"] - {6} == kept["decontaminate"]
    assert kept["mask_pii"] == kept["decontaminate"] == kept["best_fit_packing"]
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == kept["best_fit_packing"]
