"""The whole job of the training-data operators against exact solutions of small cases."""

import collections
import functools
import math
import random

import pytest

from mnemoria.llm import packing, pii, scoring


def _fewest(lengths, capacity):
    """Fewest sequences by dynamic programming over subsets: (sequences, fill of the last)."""

    @functools.cache
    def go(left):
        if not left:
            return 0, capacity
        best = (len(lengths) + 1, 0)
        for k, x in enumerate(left):
            if k and left[k - 1] == x:
                continue
            bins, fill = go(left[:k] + left[k + 1 :])
            best = min(best, (bins, fill + x) if fill + x <= capacity else (bins + 1, x))
        return best

    return go(tuple(sorted(lengths)))[0]


def _packed(lengths, capacity):
    groups = packing.bin_completion(dict(collections.Counter(lengths)), capacity)
    used = collections.Counter()
    for filling, n in groups:
        assert sum(x * k for x, k in filling) <= capacity
        for x, k in filling:
            used[x] += k * n
    assert used == collections.Counter(lengths)
    return sum(n for _, n in groups)


def test_packing_needs_the_other_filling_of_one_waste():
    assert _packed([44, 43, 38, 34, 33, 30, 29, 26, 23], 100) == 3


@pytest.mark.parametrize("seed", range(4))
def test_packing_is_optimal_on_small_cases(seed):
    rng = random.Random(seed)
    for _ in range(60):
        capacity = rng.choice((20, 50, 100))
        low, high = rng.choice(((1, capacity), (capacity // 5, capacity // 2), (capacity // 8, capacity * 2 // 3)))
        kinds = [rng.randint(low, high) for _ in range(rng.randint(2, 11))]
        lengths = [rng.choice(kinds) for _ in range(11)] if rng.random() < 0.5 else kinds
        assert _packed(lengths, capacity) == _fewest(lengths, capacity), (lengths, capacity)


class _BruteTree:
    """Context-tree weighting with a dictionary of all nodes, by the recursion."""

    def __init__(self, texts):
        self.counts = collections.defaultdict(lambda: [0, 0])
        self.below = collections.defaultdict(set)
        for t in texts:
            for context, path, bit in self.steps(t):
                for d in range(scoring.DEPTH + 1):
                    self.counts[context[scoring.DEPTH - d :], path][bit] += 1
                    if d:
                        self.below[context[scoring.DEPTH - d + 1 :], path].add(context[scoring.DEPTH - d :])
        self.weighted = functools.cache(self._weighted)

    @staticmethod
    def steps(text):
        data = b"\0" * scoring.DEPTH + text + scoring.END
        for k in range(scoring.DEPTH, len(data)):
            bits = f"{data[k]:08b}"
            for j in range(8):
                yield data[k - scoring.DEPTH : k], bits[:j], int(bits[j])

    def kt(self, context, path):
        a, b = self.counts[context, path]
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1)

    def _weighted(self, context, path):
        own = self.kt(context, path)
        if len(context) == scoring.DEPTH:
            return own
        rest = sum(self.weighted(c, path) for c in self.below[context, path])
        m = max(own, rest)
        return m + math.log((math.exp(own - m) + math.exp(rest - m)) / 2)

    def log10(self, text):
        total = 0.0
        for context, path, bit in self.steps(text):
            p = 0.5
            for d in range(scoring.DEPTH, -1, -1):
                node = context[scoring.DEPTH - d :], path
                if node in self.counts:
                    a, b = self.counts[node]
                    w = 1.0 if d == scoring.DEPTH else math.exp(self.kt(*node) - math.log(2) - self.weighted(*node))
                    p = w * (b + 0.5) / (a + b + 1) + (1 - w) * p
            total += math.log10(p if bit else 1 - p)
        return total


def test_scores_are_those_of_the_tree(spark, monkeypatch):
    """Enough distinct contexts that a table of fixed size would have mixed up nodes; blocks of one text and of many."""
    rng = random.Random(8)
    letters = "abcdefghijklmnopqrstuvwxyz 0123456789é日"
    rows = [(k, k % 4 == 1, "".join(rng.choice(letters) for _ in range(rng.randint(0, 700)))) for k in range(60)]
    rows += [(90, True, None), (91, False, ""), (92, True, rows[2][2] * 2), (93, True, "ΩΩΩ unseen")]
    docs = spark.createDataFrame(rows, "doc_id long, held_out boolean, text string").repartition(3)
    brute = _BruteTree([(t or "").encode().lower() for _, held, t in rows if not held])
    want = {k: brute.log10((t or "").encode().lower()) for k, _, t in rows}
    fitted = scoring.fit(docs.filter("not held_out"))
    for size in (2_000_000, 500):
        monkeypatch.setattr(scoring, "BLOCK_BYTES", size, raising=False)
        got = {r["doc_id"]: r["score"] for r in scoring.score(docs, *fitted).collect()}
        assert got.keys() == want.keys()
        assert max(abs(got[k] - want[k]) for k in want) < 1e-6


def test_words_against_do_not_unmask():
    assert pii.redact_text("order: +49 30 123456789") == "order: <PHONE>"
    assert pii.redact_text("release serial 10.0.0.1, version 10.0.0.2") == "release serial <IP>, version <IP>"
