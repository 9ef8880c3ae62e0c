"""Best-fit packing of token sequences by bin completion.

A document is its token ids and an end id. Longer ones are cut into pieces of the capacity; every full
piece is a sequence of its own, and the remainders are packed. Remainders of one length are
interchangeable, so the solver sees only how many there are of each length (at most `capacity` numbers,
whatever the corpus) and answers with groups: a filling and how many sequences have it. Rows then find
their place by their rank among the remainders of their length, which is counted in salted groups.

Defined cases: a null text is the empty text (one piece that holds the end id); no rows give no rows;
repeated rows are packed as often as they occur; other columns of the input are ignored.
"""

from __future__ import annotations

import bisect
import random
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_stream, gathered, materialize, read
from .tokens import BATCH_BYTES, encoder

CAPACITY = 4096
END_ID = 1
#: Nodes of the search over sequences; then the best solution so far stands.
SEARCH_NODES = 200_000
#: Nodes of all enumerations of fillings together; as above.
FILL_NODES = 4_000_000
#: Rows that one task ranks, about.
RANK_ROWS = 20_000

Groups = list[tuple[tuple[tuple[int, int], ...], int]]


def best_fit(counts: dict[int, int], capacity: int) -> Groups:
    """Best-fit decreasing on lengths with multiplicities: (filling as (length, copies), sequences)."""
    open_groups: dict[int, list[tuple[tuple[tuple[int, int], ...], int]]] = {}
    room: list[int] = []  # sorted keys of open_groups
    done: Groups = []

    def put(left: int, filling: tuple[tuple[int, int], ...], n: int) -> None:
        if left == 0:
            done.append((filling, n))
            return
        if left not in open_groups:
            bisect.insort(room, left)
            open_groups[left] = []
        open_groups[left].append((filling, n))

    for length in sorted(counts, reverse=True):
        rest = counts[length]
        while rest:
            k = bisect.bisect_left(room, length)
            if k == len(room):
                left, filling, n = capacity, (), rest
            else:
                left = room[k]
                filling, n = open_groups[left].pop()
                if not open_groups[left]:
                    del open_groups[left]
                    room.pop(k)
            each = min(left // length, rest)
            full = min(n, rest // each)
            if filling and n > full:
                put(left, filling, n - full)
            put(left - each * length, (*filling, (length, each)), full)
            rest -= full * each
    return done + [g for gs in open_groups.values() for g in gs]


class Remainders:
    """What is left to pack: copies by length, the lengths in ascending order, and a number for the state."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.left = dict(counts)
        self.lengths = sorted(counts)
        self.bits = sum(1 << x for x in counts)
        rng = random.Random(0)
        self.codes = {x: rng.getrandbits(128) for x in self.lengths}
        self.state = sum(self.codes[x] * n for x, n in counts.items()) & _STATE
        #: for each length the sums up to the capacity that it and shorter ones can make, as bits
        self.sums: dict[int, int] = {}
        sums, mask = 1, (1 << (capacity + 1)) - 1
        for x in self.lengths:
            n, k = min(counts[x], capacity // x), 1
            while n > 0:
                k = min(k, n)
                sums |= sums << (x * k) & mask
                n, k = n - k, 2 * k
            self.sums[x] = sums

    def add(self, x: int, n: int) -> None:
        """Put n copies of x back, or take them out if n is negative."""
        before = self.left[x]
        self.left[x] = before + n
        self.state = (self.state + self.codes[x] * n) & _STATE
        if (before == 0) != (before + n == 0):
            self.bits ^= 1 << x
            if before:
                self.lengths.pop(bisect.bisect_left(self.lengths, x))
            else:
                bisect.insort(self.lengths, x)


_STATE = (1 << 128) - 1


def _dominated(rest: Remainders, chosen: tuple[tuple[int, int], ...], waste: int) -> bool:
    """Whether a length that is left can take the place of some chosen ones (or of none) that sum up to at most it."""

    def hit(items: tuple[tuple[int, int], ...], lengths: int) -> bool:
        sums = 1
        for x, n in items:
            k = 1
            while n > 0:
                k = min(k, n)
                sums |= sums << (x * k)
                n, k = n - k, 2 * k
        width = 1
        while width <= waste:  # every sum and up to `waste` more
            step = min(width, waste + 1 - width)
            sums |= sums << step
            width += step
        return bool(sums & lengths)

    if hit(chosen, rest.bits & ~sum(1 << x for x, _ in chosen)):
        return True
    return any(rest.left[x] > n and hit(tuple(c for c in chosen if c[0] != x), 1 << x) for x, n in chosen)


def fillings(rest: Remainders, room: int, low: int, high: int, nodes: list[int]) -> Iterator[tuple[int, tuple[tuple[int, int], ...]]]:
    """All undominated fillings of `room` that waste more than `low` and at most `high`, as (waste, filling).

    A filling is dominated (Martello and Toth) if the items of another one can take in all of its items,
    some of them several. It is enough to look for one length that is left and could replace a part of the
    filling. nodes[0] is counted down; at 0 the enumeration ends early.
    """

    def go(end: int, left: int, chosen: tuple[tuple[int, int], ...]) -> Iterator[tuple[int, tuple[tuple[int, int], ...]]]:
        nodes[0] -= 1
        if nodes[0] < 0:
            return
        if low < left <= high and not _dominated(rest, chosen, left):
            yield left, chosen
        least = max(0, left - high)
        for j in range(min(end, bisect.bisect_right(rest.lengths, left)) - 1, -1, -1):
            x = rest.lengths[j]
            if not (rest.sums[x] & ((1 << (left + 1)) - 1)) >> least:
                return  # this and shorter ones cannot fill enough
            for n in range(min(rest.left[x], left // x), 0, -1):
                yield from go(j, left - n * x, (*chosen, (x, n)))
                if nodes[0] < 0:
                    return

    yield from go(len(rest.lengths), room, ())


def completions(rest: Remainders, room: int, slack: int, nodes: list[int]) -> Iterator[tuple[int, tuple[tuple[int, int], ...]]]:
    """All undominated fillings of `room` that waste at most `slack`, in bands of rising waste."""
    low, high, slack = -1, 0, min(slack, room)
    while low < slack and nodes[0] >= 0:
        yield from fillings(rest, room, low, high, nodes)
        low, high = high, min(slack, 2 * high + 1)


def bin_completion(counts: dict[int, int], capacity: int = CAPACITY, search_nodes: int = SEARCH_NODES, fill_nodes: int = FILL_NODES) -> Groups:
    """Branch and bound over completions of the sequence around the largest remaining length.

    A level fills n sequences alike: every undominated filling is tried, each with the greatest number of
    copies first and then with fewer, down to one. The waste that a better solution may have is
    (incumbent - 1) * capacity - total; a branch that wastes more is left. So is a state that was reached
    before with as few sequences. The first incumbent is best fit; reaching the bound
    ceil(total / capacity) ends the search. Within the two numbers of nodes the result is optimal; when
    one is used up, the best solution so far stands.
    """
    counts = {k: n for k, n in counts.items() if n > 0}
    if not counts:
        return []
    total = sum(k * n for k, n in counts.items())
    bound = -(-total // capacity)
    best = best_fit(counts, capacity)
    used = sum(n for _, n in best)
    if used == bound:
        return best
    rest, nodes = Remainders(counts, capacity), [fill_nodes]
    seen: dict[int, int] = {}  # state: fewest sequences that led to it
    stack: list[dict] = []  # one level for each filling that is in use
    wasted, bins = 0, 0
    while search_nodes > 0 and nodes[0] >= 0 and used > bound:
        search_nodes -= 1
        allowed = (used - 1) * capacity - total
        if not rest.lengths:
            if bins < used:
                best, used = [(s["filling"], s["n"]) for s in stack], bins
        elif wasted <= allowed and seen.get(rest.state, bins + 1) > bins:
            seen[rest.state] = bins
            top = rest.lengths[-1]
            stack.append({"top": top, "options": completions(rest, capacity - top, allowed - wasted, nodes), "n": 0})
        while stack:
            level = stack[-1]
            n = level["n"]
            if n:  # undo
                for x, k in level["filling"]:
                    rest.add(x, k * n)
                wasted -= level["waste"] * n
                bins -= n
            if n > 1:
                n -= 1
            else:
                top = level["top"]
                rest.add(top, -1)  # the options are those of what is left besides it
                option = next(level["options"], None)
                rest.add(top, 1)
                if option is None:
                    stack.pop()
                    continue
                merged = {top: 1}
                for x, k in option[1]:
                    merged[x] = merged.get(x, 0) + k
                level |= {"filling": tuple(merged.items()), "waste": option[0]}
                n = min(rest.left[x] // k for x, k in merged.items())
                if level["waste"]:  # more copies than the allowed waste has room for lead nowhere
                    n = min(n, ((used - 1) * capacity - total - wasted) // level["waste"])
                if n < 1:
                    level["n"] = 0
                    continue
            level["n"] = n
            for x, k in level["filling"]:
                rest.add(x, -k * n)
            wasted += level["waste"] * n
            bins += n
            break
        if not stack:
            break
    return best


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, crcs, nth): one row per document; crcs has the crc32 of each piece's ids.

    nth counts the rows of a task, from the task's number on.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = TaskContext.get().partitionId()
        for batch in gathered(batches, 1, BATCH_BYTES):
            ids, ends = encoder(tokenizer_path, keep_space=False).encode_column(batch.column(1), END_ID)
            crcs = []
            for a, b in zip(ends.tolist(), ends[1:].tolist(), strict=False):
                raw = ids[a:b].astype("<u4").tobytes()
                crcs.append([zlib.crc32(raw[k : k + 4 * capacity]) for k in range(0, len(raw), 4 * capacity)])
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(np.diff(ends)), pa.array(crcs, pa.list_(pa.int64())), pa.array(np.arange(done, done + len(crcs)))], ["doc_id", "n_tokens", "crcs", "nth"])
            done += len(crcs)

    return arrow_stream(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), run, "doc_id long, n_tokens long, crcs array<long>, nth long")


def plan_runs(groups: Groups) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, copies, first sequence, offset) for each length in each group."""
    rank: dict[int, int] = {}
    runs, first = [], 0
    for filling, n in groups:
        offset = 0
        for length, copies in filling:
            start = rank.get(length, 0)
            runs.append((length, start, start + copies * n, copies, first, offset))
            rank[length] = start + copies * n
            offset += length * copies
        first += n
    return runs


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Places for the rows of token_pieces: (doc_id, piece, start, length, ids_crc32, sequence_id, offset).

    Sequences of remainders are numbered from 0 in the order of the plan, those of full pieces by
    negative numbers made of the row's own rank.
    """
    spark = pieces.sparkSession
    rows = materialize(pieces, "pieces")
    tail = (F.col("n_tokens") % capacity).cast("int")
    # the histogram has `capacity` rows at most; a remainder of 0 means full pieces only
    counts = {r["tail"]: r["n"] for r in rows.groupBy(tail.alias("tail")).agg(F.count("*").alias("n")).collect()}
    salts = max(1, sum(counts.values()) // RANK_ROWS)
    groups = bin_completion({k: n for k, n in counts.items() if k}, capacity)
    # for each length its runs, sorted by first rank: the plan's size depends on the capacity alone
    by_length: dict[int, list] = {}
    for length, a, b, copies, first, offset in plan_runs(groups):
        by_length.setdefault(length, []).append((a, b, copies, first, offset))
    plan = spark.createDataFrame(
        list(by_length.items()), "tail int, runs array<struct<a:long,b:long,copies:long,first:long,offset:long>>"
    )

    # the salt is no function of a document, so that repeated rows are spread as well
    salted = rows.select("doc_id", "n_tokens", "crcs", tail.alias("tail"), F.pmod("nth", F.lit(salts)).cast("int").alias("salt"))
    sizes = salted.groupBy("tail", "salt").agg(F.count("*").alias("n"))
    before = sizes.select("tail", "salt", (F.sum("n").over(Window.partitionBy("tail").orderBy("salt")) - F.col("n")).alias("before"))
    in_salt = F.row_number().over(Window.partitionBy("tail", "salt").orderBy("doc_id", "n_tokens", "crcs")) - 1
    ranked = salted.withColumn("in_salt", in_salt).join(before, ["tail", "salt"]).withColumn("rank", F.col("in_salt") + F.col("before"))
    placed = ranked.join(F.broadcast(plan), "tail", "left")
    run = F.filter("runs", lambda r: (r["a"] <= F.col("rank")) & (F.col("rank") < r["b"]))[0]
    placed = placed.withColumn("run", run).select("doc_id", "n_tokens", "tail", "rank", "run", F.posexplode("crcs").alias("piece", "ids_crc32"))
    start = F.col("piece").cast("long") * capacity
    length = F.least(F.lit(capacity).cast("long"), F.col("n_tokens") - start)
    nth = F.col("rank") - F.col("run.a")
    is_full = length == capacity
    # (tail, rank) names a document, so (tail, rank, piece) names a full piece
    own: Column = -1 - (F.col("piece").cast("long") * capacity + F.col("tail")) - F.col("rank") * F.lit(1 << 34)
    return placed.select(
        "doc_id",
        F.col("piece").cast("int").alias("piece"),
        start.alias("start"),
        length.alias("length"),
        "ids_crc32",
        F.when(is_full, own).otherwise(F.col("run.first") + F.floor(nth / F.col("run.copies"))).cast("long").alias("sequence_id"),
        F.when(is_full, F.lit(0)).otherwise(F.col("run.offset") + (nth % F.col("run.copies")) * length).cast("long").alias("offset"),
    )


def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(token_pieces(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))
