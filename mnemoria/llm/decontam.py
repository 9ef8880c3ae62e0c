"""Benchmark decontamination by spaced seeds, with DataFrame functions only.

A mask selects some of the tokens in a span and ignores the others, so a hash of the selected ones
survives substitutions at the ignored places. Hashes of all benchmark positions are joined with those of
all training positions; around each hit the item is laid on the document along the hit's diagonal, and
the best run of agreeing tokens (a match counts 1, a mismatch -1) decides.

The plan is the same at every size. A bitmap of FILTER_WORDS longs has a bit for each benchmark hash;
training positions whose bit is not set cannot be hits and go no further. It has a fixed size, and a
benchmark that fills it lets more through and loses nothing. What is left is (document, place, hash)
alone; hits are brought down to distinct (document, item, diagonal), and only then are the texts of the
documents that have any joined back, cut into stretches: a diagonal meets the one stretch that it needs and
never the whole text, so a repetitive text with a diagonal at each place costs its length and not the square.

Tokens are lower-cased runs of letters, marks and digits; in scripts that are written without spaces,
each letter with its marks is a token. Items of fewer tokens than the shortest mask are found word for
word, from LEAST_EXACT tokens on anywhere in a document, shorter ones where they are all of it.

Defined cases: a null text has no tokens; an item without tokens or id is never found; documents that
repeat an id are looked at each for itself and reported together; an empty benchmark finds nothing;
other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import columns_of, materialize, read

#: Places of a span that count, in each mask.
MASKS = ((0, 1, 2, 4, 6, 7), (0, 1, 3, 6, 7, 8), (0, 1, 3, 4, 7, 9))
SHORTEST = min(m[-1] for m in MASKS) + 1
#: Longs of the bitmap: a power of two. 2 MB.
FILTER_WORDS = 1 << 18
#: The best run must reach this, or this share of a shorter item's tokens.
LEAST_RUN, LEAST_SHARE = 12, 0.6
#: Shorter items count only where they are a whole document.
LEAST_EXACT = 5
#: Tokens of a stretch of a document, or as many as the longest item has.
LEAST_STRETCH = 1024

#: Scripts written without spaces between words.
_DENSE = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}]"
#: All of their letters lie here; a range is looked for faster than scripts are.
_MAY_BE_DENSE = r"[\x{0E00}-\x{1FFF}\x{2E80}-\x{10FFFF}]"
_APART = r"[^\p{L}\p{M}\p{N}]+"


def tokens_of(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    spaced = F.when(text.rlike(_MAY_BE_DENSE), F.regexp_replace(text, rf"({_DENSE}\p{{M}}*)", " $1 ")).otherwise(text)
    return F.array_remove(F.split(F.lower(spaced), _APART), "")


def _seeds_at(tokens: Column, at: Column, short: list[int]) -> Column:
    """The hashes that a place has, null where a mask does not fit; short: lengths of short items."""
    size = F.size(tokens)
    each = [F.when(at + m[-1] < size, F.xxhash64(F.lit(k), *[F.get(tokens, at + j) for j in m])) for k, m in enumerate(MASKS)]
    for n in short:
        fits = at + n <= size if n >= LEAST_EXACT else size == n
        each.append(F.when(fits, F.xxhash64(F.lit(-n), *[F.get(tokens, at + j) for j in range(n)])))
    return F.array(*each)


def _places(rows: DataFrame, tokens: str, short: list[int]) -> DataFrame:
    """Each row of rows with each of its seeds: its columns, at, seed."""
    # no filter on the tokens: it would be pushed below them and make them twice
    every = F.when(F.size(tokens) > 0, F.sequence(F.lit(0), F.size(tokens) - 1))
    placed = rows.select("*", F.explode(every).alias("at"))
    return placed.select("*", F.explode(_seeds_at(F.col(tokens), F.col("at"), short)).alias("seed")).filter("seed is not null").drop(tokens)


def benchmark_seeds(items: DataFrame, short: list[int]) -> DataFrame:
    """items (item_id, item_tokens) -> (seed, item_id, at, n): spaced seeds, or the whole of a short item; n: its tokens."""
    items = items.withColumn("n", F.size("item_tokens"))
    spaced = _places(items.filter(F.col("n") >= SHORTEST), "item_tokens", [])
    for n in short:  # a longer item's start is no short item
        own = _seeds_at(F.col("item_tokens"), F.lit(0), [n])[len(MASKS)]
        spaced = spaced.unionByName(items.filter(F.col("n") == n).select("item_id", "n", F.lit(0).alias("at"), own.alias("seed")))
    return spaced.select("seed", "item_id", "at", "n").distinct()


def word_of(seed: Column) -> Column:
    return F.shiftrightunsigned(seed, 64 - FILTER_WORDS.bit_length() + 1).cast("int")


def bitmap(seeds: DataFrame) -> Column:
    """FILTER_WORDS longs, with a bit for each seed, as a scalar subquery."""
    words = seeds.groupBy(word_of(F.col("seed")).alias("id")).agg(F.expr("bit_or(shiftleft(1L, cast(seed & 63 as int)))").alias("word"))
    every = seeds.sparkSession.range(FILTER_WORDS, numPartitions=1).select(F.col("id").cast("int").alias("id")).join(words, "id", "left")
    ordered = F.array_sort(F.collect_list(F.struct("id", F.coalesce("word", F.lit(0).cast("long")).alias("word"))))
    return every.agg(F.transform(ordered, lambda x: x["word"]).alias("words")).scalar()


def may_be_in(words: Column, seed: Column) -> Column:
    """Whether the seed's bit is set: true for all seeds of the bitmap, and for few others while it is sparse."""
    return F.getbit(F.get(words, word_of(seed)), seed.bitwiseAND(63)) == 1


def without(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of docs whose id is not in ids (id_col alone, a written table); rows of a null id stay.

    Rows whose bit is not set in a bitmap of the ids stay at once. Only the others, few while the ids are few
    millions, are shuffled to be joined; texts that stay do not move.
    """
    seed = F.xxhash64(F.col(id_col))
    maybe = may_be_in(bitmap(ids.select(F.xxhash64(id_col).alias("seed"))), seed)
    looked_up = docs.filter(maybe).join(ids, id_col, "left_anti").select(*columns_of(docs))
    return docs.filter(~maybe).union(looked_up)


def _best_run(a: Column, b: Column) -> Column:
    """The largest sum of a stretch of the aligned tokens: 1 for equal, -1 for different."""
    start = F.struct(F.lit(0).alias("here"), F.lit(0).alias("best"))

    def step(acc: Column, same: Column) -> Column:
        here = F.greatest(F.lit(0), acc["here"] + F.when(same, 1).otherwise(-1))
        return F.struct(here.alias("here"), F.greatest(acc["best"], here).alias("best"))

    return F.aggregate(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), start, step)["best"]


def _stretches(texts: DataFrame, length: int) -> DataFrame:
    """texts (d, t, doc_tokens) -> (d, t, stretch, tokens): twice length tokens from each multiple of length on."""
    cut = lambda k: F.struct(k.alias("stretch"), F.slice("doc_tokens", k * length + 1, 2 * length).alias("tokens"))
    every = F.when(F.size("doc_tokens") > 0, F.sequence(F.lit(0), F.floor((F.size("doc_tokens") - 1) / length).cast("int")))
    return texts.select("d", "t", F.explode(F.transform(every, cut)).alias("s")).select("d", "t", "s.*")


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, run, n_item_tokens, n_equal): one row for each document and item that overlap."""
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), tokens_of(F.col(item_text)).alias("item_tokens"))
    items = materialize(items.filter("item_id is not null and size(item_tokens) > 0").distinct(), "items")
    short = sorted(r["n"] for r in items.filter(F.size("item_tokens") < SHORTEST).select(F.size("item_tokens").alias("n")).distinct().collect())
    seeds = materialize(benchmark_seeds(items, short), "seeds")

    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("th"), F.col(text_col).alias("text"))
    places = _places(named.select("doc_id", "th", tokens_of(F.col("text")).alias("doc_tokens")), "doc_tokens", short)
    passed = places.filter(may_be_in(bitmap(seeds), F.col("seed")))
    hits = passed.select("doc_id", "th", F.col("at").alias("doc_at"), "seed").join(seeds, "seed")
    lines = materialize(hits.select("doc_id", "th", "item_id", "n", (F.col("doc_at") - F.col("at")).alias("diagonal")).distinct(), "lines")

    length = max(LEAST_STRETCH, items.agg(F.max(F.size("item_tokens"))).first()[0] or 0)
    found = lines.select(F.col("doc_id").alias("d"), F.col("th").alias("t")).distinct()
    same = lambda a, b: a["doc_id"].eqNullSafe(b["d"]) & (a["th"] == b["t"])
    texts = named.join(found, same(named, found), "left_semi").dropDuplicates(["doc_id", "th"])
    parts = _stretches(texts.select(F.col("doc_id").alias("d"), F.col("th").alias("t"), tokens_of(F.col("text")).alias("doc_tokens")), length)
    start = F.greatest(F.col("diagonal"), F.lit(0))
    lines_at = lines.withColumn("at", F.floor(start / length).cast("int"))
    laid = lines_at.join(parts, same(lines_at, parts) & (lines_at["at"] == parts["stretch"]))
    # the part of the document that the item would cover on this diagonal, and the part of the item
    part = F.slice("tokens", start - F.col("at") * length + 1, F.col("n") + F.least(F.col("diagonal"), F.lit(0)))
    laid = laid.select("doc_id", "item_id", "diagonal", part.alias("part")).join(items, "item_id")
    covered = F.slice("item_tokens", F.greatest(-F.col("diagonal"), F.lit(0)) + 1, F.size("part"))
    n_equal = F.size(F.filter(F.zip_with("part", covered, lambda x, y: x.eqNullSafe(y)), lambda same: same))
    scored = laid.select("doc_id", "item_id", F.size("item_tokens").alias("n"), _best_run(F.col("part"), covered).alias("run"), n_equal.alias("equal"))
    enough = F.col("run") >= F.when(F.col("n") < SHORTEST, F.col("n")).otherwise(F.least(F.lit(LEAST_RUN), F.ceil(F.col("n") * LEAST_SHARE)))
    return scored.filter(enough).groupBy("doc_id", "item_id").agg(F.max("run").cast("long").alias("run"), F.max("n").cast("long").alias("n_item_tokens"), F.max("equal").cast("long").alias("n_equal"))


def op7_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
