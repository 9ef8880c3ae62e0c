"""Names of a dictionary in texts: every place, leftmost first, the longest there, none inside another."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Letters of all names together up to which one automaton is sent to the tasks; beyond it names are joined.
MOST_LETTERS = 4_000_000
#: Lengths of the windows of a text that are joined to the first letters of names.
WINDOWS = (1, 2, 4, 8, 16)
FOUND = "array<struct<name:string,pos:long>>"


def _dictionary(names: DataFrame) -> DataFrame:
    """(low, name): names that differ in case are one, the first of them; null and empty names go."""
    low = F.lower("name")
    return names.filter(F.length("name") > 0).groupBy(low.alias("low")).agg(F.min("name").alias("name"))


def _leftmost_longest(automaton: ahocorasick.Automaton, text: str) -> list[dict]:
    longest: dict[int, tuple[int, str]] = {}
    for last, (n, name) in automaton.iter(text):
        start = last - n + 1
        if start not in longest or longest[start][0] < n:
            longest[start] = (n, name)
    out, free = [], 0
    for start in sorted(longest):
        if start >= free:
            n, name = longest[start]
            out.append({"name": name, "pos": start + 1})
            free = start + n
    return out


def _by_automaton(texts: DataFrame, dictionary: DataFrame) -> DataFrame:
    automaton = ahocorasick.Automaton()
    for low, name in dictionary.collect():  # MOST_LETTERS at most
        automaton.add_word(low, (len(low), name))
    if not len(automaton):
        return texts.select("id", F.array().cast(FOUND).alias("found")).limit(0)
    automaton.make_automaton()
    sent = texts.sparkSession.sparkContext.broadcast(automaton)
    schema = pa.schema([("id", pa.int64()), ("found", pa.list_(pa.struct([("name", pa.string()), ("pos", pa.int64())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_leftmost_longest(sent.value, t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(found, schema.field(1).type)], schema=schema)

    return texts.select("id", F.lower("text")).mapInArrow(run, f"id long, found {FOUND}")


def _fold(hits: Column) -> Column:
    """Sorted (pos, n, name), one for each place -> those that start behind the last one taken."""
    start = F.struct(F.lit(0).cast("long").alias("free"), F.array().cast(FOUND).alias("found"))
    taken = lambda acc, x: F.struct((x["pos"] + x["n"]).alias("free"), F.concat(acc["found"], F.array(F.struct(x["name"].alias("name"), x["pos"].alias("pos")))).alias("found"))
    return F.aggregate(hits, start, lambda acc, x: F.when(x["pos"] >= acc["free"], taken(acc, x)).otherwise(acc))["found"]


def _by_windows(texts: DataFrame, dictionary: DataFrame) -> DataFrame:
    """As the automaton, for a dictionary of any size: windows of the texts meet the first letters of names."""
    n = F.length("low")
    size = F.lit(WINDOWS[0])
    for w in WINDOWS[1:]:
        size = F.when(n >= w, w).otherwise(size)
    keyed = dictionary.select("name", "low", n.cast("long").alias("n"), F.substring("low", F.lit(1), size).alias("key"))
    low = texts.select("id", F.lower("text").alias("low"))
    # a window brings the 64 letters from its place on; longer names are compared with the whole text later
    place = low.select("id", "low", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("low")))).alias("pos")).select("id", "pos", F.substring("low", F.col("pos"), F.lit(64)).alias("ahead"))
    window = place.select("id", F.col("pos").cast("long").alias("pos"), "ahead", F.explode(F.array(*[F.substring("ahead", F.lit(1), F.lit(w)) for w in WINDOWS])).alias("key")).filter("key <> ''").distinct()
    hits = window.join(keyed, "key").filter(F.startswith("ahead", F.substring("low", 1, 64)))
    long = hits.filter("n > 64").join(low.withColumnRenamed("low", "whole"), "id").filter("substring(whole, pos, n) = low")
    every = hits.filter("n <= 64").select("id", "pos", "n", "name").union(long.select("id", "pos", "n", "name"))
    longest = every.groupBy("id", "pos").agg(F.max_by(F.struct("n", "name"), "n").alias("b"))
    return longest.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("pos", "b.n", "b.name"))).alias("hits")).select("id", _fold(F.col("hits")).alias("found"))


def match_names(texts: DataFrame, names: DataFrame, most_letters: int = MOST_LETTERS) -> DataFrame:
    """texts (id, text), names (name) -> (id, name, pos): matches whatever their case, from the left, pos from 1.

    Ids are long and unique. Places are those of the lower-cased text. A null text has no matches. The
    dictionary's letters are counted first: up to most_letters it goes as one automaton to every task, which
    reads each text once; a larger one is joined. Both give the same rows.
    """
    dictionary = _dictionary(names)
    letters = dictionary.agg(F.sum(F.length("low"))).first()[0] or 0
    found = (_by_automaton if letters <= most_letters else _by_windows)(texts, dictionary)
    return found.select("id", F.explode("found").alias("f")).select("id", "f.name", "f.pos")
