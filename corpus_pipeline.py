"""The training-data pipeline over `documents`: five stages, each written and read again by its caller.

Every stage takes (spark, docs, sf_dir); all but the last return the columns of documents.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemoria.llm.common import cleared, columns_of, materialize, read, unused
from mnemoria.llm.decontam import contaminated, without
from mnemoria.llm.langid import UND, held_out_rows, predict, train
from mnemoria.llm.neardup import near_duplicates
from mnemoria.llm.packing import pack, token_pieces
from mnemoria.llm.pii import redact


def _ordered(df: DataFrame) -> Column:
    """All columns as something that has an order: maps, wherever they stand, have none and count as JSON."""
    each = [F.to_json(F.struct(c)) if re.search("map|variant", f.dataType.simpleString()) else c for c, f in zip(columns_of(df), df.schema.fields, strict=True)]
    return F.struct(*each)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a language: no text, or no letter in it.

    A null id counts as an empty one when rows to learn from are chosen; repeated rows are treated alike;
    other columns are kept, whatever their names; an empty table stays empty.
    """
    model = train(docs.filter(~held_out_rows()))
    names = tuple(unused(docs, n) for n in ("lang_pred", "lang_score"))
    return predict(docs, model, docs.columns, names).filter(F.col(names[0]) != UND).select(*columns_of(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of the smallest id of each group; shingles of five words, similarity 0.8 or more.

    Rows of a null id belong to no group and stay. Of rows that repeat a kept id the smallest stays, by
    all columns in order (maps as JSON). Documents without words are their own groups. Other columns are kept.
    """
    kept: list[DataFrame] = []
    with cleared(kept):
        found = materialize(near_duplicates(docs).select("doc_id", "kept").filter("doc_id is not null"), "found")
        gone = materialize(found.filter("not kept").select("doc_id").distinct(), "gone")
        twice = materialize(found.filter("kept").groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id"), "twice")
        kept += [gone, twice]
    rows = without(docs, gone)
    if twice.isEmpty():
        return rows
    again = rows.join(twice, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(F.struct(*columns_of(docs)), _ordered(docs)).alias("row")).select("row.*")
    return without(rows, twice).union(again)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that overlap with a benchmark item.

    Rows of a null id cannot be named and stay; documents without text overlap with nothing; rows that
    repeat an id go together; an empty benchmark drops nothing.
    """
    kept: list[DataFrame] = []
    with cleared(kept):
        hits = materialize(contaminated(docs, read(spark, sf_dir, "benchmark")).select("doc_id").filter("doc_id is not null").distinct(), "hits")
        kept.append(hits)
    return without(docs, hits)


def mask_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data in the texts; n_chars follows the new text.

    Base spans are masked whatever their score, added ones from a score of 0.5 on. A null text stays null.
    """
    out = redact(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces in sequences of 4096 tokens."""
    return pack(token_pieces(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mask_pii", mask_pii),
    ("best_fit_packing", best_fit_packing),
]

#: SQL cannot express the classifier, the hash minima or the packing; tests/llm has brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each on what the one before it kept."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
