"""Hooks around a chat, as batch functions: what is stored of the turns, and prompts with remembered context."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import should_skip
from .fusion import context_items
from .ingest import clean_llm_response

LEAST_CHARS, REPLY_CHARS = 4, 200


def turns_to_store(turns: DataFrame) -> DataFrame:
    """conversations (conv_id, turn, role, text) -> (conv_id, turn, role, content, reply_to).

    User turns are stored unless they say nothing. Assistant turns lose their tool calls first, must still
    have LEAST_CHARS letters, and name the start of the user's turn before them.
    """
    order = Window.partitionBy("conv_id").orderBy("turn")
    asked = F.last(F.when(F.col("role") == "user", F.col("text")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = turns.withColumn("reply_to", F.when(F.col("role") == "assistant", F.substring(asked, 1, REPLY_CHARS)))
    said = F.coalesce("text", F.lit(""))
    rows = rows.withColumn("content", F.when(F.col("role") == "assistant", clean_llm_response(said)).otherwise(said))
    kept = rows.filter(~should_skip(said) & ((F.col("role") != "assistant") | (F.length("content") >= LEAST_CHARS)))
    return kept.select("conv_id", "turn", "role", "content", "reply_to")


def pre_process(found: DataFrame, system_prompt: str = "") -> DataFrame:
    """Search results (id, text, score, sources, rank) -> one row (prompt): the prompt, a blank line, the context."""
    lines = context_items(found)
    context = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "line"))), lambda x: x["line"]), "\n")
    one = lines.agg(context.alias("context"))
    head = F.lit(system_prompt)
    return one.select(F.when(F.col("context") == "", head).when(head == "", F.col("context")).otherwise(F.concat(head, F.lit("\n\n"), "context")).alias("prompt"))
