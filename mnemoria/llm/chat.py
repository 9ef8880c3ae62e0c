"""Chat formatting of reply trees with DataFrame functions only.

Messages name their parent; the paths from a root to a leaf are enumerated by self-joins on jump
pointers: round k joins pointers of length 2 ** k with themselves, so the rounds grow with the logarithm
of the depth. The same pointers carry scores, so that each leaf knows the score of its branch; branches
are ranked within their root, the best are chosen, and the chosen leaves collect their paths through the
stored pointers, doubling what is covered in each round.

Template of a turn: <s>ROLE[INST]TEXT</s>, where the escape of `\\`, `<` and `[` (as `\\b`, `\\l`, `\\i`)
keeps every control string out of roles and texts, and can be undone. The loss mask has the spans of
assistant texts in the formatted conversation.

Defined cases: a null role or text is empty; rows of a null conversation are one conversation; turns in
one place are ordered by role, then text, and repeated rows are repeated turns; messages whose parents
run in a circle belong to no root and are left out; no rows give no conversations.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, read

TURN, BODY, END = "<s>", "[INST]", "</s>"
#: The role whose texts are learned.
LEARNED = "assistant"


def escape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l")), F.lit("["), F.lit("\\i"))


def unescape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("\\l"), F.lit("<")), F.lit("\\i"), F.lit("[")), F.lit("\\b"), F.lit("\\"))


def thread(rows: DataFrame) -> DataFrame:
    """conversations (conv_id, turn, role, text) as messages: each turn replies to the one before it."""
    in_order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    text, role = F.coalesce("text", F.lit("")).alias("text"), F.coalesce("role", F.lit("")).alias("role")
    numbered = rows.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role, text).withColumn("node", F.row_number().over(in_order).cast("long"))
    return numbered.select("conv_id", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), F.lit(0.0).alias("score"), "role", "text")


def _key(a: DataFrame, b: DataFrame, left: str, right: str) -> Column:
    return a["conv_id"].eqNullSafe(b["conv_id"]) & (a[left] == b[right])


def jump_pointers(messages: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Pointers of 1, 2, 4, ... steps, and for each message its root, depth and branch score.

    A level has (conv_id, node, up): messages that have an ancestor so many steps above.
    """
    one = messages.filter("parent is not null").select("conv_id", "node", F.col("parent").alias("up"))
    levels = [materialize(one, "jump")]
    # what a message has gathered so far: `far` is the next ancestor not yet counted in
    state = messages.select("conv_id", "node", F.col("parent").alias("far"), F.lit(0).cast("long").alias("depth"), "score", F.col("node").alias("top"))
    state = materialize(state, "state")
    done, active = [state.filter("far is null")], state.filter("far is not null")
    # without circles a path is no longer than the number of messages
    for _ in range(max(1, messages.count()).bit_length() + 1):
        if active.isEmpty():
            break
        # only messages that have not reached their root move on; they look up all others
        every = reduce(DataFrame.union, done, active)
        b = every.select(F.col("conv_id").alias("c2"), F.col("node").alias("n2"), F.col("far").alias("far2"), F.col("depth").alias("d2"), F.col("score").alias("s2"), F.col("top").alias("t2"))
        found = active.join(b, active["conv_id"].eqNullSafe(b["c2"]) & (active["far"] == b["n2"]), "left")
        state = found.select(
            "conv_id", "node",
            F.when(F.col("n2").isNotNull(), F.col("far2")).alias("far"),
            F.when(F.col("n2").isNotNull(), F.col("depth") + F.col("d2") + 1).otherwise(F.col("depth")).alias("depth"),
            F.when(F.col("n2").isNotNull(), F.col("score") + F.col("s2")).otherwise(F.col("score")).alias("score"),
            F.coalesce("t2", "top").alias("top"),
        )
        state = materialize(state, "state")
        done.append(state.filter("far is null"))
        active = state.filter("far is not null")
        last = levels[-1]
        up = last.select(F.col("conv_id").alias("c2"), F.col("node").alias("n2"), F.col("up").alias("up2"))
        levels.append(materialize(last.join(up, last["conv_id"].eqNullSafe(up["c2"]) & (last["up"] == up["n2"])).select("conv_id", "node", F.col("up2").alias("up")), "jump"))
    return levels, reduce(DataFrame.union, done)


def best_paths(messages: DataFrame, per_root: int = 1) -> DataFrame:
    """(conv_id, leaf, rank, node, place): the messages of the chosen branches, place 0 at the root.

    Branches of a root are ranked by the mean score of their messages, then by length (longer first),
    then by the leaf's number.
    """
    levels, state = jump_pointers(messages)
    one = levels[0]
    leaves = state.join(one, _key(state, one, "node", "up"), "left_anti")
    order = Window.partitionBy("conv_id", "top").orderBy(F.desc(F.col("score") / (F.col("depth") + 1)), F.desc("depth"), "node")
    chosen = leaves.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= per_root)
    path = chosen.select("conv_id", F.col("node").alias("leaf"), "rank", "node", F.col("depth").alias("place"))
    for k, level in enumerate(levels):
        up = level.select(F.col("conv_id").alias("c2"), F.col("node").alias("n2"), "up")
        more = path.join(up, path["conv_id"].eqNullSafe(up["c2"]) & (path["node"] == up["n2"]))
        path = path.union(more.select("conv_id", "leaf", "rank", F.col("up").alias("node"), F.col("place") - (1 << k)))
        path = materialize(path, "path")
    return path


def format_paths(messages: DataFrame, paths: DataFrame) -> DataFrame:
    """(conv_id, leaf, rank, formatted, loss_spans): one row for each chosen path."""
    m = messages.select(F.col("conv_id").alias("c2"), F.col("node").alias("n2"), "role", "text")
    turns = paths.join(m, paths["conv_id"].eqNullSafe(m["c2"]) & (paths["node"] == m["n2"]))
    head = F.concat(F.lit(TURN), escape(F.col("role")), F.lit(BODY))
    # the length of a turn's parts goes along, so that the spans are sums of integers
    item = F.struct("place", F.concat(head, escape(F.col("text")), F.lit(END)).alias("s"), F.length(head).cast("long").alias("before"), F.length(escape(F.col("text"))).cast("long").alias("n"), (F.col("role") == LEARNED).alias("learned"))
    whole = turns.groupBy("conv_id", "leaf", "rank").agg(F.array_sort(F.collect_list(item)).alias("t"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<from:long,n:long>>").alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        span = F.array(F.struct((acc["at"] + x["before"]).alias("from"), x["n"].alias("n")))
        return F.struct((acc["at"] + x["before"] + x["n"] + len(END)).alias("at"), F.when(x["learned"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    spans = F.aggregate("t", start, step)["spans"]
    return whole.select("conv_id", "leaf", "rank", F.array_join(F.transform("t", lambda x: x["s"]), "").alias("formatted"), spans.alias("loss_spans"))


def parse_turns(formatted: Column) -> Column:
    """array<struct<role, text>> read back from a formatted conversation."""
    parts = F.filter(F.split(formatted, END), lambda p: p != "")
    body = lambda p: F.instr(p, BODY)  # noqa: E731  no escaped text has the control string
    return F.transform(
        parts,
        lambda p: F.struct(
            unescape(F.substring(p, F.lit(len(TURN) + 1), body(p) - len(TURN) - 1)).alias("role"),
            unescape(F.substring(p, body(p) + len(BODY), F.length(p))).alias("text"),
        ),
    )


def digest(formatted: DataFrame) -> DataFrame:
    """Digests read back from the output: turns by parsing it, the loss by its spans."""
    turns = parse_turns(F.col("formatted"))
    flat = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learned = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), (s["from"] + 1).cast("int"), s["n"].cast("int")))), "")
    return formatted.select("conv_id", "leaf", "rank", F.size(turns).cast("long").alias("n_turns"), F.sha2(flat.cast("binary"), 256).alias("turns_sha256"), learned.alias("learned"), F.length("formatted").cast("long").alias("formatted_chars")).select(
        "conv_id", "n_turns", "turns_sha256", F.length("learned").cast("long").alias("loss_chars"), F.sha2(F.col("learned").cast("binary"), 256).alias("loss_sha256"), "formatted_chars"
    )


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = "</s>[INST] ok [/INST]"
    more = reduce(DataFrame.union, [spark.range(1).select(F.lit(-1).cast("long"), F.lit(k).cast("long"), F.lit(role), F.lit(probe)) for k, role in enumerate(("user", "assistant"))])
    rows = read(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").union(more)
    messages = materialize(thread(rows), "messages")
    return digest(format_paths(messages, best_paths(messages)))
