"""Exact similarity joins of sets (entity, mid), without the square of a hub.

An element that more than `hub` sets hold is a hub. Pairs that share another element come from its short
list of sets. Pairs that share hubs alone have a similarity that only their hubs and sizes decide, so
entities of equal hubs and size form a class, and classes are compared in their place. Rows with a null
end are no elements; repeated rows count once. Without any hub, an element's sets are one short list, and
all that is exchanged are these lists, the pairs in them and the few best of each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Sets that may hold an element before it counts as a hub.
HUB = 256
#: Sets whose sizes are broadcast; sizes of more are joined as the planner chooses.
MOST_SIZES = 1_000_000
#: Parts that a set's pairs are dealt out to, so that those of a large set do not meet in one task.
PARTS = 16
#: More than what rounding to six places can lift a similarity by.
SLACK = 1.1e-6


def _known(sets: DataFrame) -> DataFrame:
    return sets.select("entity", "mid").filter("entity is not null and mid is not null")


def has_hub(sets: DataFrame, hub: int) -> bool:
    """Whether more than `hub` sets hold an element; different ones are counted only where rows may be as many."""
    often = lambda rows: not rows.groupBy("mid").agg(F.count("*").alias("n")).filter(F.col("n") > hub).isEmpty()
    return often(_known(sets)) and often(_known(sets).distinct())


def _held(sets: DataFrame) -> DataFrame:
    """(mid, held): the different sets of each element; for sets without a hub, so none is long."""
    return _known(sets).groupBy("mid").agg(F.collect_set("entity").alias("held"))


def _list_pairs(held: DataFrame) -> DataFrame:
    """(entity, other) once for each element that both hold, both ways and with themselves."""
    return held.select(F.explode("held").alias("entity"), "held").select("entity", F.explode("held").alias("other"))


def _elements(sets: DataFrame) -> DataFrame:
    """(entity, mid, freq): freq is the number of sets that hold mid."""
    n = _known(sets).distinct()
    return n.join(n.groupBy("mid").agg(F.count("*").alias("freq")), "mid").select("entity", "mid", "freq")


def _profiles(elements: DataFrame, hub: int) -> DataFrame:
    """(entity, size, hubs): hubs from the rarest on; there are no more of them than elements / hub."""
    held = F.collect_list(F.when(F.col("freq") > hub, F.struct("freq", "mid")))
    return elements.groupBy("entity").agg(F.count("*").alias("size"), F.sort_array(held)["mid"].alias("hubs"))


def _jaccard(common: Column, size: Column, other: Column) -> Column:
    return common / (size + other - common)


def rare_pairs(sets: DataFrame, hub: int = HUB) -> DataFrame:
    """(entity, other, shared) of pairs with a shared element that is no hub, both ways; shared counts those."""
    rare = _elements(sets).filter(F.col("freq") <= hub).select("entity", "mid")
    pairs = rare.join(rare.withColumnRenamed("entity", "other"), "mid").filter("entity <> other")
    return pairs.groupBy("entity", "other").agg(F.count("*").alias("shared"))


def _classes(profiles: DataFrame, k: int) -> DataFrame:
    """(cls, size, hubs, names): entities of equal hubs and size, by their first k + 1 names."""
    own = Window.partitionBy("size", "hubs").orderBy("entity")
    first = profiles.filter(F.size("hubs") > 0).withColumn("n", F.row_number().over(own)).filter(F.col("n") <= k + 1)
    c = first.groupBy("size", "hubs").agg(F.sort_array(F.collect_list("entity")).alias("names"))
    return c.select(_class_id().alias("cls"), "size", "hubs", "names")


def _class_id() -> Column:
    return F.sha2(F.to_json(F.struct("size", "hubs")), 256)


def _reached(rows: DataFrame, key: str, k: int) -> DataFrame:
    """rows (key, size, n) -> (key, z): the least size up to which a key has more than k entities."""
    c = rows.groupBy(key, "size").agg(F.sum("n").alias("n"))
    upto = F.sum("n").over(Window.partitionBy(key).orderBy("size"))
    return c.withColumn("upto", upto).filter(F.col("upto") > k).groupBy(key).agg(F.min("size").alias("z"))


def _bounds(classes: DataFrame, k: int) -> DataFrame:
    """(cls, least): a similarity that k others reach with every entity of the class.

    With z as the size up to which more than k entities hold one of its hubs, that is 1 / (size + z - 1);
    with z as the same for entities of just its hubs, all of these are shared.
    """
    held = classes.select("cls", "size", F.size("names").alias("n"), F.explode("hubs").alias("mid"))
    one = held.join(_reached(held, "mid", k), "mid").groupBy("cls").agg(F.max(1 / (F.col("size") + F.col("z") - 1)).alias("one"))
    alike = _reached(classes.select("hubs", "size", F.size("names").alias("n")), "hubs", k)
    a = F.size("hubs")
    every = classes.join(alike, "hubs", "left").select("cls", _jaccard(a, F.col("size"), F.col("z")).alias("all"))
    # greatest skips nulls
    return every.join(one, "cls", "left").select("cls", (F.coalesce(F.greatest("one", "all"), F.lit(0.0)) - SLACK).alias("least"))


def class_pairs(classes: DataFrame, k: int) -> DataFrame:
    """(cls, other) of classes that may hold one of the k best of each other's entities by hubs alone.

    A class that reaches `least` shares ceil(least * size) hubs, so one among the others' first hubs
    (prefix); the rest from the first shared hub on bounds what can still be shared (position).
    """
    a = F.size("hubs")
    post = classes.select("cls", "size", a.alias("a"), F.posexplode("hubs").alias("i", "mid"))
    need = F.greatest(F.lit(1), F.ceil(F.col("least") * F.col("size")))
    prefix = post.join(_bounds(classes, k), "cls").filter(F.col("i") <= F.col("a") - need)
    index = post.select("mid", F.col("cls").alias("other"), F.col("size").alias("size2"), F.col("a").alias("a2"), F.col("i").alias("j"))
    most = F.least(F.col("a") - F.col("i"), F.col("a2") - F.col("j"))
    near = prefix.join(index, "mid").filter(_jaccard(most, F.col("size"), F.col("size2")) >= F.col("least"))
    return near.select("cls", "other").distinct()


def _by_hubs(profiles: DataFrame, k: int) -> DataFrame:
    """(entity, other, jaccard) of the k best of each entity, counting hubs alone."""
    classes = _classes(profiles, k)
    c, o = classes.select("cls", "size", "hubs"), classes.select(F.col("cls").alias("other"), F.col("size").alias("size2"), F.col("hubs").alias("hubs2"), "names")
    rows = class_pairs(classes, k).join(c, "cls").join(o, "other")
    score = F.round(_jaccard(F.size(F.array_intersect("hubs", "hubs2")), F.col("size"), F.col("size2")), 6)
    rows = rows.select("cls", score.alias("jaccard"), F.explode("names").alias("other"))
    best = Window.partitionBy("cls").orderBy(F.desc("jaccard"), "other")
    top = rows.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= k + 1).drop("n")
    members = profiles.filter(F.size("hubs") > 0).select("entity", _class_id().alias("cls"))
    return members.join(top, "cls").filter("entity <> other").select("entity", "other", "jaccard")


def _top_without_hub(sets: DataFrame, k: int) -> DataFrame:
    """`top_jaccard` of sets without a hub: a set's pairs are counted, scored and cut where they are dealt to, part by part."""
    held = _held(sets)
    size = held.select(F.explode("held").alias("entity")).groupBy("entity").agg(F.count("*").alias("size"))
    few = _known(sets).select("entity").distinct().limit(MOST_SIZES + 1).count() <= MOST_SIZES
    size, size2 = (F.broadcast(x) if few else x for x in (size, size.toDF("other", "size2")))
    dealt = _list_pairs(held).filter("entity <> other").withColumn("part", F.pmod(F.xxhash64("other"), F.lit(PARTS))).repartition("entity", "part")
    both = dealt.groupBy("entity", "part", "other").agg(F.count("*").alias("shared")).join(size, "entity").join(size2, "other")
    both = both.select("entity", "part", "other", F.round(_jaccard(F.col("shared"), F.col("size"), F.col("size2")), 6).alias("jaccard"))
    best = Window.partitionBy("entity", "part").orderBy(F.desc("jaccard"), "other")
    return both.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= k).select("entity", "other", "jaccard")


def top_jaccard(sets: DataFrame, k: int, hub: int = HUB) -> DataFrame:
    """(entity, other, jaccard, rank): the k most similar sets of each that share an element, ties by name.

    Counting hubs alone never gives too much, and gives the whole of a pair that shares nothing else. So
    whoever is not among a class's first k + 1 has k others before it.
    """
    hub = max(hub, k + 1)  # a hub must be held by more than k others
    if has_hub(sets, hub):
        p = _profiles(_elements(sets), hub)
        q = p.select(F.col("entity").alias("other"), F.col("size").alias("size2"), F.col("hubs").alias("hubs2"))
        common = F.col("shared") + F.size(F.array_intersect("hubs", "hubs2"))
        both = rare_pairs(sets, hub).join(p, "entity").join(q, "other").select("entity", "other", F.round(_jaccard(common, F.col("size"), F.col("size2")), 6).alias("jaccard"))
        both = both.union(_by_hubs(p, k)).groupBy("entity", "other").agg(F.max("jaccard").alias("jaccard"))
    else:
        both = _top_without_hub(sets, k)
    w = Window.partitionBy("entity").orderBy(F.desc("jaccard"), "other")
    return both.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= k).select("entity", "other", "jaccard", (F.col("n") - 1).cast("long").alias("rank"))


def common_pairs(sets: DataFrame, least: int, hub: int = HUB) -> DataFrame:
    """(a, b, n_common) of all pairs a < b that share at least `least` elements.

    Without a hub the pairs of each element's short list are counted. Else, in one order of all elements, rarest first, such a pair shares one that is not among the last least - 1
    of either set; so a hub that ends its sets joins nothing. Of two sets the one whose head ends
    first has all that is left to count in its tail, which is looked up in the other set.
    """
    if not has_hub(sets, hub):
        pairs = _list_pairs(_held(sets)).toDF("a", "b").filter("a < b")
        return pairs.groupBy("a", "b").agg(F.count("*").alias("n_common")).filter(F.col("n_common") >= least)
    order = Window.partitionBy("entity").orderBy("freq", "mid")
    n = _elements(sets).withColumn("at", F.row_number().over(order))
    size = n.groupBy("entity").agg(F.count("*").alias("size"))
    n = n.join(size, "entity").filter(F.col("size") >= least)
    in_head = F.col("at") <= F.col("size") - least + 1
    last = n.filter(F.col("at") == F.col("size") - least + 1).select("entity", F.struct("freq", "mid").alias("last"))
    tails = n.filter(~in_head).select("entity", "mid")
    head = n.filter(in_head).select("entity", "mid").join(last, "entity")
    a, b = head.toDF("a", "mid", "last_a"), head.toDF("b", "mid", "last_b")
    found = a.join(b, "mid").filter("a < b").groupBy("a", "b", "last_a", "last_b").agg(F.count("*").alias("c"))
    short = F.col("last_a") <= F.col("last_b")
    ends = found.select("a", "b", F.when(short, F.col("a")).otherwise(F.col("b")).alias("entity"), F.when(short, F.col("b")).otherwise(F.col("a")).alias("holder"))
    holds = n.select(F.col("entity").alias("holder"), "mid")
    rest = ends.join(tails, "entity").join(holds, ["holder", "mid"]).select("a", "b", F.lit(1).cast("long").alias("c"))
    return found.select("a", "b", "c").union(rest).groupBy("a", "b").agg(F.sum("c").alias("n_common")).filter(F.col("n_common") >= least)
