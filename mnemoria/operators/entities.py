"""Entities by rules: candidates by patterns, filters, cleaning, first-seen order, scores by signals."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names

#: Entities that a text keeps, in order of appearance.
MOST_ENTITIES = 20
NOISE_ROUNDS = 6


def _any(values: list[str]) -> str:
    return "|".join(values)


def has_han(c: Column) -> Column:
    return c.rlike(names.HAN)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once: a column used many times would be copied each time."""
    return F.get(F.transform(F.array(value), body), 0)


def _without_noise(name: Column, kind: str) -> Column:
    safe = names.PRODUCT_PREFIXES if kind == "product" else []
    prefixes = _any([p for p in names.NOISE_PREFIXES if p not in safe])
    for _ in range(NOISE_ROUNDS):
        name = F.regexp_replace(name, rf"(?s)^(?:{prefixes})(?=.{{2}})", "")
    return name


def _without_speech(name: Column) -> Column:
    out = name
    for v in reversed(sorted(names.PERSON_VERBS, key=len, reverse=True)):
        at = F.instr(name, v)
        out = F.when((at > 0) & (F.length(name) > len(v)), F.when(at > 1, F.substring(name, F.lit(1), at - 1)).otherwise(name)).otherwise(out)
    return out


def _to_ending(name: Column, kind: str) -> Column:
    out = name
    for suffix in reversed(sorted(names.TYPE_SUFFIXES[kind], key=len, reverse=True)):
        # the last place of the ending, not at the start, and eight letters before it
        head = F.regexp_replace(F.regexp_extract(name, rf"(?s)^.*?(.{{0,8}}){suffix}(?:(?!{suffix}).)*$", 1), "(?s)^.*[的在跟到去来]", "")
        out = F.when(name.rlike(rf"(?s)^.+{suffix}"), F.concat(head, F.lit(suffix))).otherwise(out)
    return out


def _ending_of(kind: str) -> Callable[[Column], Column]:
    return lambda name: _to_ending(name, kind)


def clean_name(name: Column, kind: Column) -> Column:
    """A name without noise before it, without what follows a verb of speech, and cut to its type's ending.

    The first prefix in the list's order that leaves two letters goes, six times at most; products keep
    some of them. Of the verbs (endings) the longest in the name decides, of equally long ones the first.
    """
    out = name
    for k in names.TYPE_SUFFIXES:
        said = _let(_without_noise(name, k), _without_speech)
        said = F.regexp_replace(said, "也$", "") if k == "person" else said
        out = F.when(kind == k, F.trim(_let(said, _ending_of(k)))).otherwise(out)
    return F.when((kind == "person") & name.isin(names.NO_PERSONS), "").when(has_han(name), out).otherwise(name)


def is_generic(name: Column) -> Column:
    """Whether a Latin name is a word of everyday English."""
    low = F.lower(name)
    keep = name.rlike("[0-9]") | name.contains(" ") | ((F.upper(name) == name) & (F.length(name) >= 3)) | (name.rlike("^[A-Z]") & (F.length(name) > 4))
    return low.isin(names.GENERIC) | ~keep


def is_stop_word(name: Column) -> Column:
    """Whether a Han name is a stop word, or made of stop letters alone."""
    letters = "".join(w for w in names.STOP_WORDS if len(w) == 1)
    return name.isin(names.STOP_WORDS) | ~F.regexp_replace(name, f"[{letters}]", "").rlike(names.HAN)


def extract_entities(df: DataFrame, id_col: str, text_col: str, garbage: list[str] = names.GARBAGE) -> DataFrame:
    """(id, name, type, freq, pos): pos is the order of first appearance, pattern by pattern.

    Names that differ in case are one, of the first type and spelling. Stop words are of Han names,
    generic words of Latin ones. A null text has no entities.
    """
    t = F.col(text_col)

    def typed(kind: str) -> Callable[[Column], Column]:
        return lambda n: F.struct(F.lit(kind).alias("type"), n.alias("name"))

    def matches(patterns: list[tuple[str, str]]) -> list[Column]:
        return [F.transform(F.regexp_extract_all(t, F.lit(f"({p})")), typed(k)) for p, k in patterns]

    none = F.array().cast("array<struct<type:string,name:string>>")
    # one scan tells whether the patterns of Han letters need to be tried at all
    found = F.concat(F.when(has_han(t), F.concat(*matches(names.HAN_PATTERNS))).otherwise(none), *matches(names.LATIN_PATTERNS))
    rows = df.select(F.col(id_col).alias("id"), F.posexplode(found).alias("at", "e")).select("id", "at", "e.type", "e.name")
    n = F.col("name")
    kept = rows.filter((F.length(n) >= 2) & ~n.isin(garbage) & F.when(has_han(n), ~is_stop_word(n)).otherwise(~is_generic(n)))
    kept = kept.withColumn("name", F.when(has_han(n), clean_name(n, F.col("type"))).otherwise(n)).filter(F.length("name") >= 2)
    return kept.groupBy("id", F.lower("name").alias("key")).agg(F.min(F.struct("at", "name", "type")).alias("f"), F.count("*").alias("freq")).select("id", "f.name", "f.type", "freq", F.col("f.at").cast("long").alias("pos"))


def _has_colon(c: Column) -> Column:
    return reduce(lambda a, b: a | b, [c.contains(w) for w in names.DIALOGUE[:2]])


def before_colons(text: Column) -> Column:
    """What stands before each colon of a text, back to the colon before it; of a text without one, nothing."""
    pieces = _let(F.split(text, f"[{''.join(names.DIALOGUE[:2])}]"), lambda p: F.slice(p, 1, F.size(p) - 1))
    return F.when(_has_colon(text), pieces).when(text.isNotNull(), F.array().cast("array<string>"))


def _signals(name: Column, kind: Column, freq: Column, text: Column, han: Column | None = None, spoken: Column | None = None) -> list[tuple[Column, Column, float]]:
    """(label, whether, weight) in the order of the specification.

    han and spoken are has_han and before_colons of the text where they are known already; a text of neither
    Han letters nor colons may then be null.
    """

    def followed(words: list[str]) -> Column:
        return reduce(lambda a, b: a | b, [text.contains(F.concat(name, F.lit(w))) for w in words])

    person, han = kind == "person", has_han(text) if han is None else han
    colon = followed(names.DIALOGUE[:2])
    if spoken is not None:  # not the text for each of its names; a name with a colon in it ends no piece
        colon = F.when(_has_colon(name), colon).otherwise(F.exists(spoken, lambda p: p.endswith(name)))
    at = F.position(name, text)
    before = F.coalesce(F.length(F.regexp_extract(F.substring(text, F.lit(1), at - 1), "(?s)^(.*)\n", 1)), F.lit(0))
    has_line = F.instr(F.substring(text, F.lit(1), at - 1), "\n") > 0
    start = F.when(has_line, F.greatest(F.lit(0), before - 50)).otherwise(0)
    line_end = F.instr(F.substring(text, at, F.length(text)), "\n")
    # without a line end after the name the window ends at the 49th letter of the text
    end = F.when(line_end > 0, F.least(F.length(text), at + line_end - 2 + 50)).otherwise(49)
    window = F.substring(text, start + 1, F.greatest(F.lit(0), end - start))
    return [
        (F.concat(F.lit("高频("), freq.cast("string"), F.lit("x)")), freq >= 3, 0.15),
        (F.concat(F.lit("中频("), freq.cast("string"), F.lit("x)")), freq == 2, 0.08),
        (F.lit("对话标记"), person & F.when(han, followed(names.DIALOGUE)).otherwise(colon), 0.2),
        (F.lit("动作上下文"), person & han & followed(names.ACTIONS), 0.15),
        (F.lit("代词邻近"), person & han & (at > 0) & window.rlike(f"[{''.join(names.PRONOUNS)}]"), 0.1),
        (F.lit("中文姓氏"), person & name.rlike(f"^[{names.SURNAMES}]"), 0.1),
        (F.lit("英文全名"), person & name.contains(" ") & name.rlike("^[A-Z]"), 0.1),
        (F.lit("大写缩写"), (kind == "org") & name.rlike("[A-Z]") & (F.upper(name) == name), 0.1),
        (F.lit("头衔后缀"), name.rlike(f"(?:{_any(names.TITLES)})$"), 0.15),
    ]


def entity_score(name: Column, kind: Column, freq: Column, text: Column, han: Column | None = None, spoken: Column | None = None) -> Column:
    """Confidence of an entity by its signals, 0.3 to 0.99."""
    base = F.when(kind == "person", 0.2).when(kind.isin("org", "location"), 0.15).otherwise(0.1)
    score = reduce(lambda a, s: a + F.when(s[1], s[2]).otherwise(0.0), _signals(name, kind, freq, text, han, spoken), F.lit(0.0))
    return F.round(F.greatest(F.lit(0.3), F.least(F.lit(0.99), score + base)), 2)


def score_entities(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, name, type, freq, pos, confidence): the entities of texts with their scores.

    Han letters and colons are looked for once in a text, not once for each of its names, whose number grows
    with it; texts with neither go no further.
    """
    t = F.col(text_col)
    texts = df.select(F.col(id_col).alias("id"), has_han(t).alias("han"), before_colons(t).alias("spoken"), F.when(has_han(t) | _has_colon(t), t).alias("text"))
    e = extract_entities(df, id_col, text_col).join(texts, "id")
    score = entity_score(F.col("name"), F.col("type"), F.col("freq"), F.col("text"), F.col("han"), F.col("spoken"))
    return e.select("id", "name", "type", "freq", "pos", score.alias("confidence"))


def entity_signals(name: Column, kind: Column, freq: Column, text: Column) -> Column:
    """The labels of the first five signals."""
    return F.slice(F.array_compact(F.array(*[F.when(on, label) for label, on, _ in _signals(name, kind, freq, text)])), 1, 5)
