"""Column functions on text, all native expressions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Sentence ends, signals of density and of stability, and the interjections of short replies.
SENTENCE_END = r"[。！？；.!?;]\s*"
DENSITY_PATTERNS = [
    r"[0-9]+",
    "年|月|日|时|分|秒|周|昨天|今天|明天|上周|下周",
    "先生|女士|小.|老.|博士|教授|医生",
    "因为|所以|导致|引起|由于|因此|结果|原因",
    r"元|块|万|亿|￥|¥|\$",
]
STABILITY_PATTERNS = [
    "(总是|经常|通常|习惯|喜欢|偏好|倾向于|爱)",
    "(擅长|精通|熟悉|熟练掌握|能|会|懂得)",
    "(一直|长期|多年来|持续|始终|从未)",
    "(研究|专业|领域|方向|关注|感兴趣)",
    "(不[吃喝用]|避免|忌|戒|排斥)",
    "(信任|信赖|认可|推荐|首选)",
]
CJK = "[一-鿿]"


def grams(c: Column, n: int) -> Column:
    """Distinct substrings of n characters, in order of first appearance."""
    last = F.length(c) - n + 1
    return F.when(last >= 1, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substring(c, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))


def bigram_set(c: Column) -> Column:
    """Bigrams of the lower-cased, trimmed text; a single character stands for itself."""
    t = F.lower(F.trim(c))
    return F.when(F.length(t) == 1, F.array(t)).otherwise(grams(t, 2))


def trigram_set(c: Column) -> Column:
    """Trigrams of the lower-cased, trimmed text with two spaces before and one after."""
    return grams(F.concat(F.lit("  "), F.lower(F.trim(c)), F.lit(" ")), 3)


def set_jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    every = F.size(a) + F.size(b) - both
    return F.when(every > 0, both / every).otherwise(F.lit(0.0))


def set_dice(a: Column, b: Column) -> Column:
    total = F.size(a) + F.size(b)
    return F.when(total > 0, 2.0 * F.size(F.array_intersect(a, b)) / total).otherwise(F.lit(0.0))


def trigram_similarity(a: Column, b: Column) -> Column:
    """Dice of trigram sets: equal texts 1, an empty text 0."""
    x, y = F.lower(F.trim(a)), F.lower(F.trim(b))
    return F.when((x == "") | (y == ""), 0.0).when(x == y, 1.0).otherwise(set_dice(trigram_set(a), trigram_set(b)))


def occurrences(c: Column, term: str) -> Column:
    """Non-overlapping occurrences of a lower-case term in the lower-cased text."""
    low = F.lower(c)
    return ((F.length(low) - F.length(F.replace(low, F.lit(term), F.lit("")))) / len(term)).cast("int")


def words(c: Column) -> Column:
    """Runs without ASCII white space."""
    return F.array_remove(F.split(c, r"[ \t\n\r]+"), "")


def cjk_chars(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(f"({CJK})"))


def sentences(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, SENTENCE_END), lambda s: F.regexp_replace(s, r"^[ \t\n\r]+|[ \t\n\r]+$", "")), lambda s: s != "")


def summary_tokens(c: Column) -> Column:
    """Lower-case words, then single CJK characters, then CJK bigrams."""
    own = words(F.lower(c))

    def with_pairs(chars: Column) -> Column:
        pairs = F.when(F.size(chars) > 1, F.transform(F.sequence(F.lit(1), F.greatest(F.size(chars) - 1, F.lit(1))), lambda i: F.concat(F.element_at(chars, i), F.element_at(chars, i + 1)))).otherwise(F.array().cast("array<string>"))
        return F.concat(chars, pairs)

    # the letters are found once, and not looked for pair by pair
    return F.when(c.rlike(CJK), F.concat(own, F.get(F.transform(F.array(cjk_chars(c)), with_pairs), 0))).otherwise(own)


def _signals(c: Column, patterns: list[str]) -> Column:
    """Matches of all patterns; those whose every match holds a Han letter are tried where there is one."""
    count = lambda ps: reduce(lambda a, b: a + b, [F.regexp_count(c, F.lit(p)) for p in ps], F.lit(0))
    han = [p for p in patterns if all(re.search(CJK, part) for part in p.split("|"))]
    return count([p for p in patterns if p not in han]) + F.when(c.rlike(CJK) | c.isNull(), count(han)).otherwise(0)


def entity_density(c: Column) -> Column:
    return F.least(F.lit(1.0), _signals(c, DENSITY_PATTERNS) / 5.0)


def stability_signal(c: Column) -> Column:
    return F.least(F.lit(1.0), _signals(c, STABILITY_PATTERNS) / 3.0)


def should_skip(c: Column, least: int = 5) -> Column:
    """Too short, interjections only, a command, or digits only."""
    t = F.regexp_replace(c, r"^[ \t\n\r]+|[ \t\n\r]+$", "")
    return F.coalesce((F.length(t) < least) | t.rlike(r"^[好的嗯哦啊哈呵]+[ \t\n\r!！。.]*$") | t.rlike(r"^[/\\]") | t.rlike(r"^[0-9 \t\n\r]+$"), F.lit(True))


def path_escape(c: Column) -> Column:
    """Percent-encode # % & ? =, the percent sign first."""
    return reduce(lambda a, p: F.replace(a, F.lit(p[0]), F.lit(p[1])), [("%", "%25"), ("#", "%23"), ("&", "%26"), ("?", "%3F"), ("=", "%3D")], c)


def repair_nul(c: Column) -> Column:
    return F.replace(c, F.lit("\x00"), F.lit(""))


#: The characters that Windows-1252 has in 0x80-0x9F, and their bytes.
CP1252 = "€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ"
CP1252_BYTES = "".join(map(chr, (0x80, 0x82, 0x83, 0x84, 0x85, 0x86, 0x87, 0x88, 0x89, 0x8A, 0x8B, 0x8C, 0x8E, 0x91, 0x92, 0x93, 0x94, 0x95, 0x96, 0x97, 0x98, 0x99, 0x9A, 0x9B, 0x9C, 0x9E, 0x9F)))
_TAIL = f"[\u0080-¿{CP1252}]"
MOJIBAKE = f"[ÂÃ]{_TAIL}|â{_TAIL}{{2}}|ð{_TAIL}{{3}}|ï{_TAIL}{{2}}"


def repair_mojibake(c: Column, passes: int = 3) -> Column:
    """Runs of UTF-8 that was read as Windows-1252, decoded again; what does not decode stays."""

    def one(text: Column) -> Column:
        runs = F.array_distinct(F.regexp_extract_all(text, F.lit(f"({MOJIBAKE})")))

        def fix(acc: Column, run: Column) -> Column:
            raw = F.encode(F.translate(run, CP1252, CP1252_BYTES), "iso-8859-1")
            good = F.is_valid_utf8(raw.cast("string"))
            return F.when(good, F.replace(acc, run, F.decode(raw, "utf-8"))).otherwise(acc)

        return F.when(text.rlike(MOJIBAKE), F.aggregate(runs, text, fix)).otherwise(text)

    for _ in range(passes):  # each on the one before's text, which is made once and not for each use
        c = F.get(F.transform(F.array(c), one), 0)
    return c


def round6(c: Column) -> Column:
    return F.round(c, 6)
