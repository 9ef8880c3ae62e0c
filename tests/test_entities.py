"""Entity extraction against the rules written out, on literal and random texts."""

import random
import re

from pyspark.sql import functions as F

from mnemoria.functions import names
from mnemoria.operators import entities, ingest
from mnemoria.plans.catalog import queries as annotation_queries

HAN = re.compile(names.HAN)


def _clean(name, kind):
    if not HAN.search(name):
        return name
    if kind == "person" and name in names.NO_PERSONS:
        return ""
    for _ in range(6):
        safe = names.PRODUCT_PREFIXES if kind == "product" else []
        gone = next((p for p in names.NOISE_PREFIXES if p not in safe and name.startswith(p) and len(name) > len(p) + 1), None)
        if gone is None:
            break
        name = name[len(gone) :]
    verb = next((v for v in sorted(names.PERSON_VERBS, key=len, reverse=True) if v in name and len(name) > len(v)), None)
    if verb and name.find(verb) > 0:
        name = name[: name.find(verb)]
    if kind == "person":
        name = name.removesuffix("也")
    for suffix in sorted(names.TYPE_SUFFIXES[kind], key=len, reverse=True):
        at = name.rfind(suffix)
        if at > 0:
            head = re.split("[的在跟到去来]", name[max(0, at - 8) : at])[-1]
            return (head + suffix).strip()
    return name.strip()


def _entities(text):
    seen = {}
    for pattern, kind in names.HAN_PATTERNS + names.LATIN_PATTERNS:
        for name in (m.group() for m in re.finditer(pattern, text)):
            if len(name) < 2 or name in names.GARBAGE:
                continue
            if HAN.search(name):
                if name in names.STOP_WORDS or all(c in names.STOP_WORDS for c in name if HAN.match(c)):
                    continue
            elif name.lower() in names.GENERIC or not (" " in name or name.isupper() and len(name) >= 3 or len(name) > 4):
                continue
            name = _clean(name, kind)
            if len(name) >= 2:
                seen.setdefault(name.lower(), [name, kind, 0])[2] += 1
    return [tuple(x) for x in seen.values()]


def _texts():
    rng = random.Random(5)
    parts = [*names.SURNAMES[:12], *"明华强伟芳也了在的说去我", *names.PERSON_VERBS[:8], *names.TITLES[:4], *names.NOISE_PREFIXES[:30], "公司", "大学", "市", "区", "系统", "平台", "APP", "局", "局长", "，", "。", " ", "John", "Smith", "NASA", "Claude", "Error"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(1500)] + ["", "今天", "我们我们我们", "方案"]


def test_extract(spark):
    texts = _texts()
    df = spark.createDataFrame([*enumerate(texts), (-1, None)], "id long, content string")
    got = {}
    for r in entities.extract_entities(df, "id", "content").collect():
        got.setdefault(r["id"], []).append((r["pos"], r["name"], r["type"], r["freq"]))
    for k, text in enumerate(texts):
        assert [x[1:] for x in sorted(got.get(k, []))] == _entities(text), text
    assert -1 not in got


def test_clean(spark):
    rows = [(k, t[:12], kind) for k, t in enumerate(_texts()) for kind in names.TYPE_SUFFIXES]
    df = spark.createDataFrame(rows, "id long, name string, kind string")
    for r in df.select("name", "kind", entities.clean_name(F.col("name"), F.col("kind")).alias("out")).collect():
        assert r["out"].strip() == _clean(r["name"], r["kind"]).strip(), r


def test_score(spark):
    rows = [("张三", "person", 3, "张三说他完成了工作，张三做了设计"), ("李四老师", "person", 1, "李四老师在这里"), ("NASA", "org", 2, "NASA and NASA"), ("John Smith", "person", 1, "John Smith: hello"), ("北京市", "location", 1, "北京市"), (None, "person", 1, None)]
    df = spark.createDataFrame(rows, "name string, kind string, freq long, text string")
    args = [F.col(c) for c in ("name", "kind", "freq", "text")]
    got = df.select(entities.entity_score(*args).alias("score"), entities.entity_signals(*args).alias("signals")).collect()
    assert [r["score"] for r in got[:5]] == [0.9, 0.45, 0.33, 0.5, 0.3]
    assert got[0]["signals"] == ["高频(3x)", "对话标记", "动作上下文", "代词邻近", "中文姓氏"]
    assert got[1]["signals"] == ["中文姓氏", "头衔后缀"] and got[3]["signals"] == ["对话标记", "英文全名"]


def test_annotations_of_texts(spark):
    """Classes and first person by counts in Python; what a text alone tells is written once in the filtered plan."""
    words = [w for ws in ingest.FACT_TYPES.values() for w in ws] + ingest.FIRST_PERSON
    assert all(HAN.search(w) for w in words)  # so a text without Han letters need not be searched
    rng = random.Random(6)
    texts = ["".join(rng.choice([*words, "NASA ", "John", "。", "x"]) for _ in range(rng.randint(0, 6))) for _ in range(400)] + ["", None, "plain", "John Smith"]
    df = spark.createDataFrame([*enumerate(texts)], "id long, content string").withColumn("created_at", F.col("id"))
    for r in ingest.annotate(df).collect():
        n = [sum(w in (r["content"] or "") for w in ws) for ws in ingest.FACT_TYPES.values()]
        assert r["fact_type"] == list(ingest.FACT_TYPES)[n.index(max(n))], r
        assert (r["authority"] == "critical") == any(p in (r["content"] or "") for p in ingest.FIRST_PERSON), r
    kept = ingest.annotate(df).filter(F.col("authority").isin("critical", "high") & (F.col("trust_score") >= 0.7)).select("id", "authority", "trust_score")
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    above = plan[: plan.index("Join")]
    assert plan.count("Contains(content") == len(words) and "Contains(" not in above and "content" not in above


def test_scores_of_texts(spark):
    """Scores of extracted names equal those over the whole text; no text goes to its names' rows unless they need it."""
    rng = random.Random(7)
    parts = ["John", "John Smith", "Smith", ":", "：", " ", "\n", "NASA", "张三", "说", "他", "测试", "。", "Mary:", "xNASA:"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(600)] + ["", ":", "：：", "John:", ":John", None]
    df = spark.createDataFrame([*enumerate(texts)], "id long, content string")
    whole = entities.extract_entities(df, "id", "content").join(df, "id").select("id", "name", entities.entity_score(*[F.col(c) for c in ("name", "type", "freq", "content")]).alias("confidence"))
    out = entities.score_entities(df, "id", "content").select("id", "name", "confidence")
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, whole.collect()))
    for rows in (out, annotation_queries()["entity_score_en"](spark, "/root/testdata/sf0.001")):
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        assert names.HAN not in plan[: plan.index("Join")]
    odd = spark.createDataFrame([("a:b", "a:b: c"), ("a:b", "a:b c"), ("", "x:"), ("", "x")], "name string, text string")
    n, t = F.col("name"), F.col("text")
    args = n, F.lit("person"), F.lit(1), t
    assert odd.filter(entities.entity_score(*args) != entities.entity_score(*args, entities.has_han(t), entities.before_colons(t))).count() == 0
