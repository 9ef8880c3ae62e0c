"""Scans, sinks, filters and maintenance."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.embed import NAME, hash_embedding
from ..functions.text import path_escape, repair_mojibake, repair_nul, should_skip
from ..operators.ingest import AUTHORITY_RANK, annotate, dedup_exact
from ..operators.plugins import repair_document
from ..sources.store import scratch
from ..sources.tables import EVENTS_NOW, NOW, events, memories, table
from .annotation import ANN_SQL
from .registry import MEM, query


@query("scan_memory_by_id", f"WITH {MEM} SELECT id, length(content) AS n FROM memories WHERE id = 42")
def _(s, d):
    return memories(s, d).filter("id = 42").select("id", F.length("content").cast("long").alias("n"))


@query("scan_recent", f"WITH {MEM} SELECT id, created_at FROM memories WHERE created_at >= {NOW} - 720 * 3600 ORDER BY created_at DESC, id LIMIT 100")
def _(s, d):
    return memories(s, d).filter(F.col("created_at") >= NOW - 720 * 3600).select("id", "created_at").orderBy(F.desc("created_at"), "id").limit(100)


@query("scan_wing_room", f"WITH {MEM} SELECT id, wing, room, created_at FROM memories WHERE wing = 'en' AND room = 'src1' ORDER BY created_at DESC, id LIMIT 50")
def _(s, d):
    return memories(s, d).filter("wing = 'en' and room = 'src1'").select("id", "wing", "room", "created_at").orderBy(F.desc("created_at"), "id").limit(50)


@query("list_wings", "SELECT DISTINCT lang AS wing FROM documents WHERE lang IS NOT NULL")
def _(s, d):
    return memories(s, d).select("wing").filter("wing is not null").distinct()


@query("list_rooms", "SELECT DISTINCT source AS room FROM documents WHERE lang = 'en'")
def _(s, d):
    return memories(s, d).filter("wing = 'en'").select("room").distinct()


@query("taxonomy", "SELECT lang AS wing, string_agg(DISTINCT source, ',' ORDER BY source) AS rooms FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL GROUP BY 1")
def _(s, d):
    return memories(s, d).filter("wing is not null and room is not null").groupBy("wing").agg(F.array_join(F.sort_array(F.collect_set("room")), ",").alias("rooms"))


@query("scene_list", f"WITH {MEM} SELECT wing, room, max(created_at) AS updated_at FROM memories GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 20 OFFSET 10")
def _(s, d):
    return memories(s, d).groupBy("wing", "room").agg(F.max("created_at").alias("updated_at")).orderBy(F.desc("updated_at"), "wing", "room").offset(10).limit(20)


@query("scan_verbatim", "SELECT conv_id, turn, role FROM conversations WHERE contains(lower(text), 'there') ORDER BY conv_id DESC, turn DESC LIMIT 20")
def _(s, d):
    return table(s, d, "conversations").filter(F.lower("text").contains("there")).select("conv_id", "turn", "role").orderBy(F.desc("conv_id"), F.desc("turn")).limit(20)


@query("scan_vectors_by_metadata", "SELECT vec_id, label FROM embeddings WHERE label = 2 ORDER BY vec_id LIMIT 20")
def _(s, d):
    return table(s, d, "embeddings").filter("label = 2").select("vec_id", "label").orderBy("vec_id").limit(20)


@query("random_sample", "SELECT doc_id AS id, md5(concat(doc_id::VARCHAR, ':7')) AS h FROM documents ORDER BY h, id LIMIT 5")
def _(s, d):
    return memories(s, d).select("id", F.md5(F.concat(F.col("id").cast("string"), F.lit(":7")).cast("binary")).alias("h")).orderBy("h", "id").limit(5)


@query("wiki_dump", f"WITH {ANN_SQL} SELECT id, CASE authority WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END AS authority_rank, trust_score, substr(text, 1, 500) AS content FROM ann")
def _(s, d):
    a = annotate(memories(s, d))
    order = F.lit(9)
    for k, v in AUTHORITY_RANK.items():
        order = F.when(F.col("authority") == k, v).otherwise(order)
    return a.select("id", order.alias("authority_rank"), "trust_score", F.substring("content", 1, 500).alias("content"))


@query("sink_memory", "SELECT doc_id AS id, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'stored' ELSE 'new' END AS origin, length(text) AS n FROM documents")
def _(s, d):
    """Insert-or-ignore into a written table: labelled documents are there already and stay as they are."""
    m = memories(s, d).select("id", "content")
    store = scratch(s)
    store.append("memories", m.join(table(s, d, "labels").select(F.col("doc_id").alias("id")), "id", "left_semi").withColumn("origin", F.lit("stored")))
    store.insert_new("memories", m.withColumn("origin", F.lit("new")))
    return store.read("memories").select("id", "origin", F.length("content").cast("long").alias("n"))


@query("sink_vector_one", "SELECT doc_id AS id, concat_ws('/', lang, source, substr(sha256(text), 1, 16)) AS drawer FROM documents")
def _(s, d):
    return memories(s, d).select("id", F.concat_ws("/", "wing", "room", F.substring(F.sha2(F.col("content").cast("binary"), 256), 1, 16)).alias("drawer"))


def _embed(rows):
    return rows.select("id", hash_embedding(F.col("content")).alias("embedding"))


@query("sink_vector_batch", "SELECT min(doc_id) AS id, sha256(coalesce(text, '')) AS content_hash, 64::BIGINT AS n FROM documents GROUP BY coalesce(text, '')")
def _(s, d):
    """Two batches with a common half: memories and vectors are written, a text that has a vector is not embedded again."""
    m = memories(s, d).select("id", F.coalesce("content", F.lit("")).alias("content"))
    store = scratch(s)
    store.sink_batch(m.filter("id % 3 < 2"), _embed)
    store.sink_batch(m.filter("id % 3 > 0"), _embed)
    v = store.read("vectors").select("content_hash", F.size("embedding").cast("long").alias("n"))
    first = store.read("memories").groupBy(F.sha2(F.col("content").cast("binary"), 256).alias("content_hash")).agg(F.min("id").alias("id"))
    return v.join(first, "content_hash").select("id", "content_hash", "n")


@query("sink_verbatim", "SELECT conv_id, 2 * count(*) AS n, 2 * sum(length(text))::BIGINT AS chars FROM conversations GROUP BY 1")
def _(s, d):
    """Raw rows appended twice: duplicates stay."""
    rows, store = table(s, d, "conversations"), scratch(s)
    for _ in range(2):
        store.append("verbatim", rows, "conv_id")
    return store.read("verbatim", "conv_id").groupBy("conv_id").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@query("sink_write_buffer", "SELECT user_id, event_type, arg_max(round(value, 6), event_id) AS value FROM events GROUP BY 1, 2")
def _(s, d):
    return events(s, d).groupBy("user_id", "event_type").agg(F.max_by(F.round("value", 6), "event_id").alias("value"))


@query("delete_by_id", "SELECT doc_id AS id, length(text) AS n FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def _(s, d):
    store = scratch(s)
    store.append("memories", memories(s, d).select("id", "content"))
    store.delete("memories", table(s, d, "labels").filter("toxic = 1").select(F.col("doc_id").alias("id")))
    return store.read("memories").select("id", F.length("content").cast("long").alias("n"))


@query("ttl_expire_memories", f"SELECT event_id AS id, expires_at FROM (SELECT event_id, CASE WHEN event_id % 5 > 0 THEN floor(epoch(ts))::BIGINT + floor(value)::BIGINT * 86400 END AS expires_at FROM events) WHERE expires_at IS NULL OR expires_at >= {EVENTS_NOW}")
def _(s, d):
    """The rows that outlive the time, a fifth of them without one."""
    e = events(s, d).select(F.col("event_id").alias("id"), F.when(F.col("event_id") % 5 > 0, F.col("at") + F.floor("value").cast("long") * 86400).alias("expires_at"))
    store = scratch(s)
    store.append("memories", e)
    store.expire("memories", EVENTS_NOW)
    return store.read("memories").select("id", "expires_at")


@query("ttl_expire_personas", f"SELECT user_id FROM events GROUP BY 1 HAVING max(floor(epoch(ts))::BIGINT) + 25 * 86400 >= {EVENTS_NOW} + 24 * 86400")
def _(s, d):
    return events(s, d).groupBy("user_id").agg(F.max("at").alias("last")).filter(F.col("last") + 25 * 86400 >= EVENTS_NOW + 24 * 86400).select("user_id")


@query("kv_config", "SELECT event_type AS key, arg_max(props, event_id) AS value FROM events GROUP BY 1")
def _(s, d):
    return events(s, d).groupBy(F.col("event_type").alias("key")).agg(F.max_by("props", "event_id").alias("value"))


@query("rebuild_index", "SELECT doc_id AS id, sha256(coalesce(text, '')) AS content_hash, 64::BIGINT AS n FROM documents")
def _(s, d):
    """All vectors anew from the memories; vectors of rows that are not there go."""
    m = memories(s, d).select("id", F.coalesce("content", F.lit("")).alias("content"))
    store = scratch(s)
    store.append("memories", m)
    store.append("vectors", _embed(m.select((F.col("id") + 10_000_000).alias("id"), "content")).withColumn("content_hash", F.lit("old")))
    store.rebuild(_embed)
    return store.read("vectors").select("id", "content_hash", F.size("embedding").cast("long").alias("n"))


@query("replay_annotations", f"WITH {ANN_SQL} SELECT id, authority, trust_score FROM ann")
def _(s, d):
    """Stored annotations of an older rule, overwritten by key with those of today."""
    m = memories(s, d)
    store = scratch(s)
    store.append("annotations", m.select("id", F.lit("unknown").alias("authority"), F.lit(0.0).alias("trust_score")))
    store.upsert("annotations", annotate(m).select("id", "authority", "trust_score"))
    return store.read("annotations").select("id", "authority", "trust_score")


@query("embedder_identity_check", "SELECT label, CASE WHEN label % 2 = 0 THEN 'hashing-64' ELSE 'hashing-32' END AS stored, 'hashing-64' AS current, label % 2 = 0 AS same, min(len(embedding))::BIGINT AS n FROM embeddings GROUP BY label")
def _(s, d):
    """The embedder that a table of vectors names as its own, written with it and read back, against the one in use.

    Vectors of odd labels stand in a table that an older embedder wrote.
    """
    v, store = table(s, d, "embeddings"), scratch(s)
    with store.transaction() as t:
        for name, rows, embedder in (("vectors", v.filter("label % 2 = 0"), NAME), ("vectors_before", v.filter("label % 2 <> 0"), "hashing-32")):
            t.append(name, rows.select("vec_id", "label", "embedding"), "vec_id")
            t.set_property(name, "embedder", embedder)

    def told(name):
        stored = store.properties(name)["embedder"]
        by_label = store.read(name, "vec_id").groupBy("label").agg(F.min(F.size("embedding")).cast("long").alias("n"))
        return by_label.select("label", F.lit(stored).alias("stored"), F.lit(NAME).alias("current"), F.lit(stored == NAME).alias("same"), "n")

    return told("vectors").unionByName(told("vectors_before"))


@query("store_health", "SELECT (SELECT count(*) FROM documents) AS n_rows, (SELECT count(*) FROM embeddings) AS n_vectors, (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)) AS n_missing, (SELECT count(*) FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents)) AS n_orphans")
def _(s, d):
    m, v = memories(s, d).select("id"), table(s, d, "embeddings").select(F.col("vec_id").alias("id"))
    both = m.withColumn("m", F.lit(1)).join(v.withColumn("v", F.lit(1)), "id", "full")
    return both.agg(F.count("m").alias("n_rows"), F.count("v").alias("n_vectors"), F.count_if(F.col("v").isNull()).alias("n_missing"), F.count_if(F.col("m").isNull()).alias("n_orphans"))


@query("orphan_cleanup", "SELECT count(*) FILTER (trim(coalesce(text, '')) = '') AS n_empty, count(*) FILTER (trim(coalesce(text, '')) <> '') AS n_kept FROM documents")
def _(s, d):
    empty = F.trim(F.coalesce("content", F.lit(""))) == ""
    return memories(s, d).agg(F.count_if(empty).alias("n_empty"), F.count_if(~empty).alias("n_kept"))


@query("content_like_delete", "SELECT doc_id AS id FROM documents WHERE NOT (text LIKE '%license%' OR text LIKE '%ouelle%')")
def _(s, d):
    return memories(s, d).filter(~(F.col("content").like("%license%") | F.col("content").like("%ouelle%"))).select("id")


@query("eval_dataset_load", "SELECT d.doc_id AS id, coalesce(CASE WHEN l.quality = 1 THEN 'good' END, 'general') AS category FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def _(s, d):
    """JSON samples with a default category, through to_json and from_json."""
    rows = memories(s, d).select("id").join(table(s, d, "labels").select(F.col("doc_id").alias("id"), "quality"), "id", "left")
    js = rows.select(F.to_json(F.struct("id", F.when(F.col("quality") == 1, "good").alias("category"))).alias("j"))
    return js.select(F.from_json("j", "id long, category string").alias("x")).select("x.id", F.coalesce("x.category", F.lit("general")).alias("category"))


@query("chat_format_parse", "SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, role FROM conversations")
def _(s, d):
    """Nested chats (an array of turns in a row) exploded to turns."""
    nested = table(s, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role"))).alias("chat"))
    return nested.select("conv_id", F.posexplode("chat").alias("pos", "t")).select("conv_id", F.col("pos").cast("long").alias("pos"), "t.role")


@query("filter_conjunctive", f"WITH {MEM} SELECT count(*) AS n FROM memories WHERE wing = 'en' AND room = 'src3'")
def _(s, d):
    from functools import reduce

    wanted = {"wing": "en", "room": "src3"}
    return memories(s, d).filter(reduce(lambda a, b: a & b, [F.col(k) == v for k, v in wanted.items()])).agg(F.count("*").alias("n"))


@query("filter_range", f"WITH {MEM} SELECT id FROM memories WHERE created_at BETWEEN 1704500000 AND 1705500000")
def _(s, d):
    return memories(s, d).filter(F.col("created_at").between(1704500000, 1705500000)).select("id")


@query("filter_null_empty", "SELECT count(*) AS n FROM documents WHERE text IS NOT NULL AND text <> ''")
def _(s, d):
    return memories(s, d).filter("content is not null and content <> ''").agg(F.count("*").alias("n"))


@query("filter_membership", "SELECT doc_id AS id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def _(s, d):
    good = table(s, d, "labels").filter("quality = 1").select(F.col("doc_id").alias("id"))
    return memories(s, d).select("id").join(good, "id", "left_semi")


@query("filter_substring", "SELECT DISTINCT event_type, user_id FROM events WHERE contains(lower(event_type), 'pur') OR contains(lower(props), '\"k\": 7')")
def _(s, d):
    return events(s, d).filter(F.lower("event_type").contains("pur") | F.lower("props").contains('"k": 7')).select("event_type", "user_id").distinct()


@query("should_skip", r"SELECT conv_id, turn, coalesce(length(regexp_replace(text, '^[ \t\n\r]+|[ \t\n\r]+$', '', 'g')) < 5 OR regexp_matches(text, '^[/\\]') OR regexp_matches(regexp_replace(text, '^[ \t\n\r]+|[ \t\n\r]+$', '', 'g'), '^[0-9 \t\n\r]+$'), true) AS skip FROM conversations")
def _(s, d):
    return table(s, d, "conversations").select("conv_id", "turn", should_skip(F.col("text")).alias("skip"))


@query("trust_filter", f"WITH {ANN_SQL} SELECT id, authority, trust_score, 1704067200 + id * 3600 AS created_at FROM ann WHERE authority IN ('critical', 'high') AND trust_score >= 0.7 ORDER BY id DESC LIMIT 500")
def _(s, d):
    """Ranked authority: critical and high, trust at least 0.7, the newest 500."""
    a = annotate(memories(s, d)).filter(F.col("authority").isin("critical", "high") & (F.col("trust_score") >= 0.7))
    return a.select("id", "authority", "trust_score", "created_at").orderBy(F.desc("created_at"), "id").limit(500)


@query("min_evidence_filter", f"WITH {MEM}, g AS (SELECT *, count(*) OVER (PARTITION BY wing, room) AS n FROM memories) SELECT id, n FROM g WHERE n >= 3")
def _(s, d):
    m = memories(s, d)
    big = m.groupBy("wing", "room").agg(F.count("*").alias("n")).filter("n >= 3")
    return m.join(big, ["wing", "room"]).select("id", "n")


@query("incremental_filter", f"WITH {MEM} SELECT count(*) AS n, min(id) AS first FROM memories WHERE created_at > 1705000000")
def _(s, d):
    return memories(s, d).filter(F.col("created_at") > 1705000000).agg(F.count("*").alias("n"), F.min("id").alias("first"))


@query("projection_truncate", "SELECT doc_id AS id, substr(text, 1, 80) AS short, substr(concat(lang, chr(10), text), 1, 200) AS joined FROM documents")
def _(s, d):
    return memories(s, d).select("id", F.substring("content", 1, 80).alias("short"), F.substring(F.concat("wing", F.lit("\n"), "content"), 1, 200).alias("joined"))


@query("metadata_stringify", "SELECT event_id, concat('k=', (props::JSON->>'k')) AS meta FROM events")
def _(s, d):
    m = F.from_json("props", "map<string,int>")
    text = F.transform_values(m, lambda k, v: v.cast("string"))
    return events(s, d).select("event_id", F.array_join(F.transform(F.map_entries(text), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("meta"))


@query("repair_nul", "SELECT doc_id AS id, length(replace(text, ' ', '')) AS n FROM documents")
def _(s, d):
    """The driver's texts have no NUL: spaces are turned into NULs first."""
    dirty = F.replace("content", F.lit(" "), F.lit("\x00"))
    return memories(s, d).select("id", F.length(repair_nul(dirty)).cast("long").alias("n"))


@query("repair_mojibake", "SELECT doc_id AS id, md5(text) AS h FROM documents")
def _(s, d):
    """Accented letters are first spoilt as if UTF-8 had been read as Windows-1252, then repaired."""
    from functools import reduce

    spoilt = reduce(lambda c, p: F.replace(c, F.lit(p), F.lit(p.encode().decode("cp1252"))), "éèêçñóúü", F.col("content"))
    return memories(s, d).select("id", F.md5(repair_mojibake(spoilt).cast("binary")).alias("h"))


@query("repair_document", "SELECT doc_id AS id, md5(replace(text, ' ', '')) AS h FROM documents")
def _(s, d):
    """Spaces turned into NULs and letters spoilt; both repairs in order."""
    from functools import reduce

    spoilt = reduce(lambda c, p: F.replace(c, F.lit(p), F.lit(p.encode().decode("cp1252"))), "éèêçñóúü", F.replace("content", F.lit(" "), F.lit("\x00")))
    return memories(s, d).select("id", F.md5(repair_document(spoilt).cast("binary")).alias("h"))


@query("path_escape", "SELECT page_id, replace(replace(replace(replace(replace(url, '%', '%25'), '#', '%23'), '&', '%26'), '?', '%3F'), '=', '%3D') AS url FROM pages")
def _(s, d):
    return table(s, d, "pages").select("page_id", path_escape(F.col("url")).alias("url"))


@query("content_hash", "SELECT doc_id AS id, sha256(text) AS content_hash FROM documents")
def _(s, d):
    return memories(s, d).select("id", F.sha2(F.col("content").cast("binary"), 256).alias("content_hash"))


@query("dedup_exact", "SELECT min(doc_id) AS id, sha256(text) AS content_hash FROM documents GROUP BY text")
def _(s, d):
    return dedup_exact(memories(s, d), "content", "id").select("id", "content_hash")


@query("seen_hash_skip", "SELECT doc_id AS id FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE source = 'src1')")
def _(s, d):
    h = F.sha2(F.col("content").cast("binary"), 256).alias("h")
    m = memories(s, d).select("id", "room", h)
    return m.join(m.filter("room = 'src1'").select("h").distinct(), "h", "left_anti").select("id")


@query("system_stats", "SELECT (SELECT count(*) FROM documents) AS memories, (SELECT count(*) FROM embeddings) AS vectors, (SELECT count(*) FROM conversations) AS verbatim, (SELECT count(DISTINCT source) FROM documents) AS rooms")
def _(s, d):
    m = memories(s, d).agg(F.count("*").alias("memories"), F.count_distinct("room").alias("rooms"))
    v, c = table(s, d, "embeddings").agg(F.count("*").alias("vectors")), table(s, d, "conversations").agg(F.count("*").alias("verbatim"))
    return m.crossJoin(v).crossJoin(c).select("memories", "vectors", "verbatim", "rooms")  # one row each
