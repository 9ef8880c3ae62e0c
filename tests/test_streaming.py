"""Streaming forms agree with the batch forms."""

from pyspark.sql import functions as F

from mnemoria.operators.beliefs import belief_fold
from mnemoria.streaming import ingest


def _run(df, mode, name, spark):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name)


def test_dedup_and_registry(spark, tmp_path):
    rows = spark.createDataFrame([(k, f"t{k % 3}", "2024-01-01 00:00:00") for k in range(9)], "id int, content string, at string")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")).withColumn("at", F.to_timestamp("at"))
    assert _run(ingest.dedup_stream(stream, "content", "at"), "append", "dedup_out", spark).count() == 3
    reg = _run(ingest.registry_stream(stream.select(F.col("content").alias("name"))), "complete", "reg_out", spark)
    assert {(r["name"], r["count"], r["state"]) for r in reg.collect()} == {(f"t{k}", 3, "confirmed") for k in range(3)}


def test_beliefs(spark, tmp_path):
    rows = spark.createDataFrame([("c", k % 2, k, v, 0.1) for k, v in enumerate(["click", "view", "click", "view", "view", "click"])], "category string, key long, seq int, value string, delta double")
    rows.write.parquet(str(tmp_path / "in"))
    got = _run(ingest.belief_stream(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))), "update", "belief_out", spark)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, belief_fold(rows).collect()))


def test_sink_is_idempotent(spark, tmp_path):
    write = ingest.idempotent_sink(str(tmp_path / "out"))
    for _ in range(2):
        write(spark.range(3), 0)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_names_are_forgotten(spark, tmp_path):
    rows = lambda *x: spark.createDataFrame([(n, t) for n, t in x], "name string, at string").select("name", F.to_timestamp("at").alias("ts"))
    source, out = str(tmp_path / "in"), {}
    schema = rows(("a", "2024-01-01")).schema

    def run(batch):
        batch.write.mode("append").parquet(source)
        stream = ingest.registry_with_ttl(spark.readStream.schema(schema).parquet(source), "ts", 3600, delay="1 second")

        def sink(df, _):
            out.update({r["name"]: (r["count"], r["state"]) for r in df.collect()})

        stream.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).foreachBatch(sink).start().awaitTermination()

    run(rows(*[("a", "2024-01-01 00:00:00")] * 3, ("b", "2024-01-01 00:00:10")))
    assert out == {"a": (3, "confirmed"), "b": (1, "candidate")}
    run(rows(("b", "2024-01-01 00:50:00"), ("c", "2024-01-01 01:30:00")))
    run(rows(("c", "2024-01-01 01:31:00")))
    assert out["a"] == (0, "expired") and out["b"] == (2, "candidate") and out["c"] == (2, "candidate")


def test_quarantine(spark, tmp_path):
    source, bad, good = (str(tmp_path / x) for x in ("in", "bad", "good"))
    spark.createDataFrame([(1, "fine"), (2, None), (3, "also fine")], "id long, text string").write.parquet(source)
    sink = ingest.quarantine_sink(ingest.idempotent_sink(good), bad, F.when(F.col("text").isNull(), "no text"))
    ingest.micro_batches(spark.readStream.schema("id long, text string").parquet(source), sink, str(tmp_path / "c"), until_empty=True).awaitTermination()
    assert {r["id"] for r in spark.read.parquet(good).collect()} == {1, 3}
    assert [(r["id"], r["problem"]) for r in spark.read.parquet(bad).collect()] == [(2, "no text")]
