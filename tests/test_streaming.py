from pyspark.sql import functions as F

from corpusmill.streaming import questions


def run(frame, name, mode):
    q = frame.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()


def test_question_stream(spark, tmp_path):
    rows = [("a", "Should prostate cancer be referred?"), ("b", "Evidence on haemoptysis"), ("c", "I am unconscious")]
    spark.createDataFrame(rows, "qid string, text string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("qid string, text string").parquet(str(tmp_path / "in"))
    run(questions.guarded(stream), "guarded", "append")
    assert {r.qid: r.outcome for r in spark.table("guarded").collect()} == {"a": "scope_refusal", "b": None, "c": "emergency_redirect"}
    idf = spark.createDataFrame([("haemoptysis", 2.0)], "term string, idf double")
    postings = spark.createDataFrame([(1, "haemoptysis", 3)], "doc_id int, term string, tf int")
    run(questions.scored(stream, postings, idf), "scored", "append")
    assert [(r.qid, r.doc_id, r.weight) for r in spark.table("scored").collect()] == [("b", 1, 6.0)]


def test_telemetry(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    events.write.parquet(str(tmp_path / "ev"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "ev"))
    run(questions.telemetry(stream, "1 day"), "telemetry", "complete")
    assert spark.table("telemetry").agg(F.sum("n")).first()[0] == events.count()
