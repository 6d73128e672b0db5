"""Streams that stop and go on, and event time, against batches."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from pseudolake.functions import catalog as cat
from pseudolake.plans import jobs, stream_queries, streams
from pseudolake.streaming import event_time, restore
from pseudolake.streaming.log import CommittedTables


def test_a_batch_counts_once_it_is_committed(spark, tmp_path):
    log = CommittedTables(str(tmp_path))
    rows = lambda *n: spark.createDataFrame([(x,) for x in n], "n int")
    assert log.last(spark) == -1 and log.read(spark, "a", "n int").count() == 0
    log.write(spark, 0, {"a": rows(1), "b": rows(2)})

    def stop(batch, name):
        raise RuntimeError(name)

    with pytest.raises(RuntimeError, match="a"):
        log.write(spark, 1, {"a": rows(3), "b": rows(4)}, stop)
    assert [r.n for r in log.read(spark, "a", "n int").collect()] == [1]
    log.write(spark, 1, {"a": rows(5), "b": rows()})
    assert sorted(r.n for r in log.read(spark, "a", "n int").collect()) == [1, 5]
    assert [r.n for r in log.read(spark, "a", "n int", before=1).collect()] == [1] and log.read(spark, "a", "n int", before=0).count() == 0


@pytest.mark.parametrize("table", ["vault", "texts"])
def test_stopped_anonymisation_equals_a_batch(spark, tmp_path, table):
    say = lambda k: f"{k}: a{k % 7}@corp.ru b{k % 5}@corp.ru и a{k % 3}@corp.ru"
    docs = spark.createDataFrame([(k, f"s{k % 2}", say(k)) for k in range(40)] + [(40, "s0", None), (41, "s1", "")], "doc_id long, session_id string, text string")
    stream = stream_queries.as_files(docs, "doc_id", str(tmp_path))
    stream_queries.stopped_once(lambda hook: streams.stream_anonymize(stream, str(tmp_path), cat.only("EMAIL"), on_written=hook), 2, table)
    log = CommittedTables(str(tmp_path))
    got = {(r.session_id, r.token): r.original_value for r in log.read(spark, "vault", streams.VAULT).collect()}
    texts, new, _ = jobs.anonymize_texts(docs, catalog=cat.only("EMAIL"))
    assert got == {(r.session_id, r.token): r.original_value for r in new.collect()}
    assert log.read(spark, "vault", streams.VAULT).count() == len(got)  # no token twice
    assert {r.doc_id: r.text for r in log.read(spark, "texts", "doc_id long, text string").collect()} == {r.doc_id: r.text for r in texts.collect()}


def test_no_answer_and_no_audit_row_is_lost_or_doubled(spark, tmp_path):
    rows = [(k, f"r{k}", "s", seq, text, last, error) for k in range(12) for seq, text, last, error in ((0, f"answer {k} [OR", False, None), (1, "G_1]" if k % 3 else "broken", k % 3 > 0, None if k % 3 else "closed"))]
    chunks = spark.createDataFrame(rows, "k long, stream_id string, session_id string, seq long, text string, is_last boolean, error string")
    known = spark.createDataFrame([("s", "[ORG_1]", "Firm"), ("t", "[ORG_1]", "Other")], "session_id string, token string, original_value string")
    stream = stream_queries.as_files(chunks, "k", str(tmp_path)).drop("k")
    stream_queries.stopped_once(lambda hook: streams.stream_answers(stream, lambda: known, str(tmp_path), None, hook), 1, "answers")
    log = CommittedTables(str(tmp_path))
    answers = sorted((r.stream_id, r.text) for r in log.read(spark, "answers", "stream_id string, text string").collect())
    assert answers == sorted((f"r{k}", f"answer {k} Firm") for k in range(12) if k % 3)
    audit = sorted((r.request_id, r.anonymized_content, r.error, r.n_chunks) for r in log.read(spark, "audit", streams.AUDIT).collect())
    assert audit == sorted((f"r{k}", f"answer {k} [ORG_1]" if k % 3 else f"answer {k} [ORbroken", None if k % 3 else "closed", 2) for k in range(12))


START = datetime(2024, 1, 1)


def _timed(spark, tmp_path, rows):
    """A stream of rows in files of arrival order; a last row of no key lets all times pass."""
    last = (len(rows), None, START + timedelta(days=9), 0)
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)] + [last], "arrived long, key string, ts timestamp, n int")
    return stream_queries.as_files(df, "arrived", str(tmp_path)).drop("arrived")


def _run(stream, tmp_path):
    stream.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start(f"{tmp_path}/out").awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{tmp_path}/out").where("key is not null")


def test_repeats_are_measured_from_the_one_kept_in_streams_too(spark, tmp_path):
    rng = random.Random(3)
    rows = [(f"k{rng.randrange(6)}", START + timedelta(seconds=20 * i + rng.randrange(-250, 250)), rng.randrange(3)) for i in range(400)]  # out of order, ties
    rows += [("one", START + timedelta(seconds=s), 1) for s in (8000, 8700, 9100)] + [("none", None, 5)]
    batch = restore.coalesce_duplicates(spark.createDataFrame(rows, "key string, ts timestamp, n int"), ["key"])
    stream = _timed(spark, tmp_path, rows)
    got = _run(restore.coalesce_duplicates(stream, ["key"], late=1200), tmp_path)
    as_rows = lambda df: sorted((r.key, str(r.ts), r.n) for r in df.collect())
    assert as_rows(got) == as_rows(batch)
    assert [r for r in as_rows(got) if r[0] == "one"] == [("one", str(START + timedelta(seconds=s)), 1) for s in (8000, 8700)]


def test_rows_behind_the_watermark_are_dropped(spark, tmp_path):
    rows = [("a", START + timedelta(hours=h), 1) for h in (1, 2, 3, 4)] + [("a", START, 7)]  # the last one is four hours late
    got = _run(restore.coalesce_duplicates(_timed(spark, tmp_path, rows), ["key"], late=60), tmp_path)
    assert sorted(r.n for r in got.collect()) == [1, 1, 1, 1]


def test_sessions_expire_and_keep_their_metadata(spark, tmp_path):
    rows = [("a", START + timedelta(hours=h), n) for h, n in ((0, 5), (1, 6), (23, 7), (24, 8), (30, 9), (60, 1))]
    got = _run(event_time.sessions(_timed(spark, tmp_path, rows), ["key"], "ts", 86400, 3600, "n").withColumn("x", F.lit(1)), tmp_path)
    assert sorted((str(r.created_at), r.requests, r.metadata) for r in got.collect()) == [(str(START), 3, "5"), (str(START + timedelta(hours=24)), 2, "8"), (str(START + timedelta(hours=60)), 1, "1")]


def test_batches_are_few_and_no_range_is_torn(spark, tmp_path):
    rows = spark.range(1000).selectExpr("CASE WHEN id < 990 THEN id ELSE 100000 * id END AS n", "id").unionByName(spark.sql("SELECT cast(null AS bigint) AS n, -1L AS id"))
    stream, seen = stream_queries.as_files(rows, "n", str(tmp_path)), []
    stream.writeStream.foreachBatch(lambda batch, k: seen.append(sorted(r.id for r in batch.collect()))).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    assert [i for batch in seen for i in batch] == list(range(-1, 1000)) and len(seen) == stream_queries.BATCHES
    assert max(map(len, seen)) < 300  # balanced, whatever the values


def test_no_event_is_late_whose_id_says_another_order(spark, tmp_path):
    events = spark.range(2000).selectExpr("id AS event_id", "id % 7 AS user_id", "'a' AS event_type", "timestamp'2024-01-01' + make_interval(0, 0, 0, 0, 0, 0, (2000 - id) * 600) AS ts")
    events.write.parquet(f"{tmp_path}/events.parquet")
    got = stream_queries._timed_events(spark, str(tmp_path), str(tmp_path), 3).drop("event_id")
    out = stream_queries._run(event_time.sessions(got, ["user_id"], "ts", 86400, 600), str(tmp_path)).where("user_id is not null")
    assert out.agg(F.sum("requests")).first()[0] == 2000


def test_keys_that_share_a_bucket_keep_apart(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(event_time, "BUCKETS", 1)
    rows = [(k, START + timedelta(seconds=100 * i), i) for i in range(60) for k in ("a", "b", None)]
    got = _run(restore.coalesce_duplicates(_timed(spark, tmp_path, rows), ["key"], late=1200).withColumn("x", F.lit(1)), tmp_path)
    assert sorted((r.key, r.n) for r in got.collect()) == sorted((k, n) for k in "ab" for n in range(0, 60, 6))
