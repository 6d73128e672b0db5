"""Queries that run as streams over files of the given tables, stop in the middle, and go on."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..sources.shared import shared_folder
from ..streaming import event_time
from ..streaming.log import CommittedTables
from ..streaming.restore import coalesce_duplicates as coalesced
from . import streams
from .queries import EMAIL, FIRST, PHONE, TWO, query, seeded, table

#: Batches of a stream, and rows of a file of one, about; a batch of fewer rows still has a file for each core, of LEAST_ROWS at least.
BATCHES, FILE_ROWS, LEAST_ROWS = 4, 50_000, 100


class Stopped(Exception):
    """Stands for a driver that is lost between two writes."""


def as_files(rows: DataFrame, column: str, folder: str) -> DataFrame:
    """A stream of BATCHES ranges of a column (or SQL expression) of numbers in ascending order, null first, of about as many rows each.

    The number of batches doesn't grow with the table, as each has costs of its own; the number of files of a batch does,
    so that all cores write and read it. The table is read once for the bounds, once for their counts and once for each batch.
    """
    spark = rows.sparkSession
    bounds = rows.agg(F.percentile_approx(F.expr(column), [k / BATCHES for k in range(1, BATCHES)])).first()[0] or []
    place = sum((F.when(F.expr(column) > b, 1).otherwise(0) for b in sorted(set(bounds))), F.lit(0))
    counts = {r["place"]: r["count"] for r in rows.groupBy(place.alias("place")).count().collect()} or {0: 0}
    most = max(counts.values())
    files = max(1, -(-most // FILE_ROWS), min(spark.sparkContext.defaultParallelism, most // LEAST_ROWS))
    written = 0
    for k in sorted(counts):
        rows.where(place == k).repartition(files).write.mode("append").parquet(f"{folder}/in")
        written += files
        for _ in range(written - len(spark.read.schema(rows.schema).parquet(f"{folder}/in").inputFiles())):
            rows.limit(0).coalesce(1).write.mode("append").parquet(f"{folder}/in")  # a partition without rows has no file, but a batch is a number of files
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(f"{folder}/in")


def stopped_once(writer: Callable[[Callable[[int, str], None] | None], DataStreamWriter], batch: int, name: str) -> None:
    """Runs a stream until it is stopped after a write of one table of one batch, and then from its checkpoint to its end."""

    def stop(at: int, table: str) -> None:
        if (at, table) == (batch, name):
            raise Stopped

    try:
        writer(stop).trigger(availableNow=True).start().awaitTermination()
    except Exception as e:
        if "Stopped" not in str(e):
            raise
    writer(None).trigger(availableNow=True).start().awaitTermination()


@query(f"WITH {TWO}, {FIRST} SELECT * FROM vault")
def stream_anonymize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vault of a stream that is stopped between writing new values of its second batch and committing it."""
    folder = shared_folder(spark, "anonymized")
    stream = as_files(seeded(spark, sf_dir), "doc_id", folder)
    stopped_once(lambda hook: streams.stream_anonymize(stream, folder, (*EMAIL, *PHONE), on_written=hook), 1, "vault")
    return CommittedTables(folder).read(spark, "vault", streams.VAULT).drop("batch")


@query("""WITH a AS (SELECT conv_id || '-' || turn AS request_id, (conv_id + turn) % 10 = 3 AS failed, CASE WHEN (conv_id + turn) % 10 = 3 THEN substring(text, 1, CAST(length(text) // 2 AS INTEGER)) ELSE text || ' [ORG_1]' END AS text, text AS said, n_name
 FROM conversations JOIN nation ON n_nationkey = conv_id % 25 WHERE role = 'assistant')
SELECT request_id, 'answers' AS kind, said || ' ' || n_name AS text, NULL::VARCHAR AS error FROM a WHERE NOT failed
UNION ALL SELECT request_id, 'audit', text, CASE WHEN failed THEN 'upstream closed' END FROM a""")
def stream_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers and audit rows of streams in three chunks, some of which fail; stopped between the two tables of a batch."""
    c, n = table(spark, sf_dir, "conversations").where("role = 'assistant'"), table(spark, sf_dir, "nation")
    session = lambda x: F.concat(F.lit("n"), x.cast("string"))
    half = (F.length("text") / 2).cast("int")
    failed = (F.col("conv_id") + F.col("turn")) % 10 == 3
    chunk = lambda k, text, last, error: F.struct(F.lit(k).cast("long").alias("seq"), text.alias("text"), F.lit(last).alias("is_last"), error.cast("string").alias("error"))
    none = F.lit(None)
    parts = F.when(failed, F.array(chunk(0, F.substring("text", F.lit(1), half), False, none), chunk(1, none.cast("string"), False, F.lit("upstream closed")))).otherwise(
        F.array(chunk(0, F.substring("text", F.lit(1), half), False, none), chunk(1, F.concat(F.substring("text", half + 1, F.length("text")), F.lit(" [OR")), False, none), chunk(2, F.lit("G_1]"), True, none))
    )
    rows = c.select("conv_id", F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("stream_id"), session(F.col("conv_id") % 25).alias("session_id"), F.inline(parts))
    known = n.select(session(F.col("n_nationkey")).alias("session_id"), F.lit("[ORG_1]").alias("token"), F.col("n_name").alias("original_value"))
    folder = shared_folder(spark, "answers")
    stream = as_files(rows.join(n, F.col("n_nationkey") == F.col("conv_id") % 25, "left_semi"), "conv_id", folder).drop("conv_id")
    stopped_once(lambda hook: streams.stream_answers(stream, lambda: known, folder, None, hook), 1, "answers")
    log = CommittedTables(folder)
    answers = log.read(spark, "answers", "stream_id string, session_id string, text string").select(F.col("stream_id").alias("request_id"), F.lit("answers").alias("kind"), "text", F.lit(None).cast("string").alias("error"))
    return answers.unionByName(log.read(spark, "audit", streams.AUDIT).select("request_id", F.lit("audit").alias("kind"), F.col("anonymized_content").alias("text"), "error"))


def _timed_events(spark: SparkSession, sf_dir: str, folder: str, far_days: int) -> DataFrame:
    """A stream of events in order of their times, and of one later row of no user, by which all other times have passed.

    Events arrive by time and not by id, so that none is late, whatever ids a table gives its events.
    """
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    end = e.agg((F.max("event_id") + 1).alias("event_id"), (F.max("ts") + F.make_interval(days=F.lit(far_days))).alias("ts"))
    end = end.where("event_id is not null").select("event_id", F.lit(None).cast("long").alias("user_id"), F.lit(None).cast("string").alias("event_type"), "ts")
    return as_files(e.unionByName(end), "unix_micros(ts)", folder)


def _run(stream: DataFrame, folder: str) -> DataFrame:
    out = stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
    out.start(f"{folder}/out").awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")


FIRSTS = """WITH RECURSIVE e AS (SELECT DISTINCT user_id, event_type, CAST(ts AS TIMESTAMP) AS ts FROM events),
k AS (SELECT user_id, event_type, min(ts) AS ts FROM e GROUP BY user_id, event_type
 UNION ALL SELECT k.user_id, k.event_type, min(e.ts) FROM k JOIN e ON e.user_id = k.user_id AND e.event_type = k.event_type AND e.ts >= k.ts + INTERVAL 86400 SECONDS GROUP BY k.user_id, k.event_type)"""


@query(f"{FIRSTS} SELECT user_id, event_type, ts FROM k")
def stream_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeats within a day of the event kept, by user and type, in a stream."""
    folder = shared_folder(spark, "coalesced")
    events = _timed_events(spark, sf_dir, folder, 3).drop("event_id")
    got = _run(coalesced(events, ["user_id", "event_type"], seconds=86400), folder)
    return got.where("user_id is not null").select("user_id", "event_type", F.col("ts").cast("timestamp_ntz").alias("ts"))


@query("""WITH RECURSIVE e AS (SELECT user_id, CAST(ts AS TIMESTAMP) AS ts, event_type FROM events),
k AS (SELECT user_id, min(ts) AS ts FROM e GROUP BY user_id
 UNION ALL SELECT k.user_id, min(e.ts) FROM k JOIN e ON e.user_id = k.user_id AND e.ts >= k.ts + INTERVAL 24 HOURS GROUP BY k.user_id)
SELECT k.user_id, k.ts AS created_at, k.ts + INTERVAL 24 HOURS AS expires_at, count(*) AS requests, min(e.event_type) FILTER (e.ts = k.ts) AS metadata
FROM k JOIN e ON e.user_id = k.user_id AND e.ts >= k.ts AND e.ts < k.ts + INTERVAL 24 HOURS GROUP BY k.user_id, k.ts""")
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of a day each, with the type of the event that opened them, in a stream."""
    folder = shared_folder(spark, "sessions")
    events = _timed_events(spark, sf_dir, folder, 3).drop("event_id")
    got = _run(event_time.sessions(events, ["user_id"], "ts", 86400, 600, "event_type"), folder)
    ntz = lambda c: F.col(c).cast("timestamp_ntz").alias(c)
    return got.where("user_id is not null").select("user_id", ntz("created_at"), ntz("expires_at"), "requests", "metadata")
