"""Streaming jobs: anonymising with a vault that grows, and answers with their audit rows."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import catalog as cat
from ..operators import replace
from ..sources.shared import kept
from ..streaming.log import CommittedTables
from . import jobs

VAULT = "session_id string, token string, original_value string, entity_type string"
FINISHED = "stream_id string, session_id string, text string, n_chunks long, error string"
AUDIT = "session_id string, request_type string, request_id string, anonymized_content string, n_chunks long, error string"
Written = Callable[[int, str], None]


def stream_anonymize(
    docs: DataFrame, folder: str, catalog: Iterable[cat.Pattern] = cat.CATALOG, expand: bool = False, on_written: Written | None = None
) -> DataStreamWriter:
    """docs: a stream (doc_id, session_id, text). The tables `texts` and `vault` of CommittedTables(folder) grow by a batch at a time.

    A batch sees the vault as the batches before it have left it, and numbers its new values after them. A batch that
    didn't commit leaves nothing that counts, and gives the same tokens when it runs again.
    """
    log = CommittedTables(folder)

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        known = log.read(spark, "vault", VAULT, batch_id).drop("batch")
        texts, new, _ = jobs.anonymize_texts(batch.select("doc_id", "session_id", "text"), known, catalog, expand)
        log.write(spark, batch_id, {"vault": new, "texts": texts}, on_written)

    return docs.writeStream.foreachBatch(step).option("checkpointLocation", f"{folder}/state")


def finished(chunks: DataFrame, idle: int | None = 600_000) -> DataFrame:
    """chunks (stream_id, session_id, seq, text, is_last, error) -> FINISHED: one row for each stream that has ended.

    A stream ends with its last chunk, with a chunk that has an error, or after `idle` milliseconds without a chunk
    (None: never), which is an error too. Chunks of a stream arrive in order of seq; what follows its end is a stream of its own.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        text, n = state.get if state.exists else ("", 0)
        rows = []
        if state.hasTimedOut:
            rows.append((*key, text, n, "no end"))
            n = 0
        else:
            for c in pd.concat(list(frames)).sort_values("seq").itertuples(index=False):
                text, n = text + (c.text or ""), n + 1
                if c.is_last or c.error is not None:
                    rows.append((*key, text, n, c.error))
                    text, n = "", 0
        if n:
            state.update((text, n))
            if idle is not None:
                state.setTimeoutDuration(idle)
        elif state.exists:
            state.remove()
        yield pd.DataFrame(rows, columns=["stream_id", "session_id", "text", "n_chunks", "error"])

    rows = chunks.select("stream_id", "session_id", F.col("seq").cast("long"), "text", F.coalesce("is_last", F.lit(False)).alias("is_last"), "error")
    timeout = GroupStateTimeout.NoTimeout if idle is None else GroupStateTimeout.ProcessingTimeTimeout
    got = rows.groupBy("stream_id", "session_id").applyInPandasWithState(step, FINISHED, "text string, n long", "append", timeout)
    return got.withColumn("text", F.concat("text", F.lit("")))  # a projection has to follow the operator's columnar rows


def stream_answers(chunks: DataFrame, vault: Callable[[], DataFrame], folder: str, idle: int | None = 600_000, on_written: Written | None = None) -> DataStreamWriter:
    """Streams that have ended go to two tables of CommittedTables(folder): `answers` (stream_id, session_id, text) with their
    tokens restored, and `audit` with one row for each, failed ones with their error and what had come.

    vault() is read anew for each batch. Only tokens that stand in an answer meet the vault.
    """
    log = CommittedTables(folder)

    def step(batch: DataFrame, batch_id: int) -> None:
        ended = kept(batch, "ended")
        answers = replace.deanonymize(ended.where("error is null").select("stream_id", "session_id", "text"), vault(), ["stream_id"])
        audit = ended.select("session_id", F.lit("answer").alias("request_type"), F.col("stream_id").alias("request_id"), F.col("text").alias("anonymized_content"), "n_chunks", "error")
        log.write(batch.sparkSession, batch_id, {"answers": answers, "audit": audit}, on_written)

    return finished(chunks, idle).writeStream.foreachBatch(step).option("checkpointLocation", f"{folder}/state")
