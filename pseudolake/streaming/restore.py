"""Streams: restoring tokens that are torn between chunks, duplicate requests."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .event_time import bucket, firsts

OUTPUT = "key_ string, seq long, text string, is_last boolean"


def safe_prefix(buffer: str) -> tuple[str, str]:
    """What may leave the buffer now, and what waits: from the last bracket on, if it is open."""
    at = buffer.rfind("[")
    return (buffer, "") if at < 0 or buffer.find("]", at) >= 0 else (buffer[:at], buffer[at:])


def regroup(chunks: DataFrame, idle: int | None = 600_000) -> DataFrame:
    """Chunks (stream_id, channel, seq, text, is_last) with brackets whole: a tail with an open bracket waits for its end.

    One buffer for each stream and channel; streams share the state of a bucket, as a call for each costs more than its
    chunks do. The end of a stream (is_last) or `idle` milliseconds without a chunk (None: only its end) empty its buffer.
    Restoring is a join with the vault afterwards, so that the state holds no values.
    """

    def step(_: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held: dict[str, list] = json.loads(state.get[0]) if state.exists else {}
        now = 0 if idle is None else state.getCurrentProcessingTimeMs()
        rows = []
        if not state.hasTimedOut:
            for c in pd.concat(list(frames)).sort_values("seq", kind="stable").itertuples(index=False):
                _, kept, _ = held.pop(c.key_, (0, "", 0))
                over = bool(c.is_last)
                out, kept = (kept + c.text, "") if over else safe_prefix(kept + c.text)
                if out or over:
                    rows.append((c.key_, int(c.seq), out, over))
                if not over:
                    held[c.key_] = [int(c.seq), kept, now + (idle or 0)]
        for key, (seq, kept, end) in list(held.items()):
            if idle is not None and end <= now:
                del held[key]
                if kept:
                    rows.append((key, seq, kept, True))
        if held:
            state.update((json.dumps(held),))
            if idle is not None:
                state.setTimeoutDuration(max(1, min(end for *_, end in held.values()) - now))
        elif state.exists:
            state.remove()
        if rows:
            yield pd.DataFrame(rows, columns=["key_", "seq", "text", "is_last"])

    keys = ["stream_id", "channel"]
    key = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}).alias("key_")
    rows = chunks.select(bucket(*keys), key, F.col("seq").cast("long"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("is_last", F.lit(False)).alias("is_last"))
    timeout = GroupStateTimeout.NoTimeout if idle is None else GroupStateTimeout.ProcessingTimeTimeout
    out = rows.groupBy("bucket_").applyInPandasWithState(step, OUTPUT, "kept string", "append", timeout)
    # a projection, as a shuffle can't follow the operator's columnar rows directly
    return out.withColumn("key_", F.from_json("key_", "stream_id string, channel string")).select("key_.*", "seq", "text", "is_last")


def restore_stream(chunks: DataFrame, vault: DataFrame, channels: tuple[str, ...] | None = None, idle: int | None = 600_000) -> DataFrame:
    """(stream_id, channel, seq, text, is_last): tokens of `vault` (stream_id, token, original_value) restored in the stream.

    With `channels` only those are restored (the content, say), the rest passes as it came. Of several values of one token
    in the vault the smallest counts.
    """
    vault = vault.where("token is not null").groupBy("stream_id", "token").agg(F.min("original_value").alias("original_value"))
    mapped = vault.groupBy("stream_id").agg(F.map_from_entries(F.collect_list(F.struct("token", "original_value"))).alias("m"))
    wanted = chunks if channels is None else chunks.where(F.col("channel").isin(*channels))
    joined = regroup(wanted, idle).join(mapped, "stream_id", "left")
    pieces = F.split("text", r"(?<=\])|(?=\[)")
    known = F.transform(pieces, lambda p: F.coalesce(F.try_element_at("m", p), p))
    out = joined.withColumn("text", F.when(F.col("m").isNull(), F.col("text")).otherwise(F.array_join(known, ""))).drop("m")
    return out if channels is None else out.unionByName(chunks.where(~F.col("channel").isin(*channels)).select("stream_id", "channel", "seq", "text", "is_last"))


def restore_all(chunks: DataFrame, vault: DataFrame, folder: str, channels: tuple[str, ...] | None = None) -> DataFrame:
    """Runs the stream over all files of chunks that lie in a shared folder, and returns what it wrote."""
    spark = chunks.sparkSession
    chunks.write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(chunks.schema).parquet(f"{folder}/in")
    out = restore_stream(stream, vault, channels, None).writeStream.format("parquet").option("checkpointLocation", f"{folder}/state")
    out.trigger(availableNow=True).start(f"{folder}/out").awaitTermination()
    return spark.read.parquet(f"{folder}/out")


def collected(chunks: DataFrame) -> DataFrame:
    """(stream_id, channel, text): the whole text of each channel of a finished stream."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"])
    return chunks.groupBy("stream_id", "channel").agg(F.array_join(ordered, "").alias("text"))


def coalesce_duplicates(requests: DataFrame, keys: list[str], time: str = "ts", seconds: int = 600, late: int = 600) -> DataFrame:
    """Requests without those that repeat one that was kept less than `seconds` before, by key.

    In a batch the rows of a key fall apart where `seconds` pass without one, and each such burst is folded by itself.
    Of several rows of one time the least stays. Rows without a time stay. A stream gives the same rows, once the
    watermark has passed them; rows that come more than `late` seconds behind the latest time seen are dropped.
    """
    if requests.isStreaming:
        return firsts(requests, keys, time, seconds, late)
    rest = [c for c in requests.columns if c not in {*keys, time}]
    by_time = Window.partitionBy(*keys).orderBy(time, *rest)
    span = F.make_interval(secs=F.lit(seconds))
    apart = F.when(F.col(time) < F.lag(time).over(by_time) + span, 0).otherwise(1)
    timed = requests.where(F.col(time).isNotNull()).withColumn("apart_", apart)
    timed = timed.withColumn("burst_", F.sum("apart_").over(by_time.rowsBetween(Window.unboundedPreceding, 0))).drop("apart_")
    item = F.struct(time, *rest)
    kind = timed.select(item.alias("r")).schema["r"].dataType.simpleString()
    none = F.array().cast(f"array<{kind}>")

    def add(kept: Column, r: Column) -> Column:
        repeats = (F.size(kept) > 0) & (r[time] < F.try_element_at(kept, F.lit(-1))[time] + span)
        return F.when(repeats, kept).otherwise(F.concat(kept, F.array(r)))

    lists = timed.groupBy(*keys, "burst_").agg(F.aggregate(F.array_sort(F.collect_list(item)), none, add).alias("kept_"))
    out = lists.select(*keys, F.inline("kept_")).select(requests.columns)
    return out.unionByName(requests.where(F.col(time).isNull()))
