"""Decisions on the rows of a key in the order of their event time, however they arrive."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Keys share the state of a bucket, as a call for each key costs more than its rows do; a bucket's keys are decided one by one.
BUCKETS = 1024
#: A row that waits: its time in microseconds and its other columns as JSON.
Row = tuple[int, str]
#: decide(memory, rows whose time has come, watermark) -> (output rows, memory, time to look again or None to forget the key)
Decide = Callable[[dict, list[Row], int], tuple[list[tuple], dict, int | None]]


def _order(row: Row) -> tuple:
    return row[0], tuple((v is not None, v) for v in json.loads(row[1]).values())


def _sorted(rows: list[Row]) -> list[Row]:
    return sorted(rows, key=_order if len({at for at, _ in rows}) < len(rows) else lambda row: row[0])


def bucket(*keys: str | Column) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int").alias("bucket_")


def in_order(requests: DataFrame, keys: list[str], time: str, seconds_late: int, decide: Decide, out: str) -> DataFrame:
    """(keys, out): what `decide` says of each key's rows, which wait until the watermark has passed them.

    Rows that come more than seconds_late behind the latest time seen are dropped. State is the keys' waiting rows and
    their memory, by bucket of keys; a key that is forgotten has none.
    """
    rest = [c for c in requests.columns if c not in {*keys, time}]
    whole = {"ignoreNullFields": "false"}
    packed = F.to_json(F.struct(*rest), whole) if rest else F.lit("{}")
    rows = requests.withWatermark(time, f"{seconds_late} seconds").select(bucket(*keys), F.to_json(F.struct(*keys), whole).alias("key_"), time, F.unix_micros(time).alias("at_"), packed.alias("row_"))
    names = ["key_"] + [c.strip().split()[0] for c in out.split(",")]

    def step(_: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held: dict[str, list] = json.loads(state.get[0]) if state.exists else {}
        if not state.hasTimedOut:
            for f in frames:
                for key, at, row in zip(f["key_"], f["at_"].tolist(), f["row_"]):
                    held.setdefault(key, [{}, []])[1].append((at, row))
        passed = max(0, state.getCurrentWatermarkMs()) * 1000
        rows, wakes = [], []
        for key, (memory, waiting) in list(held.items()):
            ready = _sorted([(at, row) for at, row in waiting if at <= passed])
            waiting = [(at, row) for at, row in waiting if at > passed]
            found, memory, again = decide(memory, ready, passed)
            rows += [(key, *r) for r in found]
            wake = min([at for at, _ in waiting] + ([again] if again is not None and again > passed else []), default=None)
            if wake is None:
                del held[key]
            else:
                held[key] = [memory, waiting]
                wakes.append(wake)
        if held:
            state.update((json.dumps(held),))
            state.setTimeoutTimestamp(min(wakes) // 1000 + 1)
        else:
            state.remove()
        if rows:
            yield pd.DataFrame(rows, columns=names)

    got = rows.groupBy("bucket_").applyInPandasWithState(step, f"key_ string, {out}", "kept string", "append", GroupStateTimeout.EventTimeTimeout)
    # a projection, as it has to follow the operator's columnar rows
    return got.withColumn("key_", F.from_json("key_", requests.select(*keys).schema)).select("key_.*", *names[1:])


def firsts(requests: DataFrame, keys: list[str], time: str, seconds: int, seconds_late: int) -> DataFrame:
    """A stream's requests without those less than `seconds` after one that was kept, by key."""
    span = seconds * 1_000_000

    def decide(memory: dict, ready: list[Row], passed: int) -> tuple[list[tuple], dict, int | None]:
        last, found = memory.get("last"), []
        for at, row in ready:
            if last is None or at >= last + span:
                found.append((at, row))
                last = at
        return found, {"last": last}, None if last is None else last + span

    rest = [c for c in requests.columns if c not in {*keys, time}]
    got = in_order(requests.where(F.col(time).isNotNull()), keys, time, seconds_late, decide, "at_ long, row_ string")
    got = got.withColumn(time, F.timestamp_micros("at_").cast(requests.schema[time].dataType))
    if rest:
        got = got.withColumn("row_", F.from_json("row_", requests.select(*rest).schema)).select(*keys, time, "row_.*")
    return got.select(requests.columns).unionByName(requests.where(F.col(time).isNull()))


def sessions(requests: DataFrame, keys: list[str], time: str, seconds: int, seconds_late: int, metadata: str | None = None) -> DataFrame:
    """(keys, created_at, expires_at, requests, metadata): a stream's sessions, each told when the watermark passes its end.

    A request opens a session of `seconds` unless its key has one that is open; the session keeps the metadata of the
    request that opened it. What has expired is dropped from the state, so a join with this result tells which
    mappings may go; audit rows and links don't depend on it.
    """
    span = seconds * 1_000_000

    def decide(memory: dict, ready: list[Row], passed: int) -> tuple[list[tuple], dict, int | None]:
        start, n, own, found = memory.get("start"), memory.get("n", 0), memory.get("own"), []
        for at, row in ready:
            if start is not None and at >= start + span:
                found.append((start, start + span, n, own))
                start = None
            if start is None:
                start, n, own = at, 0, next(iter(json.loads(row).values()), None)
            n += 1
        if start is not None and start + span <= passed:
            found.append((start, start + span, n, own))
            start = None
        return found, {"start": start, "n": n, "own": own} if start is not None else {}, None if start is None else start + span

    slim = requests.select(*keys, time, *([F.col(metadata).cast("string").alias("metadata_")] if metadata else []))
    got = in_order(slim.where(F.col(time).isNotNull()), keys, time, seconds_late, decide, "start_ long, end_ long, requests long, metadata string")
    return got.select(*keys, F.timestamp_micros("start_").alias("created_at"), F.timestamp_micros("end_").alias("expires_at"), "requests", "metadata")
