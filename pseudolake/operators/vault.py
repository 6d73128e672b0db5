"""Sessions, the token vault, audit and document links, as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import catalog as cat
from .numbering import numbered


def next_counter(vault: DataFrame) -> DataFrame:
    """(session_id, last): the largest token number of each session."""
    return vault.groupBy("session_id").agg(F.max(F.coalesce(F.regexp_extract("token", r"_(\d+)\]$", 1).try_cast("long"), F.lit(0))).alias("last"))


def first_mentions(spans: DataFrame, order: list[str]) -> DataFrame:
    """(session_id, original_value, entity_type, at): each value once, with the type of its first mention.

    Mentions are ordered by the columns `order`, then by place downwards: texts are replaced from their end. The
    minimum is taken before any shuffle by session, so that a session of many mentions costs its distinct values only.
    """
    at = F.struct(*order, (-F.col("start")).alias("back"), F.col("type"))
    first = spans.groupBy("session_id", F.col("value").alias("original_value")).agg(F.min(at).alias("at"))
    return first.select("session_id", "original_value", F.col("at.type").alias("entity_type"), "at")


def assign_tokens(spans: DataFrame, vault: DataFrame, order: list[str], allocator: str = "counter") -> DataFrame:
    """New vault rows (session_id, token, original_value, entity_type) for values that the vault doesn't have.

    counter: numbers go on from the session's largest, one counter for all types, in order of first mention.
    per_type: the same for each type of a session. hash: 62-bit numbers from the value's hash, in no order; values of a
    session whose numbers clash with each other, or with the vault, get others (a window over the clashing ones only).
    """
    first = first_mentions(spans, order).join(vault.select("session_id", "original_value"), ["session_id", "original_value"], "left_anti")
    if allocator == "hash":
        number = lambda *more: F.pmod(F.xxhash64("original_value", *more), F.lit(1 << 62))
        taken = vault.select("session_id", F.regexp_extract("token", r"_(\d+)\]$", 1).try_cast("long").alias("hashed"), F.lit(True).alias("taken")).where("hashed is not null").distinct()
        first = first.withColumn("hashed", number()).join(taken, ["session_id", "hashed"], "left")
        again = F.row_number().over(Window.partitionBy("session_id", "hashed").orderBy("original_value")) + F.when(F.col("taken"), 1).otherwise(0)
        first = first.withColumn("again", again)
        n = F.when(F.col("again") == 1, F.col("hashed")).otherwise(number(F.col("again")))
    else:
        keys = ["session_id"] + (["entity_type"] if allocator == "per_type" else [])
        row = F.row_number().over(Window.partitionBy(*keys).orderBy("at", "original_value"))
        first = first.join(next_counter(vault), "session_id", "left")
        n = row + F.coalesce("last", F.lit(0).cast("long"))
    return first.select("session_id", F.concat(F.lit("["), F.col("entity_type"), F.lit("_"), n.cast("string"), F.lit("]")).alias("token"), "original_value", "entity_type")


def assign_tokens_globally(spans: DataFrame, order: list[str]) -> DataFrame:
    """One session for everything: numbers by a range-partitioned sort and the sizes of the partitions before, no single-task window."""
    first = first_mentions(spans.withColumn("session_id", F.lit("all")), order)
    return numbered(first, ["at", "original_value"], "n").select("session_id", F.concat(F.lit("["), F.col("entity_type"), F.lit("_"), F.col("n").cast("string"), F.lit("]")).alias("token"), "original_value", "entity_type")


def merge_vault(vault: DataFrame, new: DataFrame) -> DataFrame:
    """The vault with rows for values it doesn't have; of equal new values one stays."""
    fresh = new.dropDuplicates(["session_id", "original_value"]).join(vault, ["session_id", "original_value"], "left_anti")
    return vault.unionByName(fresh.select(vault.columns))


def tokens_of(spans: DataFrame, vault: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, start, end, token) of spans whose value the session's vault has."""
    known = vault.select("session_id", F.col("original_value").alias("value"), "token")
    return spans.join(known, ["session_id", "value"]).select(*keys, "start", "end", "token")


def open_sessions(requests: DataFrame, sessions: DataFrame, now: Column) -> DataFrame:
    """requests (request_id, session_id): a live session is used again, else one opens: (request_id, session_id, is_new, expires_at)."""
    live = sessions.where(F.col("expires_at") > now).select("session_id", F.col("expires_at").alias("until"))
    joined = requests.join(live, "session_id", "left")
    fresh = F.sha2(F.concat_ws(":", "request_id", "session_id"), 256)
    name = F.when(F.col("until").isNotNull(), F.col("session_id")).otherwise(F.substring(fresh, 1, 32))
    until = F.coalesce("until", now + F.expr(f"interval {cat.TTL_HOURS} hours"))
    return joined.select("request_id", name.alias("session_id"), F.col("until").isNull().alias("is_new"), until.alias("expires_at"))


def live_sessions(sessions: DataFrame, now: Column) -> DataFrame:
    return sessions.where(F.col("expires_at") > now)


def expire(sessions: DataFrame, vault: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Sessions and vault without what has expired; audit rows and document links stay as they are."""
    dead = sessions.where(F.col("expires_at") < now).select("session_id")
    return sessions.join(dead, "session_id", "left_anti"), vault.join(dead, "session_id", "left_anti")


def session_summary(sessions: DataFrame, vault: DataFrame, now: Column) -> DataFrame:
    """Live sessions with their number of mappings."""
    counts = vault.groupBy("session_id").agg(F.count("*").alias("mappings"))
    live = live_sessions(sessions, now).join(counts, "session_id", "left")
    return live.select("session_id", "created_at", "expires_at", F.coalesce("mappings", F.lit(0).cast("long")).alias("mappings"))


def sessions_with_tokens(vault: DataFrame, wanted: DataFrame) -> DataFrame:
    """(session_id, found, created_at): sessions that own any of the `wanted` tokens."""
    own = vault.join(wanted.select("token").distinct(), "token", "left_semi")
    return own.groupBy("session_id").agg(F.countDistinct("token").alias("found"), F.max("created_at").alias("created_at"))


def latest_session(links: DataFrame) -> DataFrame:
    """(doc_key, session_id): the newest link of each document."""
    return links.groupBy("doc_key").agg(F.max_by("session_id", F.struct("created_at", "seq")).alias("session_id"))


def link_documents(links: DataFrame, new: DataFrame) -> DataFrame:
    """New links (doc_key, session_id, ...) that aren't there yet, each pair once."""
    return new.dropDuplicates(["doc_key", "session_id"]).join(links, ["doc_key", "session_id"], "left_anti")


def discover_targets(vault: DataFrame, links: DataFrame, wanted: DataFrame) -> DataFrame:
    """(session_id, doc): the document of each session with a wanted token; a result goes before its copy, a copy before others."""
    own = sessions_with_tokens(vault, wanted).select("session_id")
    rank = F.when(F.col("doc_key").rlike(r"(?i)\.result\.[a-z0-9]+$"), 0).when(F.col("doc_key").rlike(r"(?i)\.anonymized\.[a-z0-9]+$"), 1).otherwise(2)
    stem = F.regexp_replace("doc_key", r"(?i)\.(?:result|anonymized)(\.[a-z0-9]+)$", "$1")
    return links.join(own, "session_id", "left_semi").groupBy("session_id", stem.alias("stem")).agg(F.min_by("doc_key", F.struct(rank, "doc_key")).alias("doc"))


def merge_history(mentions: DataFrame, vault: DataFrame) -> DataFrame:
    """mentions (conv_id, turn, session_id): the mappings of all sessions of a conversation; of one token the later session's."""
    last = mentions.groupBy("conv_id", "session_id").agg(F.max("turn").alias("turn"))
    rows = last.join(vault.select("session_id", "token", "original_value"), "session_id")
    return rows.groupBy("conv_id", "token").agg(F.max_by("original_value", F.struct("turn", "session_id")).alias("original_value"))


def recent_audit(audit: DataFrame, session_id: str | None = None, limit: int = 100) -> DataFrame:
    rows = audit if session_id is None else audit.where(F.col("session_id") == session_id)
    return rows.orderBy(F.desc("ts"), F.desc("request_id")).limit(limit)


def entity_counts(spans: DataFrame, keys: list[str]) -> DataFrame:
    return spans.groupBy(*keys, "type").agg(F.count("*").alias("entities"), F.countDistinct("value").alias("mappings"))


def batch_status(results: DataFrame, key: str) -> DataFrame:
    """results (key, error, found): failed, partial, ok, or nothing found, by batch."""
    bad, n = F.sum(F.when(F.col("error").isNotNull(), 1).otherwise(0)), F.count("*")
    got = F.sum(F.when(F.col("error").isNull(), F.coalesce("found", F.lit(0))).otherwise(0))
    status = F.when(bad == n, "failed").when(bad > 0, "partial").when(got == 0, "nothing found").otherwise("ok")
    return results.groupBy(key).agg(status.alias("status"), n.alias("files"), bad.alias("errors"), got.cast("long").alias("found"))


def cache_misses(texts: DataFrame, cache: DataFrame) -> DataFrame:
    """(key, text): distinct texts whose hash isn't cached: what a model has to see."""
    keyed = texts.where("text is not null").select(F.sha2("text", 256).alias("key"), "text").groupBy("key").agg(F.first("text").alias("text"))
    return keyed.join(cache.select("key"), "key", "left_anti")


def reusable(documents: DataFrame, manifest: DataFrame, version: str, slack_seconds: int = 1) -> DataFrame:
    """documents (batch, doc_key, modified): whether the copy in `manifest` (doc_key, made, version) may stand.

    It may if it is newer than the source by more than the slack and of this version; a batch of both kinds is redone.
    """
    j = documents.join(manifest, "doc_key", "left")
    good = F.coalesce((F.col("made") > F.col("modified") + F.expr(f"interval {slack_seconds} seconds")) & (F.col("version") == version), F.lit(False))
    every = j.withColumn("good", good).groupBy("batch").agg(F.bool_and("good").alias("all_good"))
    return j.withColumn("good", good).join(every, "batch").select("batch", "doc_key", "good", (F.col("good") & F.col("all_good")).alias("reuse"))


def classify_by_labels(scores: DataFrame, floor: float = 0.05, margin: float = 1.3) -> DataFrame:
    """scores (id, label, score): the best label of each id, null if it is under the floor or near the runner-up."""
    best = scores.groupBy("id", "label").agg(F.max("score").alias("score"))
    w = Window.partitionBy("id").orderBy(F.desc("score"), "label")
    top = best.withColumn("r", F.row_number().over(w)).withColumn("second", F.lead("score").over(w)).where("r = 1")
    sure = (F.col("score") >= floor) & (F.col("second").isNull() | (F.col("score") >= F.col("second") * margin))
    return top.select("id", F.when(sure, F.col("label")).alias("label"), "score")
