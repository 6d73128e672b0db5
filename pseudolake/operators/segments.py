"""Texts of several parts: chat turns, document lines, multimodal content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx


#: Characters of a joined text in which spans and segments meet.
BUCKET = 4096


def segment_bounds(segments: DataFrame, key: str, order: str) -> DataFrame:
    """`segments` with seg_start and seg_end in the text joined by line ends (null texts count as empty)."""
    sized = segments.withColumn("size_", F.length(F.coalesce("text", F.lit(""))))  # so that the window carries texts only where they are asked for
    before = F.sum(F.col("size_") + 1).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    start = F.coalesce(before, F.lit(0).cast("long"))
    return sized.withColumn("seg_start", start).withColumn("seg_end", F.col("seg_start") + F.col("size_")).drop("size_")


def joined_text(segments: DataFrame, key: str, order: str) -> DataFrame:
    """(key, text): the segments in order, joined by line ends."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.coalesce("text", F.lit("")).alias("t"))))
    return segments.groupBy(key).agg(F.array_join(F.transform(parts, lambda p: p["t"]), "\n").alias("text"))


def split_by_segments(spans: DataFrame, segments: DataFrame, key: str, order: str) -> DataFrame:
    """Spans of joined texts in the places of their segments; a span over several is cut, at 0.8 of its confidence.

    Spans and segments meet by the stretches of BUCKET characters that both touch, once in the first of them, so that a
    text of many segments costs no pairs of all spans and segments. Blank parts go; a span that fits one segment is that
    segment's only.
    """

    def dealt(df: DataFrame, start: str, end: str, first: str) -> DataFrame:
        at = lambda place: F.floor(place / BUCKET).cast("long")
        df = df.withColumn(first, at(F.col(start)))
        return df.withColumn("bucket", F.explode(F.sequence(first, F.greatest(F.col(first), at(F.col(end) - 1)))))

    b = segment_bounds(segments.select(key, order, "text"), key, order).where("seg_end > seg_start").select(key, order, "seg_start", "seg_end")
    j = dealt(spans, "start", "end", "first_").join(dealt(b, "seg_start", "seg_end", "seg_first"), [key, "bucket"])
    j = j.where((F.col("start") < F.col("seg_end")) & (F.col("end") > F.col("seg_start")) & (F.col("bucket") == F.greatest("first_", "seg_first")))
    start, end = F.greatest("start", "seg_start"), F.least("end", "seg_end")
    whole = (F.col("start") >= F.col("seg_start")) & (F.col("end") <= F.col("seg_end"))
    local = (start - F.col("seg_start")).cast("int")
    confidence = F.col("confidence") * F.when(whole, 1.0).otherwise(0.8)
    out = j.select(key, order, local.alias("start"), (end - F.col("seg_start")).cast("int").alias("end"), "value", "type", confidence.alias("confidence"), whole.alias("whole"))
    texts = segments.select(F.col(key).alias("k_"), F.col(order).alias("o_"), F.col("text").alias("seg_text"))
    out = out.join(texts, (F.col(key) == F.col("k_")) & (F.col(order) == F.col("o_")) & ~F.col("whole"), "left").drop("k_", "o_")
    part = F.substring("seg_text", F.col("start") + 1, F.col("end") - F.col("start"))
    out = out.withColumn("value", F.when(F.col("whole"), F.col("value")).otherwise(part)).drop("seg_text")
    return out.where(F.col("whole") | (F.trim(F.regexp_replace("value", r"\s+", " ")) != "")).drop("whole")


def last_user_message(messages: DataFrame) -> DataFrame:
    """The last user turn with text of each conversation."""
    said = messages.where((F.col("role") == "user") & (F.trim(F.coalesce("text", F.lit(""))) != ""))
    return said.groupBy("conv_id").agg(F.max_by(F.struct("turn", "text"), F.col("turn")).alias("m")).select("conv_id", "m.turn", "m.text")


def render_conversation(messages: DataFrame, tool_calls: str | None = None) -> DataFrame:
    """(conv_id, markdown): a heading for each role, its text, its tool calls, apart by blank lines; empty parts go."""
    parts = [F.concat(F.lit("## "), F.coalesce("role", F.lit("?"))), F.coalesce("text", F.lit(""))]
    own = F.array(*parts)
    if tool_calls:
        said = F.transform(F.coalesce(F.col(tool_calls), F.array()), lambda c: F.concat(F.lit("> tool_call: "), c["name"], F.lit(" args="), c["arguments"]))
        own = F.concat(own, said)
    rows = messages.select("conv_id", "turn", own.alias("parts"))
    ordered = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("turn", "parts"))), lambda x: x["parts"]))
    return rows.groupBy("conv_id").agg(F.array_join(F.filter(ordered, lambda p: p != ""), "\n\n").alias("markdown"))


def text_parts(messages: DataFrame) -> DataFrame:
    """messages (conv_id, turn, parts array of struct type, text) -> rows (conv_id, turn, part, text) of the text parts."""
    rows = messages.select("conv_id", "turn", F.posexplode("parts").alias("part", "p"))
    return rows.where("p.type = 'text'").select("conv_id", "turn", "part", F.col("p.text").alias("text"))


def put_parts(messages: DataFrame, new: DataFrame) -> DataFrame:
    """`messages` with the text parts of `new` (conv_id, turn, part, text) in place; other parts and the order stay. Of repeated rows the least text counts."""
    new = new.groupBy("conv_id", "turn", "part").agg(F.min("text").alias("text"))
    lists = new.groupBy("conv_id", "turn").agg(F.map_from_entries(F.collect_list(F.struct("part", "text"))).alias("new_"))
    put = F.transform("parts", lambda p, k: F.when(F.col("new_").isNotNull() & F.map_contains_key("new_", k), p.withField("text", F.element_at("new_", k))).otherwise(p))
    return messages.join(lists, ["conv_id", "turn"], "left").withColumn("parts", F.when(F.col("parts").isNull(), F.col("parts")).otherwise(put)).drop("new_")


def file_blocks(messages: DataFrame, documents: DataFrame, keys: list[str], failed: str) -> DataFrame:
    """Bodies of <file_content path="..."> blocks that begin with `failed` replaced by the document's text of that path."""
    block = r"(?s)<file_content path=\"([^\"]*)\">\n?" + r"\Q" + failed + r"\E" + r".*?</file_content>"
    found = messages.select(*keys, F.inline(tx.matches(F.col("text"), block))).withColumn("path", tx.norm_path(F.regexp_extract("value", block, 1)))
    docs = documents.select(tx.norm_path(F.col("path")).alias("path"), F.col("text").alias("body"))
    put = found.join(docs, "path").withColumn("token", F.concat(F.regexp_extract("value", r"^<file_content[^>]*>", 0), F.lit("\n"), F.col("body"), F.lit("\n</file_content>")))
    from .replace import apply_tokens

    return apply_tokens(messages, put.select(*keys, "start", "end", "token"), keys)


def attached_documents(messages: DataFrame) -> DataFrame:
    """(conv_id, path, at): documents a conversation attaches, without those done, derived copies and lock files."""
    text = F.col("text")
    wanted = messages.select("conv_id", "turn", F.explode(F.concat(
        F.regexp_extract_all(text, F.lit(r"<file_content path=\"([^\"]+)\""), F.lit(1)),
        F.regexp_extract_all(text, F.lit(r"@file:(\S+)"), F.lit(1)),
    )).alias("raw"))
    paths = wanted.select("conv_id", "turn", tx.norm_path(F.col("raw")).alias("path")).where(F.col("path").rlike(r"\.(?:docx|xlsx|xml|txt|md)$") & ~F.col("path").rlike(r"\.(?:anonymized|result)\.[a-z]+$|(?:^|/)~\$"))
    done = messages.select("conv_id", F.explode(tx.markers(text, "done")).alias("raw")).select("conv_id", tx.norm_path(F.col("raw")).alias("path"))
    return paths.groupBy("conv_id", "path").agg(F.min("turn").alias("at")).join(done, ["conv_id", "path"], "left_anti")


def apply_segments(segments: DataFrame, edited: DataFrame, keys: list[str]) -> DataFrame:
    """`segments` with texts of `edited` where they differ; `changed` says where."""
    new = edited.select(*keys, F.col("text").alias("new_"))
    j = segments.join(new, keys, "left").withColumn("changed", F.coalesce(F.col("new_") != F.col("text"), F.lit(False)))
    return j.withColumn("text", F.when(F.col("changed"), F.col("new_")).otherwise(F.col("text"))).drop("new_")


def insert_lines(segments: DataFrame, key: str, order: str, anchors: DataFrame, lines: Column, after: bool = True) -> DataFrame:
    """New lines before or after the anchors (key, order): blank ones go; the rest is numbered anew."""
    new = anchors.select(key, order, F.posexplode(F.filter(lines, lambda x: F.trim(x) != "")).alias("k", "text")).withColumn("side", F.lit(1 if after else -1))
    all_ = segments.select(key, order, "text").withColumn("k", F.lit(0)).withColumn("side", F.lit(0)).unionByName(new)
    number = F.row_number().over(Window.partitionBy(key).orderBy(order, "side", "k")) - 1
    return all_.select(key, number.alias(order), "text")


def nth_occurrence(hits: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    return hits.withColumn("nth_", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("nth_") == n).drop("nth_")


def dump(segments: DataFrame, key: str, order: str, needle: str | None = None) -> DataFrame:
    text = joined_text(segments, key, order)
    return text if needle is None else text.select(key, F.array_join(tx.find_lines(F.col("text"), needle), "\n").alias("text")).where("text <> ''")


def empty_streams(chunks: DataFrame) -> DataFrame:
    """(stream_id, empty): whether a stream had neither visible content nor a tool call."""
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("channel") == "content", F.struct("seq", "text")))), lambda x: x["text"]), "")
    calls = F.bool_or(F.col("channel") != "content")
    return chunks.groupBy("stream_id").agg(((tx.strip_think(ordered) == "") & ~calls).alias("empty"))
