"""End-to-end jobs: anonymise texts, documents of segments and conversations; restore; redact; check."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import catalog as cat
from ..functions import json_text as js
from ..operators import detect, dictionary, replace, segments, vault
from ..sources.shared import kept


def empty_vault(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([], "session_id string, token string, original_value string, entity_type string")


def anonymize_texts(
    docs: DataFrame, known: DataFrame | None = None, catalog: Iterable[cat.Pattern] = cat.CATALOG, expand: bool = False, model: DataFrame | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """docs (doc_id, session_id, text) -> texts with tokens, new vault rows, spans. Null texts stay null.

    Spans and new vault rows are narrow tables, written once; texts are read once for the spans and once for the result.
    With a model the texts have a column `failed`; a text on which the model failed is withheld: its text is null.
    """
    known = empty_vault(docs) if known is None else known
    found = detect.detect(docs, catalog, model, expand)
    if model is not None:
        broken = found.where("failed").select("doc_id", "failed")
        found = found.where("not failed").drop("failed")
        docs = docs.join(broken, "doc_id", "left").withColumn("failed", F.coalesce("failed", F.lit(False)))
        docs = docs.withColumn("text", F.when(~F.col("failed"), F.col("text")))
    found = found.join(docs.select("doc_id", "session_id"), "doc_id")
    chosen = replace.collected(found, ["doc_id", "session_id"])
    spans = kept(chosen.select("doc_id", "session_id", F.inline(replace.select_non_overlapping(F.col("spans")))), "spans")
    new = kept(vault.assign_tokens(spans, known, ["doc_id"]), "new")
    tokens = vault.tokens_of(spans, known.select(new.columns).unionByName(new), ["doc_id"])
    return replace.apply_tokens(docs, tokens, ["doc_id"]), new, spans


def _segment_tokens(
    parts: DataFrame, key: str, order: str, known: DataFrame | None, catalog: Iterable[cat.Pattern], expand: bool
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(key, order, start, end, token) of parts of a text, new vault rows, spans."""
    known = empty_vault(parts) if known is None else known
    whole = segments.joined_text(parts, key, order).withColumnRenamed(key, "doc_id")
    whole = kept(whole, "joined") if expand else whole  # read again for the places of what was found
    found = detect.detect(whole, catalog, None, expand).withColumnRenamed("doc_id", key)
    local = segments.split_by_segments(found, parts, key, order)
    keys = [key, order]
    chosen = replace.collected(local, keys).select(*keys, F.inline(replace.select_non_overlapping(F.col("spans"))))
    chosen = kept(chosen.join(parts.select(*keys, "session_id"), keys), "spans")
    new = kept(vault.assign_tokens(chosen, known, keys), "new")
    return vault.tokens_of(chosen, known.select(new.columns).unionByName(new), keys), new, chosen


def anonymize_segments(
    parts: DataFrame, key: str, order: str, known: DataFrame | None = None, catalog: Iterable[cat.Pattern] = cat.CATALOG, expand: bool = True
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """parts (key, order, session_id, text): found in the joined text, replaced part by part, so that each part stays a part."""
    tokens, new, chosen = _segment_tokens(parts, key, order, known, catalog, expand)
    return replace.apply_tokens(parts, tokens, [key, order]), new, chosen


def anonymize_messages(
    messages: DataFrame, known: DataFrame | None = None, catalog: Iterable[cat.Pattern] = cat.CATALOG, expand: bool = True, untouched: str = r"^file:"
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """messages (conv_id, turn, session_id, text, tool_calls array of struct with `arguments`): texts and the strings inside arguments.

    All of a conversation is searched as one text. In arguments that are JSON the values of strings are replaced, at any
    depth and whatever their escapes; keys, numbers, values that match `untouched` and all other characters stay, so that
    they are JSON as before. Other arguments are replaced as texts. Null texts and arguments stay null. conv_id and turn
    name a message.
    """
    calls = messages.select("conv_id", "turn", "session_id", F.posexplode("tool_calls").alias("call", "c"))
    strings = calls.where("c.arguments is not null").select("conv_id", "turn", "session_id", "call", F.posexplode(js.strings(F.col("c.arguments"))).alias("k", "s"))
    place = lambda call, k: F.struct(F.col("turn").cast("long").alias("turn"), call.cast("int").alias("call"), k.cast("int").alias("k")).alias("place")
    args = strings.where("not s.key").select("conv_id", place(F.col("call"), F.col("k")), "session_id", js.said(F.col("s.units")).alias("text"), "s.start", "s.units")
    args = kept(args.where(~F.col("text").rlike(untouched)), "arguments")
    texts = messages.select("conv_id", place(F.lit(-1), F.lit(0)), "session_id", "text")
    tokens, new, chosen = _segment_tokens(texts.unionByName(args.select(texts.columns)), "conv_id", "place", known, catalog, expand)

    own = tokens.where("place.call = -1").select("conv_id", F.col("place.turn").alias("turn"), "start", "end", "token")
    raw = lambda at, end: (F.col("base") + js.raw_place(F.col("units"), F.col(at), end)).cast("int").alias(at)
    inside = tokens.join(args.select("conv_id", "place", F.col("start").alias("base"), "units"), ["conv_id", "place"])
    inside = inside.select("conv_id", F.col("place.turn").alias("turn"), F.col("place.call").alias("call"), raw("start", False), raw("end", True), "token")
    put = replace.apply_tokens(calls.withColumn("text", F.col("c.arguments")), inside, ["conv_id", "turn", "call"])
    lists = put.groupBy("conv_id", "turn").agg(F.array_sort(F.collect_list(F.struct("call", F.col("c").withField("arguments", F.col("text")).alias("c")))).alias("calls_"))
    done = replace.apply_tokens(messages, own, ["conv_id", "turn"]).join(lists, ["conv_id", "turn"], "left")
    return done.withColumn("tool_calls", F.coalesce(F.transform("calls_", lambda x: x["c"]), "tool_calls")).drop("calls_"), new, chosen


def restore_arguments(calls: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """calls (keys, session_id, text: arguments): tokens restored; inside JSON a value is escaped, so that it stays JSON."""
    found = replace.find_tokens(calls, [*keys, "session_id"]).join(known.select("session_id", "token", "original_value"), ["session_id", "token"])
    put = found.join(calls.select(*keys, js.is_json(F.col("text")).alias("json")), keys)
    value = F.when(F.coalesce("json", F.lit(False)), js.escaped(F.col("original_value"))).otherwise(F.col("original_value"))
    return replace.apply_tokens(calls, put.select(*keys, "start", "end", value.alias("token")), keys)


def restore(texts: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    return replace.deanonymize(texts, known, keys)


def restore_answers(answers: DataFrame, known: DataFrame, full: bool = True) -> DataFrame:
    """answers (conv_id, turn, channel, session_id, text): all channels restored, or the content only; tool arguments then keep tokens."""
    keys = ["conv_id", "turn", "channel"]
    if full:
        return replace.deanonymize(answers, known, keys)
    own = F.col("channel") == "content"
    return replace.deanonymize(answers.where(own), known, keys).unionByName(answers.where(~own))


def extra_redact(texts: DataFrame, names: DataFrame | list[str], known: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """texts (keys, session_id, text): the user's own values replaced; new vault rows; (value, found) for each value asked for.

    names: a table (seq, value) of any size, or a list; a smaller seq goes first where spans overlap.
    """
    if isinstance(names, list):
        names = texts.sparkSession.createDataFrame(list(enumerate(names)), "seq long, value string")
    found = kept(dictionary.redactions(texts, names, keys).join(texts.select(*keys, "session_id"), keys), "redactions")
    new = vault.assign_tokens(found, known, keys)
    tokens = vault.tokens_of(found, known.select(new.columns).unionByName(new), keys)
    plain = F.lower(F.regexp_replace("value", "[ \\u00A0,.]", ""))
    report = names.withColumn("k", plain).join(found.select(plain.alias("k"), F.lit(True).alias("found")).distinct(), "k", "left")
    return replace.apply_tokens(texts, tokens, keys), new, report.select("value", F.coalesce("found", F.lit(False)).alias("found"))


def audit_rows(texts: DataFrame, spans: DataFrame, kind: str) -> DataFrame:
    """(session_id, request_type, doc_id, anonymized_content, entities_found) to append to the audit table."""
    lists = spans.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", "type"))).alias("entities_found"))
    return texts.join(lists, "doc_id", "left").select("session_id", F.lit(kind).alias("request_type"), "doc_id", F.col("text").alias("anonymized_content"), "entities_found")
