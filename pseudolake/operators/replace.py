"""Replacement of spans by tokens, restoration of tokens, dictionary redaction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import catalog as cat
from ..functions import text as tx
from .detect import no_spans, span
from .dictionary import value_hits


def select_non_overlapping(spans: Column) -> Column:
    """The longest spans first, then the earlier; spans that overlap one chosen before go."""
    ordered = F.array_sort(F.transform(spans, lambda s, k: F.struct((s["start"] - s["end"]).alias("shorter"), s["start"].alias("start"), k.alias("k"), s.alias("s"))))

    def add(kept: Column, x: Column) -> Column:
        s = x["s"]
        return F.when(F.exists(kept, lambda o: (s["start"] < o["end"]) & (s["end"] > o["start"])), kept).otherwise(F.concat(kept, F.array(s)))

    return F.aggregate(ordered, no_spans(), add)


def collected(spans: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, spans): the spans of each text as an array in order of place."""
    item = span(F.col("start"), F.col("end"), F.col("value"), F.col("type"), F.col("confidence"))
    return spans.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("spans"))


def apply_tokens(texts: DataFrame, tokens: DataFrame, keys: list[str]) -> DataFrame:
    """texts (keys, text) with the spans of `tokens` (keys, start, end, token; apart) replaced; texts without stay."""
    lists = tokens.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("start", "end", "token"))).alias("cuts_"))
    joined = texts.join(lists, keys, "left")
    return joined.withColumn("text", F.when(F.col("cuts_").isNull(), F.col("text")).otherwise(tx.cut_out(F.col("text"), F.col("cuts_")))).drop("cuts_")


def find_tokens(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, start, end, token, type, n) of the placeholders in `text`."""
    found = df.select(*keys, F.inline(tx.matches(F.col("text"), cat.TOKEN)))
    return found.select(*keys, "start", "end", F.col("value").alias("token"), F.regexp_extract("value", cat.TOKEN, 1).alias("type"), F.regexp_extract("value", cat.TOKEN, 2).cast("long").alias("n"))


def deanonymize(texts: DataFrame, vault: DataFrame, keys: list[str]) -> DataFrame:
    """`texts` (keys, session_id, text) with the tokens the session's vault knows replaced by their values, in one pass."""
    found = find_tokens(texts, [*keys, "session_id"])
    known = found.join(vault.select("session_id", "token", "original_value"), ["session_id", "token"])
    return apply_tokens(texts, known.select(*keys, "start", "end", F.col("original_value").alias("token")), keys)


def deanonymize_subset(texts: DataFrame, vault: DataFrame, wanted: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Texts with only the `wanted` tokens (session_id, token) restored, and the wanted tokens that the vault doesn't know."""
    subset = vault.join(wanted.select("session_id", "token").distinct(), ["session_id", "token"], "left_semi")
    unknown = wanted.select("session_id", "token").distinct().join(vault, ["session_id", "token"], "left_anti")
    return deanonymize(texts, subset, keys), unknown


def replace_by_value(texts: DataFrame, values: DataFrame, keys: list[str], on: list[str]) -> DataFrame:
    """Exact values (case counts, not inside words, longest first) replaced by their tokens in one pass; see dictionary.value_hits."""
    return apply_tokens(texts, value_hits(texts, values, keys, on), keys)


def leaks(texts: DataFrame, vault: DataFrame) -> DataFrame:
    """(keys of `texts`, original_value): values of the session that still stand in a text as words of their own."""
    keys = [c for c in texts.columns if c != "text"]
    values = vault.select("session_id", F.col("original_value").alias("value"), F.col("original_value").alias("token"))
    return value_hits(texts, values, keys, ["session_id"]).select(*keys, F.col("token").alias("original_value")).distinct()

