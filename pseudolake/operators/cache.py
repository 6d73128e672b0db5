"""Results of a model kept by the content of a text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..sources.shared import kept
from .detect import Predictor, model_spans, no_spans, span
from .numbering import numbered
from .vault import cache_misses

#: seq numbers the entries in the order in which they were stored, without gaps.
CACHE = f"key string, seq long, spans {tx.SPAN}"


def empty_cache(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], CACHE)


def cached_spans(docs: DataFrame, cache: DataFrame, load: Callable[[], Predictor], limit: int = 1_000_000, **how) -> tuple[DataFrame, DataFrame, DataFrame]:
    """docs (doc_id, text) -> (doc_id, spans, failed), the cache after this run, and the texts (key, text) the model saw.

    Each distinct text that isn't cached is shown to the model once. Results are stored in the order of each text's
    smallest doc_id, those of failures never; of more than `limit` entries the ones stored first go. A text on which the
    model failed has failed = true and no spans; null texts have no spans.
    """
    keyed = docs.select("doc_id", F.sha2("text", 256).alias("key"))
    misses = kept(cache_misses(docs, cache), "misses")
    found = model_spans(misses.select(F.col("key").alias("doc_id"), "text"), load, **how)
    item = span(F.col("start"), F.col("end"), F.col("value"), F.col("type"), F.col("confidence"))
    per = found.groupBy(F.col("doc_id").alias("key")).agg(F.array_sort(F.collect_list(F.when(~F.col("failed"), item))).alias("spans"), F.bool_or("failed").alias("failed"))
    seen = misses.select("key").join(per, "key", "left")
    seen = kept(seen.select("key", F.when(F.col("failed"), no_spans()).otherwise(F.coalesce("spans", no_spans())).alias("spans"), F.coalesce("failed", F.lit(False)).alias("failed")), "seen")

    results = cache.select("key", "spans", F.lit(False).alias("failed")).unionByName(seen)
    out = keyed.join(results, "key", "left").select("doc_id", F.coalesce("spans", no_spans()).alias("spans"), F.coalesce("failed", F.lit(False)).alias("failed"))

    first = keyed.groupBy("key").agg(F.min("doc_id").alias("first_"))
    fresh = numbered(seen.where("not failed").join(first, "key"), ["first_", "key"], "n_")
    last = cache.agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0]
    stored = cache.select("key", "seq", "spans").unionByName(fresh.select("key", (F.col("n_") + last).alias("seq"), "spans"))
    end = last + fresh.count()
    return out, kept(stored.where(F.col("seq") > end - limit), "cache"), misses
