"""Metadata of documents as maps: names of people become tokens, other traces are blanked or dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import kept
from . import vault

AUTHORS = ("comment_author", "reviewer")
BLANK = ("author", "modified_by", "comments", "subject", "keywords", "category")
DROP = ("company", "manager", "links")


def scrub_authors(
    docs: DataFrame, known: DataFrame, authors: tuple[str, ...] = AUTHORS, blank: tuple[str, ...] = BLANK, drop: tuple[str, ...] = DROP
) -> tuple[DataFrame, DataFrame]:
    """docs (doc_id, session_id, metadata map<string,string>) -> docs with their metadata scrubbed, new vault rows.

    Fields in `authors` hold a name each, which becomes the session's token; names that its vault doesn't have are
    numbered like other values, in order of doc_id and field. Fields in `blank` become empty, those in `drop` go, all
    others stay. Null maps and null values stay null, blank names become empty, and so do names of a null session,
    which has no vault.
    """
    fields = docs.select("doc_id", "session_id", F.explode("metadata").alias("field", "value"))
    names = fields.where(F.col("field").isin(*authors) & (F.trim("value") != "") & F.col("session_id").isNotNull())
    spans = kept(names.withColumns({"start": F.lit(0), "type": F.lit("PERSON")}), "names")
    new = kept(vault.assign_tokens(spans, known, ["doc_id", "field"]), "new")
    tokens = known.select(new.columns).unionByName(new).groupBy("session_id", F.col("original_value").alias("value")).agg(F.min("token").alias("token"))
    met = spans.select("doc_id", "session_id", "value").distinct().join(tokens, ["session_id", "value"])
    maps = met.groupBy("doc_id", "session_id").agg(F.map_from_entries(F.collect_list(F.struct("value", "token"))).alias("tokens_"))
    left = F.map_filter("metadata", lambda k, v: ~k.isin(*drop))
    said = F.transform_values(left, lambda k, v: (
        F.when(v.isNull(), v).when(k.isin(*blank), F.lit("")).when(k.isin(*authors), F.coalesce(F.col("tokens_")[v], F.lit(""))).otherwise(v)
    ))
    return docs.join(maps, ["doc_id", "session_id"], "left").withColumn("metadata", said).select(docs.columns), new
