"""Sinks: vault and audit tables, exports, copies and results beside their sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators.vault import recent_audit


def append_vault(new: DataFrame, path: str) -> None:
    """Appends mappings that the stored vault doesn't have, by session: safe to run again."""
    spark = new.sparkSession
    fresh = new.dropDuplicates(["session_id", "original_value"])
    try:
        old = spark.read.parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    else:
        fresh = fresh.join(old.select("session_id", "original_value"), ["session_id", "original_value"], "left_anti")
    fresh.write.mode("append").parquet(path)


def append_audit(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def export_audit_json(audit: DataFrame, path: str, session_id: str | None = None, limit: int = 10_000) -> None:
    recent_audit(audit, session_id, limit).write.mode("overwrite").json(path)


def write_copies(docs: DataFrame, path: str, kind: str = "anonymized") -> None:
    """docs (doc_key, text): a table of copies (or `result`s) under their derived names; an existing one is an error."""
    name = tx.copy_path(F.col("doc_key")) if kind == "anonymized" else tx.result_path(F.col("doc_key"))
    docs.withColumn("doc_key", name).write.mode("error").parquet(f"{path}/{kind}")


def write_review(texts: DataFrame, path: str) -> None:
    """Review copies of anonymised texts (session_id, request_id, text), one folder a session and in it one a request.

    Safe to run again: a request that comes again replaces its own copy, all others stay. Null ids share Spark's folder
    for null partitions; null texts have no copy.
    """
    rows = texts.where("text is not null").select("session_id", "request_id", "text")
    writer = rows.repartition("session_id", "request_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("session_id", "request_id").text(path)
