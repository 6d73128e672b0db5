"""Queries on the metadata of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import metadata
from .queries import query, table


@query("""WITH d AS (SELECT o_orderkey AS doc_id, 's' || (o_custkey % 16) AS session_id, c_name AS comment_author, 'Reviewer ' || (o_orderkey % 53) AS reviewer, o_orderstatus AS title
  FROM orders JOIN customer ON o_custkey = c_custkey),
known AS (SELECT 's' || (c_custkey % 16) AS session_id, c_name AS value, '[PERSON_' || c_custkey || ']' AS token, c_custkey AS n FROM customer WHERE c_custkey % 5 = 0),
said AS (SELECT doc_id, session_id, 'comment_author' AS field, comment_author AS value FROM d UNION ALL SELECT doc_id, session_id, 'reviewer', reviewer FROM d),
firsts AS (SELECT session_id, value, min(doc_id * 2 + CASE field WHEN 'reviewer' THEN 1 ELSE 0 END) AS seen FROM said s
  WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.session_id = s.session_id AND k.value = s.value) GROUP BY 1, 2),
fresh AS (SELECT f.session_id, f.value, '[PERSON_' || (row_number() OVER (PARTITION BY f.session_id ORDER BY seen) + coalesce(l.n, 0)) || ']' AS token
  FROM firsts f LEFT JOIN (SELECT session_id, max(n) AS n FROM known GROUP BY 1) l ON l.session_id = f.session_id),
vault AS (SELECT session_id, value, token FROM known UNION ALL SELECT * FROM fresh)
SELECT d.doc_id, '' AS author, a.token AS comment_author, r.token AS reviewer, d.title, 4 AS n_fields
FROM d JOIN vault a ON a.session_id = d.session_id AND a.value = d.comment_author JOIN vault r ON r.session_id = d.session_id AND r.value = d.reviewer""")
def author_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as documents whose comments are by their customers, a fifth of whom the session's vault knows."""
    clients = table(spark, sf_dir, "customer")
    session = lambda key: F.concat(F.lit("s"), (F.col(key) % 16).cast("string")).alias("session_id")
    token = F.concat(F.lit("[PERSON_"), F.col("c_custkey").cast("string"), F.lit("]")).alias("token")
    known = clients.where("c_custkey % 5 = 0").select(session("c_custkey"), token, F.col("c_name").alias("original_value"), F.lit("PERSON").alias("entity_type"))
    reviewer = F.concat(F.lit("Reviewer "), (F.col("o_orderkey") % 53).cast("string"))
    fields = {"author": F.col("c_name"), "comment_author": F.col("c_name"), "reviewer": reviewer, "company": F.lit("Firm"), "title": F.col("o_orderstatus")}
    meta = F.create_map(*[x for k, v in fields.items() for x in (F.lit(k), v)]).alias("metadata")
    docs = table(spark, sf_dir, "orders").join(clients, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("doc_id"), session("o_custkey"), meta)
    done, _ = metadata.scrub_authors(docs, known)
    return done.select("doc_id", *[F.col("metadata")[k].alias(k) for k in ("author", "comment_author", "reviewer", "title")], F.size("metadata").alias("n_fields"))
