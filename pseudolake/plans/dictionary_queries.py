"""Queries on dictionaries that are tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import replace
from . import jobs
from .queries import FIRST, SEEDED, TWO, query, seeded, table, two_kinds


def _seeded_sql(client: str = "c.c_name", phone: str = "'+7 (900) 123-45-' || lpad(CAST(d.doc_id % 100 AS VARCHAR), 2, '0')", firm: str = "'Фирма ' || (d.doc_id % 11)", total: str = "(1 + d.doc_id % 9) || ' 250,50'") -> str:
    """The seeded texts with some of their values put in another way."""
    old = ("c.c_name", "+7 (900) 123-45-'\n || lpad(CAST(d.doc_id % 100 AS VARCHAR), 2, '0') || '", "Фирма ' || (d.doc_id % 11)\n || '", "(1 + d.doc_id % 9) || ' 250,50")
    new = (client, f"' || {phone} || '", f"' || {firm} || '", f"{total} || '")
    out = SEEDED
    for a, b in zip(old, new):
        assert a in out
        out = out.replace(a, b)
    return out


LEAKED = "'mail' || (doc_id * 7 % 37) || '@corp' || (doc_id % 5) || '.example.com'"


@query(f"""WITH {TWO}, {FIRST}, planted AS (SELECT session_id, CASE WHEN doc_id % 10 = 0 THEN {LEAKED} END AS value FROM seeded)
SELECT p.session_id, count(*) AS docs, count(v.token) AS leaking FROM planted p LEFT JOIN vault v ON v.session_id = p.session_id AND v.original_value = p.value GROUP BY 1""")
def leak_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anonymised documents of which a tenth says an address again that the session's vault may or may not have."""
    texts, new, _ = two_kinds(spark, sf_dir)
    again = F.concat(F.lit(" mail"), (F.col("doc_id") * 7 % 37).cast("string"), F.lit("@corp"), (F.col("doc_id") % 5).cast("string"), F.lit(".example.com"))
    texts = texts.withColumn("text", F.when(F.col("doc_id") % 10 == 0, F.concat("text", again)).otherwise(F.col("text")))
    bad = replace.leaks(texts.select("doc_id", "session_id", "text"), new).select("doc_id").distinct().withColumn("bad", F.lit(1))
    return texts.select("doc_id", "session_id").join(bad, "doc_id", "left").groupBy("session_id").agg(F.count("*").alias("docs"), F.count("bad").alias("leaking"))


@query(f"WITH {_seeded_sql(client="CASE WHEN c.c_custkey % 2 = 0 THEN '[PERSON_' || c.c_custkey || ']' ELSE c.c_name END")} SELECT doc_id, text FROM seeded")
def replace_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The names of every other customer, all of which begin with the same word."""
    texts = seeded(spark, sf_dir).withColumn("book", F.lit("customers"))
    token = F.concat(F.lit("[PERSON_"), F.col("c_custkey").cast("string"), F.lit("]"))
    values = table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.lit("customers").alias("book"), F.col("c_name").alias("value"), token.alias("token"))
    return replace.replace_by_value(texts, values, ["doc_id"], ["book"]).select("doc_id", "text")


@query(f"WITH {_seeded_sql(phone="'[PHONE_' || (d.doc_id % 100) || ']'")} SELECT doc_id, session_id, text FROM seeded")
def replace_phones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers that have all but their last two digits in common."""
    texts = seeded(spark, sf_dir).withColumn("book", F.lit("phones"))
    k = F.col("c_custkey") % 100
    phone = F.concat(F.lit("+7 (900) 123-45-"), F.lpad(k.cast("string"), 2, "0"))
    values = table(spark, sf_dir, "customer").select(F.lit("phones").alias("book"), phone.alias("value"), F.concat(F.lit("[PHONE_"), k.cast("string"), F.lit("]")).alias("token")).distinct()
    return replace.replace_by_value(texts, values, ["doc_id"], ["book"]).drop("book")


_REDACTED = _seeded_sql(
    client="CASE WHEN c.c_custkey < 50 THEN '[MISC]' ELSE c.c_name END", firm="CASE WHEN d.doc_id % 11 = 3 THEN '[MISC]' ELSE 'Фирма ' || (d.doc_id % 11) END",
    total="CASE WHEN d.doc_id % 9 < 5 THEN '[MISC]' ELSE (1 + d.doc_id % 9) || ' 250,50' END",
)


@query(f"WITH {_REDACTED} SELECT doc_id, session_id, text FROM seeded")
def extra_redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names, sums and a firm from tables; the numbers of the tokens are left out of the result."""
    texts = seeded(spark, sf_dir)
    names = table(spark, sf_dir, "customer").where("c_custkey < 50").select(F.col("c_custkey").cast("long").alias("seq"), F.upper("c_name").alias("value"))
    n = F.col("n_nationkey").cast("long")
    sums = table(spark, sf_dir, "nation").where("n_nationkey < 5").select((n + 1000).alias("seq"), F.concat((n + 1).cast("string"), F.lit(" 250,50")).alias("value"))
    firm = table(spark, sf_dir, "region").where("r_regionkey = 3").select(F.lit(2000).cast("long").alias("seq"), F.concat(F.lit("фирма "), F.col("r_regionkey").cast("string")).alias("value"))
    out, _, _ = jobs.extra_redact(texts, names.unionByName(sums).unionByName(firm), jobs.empty_vault(texts), ["doc_id"])
    return out.select("doc_id", "session_id", F.regexp_replace("text", r"\[MISC_\d+\]", "[MISC]").alias("text"))
