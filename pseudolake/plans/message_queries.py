"""Queries on messages: tool arguments, attached documents, blocks of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import segments
from ..sources.shared import spread
from . import jobs
from .queries import EMAIL, query, table

TURNS = "m AS (SELECT conv_id, turn, text, 'mail' || (conv_id % 9) || '@corp.example.com' AS a, 'mail' || (conv_id % 9 + 1) || '@corp.example.com' AS b FROM conversations)"


@query(f"""WITH {TURNS} SELECT conv_id, turn, text || ' [EMAIL_1]' AS text,
 '{{"uri":"file:///c:/' || a || '.docx","' || a || '":{{"list":["[EMAIL_1]","say \\"[EMAIL_2]\\"\\nthen"]}},"n":' || turn || '}}' AS first, 'plain [EMAIL_2]' AS second FROM m""")
def tool_arguments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses in texts, in nested arguments (one with an escaped sign), in a key, in a path, and in arguments that aren't JSON."""
    c = spread(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), "conv_id")
    mail = lambda k: F.concat(F.lit("mail"), (F.col("conv_id") % 9 + k).cast("string"), F.lit("@corp.example.com"))
    a, b = mail(0), mail(1)
    hidden = F.replace(b, F.lit("@"), F.lit("\\u0040"))
    nested = F.concat(F.lit('{"uri":"file:///c:/'), a, F.lit('.docx","'), a, F.lit('":{"list":["'), a, F.lit('","say \\"'), hidden, F.lit('\\"\\nthen"]},"n":'), F.col("turn").cast("string"), F.lit("}"))
    call = lambda name, arguments: F.struct(F.lit(name).alias("name"), arguments.alias("arguments"))
    calls = F.array(call("send", nested), call("say", F.concat(F.lit("plain "), b)))
    messages = c.select("conv_id", "turn", F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("session_id"), F.concat("text", F.lit(" "), a).alias("text"), calls.alias("tool_calls"))
    out, _, _ = jobs.anonymize_messages(messages, catalog=EMAIL)
    return out.select("conv_id", "turn", "text", F.col("tool_calls")[0]["arguments"].alias("first"), F.col("tool_calls")[1]["arguments"].alias("second"))


@query("""WITH t AS (SELECT conv_id, max(turn) AS last, list(turn) AS turns FROM conversations GROUP BY 1)
SELECT conv_id, 'c:/docs/r' || (conv_id % 7) || ' x.docx' AS path, 0::BIGINT AS at FROM t WHERE NOT (conv_id % 3 = 0 AND list_contains(turns, 2))
UNION ALL SELECT conv_id, 'notes/' || conv_id || '.txt', 1 FROM t WHERE list_contains(turns, 1)""")
def attached_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two spellings of a path in a conversation are one document; a third of the conversations is done with it."""
    c = table(spark, sf_dir, "conversations")
    n = (F.col("conv_id") % 7).cast("string")
    block = F.concat(F.lit('<file_content path="C:\\Docs\\R'), n, F.lit('%20x.DOCX">body</file_content> @file:c:/docs/~$lock.docx'))
    again = F.concat(F.lit("@file:c:/docs/r"), n, F.lit("%20x.docx @file:notes/"), F.col("conv_id").cast("string"), F.lit(".txt @file:a/b.anonymized.docx"))
    done = F.concat(F.lit("[anonymizer:done:c:/docs/r"), n, F.lit(" x.docx]"))
    extra = F.when(F.col("turn") == 0, block).when(F.col("turn") == 1, again).when((F.col("turn") == 2) & (F.col("conv_id") % 3 == 0), done).otherwise("")
    return segments.attached_documents(c.select("conv_id", "turn", F.concat("text", F.lit(" "), extra).alias("text")))


@query("""SELECT conv_id, turn, text || chr(10) || '<file_content path="C:\\docs\\' || (conv_id % 30) || '.docx">' || chr(10)
 || CASE WHEN turn % 2 = 1 THEN 'whole body' WHEN n_name IS NULL THEN 'Failed to read: binary' ELSE 'Text of ' || n_name END || chr(10) || '</file_content> end' AS text
FROM conversations LEFT JOIN nation ON n_nationkey = conv_id % 30""")
def file_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies of blocks that couldn't be read come from the documents of these paths; others, and unknown paths, stay."""
    c, n = table(spark, sf_dir, "conversations"), table(spark, sf_dir, "nation")
    body = F.when(F.col("turn") % 2 == 1, "whole body").otherwise("Failed to read: binary")
    text = F.concat("text", F.lit('\n<file_content path="C:\\docs\\'), (F.col("conv_id") % 30).cast("string"), F.lit('.docx">\n'), body, F.lit("\n</file_content> end"))
    documents = n.select(F.concat(F.lit("file://c:/docs/"), F.col("n_nationkey").cast("string"), F.lit(".docx")).alias("path"), F.concat(F.lit("Text of "), "n_name").alias("text"))
    return segments.file_blocks(c.select("conv_id", "turn", text.alias("text")), documents, ["conv_id", "turn"], "Failed to read")


@query("""SELECT o_orderkey, 'c:/data/' || lower(o_orderpriority) || '/' || o_orderkey || '.xlsx' AS path, 'C:/Data/' || o_orderpriority || '/' || o_orderkey || '.result.xlsx' AS result,
 CAST(o_totalprice AS DECIMAL(18,2))::DOUBLE AS price FROM orders""")
def paths_and_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths in another spelling, names of results, and numbers read back as they are shown."""
    k, o = F.col("o_orderkey").cast("string"), table(spark, sf_dir, "orders")
    written = F.concat(F.lit('"C:\\Data/'), F.replace("o_orderpriority", F.lit(" "), F.lit("%20")), F.lit("\\"), k, F.lit('.XLSX"'))
    name = F.concat(F.lit("C:/Data/"), "o_orderpriority", F.lit("/"), k, F.when(F.col("o_orderkey") % 2 == 0, ".anonymized.xlsx").otherwise(".xlsx"))
    shown = tx.render_number(F.col("o_totalprice").cast("decimal(18,2)").cast("string"), F.lit('#,##0.00\\ [$₽-419]'))
    return o.select("o_orderkey", tx.norm_path(written).alias("path"), tx.result_path(name).alias("result"), tx.restore_number(shown).alias("price"))
