"""Queries over the shipped tables, each with the SQL that gives the same rows where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import catalog as cat
from ..functions import text as tx
from ..operators import cells as grid
from ..operators import detect, replace, segments, vault
from ..sources.shared import shared_folder, spread
from ..streaming import restore as streams
from . import jobs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- derived inputs, in both languages -------------------------------------------------------------------------

SEEDED = """seeded AS (SELECT d.doc_id, 's' || (d.doc_id % 16) AS session_id, d.text || ' Клиент ' || c.c_name || ', +7 (900) 123-45-'
 || lpad(CAST(d.doc_id % 100 AS VARCHAR), 2, '0') || ', mail' || (d.doc_id % 37) || '@corp' || (d.doc_id % 5) || '.example.com; ООО «Фирма ' || (d.doc_id % 11)
 || '», сумма ' || (1 + d.doc_id % 9) || ' 250,50 руб. См. https://host' || (d.doc_id % 13) || '.example.org/p?id=' || (d.doc_id % 7) || '.' AS text
 FROM documents d JOIN customer c ON c.c_custkey = d.doc_id % 100)"""


def seeded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with values of each kind at the end, in 16 sessions."""
    d, c = spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id"), table(spark, sf_dir, "customer")
    i = F.col("doc_id")
    s = lambda x: x.cast("string")
    text = F.concat(
        "text", F.lit(" Клиент "), "c_name", F.lit(", +7 (900) 123-45-"), F.lpad(s(i % 100), 2, "0"), F.lit(", mail"), s(i % 37), F.lit("@corp"), s(i % 5),
        F.lit(".example.com; ООО «Фирма "), s(i % 11), F.lit("», сумма "), s(1 + i % 9), F.lit(" 250,50 руб. См. https://host"), s(i % 13), F.lit(".example.org/p?id="), s(i % 7), F.lit("."),
    )
    few = c.where(F.col("c_custkey").between(-99, 99)).select("c_custkey", "c_name")  # all that i % 100 can be: a join by shuffle would send texts to 100 keys
    return d.join(F.broadcast(few), F.col("c_custkey") == i % 100).select("doc_id", F.concat(F.lit("s"), s(i % 16)).alias("session_id"), text.alias("text"))


EMAIL, PHONE = cat.only("EMAIL"), cat.only("PHONE")[:1]
RE_EMAIL = r"(?i)\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
RE_PHONE = r"(?:\+7|8)[\s\-]?\(?\d{3}\)?[\s\-]?\d{3}[\s\-]?\d{2}[\s\-]?\d{2}"


def sql_spans(pattern: str, source: str, keys: str, kind: str, name: str) -> str:
    """CTE `name` (keys, start, end, value, type) of all matches in `source`."""
    lens = lambda x: f"coalesce(list_sum(list_transform({x}, lambda e: length(e))), 0)"
    return f"""{name}_m AS (SELECT {keys}, string_split_regex(text, '{pattern}') AS g, regexp_extract_all(text, '{pattern}') AS v FROM {source} WHERE regexp_matches(text, '{pattern}')),
{name}_k AS (SELECT {keys}, g, v, unnest(range(1, len(v) + 1)) AS k FROM {name}_m),
{name} AS (SELECT {keys}, CAST({lens('g[1:k]')} + {lens('v[1:k - 1]')} AS INTEGER) AS "start", CAST({lens('g[1:k]')} + {lens('v[1:k]')} AS INTEGER) AS "end", v[k] AS value, '{kind}' AS type FROM {name}_k)"""


TWO = f"{SEEDED}, {sql_spans(RE_EMAIL, 'seeded', 'doc_id, session_id', 'EMAIL', 'e')}, {sql_spans(RE_PHONE, 'seeded', 'doc_id, session_id', 'PHONE', 'p')}, spans AS (SELECT * FROM e UNION ALL SELECT * FROM p)"
FIRST = """first AS (SELECT * FROM spans QUALIFY row_number() OVER (PARTITION BY session_id, value ORDER BY doc_id, "start" DESC, type) = 1),
vault AS (SELECT session_id, '[' || type || '_' || row_number() OVER (PARTITION BY session_id ORDER BY doc_id, "start" DESC, type, value) || ']' AS token, value AS original_value, type AS entity_type FROM first)"""
ANON = """cuts AS (SELECT doc_id, s."start", s."end", v.token FROM spans s JOIN vault v ON v.session_id = s.session_id AND v.original_value = s.value),
pieces AS (SELECT doc_id, "start", coalesce(lag("end") OVER (PARTITION BY doc_id ORDER BY "start"), 0) AS prev, token FROM cuts),
done AS (SELECT doc_id, string_agg(substring(text, prev + 1, "start" - prev) || token, '' ORDER BY "start") AS head, max("end") AS tail FROM pieces JOIN cuts USING (doc_id, "start", token) JOIN seeded USING (doc_id) GROUP BY doc_id),
anon AS (SELECT doc_id, session_id, coalesce(head || substring(text, tail + 1), text) AS text FROM seeded LEFT JOIN done USING (doc_id))"""


def two_kinds(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return jobs.anonymize_texts(seeded(spark, sf_dir), catalog=(*EMAIL, *PHONE))


NOW = "TIMESTAMP '2024-01-03 00:00:00'"
SESSIONS = """sessions AS (SELECT 's' || c_custkey AS session_id, TIMESTAMP '2024-01-01' + to_hours(CAST(c_custkey % 72 AS BIGINT)) AS created_at,
 TIMESTAMP '2024-01-02' + to_hours(CAST(c_custkey % 72 AS BIGINT)) AS expires_at FROM customer)"""
MAPPINGS = """mappings AS (SELECT 's' || o_custkey AS session_id, '[' || CASE WHEN o_orderstatus = 'F' THEN 'PERSON' ELSE 'ORG' END || '_' || (1 + o_orderkey % 50) || ']' AS token,
 min(o_orderpriority || ' ' || o_orderkey) AS original_value, max(CAST(o_orderdate AS TIMESTAMP)) AS created_at FROM orders GROUP BY 1, 2)"""


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    hours = F.make_interval(hours=(F.col("c_custkey") % 72).cast("int"))
    c = table(spark, sf_dir, "customer")
    return c.select(F.concat(F.lit("s"), F.col("c_custkey").cast("string")).alias("session_id"), (F.expr("timestamp_ntz '2024-01-01'") + hours).alias("created_at"), (F.expr("timestamp_ntz '2024-01-02'") + hours).alias("expires_at"))


def mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    kind = F.when(F.col("o_orderstatus") == "F", "PERSON").otherwise("ORG")
    token = F.concat(F.lit("["), kind, F.lit("_"), (1 + F.col("o_orderkey") % 50).cast("string"), F.lit("]"))
    value = F.concat_ws(" ", "o_orderpriority", F.col("o_orderkey").cast("string"))
    return o.groupBy(F.concat(F.lit("s"), F.col("o_custkey").cast("string")).alias("session_id"), token.alias("token")).agg(F.min(value).alias("original_value"), F.max(F.col("o_orderdate").cast("timestamp_ntz")).alias("created_at"))


def now():
    return F.expr("timestamp_ntz '2024-01-03 00:00:00'")


# ---- detection -------------------------------------------------------------------------------------------------


def _kind_spans(spark, sf_dir, catalog):
    return seeded(spark, sf_dir).select("doc_id", F.inline(detect.regex_spans(F.col("text"), catalog))).drop("confidence")


@query(f"WITH {SEEDED}, {sql_spans(RE_EMAIL, 'seeded', 'doc_id', 'EMAIL', 'e')} SELECT * FROM e")
def email_spans(spark, sf_dir):
    return _kind_spans(spark, sf_dir, EMAIL)


@query(f"WITH {SEEDED}, {sql_spans(RE_PHONE, 'seeded', 'doc_id', 'PHONE', 'p')} SELECT * FROM p")
def phone_spans(spark, sf_dir):
    return _kind_spans(spark, sf_dir, PHONE)


RE_URL = r"(?i)https?://[^\s<>\"'')\]]+"


@query(f"""WITH {SEEDED}, {sql_spans(RE_URL, 'seeded', 'doc_id', 'WEB', 'w')}
SELECT doc_id, "start", CAST("start" + length(rtrim(value, '.,;:!?)]}}»"''…')) AS INTEGER) AS "end", rtrim(value, '.,;:!?)]}}»"''…') AS value, type FROM w""")
def url_spans(spark, sf_dir):
    return _kind_spans(spark, sf_dir, cat.only("WEB")[:1])


RE_ORG = r"ООО\s+«[^»]{2,120}»"


@query(f"WITH {SEEDED}, {sql_spans(RE_ORG, 'seeded', 'doc_id', 'ORG', 'o')} SELECT * FROM o")
def org_spans(spark, sf_dir):
    return _kind_spans(spark, sf_dir, cat.only("ORG")[:1])


TAGGED = """tagged AS (SELECT doc_id, text || ' Петров А. Б., паспорт 4' || lpad(CAST(doc_id % 1000 AS VARCHAR), 3, '0') || ' 1' || lpad(CAST(doc_id % 99991 AS VARCHAR), 5, '0')
 || '; К. Л. Сидорова-Мак, серия: 4511 № 654321, ИНН 77' || lpad(CAST(doc_id % 99999989 AS VARCHAR), 8, '0') || ', ОГРН: 10277001325' || lpad(CAST(doc_id % 10 AS VARCHAR), 1, '0')
 || ', цена ' || (1 + doc_id % 9) || ' 250,50 руб и ' || (10000 + doc_id % 999) || ' USD, www.host' || (doc_id % 13) || '.example.org/p.' AS text FROM documents)"""


def tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with names, passports, tax numbers, sums and an address at the end."""
    i = F.col("doc_id")
    s = lambda x: x.cast("string")
    text = F.concat(
        "text", F.lit(" Петров А. Б., паспорт 4"), F.lpad(s(i % 1000), 3, "0"), F.lit(" 1"), F.lpad(s(i % 99991), 5, "0"),
        F.lit("; К. Л. Сидорова-Мак, серия: 4511 № 654321, ИНН 77"), F.lpad(s(i % 99999989), 8, "0"), F.lit(", ОГРН: 10277001325"), s(i % 10),
        F.lit(", цена "), s(1 + i % 9), F.lit(" 250,50 руб и "), s(10000 + i % 999), F.lit(" USD, www.host"), s(i % 13), F.lit(".example.org/p."),
    )
    return table(spark, sf_dir, "documents").select("doc_id", text.alias("text"))


def _tagged_spans(spark, sf_dir, catalog):
    return tagged(spark, sf_dir).select("doc_id", F.inline(detect.regex_spans(F.col("text"), catalog))).drop("confidence")


def _tagged_sql(kind: str, *patterns: str) -> str:
    names = [f"{kind.lower()}{k}" for k in range(len(patterns))]
    ctes = ", ".join(sql_spans(p, "tagged", "doc_id", kind, n) for n, p in zip(names, patterns))
    return f"WITH {TAGGED}, {ctes} " + " UNION ALL ".join(f"SELECT * FROM {n}" for n in names)


@query(_tagged_sql("PASSPORT", r"\b\d{4}\s*\d{6}\b", r"(?i)(?:серия|паспорт)[:\s]*\d{4}\s*(?:№|номер)?[:\s]*\d{6}"))
def passport_spans(spark, sf_dir):
    return _tagged_spans(spark, sf_dir, cat.only("PASSPORT"))


@query(_tagged_sql("PERSON", r"[А-ЯЁ][а-яё]+(?:-[А-ЯЁ][а-яё]+)?\s+[А-ЯЁ]\.\s*[А-ЯЁ]\.", r"[А-ЯЁ]\.[ \t]?[А-ЯЁ]\.[ \t]+[А-ЯЁ][а-яё]+(?:-[А-ЯЁ][а-яё]+)?"))
def person_spans(spark, sf_dir):
    return _tagged_spans(spark, sf_dir, cat.only("PERSON"))


@query(_tagged_sql("INN", r"(?i)(?:ИНН|ОГРН|КПП)[:\s]*\d{10,12}\b"))
def inn_spans(spark, sf_dir):
    return _tagged_spans(spark, sf_dir, cat.only("INN")[:1])


_SUM = r"[ \t\x{00A0}]*(?:руб[а-яё]*|₽|RUB\b|USD\b|EUR\b|CNY\b|юан[а-яё]*|долл[а-яё]*|евро|¥|£|\$|€)"


@query(_tagged_sql(
    "MONEY", r"(?i)\b\d{1,3}(?:[ \t\x{00A0}]\d{3})*(?:[.,]\d+)?" + _SUM, r"\b\d{1,3}(?:[ \x{00A0}\x{2009}]\d{3})+(?:[.,]\d+)?\b", r"(?i)\b\d{4,}(?:[.,]\d+)?" + _SUM
))
def money_spans(spark, sf_dir):
    return _tagged_spans(spark, sf_dir, cat.only("MONEY")[:3])


RE_WWW = r"(?i)\bwww\.[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+(?:/[^\s<>\"'')\]]*)?"


@query(f"""WITH {TAGGED}, {sql_spans(RE_WWW, 'tagged', 'doc_id', 'WEB', 'w')}
SELECT doc_id, "start", CAST("start" + length(rtrim(value, '.,;:!?)]}}»"''…')) AS INTEGER) AS "end", rtrim(value, '.,;:!?)]}}»"''…') AS value, type FROM w""")
def www_spans(spark, sf_dir):
    return _tagged_spans(spark, sf_dir, cat.only("WEB")[1:2])


@query(f"WITH {TWO} SELECT session_id, type, count(*) AS entities, count(DISTINCT value) AS mappings FROM spans GROUP BY ALL")
def entity_counts(spark, sf_dir):
    docs = seeded(spark, sf_dir)
    spans = docs.select("session_id", F.inline(detect.resolve_overlaps(detect.regex_spans(F.col("text"), (*EMAIL, *PHONE)))))
    return vault.entity_counts(spans, ["session_id"])


LINE_SPANS = """ls AS (SELECT l_orderkey AS doc_id, CAST(l_linenumber * 4 + l_suppkey % 7 AS INTEGER) AS "start", CAST(l_linenumber * 4 + l_suppkey % 7 + 2 + l_partkey % 9 AS INTEGER) AS "end",
 'v' || l_partkey AS value, CASE l_partkey % 3 WHEN 0 THEN 'EMAIL' WHEN 1 THEN 'WEB' ELSE 'ORG' END AS type FROM lineitem)"""


def line_spans(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem")
    start = (F.col("l_linenumber") * 4 + F.col("l_suppkey") % 7).cast("int")
    kind = F.when(F.col("l_partkey") % 3 == 0, "EMAIL").when(F.col("l_partkey") % 3 == 1, "WEB").otherwise("ORG")
    return x.select(F.col("l_orderkey").alias("doc_id"), start.alias("start"), (start + 2 + F.col("l_partkey") % 9).cast("int").alias("end"), F.concat(F.lit("v"), F.col("l_partkey").cast("string")).alias("value"), kind.alias("type"), F.lit(1.0).alias("confidence"))


@query(f"""WITH RECURSIVE {LINE_SPANS}, o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY "start", "start" - "end", CASE type WHEN 'EMAIL' THEN 0 WHEN 'WEB' THEN 1 ELSE 9 END, value) AS k,
 CASE type WHEN 'EMAIL' THEN 0 WHEN 'WEB' THEN 1 ELSE 9 END AS rank FROM ls),
f AS (SELECT doc_id, k, "start" AS s, "end" AS e, value, type, rank, 0 AS closed, NULL::INTEGER AS os, NULL::INTEGER AS oe, NULL::VARCHAR AS ov, NULL::VARCHAR AS ot FROM o WHERE k = 1
 UNION ALL SELECT o.doc_id, o.k,
  CASE WHEN o."start" >= f.e OR w THEN o."start" ELSE f.s END, CASE WHEN o."start" >= f.e OR w THEN o."end" ELSE f.e END,
  CASE WHEN o."start" >= f.e OR w THEN o.value ELSE f.value END, CASE WHEN o."start" >= f.e OR w THEN o.type ELSE f.type END, CASE WHEN o."start" >= f.e OR w THEN o.rank ELSE f.rank END,
  CASE WHEN o."start" >= f.e THEN 1 ELSE 0 END, f.s, f.e, f.value, f.type
 FROM f JOIN (SELECT * FROM o) o ON o.doc_id = f.doc_id AND o.k = f.k + 1, LATERAL (SELECT o."end" - o."start" > f.e - f.s OR (o."end" - o."start" = f.e - f.s AND o.rank < f.rank) AS w)),
last AS (SELECT * FROM f QUALIFY k = max(k) OVER (PARTITION BY doc_id))
SELECT doc_id, os AS "start", oe AS "end", ov AS value, ot AS type FROM f WHERE closed = 1 UNION ALL SELECT doc_id, s, e, value, type FROM last""")
def resolve_overlaps(spark, sf_dir):
    x = line_spans(spark, sf_dir)
    lists = x.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("value", "start", "end", "type", "confidence"))).alias("s"))
    spans = F.transform("s", lambda s: detect.span(s["start"], s["end"], s["value"], s["type"], s["confidence"]))
    return lists.select("doc_id", F.inline(detect.resolve_overlaps(spans))).drop("confidence")


@query(f"""WITH RECURSIVE {LINE_SPANS}, o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY "start" - "end", "start", "end", value, type) AS k FROM ls),
f AS (SELECT doc_id, k, [{{'s': "start", 'e': "end", 'v': value, 't': type}}] AS kept FROM o WHERE k = 1
 UNION ALL SELECT o.doc_id, o.k, CASE WHEN len(list_filter(f.kept, lambda x: o."start" < x.e AND o."end" > x.s)) > 0 THEN f.kept ELSE list_append(f.kept, {{'s': o."start", 'e': o."end", 'v': o.value, 't': o.type}}) END
 FROM f JOIN o ON o.doc_id = f.doc_id AND o.k = f.k + 1),
last AS (SELECT doc_id, unnest(kept) AS x FROM f QUALIFY k = max(k) OVER (PARTITION BY doc_id))
SELECT doc_id, x.s AS "start", x.e AS "end", x.v AS value, x.t AS type FROM last""")
def non_overlapping(spark, sf_dir):
    lists = replace.collected(line_spans(spark, sf_dir), ["doc_id"])
    return lists.select("doc_id", F.inline(replace.select_non_overlapping(F.col("spans")))).drop("confidence")


@query(f"""WITH {LINE_SPANS} SELECT doc_id % 100 AS grp, type, value, count(*) AS n FROM (SELECT DISTINCT doc_id, "start", "end", value, type FROM ls) GROUP BY ALL""")
def dedup_spans(spark, sf_dir):
    x = line_spans(spark, sf_dir)
    d = detect.dedup_spans(x.unionByName(x.withColumn("confidence", F.lit(0.5))), ["doc_id"])
    return d.groupBy((F.col("doc_id") % 100).alias("grp"), "type", "value").agg(F.count("*").alias("n"))


@query(f"""WITH {SEEDED}, {sql_spans(RE_ORG, 'seeded', 'doc_id', 'ORG', 'o')}, c AS (SELECT DISTINCT doc_id, regexp_extract(value, '«([^»]+)»', 1) AS core FROM o)
SELECT * FROM o UNION ALL SELECT doc_id, CAST(instr(text, core) - 1 AS INTEGER), CAST(instr(text, core) - 1 + length(core) AS INTEGER), core, 'ORG' FROM c JOIN seeded USING (doc_id)""")
def quoted_names(spark, sf_dir):
    docs = seeded(spark, sf_dir).select("doc_id", "text")
    spans = docs.select("doc_id", F.inline(detect.regex_spans(F.col("text"), cat.only("ORG")[:1])))
    return detect.quoted_cores(spans, docs).drop("confidence")


@query(f"""WITH lic AS (SELECT doc_id, text FROM documents WHERE text LIKE '%License%'), {sql_spans('(?i)[[:word:]]*license[[:word:]]*', 'lic', 'doc_id', 'MISC', 'w')}
SELECT doc_id, "start", "end", 'License' AS value, type FROM w WHERE lower(value) = 'license'""")
def expand_values(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    at = F.instr("text", F.lit("License")) - 1
    seen = docs.select("doc_id", detect.span(at, at + 7, F.lit("License"), F.lit("MISC"), F.lit(0.9)).alias("s")).where("s.start >= 0").select("doc_id", "s.*")
    return detect.expand_occurrences(seen, docs).drop("confidence")


@query(f"""WITH {TAGGED} SELECT doc_id, CAST(instr(text, ' 250,50 руб и ') - 2 AS INTEGER) AS "start", CAST(instr(text, ' 250,50 руб и ') + 6 AS INTEGER) AS "end" FROM tagged""")
def whole_numbers(spark, sf_dir):
    d = tagged(spark, sf_dir).withColumn("at", F.instr("text", F.lit("250,50 руб и ")) - 1)
    return d.select("doc_id", detect.extend_numbers(F.col("text"), F.col("at"), F.col("at") + 3).alias("p")).select("doc_id", "p.start", "p.end")


@query("""WITH p AS (SELECT doc_id, text, CASE WHEN instr(text, 'LICENSE') > 0 THEN instr(text, 'LICENSE') ELSE nullif(instr(lower(text), 'license'), 0) END AS pos FROM documents)
SELECT doc_id, CAST(pos - 1 AS INTEGER) AS "start", CAST(pos + 6 AS INTEGER) AS "end", CASE WHEN pos IS NOT NULL THEN substring(text, pos, 7) END AS value FROM p""")
def locate_values(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", detect.locate_normalized(F.col("text"), F.lit("LICENSE")).alias("p")).select("doc_id", "p.start", "p.end", "p.value")


@query(f"""WITH {LINE_SPANS}, one AS (SELECT * FROM ls JOIN (SELECT l_orderkey AS doc_id FROM lineitem GROUP BY 1 HAVING count(*) > 1) USING (doc_id)),
e AS (SELECT doc_id, "start", "end", value, type FROM one QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY "start", "end", value, type) = 1),
m AS (SELECT doc_id, "start", "end", value, type FROM one QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY "start" DESC, "end" DESC, value DESC, type DESC) = 1),
j AS (SELECT e.doc_id, m."start" <= e."end" AND m."end" >= e."start" AS near, length(m.value) > length(e.value) AS longer, e."start" AS es, e."end" AS ee, e.value AS ev, e.type AS et, m."start" AS ms, m."end" AS me, m.value AS mv, m.type AS mt FROM e JOIN m USING (doc_id))
SELECT doc_id, es AS "start", ee AS "end", ev AS value, et AS type FROM j WHERE NOT (near AND longer) UNION ALL SELECT doc_id, ms, me, mv, mt FROM j WHERE NOT near OR longer""")
def merge_model_spans(spark, sf_dir):
    item = F.struct("start", "end", "value", "type")
    x = line_spans(spark, sf_dir).groupBy("doc_id").agg(F.min(item).alias("e"), F.max(item).alias("m"), F.count("*").alias("n")).where("n > 1")
    one = lambda c: F.array(detect.span(F.col(f"{c}.start"), F.col(f"{c}.end"), F.col(f"{c}.value"), F.col(f"{c}.type"), F.lit(1.0)))
    return x.select("doc_id", F.inline(detect.merge_spans(one("e"), one("m")))).drop("confidence")


@query("""SELECT p_partkey, regexp_full_match(upper(p_brand), '[A-Z]+') AS acronym, regexp_matches(p_name, '^[A-Za-zА-Яа-яЁё][A-Za-zА-Яа-яЁё.\\- ]*$') AS name_like,
 true AS numeric_key, p_partkey % 3 = 0 AS tokens FROM part""")
def value_predicates(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    letters = F.when(F.upper("p_brand").rlike("^[A-Z]+$"), F.upper("p_brand")).otherwise(F.lower("p_brand"))
    marked = F.when(F.col("p_partkey") % 3 == 0, F.concat("p_name", F.lit(" [ORG_1]"))).otherwise(F.col("p_name"))
    return p.select("p_partkey", tx.is_acronym(letters).alias("acronym"), tx.is_name_like(F.col("p_name")).alias("name_like"), tx.is_numeric_value(F.col("p_partkey").cast("string")).alias("numeric_key"), tx.has_tokens(marked).alias("tokens"))


@query("""SELECT conv_id, turn, CASE turn % 2 WHEN 0 THEN 'content' ELSE 'tool' END AS channel, 'n' || (conv_id % 25) AS session_id, text || ' ' || CASE turn % 2 WHEN 0 THEN n_name ELSE '[ORG_1]' END AS text
FROM conversations JOIN nation ON n_nationkey = conv_id % 25""")
def restore_content(spark, sf_dir):
    c, n = table(spark, sf_dir, "conversations"), table(spark, sf_dir, "nation")
    session = lambda x: F.concat(F.lit("n"), x.cast("string"))
    known = n.select(session(F.col("n_nationkey")).alias("session_id"), F.lit("[ORG_1]").alias("token"), F.col("n_name").alias("original_value"), F.lit("ORG").alias("entity_type"))
    channel = F.when(F.col("turn") % 2 == 0, "content").otherwise("tool")
    answers = c.select("conv_id", "turn", channel.alias("channel"), session(F.col("conv_id") % 25).alias("session_id"), F.concat("text", F.lit(" [ORG_1]")).alias("text"))
    return jobs.restore_answers(answers, known, full=False)


@query("""SELECT * FROM (SELECT conv_id, array_to_string(list_filter(string_split(string_agg(text, chr(10) ORDER BY turn), chr(10)), lambda l: contains(replace(lower(l), 'ё', 'е'), 'the')), chr(10)) AS text FROM conversations GROUP BY 1) WHERE text <> ''""")
def dump_lines(spark, sf_dir):
    return segments.dump(table(spark, sf_dir, "conversations"), "conv_id", "turn", "the")


@query()
def chunk_text(spark, sf_dir):
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return d.select("doc_id", F.posexplode(detect.chunk_bounds(F.coalesce("text", F.lit("")))).alias("chunk", "c")).select("doc_id", "chunk", "c.start", "c.end")


@query()
def detect_all(spark, sf_dir):
    return detect.detect(seeded(spark, sf_dir))


@query()
def model_entities(spark, sf_dir):
    words = {"worthless": "MISC", "Apache License": "PRODUCT", "the": "MISC"}
    return detect.model_spans(table(spark, sf_dir, "documents").select("doc_id", "text"), detect.gazetteer(words))


@query("SELECT doc_id, CASE WHEN instr(text, 'License') > 0 THEN CAST(instr(text, 'License') - 1 AS INTEGER) END AS \"start\", CASE WHEN instr(text, 'License') > 0 THEN CAST(instr(text, 'License') + 6 AS INTEGER) END AS \"end\" FROM documents")
def validate_offsets(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("p", detect.validate_offsets(F.col("text"), F.lit("License"), F.lit(3), F.lit(10)))
    return d.select("doc_id", "p.start", "p.end")


@query("""WITH b AS (SELECT user_id AS id, event_type AS label, max(value) AS score FROM events GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, label) AS r, lead(score) OVER (PARTITION BY id ORDER BY score DESC, label) AS second FROM b)
SELECT id, CASE WHEN score >= 0.05 AND (second IS NULL OR score >= second * 1.3) THEN label END AS label, score FROM r WHERE r = 1""")
def label_margin(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return vault.classify_by_labels(e.select(F.col("user_id").alias("id"), F.col("event_type").alias("label"), F.col("value").alias("score")))


# ---- tokens, vault, restoration --------------------------------------------------------------------------------


@query(f"WITH {TWO}, {FIRST} SELECT * FROM vault")
def vault_tokens(spark, sf_dir):
    return two_kinds(spark, sf_dir)[1]


@query(f"WITH {TWO}, {FIRST}, {ANON} SELECT * FROM anon")
def anonymize_docs(spark, sf_dir):
    return two_kinds(spark, sf_dir)[0]


@query(f"WITH {SEEDED} SELECT * FROM seeded")
def restore_docs(spark, sf_dir):
    texts, new, _ = two_kinds(spark, sf_dir)
    return jobs.restore(texts, new, ["doc_id"])


@query(f"""WITH {TWO}, {FIRST}, {ANON}, {sql_spans('[[]([A-Z_]+)_([0-9]+)[]]', 'anon', 'doc_id', 't', 't')}
SELECT doc_id, "start", "end", value AS token, regexp_extract(value, '[[]([A-Z_]+)_', 1) AS type, CAST(regexp_extract(value, '_([0-9]+)[]]', 1) AS BIGINT) AS n FROM t""")
def token_scan(spark, sf_dir):
    return replace.find_tokens(two_kinds(spark, sf_dir)[0], ["doc_id"])


@query(f"""WITH {TWO}, {FIRST}, {ANON}, keep AS (SELECT * FROM vault WHERE token LIKE '[PHONE_%'),
c2 AS (SELECT doc_id, s."start", s."end", s.value, v.token, v.token LIKE '[PHONE_%' AS back FROM spans s JOIN vault v ON v.session_id = s.session_id AND v.original_value = s.value),
p2 AS (SELECT *, coalesce(lag("end") OVER (PARTITION BY doc_id ORDER BY "start"), 0) AS prev FROM c2),
d2 AS (SELECT doc_id, string_agg(substring(text, prev + 1, "start" - prev) || CASE WHEN back THEN value ELSE token END, '' ORDER BY "start") AS head, max("end") AS tail FROM p2 JOIN seeded USING (doc_id) GROUP BY doc_id)
SELECT doc_id, coalesce(head || substring(text, tail + 1), text) AS text FROM seeded LEFT JOIN d2 USING (doc_id)""")
def subset_restore(spark, sf_dir):
    texts, new, _ = two_kinds(spark, sf_dir)
    wanted = new.where("token like '[PHONE_%'").select("session_id", "token")
    return replace.deanonymize_subset(texts, new, wanted, ["doc_id"])[0].select("doc_id", "text")


@query(f"WITH {MAPPINGS} SELECT session_id, max(CAST(regexp_extract(token, '_([0-9]+)[]]', 1) AS BIGINT)) AS last FROM mappings GROUP BY 1")
def next_counter(spark, sf_dir):
    return vault.next_counter(mappings(spark, sf_dir))


@query(f"WITH {MAPPINGS} SELECT session_id, count(DISTINCT token) AS found, max(created_at) AS created_at FROM mappings WHERE token IN ('[PERSON_3]', '[ORG_7]', '[ORG_11]') GROUP BY 1")
def sessions_with_tokens(spark, sf_dir):
    wanted = mappings(spark, sf_dir).select("token").where(F.col("token").isin("[PERSON_3]", "[ORG_7]", "[ORG_11]"))
    return vault.sessions_with_tokens(mappings(spark, sf_dir), wanted)


@query(f"""WITH {SESSIONS}, {MAPPINGS} SELECT s.session_id, s.created_at, s.expires_at, count(m.token) AS mappings FROM sessions s LEFT JOIN mappings m USING (session_id) WHERE s.expires_at > {NOW} GROUP BY ALL""")
def session_summary(spark, sf_dir):
    return vault.session_summary(sessions(spark, sf_dir), mappings(spark, sf_dir), now())


@query(f"WITH {SESSIONS} SELECT * FROM sessions WHERE expires_at > {NOW}")
def live_sessions(spark, sf_dir):
    return vault.live_sessions(sessions(spark, sf_dir), now())


@query(f"WITH {SESSIONS}, {MAPPINGS} SELECT m.* FROM mappings m WHERE session_id NOT IN (SELECT session_id FROM sessions WHERE expires_at < {NOW})")
def expired_purge(spark, sf_dir):
    return vault.expire(sessions(spark, sf_dir), mappings(spark, sf_dir), now())[1]


@query(f"""WITH {SESSIONS}, r AS (SELECT event_id AS request_id, 's' || user_id AS session_id FROM events)
SELECT request_id, r.session_id AS asked, s.session_id IS NULL AS is_new, coalesce(s.expires_at, {NOW} + INTERVAL 24 HOURS) AS expires_at FROM r LEFT JOIN sessions s ON s.session_id = r.session_id AND s.expires_at > {NOW}""")
def open_sessions(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("request_id"), F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("session_id"))
    got = vault.open_sessions(e, sessions(spark, sf_dir), now())
    return got.join(e.withColumnRenamed("session_id", "asked"), "request_id").select("request_id", "asked", "is_new", "expires_at")


@query("SELECT event_id AS request_id, 's' || user_id AS session_id, CAST(ts AS TIMESTAMP) AS ts, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 100")
def recent_audit(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("request_id"), F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("session_id"), F.col("ts").cast("timestamp_ntz").alias("ts"), "event_type")
    return vault.recent_audit(e)


LINKS = """links AS (SELECT 'doc' || (o_custkey % 200) || CASE o_orderkey % 3 WHEN 0 THEN '.docx' WHEN 1 THEN '.anonymized.docx' ELSE '.result.docx' END AS doc_key, 's' || (o_orderkey % 40) AS session_id,
 CAST(o_orderdate AS TIMESTAMP) AS created_at, o_orderkey AS seq FROM orders)"""


def links(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    kind = F.when(F.col("o_orderkey") % 3 == 0, ".docx").when(F.col("o_orderkey") % 3 == 1, ".anonymized.docx").otherwise(".result.docx")
    return o.select(F.concat(F.lit("doc"), (F.col("o_custkey") % 200).cast("string"), kind).alias("doc_key"), F.concat(F.lit("s"), (F.col("o_orderkey") % 40).cast("string")).alias("session_id"), F.col("o_orderdate").cast("timestamp_ntz").alias("created_at"), F.col("o_orderkey").alias("seq"))


@query(f"WITH {LINKS} SELECT doc_key, session_id FROM links QUALIFY row_number() OVER (PARTITION BY doc_key ORDER BY created_at DESC, seq DESC) = 1")
def latest_session(spark, sf_dir):
    return vault.latest_session(links(spark, sf_dir))


@query(f"""WITH {LINKS}, l AS (SELECT *, regexp_replace(doc_key, '\\.(?:result|anonymized)(\\.[a-z0-9]+)$', '\\1', 'i') AS stem, CASE WHEN doc_key LIKE '%.result.%' THEN 0 WHEN doc_key LIKE '%.anonymized.%' THEN 1 ELSE 2 END AS r FROM links WHERE session_id IN ('s1', 's4'))
SELECT session_id, stem, arg_min(doc_key, r) AS doc FROM (SELECT session_id, stem, doc_key, min(r) AS r FROM l GROUP BY ALL) GROUP BY ALL""")
def discover_targets(spark, sf_dir):
    m = spark.createDataFrame([("s1", "[ORG_1]"), ("s4", "[ORG_1]"), ("s5", "[ORG_2]")], "session_id string, token string").withColumn("created_at", now())
    return vault.discover_targets(m, links(spark, sf_dir), m.where("token = '[ORG_1]'"))


@query(f"WITH {LINKS} SELECT DISTINCT doc_key, session_id FROM links l WHERE seq % 2 = 0 AND NOT EXISTS (SELECT 1 FROM links o WHERE o.seq % 2 = 1 AND o.doc_key = l.doc_key AND o.session_id = l.session_id)")
def link_documents(spark, sf_dir):
    l_ = links(spark, sf_dir)
    return vault.link_documents(l_.where("seq % 2 = 1"), l_.where("seq % 2 = 0")).select("doc_key", "session_id")


@query(f"""WITH {MAPPINGS}, said AS (SELECT DISTINCT conv_id, turn, 's' || ((conv_id * 7 + turn) % 150) AS session_id FROM conversations),
l AS (SELECT conv_id, session_id, max(turn) AS turn FROM said GROUP BY ALL)
SELECT conv_id, token, original_value FROM l JOIN mappings USING (session_id) QUALIFY row_number() OVER (PARTITION BY conv_id, token ORDER BY turn DESC, session_id DESC) = 1""")
def merge_history(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.lit("s"), ((F.col("conv_id") * 7 + F.col("turn")) % 150).cast("string")).alias("session_id")).distinct()
    return vault.merge_history(c, mappings(spark, sf_dir))


@query("""WITH r AS (SELECT o_custkey AS batch, CASE WHEN o_orderkey % 5 = 0 THEN 'broken' END AS error, CAST(o_orderkey % 3 AS BIGINT) AS found FROM orders),
a AS (SELECT batch, count(*) AS files, CAST(count(error) AS BIGINT) AS errors, CAST(coalesce(sum(found) FILTER (WHERE error IS NULL), 0) AS BIGINT) AS found FROM r GROUP BY 1)
SELECT batch, CASE WHEN errors = files THEN 'failed' WHEN errors > 0 THEN 'partial' WHEN found = 0 THEN 'nothing found' ELSE 'ok' END AS status, files, errors, found FROM a""")
def batch_status(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return vault.batch_status(o.select(F.col("o_custkey").alias("batch"), F.when(F.col("o_orderkey") % 5 == 0, "broken").alias("error"), (F.col("o_orderkey") % 3).alias("found")), "batch")


@query("SELECT sha256(text) AS key, text FROM (SELECT DISTINCT text FROM documents) WHERE text NOT IN (SELECT text FROM documents WHERE doc_id % 3 = 0)")
def ner_cache_misses(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return vault.cache_misses(d, d.where("doc_id % 3 = 0").select(F.sha2("text", 256).alias("key")))


@query("""WITH j AS (SELECT o_custkey AS batch, o_orderkey, coalesce(l.made > CAST(o_orderdate AS TIMESTAMP) + INTERVAL 1 SECOND AND l.version = '2', false) AS good
 FROM orders LEFT JOIN (SELECT l_orderkey, max(CAST(l_shipdate AS TIMESTAMP)) AS made, CAST(max(l_linenumber) % 3 AS VARCHAR) AS version FROM lineitem GROUP BY 1) l ON l_orderkey = o_orderkey)
SELECT batch, o_orderkey AS doc_key, good, good AND bool_and(good) OVER (PARTITION BY batch) AS reuse FROM j""")
def reuse_unchanged(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("batch"), F.col("o_orderkey").alias("doc_key"), F.col("o_orderdate").cast("timestamp_ntz").alias("modified"))
    m = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc_key")).agg(F.max(F.col("l_shipdate").cast("timestamp_ntz")).alias("made"), (F.max("l_linenumber") % 3).cast("string").alias("version"))
    return vault.reusable(o, m, "2")


_AROUND = r"'(^|[^0-9A-Za-z_À-ɏ])({})([^0-9A-Za-z_À-ɏ]|$)', '\1{}\3', 'g'"
_PRODUCT, _MISC = _AROUND.format("Licensed under the Apache License", "[PRODUCT_1]"), _AROUND.format("worthless", "[MISC_2]")


# A match takes the character after it along, so that of neighbours every other one is found at once: twice finds all.
@query(f"SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, {_PRODUCT}), {_PRODUCT}), {_MISC}), {_MISC}) AS text FROM documents")
def replace_by_value(spark, sf_dir):
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id").withColumn("one", F.lit(1))
    values = spark.createDataFrame([(1, "Licensed under the Apache License", "[PRODUCT_1]"), (1, "worthless", "[MISC_2]")], "one int, value string, token string")
    return replace.replace_by_value(d, values, ["doc_id"], ["one"]).select("doc_id", "text")


# ---- conversations and segments --------------------------------------------------------------------------------


@query("""SELECT conv_id, turn, CAST(coalesce(sum(length(text) + 1) OVER w, 0) AS BIGINT) AS seg_start, CAST(coalesce(sum(length(text) + 1) OVER w, 0) + length(text) AS BIGINT) AS seg_end
FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def segment_bounds(spark, sf_dir):
    return segments.segment_bounds(table(spark, sf_dir, "conversations"), "conv_id", "turn").select("conv_id", "turn", "seg_start", "seg_end")


@query("""WITH b AS (SELECT conv_id, turn, text, CAST(coalesce(sum(length(text) + 1) OVER w, 0) AS BIGINT) AS s FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS whole FROM conversations GROUP BY 1),
sp AS (SELECT conv_id, whole, unnest(range(0, length(whole) - 90, 300)) AS a FROM t),
j AS (SELECT sp.conv_id, turn, text, a, a + 90 AS z, s, s + length(text) AS e, whole FROM sp JOIN b ON b.conv_id = sp.conv_id AND a < s + length(text) AND a + 90 > s),
o AS (SELECT conv_id, turn, CAST(greatest(a, s) - s AS INTEGER) AS "start", CAST(least(z, e) - s AS INTEGER) AS "end", a >= s AND z <= e AS whole_, substring(text, greatest(a, s) - s + 1, least(z, e) - greatest(a, s)) AS value FROM j)
SELECT conv_id, turn, "start", "end", value, CASE WHEN whole_ THEN 1.0::DOUBLE ELSE 0.8::DOUBLE END AS confidence FROM o WHERE whole_ OR regexp_matches(value, '[^\\s]')""")
def split_segments(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    whole = segments.joined_text(c, "conv_id", "turn").where(F.length("text") > 90)
    at = whole.select("conv_id", "text", F.explode(F.sequence(F.lit(0), F.length("text") - 91, F.lit(300))).alias("start"))
    spans = at.select("conv_id", "start", (F.col("start") + 90).alias("end"), F.substring("text", F.col("start") + 1, F.lit(90)).alias("value"), F.lit("MISC").alias("type"), F.lit(1.0).alias("confidence"))
    return segments.split_by_segments(spans, c, "conv_id", "turn").drop("type")


@query("SELECT conv_id, turn, text FROM conversations WHERE role = 'user' AND trim(text) <> '' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1")
def last_user_turn(spark, sf_dir):
    return segments.last_user_message(table(spark, sf_dir, "conversations"))


@query("""SELECT conv_id, string_agg('## ' || role || CASE WHEN text <> '' THEN chr(10) || chr(10) || text ELSE '' END, chr(10) || chr(10) ORDER BY turn) AS markdown FROM conversations GROUP BY 1""")
def render_conversation(spark, sf_dir):
    return segments.render_conversation(table(spark, sf_dir, "conversations"))


@query()
def anonymize_conversations(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    text = F.concat("text", F.lit(" mail"), (F.col("conv_id") % 9).cast("string"), F.lit("@corp.example.com"))
    parts = c.select("conv_id", "turn", F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("session_id"), text.alias("text"))
    return jobs.anonymize_segments(parts, "conv_id", "turn", catalog=EMAIL)[0]


@query("SELECT doc_id, array_to_string(list_filter(string_split(text, chr(10)), lambda l: contains(replace(lower(l), 'ё', 'е'), 'license')), chr(10)) AS lines FROM documents")
def find_lines(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(tx.find_lines(F.col("text"), "LICENSE"), "\n").alias("lines"))


@query("""WITH t AS (SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN '<think>' || text || '</think> ' || role WHEN 1 THEN role || ' <think>' || text ELSE text END AS text FROM conversations)
SELECT conv_id, turn, regexp_replace(regexp_replace(text, '(?s)<think>.*?(?:</think>|$)', '', 'g'), '^\\s+|\\s+$', '', 'g') AS text FROM t""")
def strip_think(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    text = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("<think>"), "text", F.lit("</think> "), "role")).when(F.col("turn") % 3 == 1, F.concat("role", F.lit(" <think>"), "text")).otherwise(F.col("text"))
    return c.select("conv_id", "turn", tx.strip_think(text).alias("text"))


@query(f"WITH {SEEDED} SELECT CAST(doc_id AS VARCHAR) AS stream_id, 'content' AS channel, text FROM seeded")
def stream_restore(spark, sf_dir):
    """The streaming operator over chunks of anonymised documents; the result equals the seeded texts."""
    texts, new, _ = two_kinds(spark, sf_dir)
    n = F.ceil(F.length("text") / 200).cast("int")
    cut = texts.select(F.col("doc_id").cast("string").alias("stream_id"), "text", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(n - 1, F.lit(0)).cast("long"))).alias("seq"), n.alias("n"))
    chunks = cut.select("stream_id", F.lit("content").alias("channel"), "seq", F.substring("text", (F.col("seq") * 200 + 1).cast("int"), F.lit(200)).alias("text"), (F.col("seq") >= F.col("n") - 1).alias("is_last"))
    held = replace.find_tokens(texts, ["doc_id", "session_id"]).select(F.col("doc_id").cast("string").alias("stream_id"), "session_id", "token").distinct()
    known = held.join(new, ["session_id", "token"]).select("stream_id", "token", "original_value")
    return streams.collected(streams.restore_all(chunks, known, shared_folder(spark, "chunks")))


@query("""WITH RECURSIVE e AS (SELECT DISTINCT user_id, event_type, CAST(ts AS TIMESTAMP) AS ts FROM events),
k AS (SELECT user_id, event_type, min(ts) AS ts FROM e GROUP BY user_id, event_type
 UNION ALL SELECT k.user_id, k.event_type, min(e.ts) FROM k JOIN e ON e.user_id = k.user_id AND e.event_type = k.event_type AND e.ts >= k.ts + INTERVAL 600 SECONDS GROUP BY k.user_id, k.event_type)
SELECT user_id, event_type, ts FROM k""")
def coalesce_duplicates(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_type", F.col("ts").cast("timestamp_ntz").alias("ts"))
    return streams.coalesce_duplicates(e, ["user_id", "event_type"])


# ---- commands and small functions ------------------------------------------------------------------------------

SPEC = """spec AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'раскрой PERSON_' || (o_orderkey % 9) || '–PERSON_' || (o_orderkey % 9 + 2) || ' и ORG_2'
 WHEN 1 THEN 'PERSON_' || (o_orderkey % 7) || ', [ORG_' || (o_orderkey % 5) || '], FOO_1' WHEN 2 THEN 'с PERSON_4 по PERSON_' || (o_orderkey % 9) ELSE o_orderpriority END AS text FROM orders)"""


def spec(spark, sf_dir):
    k, s = F.col("o_orderkey"), lambda x: x.cast("string")
    text = (
        F.when(k % 4 == 0, F.concat(F.lit("раскрой PERSON_"), s(k % 9), F.lit("–PERSON_"), s(k % 9 + 2), F.lit(" и ORG_2")))
        .when(k % 4 == 1, F.concat(F.lit("PERSON_"), s(k % 7), F.lit(", [ORG_"), s(k % 5), F.lit("], FOO_1")))
        .when(k % 4 == 2, F.concat(F.lit("с PERSON_4 по PERSON_"), s(k % 9))).otherwise(F.col("o_orderpriority"))
    )
    return spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), "o_orderkey").select("o_orderkey", text.alias("text"))


@query(f"""WITH {SPEC} SELECT o_orderkey, CASE o_orderkey % 4
 WHEN 0 THEN array_to_string(list_transform(range(o_orderkey % 9, o_orderkey % 9 + 3), lambda n: '[PERSON_' || n || ']'), ',') || ',[ORG_2]'
 WHEN 1 THEN '[PERSON_' || (o_orderkey % 7) || '],[ORG_' || (o_orderkey % 5) || ']'
 WHEN 2 THEN array_to_string(list_transform(range(4, o_orderkey % 9 + 1), lambda n: '[PERSON_' || n || ']'), ',') ELSE '' END AS tokens,
 CASE WHEN o_orderkey % 4 = 1 THEN 'FOO_1: unknown type' WHEN o_orderkey % 4 = 2 AND o_orderkey % 9 < 4 THEN 'PERSON_4–PERSON_' || (o_orderkey % 9) || ': downwards' ELSE '' END AS errors FROM spec""")
def parse_spec(spark, sf_dir):
    got = spec(spark, sf_dir).withColumn("p", tx.parse_placeholder_spec(F.col("text")))
    return got.select("o_orderkey", F.array_join("p.tokens", ",").alias("tokens"), F.array_join("p.errors", ",").alias("errors"))


@query("""SELECT c_custkey, c_name || ';' || c_mktsegment || ';' || (100000 + c_custkey) || ',' || (10 + c_custkey % 90) AS vals FROM customer""")
def parse_values(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    text = F.concat(F.lit(": имена "), "c_name", F.lit(", «"), "c_mktsegment", F.lit("» и "), F.lower("c_mktsegment"), F.lit("; "), (100000 + F.col("c_custkey")).cast("string"), F.lit(","), (10 + F.col("c_custkey") % 90).cast("string"))
    return c.select("c_custkey", F.array_join(tx.parse_value_list(text)["values"], ";").alias("vals"))


PHRASES = ["перезапусти прокси", "работай через локальную модель", "переключись на облако", "раскрой эти данные PERSON_1", "скрой эти данные: Иванов", "раскрой все данные", "скрой всё", "what is the weather"]
_INTENTS = ["restart", "backend_local", "backend_cloud", "reveal_some", "hide_some", "reveal_all", "hide_all", None]


@query("SELECT conv_id, turn, CASE (conv_id + turn) % 8 " + " ".join(f"WHEN {k} THEN {'NULL' if x is None else repr(x)}" for k, x in enumerate(_INTENTS)) + " END AS intent FROM conversations")
def command_intent(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    phrase = F.element_at(F.array(*map(F.lit, PHRASES)), ((F.col("conv_id") + F.col("turn")) % 8 + 1).cast("int"))
    return c.select("conv_id", "turn", tx.command_intent(F.concat("text", F.lit("\n"), phrase)).alias("intent"))


@query(r"""SELECT page_id, regexp_replace(html, '(?i)(\bhref\s*=\s*)"(?:https?:|ftp:|mailto:|www\.)[^"'']*"', '\1"#"', 'g') AS html FROM pages""")
def scrub_links(spark, sf_dir):
    return spread(table(spark, sf_dir, "pages").select("page_id", "html"), "page_id").select("page_id", tx.scrub_link_targets(F.col("html")).alias("html"))


@query("""SELECT o_orderkey, regexp_replace(regexp_replace(regexp_replace(w, '(\\d)(\\d{3})$', '\\1 \\2'), '(\\d)(\\d{3}) ', '\\1 \\2 '), '(\\d)(\\d{3}) ', '\\1 \\2 ') || ',' || f || ' ₽' AS shown
FROM (SELECT o_orderkey, split_part(CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR), '.', 1) AS w, split_part(CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR), '.', 2) AS f FROM orders)""")
def number_render(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", tx.render_number(F.col("o_totalprice").cast("decimal(18,2)").cast("string"), F.lit('#,##0.00\\ [$₽-419]')).alias("shown"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderdate AS DATE) END AS d, CASE WHEN o_orderkey % 3 = 1 THEN o_orderkey END AS i, CASE WHEN o_orderkey % 3 = 2 THEN o_orderpriority END AS t FROM orders")
def coerce_value(spark, sf_dir):
    k = F.col("o_orderkey")
    text = F.when(k % 3 == 0, F.date_format("o_orderdate", "dd.MM.yyyy")).when(k % 3 == 1, k.cast("string")).otherwise(F.col("o_orderpriority"))
    v = table(spark, sf_dir, "orders").select("o_orderkey", tx.coerce_value(text).alias("v"))
    return v.select("o_orderkey", F.col("v.date").alias("d"), F.col("v.int").alias("i"), F.col("v.text").alias("t"))


@query()
def normalize_search(spark, sf_dir):
    """The fold of all letters has no SQL."""
    return table(spark, sf_dir, "documents").select("doc_id", tx.normalize_for_search(F.col("text")).alias("norm"))


@query("SELECT page_id, regexp_matches('s-' || page_id || CASE WHEN page_id % 5 = 0 THEN ' x' ELSE '_y' END, '^[A-Za-z0-9_-]{1,64}$') AS ok FROM pages")
def session_id_check(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", tx.valid_session_id(F.concat(F.lit("s-"), F.col("page_id").cast("string"), F.when(F.col("page_id") % 5 == 0, " x").otherwise("_y"))).alias("ok"))


@query(r"""SELECT o_orderkey, CASE WHEN hour(d) + minute(d) + second(d) = 0 THEN strftime(d, '%Y-%m-%d') ELSE strftime(d, '%Y-%m-%d %H:%M:%S') END AS shown, trim(replace(regexp_replace(t, '\s*\n+\s*', ' ', 'g'), '_x000D_', '')) AS line
FROM (SELECT o_orderkey, CAST(o_orderdate AS TIMESTAMP) + to_seconds(CASE WHEN o_orderkey % 2 = 0 THEN 0 ELSE o_orderkey % 86400 END) AS d, ' ' || o_orderpriority || '_x000D_' || chr(10) || ' ' || o_orderstatus AS t FROM orders)""")
def cell_display(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    seconds = F.when(F.col("o_orderkey") % 2 == 0, 0).otherwise(F.col("o_orderkey") % 86400)
    at = F.col("o_orderdate").cast("timestamp_ntz") + F.make_interval(secs=seconds)
    text = F.concat(F.lit(" "), "o_orderpriority", F.lit("_x000D_\n "), "o_orderstatus")
    return o.select("o_orderkey", tx.fmt_cell(at, "timestamp_ntz").alias("shown"), tx.fmt_cell(text).alias("line"))


@query("""SELECT conv_id, turn, CASE WHEN (conv_id + turn) % 3 = 1 AND role <> '' THEN role || '/' || turn END AS model FROM conversations""")
def model_prefix(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    k = (F.col("conv_id") + F.col("turn")) % 3
    name = F.concat("role", F.lit("/"), F.col("turn").cast("string"))
    asked = F.when(k == 0, name).when(k == 1, F.concat(F.lit(" Local/"), name)).otherwise(F.lit("local/"))
    return c.select("conv_id", "turn", tx.prefixed_model(asked, "local").alias("model"))


@query("""SELECT conv_id, trim(regexp_replace(string_agg(text, chr(10) ORDER BY turn), '\\s*\\n+\\s*', ' / ', 'g')) AS line FROM conversations GROUP BY 1""")
def one_line(spark, sf_dir):
    whole = segments.joined_text(table(spark, sf_dir, "conversations"), "conv_id", "turn")
    return whole.select("conv_id", tx.one_line(F.col("text")).alias("line"))


@query("""SELECT conv_id, turn, text FROM conversations WHERE role = 'user' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) = 2""")
def nth_occurrence(spark, sf_dir):
    said = table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", "text")
    return segments.nth_occurrence(said, ["conv_id"], ["turn"], 2)


@query("""SELECT CAST(conv_id AS VARCHAR) AS stream_id, coalesce(bool_and(turn % 2 = 0 OR trim(text) = ''), true) AND NOT bool_or(turn % 5 = 4) AS empty FROM conversations GROUP BY 1""")
def empty_streams(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    text = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("<think>"), F.lit("x"), F.lit("</think> "))).otherwise(F.col("text"))
    channel = F.when(F.col("turn") % 5 == 4, "tool").otherwise("content")
    return segments.empty_streams(c.select(F.col("conv_id").cast("string").alias("stream_id"), F.col("turn").alias("seq"), channel.alias("channel"), text.alias("text")))


@query("""SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN reverse(text) ELSE text END AS text, role, 'end ' || turn AS last FROM conversations""")
def multimodal_parts(spark, sf_dir):
    """The first text part of every other message is put in place reversed; its other parts and other messages stay."""
    c = table(spark, sf_dir, "conversations")
    part = lambda kind, text: F.struct(F.lit(kind).alias("type"), text.alias("text"))
    end = F.concat(F.lit("end "), F.col("turn").cast("string"))
    messages = c.select("conv_id", "turn", F.array(part("image", F.col("role")), part("text", F.col("text")), part("text", end)).alias("parts"))
    new = segments.text_parts(messages).where("part = 1 and turn % 2 = 0").withColumn("text", F.reverse("text"))
    put = segments.put_parts(messages, new)
    return put.select("conv_id", "turn", F.col("parts")[1]["text"].alias("text"), F.col("parts")[0]["text"].alias("role"), F.col("parts")[2]["text"].alias("last"))


# ---- cell grids ------------------------------------------------------------------------------------------------

COLUMNS = ["p_partkey", "p_name", "p_brand", "p_type", "p_size"]
CELLS = "cells AS (SELECT 'book' || (p_partkey // 1000) AS doc_id, 'Sheet1' AS sheet, unnest([1, 2, 3, 4, 5]) AS col, CAST(row_number() OVER (PARTITION BY p_partkey // 1000 ORDER BY p_partkey) + 1 AS INTEGER) AS row, unnest([CAST(p_partkey AS VARCHAR), p_name, p_brand, p_type, CAST(p_size AS VARCHAR)]) AS value FROM part UNION ALL SELECT DISTINCT 'book' || (p_partkey // 1000), 'Sheet1', unnest([1, 2, 3, 4, 5]), 1, unnest(['p_partkey', 'p_name', 'p_brand', 'p_type', 'p_size']) FROM part)"


def cells(spark, sf_dir):
    """Books of a thousand parts each, so that their number grows with the table and not their size."""
    p = table(spark, sf_dir, "part").withColumn("book", F.concat(F.lit("book"), F.expr("p_partkey div 1000").cast("string")))
    p = p.withColumn("r", F.row_number().over(Window.partitionBy("book").orderBy("p_partkey")))
    return grid.from_table(p, F.col("book"), F.col("r"), COLUMNS)


@query(f"WITH {CELLS} SELECT doc_id, sheet, 'C' || row AS address, row, value FROM cells WHERE col = 3 AND row > 1")
def read_column(spark, sf_dir):
    return grid.read_column(cells(spark, sf_dir), "P_BRAND")


@query(f"WITH {CELLS} SELECT doc_id, sheet, max(row) AS n_rows, max(col) AS n_cols, 'p_partkey | p_name | p_brand | p_type | p_size' AS first_row FROM cells GROUP BY ALL")
def list_tables(spark, sf_dir):
    return grid.table_overview(cells(spark, sf_dir))


@query(f"WITH {CELLS} SELECT doc_id, sheet, row, CASE WHEN col >= 3 THEN col + 1 ELSE col END AS col, value FROM cells UNION ALL SELECT DISTINCT doc_id, sheet, row, 3, CASE WHEN row = 1 THEN 'checked' ELSE 'no' END FROM cells")
def add_column(spark, sf_dir):
    x = cells(spark, sf_dir)
    return grid.add_column(x, grid.resolve_column(x, "p_brand"), "checked", F.lit("no"))


@query(f"WITH {CELLS} SELECT doc_id, sheet, row, CASE WHEN col > 2 THEN col - 1 ELSE col END AS col, value FROM cells WHERE col <> 2")
def delete_column(spark, sf_dir):
    x = cells(spark, sf_dir)
    return grid.delete_column(x, grid.resolve_column(x, "B"))


@query(f"WITH {CELLS} SELECT doc_id, sheet, row, col, value FROM cells UNION ALL SELECT doc_id, sheet, CAST(max(row) + 1 AS INTEGER), 1, 'total' FROM cells GROUP BY ALL")
def add_row(spark, sf_dir):
    x = cells(spark, sf_dir)
    new = x.select("doc_id", "sheet").distinct().select("doc_id", "sheet", F.lit(1).alias("k"), F.lit(1).alias("col"), F.lit("total").alias("value"))
    return grid.add_rows(x, new)


@query(f"WITH {CELLS} SELECT doc_id, sheet, row, col, CASE WHEN col = 2 AND row % 10 = 0 THEN 'x' ELSE value END AS value FROM cells")
def set_cells(spark, sf_dir):
    x = cells(spark, sf_dir)
    return grid.set_cells(x, x.where("col = 2 and row % 10 = 0").withColumn("value", F.lit("x")))


@query(f"WITH {CELLS} SELECT doc_id, sheet, row, col, replace(value, 'ring', 'RING') AS value, CAST((length(value) - length(replace(value, 'ring', ''))) / 4 AS INTEGER) AS hits FROM cells")
def replace_in_cells(spark, sf_dir):
    return grid.replace_text(cells(spark, sf_dir), "ring", "RING").select("doc_id", "sheet", "row", "col", "value", "hits")


@query(f"WITH {CELLS}, l AS (SELECT doc_id, sheet, row, '| ' || string_agg(value, ' | ' ORDER BY col) || ' |' || CASE WHEN any_value(row) = 1 THEN chr(10) || '| --- | --- | --- | --- | --- |' ELSE '' END AS line FROM cells GROUP BY doc_id, sheet, row) SELECT doc_id, sheet, string_agg(line, chr(10) ORDER BY row) AS markdown FROM l GROUP BY doc_id, sheet")
def grid_markdown(spark, sf_dir):
    return grid.rows_to_markdown(cells(spark, sf_dir))


@query(f"WITH {CELLS} SELECT DISTINCT doc_id, sheet, 1 AS header_row FROM cells")
def header_row(spark, sf_dir):
    return grid.guess_header_row(cells(spark, sf_dir))


@query("""WITH s AS (SELECT doc_id, CAST(k - 1 AS INTEGER) AS seg_idx, l AS text FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents)),
n AS (SELECT doc_id, seg_idx, 0 AS side, 0 AS k, text FROM s UNION ALL SELECT doc_id, seg_idx, 1, unnest([0, 1]), unnest(['first line', 'second line']) FROM s WHERE seg_idx = 0)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY seg_idx, side, k) - 1 AS INTEGER) AS seg_idx, text FROM n""")
def insert_rows(spark, sf_dir):
    s = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("seg_idx", "text"))
    return segments.insert_lines(s, "doc_id", "seg_idx", s.where("seg_idx = 0").select("doc_id", "seg_idx"), F.array(F.lit("first line"), F.lit(" "), F.lit("second line")))


@query("""WITH s AS (SELECT doc_id, CAST(k - 1 AS INTEGER) AS seg_idx, l AS text FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents))
SELECT doc_id, seg_idx, CASE WHEN seg_idx % 2 = 1 THEN reverse(text) ELSE text END AS text, seg_idx % 2 = 1 AND reverse(text) <> text AS changed FROM s""")
def apply_segments(spark, sf_dir):
    s = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("seg_idx", "text"))
    return segments.apply_segments(s, s.where("seg_idx % 2 = 1").withColumn("text", F.reverse("text")), ["doc_id", "seg_idx"])
