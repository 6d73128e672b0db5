"""Information-theoretic sanitisation of personal data, native: DataFrame functions only.

Base spans (e-mail, IP address, card, phone) come from fixed patterns and checks. Each distinct value is a protected
entity, and so is what values have in common: an address's domain, a network, a card's issuer, a phone's area. Terms are
the words of three letters or more anywhere in a document, outside base spans. Over all documents
    disclosure(t, e) = PMI(t, e) / IC(e) * n_te / (n_te + DOUBT),  PMI = ln(N * n_te / (n_t * n_e)),  IC = ln(N / n_e)
says how much of the entity's information a term gives away (1 if it occurs nowhere else), shrunk where few documents
tell: one alone, in which every rare word would point to every entity, proves nothing. A term is generalised from
GENERALISE on and removed from REMOVE on, wherever it stands in a document that holds the entity. Spans of both
kinds are added after the base spans, which stay. Copies are documents too: rare words that all copies of a text share
with an entity do point to it, so a corpus with copies had better be deduplicated before.

Counts cover all documents and whole texts; nothing but numbers of rows reaches the driver. Terms meet the entities of
their document only where their counts allow a disclosure.

A null text counts as empty and has no spans; documents of N include it. Repeated rows (same id and text)
count as documents of their own and get the same spans. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table

KINDS = ("email", "ip", "card", "phone")
#: Fixed patterns in Java's dialect; possessive where the next character can't belong to the run before,
#: and begun only at the start of a run (or where the last match ended), so that long runs stay linear.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text needs for a match at all.
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9][ -]?[0-9]", "phone": r"\+[0-9]"}
DOUBT, GENERALISE, REMOVE = 0.5, 0.75, 0.9
#: Copies of a join key's rows that share a hot entity's occurrences.
SALT = 16

_SPAN = "array<struct<kind:string,start:int,end:int,value:string>>"
_WORD = r"\p{L}{3,}"


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _luhn(v: Column) -> Column:
    d = _digits(v)
    n = F.length(d)

    def weigh(i: Column) -> Column:
        x = F.substring(d, i, F.lit(1)).cast("int")
        return F.when((n - i) % 2 == 0, x).otherwise(F.when(x > 4, 2 * x - 9).otherwise(2 * x))

    total = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda a, i: a + weigh(i))
    return n.between(16, 19) & (F.when(n.between(16, 19), total).otherwise(1) % 10 == 0)


VALID = {
    "email": lambda v: F.lit(True),
    "ip": lambda v: F.forall(F.split(v, r"\."), lambda p: p.rlike("^0*(?:[0-9]{1,2}|1[0-9][0-9]|2[0-4][0-9]|25[0-5])$")),
    "card": _luhn,
    "phone": lambda v: F.length(_digits(v)).between(8, 15),
}


def _matches(text: Column, pattern: str, kind: Column) -> Column:
    """All matches as structs; their places from the lengths of matches and of what lies between."""
    pairs = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda g, m: F.struct(g.alias("g"), m.alias("m")))
    zero = F.struct(F.lit(0).alias("pos"), F.array().cast(_SPAN).alias("out"))

    def add(a: Column, x: Column) -> Column:
        start = a["pos"] + F.length(x["g"])
        end = start + F.length(x["m"])
        span = F.struct(kind.alias("kind"), start.alias("start"), end.alias("end"), x["m"].alias("value"))
        return F.when(x["m"].isNull(), a).otherwise(F.struct(end.alias("pos"), F.concat(a["out"], F.array(span)).alias("out")))

    return F.aggregate(pairs, zero, add, lambda a: a["out"])


def base_spans(text: Column) -> Column:
    """Valid matches by kind, then start."""

    def of(kind: str) -> Column:
        valid = F.filter(_matches(text, PATTERNS[kind], F.lit(kind)), lambda s: VALID[kind](s["value"]))
        return F.when(text.rlike(NEEDS[kind]), valid).otherwise(F.array().cast(_SPAN))

    return F.concat(*map(of, KINDS))


def row_key(text: Column) -> Column:
    """128 bits over id and text: what rows are found again by. Rows with the same id and text have the same spans."""
    return F.struct(F.xxhash64(F.col("doc_id"), text).alias("a"), F.xxhash64(F.lit(1), text, F.col("doc_id")).alias("b"))


def _entities(span: Column) -> Column:
    """What a base span names: its value, and the group that its value belongs to."""
    value = F.lower(span["value"])
    digits = _digits(value)
    group = (
        F.when(span["kind"] == "email", F.substring_index(value, "@", -1)).when(span["kind"] == "ip", F.substring_index(value, ".", 3))
        .when(span["kind"] == "card", F.substring(digits, 1, 6)).otherwise(F.substring(digits, 1, 4))
    )
    return F.array(F.concat_ws(":", span["kind"], value), F.concat_ws(":", span["kind"], F.lit("group"), group))


def _words(text: Column) -> Column:
    return F.transform(F.filter(F.split(text, r"[^\p{L}]+"), lambda w: F.length(w) >= 3), F.lower)


def _masked(text: Column, spans: Column) -> Column:
    """The text with base spans replaced by spaces."""
    zero = F.struct(F.lit(0).alias("pos"), F.array().cast("array<string>").alias("out"))

    def add(a: Column, s: Column) -> Column:
        gap = F.substring(text, a["pos"] + 1, F.greatest(F.lit(0), s["start"] - a["pos"]))
        return F.struct(F.greatest(a["pos"], s["end"]).alias("pos"), F.concat(a["out"], F.array(gap)).alias("out"))

    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], s["end"])))
    return F.aggregate(ordered, zero, add, lambda a: F.concat(F.array_join(a["out"], " "), F.lit(" "), F.substring(text, a["pos"] + 1, F.length(text))))


def _scan(docs: DataFrame) -> DataFrame:
    """(key, doc_id, spans) of all documents; with base spans also (text, entities, terms)."""
    rows = docs.select(F.col("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    spans = rows.select(row_key(F.col("text")).alias("key"), "doc_id", "text", base_spans(F.col("text")).alias("spans"))
    some = F.size("spans") > 0
    entities = F.array_distinct(F.flatten(F.transform("spans", _entities)))
    terms = F.array_distinct(_words(_masked(F.col("text"), F.col("spans"))))
    return spans.select("key", "doc_id", "spans", *[F.when(some, c).alias(n) for n, c in (("text", F.col("text")), ("entities", entities), ("terms", terms))])


def _word_counts(docs: DataFrame) -> DataFrame:
    """(term, n_t): the documents whose text holds a word; added up in each task before words are shuffled."""
    words = _words(F.coalesce(F.col("text").cast("string"), F.lit("")))
    return docs.select(F.explode(F.array_distinct(words)).alias("term")).groupBy("term").agg(F.count("*").alias("n_t"))


def disclosures(docs: DataFrame, scanned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entity, term, share) of disclosing terms, and (key, entity, term) of the documents' pairs whose counts allow a disclosure."""
    n = F.lit(float(max(scanned.count(), 1)))
    # the rows of a document get numbers apart, so that each counts as a document of its own
    hot = scanned.where(F.size("spans") > 0).withColumn("row", F.monotonically_increasing_id())
    held = hot.select("key", "row", F.explode("entities").alias("entity"), "terms")
    # a share can't exceed n_te / (n_te + DOUBT), and n_te is at most n_e
    least = GENERALISE * DOUBT / (1 - GENERALISE)
    counts = held.groupBy("entity").agg(F.count("*").alias("n_e"))
    counts = stored(counts.where((F.col("n_e") >= least * 0.999999) & (F.col("n_e") < n)))
    # nor does it reach GENERALISE if n_t is above n_te * (N / n_e) ** (1 - GENERALISE)
    most = F.col("n_e") * F.pow(n / F.col("n_e"), 1 - GENERALISE) * 1.000001
    met = stored(held.drop("terms").join(counts.withColumn("most", most), "entity"))
    words = hot.select("row", F.explode("terms").alias("term")).join(met.groupBy("row").agg(F.max("most").alias("row_most")), "row")
    words = stored(words)
    rare = words.join(_word_counts(docs), "term").where(F.col("n_t") <= F.col("row_most")).select("row", "term", "n_t")
    pairs = stored(met.join(rare, "row").where(F.col("n_t") <= F.col("most")).select("key", "entity", "term", "n_t", "n_e"))
    both = pairs.groupBy("entity", "term", "n_t", "n_e").agg(F.count("*").alias("n_te"))
    share = F.log(n * F.col("n_te") / (F.col("n_t") * F.col("n_e"))) / F.log(n / F.col("n_e")) * F.col("n_te") / (F.col("n_te") + DOUBT)
    told = both.withColumn("share", share).where(F.col("share") >= GENERALISE).select("entity", "term", "share")
    return told, pairs.select("key", "entity", "term")


def disclosing_terms(docs: DataFrame, scanned: DataFrame) -> DataFrame:
    """Spans to add: (key, start, end, kind), kind `generalise` or `remove`."""
    told, pairs = disclosures(docs, scanned)
    told = told.select("entity", "term", F.when(F.col("share") >= REMOVE, "remove").otherwise("generalise").alias("kind"))
    told = told.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    at = pairs.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALT)).cast("int"))
    kinds = at.join(told, ["entity", "term", "salt"]).groupBy("key", "term").agg(F.max("kind").alias("kind"))
    lists = kinds.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("term", "kind"))).alias("kinds"))
    hot = scanned.where(F.size("spans") > 0).select("key", "text", "spans").dropDuplicates(["key"]).join(lists, "key")
    found = hot.select("key", "spans", "kinds", F.explode(_matches(F.col("text"), _WORD, F.lit("term"))).alias("w"))
    found = found.withColumn("kind", F.try_element_at("kinds", F.lower(F.col("w.value")))).where("kind is not null")
    free = found.where(~F.exists("spans", lambda s: (s["start"] < F.col("w.end")) & (s["end"] > F.col("w.start"))))
    return free.select("key", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "kind")


def sanitise(docs: DataFrame) -> DataFrame:
    """For every row (key, doc_id, spans, added): base spans, and spans of disclosing terms by kind and start."""
    scanned = stored(_scan(docs))
    found = disclosing_terms(docs, scanned).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("kind", "start", "end"))).alias("added"))
    return scanned.select("key", "doc_id", "spans").join(found, "key", "left").withColumn("added", F.coalesce("added", F.array().cast("array<struct<kind:string,start:int,end:int>>")))


def redact(docs: DataFrame) -> DataFrame:
    """`docs` with the spans of `text` replaced: base spans and generalised terms by a name in brackets, removed terms by nothing.

    n_chars, where there is such a column, becomes the length of the new text; null texts stay null.
    """
    scanned = stored(_scan(docs))
    found = disclosing_terms(docs, scanned).groupBy("key").agg(F.collect_list(F.struct("start", "end", "kind")).alias("added_"))
    keyed = docs.select("*", row_key(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("key_"))
    text = F.col("text")
    base = F.transform(base_spans(text), lambda s: F.struct(s["start"], s["end"], s["kind"]))
    joined = keyed.join(found.withColumnRenamed("key", "key_"), "key_", "left")
    joined = joined.withColumn("spans_", F.array_sort(F.concat(base, F.coalesce("added_", F.array().cast("array<struct<start:int,end:int,kind:string>>")))))
    zero = F.struct(F.lit(0).alias("pos"), F.array().cast("array<string>").alias("out"))

    def add(a: Column, s: Column) -> Column:
        name = F.when(s["kind"] == "remove", "").when(s["kind"] == "generalise", "[TERM]").otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
        gap = F.substring(text, a["pos"] + 1, F.greatest(F.lit(0), s["start"] - a["pos"]))
        inside = s["start"] < a["pos"]
        return F.struct(F.greatest(a["pos"], s["end"]).alias("pos"), F.when(inside, a["out"]).otherwise(F.concat(a["out"], F.array(gap, name))).alias("out"))

    done = F.aggregate("spans_", zero, add, lambda a: F.concat(F.array_join(a["out"], ""), F.substring(text, a["pos"] + 1, F.length(text))))
    out = joined.withColumn("text", F.when(F.size("spans_") > 0, done).otherwise(text))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size("spans_") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(docs.columns)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sanitise(table(spark, sf_dir, "documents"))
    kinds = F.transform("spans", lambda s: s["kind"])
    counts = [(F.size("spans") - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in KINDS]
    base, more = _joined(F.col("spans")), _joined(F.col("added"))
    return found.select(
        "doc_id", *counts, F.sha2(base.cast("binary"), 256).alias("base_sha256"),
        F.concat_ws(",", F.when(base != "", base), F.when(more != "", more)).alias("spans"), F.size("added").cast("long").alias("n_terms"),
    )


QUERIES = {"op3_pii": op3_pii}
ORACLE_SQL: dict[str, str] = {}
