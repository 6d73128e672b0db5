"""Queries with models that are trained here: labels of commands, a second recogniser, a cache of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cache, detect, recogniser, scorer, vault
from ..sources.shared import spread
from .queries import query, table

# Labels of commands with their descriptions.
COMMANDS = {"backend_local": "команда переключения на локальную модель", "backend_cloud": "команда переключения на облако", "deanon_files": "команда деанонимизации файлов целиком"}
#: Commands as people may say them; none is a description.
SAID = ("переключи на локальную модель", "вернись на облако, пожалуйста, переключение", "нужна деанонимизация файлов целиком")
#: Scores that count as a command; messages without one stay under half of it.
FLOOR = 0.05


@query("SELECT conv_id * 100 + turn AS id, CASE (conv_id + turn) % 4 " + " ".join(f"WHEN {k} THEN '{name}'" for k, name in enumerate(COMMANDS)) + " END AS label FROM conversations WHERE text IS NOT NULL")
def command_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The label of each message, of which three quarters end in a line with a command; weights are learned from all messages."""
    c = spread(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), "conv_id")
    k = (F.col("conv_id") + F.col("turn")) % 4
    said = F.coalesce(*[F.when(k == i, F.lit("\n" + s)) for i, s in enumerate(SAID)], F.lit(""))
    row = F.struct("conv_id", "turn", F.monotonically_increasing_id().alias("row"))  # ids made of conv_id and turn clash from turn 100 on
    texts = c.select(row.alias("id"), F.concat("text", said).alias("text"))
    scores = scorer.label_scores(texts, COMMANDS, scorer.ngram_scorer(scorer.ngram_weights(texts)))
    return vault.classify_by_labels(scores.where("not failed"), FLOOR).select((F.col("id.conv_id") * 100 + F.col("id.turn")).alias("id"), "label")


# What invented names and the sentences around them are made of.
SYLLABLES = ("ба", "ве", "го", "ди", "зо", "ку", "ла", "ме", "ни", "ро", "са", "тю")
GIVEN = ("Иван", "Мария", "Пётр", "Анна", "Олег", "Ольга", "Сергей", "Елена")
ENDINGS = {"PERSON": ("нов", "лин", "сова", "ский"), "LOC": ("град", "ск", "бург"), "ORG": ("строй", "нефть", "торг")}
SENTENCES = (
    "Договор подписал {PERSON} , директор компании {ORG} .", "{PERSON} живёт в городе {LOC} .", "В городе {LOC} открылся филиал компании {ORG} .", "По словам {PERSON} , {ORG} переезжает в {LOC} .",
    "Сегодня утром на улице шёл дождь , и Банк был закрыт .", "Компания {ORG} и {PERSON} заключили сделку .", "Вчера {PERSON} встретился с представителем {ORG} в {LOC} .",
)


def invented(k: Column, sentence: Column) -> tuple[Column, Column]:
    """A sentence with names that follow from a whole number, and its spans."""
    pick = lambda of, i: F.element_at(F.array(*map(F.lit, of)), (i % len(of) + 1).cast("int"))
    n = F.abs(F.xxhash64(k) % 1_000_003)
    stem = lambda shift: F.initcap(F.concat(pick(SYLLABLES, n + shift), pick(SYLLABLES, F.floor(n / 12) + shift)))
    names = {kind: F.concat(stem(3 * i), pick(ends, F.floor(n / 144) + i)) for i, (kind, ends) in enumerate(ENDINGS.items())}
    names["PERSON"] = F.concat(pick(GIVEN, F.floor(n / 7)), F.lit(" "), names["PERSON"])
    text = pick(SENTENCES, sentence)
    for kind, name in names.items():
        text = F.replace(text, F.lit("{" + kind + "}"), name)
    at = {kind: F.instr(text, name) for kind, name in names.items()}
    spans = F.array(*[F.struct((at[kind] - 1).cast("int").alias("start"), (at[kind] - 1 + F.length(name)).cast("int").alias("end"), F.lit(kind).alias("type")) for kind, name in names.items()])
    return text, F.filter(spans, lambda s: s["start"] >= 0)


def labelled(spark: SparkSession, sf_dir: str, held_out: bool) -> DataFrame:
    """(text, spans): a sentence for each order, and the beginning of each document, which has no names.

    Those of every fourth order or document, and all sentences of the last kind, are held out.
    """
    k = F.col("o_orderkey")
    text, spans = invented(k, k)
    own = (k % 4 == 0) | (k % len(SENTENCES) == len(SENTENCES) - 1)
    named = table(spark, sf_dir, "orders").where(own if held_out else ~own).select(text.alias("text"), spans.alias("spans"))
    d = table(spark, sf_dir, "documents").where((F.col("doc_id") % 4 == 0) == held_out)
    start = F.regexp_replace(F.substring_index("text", ".", 3), r"\s+", " ")
    return named.unionByName(d.select(start.alias("text"), F.array().cast("array<struct<start:int,end:int,type:string>>").alias("spans")))


@query()
def second_recogniser(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of the second recogniser in all documents, each of which ends in a held-out sentence on a line of its own; failed = true tells of a document that it failed on."""
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    text, _ = invented(-F.col("doc_id") - 1, F.lit(len(SENTENCES) - 1))
    docs = d.select("doc_id", F.concat_ws("\n", "text", text).alias("text"))
    load = recogniser.recogniser(recogniser.learned(labelled(spark, sf_dir, False)))
    return recogniser.second_pass_spans(docs, load)


@query("""WITH d AS (SELECT sha256(text) AS key, min(doc_id) FILTER (doc_id % 2 = 0) AS early, min(doc_id) AS first, min(text) AS text FROM documents WHERE text IS NOT NULL GROUP BY 1),
n AS (SELECT *, row_number() OVER (ORDER BY early IS NULL, coalesce(early, first)) AS seq FROM d)
SELECT key, seq, CASE WHEN contains(text, 'Apache License') THEN 1 ELSE 0 END AS licensed, 0::BIGINT AS third_run FROM n WHERE seq > (SELECT max(seq) FROM n) - (SELECT count(*) FROM n) * 3 // 4""")
def cached_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cache after three runs: even documents, all documents, and all again, which shows the model nothing; a quarter is evicted then."""
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    load = detect.gazetteer({"Apache License": "PRODUCT"})
    _, first, _ = cache.cached_spans(d.where("doc_id % 2 = 0"), cache.empty_cache(spark), load)
    _, second, _ = cache.cached_spans(d, first, load)
    _, third, again = cache.cached_spans(d, second, load, limit=second.count() * 3 // 4)
    return third.select("key", "seq", (F.size("spans") > 0).cast("int").alias("licensed"), F.lit(again.count()).cast("long").alias("third_run"))
