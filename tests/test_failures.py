from datetime import datetime, timedelta

from pyspark.sql import functions as F

from pseudolake.functions import catalog as cat
from pseudolake.operators import detect, vault
from pseudolake.operators.cells import rows_to_markdown
from pseudolake.plans import jobs
from pseudolake.streaming import restore


def test_a_failed_model_withholds_the_text(spark):
    docs = spark.createDataFrame([(1, "s", "a@corp.example bad"), (2, "s", "b@corp.example good"), (3, "s", None)], "doc_id long, session_id string, text string")

    def load():
        def predict(texts):
            if "bad" in texts[0]:
                raise ValueError
            return [[] for _ in texts]

        return predict

    model = detect.model_spans(docs.select("doc_id", "text"), load)
    spans = detect.detect(docs.select("doc_id", "text"), model=model).collect()
    assert {(r.doc_id, r.value, r.failed) for r in spans if r.type in ("EMAIL", None)} == {(1, None, True), (2, "b@corp.example", False)}
    texts, new, _ = jobs.anonymize_texts(docs, model=model, catalog=cat.only("EMAIL"))
    assert {(r.doc_id, r.text, r.failed) for r in texts.collect()} == {(1, None, True), (2, "[EMAIL_1] good", False), (3, None, False)}
    assert [r.original_value for r in new.collect()] == ["b@corp.example"]


def test_duplicates_within_ten_minutes_of_the_one_kept(spark):
    t = datetime(2024, 1, 1, 0, 9, 50)
    at = [0, 20, 599, 600, 900, 1199, 1200, 5000]
    rows = [("k", t + timedelta(seconds=s), s) for s in at] + [("j", t, 1), ("j", t, 0), ("j", None, 7)]
    df = spark.createDataFrame(rows, "key string, ts timestamp, n int")
    got = restore.coalesce_duplicates(df, ["key"])
    assert got.columns == df.columns
    assert sorted((r.key, r.n) for r in got.collect()) == [("j", 0), ("j", 7), ("k", 0), ("k", 600), ("k", 1200), ("k", 5000)]


def test_needs_are_no_narrower_than_patterns(spark):
    df = spark.createDataFrame([("сумма ١٢٣٤٥ руб",), ("сумма 12345 руб",)], "text string")
    got = df.select(F.size(detect.regex_spans(F.col("text"), cat.only("MONEY"))).alias("n")).collect()
    assert got[0].n == got[1].n > 0


def test_hash_tokens_of_clashing_values_differ(spark):
    spans = spark.createDataFrame([("s", f"v{k}", "ORG", 1, k) for k in range(50)], "session_id string, value string, type string, doc_id long, start int")
    none = jobs.empty_vault(spans)
    new = vault.assign_tokens(spans, none, ["doc_id"], "hash")
    first = new.where("original_value = 'v0'").select("session_id", "token", F.lit("another value").alias("original_value"), "entity_type")
    again = vault.assign_tokens(spans, first, ["doc_id"], "hash").collect()
    assert len({r.token for r in again} | {first.first().token}) == 51
    assert {r.token for r in new.where("original_value <> 'v0'").collect()} <= {r.token for r in again}


def test_repeated_rows_of_maps(spark):
    cells = spark.createDataFrame([("d", "s", 1, 1, "b"), ("d", "s", 1, 1, "a"), ("d", "s", 2, 1, "c")], "doc_id string, sheet string, row int, col int, value string")
    assert rows_to_markdown(cells).first().markdown == "| a |\n| --- |\n| c |"
    known = spark.createDataFrame([("s", "[ORG_1]", "x"), ("s", "[ORG_1]", "x"), ("s", "[ORG_1]", "w")], "stream_id string, token string, original_value string")
    chunks = spark.createDataFrame([("s", "content", 0, "a [ORG_", False), ("s", "content", 1, "1] b", True)], "stream_id string, channel string, seq long, text string, is_last boolean")
    folder = restore.restore_all(chunks, known, __import__("tempfile").mkdtemp(prefix="spark-"))
    assert restore.collected(folder).first().text == "a w b"
