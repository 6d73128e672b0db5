"""Detection on inline rows: patterns, overlaps, expansion, numbers, chunks."""

from pyspark.sql import functions as F

from pseudolake.functions import catalog as cat
from pseudolake.functions import text as tx
from pseudolake.operators import detect


def spans_of(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = df.select("doc_id", F.inline(detect.resolve_overlaps(detect.regex_spans(F.col("text"))))).collect()
    return [[(r.type, r.value) for r in sorted(rows, key=lambda r: r.start) if r.doc_id == k] for k in range(len(texts))], rows


def test_patterns(spark):
    texts = [
        "в АО НПФ Благосостояние выполнило ООО «Ромашка»; фонд оплаты труда и банк данных",
        "www.iris-retail.ru, и https://portal.example-iris.ru/docs?id=42&page=1. а также пример.рф; почта a.b@c-d.ru; report.docx 3.14",
        "7 432 480,00 и 83 600,00; 5 186 720,00 руб; 1,5 млн рублей; 101000; 614087",
        "Вдовин Д.В. и А. Б. Петров",
        "паспорт 4510 123456, ИНН 7701234567, +7 (900) 123-45-67",
        "1 586 238,422 ₽\n51903.14 $",
        None,
        "",
    ]
    got, rows = spans_of(spark, texts)
    assert got[0] == [("ORG", "АО НПФ Благосостояние"), ("ORG", "ООО «Ромашка»")]
    assert got[1] == [("WEB", "www.iris-retail.ru"), ("WEB", "https://portal.example-iris.ru/docs?id=42&page=1"), ("WEB", "пример.рф"), ("EMAIL", "a.b@c-d.ru")]
    assert [v for _, v in got[2]] == ["7 432 480,00", "83 600,00", "5 186 720,00 руб", "1,5 млн рублей"]
    assert [v for t, v in got[3] if t == "PERSON"] == ["Вдовин Д.В.", "А. Б. Петров"]
    assert {t for t, _ in got[4]} >= {"PASSPORT", "INN", "PHONE"}
    assert [v for _, v in got[5]] == ["1 586 238,422 ₽", "51903.14 $"]
    assert got[6] == got[7] == []
    assert all(texts[r.doc_id][r.start : r.end].strip() == r.value for r in rows)


def expand(spark, text, found):
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    spans = spark.createDataFrame([(1, a, b, text[a:b], t, 0.9) for a, b, t in found], "doc_id long, start int, end int, value string, type string, confidence double")
    return sorted((r.start, r.end, r.value) for r in detect.expand_occurrences(detect.quoted_cores(spans, df), df).collect())


def at(text, value, kind="ORG"):
    return (text.index(value), text.index(value) + len(value), kind)


def test_expansion(spark):
    t = "Ирис рос. ирис цвёл, Ирис, ирисы"
    assert len(expand(spark, t, [at(t, "Ирис")])) == 3
    t = "АО НПФ Благосостояние; АО НПФ Благосостояние; Благосостояние"
    got = expand(spark, t, [at(t, "АО НПФ Благосостояние"), at(t, "Благосостояние")])
    assert [b - a for a, b, _ in got] == [21, 21, 14]
    assert len(expand(spark, "Я Я Я", [(0, 1, "PERSON")])) == 1
    t = "ИС с рисками сервиса. Подпись, ис, и снова ИС"
    assert len(expand(spark, t, [at(t, "ИС")])) == 2
    t = "ООО «ИРИС» и ИРИС, Ирис? ИРИС!"
    assert [v for _, _, v in expand(spark, t, [at(t, "ООО «ИРИС»")])] == ["ООО «ИРИС»", "ИРИС", "ИРИС"]
    t = "1C (latin) 1С и 1С"
    assert len(expand(spark, t, [at(t, "1C")])) == 3
    t = "Сумма 7 432 480,00 итого"
    assert [v for _, _, v in expand(spark, t, [at(t, "480,00", "MONEY")])] == ["7 432 480,00"]


def test_numbers_places_and_chunks(spark):
    cases = [("Сумма 7 432 480,00 итого", "432", "7 432 480,00"), ("386 887,422", "887", "386 887,422"), ("386887.422", "386887", "386887.422"), ("Цена 1 500 000 руб.", "1 500", "1 500 000"), ("1500 руб.", "1500", "1500")]
    df = spark.createDataFrame([(t, t.index(v), t.index(v) + len(v), w) for t, v, w in cases], "t string, a int, b int, w string")
    got = df.select("t", "w", detect.extend_numbers(F.col("t"), F.col("a"), F.col("b")).alias("p")).collect()
    assert all(r.t[r.p.start : r.p.end] == r.w for r in got)
    one = spark.createDataFrame([("aaa.aa", "aa"), ("x", "aa"), ("q\\Ez", "\\E")], "t string, v string")
    assert [r[0] for r in one.select(tx.places(F.col("t"), F.col("v"))).collect()] == [[0, 1, 4], [], [1]]
    text = "\n".join(f"line {k} " + "y" * (k % 30) for k in range(80))
    r = spark.createDataFrame([(text,)], "t string").select(detect.chunk_bounds(F.col("t"), 1000, 200).alias("c")).first()
    assert r.c[0].start == 0 and r.c[-1].end == len(text)
    assert all(b.start == a.end - 200 and text[a.end - 1] == "\n" and a.end - a.start <= 1000 for a, b in zip(r.c, r.c[1:]))
    ok = [("Иван Петров", "Иван Петров", 0, 11), ("В ООО Ромашка", "ООО Ромашка", 5, 10), ("нет", "Иван", 0, 4)]
    v = spark.createDataFrame(ok, "t string, v string, a int, b int").select(detect.validate_offsets(F.col("t"), F.col("v"), F.col("a"), F.col("b")).alias("p")).collect()
    assert [(x.p.start, x.p.end) if x.p else None for x in v] == [(0, 11), (2, 13), None]


def test_model_slot_tells_failures(spark):
    df = spark.createDataFrame([(1, "z" * 150 + "Иванов"), (2, "boom"), (3, None)], "doc_id long, text string")

    def load():
        good = detect.gazetteer({"Иванов": "PERSON"})()

        def predict(texts):
            if texts[0] == "boom":
                raise ValueError
            return [[(t.index("Иванов"), t.index("Иванов") + 6, "PERSON", 0.9)] if "Иванов" in t else [] for t in texts] or good(texts)

        return predict

    got = {(r.doc_id, r.start, r.failed) for r in detect.model_spans(df, load, size=100, overlap=20).collect()}
    assert got == {(1, 150, False), (2, None, True)}
    exact, model = (detect.span(F.lit(a), F.lit(b), F.lit(v), F.lit("PERSON"), F.lit(1.0)) for a, b, v in ((0, 4, "Иван"), (0, 11, "Иван Петров")))
    r = df.limit(1).select(detect.merge_spans(F.array(exact), F.array(model)).alias("s")).first()
    assert [s.value for s in r.s] == ["Иван Петров"]
    assert len(cat.CATALOG) == 21
