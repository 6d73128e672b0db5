import random

from pseudolake.llm import language

VOCAB = {"aa": "the of and with this there which".split(), "bb": "der die und nicht mit über straße".split(), "cc": "el los que está niño pero como".split()}


def docs(rng, n):
    return [(i, lang, " ".join(rng.choice(VOCAB[lang]) for _ in range(rng.randint(3, 80)))) for i in range(n) for lang in [rng.choice(list(VOCAB))]]


def test_learns_and_predicts(spark):
    rng = random.Random(2)
    rows = docs(rng, 300)
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    langs, logp = language.train(df)
    assert langs == ["aa", "bb", "cc"]
    mixed = " ".join(VOCAB["aa"] * 6) + " " + " ".join(VOCAB["bb"] * 3)
    odd = [(1000, None, None), (1001, None, ""), (1002, None, "12 34 !?"), (1003, None, "¿¡ — 12"), (None, None, "the and"), (1004, None, mixed), (1005, None, "der " * 50000), (0, "aa", "the of"), (0, "aa", "the of"), (1006, None, "日本語")]
    test = spark.createDataFrame(rows + odd, "doc_id long, lang string, text string").selectExpr("*", "1 as score")
    got = language.identify(test, langs, logp).collect()
    assert len(got) == len(rows) + len(odd)
    truth = {i: lang for i, lang, _ in rows}
    pred = {r.doc_id: r for r in got}
    assert sum(pred[i].lang_pred == truth[i] for i in range(1, 300)) >= 297
    assert all(pred[i].lang_pred == "und" and pred[i].score == 0 for i in (1000, 1001, 1002, 1003))
    assert pred[1004].lang_pred == "aa" and 0.5 < pred[1004].score < 0.8 and sum(x > 0.1 for x in pred[1004].proportions) == 2
    assert pred[1005].lang_pred == "bb" and pred[1006].lang_pred in langs
    none = language.identify(test, *language.train(df.limit(0)))
    assert {r.lang_pred for r in none.collect()} == {"und"}
    assert language.identify(test.limit(0), langs, logp).count() == 0
