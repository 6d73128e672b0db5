import re

from pseudolake.plans import queries


def test_no_document_is_left_out(spark, tmp_path):
    texts = ["worthless worthless, worthless.", "a worthless, unworthless b\nworthless", "ÉTÉ À Nîmes", "Straße", "Ёлка", "Licensed under the Apache License worthless", "", None]
    rows = [(k, t, "fr" if k % 3 == 2 else None if k % 3 else "en") for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    want = {k: t and re.sub(r"\bworthless\b", "[MISC_2]", t.replace("Licensed under the Apache License", "[PRODUCT_1]")) for k, t in enumerate(texts)}
    assert {r.doc_id: r.text for r in queries.QUERIES["replace_by_value"](spark, str(tmp_path)).collect()} == want
    norm = {r.doc_id: r.norm for r in queries.QUERIES["normalize_search"](spark, str(tmp_path)).collect()}
    assert set(norm) == set(want) and norm[0] == texts[0] and norm[2] == "été à nîmes" and norm[7] is None
