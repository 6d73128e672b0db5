from pseudolake.sources import sinks


def test_reviews_can_be_written_again(spark, tmp_path):
    path, schema = str(tmp_path / "reviews"), "session_id string, request_id string, text string"
    first = spark.createDataFrame([("a", "r1", "[PERSON_1] said\nso"), ("a", "r2", "two"), ("b", "r1", "é"), ("c", "r1", None)], schema)
    sinks.write_review(first, path)
    sinks.write_review(first, path)
    sinks.write_review(spark.createDataFrame([("a", "r2", "new"), ("a", "r3", "three")], schema), path)
    got = spark.read.text(path, wholetext=True).collect()
    assert sorted((r.session_id, r.request_id, r.value.rstrip("\n")) for r in got) == [
        ("a", "r1", "[PERSON_1] said\nso"), ("a", "r2", "new"), ("a", "r3", "three"), ("b", "r1", "é"),
    ]
    sinks.write_review(first.where("false"), path)
    assert spark.read.text(path, wholetext=True).count() == 4


def test_vault_is_appended_once(spark, tmp_path):
    path = str(tmp_path / "vault")
    rows = spark.createDataFrame([("a", "[PERSON_1]", "Ann", "PERSON"), ("a", "[PERSON_2]", "Bob", "PERSON")], "session_id string, token string, original_value string, entity_type string")
    sinks.append_vault(rows, path)
    sinks.append_vault(rows, path)
    assert spark.read.parquet(path).count() == 2
