import duckdb
import pytest

import __spark_entry__ as entry
from pseudolake.operators import metadata

VAULT = "session_id string, token string, original_value string, entity_type string"


def test_names_become_tokens(spark):
    known = spark.createDataFrame([("a", "[PERSON_4]", "Ann", "PERSON"), ("b", "[PERSON_9]", "Bob", "PERSON")], VAULT)
    rows = [
        (1, "a", {"comment_author": "Bob", "reviewer": "Ann", "author": "Ann", "company": "X", "title": "t"}),
        (2, "a", {"comment_author": "Bob", "reviewer": "Cid", "subject": None}),
        (2, "a", {"comment_author": "Dot"}),
        (3, "b", {"comment_author": "Bob", "reviewer": " "}),
        (4, None, {"comment_author": "Bob"}),
        (5, "a", None),
        (6, "a", {}),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, session_id string, metadata map<string,string>")
    done, new = metadata.scrub_authors(docs, known)
    got = sorted(((r.doc_id, r.metadata) for r in done.collect()), key=str)
    want = [
        (1, {"comment_author": "[PERSON_5]", "reviewer": "[PERSON_4]", "author": "", "title": "t"}),
        (2, {"comment_author": "[PERSON_5]", "reviewer": "[PERSON_7]", "subject": None}),
        (2, {"comment_author": "[PERSON_6]"}),
        (3, {"comment_author": "[PERSON_9]", "reviewer": ""}),
        (4, {"comment_author": ""}),
        (5, None),
        (6, {}),
    ]
    assert got == sorted(want, key=str)
    assert {(r.original_value, r.token) for r in new.collect()} == {("Bob", "[PERSON_5]"), ("Dot", "[PERSON_6]"), ("Cid", "[PERSON_7]")}
    none = metadata.scrub_authors(docs.where("false"), known.where("false"))
    assert none[0].count() == none[1].count() == 0


@pytest.mark.parametrize("sf", ["0.001"])
def test_author_tokens_equal_sql(spark, sf):
    d = f"/root/testdata/sf{sf}"
    got = entry.queries()["author_tokens"](spark, d)
    con = duckdb.connect()
    for t in ("orders", "customer"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    want = con.sql(entry.oracle_sql()["author_tokens"]).fetchall()
    assert len(want) > 100 and sorted(map(tuple, got.collect())) == sorted(want)
