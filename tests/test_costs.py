"""What queries cost: nothing is computed again for each use or each key."""

import random
import re

from pyspark.sql import functions as F

from pseudolake.functions import text as tx
from pseudolake.operators import detect, segments
from pseudolake.plans import queries
from pseudolake.sources.shared import spread
from pseudolake.streaming import event_time, restore


def _regexes(spark, column, name="text"):
    """How many expressions with a regex a row of a projection evaluates, those in lambdas counted once."""
    plan = spark.createDataFrame([("x",)], f"{name} string").select(column.alias("out"))._jdf.queryExecution().analyzed().toString()
    return len(re.findall(r"regexp_extract_all\(|regexp_replace\(|split\(|RLIKE", plan))


def test_parsers_take_their_matches_once(spark):
    assert _regexes(spark, tx.parse_placeholder_spec(F.col("text"))) < 20
    assert _regexes(spark, tx.parse_value_list(F.col("text"))) < 20


def test_a_pattern_runs_over_a_text_once(spark):
    # the second way, for texts with the mark, isn't evaluated on others
    assert _regexes(spark, tx.matches(F.col("text"), "a")) == 4


def test_matches_of_texts_with_marks(spark):
    rows = {"a b\x00c a": [(0, 1, "a"), (6, 7, "a")], "\x00": [], "aa": [(0, 1, "a"), (1, 2, "a")], "": [], "я$1a\\": [(3, 4, "a")]}
    df = spark.createDataFrame([(t,) for t in rows], "text string")
    got = {r.text: [(m.start, m.end, m.value) for m in r.m] for r in df.select("text", tx.matches(F.col("text"), "a").alias("m")).collect()}
    assert got == rows


def test_dealing_out_by_a_key_leaves_joins_their_own_shuffle(spark):
    docs = spread(spark.range(100).coalesce(1), "id")
    plan = docs._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(xxhash64" in plan and detect.detect(docs.selectExpr("id AS doc_id", "'ООО «Фирма» и Фирма' AS text")).count() == 200


def test_streams_that_share_a_bucket_keep_apart(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(event_time, "BUCKETS", 1)
    rows = [(f"d{k}", "content", seq, text, seq == 2) for k in range(5) for seq, text in enumerate((f"{k} [PER", "SON_1] and [", "x"))]
    chunks = spark.createDataFrame(rows, "stream_id string, channel string, seq long, text string, is_last boolean")
    vault = spark.createDataFrame([(f"d{k}", "[PERSON_1]", f"P{k}") for k in range(4)], "stream_id string, token string, original_value string")
    got = {r.stream_id: r.text for r in restore.collected(restore.restore_all(chunks, vault, str(tmp_path))).collect()}
    assert got == {f"d{k}": f"{k} {f'P{k}' if k < 4 else '[PERSON_1]'} and [x" for k in range(5)}


def test_a_chunk_reads_its_tail_once(spark):
    plan = spark.createDataFrame([("x",)], "text string").select(detect.chunk_bounds(F.col("text")).alias("out"))._jdf.queryExecution().analyzed().toString()
    assert (plan.count("substring("), len(re.findall(r"length\(text", plan))) == (1, 1)


def test_texts_are_not_dealt_to_a_hundred_keys(spark, tmp_path):
    spark.createDataFrame([(k, "a b") for k in range(8)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, f"c{k}") for k in range(300)], "c_custkey long, c_name string").write.parquet(f"{tmp_path}/customer.parquet")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        seeded = queries.seeded(spark, str(tmp_path))
        plan = seeded._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and seeded.count() == 8
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_patterns_run_once_where_values_are_expanded(spark):
    docs = spark.createDataFrame([(1, "a@corp.ru, b, a@corp.ru")], "doc_id long, text string")
    found = detect.detect(docs)
    assert "@[A-Za-z0-9.-]+" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.start, r.end) for r in found.collect()) == [(0, 9), (14, 23)]


def test_a_long_text_is_not_walked_for_each_place(spark):
    n = 3000  # each place costs a part of the text, and is compared with its island only
    docs = spark.createDataFrame([(1, "ab@corp.ru АБВ абв 12; " * n)], "doc_id long, text string")
    spans = spark.createDataFrame([(1, 0, 10, "ab@corp.ru", "EMAIL", 0.9), (1, 11, 14, "АБВ", "ORG", 0.9), (1, 19, 21, "12", "MONEY", 0.9)], "doc_id long, start int, end int, value string, type string, confidence double")
    found = detect.expand_occurrences(spans, docs)
    got = {(r.start, r.end, r.value) for r in found.collect()}
    assert got == {(23 * k + a, 23 * k + b, v) for k in range(n) for a, b, v in ((0, 10, "ab@corp.ru"), (11, 14, "АБВ"), (19, 21, "12"))}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "island" in plan


def test_spans_meet_their_segments_by_stretches(spark, monkeypatch):
    rng = random.Random(4)
    parts = [(k, turn, rng.choice([None, "", "a", "abc \n d", "x" * 11])) for k in range(4) for turn in range(12)]
    starts, want, spans = {}, set(), []
    for k in range(4):
        at = 0
        for _, turn, text in (p for p in parts if p[0] == k):
            starts[k, turn] = (at, text or "")
            at += len(text or "") + 1
        whole = "\n".join(text or "" for key, _, text in parts if key == k)
        for _ in range(60):
            a = rng.randrange(len(whole))
            b = min(len(whole), a + rng.randrange(1, 30))
            spans.append((k, a, b, whole[a:b], "T", 1.0))
            for turn in range(12):
                begin, text = starts[k, turn]
                x, y = max(a, begin), min(b, begin + len(text))
                one = begin <= a and b <= begin + len(text)
                if x < y and (one or text[x - begin : y - begin].strip()):
                    want.add((k, turn, x - begin, y - begin, text[x - begin : y - begin], 1.0 if one else 0.8))
    segs = spark.createDataFrame(parts, "k long, turn long, text string")
    df = spark.createDataFrame(spans, "k long, start int, end int, value string, type string, confidence double")
    for size in (1, 4, 4096):
        monkeypatch.setattr(segments, "BUCKET", size)
        out = segments.split_by_segments(df, segs, "k", "turn")
        assert {tuple(r) for r in out.select("k", "turn", "start", "end", "value", "confidence").collect()} == want
    assert "bucket" in out._jdf.queryExecution().optimizedPlan().toString()


def test_what_stands_at_a_place_of_a_text_in_parts(spark, monkeypatch):
    monkeypatch.setattr(tx, "PART", 3)
    text = "aя😀b\nцd"
    df = spark.createDataFrame([(text, a, b) for a in range(-1, 8) for b in range(a + 1, 9)], "t string, a int, b int")
    got = df.select("t", "a", "b", tx.of_parts(tx.parts(F.col("t")), F.col("a"), F.col("b")).alias("x")).collect()
    assert all((r.x or "") == (r.t[r.a : r.b] if r.a >= 0 else "") for r in got)


def test_folding_tells_the_characters_it_changes(spark):
    chars = [chr(c) for c in (*range(1, 0xD800), *range(0xE000, 0x11000), *range(0x1D400, 0x1D800), 0x1F600)]
    df = spark.createDataFrame([(c,) for c in chars], "c string")
    plain = F.translate(F.lower(F.translate("c", "".join(a for a, _ in tx._FOLDED) + "ё" + tx.CYRILLIC, "".join(b for _, b in tx._FOLDED) + "e" + tx.LATIN)), "ё" + tx.CYRILLIC, "e" + tx.LATIN)
    bad = df.where((tx.normalize_for_search(F.col("c")) != plain) | (tx.foldable(F.col("c")) != (F.length(F.translate("c", tx.EXPANDING, "")) == F.length("c"))))
    assert bad.count() == 0
