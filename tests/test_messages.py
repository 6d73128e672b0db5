"""Conversations with tool calls."""

import json
import random

from pyspark.sql import functions as F

from pseudolake.functions import catalog as cat
from pseudolake.functions import json_text as js
from pseudolake.plans import jobs

CALLS = "array<struct<id:string,name:string,arguments:string>>"


def test_strings_of_json_say_what_a_parser_reads(spark):
    rng = random.Random(5)
    bits = ['"', "\\", "/", "\n", "\t", "é", "😀", "a", " ", ":", "{", "]", "\u0001", "ё"]
    say = lambda: "".join(rng.choice(bits) for _ in range(rng.randrange(8)))
    values = [[say(), {say(): say(), "n": 5, "x": [say(), None, True]}] for _ in range(150)]
    texts = [json.dumps(v, ensure_ascii=bool(k % 2), indent=k % 3 or None) for k, v in enumerate(values)]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string").select("k", "text", F.inline(js.strings(F.col("text"))))
    got = {}
    for r in df.select("k", "text", "start", "key", js.said(F.col("units")).alias("said"), F.array_join(F.transform("units", lambda u: u["raw"]), "").alias("raw")).collect():
        assert r.text[r.start : r.start + len(r.raw)] == r.raw and r.text[r.start - 1] == '"'
        got.setdefault(r.k, []).append((r.start, r.key, r.said))
    for k, text in enumerate(texts):
        want = []

        def pairs(items):
            out = []
            for name, v in items:
                out += [("key", name), v]
            return out

        def flat(v):
            if isinstance(v, tuple):
                want.append((True, v[1]))
            elif isinstance(v, list):
                for x in v:
                    flat(x)
            elif isinstance(v, str):
                want.append((False, v))

        flat(json.loads(text, object_pairs_hook=pairs))
        assert [x[1:] for x in sorted(got[k])] == want


def test_places_behind_escapes(spark):
    raw = r"a\n\u0040\ud83d\ude00b"
    df = spark.createDataFrame([(raw, k) for k in range(6)], "raw string, at int").withColumn("u", js.units(F.col("raw")))
    got = [(r.at, r.s, r.e) for r in df.select("at", js.raw_place(F.col("u"), F.col("at")).alias("s"), js.raw_place(F.col("u"), F.col("at"), True).alias("e")).collect()]
    assert got == [(0, 0, 0), (1, 1, 1), (2, 3, 3), (3, 9, 9), (4, 21, 21), (5, None, 22)]


def test_arguments_stay_json_and_come_back(spark):
    args = ['{"uri": "file:///c:/ivan@corp.ru.docx", "ivan@corp.ru": {"to": ["ivan@corp.ru", "a \\"q\\" pe\\u0074ja@corp.ru\\nx"], "n": 79001234567}}', "not json: ivan@corp.ru", None, "{}", '"pavel@corp.ru"']
    rows = [(1, 0, "s", "pisz\u0119 do ivan@corp.ru", None), (1, 1, "s", None, [(str(k), "send", a) for k, a in enumerate(args)]), (2, 0, "t", "", []), (3, 0, "t", None, None)]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, session_id string, text string, tool_calls {CALLS}").withColumn("more", F.lit(1))
    out, new, _ = jobs.anonymize_messages(df, catalog=cat.only("EMAIL"))
    got = {(r.conv_id, r.turn): r for r in out.collect()}
    known = {r.original_value: r.token for r in new.collect()}
    assert set(known) == {"ivan@corp.ru", "petja@corp.ru", "pavel@corp.ru"} and got[1, 0].text == "pisz\u0119 do " + known["ivan@corp.ru"]
    calls = got[1, 1].tool_calls
    assert got[1, 1].text is None and [c.id for c in calls] == list("01234") and got[2, 0].tool_calls == [] and got[3, 0].tool_calls is None
    first = json.loads(calls[0].arguments)
    assert first == {"uri": "file:///c:/ivan@corp.ru.docx", "ivan@corp.ru": {"to": [known["ivan@corp.ru"], f'a "q" {known["petja@corp.ru"]}\nx'], "n": 79001234567}}
    assert calls[0].arguments.startswith('{"uri": "file:///c:/ivan@corp.ru.docx", "ivan@corp.ru": {') and calls[1].arguments == "not json: " + known["ivan@corp.ru"]
    assert calls[2].arguments is None and calls[3].arguments == "{}" and json.loads(calls[4].arguments) == known["pavel@corp.ru"]
    flat = out.where("turn = 1").select("session_id", F.posexplode("tool_calls").alias("k", "c")).select("k", "session_id", F.col("c.arguments").alias("text"))
    back = {r.k: r.text for r in jobs.restore_arguments(flat, new, ["k"]).collect()}
    assert json.loads(back[0]) == json.loads(args[0]) and [back[k] for k in (1, 2, 3, 4)] == args[1:]
    quoted = spark.createDataFrame([("s", "[ORG_1]", 'ООО "Ромашка"\n')], "session_id string, token string, original_value string")
    one = spark.createDataFrame([(1, "s", '{"a": "[ORG_1]!"}')], "k int, session_id string, text string")
    assert json.loads(jobs.restore_arguments(one, quoted, ["k"]).first().text) == {"a": 'ООО "Ромашка"\n!'}
