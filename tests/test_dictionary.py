"""Dictionary search against brute force."""

import random
import re

from pyspark.sql import functions as F

from pseudolake.operators import dictionary, replace
from pseudolake.plans import jobs

ALPHABET = ["7", "900", "12", "ab", "Ab", "ё", "é", "x1", " ", " ", " ", "-", "+", "(", ")", ",", ".", " ", "_", "№", "\n"]


def brute_hits(text, values):
    """Leftmost places, the longest first, untouched by word characters where the value ends in one."""
    word = lambda c: c.isalpha() or c.isnumeric() or c == "_"
    hits = []
    for value, token in values:
        if not value.strip(" \n "):
            continue
        for at in range(len(text)):
            end = at + len(value)
            left = at and word(text[at - 1]) and word(value[0])
            right = end < len(text) and word(text[end]) and word(value[-1])
            if text.startswith(value, at) and not left and not right:
                hits.append((at, -len(value), end, token))
    out, pos = [], 0
    for start, _, end, token in sorted(set(hits)):
        if start >= pos:
            out.append((start, end, token))
            pos = end
    return out


def test_places_equal_brute_force(spark):
    rng = random.Random(11)
    say = lambda n: "".join(rng.choice(ALPHABET) for _ in range(n))
    texts = [(k, f"s{k % 3}", say(rng.randrange(60))) for k in range(200)] + [(900, "s0", None), (901, "s0", "")]
    values = [(f"s{k % 3}", say(rng.randrange(1, 6)), f"[MISC_{k}]") for k in range(240)] + [("s1", "", "[MISC_900]"), ("s1", None, "[MISC_901]"), ("s2", " ", "[MISC_902]")]
    t = spark.createDataFrame(texts, "doc_id long, session_id string, text string")
    v = spark.createDataFrame(values, "session_id string, value string, token string")
    got = {}
    for r in dictionary.value_hits(t, v, ["doc_id"], ["session_id"]).collect():
        got.setdefault(r.doc_id, []).append((r.start, r.end, r.token))
    want = {i: hits for i, s, text in texts if text and (hits := brute_hits(text, [(x, token) for own, x, token in values if own == s and x]))}
    assert {i: sorted(h) for i, h in got.items()} == want and len(want) > 60
    assert dictionary.value_hits(t, v.limit(0), ["doc_id"], ["session_id"]).count() == 0
    assert dictionary.value_hits(t.limit(0), v, ["doc_id"], ["session_id"]).count() == 0


def test_values_that_begin_alike_share_no_key(spark):
    phone = lambda n: f"+7 (9{n % 100:02d}) {n * 7919 % 1000:03d}-{n * 31 % 100:02d}-{n * 17 % 100:02d}"
    t = spark.createDataFrame([(n, "s", f"Позвоните {phone(n)} или {phone(n * 13 % 2000)}") for n in range(2000)], "doc_id long, session_id string, text string")
    v = spark.createDataFrame([("s", phone(n), f"[PHONE_{n}]") for n in range(2000)], "session_id string, value string, token string")
    found = dictionary.candidates(t, v, ["doc_id"], ["session_id"])
    most, pairs = found.groupBy("h_").count().agg(F.max("count")).first()[0], found.count()
    assert most <= pairs / 100 and pairs < 8000
    assert dictionary.value_hits(t, v, ["doc_id"], ["session_id"]).count() >= 3900


def brute_redactions(text, names):
    masked = re.sub(r"\[[A-Z_]+_\d+\]", lambda m: " " * len(m[0]), text)
    kept = []
    for name in names:
        if not name.strip():
            continue
        number = re.fullmatch(r"[0-9  .,+-]+", name) and re.search("[0-9]", name)
        tight = name.replace(" ", "").replace(" ", "")
        for form in dict.fromkeys([name, tight, name.replace(",", "."), tight.replace(",", ".")]) if number else [name]:
            pattern = rf"(?<![0-9.,]){re.escape(form)}(?:[.,][0-9]+)?(?![0-9])" if number else rf"(?i)(?<![A-Za-zА-Яа-яЁё0-9_]){re.escape(form)}(?![A-Za-zА-Яа-яЁё0-9_])"
            for m in re.finditer(pattern, masked):
                if all(m.end() <= a or m.start() >= b for a, b in kept):
                    kept.append(m.span())
    return sorted(kept)


def test_redactions_equal_brute_force(spark):
    rng = random.Random(12)
    bits = ["12", "386887", ",", ".", "42", " ", " ", "Иванов", "иванов", "ИВАНОВА", "Kim", "kIM", "[ORG_12]", "é", "+", "-", "_", "№", "руб", "\n"]
    say = lambda n: "".join(rng.choice(bits) for _ in range(n))
    texts = [(k, "s", say(rng.randrange(30))) for k in range(250)] + [(900, "s", None), (901, "s", ""), (902, "s", "12 386887,42 и 12386887.42, 12386887,42.5")]
    names = ["12 386887,42", "Иванов", "kim", "12", "№", "386887", "42,5", "-", "ИВАНОВ Kim", "é", " ", "386 887", *(say(3) for _ in range(40))]
    t = spark.createDataFrame(texts, "doc_id long, session_id string, text string")
    got = {}
    for r in dictionary.redactions(t, spark.createDataFrame(list(enumerate(names)), "seq long, value string"), ["doc_id"]).collect():
        got.setdefault(r.doc_id, []).append((r.start, r.end))
    want = {i: hits for i, _, text in texts if text and (hits := brute_redactions(text, names))}
    assert {i: sorted(h) for i, h in got.items()} == want and len(want[902]) == 3
    out, new, report = jobs.extra_redact(t.where("doc_id = 902"), ["12 386887,42"], jobs.empty_vault(t), ["doc_id"])
    assert re.fullmatch(r"\[MISC_\d\] и \[MISC_\d\], \[MISC_\d\]", out.first().text) and new.count() == 3 and report.first().found


def test_a_leak_is_told(spark):
    t = spark.createDataFrame([(1, "s", "a@b.ru stays"), (2, "s", "xa@b.ru"), (3, "t", "a@b.ru")], "doc_id long, session_id string, text string")
    v = spark.createDataFrame([("s", "[EMAIL_1]", "a@b.ru")], "session_id string, token string, original_value string")
    assert [(r.doc_id, r.original_value) for r in replace.leaks(t, v).collect()] == [(1, "a@b.ru")]
