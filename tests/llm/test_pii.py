import hashlib
import math
import random
import re

from pyspark.sql import functions as F

from pseudolake.llm import pii

RULES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(int(c) if k % 2 == 0 else (2 * int(c) - 9 * (int(c) > 4)) for k, c in enumerate(reversed(d))) % 10 == 0


def valid(kind, v):
    d = re.sub("[^0-9]", "", v)
    if kind == "ip":
        return all(int(x) <= 255 for x in v.split("."))
    if kind == "card":
        return 16 <= len(d) <= 19 and luhn(d)
    return 8 <= len(d) <= 15 if kind == "phone" else True


def brute(text):
    return [(k, m.start(), m.end()) for k, r in RULES.items() for m in re.finditer(r, text or "") if valid(k, m[0])]


ODD = [
    None, "", "a@b.cc_d@e.f.g", "x@y", "..@..", "a@b.c.d-.e", "é@b.cö", "1.2.3.4.5.6.7.8", "256.1.1.1 255.255.255.0 0000255.1.1.1",
    "4111 1111 1111 1111", "4111-1111-1111-1111x", "4111  1111 1111 1111", "12345678901234567890123", "+1 (375) 555-4393 +49 30 1234567",
    "++1234567890", "+1 2 3 . . 4", "😀 a@b.cc 😀 1.1.1.1", "7" * 20000, "a" * 200000, "1." * 30000, "+" * 500, "+1 " * 2000, "a@" * 3000, "0.0.0.0 " * 50,
]


def test_base_spans_equal_python(spark):
    rng = random.Random(8)
    bits = ["a@b.cc", "@", ".", "-", " ", "+", "4111111111111111", "1", "25", "300", "(", ")", "é", "x", "_", "\n", "10.0.0.1", "+1 555 123 4567", "😀"]
    texts = ODD + ["".join(rng.choice(bits) for _ in range(rng.randint(1, 40))) for _ in range(600)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = df.select("doc_id", pii.base_spans(F.coalesce("text", F.lit(""))).alias("s")).collect()
    for r in got:
        assert [(s.kind, s.start, s.end) for s in r.s] == brute(texts[r.doc_id]), texts[r.doc_id][:80]


def test_disclosing_terms_and_redaction(spark, monkeypatch):
    rows = [(i, f"common words here about Zyxwv and bob@site.example said more common words", "k") for i in range(6)]
    rows += [(10 + i, "common words here about things and more common words said", "k") for i in range(60)]
    rows += [(90, None, "k"), (91, "", "k"), (None, "call +1 555 123 4567 now", "k"), (0, rows[0][1], "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, kind string").withColumn("n_chars", F.length("text").cast("long"))
    got = pii.sanitise(df).collect()
    assert len(got) == len(rows)
    words = {}
    for r in got:
        text = dict((i, t) for i, t, _ in rows).get(r.doc_id) or ""
        for a in r.added:
            words.setdefault(text[a.start : a.end], set()).add(a.kind)
    assert "Zyxwv" in words and "common" not in words and not any(r.added for r in got if r.doc_id and r.doc_id >= 10)
    red = {(r.doc_id, r.text, r.n_chars) for r in pii.redact(df).collect()}
    assert (None, "call [PHONE] now", 16) in red and (90, None, None) in red and (91, "", 0) in red
    assert not any("@" in (t or "") or "Zyxwv" in (t or "") for _, t, _ in red)
    assert pii.redact(df).columns == df.columns
    assert pii.redact(df.limit(0)).count() == pii.sanitise(df.limit(0)).count() == 0


def entities(text):
    out = set()
    for kind, a, b in brute(text):
        v = text[a:b].lower()
        d = re.sub("[^0-9]", "", v)
        group = {"email": v.rsplit("@", 1)[-1], "ip": ".".join(v.split(".")[:3]), "card": d[:6], "phone": d[:4]}[kind]
        out |= {f"{kind}:{v}", f"{kind}:group:{group}"}
    return out


def words(text):
    spans = brute(text)
    return {w for w in re.findall(r"[^\W\d_]+", "".join(" " if any(a <= i < b for _, a, b in spans) else c for i, c in enumerate(text)).lower()) if len(w) >= 3}


def brute_shares(texts):
    n, held, has = len(texts), [entities(t) for t in texts], [words(t) for t in texts]
    everywhere = [{w for w in re.findall(r"[^\W\d_]+", t.lower()) if len(w) >= 3} for t in texts]
    out = {}
    for e in set().union(*held):
        own = [i for i in range(n) if e in held[i]]
        for t in set().union(*(has[i] for i in own)):
            both = [i for i in own if t in has[i]]
            n_t, s = sum(t in x for x in everywhere), len(both)
            if len(own) < n:
                share = math.log(n * len(both) / (n_t * len(own))) / math.log(n / len(own)) * s / (s + 0.5)
                if share >= 0.75:
                    out[e, t] = round(share, 9)
    return out


def test_shares_equal_brute_force_far_from_the_entity(spark):
    rng = random.Random(9)
    common = ["alpha", "beta", "gamma", "delta", "ab", "été"]
    say = lambda k: " ".join(rng.choice(common) for _ in range(k))
    texts = [f"{say(5)} Nickname{'abcd'[i % 4]} {say(150)} user{i % 4}@host{i % 2}.example {say(9)}" for i in range(16)]  # 500 characters and more away
    texts += [f"{say(20)} 10.1.2.{i} Serverroom {say(3)}" for i in range(5)] + ["copied Toldagain alpha x@y.zz"] * 7 + [say(60) for _ in range(80)]
    texts += ["call +1 555 123 4567 Rare", "", "Nicknamea alone", "4111 1111 1111 1111 Payee", "4111 1111 1111 1111 Payee again"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    scanned = pii.stored(pii._scan(df))
    got = {(r.entity, r.term): round(r.share, 9) for r in pii.disclosures(df, scanned)[0].collect()}
    want = brute_shares(texts)
    assert got == want
    assert ("email:user0@host0.example", "nicknamea") in got and ("ip:group:10.1.2", "serverroom") in got and ("email:x@y.zz", "toldagain") in got and not any(t == "rare" for _, t in got)
    spans = {r.doc_id: {(texts[r.doc_id][a.start : a.end], a.kind) for a in r.added} for r in pii.sanitise(df).collect()}
    for i, t in enumerate(texts):
        kinds = {}
        for (e, w), share in want.items():
            if e in entities(t):
                kinds[w] = max(kinds.get(w, ""), "remove" if share >= 0.9 else "generalise")
        assert {(x.lower(), k) for x, k in spans[i]} == {(w, k) for w, k in kinds.items() if w in words(t)}


def test_query_columns(spark, tmp_path):
    df = spark.createDataFrame([(1, "x 10.1.1.1 a@b.cc", 5), (2, None, 5)], "doc_id long, text string, spans int")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in pii.op3_pii(spark, str(tmp_path)).collect()}
    assert got[1].spans == "email:11:17,ip:2:10" and got[1].base_sha256 == hashlib.sha256(b"email:11:17,ip:2:10").hexdigest()
    assert got[2].spans == "" and got[2].n_email == 0 and got[2].base_sha256 == hashlib.sha256(b"").hexdigest()
