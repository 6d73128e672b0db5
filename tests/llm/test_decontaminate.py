import random
import re

from pseudolake.llm import common, decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(t):
    return WORD.findall("".join(c.lower() if c.isascii() else c for c in t or ""))


def brute(docs, items, n=10):
    wins = []
    for i, t in items:
        w = split(t)
        wins += [(str(i), w[k : k + n]) for k in range(max(1, len(w) - n + 1))] if w and i is not None else []
    out = []
    for d, t in docs:
        w = split(t)
        hit, found = set(), set()
        for i, win in wins:
            for k in range(len(w) - len(win) + 1):
                if w[k : k + len(win)] == win:
                    hit.update(range(k, k + len(win)))
                    found.add(i)
        out.append((d, len(w), len(hit), ",".join(sorted(found))))
    return sorted(out, key=str)


def run(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as n_words", "'x' as items")
    b = spark.createDataFrame(items, "item_id long, text string")
    rows = decontaminate.contamination(d, b).collect()
    return sorted([(r.kept.doc_id, r.n_words, sum(h.e - h.s for h in r.hits), ",".join(r.items)) for r in rows], key=str)


def test_against_brute_force(spark):
    rng = random.Random(5)
    vocab = "The of and été straße zéro ab cd ef gh ij kl mn 12 x9".split()
    text = lambda n: " ".join(rng.choice(vocab) + rng.choice(["", ",", "!"]) for _ in range(n))
    items = [(i, text(rng.randint(11, 30))) for i in range(12)] + [(50, text(3)), (51, ""), (52, None), (None, "ab cd"), (53, "..!")]
    docs = [(i, text(rng.randint(0, 60))) for i in range(30)] + [(90, None), (91, ""), (92, None), (None, items[0][1])]
    docs += [(100 + i, text(9) + " " + items[i][1].upper().replace("É", "é").replace("SS", "ß") + " " + text(20)) for i in range(10)]
    docs.append((200, " ".join(t or "" for _, t in items) * 50))
    docs.append((92, docs[0][1]))
    assert run(spark, docs, items) == brute(docs, items)


def test_crowded_bitmap_gives_the_same(spark, monkeypatch):
    items = [(i, " ".join(f"w{i * 3 + k}" for k in range(14))) for i in range(9)] + [(20, "w3 w4"), (21, "w5")]
    docs = [(i, "aa " + items[i][1] + " bb " + items[(i + 1) % 9][1]) for i in range(9)]
    monkeypatch.setattr(common, "MAX_BITS", 64)
    monkeypatch.setattr(decontaminate, "HELD", 10)
    assert run(spark, docs, items) == brute(docs, items)


def test_one_window_in_very_many_items(spark):
    items = [(i, "one window of ten words that every item here has") for i in range(10_000)]
    got = run(spark, [(1, "so one window of ten words that every item here has, too"), (2, "none")], items)
    assert got == [(1, 12, 10, ",".join(sorted(str(i) for i in range(10_000)))), (2, 1, 0, "")]


def test_empty_tables(spark):
    b = spark.createDataFrame([], "item_id long, text string")
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    got = decontaminate.contamination(d, b).first()
    assert (got.n_words, got.hits, got.items) == (2, [], [])
    assert decontaminate.contamination(d.limit(0), b).count() == 0
    assert decontaminate.drop_contaminated(d, b).columns == d.columns
