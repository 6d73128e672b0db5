import random
from itertools import combinations

import xxhash

from pseudolake.llm import simhash


def brute_fp(text):
    words = [w for w in "".join(c.lower() if c.isascii() else c for c in text or "").replace("\n", " ").replace("\t", " ").split(" ") if w]
    sh = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0


def brute_components(rows):
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for (i, a), (j, b) in combinations(rows, 2):
        if (a ^ b).bit_count() <= 2:
            x, y = sorted((find(i), find(j)))
            root[y] = x
    return {i: find(i) for i, _ in rows}


def test_fingerprints(spark):
    rng = random.Random(1)
    texts = [None, "", " \n ", "One", "ONE two", "é Été Ärger x y"] + [" ".join(rng.choice("aa bb CC dd ee".split()) for _ in range(rng.randint(1, 200))) for _ in range(40)]
    got = simhash.fingerprints_of(texts)
    assert [int(x) & (1 << 64) - 1 for x in got] == [brute_fp(t) for t in texts]


def _links_match(spark, fps):
    rows = list(enumerate(fps))
    want = brute_components(rows)
    signed = [(i, simhash._signed(f)) for i, f in rows]
    df = spark.createDataFrame(signed, "doc_id long, fp long")
    from pseudolake.llm.common import components

    found = {r.node: r.root for r in components(simhash.links(df.select("fp").distinct())).collect()}
    groups: dict = {}
    for i, f in signed:
        groups.setdefault(found.get(f, ("own", f)), []).append(i)
    assert {i: min(g) for g in groups.values() for i in g} == want


def test_links_small_and_crowded(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(60)]
    near = [b ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for b in base for _ in range(3)]
    _links_match(spark, base + near)
    hub = rng.getrandbits(64)
    crowd = [hub ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(300)]
    _links_match(spark, [hub, *crowd, *base])


def test_query_on_odd_rows(spark):
    rows = [(5, None, 1), (3, "", 1), (9, "a b c d", 1), (9, "a b c d", 2), (None, "a b c d", 1), (7, "x " * 30000, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    got = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(df).collect()}
    assert got == {(5, 3), (3, 3), (9, 9), (None, 9), (7, 7)}
    assert simhash.near_duplicates(df.limit(0)).count() == 0
    kept = sorted(r.doc_id for r in simhash.keep_first(df.where("doc_id is not null")).collect())
    assert kept == [3, 7, 9]
    assert simhash.keep_first(df).columns == df.columns and simhash.keep_first(df.limit(0)).count() == 0


def test_one_row_of_each_group_stays(spark):
    rng = random.Random(4)
    say = lambda: " ".join(f"w{rng.randrange(500)}" for _ in range(40))
    a, b, c, d = say(), say(), say(), say()
    rows = [(3, a), (3, b), (9, b), (None, c), (None, c), (5, c), (None, d), (None, d), (2, a), (2, a), (None, None), (None, "")]
    got = simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as fp", "2 as root", "3 as kept")).collect()
    assert sorted(((r.doc_id, r.text or "") for r in got), key=str) == sorted([(2, a), (3, b), (5, c), (None, d), (None, "")], key=str)
