import random
import zlib
from hashlib import sha256

from pseudolake.llm import manifest

FIELDS = "doc_id long, source string, lang string, n_chars long, text string"
NAMES = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 2]) for i in range(0, len(levels[-1]), 2)])
    return levels


def brute(rows):
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    order = lambda r: (r[0] is not None, r[0] or 0, leaf(r))
    groups = {g: sorted((r for r in rows if r[2] == g), key=order) for g in langs}
    trees = {g: tree([leaf(r) for r in rs]) for g, rs in groups.items()}
    top = tree([trees[g][-1][0] for g in langs])
    out = []
    for q, g in enumerate(langs):
        for p, r in enumerate(groups[g]):
            tampered = r[0] is not None and r[3] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            now, proof = leaf((*r[:3], r[3] + 1, r[4])) if tampered else leaf(r), []
            for levels, k in ((trees[g], p), (top, q)):
                for level in levels[:-1]:
                    run = [level[i] for i in range(k // 2 * 2, min(k // 2 * 2 + 2, len(level)))]
                    proof += [x for i, x in enumerate(run) if i != k % 2]
                    run[k % 2] = now
                    now, k = h(*run), k // 2
            out.append((r[0], leaf(r), trees[g][-1][0], top[-1][0], h(*proof), now, now == top[-1][0]))
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r[c] for c in NAMES) for r in manifest.manifest(df).collect()), key=str)


def test_large_group_and_far_ids(spark):
    rng = random.Random(2)
    ids = rng.sample(range(-5000, 9000), 2500) + [rng.getrandbits(63) * rng.choice((1, -1)) for _ in range(300)] + [2**63 - 1, -(2**63)]
    rows = [(i, rng.choice("ab"), rng.choice(["en"] * 8 + ["de", None]), rng.randrange(99), f"text {i}") for i in ids]
    assert found(spark.createDataFrame(rows, FIELDS)) == brute(rows)


def test_odd_rows(spark):
    rows = [(1, "s", "en", 3, "abc")] * 40 + [(1, "s", "en", 4, "abcd"), (1, None, "en", None, None), (2, "s", "en", 3, "abc"), (65, "é", "en", 1, "ß"), (0, "", "en", 0, "")]
    rows += [(None, "s", "en", k % 9, f"n{k % 90}") for k in range(300)] + [(7, "s", None, 1, "x"), (None, None, None, None, None), (8, "s", "", 2, "y"), (9, "s", "é", None, "z" * 200000), (10, "s", "zz", 2**63 - 1, "y")]
    df = spark.createDataFrame(rows, FIELDS).selectExpr("*", "1 as grp", "'x' as word", "2 as root", "3 as pos")
    assert found(df) == brute(rows)
    assert manifest.manifest(df.limit(0)).collect() == []
    one = df.where("doc_id = 9")
    assert [r.n_siblings for r in manifest.manifest(one).collect()] == [0] and found(one) == brute([r for r in rows if r[0] == 9])


def test_many_groups(spark):
    rows = [(i, "s", f"l{i % 1300}", i, "t") for i in range(3000)]
    assert found(spark.createDataFrame(rows, FIELDS)) == brute(rows)
