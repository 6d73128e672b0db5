import random

import numpy as np

from pseudolake.llm import substring
from pseudolake.llm.common import components, words_of


def sentences(rng, n):
    return " ".join(" ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 7))) for _ in range(rng.randint(1, 24))) + "." for _ in range(n))


def similarity(a, b):
    return len(np.intersect1d(a, b)) / len(np.union1d(a, b))


def test_paragraphs():
    rng = random.Random(2)
    for t in [None, "", "a b c d", "a b c d e", "é " * 3000, sentences(rng, 60), "One two. Three four five?\nsix\n\n7 eight nine ten 11 12"]:
        p, words = substring.paragraphs(t), words_of(t)
        end = p["at"] + p["words"]
        assert (p["words"] >= substring.SHINGLE).all() and (p["words"] <= substring.LONGEST + substring.SHINGLE).all()
        assert (p["at"][1:] == end[:-1]).all() and (not words[4:] or (p["at"][0] == 0 and end[-1] >= len(words) - 4))
        assert p["n"].sum() == len(p["shingles"]) and (p["n"] <= p["words"] - 4).all()
    assert substring.paragraphs("One two. Three four five?\nsix\n\n7 eight nine ten 11 12")["at"].tolist() == [0, 5]


def test_bands_hold_every_similar_pair():
    rng = np.random.default_rng(1)
    for _ in range(2000):
        a = rng.integers(0, 1 << 62, rng.integers(4, 17))
        b = np.unique(np.r_[a[rng.random(len(a)) < 0.9], rng.integers(0, 1 << 62, rng.integers(0, 3))])
        a = np.unique(a)
        if len(b) > 3 and similarity(a, b) >= 0.8:
            assert set(a[: substring.band_count(len(a))]) & set(b[: substring.band_count(len(b))])


def test_passages_equal_brute_force(spark):
    """Every document with a run of RUN_WORDS words of another has a passage; passages are those runs, but for some words at the edges."""
    rng = random.Random(3)
    shared = [sentences(rng, 30).split()[:n] for n in (40, 49, 50, 51, 58, 66, 90, 140)]
    rows = []
    for i in range(48):
        own = sentences(rng, rng.randint(2, 12)).split()
        at = rng.randrange(len(own))
        rows.append((i, " ".join(own[:at] + shared[i % 8] + own[at:]) + "\n" + " - ".join("abc")))
    copy = sentences(rng, 40)
    rows += [(60, copy), (61, copy), (62, copy.replace(copy.split()[200], "edited")), (70, None), (71, ""), (None, copy), (3, rows[3][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as at", "2 as words", "3 as keys", "4 as start")
    words = {i: words_of(t) for i, t in rows if i is not None}
    grams: dict = {}
    for i, w in words.items():
        for k in range(len(w) - 49):
            grams.setdefault(tuple(w[k : k + 50]), set()).add(i)
    want = {i: {j for k in range(len(w) - 49) if len(grams[tuple(w[k : k + 50])]) > 1 for j in range(k, k + 50)} for i, w in words.items()}
    got: dict = {}
    for r in substring.repeated_passages(df).collect():
        assert r.n_words == r.end - r.start >= substring.RUN_WORDS
        got.setdefault(r.doc_id, set()).update(range(r.start, r.end))
        if r.doc_id < 60:
            assert r.first_doc == r.doc_id % 8 and bool(r.removed) == (r.doc_id >= 8)
    assert {i for i in want if want[i]} == set(got)
    for i in got:
        assert len(want[i] - got[i]) <= substring.SHINGLE and len(got[i] - want[i]) <= 3, i  # edges beside paragraphs that are only similar
    clean = {r.doc_id: r.text for r in substring.cleaned(df.where("doc_id is not null").dropDuplicates(["doc_id"]), substring.repeated_passages(df)).collect()}
    text = dict(rows)
    assert clean[3] == text[3] and clean[60] == text[60] and not words_of(clean[61]) and clean[70] is None
    assert 0 <= len(words_of(clean[15])) - (len(words[15]) - 140) <= substring.LONGEST  # edges beside paragraphs that are only similar can stay
    assert substring.repeated_passages(df.limit(0)).count() == 0


def test_near_copies_of_sentences(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    one = [[word() for _ in range(15)] for _ in range(4)]
    text = lambda s: " ".join(" ".join(x) + "." for x in s)
    rows = [(1, text(one)), (2, text([[*s[:-1], word()] for s in one])), (3, text([[word() for _ in range(15)] for _ in range(4)]))]
    got = substring.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_words, bool(r.removed)) for r in got) == [(1, 60, False), (2, 60, True)]


def _classes_match(spark, texts):
    sets = {}
    for t in texts:
        p = substring.paragraphs(t)
        for s, i in zip(np.split(p["shingles"], np.cumsum(p["n"])[:-1]), p["set_id"].tolist()):
            sets[i] = s
    ids = sorted(sets)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(ids)):
        for b in range(a):
            if similarity(sets[ids[a]], sets[ids[b]]) >= 0.8:
                x, y = sorted((find(ids[a]), find(ids[b])))
                root[y] = x
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.node: r.root for r in components(substring.links(df, substring.paragraph_table(df))).collect()}
    assert {i: found.get(i, i) for i in ids} == {i: find(i) for i in ids}
    return len({find(i) for i in ids}), len(ids)


def test_links_equal_brute_force(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    base = [[word() for _ in range(rng.randint(8, 16))] for _ in range(30)]
    texts = [" ".join(b) for b in base] + [" ".join([*b[:-k], *(word() for _ in range(k))]) for b in base for k in (1, 2)]
    classes, n = _classes_match(spark, texts)
    assert classes < n


def test_crowded_bands_lose_no_link(spark, monkeypatch):
    """200 sets share most of their shingles, of which some are linked and most are not."""
    monkeypatch.setattr(substring, "BLOCK", 64)
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    stem = [word() for _ in range(11)]
    texts = [" ".join([*stem, *(word() for _ in range(5))]) for _ in range(150)]
    texts += [" ".join([*t.split()[:-1], word()]) for t in texts[:40]]
    texts += [" ".join([*stem, word(), word()]) for _ in range(60)]
    classes, n = _classes_match(spark, texts)
    assert n == 250 and 1 < classes < n


def test_versions_of_a_text_are_aligned_with_both_ends_of_a_class(spark, monkeypatch):
    """Three versions, of which the last two share a run that the first breaks by a word; classes dealt out to tasks change nothing."""
    rng = random.Random(5)
    base = sentences(rng, 40).split()
    at = next(k for k in range(200, len(base)) if base[k][-1] != "." and base[k - 1][-1] != ".")
    first, other = list(base), list(base)
    first[at] = "changed"
    other[at - 60] = "altered"
    rows = [(1, " ".join(first)), (2, " ".join(base)), (3, " ".join(other))] + [(i, " ".join(base[:120])) for i in range(10, 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")

    def found():
        return sorted((r.doc_id, r.start, r.end) for r in substring.repeated_passages(df).collect())

    whole = found()
    covered = {(d, k) for d, a, b in whole for k in range(a, b)}
    words = {d: words_of(t) for d, t in rows}
    for d, e in ((2, 3), (3, 2)):
        runs = [k for k in range(len(words[d]) - 49) if words[d][k : k + 50] == words[e][k : k + 50]]
        assert runs and all((d, j) in covered for k in runs for j in range(k, k + 50))
    monkeypatch.setattr(substring, "SPREAD", 4)
    assert found() == whole
