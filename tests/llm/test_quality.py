import random

import numpy as np

from pseudolake.llm import quality


def test_learns_and_is_calibrated(spark):
    rng = random.Random(6)
    words = [f"word{k}" for k in range(80)]
    rows, labels = [], []
    for i in range(400):
        t = [rng.choice(words) for _ in range(rng.randint(8, 60))]
        bad = i % 4 == 0
        rows.append((i, " ".join(w + "###" * rng.randint(0, 1) if bad else w for w in t)))
        labels.append((i, int(not bad), 0))
    odd = [(1000, None), (1001, ""), (1002, "word1 " * 40000), (None, "word2"), (0, rows[0][1])]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string").selectExpr("*", "1 as v", "2 as label", "3 as score")
    lab = spark.createDataFrame(labels + [(None, None, 1), (5, 0, 0)], "doc_id long, quality int, toxic int")
    vec = quality.word_vectors(docs)
    assert np.allclose(np.linalg.norm(vec, axis=1)[np.linalg.norm(vec, axis=1) > 0], 1, atol=1e-3)
    feats = quality.pooled(docs, vec)
    got = quality.score(feats, quality.train(feats, lab)).collect()
    assert len(got) == len(rows) + len(odd) and all(0 <= r.score <= 1 for r in got)
    s = {r.doc_id: r.score for r in got}
    assert sum((s[i] >= 0.5) == (i % 4 != 0) for i in range(400)) >= 380
    assert {r.score for r in quality.score(feats, quality.train(feats, lab.limit(0))).collect()} == {0.5}
    assert quality.score(quality.pooled(docs.limit(0), quality.word_vectors(docs.limit(0))), None).count() == 0


def test_vectors_do_not_depend_on_chunks(monkeypatch):
    texts = ["a b c a b", None, "", "x y! y! z", "q" * 100]
    whole = quality.token_ids(texts, quality._Ids())
    monkeypatch.setattr(quality, "CHUNK_TOKENS", 1)
    parts = [quality.token_ids(texts[a:b], quality._Ids()) for a, b in quality._chunks(texts)]
    for k in range(3):
        assert np.concatenate([p[k] for p in parts]).tolist() == whole[k].tolist()
    assert (whole[1] == quality.REPEATED).sum() == 1


def test_probabilities_follow_the_shares_of_all_labels():
    rng = np.random.default_rng(4)
    y = np.arange(2000) % 2
    x = rng.standard_normal((2000, 3)) + 0.5 * y[:, None]
    mean = lambda net: np.average(1 / (1 + np.exp(-net.logits(x))), weights=np.where(y == 1, 6.0, 1.0))
    assert abs(mean(quality.Net().fit(x, y, shares=(1.0, 6.0))) - 6 / 7) < 0.04 < 0.1 < 6 / 7 - mean(quality.Net().fit(x, y))
