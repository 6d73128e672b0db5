import random
import zlib

import numpy as np

from pseudolake.llm import common
from pseudolake.llm import toxicity as tox
from pseudolake.llm.common import words_of


def tiny_net(seed=0):
    odds = [np.random.default_rng(seed).standard_normal(1 << tox.ODDS_BITS).astype(np.float32)] * 5
    return tox.Net(odds, {b"aa": 0, b"bb": 1})


def test_gradients_equal_differences():
    net = tiny_net()
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    words, ids, mask = tox.arrange([[b"aa", b"cc", b"longerword"], [b"bb"], [b"x"] * tox.WINDOW])
    y = np.array([1.0, 0.0, 1.0])

    def loss():
        x, _ = net.inputs(words, 0)
        z, _ = net.forward(x, ids, mask)
        return float(np.mean(np.log1p(np.exp(-z)) * y + np.log1p(np.exp(z)) * (1 - y)))

    g = net.gradients(words, ids, mask, y, 0)
    rng = np.random.default_rng(1)
    for k, grad in g.items():
        flat, part = net.p[k].reshape(-1), grad.reshape(-1)
        near = np.argsort(-np.abs(part))[:3].tolist() + rng.integers(0, len(flat), 2).tolist()
        for i in near:
            old = flat[i]
            flat[i] = old + 1e-4
            up = loss()
            flat[i] = old - 1e-4
            down = loss()
            flat[i] = old
            assert abs((up - down) / 2e-4 - part[i]) < 2e-4 + 0.02 * abs(part[i]), k


def test_windows_reach_the_end():
    for n in (1, 31, 32, 33, 56, 57, 1000):
        starts = list(tox.window_starts(n))
        assert starts[0] == 0 and starts[-1] + tox.WINDOW >= n and all(b - a == tox.STRIDE for a, b in zip(starts, starts[1:]))
        assert len(starts) == 1 or starts[-2] + tox.WINDOW < n
    assert list(tox.window_starts(0)) == []


def test_score_is_the_highest_window():
    net = tiny_net()
    rng = random.Random(1)
    texts = [[b"w%d" % rng.randrange(50) for _ in range(n)] for n in (5, 80, 300)]
    high, n = net.scores(texts)
    for t, h in zip(texts, high):
        single = [float(net.scores([t[a : a + tox.WINDOW]])[0][0]) for a in tox.window_starts(len(t))]
        assert abs(max(single) - h) < 1e-4


def test_learns_planted_words(spark):
    rng = random.Random(4)
    plain = [f"w{k}" for k in range(60)]
    rows, labels = [], []
    for i in range(500):
        words = [rng.choice(plain) for _ in range(rng.randint(5, 120))]
        if bad := i % 5 == 0:
            words.insert(rng.randrange(len(words)), "nasty" + rng.choice(["ish", "ly", "er", "est"]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad), 1))
    odd = [(1000, None), (1001, ""), (1002, "!!"), (1003, "w1 " * 30000 + "nastyer"), (1004, "w1 " * 3000), (None, "w3"), (0, rows[0][1])]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string").selectExpr("*", "1 as label", "2 as n", "'x' as high")
    lab = spark.createDataFrame(labels + [(0, 0, 1), (None, None, None), (1, None, 0)], "doc_id long, toxic int, quality int")
    got = tox.score(docs, tox.train(docs, lab)).collect()
    assert len(got) == len(rows) + len(odd)
    s = {r.doc_id: r.score for r in got}
    assert sum((s[i] >= tox.THRESHOLD) == (i % 5 == 0) for i in range(1, 500)) >= 475  # 95 %
    assert s[1000] == s[1001] == s[1002] == 0 and s[1003] > 0.3 > s[1004]
    kept = tox.drop_toxic(docs, lab)
    assert kept.columns == docs.columns and {1000, 1001, 1004} <= {r.doc_id for r in kept.collect()}
    assert {r.score for r in tox.score(docs, tox.train(docs, lab.limit(0))).collect()} == {0.0}
    assert tox.score(docs.limit(0), None).count() == 0
    assert words_of(None) == []


def test_bounds_of_the_sample_do_not_move_the_threshold(spark):
    rng = np.random.default_rng(2)
    y = (np.arange(40000) % 10 == 0).astype(int)
    x = rng.standard_normal(len(y)) + 2 * y
    few = (y == 1) | (np.cumsum(y == 0) <= 6000)
    want, got = common.logistic(x[:, None], y), common.logistic(x[few, None], y[few], share=np.array([6.0, 1.0])[y[few]])
    assert np.abs(want - got).max() < 0.1 < 1 < common.logistic(x[few, None], y[few])[1] - want[1]
    rows = [(i, int(i % 10 == 0)) for i in range(400)] + [(1, 1), (2, None), (5, 0)]
    lab = spark.createDataFrame(rows, "doc_id long, toxic int")
    every, held = common.sample_shares(lab, "toxic", 4, 2, (1, 1)), sum(zlib.crc32(str(i).encode()) % 4 == 2 for i in range(400) if i != 1)
    assert every.sum() == 399 - held and common.sample_shares(lab, "toxic", 4, 2, (1000, 10)).tolist() == [1, every[1] / 10]
    assert common.sample_shares(lab.limit(0), "toxic", 4, 2, (1, 1)).tolist() == [1, 1]


def test_bound_training_scores_at_the_true_shares(spark, monkeypatch):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(600):
        bad = i % 6 == 0
        rows.append((i, " ".join(rng.choice(["a", "b", "c", "d"]) for _ in range(20)) + (" odd" if bad or i % 6 == 1 else "")))
        labels.append((i, int(bad)))
    docs, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    monkeypatch.setattr(tox, "SAMPLE_CLEAN", 75)
    seen = {r.doc_id: r.score for r in tox.score(docs, tox.train(docs, lab)).collect()}
    assert 0.35 < np.mean([seen[i] for i in range(0, 600, 6)]) < 0.65  # half of the texts with the word are toxic


def test_pieces_hold_the_windows_of_the_whole_text():
    rng = random.Random(4)
    step, more = tox.PIECE_WINDOWS * tox.STRIDE, tox.WINDOW - tox.STRIDE
    windows = lambda w: [w[a : a + tox.WINDOW] for a in tox.window_starts(len(w))]
    for n in [1, more, more + 1, tox.WINDOW, tox.WINDOW + 1, step, step + more, step + more + 1, 3 * step - 1, *(rng.randint(1, 4 * step) for _ in range(20))]:
        words = [b"%d" % k for k in range(n)]
        assert [x for p in tox.pieces(words) for x in windows(p)] == windows(words)


def test_long_texts_score_like_their_windows():
    rng = random.Random(6)
    words = [b"w%d" % k for k in range(3000)]
    net = tox.Net([np.random.default_rng(1).standard_normal(1 << tox.ODDS_BITS).astype(np.float32)] * 2, {w: k for k, w in enumerate(words[:500])})
    texts = [[rng.choice(words) for _ in range(n)] for n in (3, 40, 13_000, 30_000, 1, 700)]
    high, n = tox._highest(net, [None, *(b" ".join(t).decode() for t in texts), ""], len(texts) + 2)
    assert n[0] == n[-1] == high[0] == high[-1] == 0
    for k, t in enumerate(texts, 1):
        each = net.scores([t[a : a + tox.WINDOW] for a in tox.window_starts(len(t))])[0]
        assert n[k] == len(each) and abs(high[k] - each.max()) < 1e-4
