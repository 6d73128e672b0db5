import numpy as np

from pseudolake.llm import ann


def test_recall_and_ties(spark):
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((20, 64))
    x = (centres[rng.integers(0, 20, 1500)] + 0.6 * rng.standard_normal((1500, 64))).astype(np.float32)
    x[300:420] = x[300]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(2000, None), (2001, []), (2002, [0.0] * 64), (2003, [None] + [1.0] * 63), (2004, [float("nan")] * 64), (None, [1.0] * 64), (2005, [1.0] * 7)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as rank", "2 as q")
    idx = ann.index(df)
    assert idx.count() == 1501
    got = ann.search(idx, idx.where("vec_id % 20 = 0")).toPandas()
    hit = total = 0
    for q in range(0, 1500, 20):
        s = (x.astype(float) * x[q].astype(float)).sum(1)
        want = [i for i in np.lexsort((np.arange(1500), -s)) if i != q][:20]
        mine = got[got.query_id == q].sort_values("rank")
        assert mine["rank"].tolist() == list(range(1, 21))
        assert np.allclose(mine.score, s[mine.vec_id])
        hit += len(set(want) & set(mine.vec_id))
        total += 20
        if q in (300, 320):
            assert mine.vec_id.tolist() == want
    assert hit / total > 0.99
    assert set(got.query_id) == set(range(0, 1500, 20))
    assert ann.search(idx.limit(0), idx.limit(0)).count() == 0


def test_error_bound_holds():
    rng = np.random.default_rng(9)
    x, q = rng.standard_normal((3000, 64)).astype(np.float32), rng.standard_normal((20, 64)).astype(np.float32)
    rot = ann.rotation(64)
    code, norm, corr = ann.encode(x, rot)
    est, err = ann.estimates(code, corr, q, rot)
    true = (q / np.linalg.norm(q, axis=1, keepdims=True)) @ (x / norm[:, None]).T
    assert (np.abs(est - true) <= err).mean() > 0.99
