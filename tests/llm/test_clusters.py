import hashlib

import numpy as np

from pseudolake.llm import clusters

FIELDS = "vec_id long, embedding array<float>"


def brute(rows, k=8, rounds=10):
    """Clusters by a full scan of all centroids in Python integers; returns rows as sorted tuples."""
    kept = [(i, [int(np.floor(1024 * float(np.float32(x)))) for x in v]) for i, v in rows if v and len(v) == 64 and all(x is not None and abs(x) < 131072 for x in v)]
    starts = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    c = [v for _, v in starts[:k]]
    for r in range(rounds + 1):
        d = [[sum((a - b) ** 2 for a, b in zip(v, w)) for w in c] for _, v in kept]
        near = [min(range(len(c)), key=lambda j: (e[j], j)) for e in d]
        if r < rounds:
            for j in range(len(c)):
                if own := [v for (_, v), n in zip(kept, near) if n == j]:
                    c[j] = [sum(x) // len(own) for x in zip(*own)]
    dist = [e[n] for e, n in zip(d, near)]
    inertia = [sum(x for x, n in zip(dist, near) if n == j) for j in range(len(c))]
    sha = [hashlib.sha256(",".join(map(str, w)).encode()).hexdigest() for w in c]
    return sorted(((i, n, x, inertia[n], sum(inertia), sha[n]) for (i, _), n, x in zip(kept, near, dist)), key=str)


def found(df, **more):
    names = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    return sorted((tuple(r[c] for c in names) for r in clusters.kmeans(df, **more).collect()), key=str)


def test_equals_full_scans_and_scans_less(spark, monkeypatch):
    monkeypatch.setattr(clusters, "BLOCK", 64)  # several blocks
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((8, 64))
    x = (0.3 * (centres[rng.integers(0, 8, 600)] + 0.7 * rng.standard_normal((600, 64)))).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, FIELDS)
    assert found(df) == brute(rows)
    scans = [r["scans"] for r in clusters.kmeans(df).collect()]
    assert max(scans) <= 11 and sum(scans) < 0.95 * 11 * len(rows)


def test_odd_rows(spark):
    one, two = [0.5] * 64, [-0.25] * 63 + [7.0]
    rows = [(1, one), (1, one), (1, two), (None, two), (None, one), (2, None), (3, []), (4, [1.0] * 63), (5, [None] + [1.0] * 63), (6, [float("nan")] * 64)]
    rows += [(7, [float("-inf")] + [1.0] * 63), (8, [200000.0] * 64), (9, [131071.0, -131071.0] * 32), (10, two), (11, one), (12, [0.0] * 64)]
    df = spark.createDataFrame(rows, FIELDS).selectExpr("*", "1 as block", "'x' as cluster", "2 as distance", "3 as ints")
    assert found(df) == brute(rows)
    assert found(df, k=3, rounds=2) == brute(rows, 3, 2)  # centroids at equal distance, an empty cluster
    assert clusters.kmeans(df.limit(0)).collect() == [] and clusters.kmeans(df.where("vec_id = 3")).columns[0] == "vec_id"
    assert len(found(df.where("vec_id = 12"))) == 1


def test_no_table_is_left_in_the_catalogue(spark):
    clusters.kmeans(spark.createDataFrame([(i, [i / 7.0] * 64) for i in range(20)], FIELDS)).collect()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("clusters_")]
