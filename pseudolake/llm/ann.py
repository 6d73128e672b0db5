"""Nearest neighbours by randomly rotated one-bit codes.

Each vector is scaled to length one, padded to BITS dimensions, rotated by one seeded random rotation and
kept as the signs: BITS packed bits, its norm and the inner product of the signs' unit vector with it (the
correction). A query's rotated values are quantised to four bits, so that an inner product with the signs is
a few ANDs and bit counts; divided by the correction it estimates the cosine without bias, with an error
bound of EPS / sqrt(BITS - 1) times sqrt(1 - correction**2) / correction. Every candidate whose upper bound
reaches the k-th largest lower bound is scored again on the original vectors in double precision.

Queries and candidates meet in blocks, each query with each candidate block once; a block's k nearest
leave it. Null vectors, zero vectors and vectors with null or non-finite components take no part; vectors of
different lengths are never compared. Repeated vec_ids are candidates of their own, but never of that id's query.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, map_batches, table

BITS, EPS, QUERY_LEVELS = 256, 3.0, 15
#: Rows of a block of candidates and of a block of queries.
CANDIDATES, QUERIES_A_BLOCK = 4096, 4096


def rotation(dim: int, bits: int = BITS, seed: int = 7) -> np.ndarray:
    """dim x bits: the rows a random rotation of `bits` dimensions keeps for vectors padded with zeros."""
    q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((bits, bits)))
    return q[:dim].astype(np.float32)


def encode(x: np.ndarray, rot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed signs (n x bits/64 unsigned), norms, corrections."""
    norm = np.linalg.norm(x.astype(np.float64), axis=1)
    r = (x / norm[:, None]).astype(np.float32) @ rot
    code = np.packbits(r > 0, axis=1, bitorder="little").view("<u8")
    return code, norm, np.abs(r).sum(1) / np.sqrt(rot.shape[1])


def estimates(code: np.ndarray, corr: np.ndarray, q: np.ndarray, rot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated cosines (queries x candidates) and the bound of their error (by candidate)."""
    bits = rot.shape[1]
    r = (q / np.linalg.norm(q, axis=1, keepdims=True)).astype(np.float32) @ rot
    low = r.min(1, keepdims=True)
    step = np.maximum((r.max(1, keepdims=True) - low) / QUERY_LEVELS, 1e-12)
    level = np.rint((r - low) / step).astype(np.uint8)
    dots = np.zeros((len(q), len(code)), np.int32)
    ones = np.bitwise_count(code).sum(1, dtype=np.int32)
    for plane in range(4):
        p = np.packbits((level >> plane) & 1, axis=1, bitorder="little").view("<u8")
        for w in range(code.shape[1]):
            dots += np.bitwise_count(p[:, w, None] & code[None, :, w]).astype(np.int32) << plane
    total = low * bits + step * level.sum(1, dtype=np.int64)[:, None]
    signed = 2 * (low * ones[None, :] + step * dots) - total  # of the query with the signs
    corr = np.maximum(corr, 1e-6)
    err = EPS * np.sqrt(np.maximum(1 - corr**2, 0)) / corr / np.sqrt(bits - 1) + 4 * step.max() / corr / np.sqrt(12)
    return signed / np.sqrt(bits) / corr[None, :], err


def nearest(cid: np.ndarray, x: np.ndarray, code: np.ndarray, norm: np.ndarray, corr: np.ndarray, qid: np.ndarray, q: np.ndarray, k: int):
    """(query_id, vec_id, score) of the k best candidates of each query within these blocks."""
    rot = rotation(x.shape[1])
    out: list[tuple] = []
    for a in range(0, len(q), 64):
        est, err = estimates(code, corr, q[a : a + 64], rot)
        for row, i in enumerate(range(a, min(a + 64, len(q)))):
            at = np.flatnonzero(cid != qid[i])
            if not len(at):
                continue
            e, w = est[row, at] * norm[at], err[at] * norm[at]
            n = min(k, len(at))
            floor = np.partition(e - w, len(at) - n)[len(at) - n]
            at = at[e + w >= floor]
            score = np.cumsum(x[at] * q[i], axis=1)[:, -1]  # in the order of components, whatever the row
            best = np.lexsort((cid[at], -score))[:k]
            out.append((np.full(len(best), qid[i]), cid[at[best]], score[best]))
    return out


def index(vectors: DataFrame) -> DataFrame:
    """The code of every vector that takes part: (vec_id, dim, embedding, code binary, norm, corr)."""

    def make():
        rots: dict[int, np.ndarray] = {}

        def step(batch):
            out: dict[str, list] = {c: [] for c in ("vec_id", "dim", "embedding", "code", "norm", "corr")}
            by_dim: dict[int, list] = {}
            for i, v in zip(batch["vec_id"], batch["embedding"]):
                if i is not None and v and None not in v and np.isfinite(v).all() and any(v):
                    by_dim.setdefault(len(v), []).append((i, v))
            for dim, rows in by_dim.items():
                if dim not in rots:
                    rots[dim] = rotation(dim, max(BITS, -(-dim // 64) * 64))
                x = np.array([v for _, v in rows], np.float64)
                code, norm, corr = encode(x, rots[dim])
                out["vec_id"] += [i for i, _ in rows]
                out["dim"] += [dim] * len(rows)
                out["embedding"] += [v.tobytes() for v in x]
                out["code"] += [c.tobytes() for c in code]
                out["norm"] += norm.tolist()
                out["corr"] += corr.tolist()
            return out

        return step

    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
    return map_batches(rows, "vec_id long, dim int, embedding binary, code binary, norm double, corr double", make)


def search(indexed: DataFrame, query_rows: DataFrame, k: int = 20) -> DataFrame:
    """The k nearest candidates of each query: (query_id, rank, vec_id, score)."""
    blocks = max(1, -(-indexed.count() // CANDIDATES))
    query_blocks = max(1, -(-query_rows.count() // QUERIES_A_BLOCK))
    cand = indexed.withColumn("c", F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(blocks))).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    ask = query_rows.select(F.col("vec_id").alias("query_id"), "dim", "embedding", F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(query_blocks)).cast("int").alias("q"))
    ask = ask.withColumn("c", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))

    def meet(c: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        parts = []
        if len(c) and len(q):
            mat = lambda s, t: np.frombuffer(b"".join(s), t).reshape(len(s), -1)
            parts = nearest(c["vec_id"].to_numpy(), mat(c["embedding"], "<f8"), mat(c["code"], "<u8"), c["norm"].to_numpy(), c["corr"].to_numpy(), q["query_id"].to_numpy(), mat(q["embedding"], "<f8"), k)
        cols = [np.concatenate(x) for x in zip(*parts)] or [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), cols)))

    keys = ["c", "q", "dim"]
    met = cand.groupBy(*keys).cogroup(ask.groupBy(*keys)).applyInPandas(meet, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    indexed = cut(index(table(spark, sf_dir, "embeddings")))
    return search(indexed, indexed.where("vec_id % 20 = 0"))


QUERIES = {"op10_nearest": op10_nearest}
ORACLE_SQL = {
    "op10_nearest": """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings WHERE embedding IS NOT NULL
  AND NOT list_bool_or(list_transform(embedding, lambda e: e IS NULL OR NOT isfinite(e))) AND list_bool_or(list_transform(embedding, lambda e: e <> 0))),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.x, c.x), lambda z: z[1] * z[2])) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id AND len(q.x) = len(c.x)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20"""
}
