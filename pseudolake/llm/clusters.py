"""Exact k-means over integer vectors with heap-ordered bounds.

A vector's exact scan yields its cluster and the gap between the distances to its second nearest and its nearest
centroid. When centroids move, a cluster's gaps shrink by its own drift and by the largest drift of the others, so
each cluster keeps one running sum of that (its offset) and a heap of its vectors by `gap + offset at the scan`.
A round pops the vectors whose key the offset has reached, scans only those again and pushes them onto the heap of
their cluster; for all others the nearest centroid provably hasn't changed. Bounds are doubles with a margin above
their rounding, scans and sums are integers, so that clusters, centroids and distances are exact.

Vectors lie in blocks of about BLOCK rows, written once; each block has a heap for every cluster (as an array in
ascending order, which is a heap: what pops is a prefix). Both tables are bucketed by block, so a round reads a block
beside its heaps without a shuffle, writes only heaps (17 bytes a vector), and adds up what vectors that changed their
cluster move: k * (dim + 1) rows reach the driver. A round's heaps go when the next ones are written. A lost executor
costs its tasks of the running round, as every round starts from tables in the shared folder.

Vectors that are null or of another length, that hold a null or non-finite component or one of 131072 or more (a squared
distance has to fit a long) take no part. Rows without a vec_id are clustered, but start no centroid. Repeated vec_ids
are vectors of their own; equal hashes are ordered by components. Fewer vectors than k start fewer centroids; an empty
table gives no rows. Vectors are dealt to blocks by content and place in the input, so `vectors` should be read from files.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint_folder, remove, table

BLOCK, LIMIT = 8192, 131072.0
STATE = "block long, slots binary, keys binary, ends binary, scans binary, moved array<long>, ids array<long>, distances binary"
RESULT = "vec_id long, cluster int, distance long, scans int"


def integers(vectors: DataFrame, dim: int = 64, scale: int = 1024) -> DataFrame:
    """(vec_id, ints) of the vectors that take part."""
    x = F.col("embedding").cast("array<double>")
    fit = (F.size(x) == dim) & F.forall(x, lambda v: v.isNotNull() & (F.abs(v) < LIMIT))  # NaN is larger than any number
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(F.coalesce(fit, F.lit(False)), x).alias("x")).where("x is not null")
    return rows.select("vec_id", F.transform("x", lambda v: F.floor(v * scale).cast("int")).alias("ints"))


def scan(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each vector (the smaller number, if equal) and a gap that is surely not too large."""
    d = np.stack([((x - c) ** 2).sum(1) for c in centroids], 1)
    near = d.argmin(1)
    u = np.sqrt(np.take_along_axis(d, near[:, None], 1)[:, 0])
    if len(centroids) == 1:
        return near, np.full(len(x), np.inf)
    np.put_along_axis(d, near[:, None], np.iinfo(np.int64).max, 1)
    second = np.sqrt(d.min(1))
    return near, second - u - (second + u) * 1e-12 - 1e-9


def first_heaps(x: np.ndarray, centroids: np.ndarray):
    """Heaps of a block after its first scan: slots and keys by cluster and key, where each cluster ends, and scans."""
    near, gap = scan(x, centroids)
    order = np.lexsort((gap, near))
    return order.astype(np.int32), gap[order], np.searchsorted(near[order], np.arange(len(centroids)), "right").astype(np.int32), np.ones(len(x), np.int16)


def pop_and_push(x: np.ndarray, slots: np.ndarray, keys: np.ndarray, ends: np.ndarray, scans: np.ndarray, centroids: np.ndarray, offsets: np.ndarray):
    """The heaps after a round, and (slot, old cluster, new cluster) of the vectors that changed it."""
    k = len(centroids)
    starts = np.r_[0, ends[:-1]].astype(np.int64)
    pops = np.array([np.searchsorted(keys[a:b], off, "right") for a, b, off in zip(starts, ends, offsets)], np.int64)
    old = np.repeat(np.arange(k), pops)
    popped = slots[np.concatenate([np.arange(a, a + n) for a, n in zip(starts, pops)])]
    near, gap = scan(x[popped], centroids)
    scans = scans.copy()
    scans[popped] += 1
    pushed = gap + offsets[near]
    new_slots, new_keys, new_ends = [], [], []
    for j in range(k):
        rest = slice(starts[j] + pops[j], ends[j])
        mine = near == j
        s, key = np.r_[slots[rest], popped[mine]], np.r_[keys[rest], pushed[mine]]
        order = np.argsort(key, kind="stable")
        new_slots.append(s[order])
        new_keys.append(key[order])
        new_ends.append(len(s))
    changed = near != old
    heaps = np.concatenate(new_slots).astype(np.int32), np.concatenate(new_keys), np.cumsum(new_ends).astype(np.int32), scans
    return heaps, (popped[changed], old[changed], near[changed])


def _round(centroids: np.ndarray, offsets: np.ndarray, first: bool, last: bool):
    k, dim = centroids.shape
    names = [f.split()[0] for f in STATE.split(", ")]
    types = [pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]

    def one(row: dict) -> list:
        x = np.frombuffer(row["ints"], "<i4").reshape(-1, dim).astype(np.int64)
        moved = np.zeros((k, dim + 2), np.int64)  # sums of components, count, inertia
        if first:
            heaps = first_heaps(x, centroids)
            cluster = np.repeat(np.arange(k), np.diff(heaps[2], prepend=0))
            added = (heaps[0], cluster)
        else:
            heaps, (slot, old, new) = pop_and_push(
                x, np.frombuffer(row["slots"], "<i4"), np.frombuffer(row["keys"], "<f8"), np.frombuffer(row["ends"], "<i4"), np.frombuffer(row["scans"], "<i2"), centroids, offsets
            )
            added = (slot, new)
            np.subtract.at(moved[:, :dim], old, x[slot])
            np.subtract.at(moved[:, dim], old, 1)
        np.add.at(moved[:, :dim], added[1], x[added[0]])
        np.add.at(moved[:, dim], added[1], 1)
        ids = distances = None
        if last:
            slots, _, ends, _ = heaps
            cluster = np.repeat(np.arange(k), np.diff(ends, prepend=0))
            d = ((x[slots] - centroids[cluster]) ** 2).sum(1)
            np.add.at(moved[:, dim + 1], cluster, d)
            ids, distances = row["ids"], d.tobytes()
        return [row["block"], *(a.tobytes() for a in heaps), moved.ravel().tolist(), ids, distances]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):  # one block at a time
                out = one(batch.slice(i, 1).to_pylist()[0])
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(out, types)], names=names)

    return run


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks as their ids and one byte string of components."""
    for batch in batches:
        for i in range(batch.num_rows):
            ids, lists = batch["rows"].slice(i, 1).flatten().flatten()
            ints = lists.flatten().to_numpy().astype("<i4")
            cols = [batch["block"].slice(i, 1), pa.array([ids.to_pylist()], pa.list_(pa.int64())), pa.array([ints.tobytes()], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["block", "ids", "ints"])


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each vector of a block."""
    for batch in batches:
        for row in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
            slots, ends = np.frombuffer(row["slots"], "<i4"), np.frombuffer(row["ends"], "<i4")
            ids = pa.array(row["ids"], pa.int64()).take(pa.array(slots))
            cluster = np.repeat(np.arange(len(ends), dtype=np.int32), np.diff(ends, prepend=0))
            cols = [ids, pa.array(cluster), pa.array(np.frombuffer(row["distances"], "<i8")), pa.array(np.frombuffer(row["scans"], "<i2")[slots].astype(np.int32))]
            yield pa.RecordBatch.from_arrays(cols, names=["vec_id", "cluster", "distance", "scans"])


def kmeans(vectors: DataFrame, k: int = 8, rounds: int = 10, dim: int = 64, scale: int = 1024, seed: int = 3) -> DataFrame:
    """Per vector: vec_id, cluster, distance (squared), scans (how often it was scanned exactly, of rounds + 1),
    cluster_inertia, inertia, centroid_sha256 (of its final centroid's components, joined by commas)."""
    spark = vectors.sparkSession
    kept = integers(vectors, dim, scale)
    start = kept.where("vec_id is not null").select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256).alias("h"), "ints")
    centroids = np.array([r["ints"] for r in start.orderBy("h", "ints").limit(k).collect()], np.int64).reshape(-1, dim)
    ends = "cluster_inertia long, inertia long, centroid_sha256 string"
    if not len(centroids):
        return spark.createDataFrame([], f"{RESULT}, {ends}")
    k, blocks = len(centroids), max(1, -(-vectors.count() // BLOCK))
    buckets = min(blocks, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-blocks // 16)))
    run = uuid.uuid4().hex
    folder = f"{checkpoint_folder(spark)}/clusters-{run}"

    def keep(df: DataFrame, name: str) -> DataFrame:
        df.write.bucketBy(buckets, "block").option("path", f"{folder}/{name}").format("parquet").saveAsTable(f"clusters_{run}_{name}")
        return spark.table(f"clusters_{run}_{name}")

    def drop(name: str) -> None:
        spark.sql(f"drop table clusters_{run}_{name}")
        remove(spark, f"{folder}/{name}")

    dealt = kept.withColumn("block", F.pmod(F.xxhash64("vec_id", "ints", F.spark_partition_id()), F.lit(blocks))).repartition(buckets, "block")
    data = keep(dealt.groupBy("block").agg(F.collect_list(F.struct("vec_id", "ints")).alias("rows")).mapInArrow(_packed, "block long, ids array<long>, ints binary"), "vectors")

    totals, offsets, state = np.zeros((k, dim + 2), object), np.zeros(k), None
    for r in range(rounds + 1):
        last = r == rounds
        rows = data.join(state.select("block", "slots", "keys", "ends", "scans").hint("shuffle_hash"), "block") if r else data
        state = keep(rows.mapInArrow(_round(centroids, offsets, r == 0, last), STATE), f"heaps{r}")
        if r:
            drop(f"heaps{r - 1}")
        for row in state.select(F.posexplode("moved").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).collect():
            totals[divmod(row["i"], dim + 2)] += row["x"]
        if not last:
            moved = np.array([[s // n for s in t[:dim]] if (n := t[dim]) else list(c) for t, c in zip(totals, centroids)], np.int64)
            drift = np.sqrt(((moved - centroids) ** 2).sum(1))
            others = np.array([max(np.delete(drift, j), default=0.0) for j in range(k)])
            offsets = offsets + (drift + others) * (1 + 1e-12) + 1e-9
            centroids = moved
    opened = spark.read.schema(STATE).parquet(f"{folder}/heaps{rounds}").select("ids", "slots", "ends", "scans", "distances").mapInArrow(_opened, RESULT)
    drop("vectors")
    spark.sql(f"drop table clusters_{run}_heaps{rounds}")  # an external table: its files stay for the result

    def of_cluster(values: list) -> F.Column:
        return F.element_at(F.array(*map(F.lit, values)), F.col("cluster") + 1)

    inertia = [int(t) for t in totals[:, dim + 1]]
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    return opened.withColumns({"cluster_inertia": of_cluster(inertia).cast("long"), "inertia": F.lit(sum(inertia)).cast("long"), "centroid_sha256": of_cluster(digests)})


def op11_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmeans(table(spark, sf_dir, "embeddings")).drop("scans")


def _sql(k: int = 8, rounds: int = 10) -> str:
    """One assignment and one update a round, over lists of integers; floor division of negative sums written out."""
    out = [
        """WITH kept AS MATERIALIZED (SELECT row_number() OVER () AS i, vec_id, list_transform(embedding::DOUBLE[], lambda x: CAST(floor(1024 * x) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND NOT list_bool_or(list_transform(embedding, lambda e: e IS NULL OR NOT isfinite(e) OR abs(e) >= 131072)))""",
        f"""c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY sha256('3:' || vec_id), v) - 1 AS INTEGER) AS cluster, v AS c FROM kept WHERE vec_id IS NOT NULL
  QUALIFY cluster < {k})""",
    ]
    for r in range(rounds + 1):
        out.append(
            f"""a{r} AS MATERIALIZED (SELECT i, vec_id, v, cluster, d FROM (SELECT i, vec_id, v, cluster, CAST(list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d
  FROM kept, c{r}) QUALIFY row_number() OVER (PARTITION BY i ORDER BY d, cluster) = 1)"""
        )
        if r < rounds:
            out.append(
                f"""c{r + 1} AS MATERIALIZED (SELECT cluster, coalesce(m.c, o.c) AS c FROM c{r} o LEFT JOIN (SELECT cluster, list(CASE WHEN s % n < 0 THEN s // n - 1 ELSE s // n END ORDER BY p) AS c FROM
  (SELECT cluster, p, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM (SELECT cluster, unnest(v) AS x, unnest(range(64)) AS p FROM a{r}) GROUP BY cluster, p) GROUP BY cluster) m USING (cluster))"""
            )
    return (
        ",\n".join(out)
        + f"""
SELECT vec_id, cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} USING (cluster)"""
    )


QUERIES = {"op11_clusters": op11_clusters}
ORACLE_SQL = {"op11_clusters": _sql()}
