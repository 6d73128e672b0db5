"""SimHash near-duplicates by pivot distance tables.

A text's fingerprint has bit i set if over half of the XXH64 values (seed 42) of its 3-word shingles
have. Equal fingerprints are one row from there on. Each distinct fingerprint is measured against fixed
reference fingerprints (the pivots): by the triangle inequality two fingerprints within r bits differ by r
at most in every pivot distance.

The references come in families, one for each of five groups of bits: within a family they differ only
inside its group. If none of the (two at most) differing bits lies in a group, the distances to that
family, relative to its first reference, are equal. Two bits leave three of five groups alone, so the ten
choices of three families give ten keys, one of which linked fingerprints share. Pairs that share a key
are discarded if the largest difference of their distances to further, general references exceeds r, and
the rest is verified by the differing bits. A key shared by more than MAX_BUCKET fingerprints is not
paired: its members are linked through the fingerprints one bit away, which two of them share exactly if
they differ by two bits at most. Both ways are exact; none drops a link.

Null and empty texts have the fingerprint zero and are linked like any other. Repeated rows each return a
row. A null doc_id never becomes a component_id unless a component has no other.
"""

from __future__ import annotations

import random
from itertools import combinations, repeat

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bits_to_long, components, cut, map_batches, table

RADIUS = 2
#: Members of a key that are paired with each other; more are linked through their one-bit neighbours.
MAX_BUCKET = 32
#: Groups of bits, references of a group's family, general references.
GROUPS, FAMILY, GENERAL = 5, 10, 16


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def references() -> tuple[list[list[int]], list[int]]:
    """The families (the first reference of each is zero) and the general references, from a fixed seed."""
    rng = random.Random(20)
    edges = [64 * g // GROUPS for g in range(GROUPS + 1)]
    families = []
    for lo, hi in zip(edges, edges[1:]):
        mask = (1 << hi) - (1 << lo)
        families.append([0] + [rng.getrandbits(64) & mask for _ in range(FAMILY)])
    return families, [rng.getrandbits(64) for _ in range(GENERAL)]


def _shingle_hashes(text: str | None) -> np.ndarray:
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if len(words) < 3:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(size) - 1
    parts = map(joined.__getitem__, map(slice, (ends - size + 1)[:-2].tolist(), ends[2:].tolist()))
    return np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(42)), np.uint64, len(words) - 2)


def _bit_counts(h: np.ndarray, step: int = 1 << 16) -> np.ndarray:
    total = np.zeros(64, np.int64)
    for k in range(0, len(h), step):
        total += np.unpackbits(h[k : k + step].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return total


def fingerprints_of(texts: list[str | None]) -> np.ndarray:
    """Signed 64-bit fingerprints; zero for texts without words."""
    counts, n = np.zeros((len(texts), 64), np.int64), np.zeros(len(texts), np.int64)
    for k, text in enumerate(texts):
        h = _shingle_hashes(text)
        n[k] = len(h)
        if len(h):
            counts[k] = _bit_counts(h)
    return bits_to_long(counts * 2 > n[:, None])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, fp, text_hash) for every row of `docs`."""

    def make():
        def step(batch):
            return {"doc_id": batch["doc_id"], "fp": fingerprints_of(batch["text"]), "text_hash": batch["text_hash"]}

        return step

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), _text_hash(text_col).alias("text_hash"))
    return map_batches(rows, "doc_id long, fp long, text_hash long", make)


def _text_hash(text_col: str = "text") -> Column:
    return F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))


def pivot_table(fps: DataFrame) -> DataFrame:
    """Rows (fp, pivots, keys): distances to the general references, a key for each choice of families."""
    families, general = references()
    chosen = list(combinations(range(GROUPS), GROUPS - RADIUS))
    radix = 29 ** np.arange(FAMILY, dtype=np.int64)  # relative distances lie within 13 of zero

    def make():
        refs = np.array(general, np.uint64)
        fams = np.array(families, np.uint64)

        def step(batch):
            fp = np.array(batch["fp"], np.int64).view(np.uint64)
            far = np.bitwise_count(fp[:, None, None] ^ fams).astype(np.int64)
            code = ((far[:, :, 1:] - far[:, :, :1]) * radix).sum(2)
            keys = np.zeros((len(fp), len(chosen)), np.int64)
            for k, group in enumerate(chosen):
                keys[:, k] = k
                for g in group:
                    keys[:, k] = keys[:, k] * 6364136223846793005 + code[:, g]
            pivots = np.bitwise_count(fp[:, None] ^ refs).astype(np.int32)
            return {"fp": batch["fp"], "pivots": list(pivots), "keys": list(keys)}

        return step

    return map_batches(fps.select("fp"), "fp long, pivots array<int>, keys array<long>", make)


def links(fps: DataFrame) -> DataFrame:
    """Links (u, v) between distinct fingerprints within RADIUS bits, enough to connect all that are linked."""
    keyed = pivot_table(fps).select("fp", "pivots", F.explode("keys").alias("key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = cut(keyed.join(sizes, "key"))
    few = shared.where(F.col("n") <= MAX_BUCKET)
    other = few.select("key", F.col("fp").alias("v"), F.col("pivots").alias("pivots_v"))
    far = F.array_max(F.zip_with("pivots", "pivots_v", lambda a, b: F.abs(a - b)))
    pairs = few.join(other, "key").where((F.col("fp") < F.col("v")) & (far <= RADIUS) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("v"))) <= RADIUS))
    many = shared.where(F.col("n") > MAX_BUCKET).select("fp").distinct()
    flips = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(_signed(1 << b)).cast("long")) for b in range(64)])
    near = many.select("fp", F.explode(flips).alias("mid"))
    met = near.groupBy("mid").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)  # 65 at most
    stars = met.select(F.explode("fps").alias("u"), F.array_min("fps").alias("v")).where("u <> v")
    return pairs.select(F.col("fp").alias("u"), "v").unionByName(stars)


def _grouped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, fp, text_hash, root, component_id) for every row of `docs`; root is one of the component's fingerprints."""
    marked = cut(fingerprints(docs, id_col, text_col))
    distinct = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("first")))
    linked = components(links(distinct))
    with_root = linked.join(distinct, F.col("node") == F.col("fp")).select("fp", "root", "first")
    least = with_root.groupBy("root").agg(F.min("first").alias("low"))
    named = with_root.join(least, "root").select("fp", "root", "low")
    final = cut(distinct.join(named, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), F.coalesce("low", "first").alias("component_id")))
    return marked.join(final, "fp")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, fp, component_id) for every row of `docs`."""
    return _grouped(docs, id_col, text_col).select("doc_id", "fp", "component_id")


def keep_first(docs: DataFrame) -> DataFrame:
    """One row of each group of near-duplicates, with all its columns: that of the smallest doc_id (null last), then of the smallest fingerprint.

    A component is named by a fingerprint here, so that texts that share a doc_id stay apart. Of equal rows one is kept, of
    rows with the same id and text any.
    """
    least = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "fp", "text_hash")
    chosen = _grouped(docs).groupBy("root").agg(F.min(least).alias("one")).select("one.doc_id", "one.text_hash").distinct()
    rows = docs.select(F.struct(*docs.columns).alias("kept"), F.col("doc_id").cast("long").alias("doc_id"), _text_hash().alias("text_hash"))
    chosen = chosen.select(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"))
    kept = rows.join(chosen, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("hash")), "left_semi")
    return kept.dropDuplicates(["doc_id", "text_hash"]).select("kept.*")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


QUERIES = {"op7_simhash": op7_simhash}
ORACLE_SQL: dict[str, str] = {}
