"""Benchmark decontamination by a prefix-filtered set join.

A window is `window` consecutive words of an item (a shorter item is one window). Its shingles are runs of SHINGLE
words (a window of fewer words is one shingle of its own size). They are ordered by how rare they are in the
corpus; a document that holds a window holds its rarest shingle, so for exact containment that one is the
necessary prefix (and a window with a shingle that the corpus lacks occurs nowhere). The join is on prefixes: a
prefix at place p of a document with offset o in a window proposes the place p - o, which has to lie inside the
document (position and length bounds), and the words there are then compared with the whole window.

Both sides of the join are shuffled; only a bitmap of bounded size (common.MAX_BITS bits) is broadcast, which keeps the places of
documents apart that can't be a prefix. Texts are read twice, whatever the size of the benchmark (and a third time to
count words). Equal texts are joined once, by a 128-bit hash.

Null and empty texts have no words and no hits; items without words or with a null id take no part;
repeated rows are judged one by one; other columns of the inputs are not read.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bitmap, map_batches, may_be, mixed, stored, table, words_of

SHINGLE = 3
#: Hashes that a task holds before it counts them.
HELD = 1_000_000


def shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    """64-bit hashes of all runs of `size` words; equal runs have equal hashes, others may."""
    if len(words) < size:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(zlib.crc32, words), np.uint64, len(words))
    m = len(w) - size + 1
    h = np.full(m, size, np.uint64)
    for k in range(size):
        h = mixed(h + w[k : k + m])
    return h


def benchmark_windows(benchmark: DataFrame, window: int = 10) -> DataFrame:
    """Rows (item string, window binary (a digest), words array<binary>) for each window of each item."""

    def make():
        def step(batch):
            out: dict[str, list] = {"item": [], "window": [], "words": []}
            for item, text in zip(batch["item"], batch["text"]):
                w = words_of(text)
                for k in range(max(1, len(w) - window + 1) if w and item is not None else 0):
                    win = w[k : k + window]
                    out["item"].append(item)
                    out["window"].append(hashlib.blake2b(b" ".join(win), digest_size=16).digest())
                    out["words"].append(win)
            return out

        return step

    rows = benchmark.select(F.col("item_id").cast("string").alias("item"), "text")
    return map_batches(rows, "item string, window binary, words array<binary>", make)


def _window_shingles(windows: DataFrame) -> DataFrame:
    """(window, n, shingle, offset) for each shingle of each distinct window."""

    def make():
        def step(batch):
            out: dict[str, list] = {"window": [], "n": [], "shingle": [], "offset": []}
            for win, words in zip(batch["window"], batch["words"]):
                for o, h in enumerate(shingle_hashes(words, min(SHINGLE, len(words))).view(np.int64).tolist()):
                    for c, x in zip(out, (win, len(words), h, o)):
                        out[c].append(x)
            return out

        return step

    return map_batches(windows.select("window", "words"), "window binary, n int, shingle long, offset int", make)


def _shingle_counts(docs: DataFrame, shared, sizes: list[int]) -> DataFrame:
    """(shingle, n): how often the hashes in the bitmap occur in all documents."""

    def make():
        bits, size = shared.value

        def step(batch):
            held, total, found = [], 0, []

            def pour():
                if held:
                    found.append(np.unique(np.concatenate(held), return_counts=True))
                    held.clear()

            for text in batch["text"]:
                words = words_of(text)
                for k in sizes:
                    h = shingle_hashes(words, k)
                    held.append(h[may_be(h, bits, size)])
                    total += len(held[-1])
                if total > HELD:
                    pour()
                    total = 0
            pour()
            return {"shingle": np.concatenate([u for u, _ in found]).view(np.int64), "n": np.concatenate([n for _, n in found])} if found else None

        return step

    return map_batches(docs.select("text"), "shingle long, n long", make).groupBy("shingle").agg(F.sum("n").alias("n"))


def _candidates(docs: DataFrame, shared, sizes: list[int], window: int) -> DataFrame:
    """(key1, key2, place, n_words, shingle, around, at): places of documents whose shingle may be a prefix, with the words around (place: around[at])."""

    def make():
        bits, size = shared.value

        def step(batch):
            out: dict[str, list] = {c: [] for c in ("key1", "key2", "place", "n_words", "shingle", "around", "at")}
            for key1, key2, text in zip(batch["key1"], batch["key2"], batch["text"]):
                words = words_of(text)
                for k in sizes:
                    h = shingle_hashes(words, k)
                    for p in may_be(h, bits, size).tolist():
                        a = max(0, p - window + 1)
                        for c, x in zip(out, (key1, key2, p, len(words), int(h[p].view(np.int64)), words[a : p + window], p - a)):
                            out[c].append(x)
            return out

        return step

    schema = "key1 long, key2 long, place int, n_words int, shingle long, around array<binary>, at int"
    return map_batches(docs.select(*text_keys(), F.col("text").cast("string").alias("text")), schema, make)


def text_keys() -> list[Column]:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return [F.xxhash64(text).alias("key1"), F.xxhash64(F.lit(1), text).alias("key2")]


def found_windows(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """(key1, key2, s, e, item): where windows of items occur in the distinct texts of `docs` (keys: text_keys), as word ranges."""
    sc = docs.sparkSession.sparkContext
    every = stored(benchmark_windows(benchmark, window).distinct())
    windows = stored(every.select("window", "words").dropDuplicates(["window"]))
    shingles = stored(_window_shingles(windows))
    sizes = sorted(r.size for r in shingles.select(F.least("n", F.lit(SHINGLE)).alias("size")).distinct().collect())  # SHINGLE rows at most
    texts = docs.select("text")
    counts = _shingle_counts(texts, sc.broadcast(bitmap(shingles.select("shingle").distinct(), "shingle")), sizes).withColumnRenamed("n", "seen")
    ranked = shingles.join(counts, "shingle", "left").groupBy("window").agg(F.min(F.struct(F.coalesce("seen", F.lit(0)).alias("seen"), "shingle", "offset", "n")).alias("rarest"))
    prefixes = stored(ranked.where("rarest.seen > 0").select("window", "rarest.shingle", "rarest.offset", "rarest.n"))
    cand = _candidates(docs, sc.broadcast(bitmap(prefixes.select("shingle").distinct(), "shingle")), sizes, window)
    begin = F.col("place") - F.col("offset")
    near = cand.join(prefixes.join(windows, "window"), "shingle").where((begin >= 0) & (begin + F.col("n") <= F.col("n_words")))
    same = near.where(F.slice("around", F.col("at") - F.col("offset") + 1, F.col("n")) == F.col("words"))
    hits = same.select("key1", "key2", begin.alias("s"), (begin + F.col("n")).alias("e"), "window").distinct()
    return hits.join(every.select("window", "item"), "window").drop("window")


def _merged(spans: Column) -> Column:
    """Sorted ranges without those that begin inside the range before; ranges that touch become one."""
    none = F.array().cast("array<struct<s:int,e:int>>")

    def add(a: Column, x: Column) -> Column:
        last = F.element_at(a, -1)
        joins = (F.size(a) > 0) & (x["s"] <= F.try_element_at(a, F.lit(-1))["e"])
        grown = F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.struct(last["s"].alias("s"), F.greatest(last["e"], x["e"]).alias("e"))))
        return F.when(joins, grown).otherwise(F.concat(a, F.array(x)))

    return F.aggregate(F.array_sort(spans), none, add)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, keep: list[str] | None = None) -> DataFrame:
    """Per row of `docs`: the columns `keep` (doc_id, if None), n_words, hits (merged word ranges), items (sorted ids)."""
    kept = F.struct(*[F.col(c) for c in (["doc_id"] if keep is None else keep)])
    found = found_windows(docs, benchmark, window).groupBy("key1", "key2").agg(
        _merged(F.collect_set(F.struct("s", "e"))).alias("hits"), F.array_sort(F.collect_set("item")).alias("items"),
    )
    rows = docs.select(kept.alias("kept"), *text_keys(), F.col("text").cast("string").alias("text"))

    def make():
        def step(batch):
            return {c: batch[c] for c in ("kept", "key1", "key2")} | {"n_words": [len(words_of(t)) for t in batch["text"]]}

        return step

    kind = rows.schema["kept"].dataType.simpleString()
    counted = map_batches(rows, f"kept {kind}, key1 long, key2 long, n_words long", make)
    joined = counted.join(found, ["key1", "key2"], "left")
    return joined.select(
        "kept", "n_words", F.coalesce("hits", F.array().cast("array<struct<s:int,e:int>>")).alias("hits"), F.coalesce("items", F.array().cast("array<string>")).alias("items")
    )


def n_hit(hits: Column) -> Column:
    return F.aggregate(hits, F.lit(0).cast("long"), lambda a, x: a + x["e"] - x["s"])


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """The rows of `docs` that hold no window of the benchmark, with all their columns."""
    found = found_windows(docs, benchmark, window).select("key1", "key2").distinct()
    rows = docs.select(F.struct(*docs.columns).alias("kept"), *text_keys())
    return rows.join(found, ["key1", "key2"], "left_anti").select("kept.*")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    hit = n_hit(F.col("hits"))
    return found.select(
        F.col("kept.doc_id").alias("doc_id"), "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )


QUERIES = {"op1_decontamination": op1_decontamination}

_SPLIT = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE_SQL = {
    "op1_decontamination": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_SPLIT} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_SPLIT} AS w FROM benchmark WHERE item_id IS NOT NULL),
bw AS (SELECT DISTINCT item, w[k:k + 9] AS win FROM (SELECT item, w, unnest(range(1, greatest(2, len(w) - 8))) AS k FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT len(win) AS n FROM bw),
dw AS (SELECT r, n, unnest(range(1, len(w) - n + 2)) AS k, w FROM d, sizes WHERE len(w) >= n),
hit AS (SELECT r, k, n, item FROM (SELECT r, k, n, w[k:k + n - 1] AS win FROM dw) JOIN bw USING (win)),
places AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS p FROM hit) GROUP BY r),
items AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS s FROM hit GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN places USING (r) LEFT JOIN items USING (r)"""
}
