"""Substring dedup: repeated passages inside documents, by MinHash banding of paragraphs.

A text's words are cut into paragraphs at the ends of sentences and lines; where a sentence has more than LONGEST
words, also before words whose hash is the smallest of some WINDOW words in a row. A cut counts when SHINGLE words or
more lie before it, so paragraphs have SHINGLE words at least, and a passage set into other text falls into the same
ones but for its edges. A paragraph is the set of its 5-word shingles; equal sets are one from there on.

Banding is tuned to full recall: the bands of a set of n shingles are its n - ceil(0.8 n) + 1 smallest MinHash values.
Two sets at a similarity of 0.8 share ceil(0.8 n) shingles at least, so one of these. Sets that collide are joined and
verified by the exact Jaccard similarity. A band of more than MAX_BUCKET sets isn't paired: its sets are banded again by
pairs of their n - ceil(0.8 n) + 2 smallest values, two of which they share by the same count; what is still crowded is
compared in blocks of BLOCK sets, of which only a spanning forest leaves a task. No link is lost, whatever the size.
Linked sets form classes (connected components).

A paragraph repeats if its class is in two documents or more. Neighbouring ones that all stay, or all go, form an island; each end is aligned
with the first and the last document of each class of the island, by the nearest paragraph of such a class, and grows word by word (up to REACH words) as long
as the words agree. Islands with up to GAP words between them are one passage; one of RUN_WORDS words or more is
reported. To be removed are its paragraphs (with the words grown) but the first occurrence of each class.

Null texts and texts of fewer than five words have no paragraphs. Rows that repeat a doc_id count as one document; rows
with a null doc_id take no part. Other columns are not read. Equality is that of 64-bit hashes of shingles, and of
32-bit hashes of words where islands grow.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD_TABLE, components, cut, map_batches, maybe_in, mixed, stored, table, words_of

SHINGLE, SIMILAR = 5, 0.8
LONGEST, WINDOW = 20, 16
MAX_BUCKET, BLOCK = 32, 256
RUN_WORDS, REACH, GAP = 50, 28, 2
SPREAD = 1024  # paragraphs of a class in one task

_ENDS = bytes(10 if chr(b) in ".?!\n\r" else c for b, c in enumerate(WORD_TABLE))


def band_count(n):
    """How many of its n smallest values two similar sets share one of."""
    return n - -(-n * 4 // 5) + 1


def _over_windows(f, x: np.ndarray) -> np.ndarray:
    """f (minimum or maximum) over each WINDOW neighbours."""
    size = 1
    while size < WINDOW:
        step = min(size, WINDOW - size)
        x = f(x[:-step], x[step:])
        size += step
    return x


def _word_hashes(words: list[bytes]) -> np.ndarray:
    return mixed(np.fromiter(map(zlib.crc32, words), np.uint64, len(words)))


def _sets(h: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The sets of runs of `size` words with hashes h: which run, distinct shingles, set_id, and all sets' shingles, ascending.

    Runs of fewer than SHINGLE words have none.
    """
    unit = np.repeat(np.arange(len(size)), size)
    s = np.full(max(0, len(h) - SHINGLE + 1), 7, np.uint64)
    for k in range(SHINGLE):
        s = mixed(s + h[k : k + len(s)])
    inside = unit[: len(s)] == unit[len(unit) - len(s) :]
    s, u = s[inside], unit[: len(s)][inside]
    order = np.lexsort((s, u))
    s, u = s[order], u[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (u[1:] != u[:-1])
    s, u = s[new], u[new]
    new = np.ones(len(s), bool)
    new[1:] = u[1:] != u[:-1]
    first = np.flatnonzero(new)
    return u[first], np.diff(np.append(first, len(s))), np.add.reduceat(mixed(s), first).view(np.int64) if len(s) else first, s


def paragraphs(text: str | None) -> dict[str, np.ndarray]:
    """The paragraphs of a text: at (words before), words, and its set: n (distinct shingles), set_id, and all sets' shingles, ascending."""
    data = (text or "").encode("utf-8", "surrogatepass").translate(_ENDS)
    words = data.split()
    total = len(words)
    if total < SHINGLE:
        none = np.empty(0, np.int64)
        return {"at": none, "words": none, "n": none, "set_id": none, "shingles": none.view(np.uint64)}
    h = _word_hashes(words)
    lowest = np.zeros(total, np.uint64)
    if total > LONGEST:
        low = _over_windows(np.minimum, h)
        edge = np.zeros(WINDOW - 1, np.uint64)
        lowest = _over_windows(np.maximum, np.concatenate([edge, low, edge]))
    is_cut = h == lowest
    starts, last, at = [0], 0, 0
    byte = np.frombuffer(data, np.uint8)
    space = (byte == 32) | (byte == 10)
    begins = ~space
    begins[1:] &= space[:-1]
    ends = np.cumsum(begins)[byte == 10]  # words before each end of a sentence
    for end in [*ends.tolist(), total]:
        if end - at > LONGEST:
            for x in (at + np.flatnonzero(is_cut[at:end])).tolist():
                if x - last >= SHINGLE:
                    starts.append(last := x)
        at = end
        if at - last >= SHINGLE and at < total:
            starts.append(last := at)
    start = np.array(starts, np.int64)
    size = np.diff(np.append(start, total))
    which, n, set_id, shingles = _sets(h, size)
    return {"at": start[which], "words": size[which], "n": n, "set_id": set_id, "shingles": shingles}


def _smallest(p: dict[str, np.ndarray], count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The `count` smallest shingles of each set, one after the other, and how many these are."""
    rank = np.arange(len(p["shingles"])) - np.repeat(np.cumsum(p["n"]) - p["n"], p["n"])
    count = np.minimum(count, p["n"])
    return p["shingles"][rank < np.repeat(count, p["n"])].view(np.int64), count


def _lists(values: list[np.ndarray], sizes: list[np.ndarray]) -> pa.Array:
    offsets = np.r_[0, np.cumsum(np.concatenate(sizes))] if sizes else np.zeros(1)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(values) if values else [], pa.int64()))


def paragraph_table(docs: DataFrame) -> DataFrame:
    """(doc_id, at, words, n, set_id, keys): the paragraphs of all texts with their bands; sets that nothing but an equal set is similar to have none."""

    def make():
        def step(batch):
            out: dict[str, list] = {c: [] for c in ("doc_id", "at", "words", "n", "set_id")}
            keys, sizes = [], []
            for doc, text in zip(batch["doc_id"], batch["text"]):
                p = paragraphs(text)
                for c, x in (("doc_id", np.full(len(p["n"]), doc)), *((c, p[c]) for c in ("at", "words", "n", "set_id"))):
                    out[c].append(x)
                key, size = _smallest(p, np.where(p["n"] >= 4, band_count(p["n"]), 0))
                keys.append(key)
                sizes.append(size)
            return {c: np.concatenate(x) if x else [] for c, x in out.items()} | {"keys": _lists(keys, sizes)}

        return step

    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"))
    return map_batches(rows, "doc_id long, at int, words int, n int, set_id long, keys array<long>", make)


def fetch_sets(docs: DataFrame, rows: DataFrame, ids: DataFrame) -> DataFrame:
    """(set_id, shingles array<long>, ascending) of the sets `ids`, each read again at its place in the first document that has it.

    A set comes twice only where several rows have that document's id.
    """
    ids = ids.distinct()
    place = F.shiftleft(F.col("at").cast("long"), 32).bitwiseOR(F.col("words").cast("long"))
    at = maybe_in(rows.select("set_id", "doc_id", "at", "words"), "set_id", ids).join(ids, "set_id")
    at = at.groupBy("set_id").agg(F.min("doc_id").alias("doc_id"), F.min_by(place, "doc_id").alias("place"))
    asked = stored(at.groupBy("doc_id").agg(F.collect_list("set_id").alias("wanted"), F.collect_list("place").alias("places")))
    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = maybe_in(texts, "doc_id", asked.select("doc_id")).join(asked, "doc_id")

    def make():
        def step(batch):
            ids, values, sizes = [], [], []
            for text, wanted, places in zip(batch["text"], batch["wanted"], batch["places"]):
                words = (text or "").encode("utf-8", "surrogatepass").translate(_ENDS).split()
                runs = [words[x >> 32 : (x >> 32) + (x & 0xFFFFFFFF)] for x in places]
                _, n, set_id, shingles = _sets(_word_hashes([w for run in runs for w in run]), np.fromiter(map(len, runs), np.int64, len(runs)))
                here = np.isin(set_id, np.array(wanted, np.int64))  # another row with the id may have other words there
                ids.append(set_id[here])
                values.append(shingles[np.repeat(here, n)].view(np.int64))
                sizes.append(n[here])
            return {"set_id": np.concatenate(ids) if ids else [], "shingles": _lists(values, sizes)}

        return step

    return stored(map_batches(texts.select("text", "wanted", "places"), "set_id long, shingles array<long>", make))


def _counted(keyed: DataFrame) -> DataFrame:
    """The rows (key, set_id, size) of keys with several sets, and n, their number."""
    several = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    return keyed.join(several, "key")


def _pairs(met: DataFrame) -> DataFrame:
    """(u, v): sets (set_id, size) that meet in a key which isn't crowded, and whose sizes allow for a similarity of 0.8."""
    few = met.where(F.col("n") <= MAX_BUCKET).select("key", F.col("set_id").alias("u"), F.col("size").alias("size_u"))
    both = few.join(few.withColumnsRenamed({"u": "v", "size_u": "size_v"}), "key")
    return both.where("u < v and 5 * size_u >= 4 * size_v and 5 * size_v >= 4 * size_u").select("u", "v").distinct()


def _similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (u, v) whose sets are similar."""
    a = pairs.join(sets.withColumnsRenamed({"set_id": "u", "shingles": "a"}), "u").join(sets.withColumnsRenamed({"set_id": "v", "shingles": "b"}), "v")
    common = F.size(F.array_intersect("a", "b"))
    return a.where(5 * common >= 4 * (F.size("a") + F.size("b") - common)).select("u", "v")


def _forest(pdf: pd.DataFrame) -> pd.DataFrame:
    """Links (u, v) that connect what is similar among the sets of one block, or of one block and another."""
    pdf = pdf.drop_duplicates("set_id", ignore_index=True)
    ids, sizes = pdf["set_id"].to_numpy(np.int64), pdf["shingles"].map(len).to_numpy(np.int64)
    _, token = np.unique(np.concatenate(pdf["shingles"].to_list()), return_inverse=True)
    row = np.repeat(np.arange(len(ids)), sizes)
    order = np.argsort(token, kind="stable")
    edge = np.flatnonzero(np.r_[True, np.diff(token[order]) > 0, True])
    common = np.zeros((len(ids), len(ids)), np.int32)
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
        members = row[order[a:b]]
        common[members[:, None], members] += 1
    near = 5 * common >= 4 * (sizes[:, None] + sizes - common)
    seen, out = np.zeros(len(ids), bool), []
    for k in range(len(ids)):
        todo = [] if seen[k] else [k]
        seen[k] = True
        while todo:
            i = todo.pop()
            new = np.flatnonzero(near[i] & ~seen)
            seen[new] = True
            out += [(ids[i], ids[j]) for j in new]
            todo += new.tolist()
    return pd.DataFrame(out, columns=["u", "v"]).astype("int64")


def crowded_links(sets: DataFrame) -> DataFrame:
    """Links (u, v) that connect all sets of `sets` (set_id, shingles ascending, four or more) that are similar to each other."""
    n = F.size("shingles")
    low = F.slice("shingles", 1, n - F.ceil(n * 4 / 5).cast("int") + 2)
    every = F.flatten(F.transform(low, lambda x, i: F.transform(F.slice(low, i + 2, F.size(low)), lambda y: F.xxhash64(x, y))))
    keyed = sets.select("set_id", F.size("shingles").alias("size"), F.explode(F.array_distinct(every)).alias("key"))
    met = stored(_counted(keyed))
    links = _similar(_pairs(met), sets)
    many = met.where(F.col("n") > MAX_BUCKET).join(sets, "set_id")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    many = many.withColumn("block", F.pmod(F.xxhash64("set_id"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = many.select("key", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "set_id", "shingles")
    return links.unionByName(dealt.groupBy("key", "low", "high").applyInPandas(_forest, "u long, v long"))


def links(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """Links (u, v) between sets, enough to connect all that are similar; rows: paragraph_table(docs)."""
    bands = [f"k{i}" for i in range(band_count(LONGEST + SHINGLE))]
    keys = [F.get("keys", F.lit(i)).alias(c) for i, c in enumerate(bands)]
    one = rows.where(F.size("keys") > 0).select("set_id", "n", *keys).groupBy("set_id").agg(F.min("n").alias("size"), *[F.min(c).alias(c) for c in bands])
    keyed = stored(one.select("set_id", "size", F.explode(F.array_compact(F.array(*bands))).alias("key")))
    # sets are distinct here, so a key of two has its pair in the bounds; keys of more are joined, which splits under skew
    ends = [f(c).alias(f"{name}_{c}") for name, f in (("low", F.min), ("high", F.max)) for c in ("set_id", "size")]
    several = stored(keyed.groupBy("key").agg(F.count("*").alias("n"), *ends).where("n > 1"))
    twos = several.where("n = 2 and 5 * low_size >= 4 * high_size").select(F.col("low_set_id").alias("u"), F.col("high_set_id").alias("v"))
    more = several.where("n > 2").select("key", "n")
    met = stored(maybe_in(keyed, "key", more).join(more, "key"))
    pairs = stored(twos.unionByName(_pairs(met)).distinct())
    crowded = met.where(F.col("n") > MAX_BUCKET).select("set_id").distinct()
    sets = fetch_sets(docs, rows, pairs.select(F.explode(F.array("u", "v")).alias("set_id")).unionByName(crowded))
    return _similar(pairs, sets).unionByName(crowded_links(sets.join(crowded, "set_id", "left_semi")))


def repeated_paragraphs(docs: DataFrame) -> DataFrame:
    """(doc_id, at, words, class_id, first_doc, last_doc, n, gone): paragraphs whose class is in several documents; n: their number."""
    rows = stored(paragraph_table(docs))
    joined = cut(components(links(docs, rows)).select(F.col("node").alias("set_id"), "root"))
    sets = rows.groupBy("set_id").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("n"))
    sets = stored(sets.join(joined, "set_id", "left").where("first < last or root is not null"))
    named = sets.withColumn("class_id", F.coalesce("root", "set_id"))
    classes = named.groupBy("class_id").agg(F.min("first").alias("first_doc"), F.max("last").alias("last_doc"), F.sum("n").alias("n")).where("first_doc < last_doc")
    member = stored(named.select("set_id", "class_id").join(classes, "class_id"))
    narrow = maybe_in(rows.select("doc_id", "at", "words", "set_id"), "set_id", member.select("set_id"))
    hits = narrow.join(member, "set_id").drop("set_id").repartition("doc_id").distinct()
    again = F.row_number().over(Window.partitionBy("doc_id", "class_id").orderBy("at")) > 1
    return hits.withColumn("gone", (F.col("doc_id") != F.col("first_doc")) | again)


def _words_around(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """(doc_id, pos, left, words array<int>): hashes of the words before pos (left, nearest first) or from pos on, for asked (doc_id, pos, left)."""
    asked = stored(asked.groupBy("doc_id").agg(F.collect_set(F.struct("pos", "left")).alias("places")))
    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = maybe_in(texts, "doc_id", asked.select("doc_id")).join(asked, "doc_id")

    def make():
        def step(batch):
            out: dict[str, list] = {c: [] for c in ("doc_id", "pos", "left", "words")}
            for doc, text, places in zip(batch["doc_id"], batch["text"], batch["places"]):
                words = words_of(text)
                for place in places:
                    p, left = place["pos"], place["left"]
                    near = words[max(0, p - REACH) : max(0, p)][::-1] if left else words[max(0, p) : max(0, p + REACH)]
                    for c, x in zip(out, (doc, p, left, np.fromiter(map(zlib.crc32, near), np.uint32, len(near)).view(np.int32))):
                        out[c].append(x)
            return out

        return step

    return map_batches(texts.select("doc_id", "text", "places"), "doc_id long, pos int, left boolean, words array<int>", make)


def _agree(a: Column, b: Column) -> Column:
    """How many of the first elements of two arrays agree."""
    at = F.array_position(F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False))), False).cast("int")
    return F.when(at == 0, F.size(a)).otherwise(at - 1)


def grown_islands(docs: DataFrame, hits: DataFrame) -> DataFrame:
    """(doc_id, island, start, end, left, right, class_id, first_doc): islands of touching paragraphs, with the words they grow by at either end."""
    place = F.shiftleft(F.col("at").cast("long"), 32).bitwiseOR(F.col("words").cast("long"))
    first, last = (F.when(F.col("doc_id") == F.col(c), place) for c in ("first_doc", "last_doc"))
    rep = hits.where("doc_id = first_doc or doc_id = last_doc").groupBy("class_id", "first_doc", "last_doc", "n").agg(F.min(first).alias("low"), F.max(last).alias("high"))
    at_end = F.struct("at", "words", "class_id", "n")
    near = stored(hits.groupBy("doc_id", "island", "first_doc", "last_doc").agg(
        F.min(at_end).alias("left"), F.max(at_end).alias("right"), F.max(F.col("at") + F.col("words")).alias("end"), F.min("class_id").alias("lowest"),
    ))
    islands = stored(near.groupBy("doc_id", "island").agg(
        F.min("left.at").alias("start"), F.max("end").alias("end"), F.min("lowest").alias("class_id"), F.min("first_doc").alias("first_doc"),
    ))
    sides = F.array(F.struct(F.lit(True).alias("left"), F.col("left").alias("by")), F.struct(F.lit(False).alias("left"), F.col("right").alias("by")))
    asked = near.select("doc_id", "island", F.explode(sides).alias("e")).select("doc_id", "island", "e.left", "e.by.*")
    # a class of many paragraphs is dealt out to several tasks
    parts = F.ceil(F.col("n") / SPREAD)
    asked = asked.withColumn("part", F.pmod(F.xxhash64("doc_id", "island"), parts))
    rep = rep.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    pairs = asked.join(rep.drop("n"), ["class_id", "part"])
    others = F.array(F.struct(F.col("first_doc").alias("doc_id"), F.col("low").alias("place")), F.struct(F.col("last_doc").alias("doc_id"), F.col("high").alias("place")))
    pairs = pairs.select("doc_id", "island", "left", "at", "words", F.explode(others).alias("other")).where("other.doc_id <> doc_id")
    pairs = pairs.join(islands.select("doc_id", "island", "start", "end"), ["doc_id", "island"])
    # paragraphs that are similar only may differ at one edge: aligned at the first word and at the last
    there, there_words = F.shiftright(F.col("other.place"), 32).cast("int"), F.col("other.place").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")
    shift = there - F.col("at")
    shifts = F.array_distinct(F.array(shift, shift + there_words - F.col("words")))
    pos = F.when(F.col("left"), F.col("start")).otherwise(F.col("end")).alias("pos")
    ends = pairs.select("doc_id", "island", F.col("other.doc_id").alias("other"), pos, "left", F.explode(shifts).alias("shift"))
    ends = stored(ends.withColumn("other_pos", F.col("pos") + F.col("shift")).drop("shift"))
    here, there = ends.select("doc_id", "pos", "left"), ends.select(F.col("other").alias("doc_id"), F.col("other_pos").alias("pos"), "left")
    around = stored(_words_around(docs, here.unionByName(there).distinct()))
    there = around.withColumnsRenamed({"doc_id": "other", "pos": "other_pos", "words": "there"})
    both = ends.join(around, ["doc_id", "pos", "left"]).join(there, ["other", "other_pos", "left"])
    by = _agree(F.col("words"), F.col("there"))
    grown = both.groupBy("doc_id", "island").agg(F.max(F.when(F.col("left"), by)).alias("left"), F.max(F.when(~F.col("left"), by)).alias("right"))
    zero = F.lit(0)
    return islands.join(grown, ["doc_id", "island"], "left").withColumn("left", F.coalesce("left", zero)).withColumn("right", F.coalesce("right", zero))


def repeated_passages(docs: DataFrame) -> DataFrame:
    """(doc_id, passage, start, end, n_words, class_id, first_doc, removed array of structs start, end); places count the words of the text.

    class_id is the smallest class of the passage's paragraphs, first_doc the smallest document with any of them.
    """
    in_doc = Window.partitionBy("doc_id").orderBy("at", "words", "class_id", "gone")
    before = in_doc.rowsBetween(Window.unboundedPreceding, -1)
    hits = repeated_paragraphs(docs).withColumn("reached", F.max(F.col("at") + F.col("words")).over(before))
    # what is to be removed grows apart from what stays, so that it covers its edges
    apart = F.when((F.col("at") <= F.col("reached")) & (F.col("gone") == F.lag("gone").over(in_doc)), 0).otherwise(1)
    hits = stored(hits.withColumn("island", F.sum(apart).over(in_doc.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("reached"))
    islands = grown_islands(docs, hits)

    # what is to be removed of an island: its paragraphs that are gone, with the words grown next to them
    spans = hits.where("gone").select("doc_id", "island", F.col("at").alias("a"), (F.col("at") + F.col("words")).alias("b")).distinct()
    cuts = spans.groupBy("doc_id", "island").agg(F.collect_list(F.struct("a", "b")).alias("cuts"))
    rows = islands.join(cuts, ["doc_id", "island"], "left")
    grown = F.transform("cuts", lambda s: F.struct(
        F.when(s["a"] == F.col("start"), s["a"] - F.col("left")).otherwise(s["a"]).alias("start"), F.when(s["b"] == F.col("end"), s["b"] + F.col("right")).otherwise(s["b"]).alias("end")
    ))
    none = F.array().cast("array<struct<start:int,end:int>>")
    rows = rows.select("doc_id", "class_id", "first_doc", (F.col("start") - F.col("left")).alias("start"), (F.col("end") + F.col("right")).alias("end"), F.coalesce(grown, none).alias("cuts"))

    by_start = Window.partitionBy("doc_id").orderBy("start", "end")
    reached = F.max("end").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("reached", reached)
    apart = F.when(F.col("start") <= F.col("reached") + GAP, 0).otherwise(1)
    rows = rows.withColumn("run", F.sum(apart).over(by_start.rowsBetween(Window.unboundedPreceding, 0)))
    runs = rows.groupBy("doc_id", "run").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.min("class_id").alias("class_id"), F.min("first_doc").alias("first_doc"),
        F.array_sort(F.flatten(F.collect_list("cuts"))).alias("removed"),
    )
    found = runs.where(F.col("end") - F.col("start") >= RUN_WORDS)
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("start"))
    return found.select("doc_id", number.alias("passage"), "start", "end", (F.col("end") - F.col("start")).alias("n_words"), "class_id", "first_doc", "removed")


_WORD = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")


def cleaned(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """(doc_id, text) of every row with the words that are to be removed, and what lies between them, cut out of its text."""
    cuts = passages.select("doc_id", F.explode("removed").alias("r")).groupBy("doc_id").agg(F.array_sort(F.collect_list("r")).alias("cuts"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, cuts in zip(batch["text"].to_pylist(), batch["cuts"].to_pylist()):
                if text and cuts:
                    at = [m.span() for m in _WORD.finditer(text)]
                    parts, pos = [], 0
                    for c in cuts:
                        if c["start"] < min(c["end"], len(at)):
                            parts.append(text[pos : max(pos, at[c["start"]][0])])
                            pos = max(pos, at[min(c["end"], len(at)) - 1][1])
                    text = "".join(parts) + text[pos:]
                out.append(text)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(out, pa.string())], names=["doc_id", "text"])

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(cuts, "doc_id", "left")
    return rows.select("doc_id", "text", "cuts").mapInArrow(run, f"doc_id {kind}, text string")


def op6_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))


QUERIES = {"op6_substring": op6_substring}
ORACLE_SQL: dict[str, str] = {}
