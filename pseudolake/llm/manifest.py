"""Merkle manifest of a table: bitmap ranks give each leaf its place, keyed slot arrays reduce levels.

A group (a language) has a compressed bitmap of its doc_ids: 64-bit words keyed by `doc_id >> 6`, of which only those
with a bit exist, with the number of rows of each. A popcount directory over it has levels of 65,536 children: rows
before a child within its parent, added from the top down. A leaf's place is the rows before its word plus the bits
before its own, so no sort of the documents is needed. Where an id repeats within a group (told by a word's number of
rows against its bits), rows are first counted by leaf, and ordered within the word by bit and leaf, by way of a
directory of leaf prefixes, so that no window holds more than 65,536 rows of a directory or one prefix of an id.

Nodes at places p with the same p >> 10 share a slot array, keyed by group and p >> 10; an array is reduced by ten
levels at once (the group's last levels, if fewer remain), so that n leaves take log1024(n) shuffles of a
1,024th each. Roots of groups make a tree of their own. Proofs go down again: an array's nodes get their own siblings
followed by those of the array's root. Leaves and arrays are written to the shared folder, so that texts are read once.

A null doc_id precedes all others of its group; rows with equal doc_id are ordered by leaf, and equal rows have
places of their own beside each other. A null doc_id isn't tampered with. Null values hash as `-`; an empty table has no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpoint_folder, remove, stored, table

#: Levels that a slot array is reduced by, bits of a directory's level, and the fields of a leaf.
LEVELS, FAN, FIELDS = 10, 16, ("doc_id", "source", "lang", "n_chars", "text")
#: The word of null ids: before all others.
NULL_WORD = -(1 << 57) - 1
PATH = "array<struct<digest:string,left:boolean>>"


def field(value: Column) -> Column:
    """`-`, or the number of bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(values: dict[str, Column]) -> Column:
    return F.sha2(F.concat(*(field(values[c]) for c in FIELDS)).cast("binary"), 256)


def leaves(docs: DataFrame, every: int = 7) -> DataFrame:
    """(grp, word, bit, doc_id, digest, tampered): tampered is null where nothing was tampered with."""
    values = {c: F.col(c) for c in FIELDS}
    more = values | {"n_chars": F.col("n_chars").cast("decimal(20,0)") + 1}
    picked = F.crc32(F.col("doc_id").cast("string").cast("binary")) % every == 0
    doc_id = F.col("doc_id").cast("long")
    return docs.select(
        F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("")).alias("grp"),
        F.coalesce(F.shiftright(doc_id, 6), F.lit(NULL_WORD)).alias("word"),
        F.coalesce(doc_id.bitwiseAND(F.lit(63)), F.lit(0)).cast("int").alias("bit"),
        doc_id.alias("doc_id"), leaf_of(values).alias("digest"), F.when(picked & F.col("n_chars").isNotNull(), leaf_of(more)).alias("tampered"),
    )


def before(rows: Column, part: list[str], order: list[str]) -> Column:
    """Rows before this one within a part."""
    return F.coalesce(F.sum(rows).over(Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")


def directory(rows: DataFrame, folder: str) -> DataFrame:
    """(grp, word, bits, n_word, base, n): a group's words, their bits and rows, the rows of the group before them and all rows."""
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit"))
    words = stored(rows.select("grp", "word", one.alias("one")).groupBy("grp", "word").agg(F.bit_or("one").alias("bits"), F.count("*").alias("n_word")), folder)
    level = words.select("grp", F.col("word").alias("key"), F.col("n_word").alias("rows"))
    levels = [level]
    for _ in range(64 // FAN - 1):
        level = level.groupBy("grp", F.shiftright("key", FAN).alias("key")).agg(F.sum("rows").alias("rows"))
        levels.append(level)
    top = levels.pop()  # 2 ** (58 - 48) keys a group at most
    got = top.withColumns({"base": before(F.col("rows"), ["grp"], ["key"]), "n": F.sum("rows").over(Window.partitionBy("grp"))})
    for level in reversed(levels):
        up = got.select("grp", F.col("key").alias("up"), F.col("base").alias("base_up"), "n")
        here = level.withColumn("up", F.shiftright("key", FAN)).withColumn("inside", before(F.col("rows"), ["grp", "up"], ["key"]))
        got = here.join(up, ["grp", "up"]).select("grp", "key", "rows", (F.col("base_up") + F.col("inside")).alias("base"), "n")
    return stored(words.join(got.select("grp", F.col("key").alias("word"), "base", "n"), ["grp", "word"]), folder)


def placed(rows: DataFrame, words: DataFrame, folder: str) -> DataFrame:
    """The rows of leaves() with `pos`, their place in the group, and `n`, the group's rows."""
    own = ["grp", "doc_id", "digest", "tampered"]
    ones = F.bit_count("bits")
    below = F.bit_count(F.col("bits").bitwiseAND(F.bitwise_not(F.call_function("shiftleft", F.lit(-1).cast("long"), F.col("bit")))))
    plain = rows.join(words.where(F.col("n_word") == ones), ["grp", "word"]).select(*own, (F.col("base") + below).alias("pos"), "n")
    crowded = words.where(F.col("n_word") > ones).select("grp", "word", "base", "n")
    if crowded.isEmpty():
        return plain
    counted = rows.groupBy("grp", "word", "bit", "doc_id", "digest", "tampered").agg(F.count("*").alias("copies"))
    entries = stored(counted.join(crowded, ["grp", "word"]).withColumn("prefix", F.substring("digest", 1, 3)), folder)
    slot = ["grp", "word", "bit", "prefix"]
    prefixes = entries.groupBy(*slot).agg(F.sum("copies").alias("rows")).withColumn("lower", before(F.col("rows"), ["grp", "word"], ["bit", "prefix"]))
    inside = entries.withColumn("inside", before(F.col("copies"), slot, ["digest"])).join(prefixes.drop("rows"), slot)
    first = F.col("base") + F.col("lower") + F.col("inside")
    return plain.unionByName(inside.select(*own, F.explode(F.sequence(first, first + F.col("copies") - 1)).alias("pos"), "n"))


def arrays(nodes: DataFrame, done: int) -> DataFrame:
    """(grp, at, n, slots): the slot arrays of nodes (grp, pos, n, digest, ...) of which `done` levels are below, written."""
    rest = [c for c in nodes.columns if c not in ("grp", "pos", "n")]
    keyed = nodes.groupBy("grp", F.shiftright("pos", LEVELS).alias("at"), "n").agg(F.array_sort(F.collect_list(F.struct("pos", *rest))).alias("slots"))
    return stored(keyed.withColumn("done", F.lit(done)))


def levels_left(n: int, done: int) -> int:
    """Levels that an array of a group of n leaves is reduced by, where `done` levels are below it."""
    return max(0, min(LEVELS, (n - 1).bit_length() - done))


def reduced(digests: list[str], levels: int) -> list[list[str]]:
    """All levels of an array, its own first; two consecutive nodes, or a last one alone, make one."""
    out = [digests]
    for _ in range(levels):
        out.append([sha256("".join(out[-1][i : i + 2]).encode()).hexdigest() for i in range(0, len(out[-1]), 2)])
    return out


def siblings(tree: list[list[str]], i: int) -> list[tuple[str | None, bool]]:
    """For each level of slot i: the other node of its run (None if alone), and whether that one is on the left."""
    return [(level[j] if (j := (i >> k) ^ 1) < len(level) else None, bool(i >> k & 1)) for k, level in enumerate(tree[:-1])]


def _each(df: DataFrame, schema: str, step: Callable[[dict], list[tuple]]) -> DataFrame:
    """step(row as a dict) gives the output rows of one slot array; one array at a time."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                cols = list(zip(*step(batch.slice(i, 1).to_pylist()[0]))) or [[] for _ in arrow]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, arrow)], schema=arrow)

    return df.mapInArrow(run, schema)


def roots(level: DataFrame) -> DataFrame:
    """(grp, pos, n, digest) of the nodes that slot arrays are reduced to."""

    def step(row: dict) -> list[tuple]:
        tree = reduced([s["digest"] for s in row["slots"]], levels_left(row["n"], row["done"]))
        return [(row["grp"], row["at"], row["n"], tree[-1][0])]

    return _each(level.select("grp", "at", "n", "done", F.transform("slots", lambda s: F.struct(s["digest"].alias("digest"))).alias("slots")), "grp string, pos long, n long, digest string", step)


def grown(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The slot arrays of trees, level by level of arrays, and the last nodes (grp, pos 0, n, digest), one a group."""
    levels = [arrays(nodes, 0)]
    most = levels[0].agg(F.max("n")).first()[0] or 1
    while True:
        ends = roots(levels[-1])
        if levels_left(most, LEVELS * len(levels)) == 0:
            return levels, stored(ends)
        levels.append(arrays(ends, LEVELS * len(levels)))


def descended(level: DataFrame, paths: DataFrame) -> DataFrame:
    """(grp, pos, path, subroot) of the nodes in slot arrays, from the path of each array's root."""

    def step(row: dict) -> list[tuple]:
        tree = reduced([s["digest"] for s in row["slots"]], levels_left(row["n"], row["done"]))
        above = [(p["digest"], p["left"]) for p in row["path"]]
        return [(row["grp"], s["pos"], [{"digest": d, "left": left} for d, left in siblings(tree, i) + above], row["subroot"]) for i, s in enumerate(row["slots"])]

    return _each(level.join(paths.withColumnRenamed("pos", "at"), ["grp", "at"]), f"grp string, pos long, path {PATH}, subroot string", step)


def numbered(groups: DataFrame) -> DataFrame:
    """(grp, rank) in bytewise order, by ranges and the rows of the ranges before; one row a partition reaches the driver."""
    parts = stored(groups.select("grp").repartitionByRange("grp").withColumn("part", F.spark_partition_id()))
    sizes, lower, start = {r["part"]: r["n"] for r in parts.groupBy("part").agg(F.count("*").alias("n")).collect()}, {}, 0
    for part in sorted(sizes):
        lower[part], start = start, start + sizes[part]
    starts = parts.sparkSession.createDataFrame(list(lower.items()), "part int, lower long")
    place = F.row_number().over(Window.partitionBy("part").orderBy("grp")) - 1
    return parts.join(starts, "part").select("grp", (F.col("lower") + place).alias("rank"))


def fold(digest: str, path: list[tuple[str | None, bool]]) -> str:
    """The root that a leaf and its siblings lead to."""
    for other, left in path:
        digest = sha256((digest if other is None else other + digest if left else digest + other).encode()).hexdigest()
    return digest


def manifest(docs: DataFrame, every: int = 7) -> DataFrame:
    """Per row of docs: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, n_siblings."""
    schema = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, n_siblings int"
    spark = docs.sparkSession
    folder = f"{checkpoint_folder(spark)}/manifest-{uuid.uuid4().hex}"  # what is needed for the places of leaves only
    rows = stored(leaves(docs, every), folder)
    if rows.isEmpty():
        remove(spark, folder)
        return spark.createDataFrame([], schema)
    trees, subroots = grown(placed(rows, directory(rows, folder), folder))
    ranks = stored(numbered(subroots))
    remove(spark, folder)
    n = F.lit(ranks.count()).cast("long")
    top, last = grown(subroots.join(ranks, "grp").select(F.lit("").alias("grp"), F.col("rank").alias("pos"), n.alias("n"), "digest"))
    root = last.first()["digest"]
    paths = last.select("grp", "pos", F.array().cast(PATH).alias("path"), F.lit(None).cast("string").alias("subroot"))
    for level in reversed(top):
        paths = descended(level, paths)
    of_group = paths.select(F.col("pos").alias("rank"), "path").join(ranks, "rank").join(subroots.select("grp", F.col("digest").alias("subroot")), "grp")
    paths = stored(of_group.select("grp", F.lit(0).cast("long").alias("pos"), "path", "subroot"))
    for level in reversed(trees[1:]):
        paths = descended(level, paths)

    def step(row: dict) -> list[tuple]:
        digests = [s["digest"] for s in row["slots"]]
        tree = reduced(digests, levels_left(row["n"], 0))
        above = [(p["digest"], p["left"]) for p in row["path"]]
        below = [siblings(tree, i) for i in range(len(digests))]
        out = []
        for s, mine in zip(row["slots"], below):
            path = mine + above
            others = [d for d, _ in path if d is not None]
            folded = fold(s["tampered"] or s["digest"], path)
            out.append((s["doc_id"], s["digest"], row["subroot"], root, sha256("".join(others).encode()).hexdigest(), folded, folded == root, len(others)))
        return out

    return _each(trees[0].join(paths.withColumnRenamed("pos", "at"), ["grp", "at"]), schema, step)


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(table(spark, sf_dir, "documents")).drop("n_siblings")


QUERIES = {"op12_manifest": op12_manifest}
_FIELDS = " || ".join(f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in FIELDS)
ORACLE_SQL = {
    "op12_manifest": f"""
WITH RECURSIVE leaf AS MATERIALIZED (SELECT doc_id, lang, sha256({_FIELDS}) AS h, sha256({_FIELDS.replace("CAST(n_chars AS VARCHAR)", "CAST(n_chars::HUGEINT + 1 AS VARCHAR)")}) AS changed,
  list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1), lambda i: ascii(CAST(doc_id AS VARCHAR)[i])::BIGINT)),
    lambda c, x: list_reduce(list_prepend(xor(c, x), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384::BIGINT) ELSE a >> 1 END)) AS crc FROM documents),
placed AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, h) - 1 AS p FROM leaf),
tree AS (SELECT lang, 0 AS level, list(h ORDER BY p) AS nodes FROM placed GROUP BY lang
  UNION ALL SELECT lang, level + 1, list_transform(range(0, len(nodes), 2), lambda i: sha256(nodes[i + 1] || coalesce(nodes[i + 2], ''))) FROM tree WHERE len(nodes) > 1),
sub AS MATERIALIZED (SELECT lang, nodes[1] AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS q FROM tree WHERE len(nodes) = 1),
crown AS (SELECT 0 AS level, list(subroot ORDER BY q) AS nodes FROM sub
  UNION ALL SELECT level + 1, list_transform(range(0, len(nodes), 2), lambda i: sha256(nodes[i + 1] || coalesce(nodes[i + 2], ''))) FROM crown WHERE len(nodes) > 1),
step AS (SELECT d.p, d.lang, t.level, (d.p >> t.level) % 2 AS odd, t.nodes[xor(d.p >> t.level, 1) + 1] AS other FROM placed d JOIN tree t ON d.lang IS NOT DISTINCT FROM t.lang WHERE len(t.nodes) > 1
  UNION ALL SELECT d.p, d.lang, 1000 + t.level, (s.q >> t.level) % 2, t.nodes[xor(s.q >> t.level, 1) + 1] FROM placed d JOIN sub s ON d.lang IS NOT DISTINCT FROM s.lang, crown t WHERE len(t.nodes) > 1),
path AS (SELECT p, lang, list(CASE WHEN other IS NULL THEN '-' WHEN odd = 1 THEN '<' || other ELSE '>' || other END ORDER BY level) AS steps FROM step GROUP BY p, lang),
done AS (SELECT d.doc_id, d.h AS leaf, s.subroot, (SELECT nodes[1] FROM crown WHERE len(nodes) = 1) AS root, coalesce(steps, []) AS steps,
  CASE WHEN crc IS NOT NULL AND xor(crc, 4294967295::BIGINT) % 7 = 0 THEN changed ELSE d.h END AS first
  FROM placed d JOIN sub s ON d.lang IS NOT DISTINCT FROM s.lang LEFT JOIN path t ON t.p = d.p AND t.lang IS NOT DISTINCT FROM d.lang),
folded AS (SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(list_filter(steps, lambda x: x <> '-'), lambda x: x[2:]), '')) AS proof_sha256,
  list_reduce(list_prepend(first, steps), lambda h, x: CASE x[1] WHEN '-' THEN sha256(h) WHEN '<' THEN sha256(x[2:] || h) ELSE sha256(h || x[2:]) END) AS folded_root FROM done)
SELECT *, folded_root = root AS verified FROM folded"""
}
