"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Lower-cases A-Z and turns every other ASCII character outside [0-9a-z] into a space;
#: bytes of non-ASCII characters stay.
WORD_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased runs of letters, digits and non-ASCII characters, as UTF-8; null has none."""
    return text.encode("utf-8", "surrogatepass").translate(WORD_TABLE).split() if text else []


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of unsigned 64-bit integers whose outcome looks random."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_checkpoints(spark: SparkSession) -> None:
    """Uses the cluster's spark.checkpoint.dir; sets a folder of its own only where none is set, and on one machine only."""
    if spark.conf.get("spark.checkpoint.dir", None) is None and spark.sparkContext.getCheckpointDir() is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("a cluster needs spark.checkpoint.dir, a folder that its executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoints-"))


def checkpoint_folder(spark: SparkSession) -> str:
    shared_checkpoints(spark)
    return spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir")


def remove(spark: SparkSession, folder: str) -> None:
    """Removes a folder, wherever it lies."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage by a checkpoint in the shared folder."""
    shared_checkpoints(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, folder: str | None = None) -> DataFrame:
    """Cuts the lineage by a Parquet table in the shared checkpoint folder: smaller than a checkpoint where rows are narrow.

    With a folder it lies there, so that the caller can remove() all tables of a step at once.
    """
    spark = df.sparkSession
    path = f"{folder or checkpoint_folder(spark)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bits of a bitmap: SPARSE for each value in it, but no more than MAX_BITS (8 MB).
SPARSE, MAX_BITS = 256, 1 << 26


def bitmap(values: DataFrame, column: str) -> tuple[np.ndarray, int]:
    """Bytes whose bit `value mod size` is set for each value; they reach the driver 64 bits a row, MAX_BITS / 64 rows at most."""
    size = min(MAX_BITS, 1 << max(10, (SPARSE * values.count()).bit_length()))
    place = F.col(column).bitwiseAND(F.lit(size - 1).cast("long"))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int"))
    got = values.select(F.shiftright(place, 6).alias("word"), one.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(size // 64, np.int64)
    out[got["word"].to_numpy()] = got["bits"].to_numpy()
    return out.view(np.uint8), size


def may_be(values: np.ndarray, bits: np.ndarray, size: int) -> np.ndarray:
    """The indexes of the unsigned values that a bitmap may hold: all that it holds, and few others while it is sparse."""
    place = values & np.uint64(size - 1)
    return np.flatnonzero(bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & 1)


def maybe_in(rows: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """`rows` without most of those whose long `column` is not among that of `ids`, and null; an exact join has to follow."""
    shared = rows.sparkSession.sparkContext.broadcast(bitmap(ids.select(column).distinct(), column))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = may_be(batch[column].to_numpy(zero_copy_only=False).view(np.uint64), *shared.value)
            if len(at):
                yield batch.take(pa.array(at))

    return rows.where(F.col(column).isNotNull()).mapInArrow(run, rows.schema)


def give_back() -> None:
    """Returns a Python worker's free memory to the system: workers outlive their tasks, and what comes next needs it."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc only
        trim(0)


def held_out(id_col: Column, parts: int, part: int) -> Column:
    """Whether crc32 of the id as text leaves the remainder `part` modulo `parts`; a null id counts as ''."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % parts == part


def map_batches(
    df: DataFrame, schema: str, make: Callable[[], Callable[[dict[str, list]], dict[str, list] | None]]
) -> DataFrame:
    """mapInArrow over plain Python columns: make() runs once a task, its result once a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            if (out := step(batch.to_pydict())) is not None:
                yield pa.RecordBatch.from_arrays(
                    [x if isinstance(x, pa.Array) else pa.array(x, type=t) for x, t in zip(out.values(), types)],
                    names=list(out),
                )
        give_back()

    names_types = _arrow_fields(df.sparkSession, schema)
    types = [t for _, t in names_types]
    return df.mapInArrow(run, schema)


def _arrow_fields(spark: SparkSession, schema: str) -> list[tuple[str, pa.DataType]]:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))
    return [(f.name, f.type) for f in arrow]


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of links (u, v) as rows (node, root), root the smallest node.

    Alternates large-star and small-star rounds; a node's neighbours are never gathered in a list,
    only their minimum is (with partial aggregation), so a hub costs no more than its links.
    Nodes without links don't appear. Each round is cut by a checkpoint.
    """
    links = cut(
        edges.where("u is not null and v is not null and u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )
    last = None
    for _ in range(max_rounds):
        both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e"))
        links = cut(small.select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).where("u <> v").distinct())
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == last:
            break
        last = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )


def bits_to_long(a: np.ndarray) -> np.ndarray:
    """n x 64 booleans, lowest bit first, as signed 64-bit integers."""
    return np.packbits(a, axis=1, bitorder="little").view("<i8").ravel()


def char_ngrams(words: list[bytes], n: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed character n-grams (n of 3 or more) of words with a space at either edge, and the word of each, ascending.

    Every word has a trigram; shorter words have no longer n-gram.
    """
    s = (b" " + b" ".join(words) + b" ").decode("utf-8", "replace").lower()
    a = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    space, m = a == 32, len(a) - n + 1
    if m <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    h, inside = np.zeros(m, np.uint64), np.ones(m, bool)
    for k in range(n):
        h = (h ^ a[k : k + m]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(31)
        if 0 < k < n - 1:
            inside &= ~space[k : k + m]
    return (h[inside] >> np.uint64(64 - bits)).astype(np.int64), np.cumsum(space[:m])[inside] - 1


def adam_step(p: dict, g: dict, state: dict, rate: float) -> None:
    state["t"] = t = state.get("t", 0) + 1
    for k, grad in g.items():
        m, v = state.setdefault(k, [np.zeros_like(grad), np.zeros_like(grad)])
        m += 0.1 * (grad - m)
        v += 0.01 * (grad * grad - v)
        p[k] -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-3, rounds: int = 50, share: np.ndarray | None = None) -> np.ndarray:
    """Weights of a small logistic regression (the last one is the bias), by Newton's method. A row counts share times (once without)."""
    share = np.ones(len(x)) if share is None else share
    n = share.sum()
    x = np.column_stack([x, np.ones(len(x))]).astype(np.float64)
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (share * p * (1 - p))[:, None]).T @ x + (l2 * n + 1e-6) * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (share * (y - p)) - l2 * n * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def char_prefixes(words: list[bytes], lengths: range, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed beginnings of words (of each length; a shorter word ends in its edge and counts once), and the word of each."""
    s = (b" ".join(words) + b" ").decode("utf-8", "replace").lower()
    a = np.frombuffer(s.encode("utf-32-le", "surrogatepass") + b" \0\0\0" * lengths.stop, np.uint32).astype(np.uint64)
    ends = np.flatnonzero(a == 32)[: len(words)]
    at = np.r_[0, ends[:-1] + 1]
    h, live, found = np.full(len(words), 77, np.uint64), np.arange(len(words)), []
    for k in range(lengths.stop):
        c = a[at[live] + k]
        h[live] = (h[live] ^ c) * np.uint64(0x9E3779B97F4A7C15)
        h[live] ^= h[live] >> np.uint64(31)
        over = c == 32
        out = live if k + 1 in lengths else live[over]
        found.append((h[out] >> np.uint64(64 - bits), out))
        live = live[~over]
    return np.concatenate([b for b, _ in found]).astype(np.int64), np.concatenate([w for _, w in found])


def _learnable(labels: DataFrame, label: str, parts: int, part: int) -> DataFrame:
    """(doc_id, label) of the ids outside the held-out part with one label."""
    own = labels.where(F.col(label).isin(0, 1) & ~held_out(F.col("doc_id"), parts, part)).groupBy("doc_id")
    return own.agg(F.min(label).alias("label"), F.max(label).alias("other")).where("label = other").select("doc_id", "label")


def sample_shares(labels: DataFrame, label: str, parts: int, part: int, most: tuple[int, int]) -> np.ndarray:
    """For each label, how many ids that may be learned from an id of labelled_sample() stands for: 1 where its bound doesn't bind."""
    n = {r["label"]: r["n"] for r in _learnable(labels, label, parts, part).groupBy("label").agg(F.count("*").alias("n")).collect()}
    return np.array([max(1.0, n.get(k, 0) / most[k]) for k in (0, 1)])


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, parts: int, part: int, most: tuple[int, int]) -> DataFrame:
    """(doc_id, label, and the other columns of `docs`) of a bounded sample of the documents that may be learned from.

    At most most[k] ids of label k, the first by a hash of the id; ids with two different labels are left out.
    Of several rows with an id the least is taken, so that there are sum(most) rows at most. The ids are broadcast.
    """
    one = _learnable(labels, label, parts, part)
    sides = [one.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most[k]) for k in (0, 1)]
    rest = [c for c in docs.columns if c != "doc_id"]
    found = docs.join(F.broadcast(sides[0].unionByName(sides[1])), "doc_id").groupBy("doc_id", "label").agg(F.min(F.struct(*rest)).alias("row"))
    return found.select("doc_id", "label", "row.*")
