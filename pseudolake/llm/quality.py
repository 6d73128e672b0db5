"""Quality by random-indexing word vectors and a small network with calibrated probabilities.

A token (a run between white space) stands for a word (its letters and digits in lower case) and a shape
(classes of its characters, runs of a class once; a token equal to the one before has a shape of its own).
Words and shapes are hashed to fixed numbers of rows. Each row has a sparse random index vector; its word
vector is the sum, over the whole corpus, of the index vectors of the words and shapes up to REACH tokens away.
A text is the mean and the mean square of its words' and its shapes' vectors. A network of two layers (numpy)
learns from at most SAMPLE texts of each label; a temperature fitted on a part that it did not learn from
calibrates its probabilities. Before that the bias is moved from the sample's shares of the labels to those of
all labels, where SAMPLE binds.

Null and empty texts are the zero vector and scored like any other. Without labels of both kinds every score
is 0.5. Repeated rows are scored one by one; a doc_id with both labels isn't learned from.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD_TABLE, adam_step, cut, held_out, labelled_sample, map_batches, sample_shares, table

WORDS, SHAPES, DIM, NONZERO, REACH = 8192, 1024, 32, 2, 2
ROWS = WORDS + SHAPES
REPEATED = ROWS - 1
#: The bound of the sample of labelled texts of each label.
SAMPLE = 6000
HIDDEN, STEPS, BATCH, RATE = 32, 1500, 256, 0.01
CHUNK_TOKENS, TOKENS_HELD = 200_000, 500_000
THRESHOLD = 0.3

_SHAPE = bytes(65 if 65 <= b <= 90 else 97 if 97 <= b <= 122 or b >= 128 else 48 if 48 <= b <= 57 else b for b in range(256))
_RUNS = re.compile(rb"(.)\1+", re.DOTALL)


class _Ids(dict):
    """Token to word * SHAPES + shape."""

    def __missing__(self, token: bytes) -> int:
        word = zlib.crc32(token.translate(WORD_TABLE).replace(b" ", b"")) % WORDS
        shape = zlib.crc32(_RUNS.sub(rb"\1", token.translate(_SHAPE))) % (SHAPES - 1)
        self[token] = out = word * SHAPES + shape
        return out


def index_vectors(seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the NONZERO entries of each row's index vector."""
    rng = np.random.default_rng(seed)
    return rng.integers(0, DIM, (ROWS, NONZERO)), rng.choice([-1, 1], (ROWS, NONZERO))


def token_ids(texts: list[str | None], known: _Ids) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word rows and shape rows of all tokens, and the number of tokens of each text."""
    if len(known) > TOKENS_HELD:
        known.clear()
    parts = [np.fromiter(map(known.__getitem__, w), np.int64, len(w)) for t in texts for w in [(t or "").encode("utf-8", "surrogatepass").split()]]
    n = np.array([len(p) for p in parts], np.int64)
    both = np.concatenate(parts) if parts else np.empty(0, np.int64)
    word, shape = both // SHAPES, WORDS + both % SHAPES
    again = np.r_[False, both[1:] == both[:-1]][: len(both)]
    again[(np.cumsum(n) - n)[n > 0]] = False
    shape[again] = REPEATED
    return word, shape, n


def _chunks(texts: list[str | None]):
    """Texts in turns of about CHUNK_TOKENS tokens at most (as if a token had four characters)."""
    begin = size = 0
    for k, t in enumerate(texts):
        size += len(t or "") // 4
        if size > CHUNK_TOKENS:
            yield begin, k + 1
            begin, size = k + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def word_vectors(docs: DataFrame) -> np.ndarray:
    """ROWS x DIM, each row of length one; counted over all texts. ROWS rows reach the driver."""
    columns = [f"v{k}" for k in range(DIM)]

    def make():
        known, (place, sign) = _Ids(), index_vectors()

        def step(batch):
            total = np.zeros(ROWS * DIM)
            for a, b in _chunks(batch["text"]):
                word, shape, n = token_ids(batch["text"][a:b], known)
                doc = np.repeat(np.arange(len(n)), n)
                for off in range(1, REACH + 1):
                    near = doc[off:] == doc[:-off]
                    for left, right in ((x, y) for x in (word, shape) for y in (word, shape)):
                        one, two = left[:-off][near], right[off:][near]
                        for centre, other in ((one, two), (two, one)):
                            for k in range(NONZERO):
                                total += np.bincount(centre * DIM + place[other, k], sign[other, k], ROWS * DIM)
            v = total.reshape(ROWS, DIM)
            at = np.flatnonzero(v.any(1))
            return {"row": at} | {c: v[at, k].astype(np.int64) for k, c in enumerate(columns)}

        return step

    got = map_batches(docs.select("text"), "row int, " + ", ".join(f"{c} long" for c in columns), make)
    rows = got.groupBy("row").agg(*[F.sum(c).alias(c) for c in columns]).toPandas()
    out = np.zeros((ROWS, DIM))
    out[rows["row"].to_numpy(int)] = rows[columns].to_numpy(float)
    return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def pooled(docs: DataFrame, vectors: np.ndarray) -> DataFrame:
    """(doc_id, v binary): the float32 features of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def make():
        known, vec = _Ids(), shared.value

        def step(batch):
            out = np.zeros((len(batch["text"]), 4 * DIM), np.float32)
            for a, b in _chunks(batch["text"]):
                word, shape, n = token_ids(batch["text"][a:b], known)
                full = np.flatnonzero(n)
                if not len(full):
                    continue
                first = (np.cumsum(n) - n)[full]
                for k, ids in enumerate((word, shape)):
                    x = vec[ids]
                    out[a + full, 2 * k * DIM : (2 * k + 1) * DIM] = np.add.reduceat(x, first, axis=0) / n[full, None]
                    out[a + full, (2 * k + 1) * DIM : (2 * k + 2) * DIM] = np.add.reduceat(x * x, first, axis=0) / n[full, None]
            return {"doc_id": batch["doc_id"], "v": [r.tobytes() for r in out]}

        return step

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), "doc_id long, v binary", make)


class Net:
    """Standardised features, a hidden layer, one output; `heat` divides the logit."""

    def fit(self, x: np.ndarray, y: np.ndarray, seed: int = 1, shares: tuple[float, float] = (1.0, 1.0)) -> Net:
        """shares: how many labelled texts one of the sample stands for, by label."""
        rng = np.random.default_rng(seed)
        self.mean, self.std, self.heat = x.mean(0), x.std(0) + 1e-6, 1.0
        order = rng.permutation(len(x))
        apart = order[: len(x) // 5] if len(x) >= 50 else order
        learn = order[len(x) // 5 :] if len(x) >= 50 else order
        self.p = {"a": rng.standard_normal((x.shape[1], HIDDEN)) / np.sqrt(x.shape[1]), "b": np.zeros(HIDDEN), "c": rng.standard_normal((HIDDEN, 1)) / np.sqrt(HIDDEN), "d": np.zeros(1)}
        state: dict = {}
        for step in range(STEPS):
            at = learn[rng.integers(0, len(learn), BATCH)]
            z = (x[at] - self.mean) / self.std
            h = np.tanh(z @ self.p["a"] + self.p["b"])
            err = (1 / (1 + np.exp(-(h @ self.p["c"] + self.p["d"])[:, 0])) - y[at])[:, None] / BATCH
            dh = err @ self.p["c"].T * (1 - h * h)
            g = {"a": z.T @ dh + 1e-3 * self.p["a"], "b": dh.sum(0), "c": h.T @ err + 1e-3 * self.p["c"], "d": err.sum(0)}
            adam_step(self.p, g, state, RATE * (1 - step / STEPS))
        self.p["d"] += np.log(shares[1] / shares[0])
        z, weight = self.logits(x[apart]), np.asarray(shares)[y[apart].astype(int)]
        loss = lambda t: np.average(np.logaddexp(0, np.where(y[apart] == 1, -z, z) / t), weights=weight)
        self.heat = min(np.geomspace(0.2, 20, 200), key=loss)
        return self

    def logits(self, x: np.ndarray) -> np.ndarray:
        h = np.tanh((x - self.mean) / self.std @ self.p["a"] + self.p["b"])
        return (h @ self.p["c"] + self.p["d"])[:, 0] / self.heat


def matrix(rows: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(rows), np.float32).reshape(len(rows), -1).astype(np.float64)


def train(features: DataFrame, labels: DataFrame) -> Net | None:
    got = labelled_sample(features, labels, "quality", 5, 0, (SAMPLE, SAMPLE)).toPandas().sort_values(["doc_id", "v"])
    y = got["label"].to_numpy()
    if len(set(y)) < 2:
        return None
    return Net().fit(matrix(got["v"].tolist()), y, shares=tuple(sample_shares(labels, "quality", 5, 0, (SAMPLE, SAMPLE))))


def score(features: DataFrame, net: Net | None) -> DataFrame:
    """(doc_id, score) for every row."""
    if net is None:
        return features.select("doc_id", F.lit(0.5).alias("score"))
    shared = features.sparkSession.sparkContext.broadcast(net)

    def make():
        def step(batch):
            return {"doc_id": batch["doc_id"], "score": 1 / (1 + np.exp(-np.clip(shared.value.logits(matrix(batch["v"])), -30, 30)))} if batch["v"] else None

        return step

    return map_batches(features.select("doc_id", "v"), "doc_id long, score double", make)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    features = cut(pooled(docs, word_vectors(docs)))
    found = score(features, train(features, table(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op4_quality": op4_quality}
ORACLE_SQL: dict[str, str] = {}
