"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

Texts are lower-cased words in overlapping windows of WINDOW words, STRIDE apart, to the end of the text. A
word's input is a word vector (of the VOCAB most frequent training words; others share one), the mean of the
vectors of its hashed character n-grams and beginnings, and their largest and mean log-odds. Two gated
recurrent units read a window forwards and backwards, attention pools their states, one unit scores the pool.
A text's score is a logistic function of its highest window, so that a long text can't hide a window.

What is learned comes from a bounded sample of labelled texts (SAMPLE_TOXIC and SAMPLE_CLEAN at most). Its
log-odds are counted by folds, and a text is judged by the other folds' counts while the network learns. The
network learns from windows: of a toxic text the two with the highest log-odds, of a clean one the highest and
two others. Scoring reads whole texts, without any limit. In the logistic function a sampled text counts as the
labelled texts that it stands for, so that scores are probabilities at the labels' own shares, whatever the bounds.

Texts without words score 0. With no label of both kinds to learn from every score is 0. Repeated rows are
scored one by one; a doc_id with both labels isn't learned from.
"""

from __future__ import annotations

import random
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import adam_step, char_ngrams, char_prefixes, cut, give_back, held_out, labelled_sample, logistic, map_batches, sample_shares, table, words_of

WINDOW, STRIDE = 32, 24
HIDDEN, WORD_DIM, CHAR_DIM, VOCAB, CHAR_BITS, ODDS_BITS = 12, 12, 12, 4096, 12, 16
SIZES, PREFIXES = (3, 4), range(4, 9)
#: The bounds of the sample of labelled texts that is learned from.
SAMPLE_TOXIC, SAMPLE_CLEAN = 4000, 6000
FOLDS, STEPS, BATCH, RATE, DECAY = 4, 400, 128, 0.01, 1e-3
#: Toxic texts that an n-gram is taken to have been seen in besides, at the usual rate.
PRIOR = 3
#: Words of texts that are scored at once; windows of a piece of a longer text, and of a step of the network.
CHUNK_WORDS, PIECE_WINDOWS, STEP_WINDOWS = 20_000, 512, 1024
THRESHOLD = 0.3


def word_grams(words: list[bytes], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words' n-grams and beginnings, sorted by word, and the word of each."""
    bucket, word = (np.concatenate(x) for x in zip(*(char_ngrams(words, n, bits) for n in SIZES), char_prefixes(words, PREFIXES, bits)))
    order = np.argsort(word, kind="stable")
    return bucket[order], word[order]


def gram_counts(rows: DataFrame) -> np.ndarray:
    """FOLDS x 2 x buckets (the last: texts): how many texts of a fold and label have an n-gram."""

    def make():
        def step(batch):
            counts: dict[tuple, Counter] = {}
            for text, label, fold in zip(batch["text"], batch["label"], batch["fold"]):
                words = list(set(words_of(text)))
                found = np.unique(word_grams(words, ODDS_BITS)[0]).tolist() if words else []
                counts.setdefault((fold, label), Counter()).update([*found, 1 << ODDS_BITS])
            return {
                "fold": [f for (f, _), c in counts.items() for _ in c],
                "label": [k for (_, k), c in counts.items() for _ in c],
                "bucket": [b for c in counts.values() for b in c],
                "n": [x for c in counts.values() for x in c.values()],
            }

        return step

    got = map_batches(rows.select("text", "label", "fold"), "fold int, label int, bucket int, n long", make)
    got = got.groupBy("fold", "label", "bucket").agg(F.sum("n").alias("n")).toPandas()
    n = np.zeros((FOLDS, 2, (1 << ODDS_BITS) + 1), np.float32)
    n[got["fold"].to_numpy(int), got["label"].to_numpy(int), got["bucket"].to_numpy(int)] = got["n"].to_numpy()
    return n


def log_odds(n: np.ndarray) -> np.ndarray:
    """From counts by label: how much likelier an n-gram makes label 1, drawn to no effect where it is rare."""
    rate = max(n[1, -1], 1) / max(n[0, -1], 1)
    return np.log((n[1, :-1] + PRIOR) / (n[0, :-1] + PRIOR / rate) / rate).astype(np.float32)


def word_odds(words: list[bytes], odds: np.ndarray) -> np.ndarray:
    """Largest and mean log-odds of each word's n-grams."""
    bucket, word = word_grams(words, ODDS_BITS)
    first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])  # every word has some
    o = odds[bucket]
    n = np.diff(np.r_[first, len(bucket)])
    return np.column_stack([np.maximum.reduceat(o, first), np.add.reduceat(o, first) / n]).astype(np.float32)


def window_starts(n: int) -> range:
    return range(0, max(1, n - WINDOW + STRIDE), STRIDE) if n else range(0)


def sample_windows(rows: DataFrame, odds: list[np.ndarray]) -> list[tuple[bytes, int, int]]:
    """(words with spaces between, label, fold) of the windows to learn from, chosen where the texts are."""
    shared = rows.sparkSession.sparkContext.broadcast(odds)

    def make():
        def step(batch):
            out: dict[str, list] = {"words": [], "label": [], "fold": []}
            for doc_id, text, label, fold in zip(batch["doc_id"], batch["text"], batch["label"], batch["fold"]):
                words = words_of(text)
                starts = list(window_starts(len(words)))
                if not starts:
                    continue
                s = word_odds(words, shared.value[fold])[:, 0]
                order = sorted(starts, key=lambda a: -s[a : a + WINDOW].max())
                rest = order[2 if label else 1 :]
                chosen = order[: 2 if label else 1] + ([] if label else random.Random(doc_id).sample(rest, min(2, len(rest))))
                out["words"] += [b" ".join(words[a : a + WINDOW]) for a in chosen]
                out["label"] += [label] * len(chosen)
                out["fold"] += [fold] * len(chosen)
            return out

        return step

    got = map_batches(rows.select("doc_id", "text", "label", "fold"), "words binary, label int, fold int", make).toPandas()
    return sorted(zip(got["words"], got["label"].tolist(), got["fold"].tolist()))


def sig(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Net:
    """The network: parameters `p`, the vocabulary and the log-odds of n-grams."""

    def __init__(self, odds: list[np.ndarray], vocab: dict[bytes, int], seed: int = 3):
        rng = np.random.default_rng(seed)
        d, h = WORD_DIM + CHAR_DIM + 2, HIDDEN
        init = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.odds, self.vocab = odds, vocab
        self.p = {"word": init(len(vocab) + 1, WORD_DIM), "char": init(1 << CHAR_BITS, CHAR_DIM), "att": init(2 * h, 1), "out": init(2 * h, 1), "bias": np.zeros(1, np.float32)}
        for side in "fb":
            self.p |= {f"W{side}": init(d, 3 * h), f"U{side}": init(h, 3 * h), f"c{side}": np.zeros(3 * h, np.float32)}

    def inputs(self, words: list[bytes], fold: int) -> tuple[np.ndarray, tuple]:
        """The inputs of distinct words, and what their gradients need; fold -1: log-odds from all counts."""
        rows = np.array([self.vocab.get(w, len(self.vocab)) for w in words], np.int64)
        bucket, word = word_grams(words, ODDS_BITS)
        bucket >>= ODDS_BITS - CHAR_BITS
        first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        n = np.diff(np.r_[first, len(bucket)]).astype(np.float32)
        chars = np.add.reduceat(self.p["char"][bucket], first, axis=0) / n[:, None]
        return np.hstack([self.p["word"][rows], chars, word_odds(words, self.odds[fold])]), (rows, bucket, word, n)

    def run(self, x: np.ndarray, ids: np.ndarray, mask: np.ndarray, side: str, keep: bool) -> tuple[np.ndarray, list]:
        """States (windows x WINDOW x HIDDEN) of one direction; x: inputs by word; ids, mask: words of windows; keep: what gradients need."""
        h_dim, u = HIDDEN, self.p[f"U{side}"]
        a = x @ self.p[f"W{side}"] + self.p[f"c{side}"]
        h = np.zeros((len(ids), h_dim), np.float32)
        states, kept = np.zeros((len(ids), ids.shape[1], h_dim), np.float32), []
        for t in range(ids.shape[1]) if side == "f" else reversed(range(ids.shape[1])):
            g, m = a[ids[:, t]], mask[:, t, None]
            zr = sig(g[:, : 2 * h_dim] + h @ u[:, : 2 * h_dim])
            z, r = zr[:, :h_dim], zr[:, h_dim:]
            new = np.tanh(g[:, 2 * h_dim :] + (r * h) @ u[:, 2 * h_dim :])
            if keep:
                kept.append((t, h, z, r, new))
            h = np.where(m, new + z * (h - new), h)
            states[:, t] = h
        return states, kept

    def forward(self, x: np.ndarray, ids: np.ndarray, mask: np.ndarray, keep: bool = False):
        f, kept_f = self.run(x, ids, mask, "f", keep)
        b, kept_b = self.run(x, ids, mask, "b", keep)
        s = np.concatenate([f, b], axis=2)
        e = np.where(mask, (s @ self.p["att"])[:, :, 0], -1e9)
        w = np.exp(e - e.max(1, keepdims=True))
        w /= w.sum(1, keepdims=True)
        pool = np.einsum("nt,nth->nh", w, s)
        return (pool @ self.p["out"])[:, 0] + self.p["bias"][0], (s, w, pool, kept_f, kept_b)

    def gradients(self, words: list[bytes], ids: np.ndarray, mask: np.ndarray, y: np.ndarray, fold: int) -> dict:
        """Of the mean cross-entropy of a batch."""
        p, hd = self.p, HIDDEN
        x, (rows, bucket, word, n) = self.inputs(words, fold)
        logit, (s, w, pool, *kept) = self.forward(x, ids, mask, keep=True)
        d = ((sig(logit) - y) / len(y)).astype(np.float32)
        g = {"out": pool.T @ d[:, None], "bias": np.array([d.sum()], np.float32)}
        d_pool = d[:, None] * p["out"].T
        d_w = np.einsum("nh,nth->nt", d_pool, s)
        d_e = w * (d_w - (w * d_w).sum(1, keepdims=True))
        g["att"] = np.einsum("nt,nth->h", d_e, s)[:, None]
        d_s = w[:, :, None] * d_pool[:, None] + d_e[:, :, None] * p["att"][:, 0]
        d_x = np.zeros_like(x)
        for side, steps, part in (("f", kept[0], d_s[:, :, :hd]), ("b", kept[1], d_s[:, :, hd:])):
            u, gu, ga = p[f"U{side}"], np.zeros_like(p[f"U{side}"]), np.zeros((len(x), 3 * hd), np.float32)
            dh = np.zeros((len(ids), hd), np.float32)
            for t, h, z, r, new in reversed(steps):
                m = mask[:, t, None]
                dh += part[:, t]
                live = np.where(m, dh, 0)
                d_new = live * (1 - z) * (1 - new * new)
                d_rh = d_new @ u[:, 2 * hd :].T
                d_zr = np.hstack([live * (h - new) * z * (1 - z), d_rh * h * r * (1 - r)])
                gu[:, : 2 * hd] += h.T @ d_zr
                gu[:, 2 * hd :] += (r * h).T @ d_new
                np.add.at(ga, ids[:, t], np.hstack([d_zr, d_new]))
                dh = np.where(m, live * z + d_rh * r + d_zr @ u[:, : 2 * hd].T, dh)
            g[f"U{side}"], g[f"W{side}"], g[f"c{side}"] = gu, x.T @ ga, ga.sum(0)
            d_x += ga @ p[f"W{side}"].T
        g["word"], g["char"] = np.zeros_like(p["word"]), np.zeros_like(p["char"])
        np.add.at(g["word"], rows, d_x[:, :WORD_DIM])
        np.add.at(g["char"], bucket, (d_x[:, WORD_DIM : WORD_DIM + CHAR_DIM] / n[:, None])[word])
        return g

    def fit(self, windows: list[tuple[bytes, int, int]], seed: int = 5) -> None:
        """STEPS batches, each of one fold and half of each label where there are both."""
        rng, state = np.random.default_rng(seed), {}
        by: dict[int, dict[int, list]] = {}
        for words, label, fold in windows:
            by.setdefault(fold, {0: [], 1: []})[label].append(words)
        folds = [f for f in sorted(by) if by[f][0] and by[f][1]]
        for step in range(STEPS if folds else 0):
            fold = folds[step % len(folds)]
            batch = [(side[i], k) for k, side in by[fold].items() for i in rng.integers(0, len(side), BATCH // 2)]
            words, ids, mask = arrange([w.split(b" ") for w, _ in batch])
            g = self.gradients(words, ids, mask, np.array([y for _, y in batch], np.float32), fold)
            for k in g:
                g[k] += DECAY * self.p[k]
            adam_step(self.p, g, state, RATE * (1 - step / STEPS))

    def scores(self, texts: list[list[bytes]], fold: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The highest window's logit and the number of windows of each text; every text has words."""
        known: dict[bytes, int] = {}
        ids, mask, first = [], [], []
        for words in texts:
            w = np.fromiter((known.setdefault(x, len(known)) for x in words), np.int64, len(words))
            starts = window_starts(len(w))
            at = np.arange(len(starts))[:, None] * STRIDE + np.arange(WINDOW)
            ids.append(w[np.minimum(at, len(w) - 1)])
            mask.append(at < len(w))
            first.append(len(starts))
        n = np.array(first)
        x, _ = self.inputs(list(known), fold)
        ids, mask = np.concatenate(ids), np.concatenate(mask)
        logit = np.concatenate([self.forward(x, ids[k : k + STEP_WINDOWS], mask[k : k + STEP_WINDOWS])[0] for k in range(0, len(ids), STEP_WINDOWS)])
        return np.maximum.reduceat(logit, np.cumsum(n) - n), n


def arrange(windows: list[list[bytes]]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct words, the windows' words as indexes, and where there is a word."""
    known: dict[bytes, int] = {}
    ids, mask = np.zeros((len(windows), WINDOW), np.int64), np.zeros((len(windows), WINDOW), bool)
    for k, words in enumerate(windows):
        ids[k, : len(words)] = [known.setdefault(w, len(known)) for w in words]
        mask[k, : len(words)] = True
    return list(known), ids, mask


def pieces(words: list[bytes]) -> Iterator[list[bytes]]:
    """A text's words in pieces of at most PIECE_WINDOWS windows; together these are the windows of the whole text."""
    step, more = PIECE_WINDOWS * STRIDE, WINDOW - STRIDE
    for a in range(0, max(1, len(words) - more), step):
        yield words[a : a + step + more]


def _highest(net: Net, texts: Iterable[str | None], size: int, fold: int = -1) -> tuple[np.ndarray, np.ndarray]:
    """The highest window's logit (0 without words) and the number of windows of `size` texts, CHUNK_WORDS words or so at a time."""
    high, n = np.full(size, -np.inf), np.zeros(size, np.int64)
    held: list[tuple[int, list[bytes]]] = []
    total = 0

    def flush():
        at = np.array([k for k, _ in held])
        logit, windows = net.scores([w for _, w in held], fold)
        np.maximum.at(high, at, logit)
        np.add.at(n, at, windows)

    for i, text in enumerate(texts):
        words = words_of(text)
        for piece in pieces(words) if words else ():
            held.append((i, piece))
            total += len(piece)
            if total > CHUNK_WORDS:
                flush()
                held, total = [], 0
    if held:
        flush()
    return np.where(n > 0, high, 0), n


def _raw_scores(rows: DataFrame, net: Net, keep: str, fold: int = -1) -> DataFrame:
    """(the column `keep`, high double, n long) for every row; n is 0 for texts without words."""
    shared = rows.sparkSession.sparkContext.broadcast(net)
    kind = rows.schema[keep].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            high, n = _highest(shared.value, (x.as_py() for x in batch["text"]), len(batch), fold)
            yield pa.RecordBatch.from_arrays([batch[keep], pa.array(high), pa.array(n)], names=[keep, "high", "n"])
        give_back()

    return rows.select(keep, "text").mapInArrow(run, f"{keep} {kind}, high double, n long")


def train(docs: DataFrame, labels: DataFrame) -> tuple[Net, np.ndarray] | None:
    """The network and the weights of the text score (highest window, bias)."""
    rows = labelled_sample(docs.select("doc_id", "text"), labels, "toxic", 4, 2, (SAMPLE_CLEAN, SAMPLE_TOXIC))
    rows = cut(rows.withColumn("fold", F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int")))
    counts = gram_counts(rows)
    if (counts[:, :, -1].sum(0) == 0).any():
        return None
    # a text is never judged by counts of its own fold while the network learns; the last odds are from all
    odds = [log_odds(counts.sum(0) - counts[f]) for f in range(FOLDS)] + [log_odds(counts.sum(0))]
    windows = sample_windows(rows, odds)
    seen = Counter(w for words, _, _ in windows for w in set(words.split(b" ")))
    net = Net(odds, {w: k for k, (w, _) in enumerate(sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:VOCAB])})
    net.fit(windows)
    parts = [_raw_scores(rows.where(F.col("fold") == f), net, "label", f).where("n > 0").toPandas() for f in range(FOLDS)]
    high, y = (np.concatenate([p[c] for p in parts]) for c in ("high", "label"))
    shares = sample_shares(labels, "toxic", 4, 2, (SAMPLE_CLEAN, SAMPLE_TOXIC))
    return net, logistic(high[:, None], y, share=shares[y])


def _probability(w: np.ndarray) -> Column:
    z = F.col("high") * float(w[0]) + float(w[1])
    return F.when(F.col("n") > 0, 1 / (1 + F.exp(-z))).otherwise(0.0)


def score(docs: DataFrame, model: tuple[Net, np.ndarray] | None) -> DataFrame:
    """(doc_id, score) for every row."""
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    if model is None:
        return rows.select("doc_id", F.lit(0.0).alias("score"))
    return _raw_scores(rows, model[0], "doc_id").select("doc_id", _probability(model[1]).alias("score"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs` whose text scores under THRESHOLD, with all their columns."""
    if (model := train(docs, labels)) is None:
        return docs
    shared, w, at = docs.sparkSession.sparkContext.broadcast(model[0]), model[1], docs.columns.index("text")

    # rows stay in Arrow, and their texts are decoded one by one
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            high, n = _highest(shared.value, (x.as_py() for x in batch.column(at)), len(batch))
            toxic = (n > 0) & (sig(high * w[0] + w[1]) >= THRESHOLD)
            yield batch.filter(pa.array(~toxic))
        give_back()

    return docs.mapInArrow(run, docs.schema)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op2_toxicity": op2_toxicity}
ORACLE_SQL: dict[str, str] = {}
