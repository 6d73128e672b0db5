"""Language identification by multilingual mixture inference.

Character trigrams of words (with their edges, hashed to BUCKETS) give each language a smoothed distribution,
counted over all documents that may be learned from. A text is a mixture of languages: expectation-
maximisation over its words estimates the proportions from the words' trigram likelihoods. Languages join the
set by their share in the full mixture, as long as the likelihood penalised by half the logarithm of the
number of words for each language grows. The prediction is the language of the largest proportion in the set.

Null texts, texts without a letter, and all texts where nothing was learned are `und` with score 0. A text
whose letters are all outside the tables still gets the most likely language. Repeated rows count and are
scored one by one; rows without lang are not learned from.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import char_ngrams, held_out, map_batches, table

BITS = 15
BUCKETS = 1 << BITS
#: Entries of a worker's word counter, after which they become trigram counts.
WORDS_HELD = 300_000
#: Words of texts that are worked on at once.
CHUNK_WORDS = 200_000
ROUNDS = 8

_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_LETTERS).split() if text else []


def trigrams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return char_ngrams(words, 3, BITS)


def trigram_counts(docs: DataFrame) -> DataFrame:
    """(lang, bucket, n) over all rows (lang, text)."""

    def make():
        def step(batch):
            words: dict[str, Counter] = {}
            counts: dict[str, np.ndarray] = {}

            def pour(lang):
                c = words.pop(lang)
                buckets, word = trigrams(list(c))
                weight = np.fromiter(c.values(), np.float64, len(c))[word]
                counts[lang] = counts.get(lang, 0) + np.bincount(buckets, weight, BUCKETS)

            for lang, text in zip(batch["lang"], batch["text"]):
                if w := _words(text):
                    words.setdefault(lang, Counter()).update(w)
                    if len(words[lang]) > WORDS_HELD:
                        pour(lang)
            for lang in list(words):
                pour(lang)
            out: dict[str, list] = {"lang": [], "bucket": [], "n": []}
            for lang, c in counts.items():
                at = np.flatnonzero(c)
                out["lang"] += [lang] * len(at)
                out["bucket"] += at.tolist()
                out["n"] += c[at].astype(np.int64).tolist()
            return out

        return step

    rows = map_batches(docs.select("lang", "text"), "lang string, bucket int, n long", make)
    return rows.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def train(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Language names and log-probabilities (BUCKETS x languages): BUCKETS rows a language reach the driver."""
    rows = trigram_counts(docs).toPandas()
    langs = sorted(rows["lang"].unique())
    counts = np.zeros((BUCKETS, len(langs)))
    for k, lang in enumerate(langs):
        own = rows[rows["lang"] == lang]
        counts[own["bucket"].to_numpy(), k] = own["n"].to_numpy()
    smooth = counts + 0.5
    return langs, np.log(smooth / smooth.sum(0)).astype(np.float32)


def _em(p: np.ndarray, doc: np.ndarray, starts: np.ndarray, share: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Proportions and log-likelihoods of documents whose words lie one after the other; p: likelihoods."""
    n = np.diff(np.append(starts, len(p)))[:, None]
    for _ in range(rounds):
        z = p * share[doc]
        z /= z.sum(1, keepdims=True)
        share = np.add.reduceat(z, starts, axis=0) / n
    return share, np.add.reduceat(np.log((p * share[doc]).sum(1) + 1e-300), starts)


def mixtures(words: list[list[bytes]], logp: np.ndarray) -> np.ndarray:
    """Proportions (texts x languages) of the selected set of each text; every text has words."""
    known: dict[bytes, int] = {}
    ids = np.array([known.setdefault(w, len(known)) for ws in words for w in ws], np.int64)
    buckets, word = trigrams(list(known))
    first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])  # every word has a trigram
    ll = np.add.reduceat(logp[buckets].astype(np.float64), first, axis=0)
    top = ll.max(1, keepdims=True)
    p_all = np.exp(np.maximum(ll - top, -60))
    size = np.array([len(w) for w in words])
    starts = np.cumsum(size) - size
    doc = np.repeat(np.arange(len(words)), size)
    p = p_all[ids]
    full, _ = _em(p, doc, starts, np.full((len(words), p.shape[1]), 1 / p.shape[1]), ROUNDS)
    order = np.argsort(-full, axis=1, kind="stable")
    out, best = np.zeros_like(full), np.full(len(words), -np.inf)
    active = np.arange(len(words))
    for k in range(1, p.shape[1] + 1):
        share = np.zeros((len(active), p.shape[1]))
        np.put_along_axis(share, order[active, :k], 1 / k, axis=1)
        tok = np.isin(doc, active) if len(active) < len(words) else slice(None)
        n = size[active]
        share, like = _em(p[tok], np.repeat(np.arange(len(active)), n), np.cumsum(n) - n, share, 1 if k == 1 else ROUNDS)
        gain = like - 0.5 * k * np.log(n + 1)
        better = gain > best[active]
        out[active[better]], best[active[better]] = share[better], gain[better]
        active = active[better]
        if not len(active):
            break
    return out


def identify(docs: DataFrame, langs: list[str], logp: np.ndarray) -> DataFrame:
    """(doc_id, lang_pred, score, proportions array<double>) for every row."""
    model = docs.sparkSession.sparkContext.broadcast((langs, logp))

    def make():
        names, logp = model.value

        def step(batch):
            n = len(batch["text"])
            pred, score, mix = ["und"] * n, [0.0] * n, [[] for _ in range(n)]
            held: list[tuple[int, list[bytes]]] = []

            def work():
                if held:
                    for (i, _), share in zip(held, mixtures([w for _, w in held], logp)):
                        k = int(share.argmax())
                        pred[i], score[i], mix[i] = names[k], float(min(1.0, share[k])), share.tolist()
                    held.clear()

            total = 0
            for i, text in enumerate(batch["text"]):
                words = _words(text) if names else []
                if words and any(map(str.isalpha, text)):
                    held.append((i, words))
                    total += len(words)
                    if total > CHUNK_WORDS:
                        work()
                        total = 0
            work()
            return {"doc_id": batch["doc_id"], "lang_pred": pred, "score": score, "proportions": mix}

        return step

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), "doc_id long, lang_pred string, score double, proportions array<double>", make)


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    learn = docs.where(~held_out(F.col("doc_id"), 4, 2) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    found = identify(docs, *train(learn))
    return found.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "lang_pred", "score", "proportions")


QUERIES = {"op5_language": op5_language}
ORACLE_SQL: dict[str, str] = {}
