"""Scores of texts against labels that are described in words, by a model that is loaded once a task."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .detect import each_or_none

#: score(texts, descriptions) -> a row of scores for each text
Scorer = Callable[[list[str], list[str]], np.ndarray]
#: Character n-grams are this long, and their weights hashed to so many buckets.
GRAM, BUCKETS = 3, 1 << 18


def label_scores(texts: DataFrame, labels: dict[str, str], load: Callable[[], Scorer]) -> DataFrame:
    """texts (id, text), labels by name with their descriptions -> (id, label, score, failed).

    All texts of an Arrow batch meet all labels in one call. A text on which the scorer fails has one row with
    failed = true, and neither label nor score; null texts have no row.
    """
    names, described = list(labels), list(labels.values())

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = load()
        for f in frames:
            rows = []
            for i, got in zip(f["id"], each_or_none(lambda batch: score(batch, described), f["text"].tolist())):
                rows += [(i, None, None, True)] if got is None else [(i, name, float(x), False) for name, x in zip(names, got)]
            yield pd.DataFrame(rows, columns=["id", "label", "score", "failed"])

    kind = texts.schema["id"].dataType.simpleString()
    return texts.where("text is not null").select("id", "text").mapInPandas(run, f"id {kind}, label string, score double, failed boolean")


def _grams(text: str) -> list[str]:
    text = text.lower()
    return [text[i : i + GRAM] for i in range(max(1, len(text) - GRAM + 1))]


def _bucket(gram: str) -> int:
    return zlib.crc32(gram.encode("utf-8", "surrogatepass")) % BUCKETS


def ngram_weights(texts: DataFrame) -> np.ndarray:
    """The inverse document frequency of each bucket of character n-grams over all texts; BUCKETS rows at most reach the driver.

    What no text has weighs nothing: its frequency would only tell how many texts there are, so that scores sank as texts grew in number.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            seen = Counter(b for t in f["text"] for b in {_bucket(g) for g in set(_grams(t))})
            yield pd.DataFrame({"b": list(seen), "n": list(seen.values())}, dtype="int64")

    known = texts.where("text is not null").select("text")
    seen = known.mapInPandas(run, "b long, n long").groupBy("b").agg(F.sum("n").alias("n")).toPandas()
    n, counts = known.count(), np.zeros(BUCKETS)
    counts[seen["b"].astype(int)] = seen["n"]
    return np.where(counts > 0, np.log((n + 1) / (counts + 1)), 0).astype(np.float32)


def ngram_scorer(weights: np.ndarray) -> Callable[[], Scorer]:
    """A scorer by the cosine of weighted n-grams, of the line of a text that is nearest to a description.

    Buckets give weights only: lines meet descriptions in the n-grams themselves, so that no collision counts as a likeness.
    """

    def vector(line: str) -> dict[str, float]:
        counts = {g: n * float(weights[_bucket(g)]) for g, n in Counter(_grams(line)).items()}
        norm = sum(v * v for v in counts.values()) ** 0.5
        return {g: v / norm for g, v in counts.items()} if norm else {}

    def load() -> Scorer:
        cache: dict[str, dict[str, float]] = {}

        def score(texts: list[str], descriptions: list[str]) -> np.ndarray:
            for d in descriptions:
                cache.setdefault(d, vector(d))
            wanted = set().union(*(cache[d] for d in descriptions))
            out = np.zeros((len(texts), len(descriptions)))
            for i, t in enumerate(texts):
                for line in filter(str.strip, t.split("\n")):
                    if wanted.isdisjoint(_grams(line)):  # all its scores are zero
                        continue
                    v = vector(line)
                    for j, d in enumerate(descriptions):
                        out[i, j] = max(out[i, j], sum(x * v.get(g, 0.0) for g, x in cache[d].items()))
            return out

        return score

    return load
