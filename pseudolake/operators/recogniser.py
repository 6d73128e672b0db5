"""A second recogniser of persons, places and firms: a linear-chain model, trained from labelled sentences.

Tokens have hashed features of themselves and their neighbours; an averaged structured perceptron learns a weight for
each feature and tag and for each pair of tags, and Viterbi decoding finds the best tags of a line. Lines are
decoded apart, so that no span runs over a line end. Training sees a bounded number of sentences on the driver, and its
weights (BUCKETS x tags) go to the tasks with the predictor; recognition is detect.model_spans over whole texts.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .detect import Predictor, cut_at_newline, model_spans

KINDS = ("PERSON", "LOC", "ORG")
TAGS = ("O", *(f"{place}-{kind}" for kind in KINDS for place in "BI"))
BUCKETS = 1 << 15
#: Sentences that are learned from, at most, and passes over them.
SENTENCES, EPOCHS = 4000, 6
TOKEN = re.compile(r"\w+|[^\w\s]")
#: Neighbours that features tell of.
AROUND = (-2, -1, 1, 2)
#: Words whose scores a task keeps, and words that are decoded at once, at most (a line more).
KNOWN, BLOCK = 1 << 18, 1 << 16


class Weights(NamedTuple):
    features: np.ndarray  # BUCKETS x tags
    moves: np.ndarray  # (tags + 1) x tags: from a tag, the last row from the start


#: Moves that can't be: I after neither B nor I of its kind.
FORBIDDEN = np.array([[t[0] == "I" and (f == "" or f[2:] != t[2:]) for t in TAGS] for f in (*TAGS, "")])


def tokens(line: str) -> list[tuple[int, int, str]]:
    return [(m.start(), m.end(), m[0]) for m in TOKEN.finditer(line)]


def _sign(c: str) -> str:
    return "X" if c.isupper() else "x" if c.islower() else "d" if c.isdigit() else c


def _shape(word: str) -> str:
    return re.sub(r"(.)\1+", r"\1", "".join(map(_sign, word)))


def _own(word: str) -> list[str]:
    low = word.lower()
    return [f"w={low}", f"s={_shape(word)}", f"p2={low[:2]}", f"e2={low[-2:]}", f"e3={low[-3:]}"]


def _near(d: int, word: str) -> list[str]:
    """What the word `d` places on tells, '' beyond a line's ends."""
    return [f"{d}w={word.lower()}", f"{d}s={_shape(word)}"]


def _pair(shape: str, before: str) -> str:
    return f"s-1s={shape}|{before}"


def _buckets(named: list[str]) -> list[int]:
    return [zlib.crc32(f.encode("utf-8", "surrogatepass")) % BUCKETS for f in named]


def features(words: list[str]) -> np.ndarray:
    """words x features: buckets of what a word and its neighbours look like."""
    out = []
    for i, word in enumerate(words):
        named = [*_own(word), f"first={i == 0}"]
        for d in AROUND:
            named += _near(d, words[i + d] if 0 <= i + d < len(words) else "")
        named.append(_pair(_shape(word), _shape(words[i - 1]) if i else ""))
        out.append(_buckets(named))
    return np.array(out, np.int64)


def viterbi(scores: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """The tags (numbers) with the largest sum of words' scores (words x tags) and moves."""
    allowed = np.where(FORBIDDEN, -1e9, moves)
    best, back = scores[0] + allowed[-1], []
    for row in scores[1:]:
        to = best[:, None] + allowed[:-1]
        back.append(to.argmax(0))
        best = to.max(0) + row
    path = [int(best.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return np.array(path[::-1])


def viterbi_lines(scores: np.ndarray, begin: np.ndarray, n: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """viterbi() of many lines at once, word by word of all of them: the tags of each row of `scores`; lines lie at `begin` and have `n` > 0 words."""
    allowed = np.where(FORBIDDEN, -1e9, moves.astype(float))
    order = np.argsort(-n, kind="stable")
    begin, n = begin[order], n[order]
    open_lines = [int(np.searchsorted(-n, -t, "left")) for t in range(int(n[0]))]  # lines of more than t words come first
    best, back = scores[begin] + allowed[-1], []
    for t, k in enumerate(open_lines[1:], 1):
        to = best[:k, None, :] + allowed[:-1].T  # line, to, from
        step = to.argmax(2)
        back.append(step)
        best[:k] = np.take_along_axis(to, step[:, :, None], 2)[:, :, 0] + scores[begin[:k] + t]
    out, tag = np.zeros(len(scores), np.int64), best.argmax(1)
    for t in range(len(open_lines) - 1, 0, -1):
        k = open_lines[t]
        out[begin[:k] + t] = tag[:k]
        tag[:k] = back[t - 1][np.arange(k), tag[:k]]
    out[begin] = tag
    return out


def spans_of(line: list[tuple[int, int, str]], tags: np.ndarray) -> list[tuple[int, int, str]]:
    out: list[tuple[int, int, str]] = []
    for (start, end, _), t in zip(line, tags):
        name = TAGS[t]
        if name[0] == "B":
            out.append((start, end, name[2:]))
        elif name[0] == "I" and out:
            out[-1] = (out[-1][0], end, out[-1][2])
    return out


def tags_of(line: list[tuple[int, int, str]], spans: list[tuple[int, int, str]]) -> np.ndarray:
    out = np.zeros(len(line), np.int64)
    for start, end, kind in spans:
        inside = [i for i, (a, b, _) in enumerate(line) if a >= start and b <= end]
        for k, i in enumerate(inside):
            out[i] = TAGS.index(f"{'I' if k else 'B'}-{kind}")
    return out


def train(sentences: list[tuple[str, list[tuple[int, int, str]]]], seed: int = 1) -> Weights:
    """Averaged perceptron over sentences (text, spans of start, end and kind), each one line."""
    rng = np.random.default_rng(seed)
    data = [(features([w for *_, w in line]), tags_of(line, spans)) for text, spans in sentences if (line := tokens(text))]
    w, m = np.zeros((BUCKETS, len(TAGS))), np.zeros((len(TAGS) + 1, len(TAGS)))
    w_sum, m_sum, n = np.zeros_like(w), np.zeros_like(m), 1
    for _ in range(EPOCHS):
        for k in rng.permutation(len(data)):
            x, gold = data[k]
            guess = viterbi(w[x].sum(1), m)
            for i in np.flatnonzero(guess != gold):
                for sign, tag in ((1, gold[i]), (-1, guess[i])):
                    np.add.at(w[:, tag], x[i], sign)
                    np.add.at(w_sum[:, tag], x[i], sign * n)
            before = lambda path: np.r_[len(TAGS), path[:-1]]
            for sign, path in ((1, gold), (-1, guess)):
                np.add.at(m, (before(path), path), sign)
                np.add.at(m_sum, (before(path), path), sign * n)
            n += 1
    return Weights((w - w_sum / n).astype(np.float32), (m - m_sum / n).astype(np.float32))


def learned(labelled: DataFrame, most: int = SENTENCES) -> Weights:
    """From labelled (text, spans array of struct start, end, type): the first `most` sentences by a hash of their text."""
    rows = labelled.where("text is not null").orderBy(F.xxhash64("text"), "text").limit(most).collect()
    return train([(r["text"], [(s["start"], s["end"], s["type"]) for s in r["spans"]]) for r in rows])


class _Signs(dict):
    """What a character counts for in a shape."""

    def __missing__(self, c: str) -> str:
        got = self[c] = _sign(c)
        return got


class _Scores:
    """Scores of words by their tags: those of a word's own features and of what it tells its neighbours are computed once a word."""

    def __init__(self, weights: Weights):
        self.weights, self.signs = weights.features.astype(float), _Signs()
        self.first = [self.weights[_buckets([f"first={x}"])].sum(0) for x in (False, True)]
        self.forget()

    def forget(self):
        self.ids: dict[str, int] = {}
        self.shape_of: dict[str, str] = {}
        self.shapes: dict[str, int] = {}
        self.pairs: dict[tuple[int, int], np.ndarray] = {}
        self.own, self.near, self.shape, self.capital = np.zeros((0, len(TAGS))), np.zeros((len(AROUND), 0, len(TAGS))), np.zeros(0, np.int64), np.zeros(0, bool)
        self.learn([""])

    def learn(self, words: list[str]):
        """Words get their numbers last: where this fails, none has the number of another word's scores."""
        new = [w for w in dict.fromkeys(words) if w not in self.ids]
        if not new:
            return
        shapes = [self._shape_of(w) for w in new]
        score = lambda kind, said: self.weights[[zlib.crc32(x.encode("utf-8", "surrogatepass"), zlib.crc32(kind.encode())) % BUCKETS for x in said]]
        low = [w.lower() for w in new]
        own = score("w=", low) + score("s=", shapes) + score("p2=", [x[:2] for x in low]) + score("e2=", [x[-2:] for x in low]) + score("e3=", [x[-3:] for x in low])
        near = np.concatenate([self.near, np.stack([score(f"{d}w=", low) + score(f"{d}s=", shapes) for d in AROUND])], 1)
        shape = np.r_[self.shape, [self.shapes.setdefault(x, len(self.shapes)) for x in shapes]]
        capital = np.r_[self.capital, [w[:1].isupper() for w in new]]
        before, own = len(self.own), np.concatenate([self.own, own])
        self.own, self.near, self.shape, self.capital = own, near, shape, capital
        self.ids.update(zip(new, range(before, len(own))))

    def _shape_of(self, word: str) -> str:
        signs = "".join(map(self.signs.__getitem__, word))
        if (got := self.shape_of.get(signs)) is None:
            got = self.shape_of[signs] = _shape(word)
        return got

    def of(self, lines: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores of the words of lines, each line with two empty rows before it, then where lines begin, and whether one has a capital."""
        if not 0 < len(self.ids) <= KNOWN:  # none after a failure to forget
            self.forget()
        self.learn([w for line in lines for w in line])
        n = np.array([len(line) for line in lines])
        begin = np.cumsum(n + 2) - n
        ids = np.zeros(int(begin[-1] + n[-1]) + 2, np.int64)
        ids[np.arange(n.sum()) + np.repeat(2 * np.arange(1, len(n) + 1), n)] = [self.ids[w] for line in lines for w in line]
        scores = self.own[ids] + self.first[False]
        for d, near in zip(AROUND, self.near):
            scores[2:-2] += near[ids[2 + d : len(ids) - 2 + d]]
        scores[begin] += self.first[True] - self.first[False]
        pairs, at = np.unique(self.shape[ids[1:]] * len(self.shapes) + self.shape[ids[:-1]], return_inverse=True)
        names = list(self.shapes)
        tell = [divmod(p, len(names)) for p in pairs.tolist()]
        for a, b in tell:
            if (a, b) not in self.pairs:
                self.pairs[a, b] = self.weights[_buckets([_pair(names[a], names[b])])[0]]
        scores[1:] += np.array([self.pairs[p] for p in tell])[at]
        return scores, begin, np.logical_or.reduceat(self.capital[ids], begin)


def recogniser(weights: Weights, confidence: float = 0.8) -> Callable[[], Predictor]:
    """A predictor for detect.model_spans. Lines of all texts are decoded together, in blocks."""

    def load() -> Predictor:
        known = _Scores(weights)

        def decode(block: list[tuple[int, int, str, list[str]]], out: list[list[tuple[int, int, str, float]]]):
            scores, begin, named = known.of([words for *_, words in block])  # names begin with a capital
            if not named.any():
                return
            n = np.array([len(words) for *_, words in block])
            tags = viterbi_lines(scores, begin[named], n[named], weights.moves)
            for k in np.flatnonzero(named).tolist():
                own = tags[begin[k] : begin[k] + n[k]]
                if own.any():
                    i, base, raw, _ = block[k]
                    out[i] += [(base + a, base + b, kind, confidence) for a, b, kind in spans_of(tokens(raw), own)]

        def predict(texts: list[str]) -> list[list[tuple[int, int, str, float]]]:
            out: list[list[tuple[int, int, str, float]]] = [[] for _ in texts]
            block, size = [], 0
            for i, text in enumerate(texts):
                base = 0
                for raw in text.split("\n"):
                    if words := TOKEN.findall(raw):
                        block.append((i, base, raw, words))
                        size += len(words)
                    base += len(raw) + 1
                    if size >= BLOCK:
                        decode(block, out)
                        block, size = [], 0
            if block:
                decode(block, out)
            return out

        return predict

    return load


def second_pass_spans(docs: DataFrame, load: Callable[[], Predictor], **how) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, start, end, value, type, confidence, failed): a second model's spans, cut at line ends, each place once.

    A text of which the model failed on a chunk has one row with failed = true and no span, besides the spans of its other chunks.
    """
    return cut_at_newline(model_spans(docs, load, **how))
