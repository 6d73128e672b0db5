"""Best-fit packing by sums of squares.

Texts become token ids (an end id follows each); only what is longer than a sequence is cut into pieces.
Pieces are dealt by a hash into groups of about GROUP_PIECES, of which only lengths travel. In a group,
longest pieces first, each piece goes where the sum of squares of the numbers of open sequences per
residual gap becomes smallest; a new sequence is opened only for what fits into no open one, as few sequences
are wanted.

Ids come word by word. A worker knows the ids of the words it met last (two generations of CACHE_WORDS); words of
ASCII characters and Latin letters that it doesn't know fall apart into the tokenizer's own pre-tokens, which are
far fewer, and those that are new go through the tokenizer in one text, where an end-of-word id closes each.

Null and empty texts are the end id alone. Repeated rows are packed one by one. Other columns are not read.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, give_back, table

#: Pieces of a group on average: 20 bytes each, so a group has a bounded size at any scale.
GROUP_PIECES = 32_768
#: Words of a generation of a Python worker's cache.
CACHE_WORDS = 150_000
#: New pre-tokens that go through the tokenizer in one text.
JOINED = 2_000
#: Bytes of text that are worked on at once.
CHUNK_BYTES = 4_000_000

#: The characters of words that are cut here, and the tokenizer's pattern of pre-tokens for them in lower case.
PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
PRE_TOKEN = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")

_WORKER: dict = {}


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class _Encoder:
    """Ids of words, as little-endian unsigned 32-bit bytes; white space never becomes part of a token."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        ends = [i for t, i in self.tok.get_vocab().items() if t.endswith("</w>")]
        self.ends = np.zeros(self.tok.get_vocab_size() + 1, bool)
        self.ends[ends] = True
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _through_tokenizer(self, words: list[str]) -> None:
        for k in range(0, len(words), JOINED):
            part = words[k : k + JOINED]
            for w, e in zip(part, self.tok.encode_batch_fast(part, add_special_tokens=False)):
                self.new[w] = np.array(e.ids, "<u4").tobytes()

    def _pre_tokens(self, tokens: list[str]) -> None:
        """Ids of single pre-tokens, all in one text; where the ends don't tell them apart, one by one."""
        for k in range(0, len(tokens), JOINED):
            part = tokens[k : k + JOINED]
            ids = np.array(self.tok.encode(" ".join(part), add_special_tokens=False).ids, "<u4")
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) != len(part) or cuts[-1] != len(ids):
                self._through_tokenizer(part)
                continue
            data, at = ids.tobytes(), 0
            for t, end in zip(part, (4 * cuts).tolist()):
                self.new[t] = data[at:end]
                at = end

    def forget(self) -> None:
        """Workers outlive their tasks; what comes next needs the memory."""
        self.new, self.old = {}, {}
        give_back()

    def learn(self, words: list[str]) -> list[bytes]:
        """The ids of distinct words."""
        if len(self.new) > CACHE_WORDS:
            self.old, self.new = self.new, {}
        new, old = self.new, self.old
        out = [*map(new.get, words)]
        odd, cut, unknown = [], [], set()
        for k in [k for k, v in enumerate(out) if v is None]:
            w = words[k]
            if (known := old.get(w)) is not None:
                out[k] = new[w] = known
            elif PLAIN.fullmatch(w) and "<|" not in w:
                tokens = PRE_TOKEN.findall(w.lower())
                cut.append((k, tokens))
                unknown.update(tokens)
            else:
                odd.append(k)
        missing = []
        for t in unknown:
            if t not in new:
                if (known := old.get(t)) is not None:
                    new[t] = known
                else:
                    missing.append(t)
        self._pre_tokens(missing)
        self._through_tokenizer([words[k] for k in odd])
        for k in odd:
            out[k] = new[words[k]]
        for k, tokens in cut:
            out[k] = new[words[k]] = new[tokens[0]] if len(tokens) == 1 else b"".join([new[t] for t in tokens])
        return out


def encode(texts: pa.Array | list[str | None], path: str | None = None, end_id: int = 1) -> list[bytes]:
    """Little-endian unsigned 32-bit ids of each text, the end id last."""
    path = path or tokenizer_path()
    if _WORKER.get("path") != path:
        _WORKER.update(path=path, encoder=_Encoder(path))
    texts = pa.array(texts, pa.string()) if isinstance(texts, list) else texts
    split = pc.split_pattern(pc.replace_substring(texts.fill_null(""), "\n", " "), " ")
    words = split.flatten().dictionary_encode()
    ids_of = _WORKER["encoder"].learn(words.dictionary.to_pylist())
    whole = pa.array(ids_of, pa.binary()).take(words.indices)
    end = np.frombuffer(whole.buffers()[1], np.int32, len(whole) + 1, 4 * whole.offset)
    at = end[np.r_[0, np.cumsum(split.value_lengths().to_numpy(zero_copy_only=False))]].tolist()
    ids = whole.buffers()[2].to_pybytes() if len(whole) else b""
    close = np.array([end_id], "<u4").tobytes()
    return [ids[a:b] + close for a, b in zip(at, at[1:])]


def _chunks(texts: pa.Array):
    """Texts in turns of about CHUNK_BYTES; a longer one alone."""
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    turn = (np.cumsum(size) - size) // CHUNK_BYTES
    edges = np.r_[0, np.flatnonzero(turn[1:] != turn[:-1]) + 1, len(size)]
    yield from zip(edges[:-1].tolist(), np.diff(edges).tolist())


def pieces(docs: DataFrame, size: int = 4096, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32[, ids binary]) for every row of `docs`."""
    names = ("doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids)
    types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), *[pa.binary()] * with_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, n in _chunks(batch["text"]) if len(batch) else ():
                rows = []
                for doc_id, data in zip(batch["doc_id"].slice(begin, n).to_pylist(), encode(batch["text"].slice(begin, n), path)):
                    for p, at in enumerate(range(0, len(data), 4 * size)):
                        part = data[at : at + 4 * size]
                        rows.append((doc_id, p, at // 4, len(part) // 4, zlib.crc32(part), part)[: len(names)])
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names=list(names))
        if _WORKER:
            _WORKER["encoder"].forget()

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def pack_lengths(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Sequence and offset of each length (sorted downwards, each 1 to `size`); the number of sequences."""
    seq, off = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    open_n = np.zeros(size + 1, np.int64)  # by gap; what has gap 0 is closed
    holders: list[list[int]] = [[] for _ in range(size + 1)]
    n = 0
    for k, s in enumerate(lengths.tolist()):
        gain = 2 * (open_n[: size + 1 - s] - open_n[s:]) + 2  # by the gap that stays
        gain[0] = 1 - 2 * open_n[s]
        gain[open_n[s:] == 0] = 1 << 40
        rest = int(gain.argmin())
        if gain[rest] >= 1 << 40:
            b, gap = n, size
            n += 1
        else:
            gap = rest + s
            b = holders[gap].pop()
            open_n[gap] -= 1
        seq[k], off[k] = b, size - gap
        if gap > s:
            open_n[gap - s] += 1
            holders[gap - s].append(b)
    return seq, off, n


def _pack_group(pdf: pd.DataFrame, size: int) -> pd.DataFrame:
    pdf = pdf.sort_values(["length", "row"], ascending=[False, True], ignore_index=True)
    seq, off, _ = pack_lengths(pdf["length"].to_numpy(), size)
    pdf["sequence_id"] = (pdf["bin"].to_numpy(np.int64) << 32) + seq
    pdf["offset"] = off
    return pdf.drop(columns=["bin", "row"])


def pack(docs: DataFrame, size: int = 4096, path: str | None = None) -> DataFrame:
    """Where each piece goes: (doc_id, piece, start, length, ids_crc32, sequence_id, offset)."""
    found = cut(pieces(docs, size, path))
    groups = max(1, -(-found.count() // GROUP_PIECES))
    # by the number of the row in the checkpoint, so that repeated rows are dealt like any other
    dealt = found.withColumn("row", F.monotonically_increasing_id()).withColumn("bin", F.pmod(F.xxhash64("row"), F.lit(groups)))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return dealt.groupBy("bin").applyInPandas(lambda pdf: _pack_group(pdf, size), schema)


def sequences(docs: DataFrame, placed: DataFrame, size: int = 4096, path: str | None = None) -> DataFrame:
    """The packed sequences (sequence_id, ids array<int>); repeated (doc_id, piece) rows with equal ids count once each."""
    ids = pieces(docs, size, path, with_ids=True).select("doc_id", "piece", "ids_crc32", "ids").dropDuplicates(["doc_id", "piece", "ids_crc32"])
    rows = placed.join(ids, ["doc_id", "piece", "ids_crc32"])

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("offset")
        return pd.DataFrame({"sequence_id": pdf["sequence_id"].iloc[:1], "ids": [np.frombuffer(b"".join(pdf["ids"]), "<u4").astype(np.int32)]})

    return rows.groupBy("sequence_id").applyInPandas(join, "sequence_id long, ids array<int>")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


QUERIES = {"op8_packing": op8_packing}
ORACLE_SQL: dict[str, str] = {}
