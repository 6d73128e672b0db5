import zlib

import numpy as np
from tokenizers import Tokenizer

from pseudolake.llm import packing

TEXTS = [None, "", "Hello  World\n\nfoo\tbar", "It's 42% <|endoftext|> don't x", "é Été straße ́x", "a\x1cb \x85c", "x" * 9000, "word " * 9000, "Ünïcode ǅ ﬁ"]


def test_ids_equal_the_tokenizer():
    tok = Tokenizer.from_file(packing.tokenizer_path())
    for t, got in zip(TEXTS, packing.encode(TEXTS)):
        assert np.frombuffer(got, "<u4").tolist() == [*tok.encode(t or "", add_special_tokens=False).ids, 1]


def test_places_are_gapless_and_whole(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(7, TEXTS[7]), (None, "a b")] + [(100 + i, "lorem ipsum " * (i * 7)) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as piece", "1L as length")
    got = packing.pack(df).toPandas()
    ids = packing.encode([t for _, t in rows])
    assert got["length"].sum() == sum(len(x) // 4 for x in ids)
    one = got[got["doc_id"] == 7]
    assert len(one) == 2 * -(-len(ids[7]) // 4 // 4096)
    assert set(one[one["piece"] == 0]["ids_crc32"]) == {zlib.crc32(ids[7][: 4 * 4096])}
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g["offset"].tolist() == [0, *g["length"].cumsum().tolist()[:-1]] and g["length"].sum() <= 4096
    least = -(-int(got["length"].sum()) // 4096)
    assert got["sequence_id"].nunique() <= least + 2
    whole = packing.sequences(df.where("doc_id >= 100"), packing.pack(df.where("doc_id >= 100"))).toPandas()
    assert sum(map(len, whole["ids"])) == got[got["doc_id"] >= 100]["length"].sum()
    assert packing.pack(df.limit(0)).count() == 0


def test_close_to_the_least_number():
    rng = np.random.default_rng(2)
    for draw in (rng.lognormal(6, 1, 20000), rng.integers(1, 2049, 20000)):
        lengths = np.sort(np.clip(draw.astype(int), 1, 4096))[::-1]
        seq, off, n = packing.pack_lengths(lengths, 4096)
        assert np.bincount(seq, lengths).max() <= 4096
        print(n, lengths.sum() / 4096)
        assert n <= 1.02 * lengths.sum() / 4096 + 1
