"""Batched models, the sequence model, and the cache of results."""

import itertools

import numpy as np
import pytest

from pseudolake.operators import cache, detect, recogniser, scorer, vault
from pseudolake.plans import model_queries


def test_viterbi_equals_all_paths():
    rng = np.random.default_rng(2)
    for n in (1, 2, 4):
        for _ in range(20):
            scores, moves = rng.normal(size=(n, 7)), rng.normal(size=(8, 7))
            paths = [p for p in itertools.product(range(7), repeat=n) if not any(recogniser.FORBIDDEN[a, b] for a, b in zip((7, *p[:-1]), p))]
            best = max(paths, key=lambda p: sum(scores[i, t] for i, t in enumerate(p)) + sum(moves[a, b] for a, b in zip((7, *p[:-1]), p)))
            assert tuple(recogniser.viterbi(scores, moves)) == best


def test_tags_and_spans_are_inverse():
    text = "Вчера Иван Петров видел Омск."
    line = recogniser.tokens(text)
    spans = [(6, 17, "PERSON"), (24, 28, "LOC")]
    assert recogniser.spans_of(line, recogniser.tags_of(line, spans)) == spans


def test_names_that_were_never_seen(spark, tmp_path):
    spark.range(900).withColumnRenamed("id", "o_orderkey").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(k, "Une phrase. Rien ici. Fin.") for k in range(8)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    weights = recogniser.learned(model_queries.labelled(spark, str(tmp_path), False))
    predict = recogniser.recogniser(weights)()
    hit = said = real = 0
    for r in model_queries.labelled(spark, str(tmp_path), True).collect():
        got, want = {x[:3] for x in predict([r.text])[0]}, {(s.start, s.end, s.type) for s in r.spans}
        hit, said, real = hit + len(got & want), said + len(got), real + len(want)
    assert hit / said > 0.85 and hit / real > 0.6
    docs = spark.createDataFrame([(1, "Договор подписал Иван Ларонов\nТел. 5"), (2, None), (3, "")], "doc_id long, text string")
    found = recogniser.second_pass_spans(docs, recogniser.recogniser(weights)).collect()
    assert [(r.doc_id, r.value, r.type) for r in found if r.type == "PERSON"] == [(1, "Иван Ларонов", "PERSON")] and not any("\n" in r.value for r in found)


def test_one_call_a_batch_and_failures_alone(spark):
    calls = []

    def model(texts):
        calls.append(len(texts))
        if "bad" in texts:
            raise ValueError
        return [t.upper() for t in texts]

    assert detect.each_or_none(model, ["a", "bad", "b"]) == ["A", None, "B"] and calls == [3, 1, 1, 1]
    assert detect.each_or_none(model, ["a", "b"]) == ["A", "B"] and calls[4:] == [2] and detect.each_or_none(model, []) == []
    texts = spark.createDataFrame([(1, "red"), (2, "bad"), (3, None), (4, "blue blue")], "id long, text string")

    def load():
        def score(batch, labels):
            if "bad" in batch:
                raise ValueError
            return np.array([[float(t.count(d)) for d in labels] for t in batch])

        return score

    rows = scorer.label_scores(texts, {"r": "red", "b": "blue"}, load)
    assert {(r.id, r.label, r.score, r.failed) for r in rows.collect()} == {(1, "r", 1.0, False), (1, "b", 0.0, False), (2, None, None, True), (4, "r", 0.0, False), (4, "b", 2.0, False)}
    assert {(r.id, r.label) for r in vault.classify_by_labels(rows.where("not failed")).collect()} == {(1, "r"), (4, "b")}


def test_ngram_scores_find_the_nearest_line(spark):
    texts = spark.createDataFrame([(1, "x\nпереключи на облако"), (2, "nothing of this kind"), (3, "")], "id long, text string")
    scores = {(r.id, r.label): r.score for r in scorer.label_scores(texts, {"cloud": "переключение на облако", "file": "открыть файл"}, scorer.ngram_scorer(scorer.ngram_weights(texts))).collect()}
    assert scores[1, "cloud"] > 0.3 > scores[1, "file"] and scores[2, "cloud"] < 0.05 and scores[3, "cloud"] == 0


def test_the_cache_forgets_the_oldest_and_no_failure_is_kept(spark):
    def load():
        def predict(texts):
            if any("bad" in t for t in texts):
                raise ValueError
            return [[(0, 1, "MISC", 1.0)] if t.startswith("x") else [] for t in texts]

        return predict

    docs = spark.createDataFrame([(5, "x one"), (3, "two"), (4, "x one"), (9, "bad"), (7, None), (8, "")], "doc_id long, text string")
    out, first, misses = cache.cached_spans(docs, cache.empty_cache(spark), load)
    assert {r.doc_id: (len(r.spans), r.failed) for r in out.collect()} == {5: (1, False), 4: (1, False), 3: (0, False), 9: (0, True), 7: (0, False), 8: (0, False)}
    text_of = {r.key: r.text for r in misses.collect()}
    assert sorted(text_of.values()) == ["", "bad", "two", "x one"]
    assert {text_of[r.key]: r.seq for r in first.collect()} == {"two": 1, "x one": 2, "": 3}
    more = docs.unionByName(spark.createDataFrame([(10, "x new")], docs.schema))
    out, second, misses = cache.cached_spans(more, first, load, limit=2)
    assert sorted(r.text for r in misses.collect()) == ["bad", "x new"] and sorted(r.seq for r in second.collect()) == [3, 4]
    assert {r.doc_id: len(r.spans) for r in out.collect()} == {5: 1, 4: 1, 3: 0, 9: 0, 7: 0, 8: 0, 10: 1}


def test_ngrams_of_one_bucket_are_not_alike(monkeypatch):
    monkeypatch.setattr(scorer, "BUCKETS", 1)
    score = scorer.ngram_scorer(np.ones(1))()
    assert score(["enzute zu er\nxy", "команды"], ["команда"]).tolist()[0] == [0.0] and score(["команды"], ["команда"])[0, 0] > 0.5


def test_scores_do_not_sink_as_texts_grow_in_number(spark):
    texts = spark.createDataFrame([(1, "вернись на облако"), (2, "nothing"), (3, "of this kind")], "id long, text string")
    many = texts.crossJoin(spark.range(200).withColumnRenamed("id", "copy")).select("id", "text")
    few, lots = (scorer.ngram_scorer(scorer.ngram_weights(t))()(["вернись на облако"], ["переключение на облако"])[0, 0] for t in (texts, many))
    assert lots > 0.95 * few > 0.3


def test_each_message_of_a_long_conversation_has_its_label(spark, tmp_path):
    rows = [(c, t, "nothing here") for c in range(3) for t in (0, 1, 100, 101)]
    spark.createDataFrame(rows, "conv_id long, turn long, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = sorted(((r.id, r.label) for r in model_queries.command_labels(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted(((c * 100 + t, [*model_queries.COMMANDS, None][(c + t) % 4]) for c, t, _ in rows), key=str)


def test_lines_decoded_together_equal_lines_decoded_alone(monkeypatch):
    rng = np.random.default_rng(4)
    weights = recogniser.Weights(rng.normal(size=(recogniser.BUCKETS, 7)).astype(np.float32), rng.normal(size=(8, 7)).astype(np.float32))
    said = "Иван Петров, ООО 12 x . Omsk a B-2 İ ё".split(" ")
    texts = ["\n".join(" ".join(rng.choice(said, rng.integers(0, 9))) for _ in range(rng.integers(1, 6))) for _ in range(60)] + ["", "\n\n", "A"]
    want = []
    for text in texts:
        found, base = [], 0
        for raw in text.split("\n"):
            line = recogniser.tokens(raw)
            if any(w[0].isupper() for *_, w in line):
                tags = recogniser.viterbi(weights.features[recogniser.features([w for *_, w in line])].astype(float).sum(1), weights.moves.astype(float))
                found += [(base + a, base + b, kind, 0.8) for a, b, kind in recogniser.spans_of(line, tags)]
            base += len(raw) + 1
        want.append(found)
    for known, block in ((1 << 18, 1 << 16), (3, 10)):
        monkeypatch.setattr(recogniser, "KNOWN", known)
        monkeypatch.setattr(recogniser, "BLOCK", block)
        predict = recogniser.recogniser(weights)()
        calls = []
        monkeypatch.setattr(recogniser, "viterbi", lambda *a: calls.append(a))  # no line is decoded by itself
        assert [x for k in range(0, len(texts), 20) for x in predict(texts[k : k + 20])] == want and any(want) and not calls
        monkeypatch.undo()


def failing_on(word, kind="PERSON"):
    def load():
        def predict(texts):
            if any(word in t for t in texts):
                raise ValueError
            return [[(t.index("Иван"), t.index("Иван") + 4, kind, 0.9)] if "Иван" in t else [] for t in texts]

        return predict

    return load


def test_a_failure_of_the_second_pass_is_no_text_without_names(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(1, "Иван\nx"), (2, "boom"), (3, "no name"), (4, None), (5, "Иван " + "z" * 200 + " boom")], "doc_id long, text string")
    found = recogniser.second_pass_spans(docs, failing_on("boom"), size=100, overlap=20).collect()
    assert {(r.doc_id, r.start, r.value, r.failed) for r in found} == {(1, 0, "Иван", False), (2, None, None, True), (5, 0, "Иван", False), (5, None, None, True)} and len(found) == 4
    spark.range(40).withColumnRenamed("id", "o_orderkey").write.parquet(f"{tmp_path}/orders.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(recogniser, "recogniser", lambda weights: failing_on("boom"))
    got = model_queries.second_recogniser(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got if r.failed} == {2, 5} and all((r.value is None) == r.failed for r in got)


def test_answers_that_are_too_few_or_no_numbers_are_failures(spark):
    assert detect.each_or_none(lambda texts: [t.upper() for t in texts if t != "mute"], ["a", "mute", "b"]) == ["A", None, "B"]
    docs = spark.createDataFrame([(1, "Иван"), (2, "mute"), (3, "unsure")], "doc_id long, text string")

    def load():
        return lambda texts: [[(0, 4, "PERSON", float("nan") if t == "unsure" else 0.9)] for t in texts if t != "mute"]

    assert {(r.doc_id, r.value, r.failed) for r in recogniser.second_pass_spans(docs, load).collect()} == {(1, "Иван", False), (2, None, True), (3, None, True)}


def test_what_fails_by_the_machine_is_no_failure_of_a_text():
    def model(texts):
        if len(texts) > 1:
            raise MemoryError  # too much at once
        if texts == ["far"]:
            raise FileNotFoundError
        return texts

    assert detect.each_or_none(model, ["a", "b"]) == ["a", "b"]
    with pytest.raises(FileNotFoundError):
        detect.each_or_none(model, ["a", "far"])


def test_a_recogniser_that_failed_is_as_it_was(monkeypatch):
    rng = np.random.default_rng(5)
    weights = recogniser.Weights(rng.normal(size=(recogniser.BUCKETS, 7)).astype(np.float32), rng.normal(size=(8, 7)).astype(np.float32))
    texts = ["Иван Петров , Omsk", "Анна x B7b7 y Олег", "Договор Z подписал Олег Анна"]
    want, shape, own = recogniser.recogniser(weights)()(texts), recogniser._shape, recogniser._Scores.learn

    def failing(word):
        if word == "B7b7":
            raise ValueError
        return shape(word)

    predict = recogniser.recogniser(weights)()
    monkeypatch.setattr(recogniser, "_shape", failing)
    assert detect.each_or_none(predict, texts) == [want[0], None, want[2]] and want[0] and want[2]
    monkeypatch.setattr(recogniser, "_shape", shape)
    assert predict(texts) == want
    monkeypatch.setattr(recogniser, "KNOWN", 3)
    monkeypatch.setattr(recogniser._Scores, "learn", lambda self, words: own(self, words) if words != [""] else 1 / 0)  # fails as it forgets
    assert detect.each_or_none(predict, texts) == [None] * 3
    monkeypatch.setattr(recogniser._Scores, "learn", own)
    assert predict(texts) == want
