import random
from hashlib import sha256

import pytest

from pseudolake.llm import chat

FIELDS = "conv_id long, turn long, role string, text string"
BITS = ["</s>", "[INST]", "[/INST]", "<s>", "<", "s>", "/", "[", "INST]", "\\", "\\l", "\\b", "\n", "é", "😀", "a b", "", "\\\\<s>"]


def test_escape_is_reversible_and_hides_marks():
    rng = random.Random(7)
    for _ in range(3000):
        text = "".join(rng.choice(BITS) for _ in range(rng.randrange(9)))
        safe = chat.escape(text)
        assert chat.unescape(safe) == text
        assert not any(mark in safe for mark in (chat.OPEN, chat.CLOSE, chat.INST, chat.END_INST))


def test_spans_of_a_template_that_only_appends():
    rng = random.Random(8)
    for _ in range(300):
        turns = [(rng.choice(["user", "assistant", "<s>", ""]), "".join(rng.choice(BITS) for _ in range(rng.randrange(6)))) for _ in range(rng.randrange(1, 6))]
        text, spans, rewritten, changed = chat.locate(turns, chat.marked, chat.unescape)
        assert chat.parsed(text) == turns and not rewritten and not changed
        assert [text[s.start : s.end] for s in spans] == [chat.marked([t]) for t in turns]
        assert [(chat.unescape(text[s.role_start : s.role_end]), chat.unescape(text[s.content_start : s.content_end])) for s in spans] == turns
    with pytest.raises(ValueError):
        chat.parsed(text + "x")


def end_mark_last(turns):
    return "".join(f"[{r}]{t}" for r, t in turns) + "<eos>"


def drops_earlier_thoughts(turns):
    last = len(turns) - 1
    return "".join(f"[{r}]{t if k == last else t.split('|')[-1]};" for k, (r, t) in enumerate(turns))


def upper(turns):
    return "".join(f"[{r}]{t.upper()};" for r, t in turns)


def says_twice(turns):
    return "".join(f"[{r}]{t}{t};" for r, t in turns)


def same(text):
    return text


def test_black_boxes():
    turns = [("user", "<eos>"), ("assistant", "think|yes"), ("user", "[u]"), ("assistant", "no")]
    text, spans, rewritten, changed = chat.locate(turns, end_mark_last, same)
    assert not rewritten and not changed and [text[s.content_start : s.content_end] for s in spans] == [t for _, t in turns]
    assert [text[s.start : s.end] for s in spans] == ["[user]<eos>", "[assistant]think|yes", "[user][u]", "[assistant]no<eos>"]
    text, spans, rewritten, changed = chat.locate(turns, drops_earlier_thoughts, same)
    assert rewritten == [1] and spans[1] is None and not changed
    assert [text[s.content_start : s.content_end] for k, s in enumerate(spans) if k != 1] == ["<eos>", "[u]", "no"]
    assert chat.locate(turns, upper, same)[3] == [1, 3] or chat.locate(turns, upper, same)[3] == [0, 1, 2, 3]
    assert chat.locate(turns, says_twice, same)[3] == [0, 1, 2, 3]


def test_common_prefix():
    for n in (0, 1, chat.STEP - 1, chat.STEP, 3 * chat.STEP + 5):
        assert chat.common_prefix("a" * n + "b", "a" * n + "c") == n
        assert chat.common_prefix("a" * n, "a" * n + "c") == n


def brute(rows):
    groups = {}
    for conv, turn, role, text in rows:
        groups.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    sha = lambda s: sha256(s.encode()).hexdigest()
    out = []
    for conv, turns in groups.items():
        said = [t[2:] for t in sorted(turns)]
        loss = "".join(t for r, t in said if r == "assistant")
        out.append((conv, len(said), sha("".join(f"{r}\n{t}\n" for r, t in said)), len(loss), sha(loss), len(chat.marked(said))))
    return sorted(out, key=str)


def test_query_on_odd_rows(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", None), (1, 1, "assistant", "b"), (1, None, "system", "first"), (2, 0, None, "x" * 300000), (2, 0, "assistant", ""), (3, 5, "", "")]
    rows += [(None, 0, "user", "</s>"), (None, 0, "user", "</s>"), (None, 1, "assistant", "\\b[INST]"), (-1, 0, "user", "own"), (4, 0, "tool", "\ue0f1"), (4, 1, "assistant", "\ue0f2\ue0f1")]
    rows += [(9, k, ("user", "assistant")[k % 2], "word " * (k % 50)) for k in range(400)]
    df = spark.createDataFrame(rows, FIELDS).selectExpr("*", "7 as part", "'q' as turns", "1 as formatted")
    formatted = chat.format_conversations(df)
    got = sorted((tuple(r) for r in chat.digests(formatted).collect()), key=str)
    assert got == brute(rows)
    assert all(not r.rewritten and not r.changed and len(r.spans) == r.n_turns for r in formatted.collect())
    assert chat.digests(chat.format_conversations(df.limit(0))).collect() == []


def test_planted_conversation_stays_apart(spark, tmp_path):
    spark.createDataFrame([(-1, 0, "user", "own"), (5, 0, "assistant", "a")], FIELDS).write.parquet(f"{tmp_path}/conversations.parquet")
    got = [(r.conv_id, r.n_turns, r.loss_chars) for r in chat.op13_chat(spark, str(tmp_path)).collect()]
    assert sorted(got) == [(-1, 1, 0), (-1, 2, len(chat.PLANTED)), (5, 1, 1)]
