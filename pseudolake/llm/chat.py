"""Chat formatting by incremental rendering of a template that is known as a function only.

`format_conversations` renders the first turn, the first two, and so on, with a function from turns to text. Where an
output begins with the one before, the rest is the new turn's span. Where it doesn't, the template has rewritten what
lies beyond their common beginning: turns whose content reaches beyond it are reported, and their spans are dropped, as
they no longer hold in the final output (an end mark that only follows the last turn changes no content, and so reports
none). Inside a turn's span, two more renderings with the turn's text replaced by either of two probe characters show
where the content starts (their first difference) and what follows it (the rest), so the mask needs no knowledge of
the marks. A content is accepted only if it gives the turn's text back when unescaped; otherwise the turn is reported as
changed and not masked in.

A conversation is formatted in one task, as its output is one value; the cost is its characters times its turns, which
is that of rendering every prefix. Only one prefix is held at a time.

Turns are ordered by turn (null first), then role and text; null texts and roles are empty; repeated turns stay. Rows
with a null conv_id are one conversation. An empty table has no rows. Extra columns take no part.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from hashlib import sha256
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, table

Render = Callable[[list[tuple[str, str]]], str]

#: Characters that no template treats in a special way (fixed values from a private-use area).
PROBES = ("\ue0f1", "\ue0f2")
#: Characters that are compared at first where one output doesn't begin with another; a power of two.
STEP = 1 << 14


class Span(NamedTuple):
    """A turn's place in the output, that of its content, and of its role."""

    start: int
    end: int
    content_start: int
    content_end: int
    role_start: int
    role_end: int


def common_prefix(a: str, b: str) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    at, step = 0, STEP
    while step:  # they differ within n characters
        if a[at : at + step] == b[at : at + step]:
            at += step
        else:
            step //= 2
    return at


def probed(render: Render, before: list[tuple[str, str]], turn: tuple[str, str], which: int, output: str) -> tuple[int, int] | None:
    """Where the role (which 0) or the text (1) of the last turn stands in the output; None if the template ignores or repeats it."""
    swapped = [render([*before, (p, turn[1]) if which == 0 else (turn[0], p)]) for p in PROBES]
    start = common_prefix(*swapped)
    if start >= len(swapped[0]) or swapped[0][start + 1 :] != swapped[1][start + 1 :]:
        return None
    end = len(output) - (len(swapped[0]) - start - 1)
    same = start <= end and output[:start] == swapped[0][:start] and output[end:] == swapped[0][start + 1 :]
    return (start, end) if same else None


def locate(turns: list[tuple[str, str]], render: Render, unescape: Callable[[str], str]) -> tuple[str, list[Span | None], list[int], list[int]]:
    """The output for all turns; each turn's span in it, None if it doesn't hold there; the turns that a later one
    rewrote; the turns whose text or role isn't in the output as it was."""
    output, spans, rewritten, changed = "", [], set(), []
    for k, turn in enumerate(turns):
        now = render(turns[: k + 1])
        kept = common_prefix(output, now)
        if kept < len(output):
            for i, s in enumerate(spans):
                if s is not None and s.end > kept:
                    gone = max(s.content_end, s.role_end) > kept
                    spans[i] = None if gone else s._replace(end=kept)
                    rewritten |= {i} if gone else set()
        content, role = (probed(render, turns[:k], turn, which, now) for which in (1, 0))
        found = content and role and unescape(now[slice(*content)]) == turn[1] and unescape(now[slice(*role)]) == turn[0]
        spans.append(Span(kept, len(now), *content, *role) if found and min(content[0], role[0]) >= kept else None)
        if not found:
            changed.append(k)
        output = now
    return output, spans, sorted(rewritten), changed


# The shipped template: marks that frame every turn, and a reversible escape of the marks inside texts.
#: Control strings (fixed values).
OPEN, CLOSE, INST, END_INST = "<s>", "</s>", "[INST]", "[/INST]"
#: What is escaped: the escape character, and the first character of each control string.
_ESCAPED = re.compile(r"\\|<(?=/?s>)|\[(?=/?INST\])")
_CODES = {"\\": "\\\\", "<": "\\l", "[": "\\b"}
_PLAIN = {v[1]: k for k, v in _CODES.items()}
_TURN = re.compile(r"<s>(?P<role>.*?)\[INST\](?P<text>.*?)\[/INST\]</s>\n", re.S)


def escape(text: str) -> str:
    if "\\" not in text and "<" not in text and "[" not in text:
        return text
    return _ESCAPED.sub(lambda m: _CODES[m[0]], text)


def unescape(text: str) -> str:
    if "\\" not in text:
        return text
    return re.sub(r"\\(.)", lambda m: _PLAIN[m[1]], text, flags=re.S)


def marked(turns: Iterable[tuple[str, str]]) -> str:
    """<s>role[INST]text[/INST]</s> and a line end for every turn."""
    return "".join(f"{OPEN}{escape(role)}{INST}{escape(text)}{END_INST}{CLOSE}\n" for role, text in turns)


def parsed(output: str) -> list[tuple[str, str]]:
    """Roles and texts that marked() was given; ValueError for what it doesn't write."""
    turns, at = [], 0
    while at < len(output):
        if (m := _TURN.match(output, at)) is None:
            raise ValueError(f"no turn at {at}")
        turns.append((unescape(m["role"]), unescape(m["text"])))
        at = m.end()
    return turns


FORMATTED = (
    "conv_id long, part int, n_turns long, formatted string, spans array<struct<turn:int,role:string,start:int,end:int,content_start:int,content_end:int>>, "
    "loss array<struct<start:int,end:int>>, rewritten array<int>, changed array<int>"
)


def format_conversations(rows: DataFrame, render: Render = marked, unescaped: Callable[[str], str] = unescape, loss_roles: tuple[str, ...] = ("assistant",), part: str | None = None) -> DataFrame:
    """One row a conversation: conv_id, part, n_turns, formatted, spans (turns by number from 0, places in code points),
    loss (content spans of the loss roles), rewritten and changed (turns without a span, see above).

    `part` names a column that keeps conversations with the same conv_id apart.
    """
    turn = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    own = F.col(part) if part else F.lit(0)
    lists = rows.select(F.col("conv_id").cast("long").alias("conv_id"), own.cast("int").alias("part"), turn.alias("t")).groupBy("conv_id", "part").agg(F.array_sort(F.collect_list("t")).alias("turns"))

    def make():
        def step(batch: dict[str, list]) -> dict[str, list]:
            out: dict[str, list] = {f: [] for f in ("conv_id", "part", "n_turns", "formatted", "spans", "loss", "rewritten", "changed")}
            for conv, own, turns in zip(batch["conv_id"], batch["part"], batch["turns"]):
                said = [(t["role"], t["text"]) for t in turns]
                text, spans, rewritten, changed = locate(said, render, unescaped)
                held = [(k, said[k][0], s) for k, s in enumerate(spans) if s is not None]
                out["conv_id"].append(conv)
                out["part"].append(own)
                out["n_turns"].append(len(said))
                out["formatted"].append(text)
                out["spans"].append([{"turn": k, "role": r, "start": s.start, "end": s.end, "content_start": s.content_start, "content_end": s.content_end} for k, r, s in held])
                out["loss"].append([{"start": s.content_start, "end": s.content_end} for _, r, s in held if r in loss_roles])
                out["rewritten"].append(rewritten)
                out["changed"].append(changed)
            return out

        return step

    return map_batches(lists, FORMATTED, make)


def digests(formatted: DataFrame) -> DataFrame:
    """What can be read back from formatted conversations alone: their turns by the marks, and the masked text by the mask."""

    def make():
        def step(batch: dict[str, list]) -> dict[str, list]:
            out: dict[str, list] = {c: [] for c in ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")}
            for conv, text, loss in zip(batch["conv_id"], batch["formatted"], batch["loss"]):
                turns = parsed(text)
                masked = [unescape(text[s["start"] : s["end"]]) for s in loss]
                out["conv_id"].append(conv)
                out["n_turns"].append(len(turns))
                out["turns_sha256"].append(_sha(f"{role}\n{said}\n" for role, said in turns))
                out["loss_chars"].append(sum(map(len, masked)))
                out["loss_sha256"].append(_sha(masked))
                out["formatted_chars"].append(len(text))
            return out

        return step

    return map_batches(formatted.select("conv_id", "formatted", "loss"), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long", make)


def _sha(parts: Iterable[str]) -> str:
    out = sha256()
    for p in parts:
        out.update(p.encode("utf-8", "surrogatepass"))
    return out.hexdigest()


#: What both turns of the added conversation say: control strings, which have to come back as text.
PLANTED = "</s>[INST] ok [/INST]"


def op13_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text", F.lit(0).alias("part"))
    planted = spark.createDataFrame([(-1, 0, "user", PLANTED, 1), (-1, 1, "assistant", PLANTED, 1)], "conv_id long, turn long, role string, text string, part int")
    return digests(format_conversations(rows.unionByName(planted), part="part"))


QUERIES = {"op13_chat": op13_chat}
_LENGTH = r"length({0}) + length(regexp_replace({0}, '[^\\]', '', 'g')) + len(regexp_extract_all({0}, '</?s>|\[/?INST\]'))"
ORACLE_SQL = {
    "op13_chat": f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, 0 AS part FROM conversations
  UNION ALL SELECT -1, k, CASE k WHEN 0 THEN 'user' ELSE 'assistant' END, '{PLANTED}', 1 FROM range(2) r(k))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum({_LENGTH.format("role")} + {_LENGTH.format("text")} + length('<s>[INST][/INST]</s>') + 1) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id, part"""
}
