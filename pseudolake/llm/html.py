"""Main text of web pages, with a suffix array for each host.

A page becomes blocks of text between block-level tags, each with what it lies in: an article (or main element), or
a menu, header, footer, sidebar, notice, advert, form, script, style or comment (by element, role or class names; the
class names of body, article and main elements don't count, nor does what a whole article lies in, if the page has no other).

The method decides on what is left. The blocks outside articles of a host's pages are token streams. Their suffixes
are sorted by their first MIN_RUN tokens (ranks by prefix doubling) in slices of about SLICE_PAGES pages; the beginnings
that slices have are merged by a shuffle, so that the size of slices makes no difference. A beginning that MIN_PAGES
distinct pages of the host or more have is a repeated substring; longer repeats are covered by their parts.

Where a page has an article, the result is its blocks. Each run of theirs is looked up among the repeated substrings. An
exact check follows, as articles quote what adverts and footers say too: a block that they cover wholly goes only if
MIN_PAGES distinct pages have it in the same place of their articles (elements and classes around it), and if all blocks
that the host's articles have in that place are such blocks; other blocks stay, whatever covers them.

On other pages covered runs are removed, and unique runs kept: stretches of MIN_RUN tokens or more, and blocks that nothing covers. A page of which
no unique run of 2 * MIN_RUN tokens is left (two pages that differ in one word have shorter ones around it) is a copy
of others, not boilerplate, and keeps its blocks.

Null and empty pages have an empty text. A page cut off inside a tag loses that tag. A null url is a host of its own.
Repeated rows each return a row; pages of equal content count as one page.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b
from html import unescape

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bitmap, map_batches, may_be, mixed, stored, table

MIN_RUN, MIN_PAGES = 6, 3
#: Pages of a host's slice, and of the groups of slices that a task works on at once, on average.
SLICE_PAGES, GROUP_PAGES = 256, 1024

# Names of elements and words of class names.
BLOCK = set(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li main menu nav noscript ol option p pre search section select "
    "summary table tbody td template textarea tfoot th thead title tr ul".split()
)
DROPPED = set("aside button dialog footer form head iframe menu nav noscript search select svg template textarea title".split())
RAW = ("script", "style", "textarea", "title", "noscript", "template", "iframe", "svg")
VOID = set("area base br col embed hr img input link meta source track wbr".split())
BOILER = set(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disclaimer footer "
    "gdpr header hidden login masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promotion "
    "related replies reply respond share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)
#: A class name with one of these words says what is around, or isn't there.
WITHOUT = set("has no with without".split())
ROLES = set("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>" + "|".join(RAW) + r")\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)"
    r"|<[a-z/!?][^>]*(?:>|\Z)"
    r"|[^<]+|<",
    re.IGNORECASE | re.DOTALL,
)
_ATTR = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
_MAIN = re.compile(r"(?:^|\s)role\s*=\s*[\"']?main\b", re.IGNORECASE)
_HIDDEN = re.compile(r"(?:^|\s)(?:hidden(?:\s|=|/|$)|aria-hidden\s*=\s*[\"']?true|style\s*=\s*[\"'][^\"']*display\s*:\s*none)", re.IGNORECASE)


def _is_boiler(name: str, attrs: str, article: bool, in_article: bool) -> bool:
    if name in DROPPED or name == "header" and not in_article:
        return True
    if not attrs or name in ("html", "body") or article and not in_article:
        return False
    for kind, *values in _ATTR.findall(attrs):
        for value in "".join(values).lower().split():
            words = set(re.split(r"[^a-z0-9]+", value))
            if words & (ROLES if kind.lower() == "role" else BOILER) and not words & WITHOUT and not (in_article and words <= {"header", "post", "entry", "article", "title"}):
                return True
    return bool(_HIDDEN.search(attrs))


def blocks(page: str | None) -> list[tuple[str, bool, bool, bool, str]]:
    """(text, inside an article, boilerplate by its place, boilerplate around the article, place in the article) of each block with
    text, in page order.

    Boilerplate inside a line (an advert in a span, a hidden word) is left out of its block and cuts it in no other way.
    """
    out: list[tuple[str, bool, bool, bool, str]] = []
    stack: list[tuple[str, bool, bool, bool, bool, str]] = []  # open elements that matter: name, as in the result, whether text is left out, place
    parts: list[str] = []
    main = boiler = around = muted = False
    path = ""

    def close():
        if parts and (text := " ".join(unescape("".join(parts)).split())):
            out.append((text, main, boiler, around, path))
        parts.clear()

    def leave(at: int):
        nonlocal main, boiler, around, muted, path
        del stack[at:]
        _, main, boiler, around, muted, path = stack[-1] if stack else ("", False, False, False, False, "")

    def leave_paragraph():  # a block ends the paragraph that is open
        if (at := next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == "p"), -1)) >= 0:
            leave(at)

    for m in _TOKEN.finditer(page or ""):
        token, name = m[0], (m["name"] or "").lower()
        if token[0] != "<" or token == "<":
            if not muted:
                parts.append(token)
        elif not name:
            if token.startswith(("<textarea", "<title", "<noscript")):
                close()
        elif name == "br":
            parts.append(" ")
        elif name in VOID:
            if name in BLOCK:
                close()
                leave_paragraph()
        elif m["end"]:
            if name in BLOCK:
                close()
            at = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name), -1)
            if at >= 0:
                leave(at)
        else:
            if name in BLOCK:
                close()
                leave_paragraph()
            article = name in ("article", "main") or bool(_MAIN.search(m["attrs"]))
            bad = _is_boiler(name, m["attrs"], article, main)
            if not m["attrs"].endswith("/") and (name in BLOCK or bad):
                if name in ("li", "option", "td", "th", "tr") and stack and stack[-1][0] == name:
                    leave(len(stack) - 1)
                if main:
                    path = f"{path}/{name}" + "".join(f".{''.join(v).lower()}" for kind, *v in _ATTR.findall(m["attrs"]) if kind.lower() == "class")
                if article and not main:
                    main, boiler, around = True, False, boiler
                boiler = boiler or bad and name in BLOCK
                muted = muted or bad and name not in BLOCK
                stack.append((name, main, boiler, around, muted, path))
    close()
    return out


def parse(page: str | None) -> tuple[str | None, list[str], list[tuple[int, int]] | None, list[str] | None]:
    """The article's blocks (None without one, '' without a text), the tokens outside articles, where among them the open blocks of
    a page without an article lie, and the places of an article's blocks."""
    found = blocks(page)
    tokens: list[str] = []
    open_blocks: list[tuple[int, int]] = []
    free = 0
    for text, main, boiler, _, _ in found:
        if not main:
            words = text.split(" ")
            if not boiler:
                open_blocks.append((len(tokens), len(words)))
                free += len(text)
            tokens += words
    for lies_in in (False, True):
        article = [(text, path) for text, main, boiler, around, path in found if main and not boiler and around == lies_in]
        if article and (not lies_in or sum(len(text) for text, _ in article) >= free):
            return "\n\n".join(text for text, _ in article), tokens, None, [path for _, path in article]
    return (None, tokens, open_blocks, None) if open_blocks else ("", tokens, None, None)


def run_codes(tokens: list[str], host: str, known: dict[str, int]) -> np.ndarray:
    """An unsigned 64-bit code of each MIN_RUN tokens; `known` keeps those of tokens."""
    if len(known) > 1 << 18:
        known.clear()
    code = lambda s: known.get(s) or known.setdefault(s, int.from_bytes(blake2b(s.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little"))
    ids, n = np.array([code(s) for s in tokens], np.uint64), len(tokens) - MIN_RUN + 1
    h = np.full(max(n, 0), code("\n" + host), np.uint64)
    for k in range(MIN_RUN if n > 0 else 0):
        h = mixed(h ^ ids[k : k + n])
    return h


def _head(tokens: list[str], host: str) -> bytes:
    return blake2b(" ".join([host, *tokens]).encode("utf-8", "surrogatepass"), digest_size=16).digest()


def suffix_groups(streams: list[list[str]], hosts: list[str], run: int = MIN_RUN) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The suffix array of some streams, as far as `run` tokens tell: page and place of each suffix with that many tokens in its
    stream, in order, and where those with the same host and the same `run` tokens begin and end."""
    known: dict[str, int] = {}
    n = np.array([len(s) for s in streams], np.int64)
    ids = np.array([known.setdefault(t, len(known)) for s in streams for t in s], np.int64)
    page = np.repeat(np.arange(len(streams)), n)
    place = np.arange(len(ids)) - np.repeat(np.cumsum(n) - n, n)
    at = np.flatnonzero(place + run <= n[page])
    if not len(at):
        return (np.empty(0, np.int64),) * 4
    rank, size = ids, 1
    while size < run:  # ranks of the suffixes by their first `size` tokens
        step = min(size, run - size)
        tail = np.full(len(rank), -1, np.int64)
        tail[: len(rank) - step] = rank[step:]
        _, rank = np.unique((rank + 1) * (len(rank) + 2) + tail + 1, return_inverse=True)
        size += step
    host = np.unique(np.array(hosts, object).astype(str), return_inverse=True)[1]
    _, rank = np.unique(rank[at] * len(hosts) + host[page[at]], return_inverse=True)
    order = np.argsort(rank, kind="stable")
    begin = np.flatnonzero(np.r_[True, np.diff(rank[order]) > 0])
    return page[at[order]], place[at[order]], begin, np.r_[begin[1:], len(order)]


def _heads(pdf: pd.DataFrame) -> pd.DataFrame:
    """(head, code, pages, places): each beginning of suffixes, how many pages have it, where it lies in pages without an article."""
    streams, hosts = [s.split(" ") for s in pdf["stream"]], pdf["host"].tolist()
    page, place, begin, end = suffix_groups(streams, hosts)
    keys, is_open = pdf["key"].tolist(), pdf["open"].to_numpy(bool)
    out: dict[str, list] = {"head": [], "code": [], "pages": [], "places": []}
    known: dict[str, int] = {}
    for a, b in zip(begin.tolist(), end.tolist()):
        p, at = page[a:b], place[a:b]
        tokens = streams[p[0]][at[0] : at[0] + MIN_RUN]
        out["head"].append(_head(tokens, hosts[p[0]]))
        out["code"].append(int(run_codes(tokens, hosts[p[0]], known).view(np.int64)[0]))
        out["pages"].append(len(np.unique(p)))
        out["places"].append([{"key": keys[i], "at": x} for i, x in zip(p.tolist(), at.tolist()) if is_open[i]])
    return pd.DataFrame(out)


def unique_runs(tokens: list[str], open_blocks: list[tuple[int, int]], heads: list[int]) -> str:
    """The open blocks without what repeated beginnings cover; all of them, where no long unique run is left."""
    mark = np.zeros(len(tokens) + 1, np.int64)
    np.add.at(mark, heads, 1)
    np.add.at(mark, np.array(heads, np.int64) + MIN_RUN, -1)
    covered = np.cumsum(mark)[:-1] > 0
    kept, longest = [], 0
    for at, n in open_blocks:
        edge = np.flatnonzero(np.diff(np.r_[True, covered[at : at + n], True].astype(np.int8)))
        runs = [(a, b) for a, b in edge.reshape(-1, 2).tolist() if b - a >= MIN_RUN or b - a == n]
        if runs:
            longest = max(longest, *(b - a for a, b in runs))
            kept.append(" ".join(" ".join(tokens[at + a : at + b]) for a, b in runs))
    return "\n\n".join(kept if longest >= 2 * MIN_RUN else [" ".join(tokens[at : at + n]) for at, n in open_blocks])


def parsed_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, host, key binary, text, stream, blocks array<struct<at,n>>, spots array<long>) of every row: text is null without an
    article, blocks are open blocks of the stream, spots the places of the article's blocks."""

    def make():
        def step(batch):
            out = {c: batch[c] for c in ("page_id", "url", "host")} | {c: [] for c in ("key", "text", "stream", "blocks", "spots")}
            for host, page in zip(batch["host"], batch["html"]):
                text, tokens, open_blocks, paths = parse(page)
                stream = " ".join(tokens)
                spots = paths and [int.from_bytes(blake2b(x.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True) for x in paths]
                for c, x in zip(("text", "stream", "blocks", "spots"), (text, stream, open_blocks and [{"at": a, "n": n} for a, n in open_blocks], spots)):
                    out[c].append(x)
                out["key"].append(blake2b(repr((host, text, stream, open_blocks, spots)).encode("utf-8", "surrogatepass"), digest_size=16).digest())
            return out

        return step

    host = F.coalesce(F.lower(F.regexp_extract("url", r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1)), F.lit(""))
    kind = pages.schema["page_id"].dataType.simpleString()
    rows = pages.select("page_id", "url", host.alias("host"), F.col("html").cast("string").alias("html"))
    return map_batches(rows, f"page_id {kind}, url string, host string, key binary, text string, stream string, blocks array<struct<at:int,n:int>>, spots array<bigint>", make)


def repeated_heads(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(head, code): the MIN_RUN tokens that MIN_PAGES distinct pages of a host or more have outside articles; and (key, heads
    array<int>): their places in pages without an article."""
    streams = parsed.where("stream <> ''").select("host", "key", "stream", F.col("text").isNull().alias("open"))
    streams = stored(streams.dropDuplicates(["key"]))
    most = streams.groupBy("host").agg(F.count("*").alias("n")).agg(F.max("n"), F.sum("n")).first()
    slices, groups = (max(1, -(-(x or 0) // size)) for x, size in zip(most, (SLICE_PAGES, GROUP_PAGES)))
    dealt = streams.withColumn("group", F.pmod(F.xxhash64("host", F.pmod(F.xxhash64("key"), F.lit(slices))), F.lit(groups)))
    heads = stored(dealt.groupBy("group").applyInPandas(_heads, "head binary, code bigint, pages int, places array<struct<key:binary,at:int>>"))
    common = stored(heads.groupBy("head", "code").agg(F.sum("pages").alias("n")).where(F.col("n") >= MIN_PAGES).select("head", "code"))
    at = heads.where(F.size("places") > 0).join(common, "head").select(F.explode("places").alias("p"))
    return common, at.groupBy("p.key").agg(F.collect_set("p.at").alias("heads"))


def furniture(parsed: DataFrame, common: DataFrame) -> DataFrame:
    """(key, gone array<int>): the blocks of articles that go, see the module's text."""
    bits = parsed.sparkSession.sparkContext.broadcast(bitmap(common, "code"))

    def make():
        known: dict[str, int] = {}

        def step(batch):
            out = {c: [] for c in ("key", "host", "block", "spot", "body", "n", "at", "head")}
            for key, host, text, spots in zip(batch["key"], batch["host"], batch["text"], batch["spots"]):
                texts = text.split("\n\n")
                words = [x.split(" ") for x in texts]
                tokens = [w for x in words for w in x]
                block = np.repeat(np.arange(len(words)), [len(x) for x in words])
                begin = np.r_[0, np.cumsum([len(x) for x in words])]
                for i in may_be(run_codes(tokens, host, known), *bits.value).tolist():
                    k = int(block[i])
                    if i + MIN_RUN <= begin[k + 1]:
                        body = int.from_bytes(blake2b(texts[k].encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)
                        for c, x in zip(out, (key, host, k, spots[k], body, len(words[k]), i - int(begin[k]), _head(tokens[i : i + MIN_RUN], host))):
                            out[c].append(x)
            return out

        return step

    articles = parsed.where("spots is not null")
    met = map_batches(articles.select("key", "host", "text", "spots"), "key binary, host string, block int, spot bigint, body bigint, n int, at int, head binary", make)
    names = ["key", "host", "block", "spot", "body", "n"]
    blocks = met.join(common.select("head"), "head").groupBy(*names).agg(F.array_sort(F.collect_set("at")).alias("at"))
    apart = F.exists(F.zip_with(F.slice("at", 1, F.size("at") - 1), F.slice("at", 2, F.size("at")), lambda a, b: b - a > MIN_RUN), lambda x: x)
    whole = stored(blocks.where((F.array_min("at") == 0) & (F.array_max("at") == F.col("n") - MIN_RUN) & ~apart).select("key", "host", "block", "spot", "body"))
    same = whole.groupBy("host", "spot", "body").agg(F.countDistinct("key").alias("pages")).where(F.col("pages") >= MIN_PAGES).select("host", "spot", "body")
    repeated = stored(whole.join(same, ["host", "spot", "body"]))
    if repeated.isEmpty():
        return repeated.groupBy("key").agg(F.collect_set("block").alias("gone"))
    every = articles.select("host", "key", "spots").dropDuplicates(["key"]).select("host", F.explode("spots").alias("spot")).groupBy("host", "spot").agg(F.count("*").alias("all_"))
    full = repeated.groupBy("host", "spot").agg(F.count("*").alias("n")).join(every, ["host", "spot"]).where("n = all_").select("host", "spot")
    return repeated.join(full, ["host", "spot"]).groupBy("key").agg(F.collect_set("block").alias("gone"))


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) for every row of `pages`."""
    parsed = stored(parsed_pages(pages))
    common, places = repeated_heads(parsed)
    gone = stored(furniture(parsed, common))
    decided = parsed.where("text is not null").select("page_id", "url", "key", "text")
    if not gone.isEmpty():
        decided = decided.join(gone, "key", "left")
        stay = F.filter(F.split("text", "\n\n"), lambda _, k: ~F.array_contains("gone", k))
        unique = F.exists(stay, lambda x: F.size(F.split(x, " ")) >= 2 * MIN_RUN)  # else the page is a copy of others
        decided = decided.withColumn("text", F.when(F.col("gone").isNotNull() & unique, F.array_join(stay, "\n\n")).otherwise(F.col("text")))
    decided = decided.select("page_id", "url", "text")
    rows = parsed.where("text is null").select("page_id", "url", "key", "stream", "blocks").join(places, "key", "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            text = [
                unique_runs(s.split(" "), [(x["at"], x["n"]) for x in b], [] if h is None else sorted(h))
                for s, b, h in zip(pdf["stream"], pdf["blocks"], pdf["heads"])
            ]
            yield pd.DataFrame({"page_id": pdf["page_id"], "url": pdf["url"], "text": text})

    kind = pages.schema["page_id"].dataType.simpleString()
    open_rows = rows.select("page_id", "url", "stream", "blocks", "heads")
    return decided.unionByName(open_rows.mapInPandas(run, f"page_id {kind}, url string, text string"))


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


QUERIES = {"op9_html": op9_html}
ORACLE_SQL: dict[str, str] = {}
