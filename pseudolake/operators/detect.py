"""Detection: pattern spans, overlap rules, chunks, model spans, and expansion to all occurrences."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import catalog as cat
from ..functions import text as tx
from ..sources.shared import kept


def span(start: Column, end: Column, value: Column, kind: Column, confidence: Column) -> Column:
    return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), value.alias("value"), kind.alias("type"), confidence.cast("double").alias("confidence"))


def no_spans() -> Column:
    return F.array().cast(tx.SPAN)


def regex_spans(text: Column, catalog: Iterable[cat.Pattern] = cat.CATALOG) -> Column:
    """All matches of a catalogue, in its order; web addresses lose the punctuation after them. Null text: no spans."""

    def of(p: cat.Pattern) -> Column:
        def one(m: Column) -> Column:
            value = F.regexp_replace(m["value"], cat.WEB_TAIL, "") if p.type == "WEB" else m["value"]
            trimmed = F.regexp_replace(value, r"(?U)^\s+|\s+$", "")
            return span(m["start"], m["start"] + F.length(value), trimmed, F.lit(p.type), F.lit(cat.CONFIDENCE))

        found = F.filter(F.transform(tx.matches(text, p.java), one), lambda s: s["value"] != "")
        return F.when(text.rlike(p.java_needs), found).otherwise(no_spans())

    return F.coalesce(F.concat(*map(of, catalog)), no_spans())


def resolve_overlaps(spans: Column) -> Column:
    """One pass by start against the last span kept: the longer wins, then the type of higher priority."""
    rank = lambda t: F.when(t == "EMAIL", 0).when(t == "WEB", 1).otherwise(9)
    keyed = F.array_sort(F.transform(spans, lambda s, k: F.struct(s["start"].alias("start"), (s["start"] - s["end"]).alias("shorter"), rank(s["type"]).alias("rank"), k.alias("k"), s.alias("s"))))
    item = "struct<start:int,shorter:int,rank:int,k:int,s:struct<start:int,end:int,value:string,type:string,confidence:double>>"
    zero = F.struct(F.lit(None).cast(item).alias("last"), no_spans().alias("out"))

    def add(a: Column, x: Column) -> Column:
        last = a["last"]
        apart = last.isNull() | (x["start"] >= last["s"]["end"])
        wins = (x["shorter"] < last["shorter"]) | ((x["shorter"] == last["shorter"]) & (x["rank"] < last["rank"]))
        done = F.when(apart & last.isNotNull(), F.concat(a["out"], F.array(last["s"]))).otherwise(a["out"])
        return F.struct(F.when(apart | wins, x.cast(item)).otherwise(last).alias("last"), done.alias("out"))

    return F.aggregate(keyed, zero, add, lambda a: F.when(a["last"].isNull(), a["out"]).otherwise(F.concat(a["out"], F.array(a["last"]["s"]))))


def merge_spans(exact: Column, model: Column) -> Column:
    """Model spans added one by one: alone they join; touching one span the longer text stays; touching more they go."""

    def add(kept: Column, m: Column) -> Column:
        near = F.filter(kept, lambda s: (m["start"] <= s["end"]) & (m["end"] >= s["start"]))
        longer = (F.size(near) == 1) & (F.length(m["value"]) > F.length(F.get(near, F.lit(0))["value"]))
        rest = F.filter(kept, lambda s: ~((m["start"] <= s["end"]) & (m["end"] >= s["start"])))
        return F.when(F.size(near) == 0, F.concat(kept, F.array(m))).when(longer, F.concat(rest, F.array(m))).otherwise(kept)

    merged = F.aggregate(F.coalesce(model, no_spans()), F.coalesce(exact, no_spans()), add)
    order = F.array_sort(F.transform(merged, lambda s, k: F.struct(s["start"].alias("at"), k.alias("k"), s.alias("s"))))
    return F.transform(order, lambda x: x["s"])


def validate_offsets(text: Column, value: Column, start: Column, end: Column) -> Column:
    """struct(start, end) of the value: as given if right, else its first place, else null."""
    right = (start >= 0) & (start < end) & (end <= F.length(text)) & (F.substring(text, start + 1, end - start) == value)
    at = F.instr(text, value) - 1
    given = F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"))
    found = F.struct(at.cast("int").alias("start"), (at + F.length(value)).cast("int").alias("end"))
    return F.when(F.length(value) > 0, F.when(right, given).when(at >= 0, found))


def locate_normalized(text: Column, value: Column) -> Column:
    """struct(start, end, value) of the first place, exact or else normalised; the value is the text's own."""
    exact, loose = F.instr(text, value) - 1, F.instr(tx.normalize_for_search(text), tx.normalize_for_search(value)) - 1
    at = F.when(exact >= 0, exact).when((loose >= 0) & (loose + F.length(value) <= F.length(text)), loose)
    place = F.struct(at.cast("int").alias("start"), (at + F.length(value)).cast("int").alias("end"), F.substring(text, at + 1, F.length(value)).alias("value"))
    return F.when((F.length(value) > 0) & at.isNotNull(), place)


def dedup_spans(spans: DataFrame, keys: list[str], by: tuple[str, ...] = ("start", "end", "value", "type")) -> DataFrame:
    """The first of equal spans (of `by` within `keys`), by confidence downwards, then the other columns."""
    rest = [c for c in spans.columns if c not in {*keys, *by}]
    order = [F.desc("confidence")] if "confidence" in rest else []
    w = Window.partitionBy(*keys, *by).orderBy(*order, *[c for c in rest if c != "confidence"] or [by[0]])
    return spans.withColumn("rank_", F.row_number().over(w)).where("rank_ = 1").drop("rank_")


def chunk_bounds(text: Column, size: int = 1500, overlap: int = 200) -> Column:
    """array of struct(start, end): chunks of at most `size`, cut after the last line end of their last fifth, `overlap` shared."""
    overlap, head = min(overlap, size // 2), size * 4 // 5
    zero = F.struct(F.lit(0).alias("start"), F.lit(False).alias("done"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))

    def of(total: Column) -> Column:
        steps = F.sequence(F.lit(0), F.ceil(total / max(1, head - overlap)).cast("int") + 1)

        def end_of(start: Column, tail: Column) -> Column:
            last = F.instr(F.reverse(tail), "\n")
            end = F.least(start + size, total)
            return F.when((end < total) & (last > 0), start + head + F.length(tail) - last + 1).otherwise(end).cast("int")

        def cut(a: Column, end: Column) -> Column:
            piece = F.struct(a["start"].alias("start"), end.alias("end"))
            return F.struct((end - overlap).alias("start"), (end >= total).alias("done"), F.concat(a["out"], F.array(piece)).alias("out"))

        def add(a: Column, _: Column) -> Column:  # of each chunk, the last fifth is read once
            tail = F.substring(text, a["start"] + head + 1, F.lit(size - head))
            return F.when(a["done"], a).otherwise(tx.once(tail, lambda t: tx.once(end_of(a["start"], t), lambda end: cut(a, end))))

        return F.when(total <= size, F.array(F.struct(F.lit(0).alias("start"), total.alias("end")))).otherwise(F.aggregate(steps, zero, add, lambda a: a["out"]))

    return tx.once(F.length(text), of)


Predictor = Callable[[list[str]], list[list[tuple[int, int, str, float]]]]


#: What these tell of is the machine (memory, modules, files), not a text.
MACHINE = (MemoryError, ImportError, OSError)


def each_or_none(predict: Callable[[list[str]], list], texts: list[str]) -> list:
    """What a model says of each text: one call for all; where that fails, one for each, and None for those that fail.

    A call that doesn't answer once a text has failed too: its answers can't be told apart. A failure that tells of the
    machine is raised, so that Spark runs the task again or the job ends. A model is asked again after a failure, which
    has to leave it as it was.
    """
    try:
        said = list(predict(texts))
        if len(said) == len(texts):
            return said
    except Exception as error:  # noqa: BLE001  told by the caller's column
        if len(texts) < 2 and isinstance(error, MACHINE):
            raise
    return [None] * len(texts) if len(texts) < 2 else [each_or_none(predict, [t])[0] for t in texts]


def gazetteer(words: dict[str, str], confidence: float = 0.9) -> Callable[[], Predictor]:
    """A predictor from a fixed list of values and types; it stands where a trained model would."""
    import re

    def load() -> Predictor:
        pattern = re.compile(r"(?<!\w)(?:" + "|".join(map(re.escape, sorted(words, key=len, reverse=True))) + r")(?!\w)") if words else None
        some = re.compile("|".join(map(re.escape, words)))  # without a look behind, texts with no value go fast
        return lambda texts: [[(m.start(), m.end(), words[m[0]], confidence) for m in pattern.finditer(t)] if pattern and some.search(t) else [] for t in texts]

    return load


def model_spans(docs: DataFrame, load: Callable[[], Predictor], threshold: float = 0.3, size: int = 1500, overlap: int = 200) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, start, end, value, type, confidence, failed): a predictor over chunks, places in the whole text.

    load() runs once a task, and its predictor sees all chunks of an Arrow batch in one call; if that fails, one by one. A
    chunk on which the predictor fails, or that has a span whose score is no number, gives a row with failed = true and
    no span, so that a failure is never taken for a text without personal data.
    """
    pieces = docs.where(F.length("text") > 0).select("doc_id", "text", F.explode(chunk_bounds(F.col("text"), size, overlap)).alias("c"))
    pieces = pieces.select("doc_id", F.col("c.start").alias("base"), F.substring("text", F.col("c.start") + 1, F.col("c.end") - F.col("c.start")).alias("piece"))
    names = ["doc_id", "start", "end", "value", "type", "confidence", "failed"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        predict = load()
        for f in frames:
            rows = []
            for doc_id, base, piece, found in zip(f["doc_id"], f["base"], f["piece"], each_or_none(predict, f["piece"].tolist())):
                if found is None or any(p != p for *_, p in found):
                    rows.append((doc_id, None, None, None, None, None, True))
                    continue
                rows += [(doc_id, base + a, base + b, piece[a:b], kind, float(p), False) for a, b, kind, p in found if p >= threshold]
            yield pd.DataFrame(rows, columns=names).astype({"start": "Int32", "end": "Int32"})

    got = pieces.mapInPandas(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, start int, end int, value string, type string, confidence double, failed boolean")
    return dedup_spans(got, ["doc_id", "failed"])


def cut_at_newline(spans: DataFrame) -> DataFrame:
    """Second-pass spans end at their first line end; blank ones go; the first of each place stays. Rows without a value, which tell of failures, stay."""
    line = F.locate("\n", F.col("value"))
    value = F.when(line > 0, F.substring("value", F.lit(1), line - 1)).otherwise(F.col("value"))
    short = spans.withColumn("value", value).withColumn("end", (F.col("start") + F.length("value")).cast("int"))
    return dedup_spans(short.where(F.col("value").isNull() | (F.trim("value") != "")), ["doc_id"], ("start", "end"))


def quoted_core(value: Column) -> Column:
    """What the last pair of quotation marks encloses, of two characters at least, else null."""
    core = F.coalesce(*[F.when(c != "", c) for c in (F.trim(F.regexp_extract(value, r"^.*«([^«]*)»[^»]*$", 1)), F.trim(F.regexp_extract(value, r'^.*"([^"]*)"[^"]*$', 1)))])
    return F.when(F.length(core) >= 2, core)


def quoted_cores(spans: DataFrame, texts: DataFrame) -> DataFrame:
    """`spans` (doc_id, start, end, value, type, confidence) and the short names inside the quotation marks of ORG values."""
    cores = spans.where("type = 'ORG'").select("doc_id", quoted_core(F.col("value")).alias("value"), "type", "confidence").where("value is not null")
    cores = cores.groupBy("doc_id", "value", "type").agg(F.max("confidence").alias("confidence")).join(spans.select("doc_id", "value"), ["doc_id", "value"], "left_anti")
    placed = cores.join(texts.select("doc_id", "text"), "doc_id").withColumn("start", (F.instr("text", F.col("value")) - 1).cast("int")).where("start >= 0")
    return spans.unionByName(placed.select("doc_id", "start", (F.col("start") + F.length("value")).cast("int").alias("end"), "value", "type", "confidence"))


NUMBER_RUN = r"\d+(?:[.,]\d+|[ \u00A0\u2009]\d{1,3}(?!\d))*"


def extend_numbers(text: Column, start: Column, end: Column, runs: Column | None = None) -> Column:
    """struct(start, end): a partial number grown to the whole one (groups of up to three digits, decimals) around it.

    runs: the matches of NUMBER_RUN, for a caller that asks for many places of a text.
    """
    runs = tx.matches(text, NUMBER_RUN) if runs is None else runs
    run = F.get(F.filter(runs, lambda r: (r["start"] < end) & (r["end"] > start)), F.lit(0))
    return F.struct(F.coalesce(F.least(run["start"], start), start).cast("int").alias("start"), F.coalesce(F.greatest(run["end"], end), end).cast("int").alias("end"))


def _occurrences(text: Column, hay: Column, key: Column, value: Column, numeric: Column) -> Column:
    """array of struct(start, end, own): the places of a value in a text that may count; linear in the text, however many there are."""
    acronym = tx.is_acronym(value)
    starts, ends = tx.is_word_char(F.substring(value, 1, 1)), tx.is_word_char(F.right(value, F.lit(1)))

    def found(hay_parts: Column, own_parts: Column, runs: Column) -> Column:
        def one(at: Column) -> Column:
            here = F.struct(at.cast("int").alias("start"), (at + F.length(value)).cast("int").alias("end"))
            return tx.once(F.when(numeric, extend_numbers(text, at, at + F.length(value), runs)).otherwise(here), own)

        def own(p: Column) -> Column:
            return F.struct(p["start"].alias("start"), p["end"].alias("end"), F.when(numeric | acronym, tx.of_parts(own_parts, p["start"], p["end"])).alias("own"))

        def good(p: Column) -> Column:
            edge = lambda at: tx.is_word_char(tx.of_parts(hay_parts, at, at + 1))
            return ~(starts & edge(p["start"] - 1) | ends & edge(p["end"])) & ~(acronym & p["own"].rlike(r"\p{Ll}"))

        return F.filter(F.transform(tx.places(hay, key), one), good)

    own_parts, runs = F.when(numeric | acronym, tx.parts(text)), F.when(numeric, tx.matches(text, NUMBER_RUN))
    return tx.once(tx.parts(hay), lambda h: tx.once(own_parts, lambda o: tx.once(runs, lambda r: found(h, o, r))))


def expand_occurrences(spans: DataFrame, texts: DataFrame) -> DataFrame:
    """Each value found once in a text is marked wherever it stands there: (doc_id, start, end, value, type, confidence).

    Case, ё and look-alike letters don't matter (unless folding would change the length of the text or value, or the value
    is a number, which grows to the whole number); acronyms count in capitals only; a value that begins or ends with a
    word character isn't found inside a longer word; longer values go first and what they cover is taken. Values of
    under two characters keep their own span only.

    Values meet their own text by an equi join on doc_id; each value costs one search of that text. Which places are taken
    is told within islands of places that overlap, so that a text of many places costs no more than its share.
    """
    spans = spans.select("doc_id", "start", "end", "value", "type", "confidence")
    short = spans.where(F.length(F.trim("value")) < 2)
    first = Window.partitionBy("doc_id", "value").orderBy("start", "end", "type")
    unique = spans.where(F.length(F.trim("value")) >= 2).withColumn("r", F.row_number().over(first)).where("r = 1")
    text = F.col("text")
    docs = texts.select("doc_id", "text").join(unique.select("doc_id").distinct(), "doc_id", "left_semi").withColumn("folds", tx.foldable(text))
    docs = docs.withColumn("norm", F.when(F.col("folds"), tx.normalize_for_search(text)).otherwise(text))

    value = F.col("value")
    v = unique.withColumn("numeric", tx.is_numeric_value(value)).withColumn("plain", tx.foldable(value)).withColumn("low", tx.normalize_for_search(value))
    v = v.select("doc_id", "value", "type", "confidence", "numeric", "plain", "low", F.col("start").alias("seen")).join(docs, "doc_id")
    folds = F.col("folds") & F.col("plain") & ~F.col("numeric")
    v = v.withColumn("key", F.when(folds, F.col("low")).otherwise(value)).withColumn("hay", F.when(folds, F.col("norm")).otherwise(text))
    hits = v.select("doc_id", "value", "type", "confidence", "numeric", "seen", F.inline(_occurrences(text, F.col("hay"), F.col("key"), value, F.col("numeric"))))
    ranked = hits.select("doc_id", (-F.length("value")).alias("shorter"), "seen", "start", "end", F.when(F.col("numeric"), F.col("own")).otherwise(value).alias("value"), "type", "confidence").distinct()

    placed = Window.partitionBy("doc_id").orderBy("start", "end")
    both = ranked.unionByName(short.select("doc_id", F.lit(None).cast("int").alias("shorter"), F.lit(None).cast("int").alias("seen"), "start", "end", "value", "type", "confidence"))
    both = both.withColumn("before", F.max("end").over(placed.rowsBetween(Window.unboundedPreceding, -1)))
    both = both.withColumn("island", F.sum(F.when(F.col("start") < F.col("before"), 0).otherwise(1)).over(placed.rowsBetween(Window.unboundedPreceding, 0)))
    item, given = F.struct("shorter", "seen", "start", "end", "value", "type", "confidence"), F.col("shorter").isNull()
    taken = F.collect_list(F.when(given, span(F.col("start"), F.col("end"), value, F.col("type"), F.col("confidence"))))
    lists = both.groupBy("doc_id", "island").agg(F.array_sort(F.collect_list(F.when(~given, item))).alias("hits"), taken.alias("taken"))

    def add(kept: Column, h: Column) -> Column:
        clash = F.exists(kept, lambda s: (s["start"] < h["end"]) & (s["end"] > h["start"]))
        return F.when(clash, kept).otherwise(F.concat(kept, F.array(span(h["start"], h["end"], h["value"], h["type"], h["confidence"]))))

    return lists.select("doc_id", F.inline(F.aggregate("hits", F.col("taken").cast(tx.SPAN), add)))


def detect(docs: DataFrame, catalog: Iterable[cat.Pattern] = cat.CATALOG, model: DataFrame | None = None, expand: bool = True) -> DataFrame:
    """docs (doc_id, text) -> spans of patterns, of a model's spans if given, of quoted names, in all their places.

    With a model there is a column `failed`: a text on which the model failed has one row with failed = true and no span,
    and no other, so that a failure is never taken for a text without personal data. Spans to expand are a narrow table
    that is written once, as expansion uses it in many places: patterns run over a text once.
    """
    broken = None if model is None else model.where("failed").select("doc_id").distinct()
    sound = docs if broken is None else docs.join(broken, "doc_id", "left_anti")
    exact = resolve_overlaps(regex_spans(F.col("text"), catalog))
    if model is None:
        spans = sound.select("doc_id", F.inline(exact))  # no column of its own, on which a filter would be inferred that computes it again
    else:
        exact = sound.select("doc_id", "text", exact.alias("spans"))
        found = model.where("not failed").groupBy("doc_id").agg(F.array_sort(F.collect_list(span(F.col("start"), F.col("end"), F.col("value"), F.col("type"), F.col("confidence")))).alias("found"))
        exact = exact.join(found, "doc_id", "left").withColumn("spans", merge_spans(F.col("spans"), F.col("found")))
        spans = exact.select("doc_id", F.inline("spans"))
    if expand:
        spans = kept(quoted_cores(kept(spans, "found"), sound), "cores")
        spans = expand_occurrences(spans, sound)
    if broken is None:
        return spans
    return spans.withColumn("failed", F.lit(False)).unionByName(broken.withColumn("failed", F.lit(True)), allowMissingColumns=True)
