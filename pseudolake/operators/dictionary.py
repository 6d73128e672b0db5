"""Search of texts for the values of a dictionary table of any size.

Texts and values are cut into words, and up to three consecutive words (all words of a shorter value) make a shingle.
Which shingles of the dictionary stand in which text is an equi join on a 64-bit hash, and its counts say which shingle
of a value is in the fewest texts: that one is the value's anchor, so that values that begin alike (numbers of one
country, firms of one legal form) don't meet all texts that begin so. Only a text that holds a value's anchor is
searched for it; an equal hash makes a search too many, never a place too many. All values of a text are searched in
one row, so that a text is shuffled once, whatever the number of its values.

A value without a word is anchored by its rarest symbol. Empty values and values of white space are never found.
The table of shingles that were met is written to the shared folder, as it is used for the counts and for the join.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import catalog as cat
from ..functions import text as tx
from ..sources.shared import kept
from .detect import no_spans, span

#: Words of a shingle, at most.
LONGEST = 3

# Characters that a comparison without case takes for others, and those others.
ALSO, SAME = "ſKᲀᲁᲂᲃᲄᲅᲆ", "skвдосттъ"

class Cut(NamedTuple):
    """How texts and values are folded and cut: a pattern of words, and one of all characters that are no symbols."""

    fold: Callable[[Column], Column]
    word: str
    plain: str

    def words(self, text: Column) -> Column:
        return F.regexp_extract_all(self.fold(text), F.lit(self.word), F.lit(0))

    def symbols(self, text: Column) -> Column:
        """The hash of each distinct character that belongs to no word and isn't white space."""
        one = F.array_distinct(F.array_remove(F.split(F.regexp_replace(self.fold(text), self.plain, ""), ""), ""))
        return F.transform(one, lambda c: F.xxhash64(F.lit(0), c))


#: Runs of letters, digits and underscores.
WHOLE_WORDS = Cut(lambda text: text, r"[\p{L}\p{N}_]+", r"(?U)[\p{L}\p{N}_\s]+")
#: Runs of digits, and of letters of two alphabets, in lower case.
LETTERS_OR_DIGITS = Cut(lambda text: F.lower(F.translate(text, ALSO, SAME)), "[0-9]+|[a-zа-яё_]+", r"(?U)[0-9a-zа-яё_\s]+")


def shingles(words: Column, n: Column) -> Column:
    """The hash of every n consecutive words."""
    at = F.sequence(F.lit(0), F.size(words) - n)
    return F.when(F.size(words) >= n, F.transform(at, lambda i: F.xxhash64(n, F.slice(words, i + 1, n)))).otherwise(F.array().cast("array<bigint>"))


def value_shingles(values: DataFrame, cut: Cut, column: str) -> DataFrame:
    """values with the words of a shingle (`n_`: 0 for symbols) and each of its shingles (`h_`); values that can't be found go."""
    rows = values.where(F.col(column).rlike(r"(?U)\S")).withColumn("w_", cut.words(F.col(column)))
    rows = rows.withColumn("n_", F.least(F.size("w_"), F.lit(LONGEST)))
    own = F.when(F.col("n_") == 0, cut.symbols(F.col(column))).otherwise(shingles(F.col("w_"), F.col("n_")))
    return rows.withColumn("h_", F.explode(F.array_distinct(own))).drop("w_")


def candidates(texts: DataFrame, values: DataFrame, keys: list[str], on: list[str], cut: Cut = WHOLE_WORDS, column: str = "value") -> DataFrame:
    """(keys, columns of `values`, h_): the texts that hold a value's anchor h_; texts and values meet within `on` only."""
    own = kept(value_shingles(values, cut, column), "shingles")
    sizes = sorted(r["n_"] for r in own.select("n_").distinct().collect())  # 0 to LONGEST
    rest = [c for c in on if c not in keys]
    rows = texts.select(*keys, *rest, cut.words(F.col("text")).alias("w_"), *([cut.symbols(F.col("text")).alias("s_")] if 0 in sizes else []))
    parts = [F.col("s_") if n == 0 else shingles(F.col("w_"), F.lit(n)) for n in sizes] or [F.array().cast("array<bigint>")]
    rows = rows.select(*keys, *rest, F.explode(F.array_distinct(F.concat(*parts))).alias("h_"))
    met = kept(rows.join(own.select(*on, "h_").distinct(), [*on, "h_"], "left_semi"), "met")
    seen = met.groupBy(*on, "h_").agg(F.count("*").alias("texts_"))
    value = [c for c in values.columns if c not in on]
    anchors = own.join(seen, [*on, "h_"]).groupBy(*on, *value).agg(F.min_by("h_", F.struct("texts_", "h_")).alias("h_"))
    return met.join(anchors, [*on, "h_"]).select(*keys, *value, "h_")


def value_hits(texts: DataFrame, values: DataFrame, keys: list[str], on: list[str]) -> DataFrame:
    """(keys, start, end, token): places of exact values in texts (keys, on, text).

    values: (on, value, token). A place counts if no letter, digit or underscore touches it on a side where the value has
    one. Among places that overlap, the earliest goes first and the longest of one start.
    """
    found = candidates(texts, values.select(*on, "value", "token"), keys, on)
    lists = found.groupBy(*keys).agg(F.collect_set(F.struct("value", "token")).alias("c_"))
    text = F.col("text")

    def of(c: Column) -> Column:
        size = F.length(c["value"])
        touched = lambda at, own: tx.is_word_char(F.when(at > 0, F.substring(text, at, F.lit(1)))) & tx.is_word_char(own)
        free = lambda at: ~touched(at, F.substring(c["value"], 1, 1)) & ~touched(at + size + 1, F.right(c["value"], F.lit(1)))
        place = lambda at: F.struct(at.alias("start"), (-size).alias("shorter"), (at + size).alias("end"), c["token"].alias("token"))
        return F.transform(F.filter(tx.places(text, c["value"]), free), place)

    hits = lists.join(texts.select(*keys, "text"), keys).withColumn("h_", F.array_sort(F.flatten(F.transform("c_", of))))
    zero = F.struct(F.lit(0).alias("pos"), F.array().cast("array<struct<start:int,end:int,token:string>>").alias("out"))

    def add(a: Column, x: Column) -> Column:
        one = F.struct(x["start"].cast("int").alias("start"), x["end"].cast("int").alias("end"), x["token"].alias("token"))
        return F.when(x["start"] < a["pos"], a).otherwise(F.struct(x["end"].cast("int").alias("pos"), F.concat(a["out"], F.array(one)).alias("out")))

    return hits.select(*keys, F.inline(F.aggregate("h_", zero, add, lambda a: a["out"])))


def spellings(names: DataFrame) -> DataFrame:
    """names (seq, value) -> (seq, form_, value, spelling, pattern_): numbers in up to four spellings, all else as it is."""
    value = F.col("value")
    numeric = value.rlike("[0-9]") & value.rlike(r"^[0-9  .,+-]+$")
    tight = F.translate(value, "  ", "")
    forms = F.when(numeric, F.array_distinct(F.array(value, tight, F.replace(value, F.lit(","), F.lit(".")), F.replace(tight, F.lit(","), F.lit("."))))).otherwise(F.array(value))
    quoted = F.concat(F.lit(r"\Q"), F.replace("spelling", F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    number = F.concat(F.lit("(?<![0-9.,])"), quoted, F.lit(r"(?:[.,]\d+)?(?![0-9])"))
    word = F.concat(F.lit("(?iu)(?<![A-Za-zА-Яа-яЁё0-9_])"), quoted, F.lit("(?![A-Za-zА-Яа-яЁё0-9_])"))
    out = names.select("seq", "value", numeric.alias("numeric"), F.posexplode(forms).alias("form_", "spelling"))
    kind = F.when(tx.is_name_like(value), "PERSON").otherwise("MISC")
    return out.select("seq", "form_", "value", "spelling", F.when(F.col("numeric"), number).otherwise(word).alias("pattern_"), kind.alias("type_"))


def redactions(texts: DataFrame, names: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, start, end, value, type, confidence): spans of the user's own values.

    names: (seq, value). Any case, not inside words; numbers in four spellings with their decimals; placeholders are left
    alone. Of spans that overlap, the value with the smaller seq and the earlier spelling goes first.
    """
    found = candidates(texts, spellings(names), keys, [], LETTERS_OR_DIGITS, "spelling")
    lists = found.groupBy(*keys).agg(F.array_sort(F.collect_set(F.struct("seq", "form_", "pattern_", "type_"))).alias("c_"))
    hidden = F.transform(tx.matches(F.col("text"), cat.TOKEN), lambda m: F.struct(m["start"], m["end"], F.repeat(F.lit(" "), m["end"] - m["start"]).alias("token")))
    rows = lists.join(texts.select(*keys, "text"), keys).withColumn("masked_", tx.cut_out(F.col("text"), hidden))

    def of(c: Column) -> Column:
        return F.transform(tx.matches(F.col("masked_"), c["pattern_"]), lambda m: span(m["start"], m["end"], F.substring("text", m["start"] + 1, m["end"] - m["start"]), c["type_"], F.lit(1.0)))

    def add(out: Column, s: Column) -> Column:
        return F.when(F.exists(out, lambda o: (o["start"] < s["end"]) & (o["end"] > s["start"])), out).otherwise(F.concat(out, F.array(s)))

    return rows.select(*keys, F.inline(F.aggregate(F.flatten(F.transform("c_", of)), no_spans(), add)))
