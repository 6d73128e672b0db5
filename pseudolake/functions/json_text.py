"""Strings inside JSON texts: their places, what they say, and the way back from a place in what they say to the text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as tx

#: A string and, if it is a key, the colon after it. Outside strings JSON has no quotation marks, so matches in order are the strings.
STRING = r'(?s)"((?:[^"\\]++|\\.)*+)"(\s*+:)?'
#: Units of a string's content: an escaped pair of surrogates, another escape, or a run without escapes.
UNIT = r"(?s)\\u[dD][89abAB][0-9a-fA-F]{2}\\u[dD][c-fC-F][0-9a-fA-F]{2}|\\u[0-9a-fA-F]{4}|\\.|[^\\]++"
UNITS = "array<struct<raw:string,said:string>>"


def is_json(text: Column) -> Column:
    return F.try_parse_json(text).isNotNull()


def units(content: Column) -> Column:
    """The content of a string in units: as it is written, and what it says."""
    parts = F.regexp_extract_all(content, F.lit(UNIT), F.lit(0))
    read = lambda u: F.coalesce(F.from_json(F.concat(F.lit('{"v":"'), u, F.lit('"}')), "v string")["v"], F.lit("\ufffd"))
    short = lambda u: F.translate(F.substring(u, 2, 1), "bfnrt", "\b\f\n\r\t")
    said = lambda u: F.when(~F.startswith(u, F.lit("\\")), u).when(u.rlike(r'^\\["\\/bfnrt]$'), short(u)).otherwise(read(u))
    return F.transform(parts, lambda u: F.struct(u.alias("raw"), said(u).alias("said")))


def strings(text: Column) -> Column:
    """array of struct(start, key, units): the strings of a JSON text; start is the place of the content, key whether it is a key.

    A text that isn't JSON is one string of its own, without escapes.
    """

    def one(m: Column) -> Column:
        return F.struct((m["start"] + 1).alias("start"), F.endswith(m["value"], F.lit(":")).alias("key"), units(F.regexp_extract(m["value"], STRING, 1)).alias("units"))

    whole = F.array(F.struct(F.lit(0).alias("start"), F.lit(False).alias("key"), F.array(F.struct(text.alias("raw"), text.alias("said"))).alias("units")))
    return F.when(is_json(text), F.transform(tx.matches(text, STRING), one)).otherwise(whole)


def said(parts: Column) -> Column:
    return F.array_join(F.transform(parts, lambda u: u["said"]), "")


def raw_place(parts: Column, at: Column, end: bool = False) -> Column:
    """The place in the content of a place in what it says: an escape is never cut."""
    zero = F.struct(F.lit(0).alias("raw"), F.lit(0).alias("said"), F.lit(None).cast("int").alias("found"))

    def add(a: Column, u: Column) -> Column:
        raw, out = F.length(u["raw"]), F.length(u["said"])
        inside = a["found"].isNull() & ((at <= a["said"] + out) if end else (at < a["said"] + out))
        place = F.when(F.startswith(u["raw"], F.lit("\\")) & (raw > 1), a["raw"] + raw if end else a["raw"]).otherwise(a["raw"] + at - a["said"])
        return F.struct((a["raw"] + raw).alias("raw"), (a["said"] + out).alias("said"), F.when(inside, place).otherwise(a["found"]).cast("int").alias("found"))

    return F.aggregate(parts, zero, add, lambda a: a["found"])


def escaped(value: Column) -> Column:
    """A value as the content of a JSON string."""
    token = F.to_json(F.struct(value.alias("v")))
    return F.substring(token, F.lit(7), F.length(token) - 8)
