"""Column functions on text: matches with places, normalisation, predicates, lines, numbers, paths."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import catalog

#: A character that texts hardly have.
MARK = "\x00"
PLACED = "array<struct<start:int,end:int,value:string>>"
SPAN = "array<struct<start:int,end:int,value:string,type:string,confidence:double>>"

# Look-alike letters of two alphabets, Cyrillic then Latin.
CYRILLIC = "АВЕКМНОРСТУХавекмнорстух"
LATIN = "ABEKMHOPCTYXabekmhopctyx"

#: Characters whose folded form has another length; texts with them are searched as they are.
EXPANDING = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and len(chr(c).casefold()) > 1)
_FOLDED = [(chr(c), chr(c).casefold()) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and len(chr(c).casefold()) == 1 and chr(c).casefold() != chr(c).lower()]


def matches(text: Column, pattern: str | Column) -> Column:
    """All matches of a Java pattern, with places in code points (end exclusive).

    The pattern runs over a text once: matches are put between marks, and the text is cut at the marks. Only a text that has
    the mark itself is searched twice, for what lies between matches and for the matches.
    """
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    none = F.array().cast(PLACED)
    cut = F.split(F.regexp_replace(text, pattern, F.lit(f"{MARK}$0{MARK}")), MARK, -1)
    pairs = F.zip_with(F.split(text, pattern, F.lit(-1)), F.regexp_extract_all(text, pattern, F.lit(0)), lambda g, m: F.array(g, m))
    pieces = F.when(F.contains(text, F.lit(MARK)), F.filter(F.flatten(pairs), lambda x: x.isNotNull())).otherwise(cut)
    zero = F.struct(F.lit(0).alias("pos"), F.lit(False).alias("found"), none.alias("out"))

    def add(a: Column, x: Column) -> Column:
        end = a["pos"] + F.length(x)
        span = F.struct(a["pos"].alias("start"), end.alias("end"), x.alias("value"))
        return F.struct(end.alias("pos"), (~a["found"]).alias("found"), F.when(a["found"], F.concat(a["out"], F.array(span))).otherwise(a["out"]).alias("out"))

    return F.coalesce(F.aggregate(pieces, zero, add, lambda a: a["out"]), none)


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once a row, however often it is used, also in lambdas."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def places(text: Column, value: Column) -> Column:
    """array<int>: where a value (not empty) stands in a text, overlapping places too; linear in the text, like one search."""
    quoted = F.concat(F.lit(r"(?=\Q"), F.replace(value, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E)"))
    zero = F.struct(F.lit(0).alias("pos"), F.array().cast("array<int>").alias("out"))

    def add(a: Column, piece: Column) -> Column:
        pos = a["pos"] + F.length(piece)
        return F.struct(pos.alias("pos"), F.concat(a["out"], F.array(pos)).alias("out"))

    before = lambda pieces: F.slice(pieces, 1, F.size(pieces) - 1)
    later = once(F.split(text, quoted, F.lit(-1)), lambda pieces: F.aggregate(before(pieces), zero, add, lambda a: a["out"]))
    first = F.when(F.startswith(text, value), F.array(F.lit(0))).otherwise(F.array().cast("array<int>"))
    return F.when(F.contains(text, value), F.concat(first, later)).otherwise(F.array().cast("array<int>"))


#: Characters of a part of a text.
PART = 1024


def parts(text: Column) -> Column:
    """array<string>: a text in parts of PART characters, so that what stands at a place is found without a walk from the beginning."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PART}}}"), F.lit(0))


def of_parts(parts: Column, start: Column, end: Column) -> Column:
    """What stands at a place of a text in parts; null or '' outside."""
    first = F.floor(start / PART).cast("int")
    some = F.slice(parts, first + 1, F.greatest(F.floor((end - 1) / PART).cast("int") - first + 1, F.lit(0)))
    return F.when(start >= 0, F.substring(F.array_join(some, ""), start - first * PART + 1, end - start))


def cut_out(text: Column, spans: Column, put: str = "token") -> Column:
    """`text` with each span (sorted, apart) replaced by its field `put`; values are inserted literally."""
    zero = F.struct(F.lit(0).alias("pos"), F.array().cast("array<string>").alias("out"))

    def add(a: Column, s: Column) -> Column:
        gap = F.substring(text, a["pos"] + 1, s["start"] - a["pos"])
        return F.struct(s["end"].alias("pos"), F.concat(a["out"], F.array(gap, s[put])).alias("out"))

    return F.aggregate(spans, zero, add, lambda a: F.concat(F.array_join(a["out"], ""), F.substring(text, a["pos"] + 1, F.length(text))))


def _any_of(chars: str) -> str:
    """A character class of a Java pattern; Latin characters are told before the many ranges behind them are gone through."""
    ranges: list[list[int]] = []
    for c in sorted(set(map(ord, chars))):
        if ranges and c == ranges[-1][1] + 1:
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
    low, high = ("".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in ranges if (a < 0x250) == latin) for latin in (True, False))
    return f"[{low}{f'[\\x{{250}}-\\x{{10ffff}}&&[{high}]]' if high else ''}]"


def translated(c: Column, source: str, target: str) -> Column:
    """translate(), which is slow, of texts with any of these characters only."""
    return F.when(c.rlike(_any_of(source)), F.translate(c, source, target)).otherwise(c)


def normalize_for_search(c: Column) -> Column:
    """Case folded, ё as е, look-alike Cyrillic letters as Latin ones; the length stays where foldable() holds."""
    source = "".join(a for a, _ in _FOLDED) + "ё" + CYRILLIC
    target = "".join(b for _, b in _FOLDED) + "e" + LATIN
    return once(F.lower(translated(c, source, target)), lambda low: translated(low, "ё" + CYRILLIC, "e" + LATIN))


def foldable(c: Column) -> Column:
    """Whether folding keeps the length of every character."""
    return ~c.rlike(_any_of(EXPANDING))


def is_word_char(c: Column) -> Column:
    return F.coalesce(c, F.lit("")).rlike(r"^[\p{L}\p{N}_]")


def is_acronym(c: Column) -> Column:
    """At least one letter, and no letter that isn't upper case."""
    return c.rlike(r"\p{L}") & ~F.regexp_replace(c, r"[^\p{L}]", "").rlike(r"[^\p{Lu}]")


def is_numeric_value(c: Column) -> Column:
    return c.rlike("[0-9]") & c.rlike(r"^[0-9 \u00A0\u2009.,+-]+$")


def is_name_like(c: Column) -> Column:
    return c.rlike(r"^[A-Za-zА-Яа-яЁё][A-Za-zА-Яа-яЁё.\- ]*$")


def has_tokens(c: Column) -> Column:
    return c.rlike(catalog.TOKEN)


def valid_session_id(c: Column) -> Column:
    return F.coalesce(c.rlike(catalog.SESSION_ID), F.lit(False))


def strip_think(c: Column) -> Column:
    """Without <think> blocks (or an unfinished one), trimmed; null becomes ''."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?s)<think>.*?(?:</think>|$(?!\n))", ""), r"^\s+|\s+$(?!\n)", "")


def normalize_line(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s*\n+\s*", " "), r"^\s+|\s+$", "")


def one_line(c: Column) -> Column:
    return F.regexp_replace(F.trim(c), r"\s*\n+\s*", " / ")


def fmt_cell(c: Column, kind: str = "string") -> Column:
    """A cell as people read it: ISO dates (times only where there is one), no escaped carriage returns, one line; null becomes ''."""
    if kind == "date":
        shown = F.date_format(c, "yyyy-MM-dd")
    elif kind.startswith("timestamp"):
        shown = F.when(c == F.date_trunc("day", c).cast(kind), F.date_format(c, "yyyy-MM-dd")).otherwise(F.date_format(c, "yyyy-MM-dd HH:mm:ss"))
    else:
        shown = normalize_line(F.replace(c.cast("string"), F.lit("_x000D_"), F.lit("")))
    return F.coalesce(shown, F.lit(""))


def prefixed_model(c: Column, provider: str) -> Column:
    """What follows "provider/" in a model's name, null for other names; the provider in any case."""
    name = F.regexp_extract(F.trim(c), r"(?s)^[^/]*/(.+)$", 1)
    return F.when((F.lower(F.substring_index(F.trim(c), "/", 1)) == provider) & (name != ""), name)


def find_lines(text: Column, needle: str) -> Column:
    """The lines with `needle`, whatever the case and ё or е."""
    fold = lambda c: F.translate(F.lower(c), "ё", "е")
    return F.filter(F.split(text, "\n"), lambda line: F.contains(fold(line), fold(F.lit(needle))))


def scrub_link_targets(html: Column) -> Column:
    """External targets of links (http, ftp, mailto, www) become #."""
    return F.regexp_replace(html, r"(?i)(\bhref\s*=\s*)([\"'])(?:https?:|ftp:|mailto:|www\.)[^\"']*\2", "$1$2#$2")


def group_digits(digits: Column) -> Column:
    return F.regexp_replace(digits, r"(?<=\d)(?=(?:\d{3})+$)", " ")


def currency_of_format(fmt: Column) -> Column:
    """The currency a number format shows, '' if it is not of money."""
    parts = [F.regexp_extract(fmt, r"\[\$([^\]-]+)[^\]]*\]|\\([₽$€¥£])|(?<![0-9#])(₽|\$|€|¥|£)|\"((?:руб|р)\.?|руб\p{L}*|RUB)\"", k) for k in (1, 2, 3, 4)]
    return F.coalesce(*[F.when(p != "", p) for p in parts], F.lit(""))


def render_number(value: Column, fmt: Column) -> Column:
    """A plain decimal string as a spreadsheet shows it: grouped, decimal comma, currency; null if the format asks for none.

    Strings with an exponent are not rendered.
    """
    currency = currency_of_format(F.lower(fmt))
    wanted = (currency != "") | F.contains(fmt, F.lit("#,##")) | F.contains(fmt, F.lit("# ##"))
    whole, part = F.regexp_extract(value, r"^-?(\d+)", 1), F.regexp_extract(value, r"\.(\d+)$", 1)
    text = F.concat(F.when(value.startswith("-"), "-").otherwise(""), group_digits(whole), F.when(part != "", F.concat(F.lit(","), part)).otherwise(""))
    return F.when(wanted & value.rlike(r"^-?\d+(?:\.\d+)?$"), F.concat(text, F.when(currency != "", F.concat(F.lit(" "), currency)).otherwise("")))


def restore_number(text: Column) -> Column:
    """Text of a cell that held a number as a double, null if it is none any more."""
    plain = F.regexp_replace(F.regexp_replace(text, r"[ \u00A0\u2009]", ""), r"(?iuU)[₽$€¥£]|руб\w*|р\.", "")
    return F.when(plain.rlike(r"^[+-]?[0-9]*[.,]?[0-9]*$"), F.translate(plain, ",", ".").try_cast("double"))


def coerce_value(text: Column) -> Column:
    """A struct of date, int, float and text, of which one is set: ISO or DD.MM.YYYY dates, whole numbers, numbers, the rest."""
    iso = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(text, "yyyy-MM-dd"))
    dmy = F.when(text.rlike(r"^\d{1,2}\.\d{1,2}\.\d{4}$"), F.try_to_date(text, "d.M.yyyy"))
    date = F.coalesce(iso, dmy)
    whole = F.when(text.rlike(r"^[+-]?\d{1,18}$"), text.try_cast("long"))
    real = F.when(date.isNull() & whole.isNull() & text.rlike(r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$"), text.try_cast("double"))
    rest = F.when(F.coalesce(date.cast("string"), whole.cast("string"), real.cast("string")).isNull(), text)
    return F.struct(date.alias("date"), whole.alias("int"), real.alias("float"), rest.alias("text"))


def norm_path(c: Column) -> Column:
    """Paths to compare: no file: prefix or quotes, forward slashes, decoded, lower case, no trailing slash."""
    plain = F.regexp_replace(F.trim(c), r"^(?:@?file:(?://)?)|^[\"']|[\"']$", "")
    plain = F.coalesce(F.try_url_decode(F.replace(plain, F.lit("+"), F.lit("%2B"))), plain)
    return F.lower(F.regexp_replace(F.regexp_replace(plain, r"\\", "/"), r"(?<=.)/+$", ""))


def is_anonymized_copy(c: Column) -> Column:
    return F.lower(c).rlike(r"\.anonymized\.[a-z0-9]+$")


def result_path(c: Column) -> Column:
    """name.anonymized.ext -> name.result.ext; other names get .result before the extension."""
    return F.when(is_anonymized_copy(c), F.regexp_replace(c, r"(?i)\.anonymized(\.[a-z0-9]+)$", ".result$1")).otherwise(F.regexp_replace(c, r"(\.[A-Za-z0-9]+)$", ".result$1"))


def copy_path(c: Column) -> Column:
    return F.regexp_replace(c, r"(\.[A-Za-z0-9]+)$", ".anonymized$1")


def command_intent(text: Column, content_allowed: Column | None = None) -> Column:
    """restart, backend_local, backend_cloud, reveal_some, hide_some, reveal_all, hide_all or null."""
    these = r"\s+(?:вот\s+)?(?:только\s+)?(?:(?:эти|следующ\w*|указанн\w*|привед[её]нн\w*)\s+данн\w*|это\b)"
    whole = r"\s+(?:все\s+данн\w*|вс[её]\b|данн\w*|полност\w*)"
    hit = lambda p: text.rlike("(?iuU)" + p)
    tokens = text.rlike(r"(?i)(?<![A-Za-zА-Яа-яЁё0-9_])\[?(?:" + "|".join(catalog.TYPES) + r")_\d{1,6}\]?(?![A-Za-zА-Яа-яЁё0-9])")
    content = F.lit(True) if content_allowed is None else content_allowed
    # The phrases of each command.
    restart = r"(?:перезапусти|перезапустить|перезагрузи|перезагрузить|рестартни|рестартан)\w*\s+(?:прокси|сервер)|перезапуск\s+(?:прокси|сервера)|перезагрузк\w+\s+(?:прокси|сервера)|\brestart\s+(?:the\s+)?proxy\b"
    local = r"(?:переключи|переключись|работай|используй|верни)\w*[^\n]{0,40}локальн"
    cloud = r"(?:переключи|переключись|работай|используй|верни|вернись)\w*[^\n]{0,40}(?:обла(?:чн|к)|cloud)"
    some = r"(?<![а-яё])раскро\w*" + these + r"|deanonymi[sz]e\s+placeholder"
    extra = r"(?<![а-яё])скро\w*" + these
    reveal = r"раскро\w*" + whole + r"|deanonymi[sz]e?"
    hide = r"(?<![а-яё])скро\w*" + whole + r"|anonymi[sz]e?"
    return (
        F.when(hit(restart), "restart").when(hit(local), "backend_local").when(hit(cloud), "backend_cloud")
        .when(content & (hit(some) | tokens & hit(r"(?<![а-яё])раскро\w*|" + reveal)), "reveal_some")
        .when(content & hit(extra), "hide_some").when(content & hit(reveal), "reveal_all").when(content & hit(hide), "hide_all")
    )


def markers(text: Column, kind: str) -> Column:
    """Paths of [anonymizer:kind:path] markers that are paths (a slash, no angle brackets)."""
    paths = F.transform(F.regexp_extract_all(text, F.lit(r"\[anonymizer:" + kind + r":([^\]]+)\]"), F.lit(1)), F.trim)
    return F.filter(paths, lambda p: p.rlike(r"[\\/]") & ~p.rlike("[<>]"))


def session_ids(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"session_id:\s*([A-Za-z0-9_-]{1,64})"), F.lit(1))


def parse_placeholder_spec(text: Column) -> Column:
    """struct(tokens, errors): tokens [TYPE_N] named singly or as ranges, in order of first mention.

    Ranges (– - — .. … по до) hold within one type and upwards; anything else of the kind is an error, as are unknown types.
    """
    range_re = r"(?iu)(?:(?<![\p{L}\p{N}_])с\s+)?\[?([A-Za-z]{2,20})_(\d{1,6})\]?\s*(?:[-–—]|\.\.|…|(?<![\p{L}\p{N}_])(?:по|до)(?![\p{L}\p{N}_]))\s*\[?(?:([A-Za-z]{2,20})_)?(\d{1,6})\]?"
    token_re = r"(?iu)(?<![A-Za-zА-Яа-яЁё0-9_])\[?([A-Za-z]{2,20})_(\d{1,6})\]?(?![A-Za-zА-Яа-яЁё0-9])"
    known = F.array(*map(F.lit, catalog.TYPES))

    def one_range(m: Column) -> Column:
        part = lambda k: F.regexp_extract(m["value"], range_re, k)
        t1, n1, n2 = F.upper(part(1)), part(2).cast("int"), part(4).cast("int")
        t2 = F.when(part(3) == "", t1).otherwise(F.upper(part(3)))
        good = (t1 == t2) & (n1 <= n2)
        found = F.when(good, F.transform(F.sequence(n1, F.greatest(n1, n2)), lambda n: F.struct(m["start"].alias("at"), t1.alias("t"), n.alias("n"))))
        wrong = F.concat(t1, F.lit("_"), n1.cast("string"), F.lit("–"), t2, F.lit("_"), n2.cast("string"), F.when(t1 != t2, ": two types").otherwise(": downwards"))
        return F.struct(F.coalesce(found, F.array().cast("array<struct<at:int,t:string,n:int>>")).alias("found"), F.when(~good, wrong).alias("wrong"))

    single = lambda m: F.struct(m["start"].alias("at"), F.upper(F.regexp_extract(m["value"], token_re, 1)).alias("t"), F.regexp_extract(m["value"], token_re, 2).cast("int").alias("n"))
    blank = lambda m: F.struct(m["start"], m["end"], F.repeat(F.lit(" "), m["end"] - m["start"]).alias("token"))
    name = lambda x: F.concat(x["t"], F.lit("_"), x["n"].cast("string"))

    def told(listed: Column, ranges: Column) -> Column:
        good = F.filter(listed, lambda x: F.array_contains(known, x["t"]))
        bad = F.transform(F.filter(listed, lambda x: ~F.array_contains(known, x["t"])), lambda x: F.concat(name(x), F.lit(": unknown type")))
        tokens = F.array_distinct(F.transform(good, lambda x: F.concat(F.lit("["), name(x), F.lit("]"))))
        errors = F.concat(F.filter(F.transform(ranges, lambda r: r["wrong"]), lambda w: w.isNotNull()), bad)
        return F.struct(tokens.alias("tokens"), errors.alias("errors"))

    def parsed(found: Column) -> Column:
        masked = cut_out(text, F.transform(found, blank))
        singles = once(masked, lambda rest: F.transform(matches(rest, token_re), single))
        listed = lambda ranges: F.array_sort(F.concat(F.flatten(F.transform(ranges, lambda r: r["found"])), singles))
        return once(F.transform(found, one_range), lambda ranges: once(listed(ranges), lambda x: told(x, ranges)))

    return once(matches(text, range_re), parsed)


# Words between a command and its list.
FILLER = "имена имя фамилии фамилию фамилий людей персоны следующих следующие этих указанных перечисленных names persons".split()


def parse_value_list(segment: Column) -> Column:
    """struct(values, errors): values between commas, semicolons, line ends and «и»; numbers torn at the decimal comma are rejoined."""
    noise = r"(?iu)@file:\S+|[A-Za-zА-Яа-яЁё0-9_\\/:.\- ]+\.(?:docx|xlsx|xml|txt|md)(?![\p{L}\p{N}_])|<file_content[^>]*>|</file_content>"
    plain = F.regexp_replace(segment, noise, " ")
    head = r"^[ \t:;—–-]*(?:(?iu)(?:" + "|".join(FILLER) + r")[,.]*(?: |$)[ \t:;—–-]*)*"
    plain = F.regexp_replace(plain, head, "")

    def trimmed(item: Column) -> Column:
        item = F.regexp_replace(item, r"^[ \t\r\n«»\"'`]+|[ \t\r\n«»\"'`]+$", "")
        return F.regexp_replace(item, r"^[:;—–-]+[ \t]*|[ \t]+$", "")

    def joined(group: Column) -> Column:
        start = F.array().cast("array<string>")

        def add(a: Column, x: Column) -> Column:
            last = F.element_at(a, -1)
            torn = (F.size(a) > 0) & x.rlike(r"^\d{1,3}$") & F.coalesce(last.rlike("^(?:\\d{1,3}(?:[ \\u00A0]\\d{3})*|\\d+)$"), F.lit(False))
            return F.when(torn, F.concat(F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))), F.array(F.concat(last, F.lit(","), x)))).otherwise(F.concat(a, F.array(x)))

        return F.aggregate(F.filter(F.transform(F.split(group, r"(?U),|\s+и\s+"), trimmed), lambda x: x != ""), start, add)

    merged = F.flatten(F.transform(F.split(plain, "[;\n]"), joined))
    fits = lambda x: F.length(x).between(2, 100) & (F.size(F.filter(F.split(x, r"(?U)\s+"), lambda w: w != "")) <= 8) & x.rlike("[A-Za-zА-Яа-яЁё0-9]")

    def told(merged: Column) -> Column:
        distinct = lambda good, low: F.filter(good, lambda x, k: F.array_position(low, F.lower(x)) == k + 1)
        first = once(F.filter(merged, fits), lambda good: once(F.transform(good, F.lower), lambda low: distinct(good, low)))
        return F.struct(first.alias("values"), F.filter(merged, lambda x: ~fits(x)).alias("errors"))

    return once(merged, told)
