"""Readers: text files of three encodings, chat JSON, XML, and office files as segments or cells."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Extensions and content types that the readers know.
CONTENT_TYPES = {
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    "xml": "application/xml",
    "txt": "text/plain",
    "md": "text/markdown",
}


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def content_type(path: Column) -> Column:
    found = F.create_map(*[F.lit(x) for kv in CONTENT_TYPES.items() for x in kv])
    return F.coalesce(F.try_element_at(found, extension(path)), F.lit("application/octet-stream"))


def supported_only(df: DataFrame, path: str = "path") -> DataFrame:
    return df.where(extension(F.col(path)).isin(*CONTENT_TYPES))


def decode_text(content: Column) -> Column:
    """UTF-8 if the bytes are, else cp1251 if every byte is one of its characters, else UTF-8 with replacements."""
    high = "".join(map(chr, range(0x80, 0x100)))
    cyrillic = bytes(range(0x80, 0x100)).decode("cp1251", "replace")
    utf, latin = F.try_validate_utf8(content.cast("string")), F.decode(content, "ISO-8859-1")
    old = F.when(~F.contains(latin, F.lit("\x98")), F.translate(latin, high, cyrillic))
    return F.coalesce(utf, old, F.make_valid_utf8(content.cast("string")))


def read_text_docs(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, modified, text) of .txt and .md files; doc_id is the path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    files = files.where(extension(F.col("path")).isin("txt", "md"))
    return files.select(F.col("path").alias("doc_id"), F.col("modificationTime").alias("modified"), decode_text(F.col("content")).alias("text"))


def decode_base64_files(df: DataFrame, column: str = "data") -> DataFrame:
    """Files that came as base64: `content` holds the bytes, null where it isn't base64."""
    plain = F.regexp_replace(F.col(column), r"\s+", "")
    good = plain.rlike(r"^(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?$")
    return df.withColumn("content", F.when(good, F.unbase64(plain)))


MESSAGES = "array<struct<role:string,content:string,name:string,tool_call_id:string,tool_calls:array<struct<id:string,type:string,function:struct<name:string,arguments:string>>>>>"


def read_messages(df: DataFrame, column: str = "request") -> DataFrame:
    """Chat requests in JSON -> (the other columns, turn, role, text, parts, tool_calls).

    String content is `text`; content in parts is `parts` with its text parts joined in `text`; null stays null.
    """
    keys = [c for c in df.columns if c != column]
    body = F.from_json(F.get_json_object(column, "$.messages"), MESSAGES)
    rows = df.select(*keys, F.posexplode(body).alias("turn", "m"))
    parts = F.when(F.col("m.content").startswith("["), F.from_json("m.content", "array<struct<type:string,text:string>>"))
    joined = F.array_join(F.transform(F.filter(parts, lambda p: p["type"] == "text"), lambda p: p["text"]), "\n")
    calls = F.transform("m.tool_calls", lambda c: F.struct(c["id"].alias("id"), c["function"]["name"].alias("name"), c["function"]["arguments"].alias("arguments")))
    return rows.select(*keys, "turn", "m.role", F.coalesce(joined, F.col("m.content")).alias("text"), parts.alias("parts"), calls.alias("tool_calls"))


def _in_tasks(files: DataFrame, parse: Callable[[bytes], list[tuple]], names: list[str], schema: str) -> DataFrame:
    """Parsed rows of each file; a file that can't be parsed gives one row with its `error`."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for path, content in zip(f["path"], f["content"]):
                try:
                    rows += [(path, *r, None) for r in parse(bytes(content))]
                except Exception as e:  # noqa: BLE001  told by the column
                    rows.append((path, *[None] * len(names), f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["doc_id", *names, "error"])

    return files.select("path", "content").mapInPandas(run, f"doc_id string, {schema}, error string")


_PERSONAL = ("name", "resourcename", "author", "manager")


def _xml_rows(content: bytes) -> list[tuple]:
    root, rows = ET.fromstring(content), []

    def walk(el, path):
        name = el.tag.split("}")[-1]
        path = f"{path}/{name}"
        if (el.text or "").strip():
            rows.append((len(rows), "text", path, el.text.strip()))
        for k, v in el.attrib.items():
            if any(p in k.lower() for p in _PERSONAL) and len(v) > 2:
                rows.append((len(rows), "attribute", f"{path}@{k}", v))
        for child in el:
            walk(child, path)
            if (child.tail or "").strip():
                rows.append((len(rows), "tail", path, child.tail.strip()))

    walk(root, "")
    return rows


def read_xml_segments(files: DataFrame) -> DataFrame:
    """files (path, content) -> (doc_id, seg_idx, kind, coord, text, error): element texts, personal attributes, tails, in order."""
    return _in_tasks(files, _xml_rows, ["seg_idx", "kind", "coord", "text"], "seg_idx int, kind string, coord string, text string")


def _parts(content: bytes) -> dict[str, bytes]:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        return {n: z.read(n) for n in z.namelist() if n.endswith((".xml", ".rels"))}


def _local(el) -> str:
    return el.tag.split("}")[-1] if isinstance(el.tag, str) else ""


def _texts(el, tags=("t",)) -> str:
    out = []
    for x in el.iter():
        name = _local(x)
        out.append(x.text or "" if name in tags else "\n" if name in ("br", "cr") else "\t" if name == "tab" else "")
    return "".join(out)


def _attr(el, name: str) -> str | None:
    return next((v for k, v in el.attrib.items() if k.split("}")[-1] == name), None)


def _docx_rows(content: bytes) -> list[tuple]:
    parts, rows = _parts(content), []
    line = lambda s: " ".join(s.split("\n")).strip()

    def put(kind, coord, text):
        if line(text):
            rows.append((len(rows), kind, coord, line(text)))

    def table(tbl, coord):
        for r, tr in enumerate(x for x in tbl if _local(x) == "tr"):
            for c, tc in enumerate(x for x in tr if _local(x) == "tc"):
                here = f"{coord}/{r}/{c}"
                for p, el in enumerate(x for x in tc if _local(x) == "p"):
                    put("cell", f"{here}/{p}", _texts(el))
                for k, el in enumerate(x for x in tc if _local(x) == "tbl"):
                    table(el, f"{here}/t{k}")

    body = next((x for x in ET.fromstring(parts["word/document.xml"]) if _local(x) == "body"), [])
    for p, el in enumerate(x for x in body if _local(x) == "p"):
        boxes = {id(d) for b in el.iter() if _local(b) == "txbxContent" for d in b.iter()}
        put("para", str(p), "".join((x.text or "") for x in el.iter() if _local(x) == "t" and id(x) not in boxes))
    for k, el in enumerate(x for x in body if _local(x) == "tbl"):
        table(el, str(k))
    for name in sorted(n for n in parts if n.startswith(("word/header", "word/footer"))):
        for p, el in enumerate(x for x in ET.fromstring(parts[name]).iter() if _local(x) == "p"):
            put("header" if "header" in name else "footer", f"{name}/{p}", _texts(el))
    for k, box in enumerate(x for x in body.iter() if _local(x) == "txbxContent"):
        for p, el in enumerate(x for x in box if _local(x) == "p"):
            put("textbox", f"{k}/{p}", _texts(el))
    if "word/comments.xml" in parts:
        for k, c in enumerate(x for x in ET.fromstring(parts["word/comments.xml"]) if _local(x) == "comment"):
            put("comment", str(k), " ".join(_texts(p) for p in c if _local(p) == "p"))
            put("comment_author", str(k), _attr(c, "author") or "")
    return rows


def read_docx_segments(files: DataFrame) -> DataFrame:
    """files (path, content) -> segments: paragraphs, cells (nested too), headers and footers, text boxes, comments and their authors."""
    return _in_tasks(files, _docx_rows, ["seg_idx", "kind", "coord", "text"], "seg_idx int, kind string, coord string, text string")


def _xlsx_rows(content: bytes) -> list[tuple]:
    parts, rows = _parts(content), []
    shared = [_texts(si) for si in ET.fromstring(parts["xl/sharedStrings.xml"]) if _local(si) == "si"] if "xl/sharedStrings.xml" in parts else []
    formats: list[str] = []
    if "xl/styles.xml" in parts:
        styles = ET.fromstring(parts["xl/styles.xml"])
        codes = {_attr(x, "numFmtId"): _attr(x, "formatCode") for x in styles.iter() if _local(x) == "numFmt"}
        xfs = next((x for x in styles if _local(x) == "cellXfs"), [])
        formats = [codes.get(_attr(x, "numFmtId"), "") or "" for x in xfs]
    book = ET.fromstring(parts["xl/workbook.xml"])
    rels = {_attr(x, "Id"): _attr(x, "Target") for x in ET.fromstring(parts.get("xl/_rels/workbook.xml.rels", b"<r/>"))}
    for sheet in (x for x in book.iter() if _local(x) == "sheet"):
        target = (rels.get(_attr(sheet, "id")) or "").lstrip("/")
        name = target if target.startswith("xl/") else f"xl/{target}"
        for c in (x for x in ET.fromstring(parts[name]).iter() if _local(x) == "c"):
            ref, kind = c.attrib.get("r", ""), c.attrib.get("t", "n")
            own = {_local(x): x for x in c}
            if "f" in own:
                value, kind = "=" + (own["f"].text or ""), "formula"
            elif kind == "inlineStr":
                value, kind = _texts(c), "string"
            elif "v" in own:
                raw = own["v"].text or ""
                value, kind = (shared[int(raw)], "string") if kind == "s" else (raw, {"n": "number", "b": "boolean", "str": "string"}.get(kind, kind))
            else:
                continue
            letters = "".join(x for x in ref if x.isalpha())
            col = 0
            for x in letters:
                col = 26 * col + ord(x.upper()) - 64
            fmt = formats[int(c.attrib.get("s", 0))] if int(c.attrib.get("s", 0)) < len(formats) else ""
            if value != "":
                rows.append((_attr(sheet, "name"), int("".join(x for x in ref if x.isdigit()) or 0), col, value, kind, fmt))
    return rows


def read_xlsx_cells(files: DataFrame) -> DataFrame:
    """files (path, content) -> (doc_id, sheet, row, col, value, value_type, number_format, error); formulas stay text."""
    names = ["sheet", "row", "col", "value", "value_type", "number_format"]
    return _in_tasks(files, _xlsx_rows, names, "sheet string, row int, col int, value string, value_type string, number_format string")
