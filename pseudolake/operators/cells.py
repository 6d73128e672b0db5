"""Cell grids: long tables (doc_id, sheet, row, col, value) of documents' tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GRID = ["doc_id", "sheet"]


def from_table(df: DataFrame, doc_id: Column, row: Column, columns: list[str], sheet: str = "Sheet1") -> DataFrame:
    """A wide table as cells with a header row: row 1 holds the names, data begin at row 2."""
    cells = F.array(*[F.struct(F.lit(k + 1).alias("col"), F.col(c).cast("string").alias("value")) for k, c in enumerate(columns)])
    data = df.select(doc_id.alias("doc_id"), F.lit(sheet).alias("sheet"), (row + 1).cast("int").alias("row"), F.inline(cells))
    head = F.array(*[F.struct(F.lit(k + 1).alias("col"), F.lit(c).alias("value")) for k, c in enumerate(columns)])
    names = df.select(doc_id.alias("doc_id")).distinct().select("doc_id", F.lit(sheet).alias("sheet"), F.lit(1).alias("row"), F.inline(head))
    return names.unionByName(data)


def column_letter(col: Column) -> Column:
    """1 -> A, 27 -> AA, up to three letters."""
    a = lambda n: F.char(F.lit(65) + n)
    two, three = F.floor((col - 1) / 26).cast("int"), F.floor((col - 27) / 676).cast("int")
    low = a((col - 1) % 26)
    return F.when(col <= 26, low).when(col <= 702, F.concat(a((two - 1) % 26), low)).otherwise(F.concat(a(three - 1), a((two - 1) % 26), low))


def column_number(letters: str) -> int:
    n = 0
    for c in letters.upper():
        n = 26 * n + ord(c) - 64
    return n


def guess_header_row(cells: DataFrame) -> DataFrame:
    """(doc_id, sheet, header_row): the first of the first 20 rows with three filled cells, else 1."""
    filled = F.sum(F.when(F.trim(F.coalesce("value", F.lit(""))) != "", 1).otherwise(0))
    rows = cells.where("row <= 20").groupBy(*GRID, "row").agg(filled.alias("n"))
    first = rows.groupBy(*GRID).agg(F.min(F.when(F.col("n") >= 3, F.col("row"))).alias("r"))
    return cells.select(*GRID).distinct().join(first, GRID, "left").select(*GRID, F.coalesce("r", F.lit(1)).alias("header_row"))


def resolve_column(cells: DataFrame, column: str, header_rows: int = 20) -> DataFrame:
    """(doc_id, sheet, col, header_row): by letters, by number, or by heading text (the exact one first, then the first that contains it)."""
    name = column.strip()
    if name.isascii() and (name.isalpha() and len(name) <= 3 or name.isdigit() and len(name) <= 3):
        n = int(name) if name.isdigit() else column_number(name)
        return cells.groupBy(*GRID).agg(F.max("col").alias("n")).where(F.col("n") >= (n if name.isdigit() else 0)).select(*GRID, F.lit(n).alias("col"), F.lit(None).cast("int").alias("header_row"))
    value = F.trim("value")
    near = cells.where((F.col("row") <= header_rows) & F.contains(F.lower(value), F.lit(name.lower())))
    best = F.min(F.struct(F.when(value == name, 0).otherwise(1).alias("far"), F.col("row"), F.col("col")))
    return near.groupBy(*GRID).agg(best.alias("b")).select(*GRID, "b.col", F.col("b.row").alias("header_row"))


def read_column(cells: DataFrame, column: str) -> DataFrame:
    """(doc_id, sheet, address, row, value): the filled cells of a column below its heading."""
    at = resolve_column(cells, column)
    rows = cells.join(at, [*GRID, "col"]).where((F.col("row") > F.coalesce("header_row", F.lit(0))) & (F.trim("value") != ""))
    return rows.select(*GRID, F.concat(column_letter(F.col("col")), F.col("row").cast("string")).alias("address"), "row", "value")


def table_overview(cells: DataFrame) -> DataFrame:
    """(doc_id, sheet, n_rows, n_cols, first_row)."""
    first = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("row") == 1, F.struct("col", "value")))), lambda x: x["value"]), " | ")
    return cells.groupBy(*GRID).agg(F.max("row").alias("n_rows"), F.max("col").alias("n_cols"), first.alias("first_row"))


def rows_to_markdown(cells: DataFrame) -> DataFrame:
    """(doc_id, sheet, markdown): the whole grid, its first row the heading, missing cells empty; of repeated cells the least value."""
    cells = cells.groupBy(*GRID, "row", "col").agg(F.min("value").alias("value"))
    width = Window.partitionBy(*GRID)
    rows = cells.withColumn("n_cols", F.max("col").over(width)).groupBy(*GRID, "row").agg(F.max("n_cols").alias("n_cols"), F.map_from_entries(F.collect_list(F.struct("col", F.coalesce("value", F.lit(""))))).alias("m"))
    line = F.concat(F.lit("| "), F.array_join(F.transform(F.sequence(F.lit(1), F.col("n_cols")), lambda k: F.coalesce(F.try_element_at("m", k), F.lit(""))), " | "), F.lit(" |"))
    rule = F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), F.max("n_cols")))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("row", line.alias("line")))), lambda x: x["line"])
    return rows.groupBy(*GRID).agg(F.array_join(F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, 2, 1 << 30)), "\n").alias("markdown"))


def replace_text(cells: DataFrame, old: str, new: str) -> DataFrame:
    """`cells` with a literal text replaced, and the number of places in `hits`."""
    hits = (F.length("value") - F.length(F.replace(F.col("value"), F.lit(old), F.lit("")))) / len(old)
    return cells.withColumn("hits", F.coalesce(hits, F.lit(0)).cast("int")).withColumn("value", F.replace(F.col("value"), F.lit(old), F.lit(new)))


def set_cells(cells: DataFrame, new: DataFrame) -> DataFrame:
    """Cells of `new` put in place; those that weren't there are added."""
    keys = [*GRID, "row", "col"]
    kept = cells.select(*keys, "value").join(new, keys, "left_anti")
    return kept.unionByName(new.select(*keys, "value"))


def add_rows(cells: DataFrame, new: DataFrame) -> DataFrame:
    """Rows (doc_id, sheet, k from 1, col, value) below the last row of each sheet."""
    last = cells.groupBy(*GRID).agg(F.max("row").alias("last"))
    rows = new.join(last, GRID).select(*GRID, (F.col("last") + F.col("k")).cast("int").alias("row"), "col", "value")
    return cells.select(*GRID, "row", "col", "value").unionByName(rows)


def add_column(cells: DataFrame, at: DataFrame, heading: str, value: Column) -> DataFrame:
    """A column before place `col` of `at` (doc_id, sheet, col, header_row); what was there moves right. `value`: by row."""
    moved = cells.select(*GRID, "row", "col", "value").join(at.select(*GRID, F.col("col").alias("at"), F.coalesce("header_row", F.lit(1)).alias("head")), GRID, "left")
    rows = moved.where("at is not null").select(*GRID, "row", "at", "head").distinct()
    new = rows.where("row >= head").select(*GRID, "row", F.col("at").alias("col"), F.when(F.col("row") == F.col("head"), F.lit(heading)).otherwise(value).alias("value"))
    return moved.select(*GRID, "row", F.when(F.col("col") >= F.col("at"), F.col("col") + 1).otherwise(F.col("col")).alias("col"), "value").unionByName(new)


def delete_column(cells: DataFrame, at: DataFrame) -> DataFrame:
    gone = cells.select(*GRID, "row", "col", "value").join(at.select(*GRID, F.col("col").alias("at")), GRID, "left").where("at is null or col <> at")
    return gone.select(*GRID, "row", F.when(F.col("col") > F.col("at"), F.col("col") - 1).otherwise(F.col("col")).alias("col"), "value")


def scrub_metadata(docs: DataFrame, blank: tuple[str, ...] = ("author", "modified_by", "comments", "subject", "keywords", "category"), drop: tuple[str, ...] = ("company", "manager", "links")) -> DataFrame:
    """Blanks or drops the metadata columns there are."""
    return docs.withColumns({c: F.lit("") for c in blank if c in docs.columns}).drop(*[c for c in drop if c in docs.columns])
