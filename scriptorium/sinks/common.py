"""What several sinks share: ranges of the layout, and text escapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import Corpus
from ..operators.layout import range_text

KEY = "doc_key"


def escaped(text: Column, attribute: bool = False) -> Column:
    out = F.replace(F.coalesce(text, F.lit("")), F.lit("&"), F.lit("&amp;"))
    for sign, name in (("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(sign), F.lit(name))
    if attribute:
        for sign, name in (('"', "&quot;"), ("\n", "&#10;"), ("\t", "&#9;")):
            out = F.replace(out, F.lit(sign), F.lit(name))
    return out


def attributes(**values: Column | str) -> Column:
    """`` name="value"`` for each that is not null."""
    parts = []
    for name, value in values.items():
        value = F.col(value) if isinstance(value, str) else value
        parts.append(F.when(value.isNotNull(), F.concat(F.lit(f' {name}="'), escaped(value, True), F.lit('"'))))
    return F.concat_ws("", *parts)


def placed_dipls(c: Corpus) -> DataFrame:
    """Dipls with their line, column and page, and flags for the first and last of each."""
    from pyspark.sql import Window

    lines = c.lines.select(KEY, "line_ord", "line_id", F.col("name").alias("line_name"), "col_ord")
    columns = c.columns.select(KEY, "col_ord", "col_id", F.col("name").alias("col_name"), "page_ord")
    pages = c.pages.select(KEY, "page_ord", "page_id", F.col("name").alias("page_name"), "side")
    rows = c.dipls.join(lines, [KEY, "line_ord"]).join(columns, [KEY, "col_ord"]).join(pages, [KEY, "page_ord"])
    for unit in ("line", "col", "page"):
        near = Window.partitionBy(KEY).orderBy("dipl_ord")
        at = F.col(f"{unit}_ord")
        rows = rows.withColumn(f"{unit}_begins", ~at.eqNullSafe(F.lag(at).over(near))).withColumn(f"{unit}_ends", ~at.eqNullSafe(F.lead(at).over(near)))
    return rows


def layout_ranges(c: Corpus) -> tuple[DataFrame, DataFrame, DataFrame]:
    """pages, columns and lines with ``range``; a line's range is of dipls, a column's of lines, a page's of columns."""
    of_lines = c.dipls.where("line_ord is not null").groupBy(KEY, "line_ord").agg(range_text(F.min_by("dipl_id", "dipl_ord"), F.max_by("dipl_id", "dipl_ord")).alias("range"))
    lines = c.lines.join(of_lines, [KEY, "line_ord"])
    of_columns = lines.groupBy(KEY, "col_ord").agg(range_text(F.min_by("line_id", "line_ord"), F.max_by("line_id", "line_ord")).alias("range"))
    columns = c.columns.join(of_columns, [KEY, "col_ord"])
    of_pages = columns.groupBy(KEY, "page_ord").agg(range_text(F.min_by("col_id", "col_ord"), F.max_by("col_id", "col_ord")).alias("range"))
    return c.pages.join(of_pages, [KEY, "page_ord"]), columns, lines


def header_text(c: Corpus) -> DataFrame:
    """documents with ``head``: the header as it was, or else its entries, a line each."""
    entries = F.array_join(F.transform(F.array_sort(F.map_entries("header")), lambda e: F.concat(e["key"], F.lit(":"), F.array_join(e["value"], ":"))), "\n")
    return c.documents.withColumn("head", F.coalesce(F.nullif("header_string", F.lit("")), entries, F.lit("")))


def full_side(name: str = "page_name", side: str = "side") -> Column:
    return F.concat_ws("", name, side)
