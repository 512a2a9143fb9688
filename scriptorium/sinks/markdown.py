"""Markdown tables for pandoc: a row per line of the layout, comments as notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import Corpus, is_a, joined
from .common import KEY, full_side, placed_dipls

#: Fixed value: the rule below the table's head.
RULE = ":-----|:------------------------------------------------------------------"


def escaped(text: Column) -> Column:
    """Signs of Markdown's emphasis with a backslash before them."""
    return F.regexp_replace(text, r"([\\`*_])", r"\\$1")


def marked(c: Column) -> Column:
    """A character's string with marks for what brackets say; the marks are not escaped."""
    mask = c["mask"]
    return (
        F.when(is_a(mask, "ExpandedAbbreviation"), "*")
        .when(is_a(mask, "Para"), "**")
        .when(is_a(mask, "Strikethrough"), "~~")
        .when(is_a(mask, "Multiverbation", "Univerbation", "Continuation", "Whitespace"), "")
        .when(is_a(mask, "Recognizable"), F.when(c["opening"], "[").otherwise("]"))
        .when(is_a(mask, "IllegibleChar") | (is_a(mask, "TextChar") & (c["dipl_utf"] == "…")), "[…]")
        .when(is_a(mask, "Lacuna"), "^[Lücke]")
        .otherwise(escaped(c["string"]))
    )


def to_markdown(c: Corpus) -> DataFrame:
    """A comment goes to the row of the dipls before it, or to the first row."""
    rows = placed_dipls(c)
    items = c.tokens.select(KEY, "tok_ord", "item_ord")
    words = rows.join(items, [KEY, "tok_ord"]).select(
        KEY, "line_ord", "item_ord", F.col("dipl_in_tok").alias("k"), F.array_join(F.transform("chars", marked), "").alias("x")
    )
    notes = c.comments.select(
        KEY, F.lit(None).cast("int").alias("line_ord"), "item_ord", F.lit(0).alias("k"), F.concat(F.lit("^["), escaped(F.col("content")), F.lit("]")).alias("x")
    )
    w = Window.partitionBy(KEY).orderBy("item_ord", "k")
    line = F.coalesce(F.last("line_ord", ignorenulls=True).over(w), F.first("line_ord", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)))
    both = words.unionByName(notes).withColumn("line_ord", line)
    texts = both.groupBy(KEY, "line_ord").agg(joined(F.struct("item_ord", "k"), F.col("x"), " ").alias("x"))
    names = rows.select(KEY, "line_ord", "line_name", "page_name", "side", "col_name").distinct()
    column = F.when(F.coalesce("col_name", F.lit("--")) == "--", "").otherwise(F.col("col_name"))
    place = F.concat(full_side(), column, F.lit(","), "line_name")
    table = texts.join(names, [KEY, "line_ord"]).groupBy(KEY).agg(joined(F.col("line_ord"), F.concat(place, F.lit(" | "), "x"), "  \n").alias("table"))
    return c.documents.join(table, KEY, "left").select(
        KEY, F.concat_ws("  \n", F.concat(F.lit("% "), "name"), F.lit(""), F.lit("|"), F.lit(RULE), "table").alias("text")
    )
