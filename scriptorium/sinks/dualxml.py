"""dual-token XML: one text per document, put together from the texts of its elements in order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import Corpus, joined
from ..operators.layout import range_text
from .common import KEY, attributes, escaped, header_text, layout_ranges


def to_dualxml(c: Corpus, dipl_tag: str = "dipl", anno_tag: str = "mod", simple: str = "ascii") -> DataFrame:
    pages, columns, lines = layout_ranges(c)
    page_xml = pages.select(
        KEY, F.struct("page_ord", F.lit(0).alias("b"), F.lit(0).alias("c")).alias("o"),
        F.concat(F.lit("<page"), attributes(id="page_id", no="name", range="range", side=F.nullif("side", F.lit(""))), F.lit("/>")).alias("x"),
    )
    column_xml = columns.select(
        KEY, F.struct("page_ord", F.col("col_ord").alias("b"), F.lit(0).alias("c")).alias("o"),
        F.concat(F.lit("<column"), attributes(id="col_id", range="range", name=F.nullif("name", F.lit(""))), F.lit("/>")).alias("x"),
    )
    up = columns.select(KEY, "col_ord", "page_ord")
    line_xml = lines.join(up, [KEY, "col_ord"]).select(
        KEY, F.struct("page_ord", F.col("col_ord").alias("b"), F.col("line_ord").alias("c")).alias("o"),
        F.concat(F.lit("<line"), attributes(id="line_id", name="name", range="range"), F.lit("/>")).alias("x"),
    )
    layout = page_xml.unionByName(column_xml).unionByName(line_xml).groupBy(KEY).agg(joined(F.col("o"), F.col("x")).alias("layout"))
    ids = c.tokens.select(F.col(KEY).alias("_k"), F.col("tok_ord").alias("_o"), F.col("token_id").alias("_id"))
    tags = c.shift_tags
    for part in ("first", "last"):
        tags = tags.join(ids.withColumnRenamed("_id", part), (F.col(KEY) == F.col("_k")) & (F.col(f"{part}_tok_ord") == F.col("_o"))).drop("_k", "_o")
    tag_xml = F.concat(F.lit("<"), "tag", attributes(range=range_text(F.col("first"), F.col("last"))), F.lit("/>"))
    shifts = tags.groupBy(KEY).agg(joined(F.col("tag_ord"), tag_xml).alias("shifts"))
    dipl_xml = F.concat(F.lit(f"<{dipl_tag}"), attributes(id="dipl_id", trans="trans", utf="utf"), F.lit("/>"))
    dipls = c.dipls.groupBy(KEY, "tok_ord").agg(joined(F.col("dipl_in_tok"), dipl_xml).alias("dx"))
    entries = F.array_sort(F.map_entries(F.coalesce("tags", F.expr("cast(map() as map<string,string>)"))))
    child = F.array_join(F.transform(entries, lambda e: F.concat(F.lit("<"), e["key"], F.lit(' tag="'), escaped(e["value"], True), F.lit('"/>'))), "")
    flags = F.array_join(F.transform(F.array_sort("flags"), lambda f: F.concat(F.lit('<cora-flag name="'), escaped(f, True), F.lit('"/>'))), "")
    anno_xml = F.concat(
        F.lit(f"<{anno_tag}"), attributes(**{"id": "anno_id", "trans": "trans", "utf": "utf", simple: F.col("simple"), "checked": F.when(F.col("checked"), F.lit("y"))}),
        F.lit(">"), child, flags, F.lit(f"</{anno_tag}>"),
    )
    annos = c.annos.groupBy(KEY, "tok_ord").agg(joined(F.col("anno_in_tok"), anno_xml).alias("ax"))
    token_xml = F.concat(
        F.lit("<token"), attributes(id="token_id", trans="trans"), F.lit(">"), F.coalesce("dx", F.lit("")), F.coalesce("ax", F.lit("")), F.lit("</token>\n")
    )
    tokens = c.tokens.join(dipls, [KEY, "tok_ord"], "left").join(annos, [KEY, "tok_ord"], "left").select(KEY, "item_ord", token_xml.alias("x"))
    comment = F.concat(F.lit("<comment"), attributes(type="type"), F.lit(">"), escaped(F.col("content")), F.lit("</comment>\n"))
    items = tokens.unionByName(c.comments.select(KEY, "item_ord", comment.alias("x"))).groupBy(KEY).agg(joined(F.col("item_ord"), F.col("x")).alias("items"))
    rows = header_text(c).join(layout, KEY, "left").join(shifts, KEY, "left").join(items, KEY, "left")
    none = F.lit("")
    text = F.concat(
        F.lit("<text"), attributes(id="sigle"), F.lit(">\n<cora-header"), attributes(sigle="sigle", name="name"), F.lit("/>\n<header>"),
        escaped(F.col("head")), F.lit("</header>\n<layoutinfo>"), F.coalesce("layout", none), F.lit("</layoutinfo>\n<shifttags>"),
        F.coalesce("shifts", none), F.lit("</shifttags>\n"), F.coalesce("items", none), F.lit("</text>\n"),
    )
    return rows.select(KEY, text.alias("text"))
