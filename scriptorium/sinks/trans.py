"""Transcription texts: the header, then a line of the mark, a tab and the tokens for each line of the layout."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import Corpus, joined
from ..operators import bounds
from .common import KEY, full_side, header_text

FORMS = {"trans": "string", "dipl_utf": "dipl_utf", "anno_utf": "anno_utf", "anno_simple": "anno_simple"}


def to_trans(c: Corpus, form: str = "trans") -> DataFrame:
    """Dipls of a line in order, blanks between tokens; comments, for ``trans`` only, on the line of the item before.

    For the annotatable forms a blank stands at each bound inside a token. Line ends come from the layout, so texts from
    any source break where their lines do.
    """
    if form not in FORMS:
        raise ValueError(f"unknown form: {form}")
    chars = F.filter("chars", lambda x: ~x["cls"].isin("Whitespace", "LineBreak"))
    if form.startswith("anno"):
        flagged = bounds.bounded(F.col("tok_chars"))
        cut = F.transform(F.filter(flagged, lambda x: x["anno_bound"]), lambda x: x["pos"])
        piece = F.array_join(F.transform(chars, lambda x, i: F.concat(F.when(F.array_contains(cut, x["pos"]) & (x["pos"] > 0), " ").otherwise(""), x[FORMS[form]])), "")
        dipls = c.dipls.join(c.tokens.select(KEY, "tok_ord", F.col("chars").alias("tok_chars")), [KEY, "tok_ord"])
    else:
        piece, dipls = F.array_join(F.transform(chars, lambda x: x[FORMS[form]]), ""), c.dipls
    items = c.tokens.select(KEY, "tok_ord", "item_ord")
    words = dipls.join(items, [KEY, "tok_ord"]).where("line_ord is not null").groupBy(KEY, "line_ord", "item_ord").agg(joined(F.col("dipl_in_tok"), piece).alias("x"))
    rows = words
    if form == "trans":
        # a comment stands on the line where the item before it ends; before all others on the first line
        last = dipls.join(items, [KEY, "tok_ord"]).groupBy(KEY, "item_ord").agg(F.max("line_ord").alias("line_ord"))
        said = F.concat(F.lit("+"), "type", F.lit(" "), "content", F.lit(" @"), "type")
        both = last.select(KEY, "item_ord", "line_ord", F.lit(None).cast("string").alias("x")).unionByName(
            c.comments.select(KEY, "item_ord", F.lit(None).cast("int").alias("line_ord"), said.alias("x"))
        )
        w = Window.partitionBy(KEY).orderBy("item_ord")
        ahead = w.rowsBetween(0, Window.unboundedFollowing)
        line = F.coalesce(F.last("line_ord", ignorenulls=True).over(w), F.first("line_ord", ignorenulls=True).over(ahead))
        rows = words.unionByName(both.withColumn("line_ord", line).where("x is not null").select(KEY, "line_ord", "item_ord", "x"))
    texts = rows.groupBy(KEY, "line_ord").agg(joined(F.col("item_ord"), F.col("x"), " ").alias("words"))
    columns = c.columns.select(KEY, "col_ord", "page_ord", F.col("name").alias("col_name"))
    pages = c.pages.select(KEY, "page_ord", F.col("name").alias("page_name"), "side")
    sigles = c.documents.select(KEY, "sigle")
    lines = c.lines.withColumnRenamed("name", "line_name").join(texts, [KEY, "line_ord"]).join(columns, [KEY, "col_ord"]).join(pages, [KEY, "page_ord"]).join(sigles, KEY)
    mark = F.concat("sigle", F.lit("-"), full_side(), F.coalesce("col_name", F.lit("")), F.lit(","), "line_name", F.lit("\t"))
    body = lines.groupBy(KEY).agg(joined(F.col("line_ord"), F.concat(mark, "words"), "\n").alias("body"))
    return header_text(c).join(body, KEY, "left").select(
        KEY, F.concat(F.lit("+H\n"), "head", F.lit("\n@H\n\n"), F.coalesce("body", F.lit("")), F.lit("\n")).alias("text")
    )


def editor_json(tokens: DataFrame, chars: str = "chars") -> DataFrame:
    """``tokens`` with ``json``: six parallel arrays of a token's diplomatic and annotatable parts, for an editor.

    A part's break is 1 if a line break comes right before the next part.
    """
    made = bounds.tokenised(tokens, chars)
    parts = F.col("dipls")
    breaks = F.transform(parts, lambda d, i: F.when(F.coalesce(F.get(parts, i + 1)["breaks"], d["breaks"]) > d["breaks"], 1).otherwise(0))
    get = lambda rows, name: F.transform(rows, lambda x: x[name])
    record = F.struct(
        get("dipls", "trans").alias("dipl_trans"), get("dipls", "utf").alias("dipl_utf"), breaks.alias("dipl_breaks"),
        get("annos", "trans").alias("mod_trans"), get("annos", "utf").alias("mod_utf"), get("annos", "simple").alias("mod_ascii"),
    )
    return made.withColumn("json", F.to_json(record)).select(*tokens.columns, "json")
