"""Stand-off JSON: the diplomatic text, and entities as ranges of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import Corpus
from ..operators import bounds
from .common import KEY, placed_dipls


def spans(c: Corpus) -> DataFrame:
    """Placed dipls with ``start`` and ``end`` in the text: a blank between dipls, a newline before a line's first one.

    The first dipl has nothing before it. Offsets are running sums of lengths in code points.
    """
    w = Window.partitionBy(KEY).orderBy("dipl_ord")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("utf") + 1).over(before), F.lit(0)).cast("long")
    rows = placed_dipls(c).withColumn("start", start).withColumn("end", start + F.length("utf"))
    return rows.withColumn("gap", F.when(F.row_number().over(w) == 1, "").when(F.col("line_begins"), "\n").otherwise(" "))


def _json(**parts: Column) -> Column:
    return F.to_json(F.struct(*[v.alias(k) for k, v in parts.items()]))


def to_gate_json(c: Corpus) -> DataFrame:
    rows = spans(c)
    ends = lambda: F.array(F.min("start"), F.max("end"))
    entity = lambda df, kind, order, json: df.select(KEY, F.lit(kind).alias("kind") if isinstance(kind, str) else kind.alias("kind"), F.col(order).cast("long").alias("o"), json.alias("j"))  # noqa: E731, E501
    col = F.col
    found = []
    by = rows.groupBy(KEY, "page_ord", "page_id", "page_name", "side").agg(ends().alias("r"))
    found.append(entity(by, "Layout:Page", "page_ord", _json(indices=col("r"), id=col("page_id"), name=col("page_name"), side=col("side"))))
    by = rows.groupBy(KEY, "col_ord", "col_id", "col_name").agg(ends().alias("r"))
    found.append(entity(by, "Layout:Column", "col_ord", _json(indices=col("r"), id=col("col_id"), name=col("col_name"))))
    by = rows.groupBy(KEY, "line_ord", "line_id", "line_name").agg(ends().alias("r"))
    found.append(entity(by, "Layout:Line", "line_ord", _json(indices=col("r"), id=col("line_id"), name=col("line_name"))))
    found.append(entity(rows, "Token:Dipl", "dipl_ord", _json(indices=F.array("start", "end"), trans=col("trans"), utf=col("utf"), id=col("dipl_id"))))
    by = rows.groupBy(KEY, "tok_ord").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    words = c.tokens.select(KEY, "tok_ord", "item_ord", "token_id", "trans", "chars").join(by, [KEY, "tok_ord"])
    found.append(entity(words, "Token:Cora", "tok_ord", _json(indices=F.array("start", "end"), id=col("token_id"), trans=col("trans"))))
    # an anno begins where its first character stands in the dipl that holds it
    dipls = rows.select(KEY, "tok_ord", "start", F.posexplode(bounds.keep(col("chars"), "Whitespace", drop=True)).alias("i", "c"))
    at = Window.partitionBy(KEY, "tok_ord", "start").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    chars = dipls.withColumn("s", col("start") + F.coalesce(F.sum(F.length("c.dipl_utf")).over(at), F.lit(0)))
    chars = chars.select(KEY, "tok_ord", col("c.pos").alias("pos"), "s", (col("s") + F.length("c.dipl_utf")).alias("e"))
    annos = c.annos.withColumn("bare", bounds.keep(col("chars"), "Whitespace", drop=True))
    parts = annos.select(KEY, "tok_ord", "anno_ord", F.explode(F.transform("bare", lambda x: x["pos"])).alias("pos"))
    where = parts.join(chars, [KEY, "tok_ord", "pos"]).groupBy(KEY, "anno_ord").agg(F.array(F.min("s"), F.max("e")).alias("r"))
    fixed = F.map_from_arrays(F.array(*map(F.lit, ("trans", "utf", "simple", "id"))), F.array("trans", "utf", "simple", "anno_id"))
    tags = F.map_filter(F.coalesce("tags", F.expr("cast(map() as map<string,string>)")), lambda k, v: ~k.isin("trans", "utf", "simple", "id"))
    said = F.to_json(F.map_concat(fixed, tags))
    more = F.to_json(F.struct(F.col("r").alias("indices"), "checked", "flags"))
    both = F.concat(F.expr("substring(m, 1, length(m) - 1)"), F.lit(","), F.expr("substring(t, 2)"))
    annos = annos.join(where, [KEY, "anno_ord"]).withColumn("m", more).withColumn("t", said)
    found.append(entity(annos, "Token:Anno", "anno_ord", both))
    # a comment stands at the end of the item before it
    items = words.select(KEY, "item_ord", "end").unionByName(c.comments.select(KEY, "item_ord", F.lit(None).cast("long").alias("end")))
    up_to = Window.partitionBy(KEY).orderBy("item_ord")
    items = items.withColumn("at", F.coalesce(F.last("end", ignorenulls=True).over(up_to), F.lit(0).cast("long"))).select(KEY, "item_ord", "at")
    comments = c.comments.join(items, [KEY, "item_ord"])
    found.append(entity(comments, "Token:Comment", "item_ord", _json(indices=F.array("at", "at"), type=col("type"), content=col("content"))))
    ends_of = words.select(col(KEY).alias("_k"), col("tok_ord").alias("_t"), "start", "end")
    on = (col(KEY) == col("_k")) & col("_t").between(col("first_tok_ord"), col("last_tok_ord"))
    shifts = c.shift_tags.join(ends_of, on).groupBy(KEY, "tag_ord", "type", "tag").agg(ends().alias("r"))
    found.append(entity(shifts, F.concat(F.lit("Shifttags:"), "tag"), "tag_ord", _json(indices=col("r"), type=col("type"))))
    whole = found[0]
    for more_rows in found[1:]:
        whole = whole.unionByName(more_rows)
    lists = whole.groupBy(KEY, "kind").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "j"))), lambda x: x["j"]), ",").alias("list"))
    entities = lists.groupBy(KEY).agg(F.array_sort(F.collect_list(F.struct("kind", "list"))).alias("ks"))
    body = F.array_join(F.transform("ks", lambda k: F.concat(F.lit('"'), k["kind"], F.lit('":['), k["list"], F.lit("]"))), ",")
    text = rows.groupBy(KEY).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("dipl_ord", "gap", "utf"))), lambda x: F.concat(x["gap"], x["utf"])), "").alias("plain"))
    docs = c.documents.join(text, KEY, "left").join(entities.select(KEY, body.alias("body")), KEY, "left")
    front = F.to_json(F.struct(F.coalesce("plain", F.lit("")).alias("text"), "sigle", "name", "header"))
    whole_text = F.concat(F.expr("substring(f, 1, length(f) - 1)"), F.lit(',"entities":{'), F.coalesce("body", F.lit("")), F.lit("}}"))
    return docs.withColumn("f", front).select(KEY, whole_text.alias("text"))
