"""dual-token XML files: layout with ranges, tokens with diplomatic and annotatable parts, comments between them, shift marks.

A reader of rows groups children by their names and so loses the order of tokens and comments; so one pass over each
file's tree, in Arrow batches, makes one nested row per document. All checks and joins are DataFrame operators.
"""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dialects import dialect, parsed
from ..model import Corpus, shift_tag
from ..operators import bounds, headers, layout, validate
from ..session import checkpointed

_ELEMENT = "array<struct<ord:int,id:string,name:string,side:string,range:string>>"
SCAN = (
    "doc_key string, sigle string, name string, header_string string, header_xml map<string,string>,"
    f" pages {_ELEMENT}, columns {_ELEMENT}, lines {_ELEMENT}, shifts array<struct<ord:int,type:string,range:string>>,"
    " items array<struct<ord:int,kind:string,id:string,trans:string,type:string,content:string,dipls:array<struct<id:string,trans:string>>,"
    "annos:array<struct<id:string,trans:string,checked:boolean,tags:map<string,string>,flags:array<string>>>>>, problem string"
)


def _anno(e: ET.Element) -> dict:
    tags = {c.tag: c.get("tag", "") for c in e if c.tag != "cora-flag"}
    flags = sorted({c.get("name", "") for c in e if c.tag == "cora-flag"})
    return {"id": e.get("id"), "trans": e.get("trans", ""), "checked": e.get("checked") == "y", "tags": tags, "flags": flags}


def scan_file(key: str, data: bytes | str, dipl_tag: str, anno_tag: str) -> dict:
    """One nested row; a file that is no XML gives a row with ``problem``."""
    empty = {"doc_key": key, "sigle": "", "name": "", "header_string": "", "header_xml": {}, "pages": [], "columns": [], "lines": [], "shifts": [], "items": []}
    try:
        root = ET.fromstring(data)
    except ET.ParseError as e:
        return empty | {"problem": f"not_xml: {e}"}
    head, header = root.find("cora-header"), root.find("header")
    elements = {}
    for table, tag, name in (("pages", "page", "no"), ("columns", "column", "name"), ("lines", "line", "name")):
        elements[table] = [
            {"ord": i, "id": e.get("id"), "name": e.get(name), "side": e.get("side"), "range": e.get("range")}
            for i, e in enumerate(root.findall(f"layoutinfo/{tag}"), 1)
        ]
    items = []
    for e in root:
        base = {"ord": len(items) + 1, "kind": e.tag, "id": e.get("id"), "trans": None, "type": None, "content": None, "dipls": [], "annos": []}
        if e.tag == "token":
            dipls = [{"id": d.get("id"), "trans": d.get("trans", "")} for d in e.findall(dipl_tag)]
            items.append(base | {"trans": e.get("trans", ""), "dipls": dipls, "annos": [_anno(a) for a in e.findall(anno_tag)]})
        elif e.tag == "comment":
            items.append(base | {"type": e.get("type"), "content": e.text or ""})
    shifts = root.find("shifttags")
    return empty | elements | {
        "sigle": head.get("sigle", "") if head is not None else "", "name": head.get("name", "") if head is not None else "",
        "header_string": (header.text or "") if header is not None else "",
        "header_xml": {c.tag: c.text or "" for c in header} if header is not None else {},
        "shifts": [{"ord": i, "type": s.tag, "range": s.get("range")} for i, s in enumerate(shifts if shifts is not None else [], 1)],
        "items": items, "problem": None,
    }


def scan(files: DataFrame, dipl_tag: str = "dipl", anno_tag: str = "mod") -> DataFrame:
    """Nested rows for ``files`` (doc_key, content: binary or text)."""
    names = ["doc_key", "sigle", "name", "header_string", "header_xml", "pages", "columns", "lines", "shifts", "items", "problem"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [scan_file(k, bytes(c) if not isinstance(c, str) else c, dipl_tag, anno_tag) for k, c in zip(batch["doc_key"], batch["content"], strict=True)]
            yield pd.DataFrame(rows, columns=names)

    return files.select("doc_key", "content").mapInPandas(run, SCAN)


def read_dualxml(files: DataFrame, of: str = "plain", strict: bool = True, legacy: bool = False) -> Corpus:
    """A corpus from ``files`` (doc_key, content).

    A token is parsed as its diplomatic parts one after the other, with a line break where one of them ends a line. The
    given parts keep their ids; where the numbers of both kinds are the parsed ones, forms come from the parse of the whole
    token, else from each part alone, and the document is not valid if ``strict`` (unless the dialect is tokenised anew).
    """
    key, options = "doc_key", dialect(of).options
    docs = checkpointed(scan(files, options.get("dipl_tag", "dipl"), options.get("anno_tag", "mod")))
    element = lambda table: docs.select(key, F.explode(table).alias("e")).select(key, "e.*")
    items = element("items")
    ends = element("lines").select(key, layout.parse_range(F.col("range"))["last"].alias("end")).where("end is not null")
    ends = ends.groupBy(key).agg(F.collect_set("end").alias("ends"))
    tok_ord = F.row_number().over(Window.partitionBy(key).orderBy("ord")).cast("int")
    tokens = items.where("kind = 'token'").withColumn("tok_ord", tok_ord).join(ends, key, "left")
    blank = " " if options.get("spaced") else ""
    text = F.transform(
        "dipls", lambda d: F.concat(d["trans"], F.when(F.array_contains(F.coalesce("ends", F.array().cast("array<string>")), d["id"]), "\n").otherwise(blank))
    )
    tokens = tokens.withColumn("given", F.regexp_replace(F.array_join(text, ""), r"^\s+|\s+$", "")).drop("ends")
    tokens = tokens.withColumnsRenamed({"dipls": "xml_dipls", "annos": "xml_annos", "trans": "xml_trans"})
    split = lambda t: bounds.tokenised(t, carry=dialect(of).carried).withColumn("errors", validate.token_errors(legacy=legacy))
    made = parsed(tokens, of, "given", then=split).withColumnRenamed("xml_trans", "trans")
    made = made.withColumn("given_dipls", F.transform("xml_dipls", lambda d: d["trans"])).withColumn("given_annos", F.transform("xml_annos", lambda a: a["trans"]))
    made = checkpointed(validate.against_parse(made))  # all tables of tokens and their parts come from it
    words = made.select(key, F.col("ord").alias("item_ord"), "tok_ord", F.coalesce(F.nullif("id", F.lit("")), F.concat(F.lit("t"), "tok_ord")).alias("token_id"), "trans", "errors", "chars")

    # where either number differs, the whole token is taken as given, unless the dialect is tokenised anew
    same = (F.size("xml_dipls") == F.size("dipls")) & (F.size("xml_annos") == F.size("annos")) | F.lit(bool(options.get("retokenize")))

    def parts(xml: str, parse: str, fields: list[str]) -> DataFrame:
        rows = made.select(key, "tok_ord", same.alias("same"), F.col(parse).alias("p"), F.posexplode(xml).alias("k", "x"))
        alone = bounds.tokenised(parsed(rows.where("not same").select(F.col("x.trans").alias("trans")).distinct(), of), carry=dialect(of).carried)
        forms = alone.select(F.col("trans").alias("_t"), F.col("chars").alias("_c"))
        rows = rows.withColumn("piece", F.when(F.col("same"), F.get(F.col("p"), F.col("k"))["chars"]))
        rows = rows.join(forms, ~F.col("same") & (F.col("x.trans") == F.col("_t")), "left").withColumn("chars", F.coalesce("piece", "_c"))
        order = F.row_number().over(Window.partitionBy(key).orderBy("tok_ord", "k")).cast("int")
        return rows.select(key, "tok_ord", (F.col("k") + 1).alias("k"), order.alias("n"), *[F.col(f"x.{f}").alias(f) for f in fields], "chars")

    dipls = checkpointed(parts("xml_dipls", "dipls", ["id", "trans"])).withColumnsRenamed({"k": "dipl_in_tok", "n": "dipl_ord"})
    dipls = dipls.withColumn("dipl_id", F.coalesce(F.nullif("id", F.lit("")), F.concat(F.lit("d"), "dipl_ord"))).drop("id")
    dipls = dipls.withColumn("utf", bounds.form(bounds.keep(F.col("chars"), "Whitespace", drop=True), "dipl_utf"))
    annos = parts("xml_annos", "annos", ["id", "trans", "checked", "tags", "flags"]).withColumnsRenamed({"k": "anno_in_tok", "n": "anno_ord"})
    annos = annos.withColumn("anno_id", F.coalesce(F.nullif("id", F.lit("")), F.concat(F.lit("a"), "anno_ord"))).drop("id")
    bare = bounds.keep(F.col("chars"), "Whitespace", drop=True)
    annos = annos.withColumn("utf", bounds.form(bare, "anno_utf")).withColumn("simple", bounds.form(bare, "anno_simple"))

    def linked(table: str, members: DataFrame, name: str, order: str) -> tuple[DataFrame, DataFrame]:
        found = layout.resolved(element(table), members, key, name, order)
        w = Window.partitionBy(key).orderBy("first_ord", "ord")
        # of elements that begin at the same place the first one counts; layout_problems reports the others
        kept = found.where("first_ord is not null").withColumn("_same", F.row_number().over(Window.partitionBy(key, "first_ord").orderBy("ord")))
        kept = kept.where("_same = 1").drop("_same").withColumn("n", F.row_number().over(w).cast("int"))
        return found.withColumn("kind", F.lit(table)), kept

    found_l, line_rows = linked("lines", dipls, "dipl_id", "dipl_ord")
    dipls = layout.tiled(dipls, line_rows.withColumnRenamed("n", "line_ord"), key, "dipl_ord", "line_ord")
    found_c, col_rows = linked("columns", line_rows.select(key, "id", "n"), "id", "n")
    found_p, page_rows = linked("pages", col_rows.select(key, "id", "n"), "id", "n")
    lines = line_rows.select(key, F.col("n").alias("line_ord"), F.col("id").alias("line_id"), "name")
    lines = layout.tiled(lines, col_rows.withColumnRenamed("n", "col_ord"), key, "line_ord", "col_ord")
    columns = col_rows.select(key, F.col("n").alias("col_ord"), F.col("id").alias("col_id"), "name")
    columns = layout.tiled(columns, page_rows.withColumnRenamed("n", "page_ord"), key, "col_ord", "page_ord")
    pages = page_rows.select(key, F.col("n").alias("page_ord"), F.col("id").alias("page_id"), "name", "side")
    shifts = layout.resolved(element("shifts"), words, key, "token_id", "tok_ord")
    tags = shifts.where("first_ord is not null and last_ord is not null").select(
        key, F.col("ord").alias("tag_ord"), "type", shift_tag(F.col("type")).alias("tag"), F.col("first_ord").alias("first_tok_ord"), F.col("last_ord").alias("last_tok_ord")
    )
    comments = items.where("kind = 'comment'").select(key, F.col("ord").alias("item_ord"), "type", "content")
    problem = lambda df, order, severity, code, detail: df.select(
        key, F.col(order).cast("int").alias("item_ord"), F.lit(severity).alias("severity"), code.alias("code"), detail.alias("detail")
    )
    found = problem(words.withColumn("e", F.explode("errors")), "item_ord", "error", F.col("e"), F.col("trans"))
    for rows in (found_l, found_c, found_p):
        found = found.unionByName(layout.layout_problems(rows, key))
    found = found.unionByName(problem(dipls.where("line_ord is null"), "dipl_ord", "warning", F.lit("dipl_without_line"), F.col("dipl_id")))
    found = found.unionByName(problem(shifts.where("first_ord is null or last_ord is null"), "ord", "warning", F.lit("shift_tag_without_token"), F.col("range")))
    found = found.unionByName(problem(docs.where("problem is not null").withColumn("o", F.lit(None).cast("int")), "o", "error", F.lit("not_xml"), F.col("problem")))
    fatal = F.exists("errors", lambda e: e.isin([] if options.get("retokenize") else ["err_nr_dipl", "err_nr_anno"]))
    bad = words.where(fatal & F.lit(strict)).select(key).unionByName(docs.where("problem is not null").select(key)).distinct().withColumn("bad", F.lit(True))
    structured = F.transform_values("header_xml", lambda k, v: F.array(v))
    documents = docs.join(bad, key, "left").select(
        key, "sigle", "name", F.when(F.size("header_xml") > 0, structured).otherwise(headers.parse_header(F.col("header_string"))).alias("header"),
        "header_string", F.col("bad").isNull().alias("valid"),
    )
    return Corpus(documents, pages, columns, lines, words, dipls, annos, comments, tags, found)
