"""BonnXML files: nested pages, sides, columns and lines of tokens, each with its annotation.

The text is rebuilt line by line as a transcription and read like one; the annotation then meets the tokens of that text,
in order, within each document.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import UNSET, Corpus
from .trans import read_trans

#: Where a header's entries stand (element, attribute), and what they are called.
HEADER = [
    ("general/title", "val", "text"),
    ("general/abbreviation", "ab_ddd", "abbr_ddd"),
    ("general/abbreviation", "ab_mwb", "abbr_mwb"),
    ("general/text_field", "val", "topic"),
    ("general/text_type", "val", "text-type"),
    ("general/text_form", "val", "genre"),
    ("general/ref", "val", "reference"),
    ("general/sec_ref", "val", "reference-secondary"),
    ("document_medium/library", "val", "library"),
    ("document_medium/shelfmark", "val", "library-shelfmark"),
    ("document_medium/census", "val", "online"),
    ("entry/medium_type", "val", "medium"),
    ("entry/extent", "val", "extent"),
    ("entry/extract", "val", "extract"),
    ("entry/language", "val", "language"),
    ("entry/dialect_region", "val", "language-type"),
    ("entry/dialect_area", "val", "language-region"),
    ("entry/dialect", "val", "language-area"),
    ("entry/localization", "val", "place"),
    ("entry/dating", "val", "time"),
    ("entry/specific_features", "val", "notes-manuscript"),
    ("text/text_dating", "val", "date"),
    ("text/text_localization", "val", "text-place"),
    ("text/author", "val", "text-author"),
    ("text/textdialect", "val", "text-language"),
    ("text/foreign_language_dependence", "val", "text-source"),
    ("text/edition", "val", "edition"),
    ("corpusStmt/corpus", "val", "corpus"),
    ("corpusStmt/transcription_notes", "val", "notes-transcription"),
    ("corpusStmt/annotation_notes", "val", "notes-annotation"),
    ("respStmt/digitization", "val", "digitization_by"),
    ("respStmt/collation", "val", "collation_by"),
    ("respStmt/pre_editing", "val", "pre_editing_by"),
    ("respStmt/annotation", "val", "annotation_by"),
    ("respStmt/proofreading", "val", "proofreading_by"),
]
#: Tag, element, attribute, underscore to dot, and whether it is left out where it is missing.
TAGS = [
    ("norm", "form", "normu", False, False), ("lemma", "lemma", "inst", False, False), ("lemma_gen", "lemma", "gen", False, False),
    ("lemma_idmwb", "lemma", "idmwb", False, False), ("pos", "pos", "inst", False, True), ("pos_gen", "pos", "gen", False, True),
    ("infl", "infl", "val", True, False), ("inflClass", "inflClass", "inst", True, False), ("inflClass_gen", "inflClass", "gen", True, False),
    ("grapho", "grapho", "val", False, False), ("comment", "comment", "val", False, True), ("ref_second_folio", "ref_second", "folio2", False, True),
    ("ref_second_side", "ref_second", "side2", False, True), ("ref_second_line", "ref_second", "line2", False, True),
    ("ref_second_token", "ref_second", "token2", False, True),
]
#: A joiner with what closes round it and the bars after it.
_JOINER = re.compile(r"=[>)]*\|*")
_BOUND = re.compile(r"\|*[(<]*=[)>]*\|*|\|+")


def header_entries(root: ET.Element) -> dict[str, str]:
    """All entries, empty where the file has none."""
    found = [(name, root.find(f".//{path}"), attribute) for path, attribute, name in HEADER]
    return {name: e.get(attribute, "") if e is not None else "" for name, e, attribute in found}


def header_element(root: ET.Element) -> ET.Element:
    """The entries as an element with a child for each."""
    out = ET.Element("header")
    for name, value in header_entries(root).items():
        ET.SubElement(out, name).text = value
    return out


def header_xml(root: ET.Element) -> str:
    return ET.tostring(header_element(root), encoding="unicode")


def annotation(token: ET.Element) -> dict[str, str]:
    out = {}
    for tag, element, attribute, dots, optional in TAGS:
        e = token.find(element)
        value = e.get(attribute, "") if e is not None else ""
        value = value.replace("_", ".") if dots else value
        if value or not optional:
            out[tag] = value or UNSET
    return out


def structure(root: ET.Element) -> Iterator[tuple[str, str, str, int, list[ET.Element]]]:
    """(page, side, column, line in its parent, tokens): sides and columns may both be missing."""
    for page in root.iter("page"):
        for side in page.findall("side") or [page]:
            for column in side.findall("column") or [side]:
                for n, line in enumerate(column.findall("line"), 1):
                    name = "" if side is page else side.get("no", side.get("val", ""))
                    of = "" if column is side else column.get("no", column.get("val", ""))
                    yield page.get("no", page.get("val", "")), name, of, n, line.findall("token")


def preprocessed(lines: list[str]) -> list[str]:
    """The lines of a text in order, as many as before.

    Blanks round bars go. Where a bar ends a line inside a word, the line ends after the word instead (the last word of the
    text excepted). Doubled bars are one. What follows a joiner in a line's last word begins the next line.
    """
    text = re.sub(r" *\| *", "|", "\n".join(lines))
    text = re.sub(r"(?<![^ ])([^ ]*?)\|\n([^ ]*)(?= )", "\\1|\\2\n", text).replace("||", "|")
    rows = [line.split() for line in text.split("\n")]
    for row, after in zip(rows, rows[1:], strict=False):
        joiner = _JOINER.search(row[-1]) if row else None
        if joiner:
            row[-1], rest = row[-1][: joiner.end()], row[-1][joiner.end() :]
            after[:0] = [rest] if rest else []
    return [" ".join(row) for row in rows]


def scan_file(key: str, data: bytes) -> dict:
    """The text as a transcription, and the annotation of each token in order."""
    try:
        root = ET.fromstring(data)
    except ET.ParseError:
        return {"doc_key": key, "text": "", "annotations": []}
    sigle = root.get("sigle") or key
    places, lines, annotations = [], [], []
    for page, side, column, n, tokens in structure(root):
        forms = [(t.find("form").get("trans", "") if t.find("form") is not None else "") for t in tokens]
        places.append(f"{sigle}-{page}{side}{column},{n:02d}")
        lines.append(" ".join(f for f in forms if f))
        annotations += [{"trans": f, "tags": annotation(t)} for f, t in zip(forms, tokens, strict=True) if f]
    header = [f"sigle: {sigle}", *[f"{k}: {v}" for k, v in header_entries(root).items()]]
    rows = [f"{p}\t{x}" for p, x in zip(places, preprocessed(lines), strict=True)]
    return {"doc_key": key, "text": "\n".join(["+H", *header, "@H", *rows]), "annotations": annotations}


def bare(text: str) -> str:
    return _BOUND.sub("", text)


def aligned(annos: list[str], given: list[str]) -> list[int | None]:
    """For each anno the place of its annotation: equal texts meet; a text that holds several annos goes to each of them.

    Punctuation inside such a text has no annotation; an anno that nothing fits has none.
    """
    out: list[int | None] = [None] * len(annos)
    a = 0
    for g, text in enumerate(given):
        rest = bare(text)
        if a < len(annos) and bare(annos[a]) == rest:
            out[a] = g
            a += 1
            continue
        while a < len(annos) and (part := bare(annos[a])) and part in rest:
            rest = rest.replace(part, "", 1)
            if re.search(r"\w", annos[a]):
                out[a] = g
            a += 1
            if not rest:
                break
    return out


def read_bonnxml(files: DataFrame, of: str = "plain", strict: bool = True, legacy: bool = False) -> Corpus:
    """A corpus from ``files`` (doc_key, content). An anno without annotation is a diagnostic; the document is then not
    valid if ``strict``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([scan_file(k, bytes(c)) for k, c in zip(b["doc_key"], b["content"], strict=True)], columns=["doc_key", "text", "annotations"])

    scanned = files.select("doc_key", "content").mapInPandas(run, "doc_key string, text string, annotations array<struct<trans:string,tags:map<string,string>>>")
    corpus = read_trans(scanned.select("doc_key", "text"), of, strict, legacy)

    def meet(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left = left.sort_values("anno_ord")
        given = list(right["annotations"].iloc[0]) if len(right) else []
        found = aligned(left["trans"].tolist(), [g["trans"] for g in given])
        tags = [dict(given[i]["tags"]) if i is not None else None for i in found]
        return pd.DataFrame({"doc_key": key[0], "anno_ord": left["anno_ord"].to_numpy(), "new": pd.Series(tags, dtype=object)})

    small = corpus.annos.select("doc_key", "anno_ord", "trans").groupBy("doc_key")
    met = small.cogroup(scanned.select("doc_key", "annotations").groupBy("doc_key")).applyInPandas(meet, "doc_key string, anno_ord int, new map<string,string>")
    annos = corpus.annos.join(met, ["doc_key", "anno_ord"], "left").withColumn("tags", F.coalesce("new", "tags"))
    lost = annos.where(F.col("new").isNull() & F.col("trans").rlike(r"(?U)\w"))
    found = lost.select("doc_key", F.col("anno_ord").alias("item_ord"), F.lit("error").alias("severity"), F.lit("anno_without_annotation").alias("code"), F.col("trans").alias("detail"))
    bad = lost.select("doc_key").distinct().withColumn("_bad", F.lit(strict))
    documents = corpus.documents.join(bad, "doc_key", "left").withColumn("valid", F.col("valid") & ~F.coalesce("_bad", F.lit(False))).drop("_bad")
    return corpus.having(annos=annos.drop("new"), documents=documents, diagnostics=corpus.diagnostics.unionByName(found))
