"""Word documents: italics are headers, highlighted text is quotation, place marks in brackets begin lines."""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_PLACE = re.compile(r"\[(\d*)([rv]?)([a-q]?),(\d+)\]")


def _runs(data: bytes) -> Iterator[tuple[str, bool, bool]]:
    """(text, italic, highlighted) of each run; a paragraph ends with a newline."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = ET.fromstring(z.read("word/document.xml"))
    for p in root.iter(f"{_W}p"):
        for r in p.iter(f"{_W}r"):
            style = r.find(f"{_W}rPr")
            has = lambda name, style=style: style is not None and style.find(f"{_W}{name}") is not None
            text = "".join(t.text or "" if t.tag == f"{_W}t" else "\t" if t.tag == f"{_W}tab" else "" for t in r)
            yield text, has("i"), has("highlight")
        yield "\n", False, False


def docx_text(data: bytes, sigle: str) -> str:
    """The text of a document as a transcription file."""
    header, body = [], []
    marked = False
    for text, italic, highlighted in _runs(data):
        if italic:
            header.append(text)
            continue
        if text.strip() and highlighted != marked:
            body.append("+Q " if highlighted else " @Q")
            marked = highlighted
        body.append(text)
    if marked:
        body.append(" @Q")
    page, side, col, line, out = "", "", "", 0, []
    for raw in "".join(body).split("\n"):
        if not raw.strip():
            continue
        if m := _PLACE.match(raw.strip()):
            page, side, col, line = m[1] or page, m[2] or side, m[3], int(m[4])
            raw = raw.strip()[m.end() :]
        else:
            line += 1
        out.append(f"{sigle}-{page}{side}{col},{line:02d}\t{raw.strip()}")
    return "+H\n" + "".join(header).strip() + "\n@H\n" + "\n".join(out) + "\n"


def docx_texts(files: DataFrame) -> DataFrame:
    """(doc_key, text) for ``files`` (doc_key, content)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_key": b["doc_key"], "text": [docx_text(bytes(c), k) for k, c in zip(b["doc_key"], b["content"], strict=True)]})

    return files.select("doc_key", "content").mapInPandas(run, "doc_key string, text string")
