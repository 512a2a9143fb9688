"""Sinks by format; each makes one text per document: (doc_key, text)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import Corpus
from .dualxml import to_dualxml
from .gate import to_gate_json
from .markdown import to_markdown
from .tei import to_tei
from .trans import to_trans

#: Names of formats; what writes them, and the ending of their files.
FORMATS = {"coraxml": (to_dualxml, "xml"), "trans": (to_trans, "txt"), "gatejson": (to_gate_json, "json"), "tei": (to_tei, "xml"), "markdown": (to_markdown, "md")}


def exported(corpus: Corpus, format: str = "coraxml", **options) -> DataFrame:
    """(doc_key, text) for the valid documents; ValueError for an unknown format."""
    if format not in FORMATS:
        raise ValueError(f"unknown format: {format}")
    return FORMATS[format][0](corpus.valid(), **options)


def write_corpus(corpus: Corpus, path: str, format: str = "coraxml", **options) -> None:
    """Writes the valid documents below ``path``, each in a folder of its own named by its key."""
    rows = exported(corpus, format, **options).select("text", F.col("doc_key").alias("document"))
    rows.repartition("document").write.partitionBy("document").option("lineSep", "\n").text(path)
