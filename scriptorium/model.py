"""Data model: the lattice of character classes, schemas of the corpus tables, fixed names."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, fields, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: An annotation that is not set.
UNSET = "--"

#: Each class of characters and what it is a kind of.
CLASSES: dict[str, list[str]] = {
    "Whitespace": [],
    "LineBreak": ["Whitespace"],
    "Char": [],
    "Joiner": [],
    "TextChar": ["Char"],
    "Majuscule": ["TextChar"],
    "IllegibleChar": ["TextChar"],
    "Hyphen": ["TextChar", "Joiner"],
    "Punct": ["Char"],
    "MetaChar": ["Char"],
    "ForeignMarker": ["MetaChar"],
    "ParticleLink": ["MetaChar"],
    "SentBound": ["MetaChar"],
    "QuotationMark": ["SentBound"],
    "TokenBound": ["MetaChar"],
    "Univerbation": ["TokenBound"],
    "UniverbSpace": ["Univerbation"],
    "UniverbNewline": ["Univerbation", "Joiner"],
    "Multiverbation": ["TokenBound"],
    "MultiverbSpace": ["Multiverbation"],
    "MultiverbNewline": ["Multiverbation", "Joiner"],
    "Bracket": ["MetaChar"],
    "Parenthesis": ["Bracket"],
    "Strikethrough": ["Bracket"],
    "Recognizable": ["Bracket"],
    "FromEdition": ["Bracket"],
    "EditorCompleted": ["Bracket"],
    "ExpandedAbbreviation": ["Bracket"],
    "Continuation": ["Bracket"],
    "Para": ["Bracket"],
    "Addition": ["Para"],
    "Correction": ["Para"],
    "Note": ["Para"],
    "Lacuna": ["MetaChar"],
    "Comment": ["MetaChar"],
}
BIT = {name: 1 << i for i, name in enumerate(CLASSES)}


def mask_of(name: str) -> int:
    """Bits of the class and of all it is a kind of."""
    out = BIT[name]
    for parent in CLASSES[name]:
        out |= mask_of(parent)
    return out


MASK = {name: mask_of(name) for name in CLASSES}


def is_a(mask: Column, *names: str) -> Column:
    """Is a character with this mask of one of the classes, or a kind of it?"""
    bits = 0
    for name in names:
        bits |= BIT[name]
    return mask.bitwiseAND(F.lit(bits)) != 0


CHAR = (
    "struct<pos:int,cls:string,mask:long,string:string,dipl_utf:string,anno_utf:string,anno_simple:string,"
    "opening:boolean,size:string>"
)
#: Stretches of a token inside a pair of brackets, end exclusive.
SUBTOKEN = "struct<type:string,start:int,end:int>"
#: The tags of shift marks; other marks are their own tag.
SHIFT_TAGS = {"F": "fm", "L": "lat", "R": "rub", "Ü": "title", "M": "marg", "Q": "question"}


def shift_tag(kind: Column) -> Column:
    out = kind
    for code, tag in SHIFT_TAGS.items():
        out = F.when(kind == code, F.lit(tag)).otherwise(out)
    return out


#: Columns of the tables of a corpus; every order is a column of its own.
TABLES = {
    "documents": "doc_key string, sigle string, name string, header map<string,array<string>>, header_string string, valid boolean",
    "pages": "doc_key string, page_ord int, page_id string, name string, side string",
    "columns": "doc_key string, col_ord int, col_id string, page_ord int, name string",
    "lines": "doc_key string, line_ord int, line_id string, col_ord int, name string",
    "tokens": f"doc_key string, item_ord int, tok_ord int, token_id string, trans string, errors array<string>, chars array<{CHAR}>",
    "dipls": "doc_key string, tok_ord int, dipl_in_tok int, dipl_ord int, dipl_id string, trans string, utf string, line_ord int",
    "annos": (
        "doc_key string, tok_ord int, anno_in_tok int, anno_ord int, anno_id string, trans string, utf string, simple string,"
        " tags map<string,string>, flags array<string>, checked boolean"
    ),
    "comments": "doc_key string, item_ord int, type string, content string",
    "shift_tags": "doc_key string, tag_ord int, type string, tag string, first_tok_ord int, last_tok_ord int",
    "anno_spans": "doc_key string, span_ord int, first_anno_ord int, last_anno_ord int, tags map<string,string>, flags array<string>",
    "diagnostics": "doc_key string, item_ord int, severity string, code string, detail string",
}


@dataclass(frozen=True)
class Corpus:
    """Tables of many documents; see TABLES. Spans of annotations have a schema, but no source makes any."""

    documents: DataFrame
    pages: DataFrame
    columns: DataFrame
    lines: DataFrame
    tokens: DataFrame
    dipls: DataFrame
    annos: DataFrame
    comments: DataFrame
    shift_tags: DataFrame
    diagnostics: DataFrame

    def having(self, **tables: DataFrame) -> Corpus:
        return replace(self, **tables)

    def only(self, keys: DataFrame) -> Corpus:
        """The documents whose doc_key is in ``keys``."""
        return Corpus(**{f.name: getattr(self, f.name).join(keys.select("doc_key").distinct(), "doc_key", "left_semi") for f in fields(self)})

    def valid(self) -> Corpus:
        """Without rejected documents."""
        return self.only(self.documents.where("valid"))

    def stored(self, path: str) -> Corpus:
        """The same tables, written as Parquet below ``path`` and read again.

        What is read from texts has long plans; sinks and further steps plan from the files instead. Tables are dealt by
        doc_key, so that a document's rows are close together.
        """
        out = {}
        for f in fields(self):
            getattr(self, f.name).write.mode("overwrite").parquet(f"{path}/{f.name}")
            out[f.name] = self.documents.sparkSession.read.parquet(f"{path}/{f.name}")
        return Corpus(**out)

    def views(self) -> None:
        """Registers the tables as temporary views for SQL."""
        for f in fields(self):
            getattr(self, f.name).createOrReplaceTempView(f.name)


def held(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is worked out once: what stands inside a lambda is worked out for each element."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def joined(order: Column, text: Column, sep: str = "") -> Column:
    """Aggregate: the texts in order, joined by ``sep``."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), text.alias("t")))), lambda x: x["t"]), sep)
