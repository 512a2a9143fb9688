"""Characters by a table of single signs, in built-in functions: for texts without the dialects' longer signs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import MASK
from .replacements import ACCENTED, PLAIN

#: What single signs are; all others are text.
SIGNS = {**dict.fromkeys(".;!?:,/", "Punct"), "=": "Hyphen", "#": "UniverbSpace", "|": "MultiverbSpace", "\n": "LineBreak", " ": "Whitespace"}


_ORDER = "".join(SIGNS)


def _looked_up(place: Column, values: list) -> Column:
    """The value for the sign at ``place`` of SIGNS, counted from 1; the first value for 0, which is any other sign."""
    return F.get(F.array(*map(F.lit, values)), place)


def _place(char: Column) -> Column:
    return F.instr(F.lit(_ORDER), char)


def sign_class(char: Column) -> Column:
    return _looked_up(_place(char), ["TextChar", *SIGNS.values()])


def simple(text: Column) -> Column:
    """Accents and ligatures taken off, long s as s."""
    out = F.translate(text, ACCENTED + "ſ", PLAIN + "s")
    return F.replace(F.replace(out, F.lit("æ"), F.lit("ae")), F.lit("Æ"), F.lit("Ae"))


def signs(token: Column) -> Column:
    """The characters of a token as an array of structs, like the parsers'; one lookup for each code point."""
    kinds = ["TextChar", *SIGNS.values()]
    shown = [k not in ("UniverbSpace", "MultiverbSpace") for k in kinds]
    noted = [s and k != "Hyphen" for s, k in zip(shown, kinds, strict=True)]

    def made(x: Column, i: Column) -> Column:
        c, at = x["c"], x["at"]
        return F.struct(
            i.cast("int").alias("pos"), _looked_up(at, kinds).alias("cls"), _looked_up(at, [MASK[k] for k in kinds]).cast("long").alias("mask"),
            c.alias("string"), F.when(_looked_up(at, shown), c).otherwise("").alias("dipl_utf"),
            F.when(_looked_up(at, noted), c).otherwise("").alias("anno_utf"), F.when(_looked_up(at, noted), simple(c)).otherwise("").alias("anno_simple"),
            F.lit(None).cast("boolean").alias("opening"), F.lit(None).cast("string").alias("size"),
        )

    found = F.transform(F.filter(F.split(token, ""), lambda c: c != ""), lambda c: F.struct(c.alias("c"), _place(c).alias("at")))
    return F.transform(found, made)
