"""Bounds between diplomatic and annotatable tokens, and the splits they make.

A flag on a character depends on the classes of up to two characters on either side, so bounds are built-in functions on
the array of a token's characters: no shuffle, no window, no Python. Islands between flags are then folded up in order.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import MASK, is_a

JOINS = ("UniverbSpace", "UniverbNewline", "Hyphen", "MultiverbNewline")


class Near:
    """What rules ask about a character's neighbours; ``w`` holds their masks and the like, fetched once by ``around``."""

    NAMES = {-2: "b2", -1: "b1", 0: "at", 1: "a1", 2: "a2"}

    def __init__(self, w: Column):
        self.w = w

    def is_a(self, by: int, *names: str) -> Column:
        return is_a(self.w[self.NAMES[by]], *names)

    def closing(self, by: int) -> Column:
        return self.w["closes" if by == 0 else "closed"]

    @property
    def unlike(self) -> Column:
        """Is the character before written otherwise?"""
        return self.w["unlike"]


def around(chars: Column) -> Column:
    """For each character the masks of the two on either side; white space stands before the first and after the last."""
    blank = F.lit(MASK["Whitespace"]).cast("long")

    def closing(c: Column) -> Column:
        return F.coalesce(is_a(c["mask"], "Bracket") & ~F.coalesce(c["opening"], F.lit(True)), F.lit(False))

    def made(c: Column, i: Column) -> Column:
        masks = [F.coalesce(F.get(chars, i + by)["mask"], blank).alias(name) for by, name in Near.NAMES.items()]
        before = F.get(chars, i - 1)
        return F.struct(*masks, closing(c).alias("closes"), closing(before).alias("closed"), F.coalesce(before["string"] != c["string"], F.lit(False)).alias("unlike"))

    return F.transform(chars, made)


def dipl_bound(near: Near) -> Column:
    """A joiner before, or a joiner and its closing bracket before."""
    return (near.is_a(-1, *JOINS) & ~near.closing(0)) | (near.is_a(-2, *JOINS) & near.closing(-1))


def anno_bound(near: Near) -> Column:
    """Word splits, punctuation at either end or unlike its neighbour, punctuation in brackets, and sentence marks."""
    blank = near.is_a(-2, "Whitespace") & ~near.is_a(-2, "LineBreak")
    punct = near.is_a(0, "Punct")
    split = near.is_a(-1, "MultiverbSpace", "MultiverbNewline")
    initial = blank & near.is_a(-1, "Punct") & ~punct
    final = (near.is_a(-1, "TextChar") | near.closing(-1)) & punct & ~near.is_a(1, "TextChar", "Joiner", "UniverbSpace")
    unlike = near.is_a(-1, "Punct") & punct & near.unlike
    linked = near.is_a(-1, "ParticleLink") & punct
    inside = near.is_a(0, "Bracket") & near.is_a(1, "Punct") & near.is_a(2, "Bracket")
    after_quote = near.is_a(-2, "Whitespace", "MultiverbSpace") & near.is_a(-1, "QuotationMark")
    opening_quote = near.is_a(-1, "Whitespace", "MultiverbSpace") & near.is_a(0, "QuotationMark")
    mark = near.is_a(0, "SentBound") & ~opening_quote & ~near.is_a(1, "MultiverbSpace", "MultiverbNewline")
    return split | initial | final | unlike | linked | inside | after_quote | mark


def bounded(chars: Column) -> Column:
    """The characters with dipl_bound, anno_bound and token_bound."""
    flags = F.transform(around(chars), lambda w: F.struct(dipl_bound(Near(w)).alias("dipl"), anno_bound(Near(w)).alias("anno")))
    last = F.size(chars) - 1
    pairs = F.arrays_zip(chars.alias("c"), flags.alias("f"))
    return F.transform(
        pairs,
        lambda p, i: p["c"]
        .withField("dipl_bound", p["f"]["dipl"])
        .withField("anno_bound", p["f"]["anno"])
        .withField("token_bound", (i == last) & ~p["f"]["dipl"] & ~p["f"]["anno"]),
    )


def carried(chars: Column) -> Column:
    """As ``bounded``, for dialects in which a bound waits for the next character that can bear it.

    After multiverbation an annotatable, after univerbation or white space a diplomatic bound is pending; it lands on the
    next character that is no closing bracket, white space, uni- or multiverbation.
    """
    state = F.struct(
        F.slice(F.transform(chars, lambda c: _flag(c, F.lit(False), F.lit(False))), 1, 0).alias("out"),
        F.lit(False).alias("dipl"), F.lit(False).alias("anno"),
    )

    def step(s: Column, c: Column) -> Column:
        closing = is_a(c["mask"], "Bracket") & ~F.coalesce(c["opening"], F.lit(True))
        bears = ~closing & ~is_a(c["mask"], "Whitespace", "Multiverbation", "Univerbation")
        made = _flag(c, bears & s["dipl"], bears & s["anno"])
        return F.struct(
            F.concat(s["out"], F.array(made)).alias("out"),
            (is_a(c["mask"], "Univerbation", "Whitespace") | (s["dipl"] & ~bears)).alias("dipl"),
            (is_a(c["mask"], "Multiverbation") | (s["anno"] & ~bears)).alias("anno"),
        )

    return F.aggregate(chars, state, step, lambda s: s["out"])


def _flag(c: Column, dipl: Column, anno: Column) -> Column:
    return c.withField("dipl_bound", dipl).withField("anno_bound", anno).withField("token_bound", F.lit(False))


def form(chars: Column, name: str) -> Column:
    """The characters' strings or forms as one text."""
    return F.array_join(F.transform(chars, lambda c: c[name]), "")


def trans(chars: Column) -> Column:
    """As transcribed, without white space."""
    return form(keep(chars, "Whitespace", drop=True), "string")


def keep(chars: Column, *names: str, drop: bool = False) -> Column:
    """Only characters of the classes, or only others."""
    return F.filter(chars, lambda c: is_a(c["mask"], *names) != F.lit(drop))


def mapped(chars: Column, change: Callable[[Column], Column], where: Callable[[Column], Column]) -> Column:
    """The characters with those changed of which ``where`` holds."""
    return F.transform(chars, lambda c: F.when(where(c), change(c)).otherwise(c))


def has(chars: Column, *names: str) -> Column:
    return F.exists(chars, lambda c: is_a(c["mask"], *names))


def starts(chars: Column, bound: str) -> Column:
    """Where pieces begin: at the first character and at each that has the bound; then the end."""
    at = F.filter(F.transform(chars, lambda c, i: F.when(c[bound] | (i == 0), i)), lambda i: i.isNotNull())
    return F.concat(at, F.array(F.size(chars)))


def cut(chars: Column, at: Column) -> Column:
    """Arrays of characters between the places ``at``; white space is left out, and so are empty pieces."""
    spans = F.zip_with(F.slice(at, 1, F.size(at) - 1), F.slice(at, 2, F.size(at) - 1), lambda s, e: F.struct(s.alias("s"), e.alias("e")))
    parts = F.transform(spans, lambda x: keep(F.slice(chars, x["s"] + 1, x["e"] - x["s"]), "Whitespace", drop=True))
    return F.filter(parts, lambda p: F.size(p) > 0)


def pieces(chars: Column, bound: str) -> Column:
    return cut(chars, starts(chars, bound))


def dipl_pieces(chars: Column) -> Column:
    return pieces(chars, "dipl_bound")


def anno_pieces(chars: Column) -> Column:
    """No pieces at all if nothing is left to annotate, as when the whole token is struck out."""
    made = pieces(chars, "anno_bound")
    return F.when(F.exists(chars, lambda c: c["anno_utf"] != ""), made).otherwise(F.slice(made, 1, 0))


def tokenised(df: DataFrame, chars: str = "chars", carry: bool = False) -> DataFrame:
    """``df`` with bounds on ``chars`` and the arrays ``dipls`` (trans, utf, breaks, chars) and ``annos`` (trans, utf,
    simple, chars); ``breaks`` counts the line breaks of the token before the piece."""
    c = F.col(chars)
    flagged = df.withColumn(chars, (carried if carry else bounded)(c))
    flagged = flagged.withColumn("_dipls", dipl_pieces(c)).withColumn("_annos", anno_pieces(c))
    breaks = lambda p: F.size(F.filter(c, lambda x: is_a(x["mask"], "LineBreak") & (x["pos"] < F.get(p, F.lit(0))["pos"])))
    dipls = F.transform(
        "_dipls",
        lambda p: F.struct(form(p, "string").alias("trans"), form(p, "dipl_utf").alias("utf"), breaks(p).alias("breaks"), p.alias("chars")),
    )
    annos = F.transform(
        "_annos",
        lambda p: F.struct(
            form(p, "string").alias("trans"), form(p, "anno_utf").alias("utf"), form(p, "anno_simple").alias("simple"), p.alias("chars")
        ),
    )
    return flagged.withColumn("dipls", dipls).withColumn("annos", annos).drop("_dipls", "_annos")


def whole(df: DataFrame, token: str = "trans") -> DataFrame:
    """``df`` with what parsing and ``tokenised`` make of tokens that are never split, as in the plain dialect: chars, errors,
    ``kept`` (the token without blanks and line ends) and its only pieces ``dipl`` and ``anno``, which are none if it is empty.

    In built-in functions that leave out what isn't asked for; nothing is joined. Rows without a token have nulls.
    """
    t = F.col(token)
    drop = lambda c, *signs: functools.reduce(lambda x, s: F.replace(x, F.lit(s), F.lit("")), signs, c)
    last = F.length(drop(t, " ", "\t")) - 1

    def char(c: Column, i: Column) -> Column:
        end = c == "\n"
        kind = lambda f: F.when(end, F.lit(f("LineBreak"))).otherwise(F.lit(f("TextChar")))
        no = F.lit(False)
        return F.struct(
            i.alias("pos"), kind(str).alias("cls"), kind(MASK.get).cast("long").alias("mask"), c.alias("string"), c.alias("dipl_utf"), c.alias("anno_utf"),
            c.alias("anno_simple"), F.lit(None).cast("boolean").alias("opening"), F.lit(None).cast("string").alias("size"),
            no.alias("dipl_bound"), no.alias("anno_bound"), (i == last).alias("token_bound"),
        )

    signs = F.filter(F.split(drop(t, " ", "\t"), ""), lambda c: c != "")
    lead = F.regexp_extract(t, "^[ \\t\\n]*", 0)
    breaks = F.when(F.substring(t, 1, 1).isin(" ", "\t", "\n"), F.length(lead) - F.length(drop(lead, "\n"))).otherwise(0)
    codes = F.when(F.contains(t, F.lit(" ")) | F.contains(t, F.lit("\t")), F.array(F.lit("blank_in_token"))).otherwise(F.array().cast("array<string>"))
    rows = df.withColumn("kept", drop(t, " ", "\t", "\n")).withColumn("chars", F.transform(signs, char)).withColumn("errors", F.when(t.isNotNull(), codes))
    piece = keep(F.col("chars"), "Whitespace", drop=True)
    dipl = F.struct(F.col("kept").alias("trans"), F.col("kept").alias("utf"), breaks.alias("breaks"), piece.alias("chars"))
    anno = F.struct(F.col("kept").alias("trans"), F.col("kept").alias("utf"), F.col("kept").alias("simple"), piece.alias("chars"))
    return rows.withColumn("dipl", dipl).withColumn("anno", anno)
