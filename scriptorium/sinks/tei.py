"""TEI: words in their layout, with brackets as elements.

Every token becomes a short line of events (a word begins or ends, a bracket opens or closes, a milestone, text) by
built-in functions on its characters. Brackets and words may overlap: a bracket that is open where a word ends is closed
there and opened again in the next word. That takes a stack over the whole document, so the events of a document are
written out by one fold, in one pass.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import UNSET, Corpus, is_a
from ..operators import bounds
from .common import KEY, attributes, escaped, full_side, placed_dipls

#: Elements of brackets, and places of additions and notes by the sign after the asterisk or after ``\\F``.
ELEMENTS = {
    "Addition": "add", "Correction": "add", "Continuation": "add", "Note": "note", "Recognizable": "unclear",
    "ExpandedAbbreviation": "expan", "Strikethrough": "del",
}
PLACES = {"U": "bottom", "O": "top", "T": "inline", "L": "margin left", "R": "margin right", "I": "interlinear"}
BESIDE = {"U": "below", "O": "above"}
#: Kinds of events.
WORD, END, OPEN, CLOSE, SENTENCE, PLAIN = "word", "end", "open", "close", "sentence", "plain"


def _coded(codes: dict[str, str], code: Column) -> Column:
    out = F.lit(None).cast("string")
    for k, v in codes.items():
        out = F.when(code == k, F.lit(v)).otherwise(out)
    return out


def placement(bracket: Column) -> Column:
    """Where a note, an addition or a continuation stands, from the signs that open it."""
    return F.when(bracket.startswith("\\F"), _coded(BESIDE, F.substring(bracket, 3, 1))).when(
        bracket.startswith("*"), _coded(PLACES, F.substring(bracket, 2, 1))
    )


def _event(kind: str, xml: Column | str) -> Column:
    return F.struct(F.lit(kind).alias("kind"), (F.lit(xml) if isinstance(xml, str) else xml).alias("xml"))


def _of_sign(c: Column) -> Column:
    """The event of a character, or null for those that only bound words."""
    tag = _coded(ELEMENTS, c["cls"])
    place = F.when(tag.isin("add", "note"), placement(c["string"]))
    return (
        F.when(is_a(c["mask"], "Whitespace", "Multiverbation", "Univerbation"), None)
        .when(is_a(c["mask"], "IllegibleChar"), _event(PLAIN, '<gap reason="illegible"/>'))
        .when(tag.isNotNull() & c["opening"], _event(OPEN, F.concat(tag, attributes(place=place))))
        .when(tag.isNotNull(), _event(CLOSE, tag))
        .otherwise(_event(PLAIN, escaped(c["string"])))
    )


def _begins(pieces: Column) -> Column:
    """Where in the token the pieces begin."""
    return F.transform(pieces, lambda p: F.get(p, F.lit(0))["pos"])


def token_events(words: DataFrame) -> DataFrame:
    """``words`` (chars with bounds, dipls with ``mark``, annos with ``attrs``, ``ends``) with ``events``, in order.

    At a place come the end of a word, then the mark of a diplomatic part (page, column and line, or a blank inside a
    word), then the beginning of a word, then the sign. A word is joined to its neighbour where no diplomatic bound stands
    between the two.
    """
    rows = words.withColumn("d_at", _begins(bounds.dipl_pieces(F.col("chars")))).withColumn("a_at", _begins(bounds.anno_pieces(F.col("chars"))))
    glued = lambda at: F.coalesce(~F.array_contains("d_at", at), F.lit(False))

    def word(k: Column) -> Column:
        left, right = glued(F.get(F.col("a_at"), k)), glued(F.get(F.col("a_at"), k + 1))
        join = F.when(left & right, "both").when(right, "right").when(left, "left")
        return F.concat(F.get(F.col("annos"), k)["attrs"], attributes(join=join))

    def at(c: Column, i: Column) -> Column:
        d, a = F.array_position("d_at", i).cast("int") - 1, F.array_position("a_at", i).cast("int") - 1
        mark = F.get(F.col("dipls"), d)["mark"]
        inside = F.when((mark == "") & (a < 0), ' <space quantity="1" unit="chars"/>').otherwise(mark)
        return F.array(
            F.when(a >= 0, _event(END, "")), F.when(d >= 0, _event(PLAIN, F.coalesce(inside, F.lit("")))),
            F.when((a >= 0) & (a < F.size("annos")), _event(WORD, word(a))), _of_sign(c),
        )

    closing = F.try_element_at(F.filter(F.transform("annos", lambda a: a["ends"]), lambda x: x.isNotNull()), F.lit(-1))
    last = F.array(_event(END, ""), F.when(closing.isNotNull(), _event(SENTENCE, closing)))
    events = F.concat(F.flatten(F.transform("chars", at)), last)
    return rows.withColumn("events", F.array_compact(events)).drop("d_at", "a_at")


def fold(events: Iterable[dict]) -> str:
    """The text of a document from its events. Brackets still open at a word's end are opened again in the next word."""
    out: list[str] = []
    inside: list[str] = []  # brackets open in this word
    waiting: list[str] = []  # brackets that words have cut
    word, sentence = False, 0
    for e in events:
        kind, xml = e["kind"], e["xml"]
        if kind == WORD:
            out += [f"<w{xml}>", *(f"<{b}>" for b in waiting)]
            word, inside, waiting = True, waiting, []
        elif kind == END and word:
            out += [*(f"</{b.split(' ')[0]}>" for b in reversed(inside)), "</w>"]
            word, inside, waiting = False, [], inside
        elif kind == OPEN:
            (inside if word else waiting).append(xml)
            if word:
                out.append(f"<{xml}>")
        elif kind == CLOSE:
            if word and inside:
                out.append(f"</{inside.pop().split(' ')[0]}>")
            elif waiting:
                waiting.pop()
        elif kind == SENTENCE:
            out.insert(sentence, f"<s{xml}>")
            out.append("</s>")
            sentence = len(out)
        elif kind == PLAIN:
            out.append(xml)
    return f"<text><body><ab>{''.join(out)}</ab></body></text>"


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [fold(events.as_py() or []) for events in batch.column("events")]
        yield pa.record_batch([batch.column(KEY), pa.array(texts, pa.string())], [KEY, "text"])


def to_tei(c: Corpus, sentences: str | None = None) -> DataFrame:
    """``sentences`` names a tag of annos that ends a sentence; its value is the part of the s element.

    Line, page and space elements begin a line of their own or follow a blank.
    """
    column = F.when(F.coalesce("col_name", F.lit("")) != UNSET, F.concat(F.lit("<cb"), attributes(n=F.nullif("col_name", F.lit(""))), F.lit("/>")))
    page = F.concat(F.lit("\n<pb"), attributes(n=full_side()), F.lit("/>"))
    line = F.concat(F.lit("\n<lb"), attributes(n=F.coalesce("line_name", F.lit(""))), F.lit("/>"))
    mark = F.when(F.col("line_begins"), F.concat_ws("", F.when(F.col("page_begins"), page), F.when(F.col("col_begins"), column), line)).otherwise("")
    dipls = placed_dipls(c).withColumn("mark", mark).groupBy(KEY, "tok_ord").agg(F.array_sort(F.collect_list(F.struct("dipl_in_tok", "mark"))).alias("dipls"))
    tag = lambda name: F.try_element_at("tags", F.lit(name))
    pos = F.concat(tag("pos"), F.coalesce(F.concat(F.lit("<"), tag("pos_gen")), F.lit("")))
    attrs = attributes(**{"xml:id": F.col("anno_id"), "pos": pos, "msd": tag("morph"), "lemma": tag("lemma_wsd")})
    part = tag(sentences) if sentences else F.lit(None).cast("string")
    ends = F.when(F.coalesce(part, F.lit(UNSET)) != UNSET, attributes(part=part))
    annos = c.annos.select(KEY, "tok_ord", "anno_in_tok", attrs.alias("attrs"), ends.alias("ends")).groupBy(KEY, "tok_ord")
    annos = annos.agg(F.array_sort(F.collect_list(F.struct("anno_in_tok", "attrs", "ends"))).alias("annos"))
    words = c.tokens.select(KEY, "tok_ord", "item_ord", bounds.bounded(F.col("chars")).alias("chars"))
    words = words.join(dipls, [KEY, "tok_ord"], "left").join(annos, [KEY, "tok_ord"], "left")
    none = F.expr("cast(array() as array<struct<anno_in_tok:int,attrs:string,ends:string>>)")
    said = token_events(words.withColumn("annos", F.coalesce("annos", none))).select(KEY, "item_ord", "events")
    note = _event(PLAIN, F.concat(F.lit('<note type="editorial">'), escaped(F.col("content")), F.lit("</note>")))
    both = said.unionByName(c.comments.select(KEY, "item_ord", F.array(note).alias("events")))
    whole = both.groupBy(KEY).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("item_ord", "events"))), lambda x: x["events"])).alias("events"))
    rows = c.documents.select(KEY).join(whole, KEY, "left")
    return rows.mapInArrow(_folded, f"{KEY} string, text string")
