"""Sources, sinks, layout and whole steps over fixtures: small documents in every format."""

from __future__ import annotations

import base64
import io
import uuid
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import Corpus, joined
from ..operators import headers, layout, modify
from ..session import prepared, shared_folder
from ..sinks import exported, write_corpus
from ..sinks.common import placed_dipls
from ..sinks.trans import editor_json
from ..sources import read_corpus
from ..sources.bonnxml import read_bonnxml
from ..sources.docx import docx_texts
from ..sources.dualxml import read_dualxml
from ..sources.trans import read_trans
from .fixtures import golden, once
from .token_fixtures import shown

KEY = "doc_key"
Reader = Callable[[DataFrame], Corpus]


def trans(of: str = "anselm", strict: bool = True) -> Reader:
    return lambda rows: read_trans(rows.withColumnRenamed("given", "text"), of, strict)


def dualxml(of: str = "anselm", strict: bool = True) -> Reader:
    return lambda rows: read_dualxml(rows.withColumnRenamed("given", "content"), of, strict)


def of_corpus(df: DataFrame, read: Reader, f: Callable[[Corpus], DataFrame]) -> DataFrame:
    """What ``f`` makes (doc_key and columns) of the corpus of all distinct inputs, for each document."""

    def made(t: DataFrame) -> DataFrame:
        prepared(t.sparkSession)
        keyed = t.select(F.md5("given").alias(KEY), "given")
        found = f(read(keyed))
        return keyed.join(found, KEY, "left").drop(KEY)

    return once(df, made)


def rows_of(df: DataFrame, order: list[str], *parts: str | Column, into: str, sep: str = " ~ ") -> DataFrame:
    """(doc_key, into): the rows of a document in order, each as its parts between colons."""
    said = F.concat_ws(":", *[F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("-")) for p in parts])
    return df.select(KEY, F.struct(*order).alias("o"), said.alias("x")).groupBy(KEY).agg(joined(F.col("o"), F.col("x"), sep).alias(into))


def together(c: Corpus, *tables: DataFrame) -> DataFrame:
    """The tables side by side, empty text where a document has no row."""
    out = c.documents.select(KEY)
    for t in tables:
        out = out.join(t, KEY, "left")
    return out.select(KEY, *[F.coalesce(n, F.lit("")).alias(n) for t in tables for n in t.columns if n != KEY])


def dipl_rows(c: Corpus) -> DataFrame:
    return rows_of(c.dipls, ["dipl_ord"], "dipl_id", "trans", "utf", "line_ord", into="dipls")


def anno_rows(c: Corpus) -> DataFrame:
    flags = F.array_join(F.array_sort("flags"), ",")
    return rows_of(c.annos, ["anno_ord"], "anno_id", "trans", "simple", "checked", shown(F.col("tags")), flags, into="annos")


def diagnostic_rows(c: Corpus) -> DataFrame:
    return rows_of(c.diagnostics, ["code", "item_ord"], "code", "item_ord", into="found", sep=" ")


def valid(c: Corpus) -> DataFrame:
    return c.documents.select(KEY, F.col("valid").cast("string").alias("valid"))


def layout_rows(c: Corpus) -> DataFrame:
    """Lines with their place."""
    rows = c.lines.withColumnRenamed("name", "line").join(c.columns.withColumnRenamed("name", "col"), [KEY, "col_ord"]).join(c.pages.withColumnRenamed("name", "page"), [KEY, "page_ord"])
    return rows_of(rows, ["line_ord"], "page", "side", "col", "line", into="lines")


def shift_rows(c: Corpus) -> DataFrame:
    """Shift marks with their members: a range join."""
    elements = c.shift_tags.withColumnsRenamed({"first_tok_ord": "first_ord", "last_tok_ord": "last_ord"})
    met = layout.by_range(elements, c.tokens.select(KEY, "tok_ord", "trans"), KEY, "tok_ord")
    names = met.groupBy(KEY, "tag_ord", "tag").agg(joined(F.col("tok_ord"), F.col("trans"), ",").alias("members"))
    return rows_of(names, ["tag_ord"], "tag", "members", into="shifts")


@golden("valid sigle lines dipls shifts found", [
    ('+H\nSigle: M1_x\nTitel: a:b\n@H\n\nM1-1ra,01\tfoo|bar test. +K note @K +F baz\nM1-1ra,02\tlange(=)\n\tzeile@F ende $o\nM1-1rb,01\tvn\\- <<...>> *[weg*]\n', 'true', 'M1', '1:r:a:01 ~ 1:r:a:02 ~ 1:r:a:03 ~ 1:r:b:01', 'd1:foo|bar:foobar:1 ~ d2:test.:test.:1 ~ d3:baz:baz:1 ~ d4:lange(=):lange:2 ~ d5:zeile:zeile:3 ~ d6:ende:ende:3 ~ d7:$o:ſo:3 ~ d8:vn\\-:vn̄:4 ~ d9:<<...>>:[...]:4 ~ d10:*[weg*]:weg:4', 'fm:baz,lange(=)zeile', ''),
    ('+H\nSigle: S2\n@H\nS2-1v,1\ta [b] +L c +R d @R @L\nS2-2r,1\t<e>=\nS2-2r,2\t<f> +E last @E\n', 'true', 'S2', '1:v::1 ~ 2:r::1 ~ 2:r::2', 'd1:a:a:1 ~ d2:[b]:[...]:1 ~ d3:c:c:1 ~ d4:d:d:1 ~ d5:<e>=:e=:2 ~ d6:<f>:f:3', 'rub:d ~ lat:c,d', ''),
    ('', 'false', '', '', '', '', 'document_empty:- header_empty:-'),
    ('+H\n@H\nX-1r,1\tbad[ token\n', 'false', '', '1:r::1', 'd1:bad[:bad[...]:1 ~ d2:token:token:1', '', 'bracket_not_closed:1 header_empty:-'),
    ('Sigle: no\nno mark here\n', 'false', '', '-:-:-:- ~ -:-:-:-', 'd1:Sigle::Sigle::1 ~ d2:no:no:1 ~ d3:no:no:2 ~ d4:mark:mark:2 ~ d5:here:here:2', '', 'bibinfo_missing:1 bibinfo_missing:2 header_empty:-'),
    ('+H\nSigle: A\n@H\nA-1r,01\tx\nbad mark\ty\n\tz\nA-1r,09\t\nA-1v,01\tw @F\n', 'false', 'A', '1:r::01 ~ 1:r::02 ~ 1:r::03 ~ 1:r::04 ~ 1:v::01', 'd1:x:x:1 ~ d2:y:y:2 ~ d3:z:z:3 ~ d4:A-1r,09:A-1r,09:4 ~ d5:w:w:5', '', 'bibinfo_malformed:2 close_not_opened:10'),
    ('+H\nnothing: \n@H\nB-1,1\ta\tb +M open\n', 'true', '', '1:::1', 'd1:a:a:1 ~ d2:b:b:1 ~ d3:open:open:1', '', 'shift_tag_unclosed:- sigle_missing:- tab_between_tokens:1'),
])
def trans_source(df: DataFrame) -> DataFrame:
    """Transcriptions: headers, marks and their filling, lines, tokens over two lines, comments, shift marks, problems."""
    sigle = lambda c: c.documents.select(KEY, "sigle")
    return of_corpus(df, trans(), lambda c: together(c, valid(c), sigle(c), layout_rows(c), dipl_rows(c), shift_rows(c), diagnostic_rows(c)))


@golden("strict_valid valid lines dipls annos shifts found", [
    ('<text><cora-header sigle="S1" name="N"/><header>a:b</header><layoutinfo><page id="p1" no="1" side="r" range="c1"/><column id="c1" range="l1..l2"/><line id="l1" name="1" range="t1_d1"/><line id="l2" name="2" range="t2_d1..t9_d1"/></layoutinfo><shifttags><marg range="t1..t2"/><lat range="t9"/></shifttags><token id="t1" trans="test|case"><dipl id="t1_d1" trans="test|case"/><mod id="t1_m1" trans="test|" checked="y"><pos tag="NA"/><pos tag="NN"/><lemma tag="test"/><cora-flag name="lemma verified"/><cora-flag name="boundary"/></mod><mod id="t1_m2" trans="case"/></token><comment type="K">c &amp; d</comment><token id="t2" trans="her#aws"><dipl id="t2_d1" trans="her#aws"/><mod id="t2_m1" trans="her#aws" checked="y"/></token><token id="t9" trans="hin#czü|hin(.)"><dipl id="t9_d1" trans="hin#czü|"/><dipl id="t9_d2" trans="hin"/><mod id="t9_m1" trans="hin#czü|"/><mod id="t9_m2" trans="hin"/><mod id="t9_m3" trans="(.)"/></token></text>', 'false', 'true', '1:r:-:1 ~ 1:r:-:2', 't1_d1:test|case:testcase:1 ~ t2_d1:her#aws:heraws:2 ~ t9_d1:hin#czü|:hinczü:2 ~ t9_d2:hin:hin:2', 't1_m1:test|:test:true:lemma=test;pos=NN:boundary,lemma verified ~ t1_m2:case:case:false:: ~ t2_m1:her#aws:heraws:true:: ~ t9_m1:hin#czü|:hinczü:false:: ~ t9_m2:hin:hin:false:: ~ t9_m3:(.):(.):false::', 'marg:test|case,her#aws ~ lat:hin#czü|hin(.)', 'err_cat_anno:4 err_cat_dipl:4 err_nr_anno:4 err_nr_dipl:3 err_tok_dipl:4'),
    ('<text><cora-header sigle="S1" name="N"/><header>a:b</header><layoutinfo><page id="p1" no="1" side="r" range="c1"/><column id="c1" range="l1..l2"/><line id="l1" name="1" range="t1_d1"/><line id="l2" name="2" range="t2_d1..t9_d1"/></layoutinfo><shifttags><fm range="t1..t7"/></shifttags><token id="t1" trans="test|case"><dipl id="t1_d1" trans="test|case"/><mod id="t1_m1" trans="test|" checked="y"><pos tag="NA"/><pos tag="NN"/><lemma tag="test"/><cora-flag name="lemma verified"/><cora-flag name="boundary"/></mod><mod id="t1_m2" trans="case"/></token><token id="t2" trans="x"><dipl id="t2_d1" trans="x"/><mod id="t2_m1" trans="x"/></token><token id="t9" trans="y"><dipl id="t9_d1" trans="y"/></token></text>', 'false', 'true', '1:r:-:1 ~ 1:r:-:2', 't1_d1:test|case:testcase:1 ~ t2_d1:x:x:2 ~ t9_d1:y:y:2', 't1_m1:test|:test:true:lemma=test;pos=NN:boundary,lemma verified ~ t1_m2:case:case:false:: ~ t2_m1:x:x:false::', '', 'err_nr_anno:3 shift_tag_without_token:1'),
    ('<no', 'false', 'false', '', '', '', '', 'not_xml:-'),
    ('<text><cora-header sigle="S1" name="N"/><header>a:b</header><layoutinfo><page id="p1" no="1" range="c1"/><column id="c1" range="l1"/><line id="l1" name="1" range="t1_d1..t2_d1"/><line id="l2" name="2" range=""/><line id="l3" name="3" range="t1_d1"/><line id="l4" name="4" range="t7_d1"/></layoutinfo><shifttags></shifttags><token id="t1" trans="a=b"><dipl id="t1_d1" trans="a=b"/><mod id="t1_m1" trans="a=b"/></token><token id="t2" trans="ba="><dipl id="t2_d1" trans="ba="/><mod id="t2_m1" trans="ba="/></token></text>', 'false', 'true', '1:-:-:1', 't1_d1:a=b:a=b:1 ~ t2_d1:ba=:ba=:1', 't1_m1:a=b:ab:false:: ~ t2_m1:ba=:ba:false::', '', 'empty_range:2 err_nr_dipl:1 range_end_missing:4 range_start_missing:4 repeated_begin:1 repeated_begin:3'),
    ('<text><cora-header sigle="S1" name="N"/><header>a:b</header><layoutinfo><page id="p1" no="1" range="c1"/><column id="c1" name="a" range="l1..l2"/><line id="l1" name="1" range="t1_d1"/><line id="l2" name="2" range="t1_d2"/></layoutinfo><shifttags></shifttags><token id="t1" trans="a=b"><dipl id="t1_d1" trans="a="/><dipl id="t1_d2" trans="b"/><mod id="t1_m1" trans="a=b"/></token></text>', 'true', 'true', '1:-:a:1 ~ 1:-:a:2', 't1_d1:a=:a=:1 ~ t1_d2:b:b:2', 't1_m1:a=b:ab:false::', '', ''),
    ('<text><cora-header sigle="S1" name="N"/><header>a:b</header><layoutinfo></layoutinfo><shifttags></shifttags><token id="" trans="a"><dipl id="" trans="a"/><mod id="" trans="a"/></token><token id="t2" trans="q"></token></text>', 'true', 'true', '', 'd1:a:a:-', 'a1:a:a:false::', '', 'dipl_without_line:1 err_cat_dipl:2 err_no_pieces:2'),
])
def dualxml_source(df: DataFrame) -> DataFrame:
    """Dual-token XML: given ids and pieces, tags and flags, layout by ranges, comments, problems; strict or not."""
    loose = of_corpus(df, dualxml(strict=False), lambda c: together(c, valid(c), layout_rows(c), dipl_rows(c), anno_rows(c), shift_rows(c), diagnostic_rows(c)))
    strict = of_corpus(df, dualxml(), lambda c: together(c, valid(c))).select("doc_id", F.col("valid").alias("strict_valid"))
    return loose.join(strict, "doc_id")


@golden("valid dipls annos", [
    ('<text><layoutinfo><page id="p" no="1" range="c"/><column id="c" range="l"/><line id="l" name="1" range="a..b"/></layoutinfo><token id="t" trans="a°b|c"><tok_dipl id="a" trans="a°b|c"/><tok_anno id="x" trans="a°b|"/><tok_anno id="y" trans="c"/></token><token id="u" trans="d"><tok_dipl id="b" trans="d"/><tok_anno id="z" trans="d"/></token></text>', 'true', 'a:a°b|c:a°bc:1 ~ b:d:d:1', 'x:a°b|:a°b:false:: ~ y:c:c:false:: ~ z:d:d:false::'),
    ('<text><layoutinfo><page id="p" no="1" range="c"/><column id="c" range="l"/><line id="l" name="1" range="a..b"/></layoutinfo><token id="t" trans="foo#bar"><dipl id="a" trans="foo"/><dipl id="b" trans="bar"/><anno id="x" trans="foobar" checked="y"/></token></text>', 'true', 'a:foo:foo:1 ~ b:bar:bar:1', 'x:foobar:foobar:true::'),
])
def dualxml_dialects(df: DataFrame) -> DataFrame:
    """Dual-token XML in dialects with names of elements of their own, blanks between parts, or tokens cut anew."""
    rem = of_corpus(df.where("given like '%tok_dipl%'"), dualxml("rem"), lambda c: together(c, valid(c), dipl_rows(c), anno_rows(c)))
    ren = of_corpus(df.where("given not like '%tok_dipl%'"), dualxml("ren"), lambda c: together(c, valid(c), dipl_rows(c), anno_rows(c)))
    return rem.unionByName(ren)


@golden("xml", [
    ('+H\nSigle: M1_x\nTitel: a:b\n@H\n\nM1-1ra,01\tfoo|bar test. +K note @K +F baz\nM1-1ra,02\tlange(=)\n\tzeile@F ende $o\nM1-1rb,01\tvn\\- <<...>> *[weg*]\n', '<text id="M1"><cora-header sigle="M1" name=""/><header>Sigle: M1_xTitel: a:b</header><layoutinfo><page id="p1" no="1" range="c1..c2" side="r"/><column id="c1" range="l1..l3" name="a"/><line id="l1" name="01" range="d1..d3"/><line id="l2" name="02" range="d4"/><line id="l3" name="03" range="d5..d7"/><column id="c2" range="l4" name="b"/><line id="l4" name="01" range="d8..d10"/></layoutinfo><shifttags><fm range="t3..t4"/></shifttags><token id="t1" trans="foo|bar"><dipl id="d1" trans="foo|bar" utf="foobar"/><mod id="a1" trans="foo|" utf="foo" ascii="foo"></mod><mod id="a2" trans="bar" utf="bar" ascii="bar"></mod></token><token id="t2" trans="test."><dipl id="d2" trans="test." utf="test."/><mod id="a3" trans="test" utf="test" ascii="test"></mod><mod id="a4" trans="." utf="." ascii="."></mod></token><comment type="K">note</comment><token id="t3" trans="baz"><dipl id="d3" trans="baz" utf="baz"/><mod id="a5" trans="baz" utf="baz" ascii="baz"></mod></token><token id="t4" trans="lange(=)zeile"><dipl id="d4" trans="lange(=)" utf="lange"/><dipl id="d5" trans="zeile" utf="zeile"/><mod id="a6" trans="lange(=)zeile" utf="langezeile" ascii="langezeile"></mod></token><token id="t5" trans="ende"><dipl id="d6" trans="ende" utf="ende"/><mod id="a7" trans="ende" utf="ende" ascii="ende"></mod></token><token id="t6" trans="$o"><dipl id="d7" trans="$o" utf="ſo"/><mod id="a8" trans="$o" utf="ſo" ascii="so"></mod></token><token id="t7" trans="vn\\-"><dipl id="d8" trans="vn\\-" utf="vn̄"/><mod id="a9" trans="vn\\-" utf="vn̄" ascii="vnd"></mod></token><token id="t8" trans="&lt;&lt;...&gt;&gt;"><dipl id="d9" trans="&lt;&lt;...&gt;&gt;" utf="[...]"/><mod id="a10" trans="&lt;&lt;...&gt;&gt;" utf="[...]" ascii=""></mod></token><token id="t9" trans="*[weg*]"><dipl id="d10" trans="*[weg*]" utf="weg"/></token></text>'),
    ('+H\nSigle: S2\n@H\nS2-1v,1\ta [b] +L c +R d @R @L\nS2-2r,1\t<e>=\nS2-2r,2\t<f> +E last @E\n', '<text id="S2"><cora-header sigle="S2" name=""/><header>Sigle: S2</header><layoutinfo><page id="p1" no="1" range="c1" side="v"/><column id="c1" range="l1"/><line id="l1" name="1" range="d1..d4"/><page id="p2" no="2" range="c2" side="r"/><column id="c2" range="l2..l3"/><line id="l2" name="1" range="d5"/><line id="l3" name="2" range="d6"/></layoutinfo><shifttags><rub range="t4"/><lat range="t3..t4"/></shifttags><token id="t1" trans="a"><dipl id="d1" trans="a" utf="a"/><mod id="a1" trans="a" utf="a" ascii="a"></mod></token><token id="t2" trans="[b]"><dipl id="d2" trans="[b]" utf="[...]"/><mod id="a2" trans="[b]" utf="[...]" ascii="b"></mod></token><token id="t3" trans="c"><dipl id="d3" trans="c" utf="c"/><mod id="a3" trans="c" utf="c" ascii="c"></mod></token><token id="t4" trans="d"><dipl id="d4" trans="d" utf="d"/><mod id="a4" trans="d" utf="d" ascii="d"></mod></token><token id="t5" trans="&lt;e&gt;=&lt;f&gt;"><dipl id="d5" trans="&lt;e&gt;=" utf="e="/><dipl id="d6" trans="&lt;f&gt;" utf="f"/><mod id="a5" trans="&lt;e&gt;=&lt;f&gt;" utf="ef" ascii="ef"></mod></token><comment type="E">last</comment></text>'),
])
def dualxml_sink(df: DataFrame) -> DataFrame:
    """Transcriptions as dual-token XML; what is read from it and written again is the same."""

    def made(c: Corpus) -> DataFrame:
        first = exported(c, "coraxml")
        again = exported(read_dualxml(first.withColumnRenamed("text", "content"), "anselm"), "coraxml").withColumnRenamed("text", "again")
        same = F.when(F.col("text") == F.col("again"), F.replace("text", F.lit("\n"), F.lit("")))
        return first.join(again, KEY).select(KEY, same.alias("xml"))

    return of_corpus(df, trans(), made)


@golden("trans dipl_utf anno_utf anno_simple", [
    ('+H\nSigle: M1_x\nTitel: a:b\n@H\n\nM1-1ra,01\tfoo|bar test. +K note @K +F baz\nM1-1ra,02\tlange(=)\n\tzeile@F ende $o\nM1-1rb,01\tvn\\- <<...>> *[weg*]\n', '+H | Sigle: M1_x | Titel: a:b | @H |  | M1-1ra,01 > foo|bar test. +K note @K baz | M1-1ra,02 > lange(=) | M1-1ra,03 > zeile ende $o | M1-1rb,01 > vn\\- <<...>> *[weg*] | ', '+H | Sigle: M1_x | Titel: a:b | @H |  | M1-1ra,01 > foobar test. baz | M1-1ra,02 > lange | M1-1ra,03 > zeile ende ſo | M1-1rb,01 > vn̄ [...] weg | ', '+H | Sigle: M1_x | Titel: a:b | @H |  | M1-1ra,01 > foo bar test . baz | M1-1ra,02 > lange | M1-1ra,03 > zeile ende ſo | M1-1rb,01 > vn̄ [...]  | ', '+H | Sigle: M1_x | Titel: a:b | @H |  | M1-1ra,01 > foo bar test . baz | M1-1ra,02 > lange | M1-1ra,03 > zeile ende so | M1-1rb,01 > vnd   | '),
    ('+H\nSigle: S2\n@H\nS2-1v,1\ta [b] +L c +R d @R @L\nS2-2r,1\t<e>=\nS2-2r,2\t<f> +E last @E\n', '+H | Sigle: S2 | @H |  | S2-1v,1 > a [b] c d | S2-2r,1 > <e>= | S2-2r,2 > <f> +E last @E | ', '+H | Sigle: S2 | @H |  | S2-1v,1 > a [...] c d | S2-2r,1 > e= | S2-2r,2 > f | ', '+H | Sigle: S2 | @H |  | S2-1v,1 > a [...] c d | S2-2r,1 > e | S2-2r,2 > f | ', '+H | Sigle: S2 | @H |  | S2-1v,1 > a b c d | S2-2r,1 > e | S2-2r,2 > f | '),
])
def trans_sink(df: DataFrame) -> DataFrame:
    """Transcriptions written again in four forms."""

    def made(c: Corpus) -> DataFrame:
        forms = [exported(c, "trans", form=f).select(KEY, F.replace(F.replace("text", F.lit("\n"), F.lit(" | ")), F.lit("\t"), F.lit(" > ")).alias(f)) for f in ("trans", "dipl_utf", "anno_utf", "anno_simple")]
        return together(c, *forms)

    return of_corpus(df, trans(), made)


def _one_line(c: Corpus, format: str, **options) -> DataFrame:
    return exported(c, format, **options).select(KEY, F.replace("text", F.lit("\n"), F.lit("⏎")).alias("text"))


@golden("text", [
    ('+H\nSigle: M1_x\nTitel: a:b\n@H\n\nM1-1ra,01\tfoo|bar test. +K note @K +F baz\nM1-1ra,02\tlange(=)\n\tzeile@F ende $o\nM1-1rb,01\tvn\\- <<...>> *[weg*]\n', '<text><body><ab>⏎<pb n="1r"/><cb n="a"/>⏎<lb n="01"/><w xml:id="a1" join="right">foo</w><w xml:id="a2" join="left">bar</w><w xml:id="a3" join="right">test</w><w xml:id="a4" join="left">.</w><note type="editorial">note</note><w xml:id="a5">baz</w>⏎<lb n="02"/><w xml:id="a6">lange⏎<lb n="03"/>zeile</w><w xml:id="a7">ende</w><w xml:id="a8">$o</w><cb n="b"/>⏎<lb n="01"/><w xml:id="a9">vn\\-</w><w xml:id="a10">&lt;&lt;...&gt;&gt;</w> <space quantity="1" unit="chars"/>weg</ab></body></text>'),
    ('+H\nSigle: S2\n@H\nS2-1v,1\ta [b] +L c +R d @R @L\nS2-2r,1\t<e>=\nS2-2r,2\t<f> +E last @E\n', '<text><body><ab>⏎<pb n="1v"/><cb/>⏎<lb n="1"/><w xml:id="a1">a</w><w xml:id="a2">[b]</w><w xml:id="a3">c</w><w xml:id="a4">d</w>⏎<pb n="2r"/><cb/>⏎<lb n="1"/><w xml:id="a5"><unclear>e</unclear>=⏎<lb n="2"/><unclear>f</unclear></w><note type="editorial">last</note></ab></body></text>'),
    ('+H\nSigle: N\n@H\nN-1r,1\ta{L_b#c}d *LN_n* e§f\nN-1r,2\tg[…]h \\FU_i\\ +K k < l @K ǂmǂn\n', '<text><body><ab>⏎<pb n="1r"/><cb/>⏎<lb n="1"/><w xml:id="a1">a<expan>bc</expan>d</w><w xml:id="a2"><note place="margin left">n</note></w><w xml:id="a3">ef</w>⏎<lb n="2"/><w xml:id="a5">g<gap reason="illegible"/>h</w><w xml:id="a6"><add place="below">i</add></w><note type="editorial">k &lt; l</note><w xml:id="a7"><del>m</del>n</w></ab></body></text>'),
])
def tei_sink(df: DataFrame) -> DataFrame:
    """TEI with brackets across words, milestones, joined words, gaps and notes."""
    ren = of_corpus(df.where("given like '%Sigle: N%'"), trans("ren"), lambda c: _one_line(c, "tei"))
    return ren.unionByName(of_corpus(df.where("given not like '%Sigle: N%'"), trans(), lambda c: _one_line(c, "tei")))


@golden("text", [
    ('<text><cora-header sigle="S1" name="N"/><header>a:b</header><layoutinfo><page id="p1" no="1" side="r" range="c1"/><column id="c1" range="l1..l2"/><line id="l1" name="1" range="t1_d1"/><line id="l2" name="2" range="t2_d1..t9_d1"/></layoutinfo><shifttags></shifttags><token id="t1" trans="foobar"><dipl id="t1_d1" trans="foobar"/><mod id="t1_m1" trans="foobar" checked="y"><pos tag="NN"/><pos_gen tag="NE"/><morph tag="Sg"/><lemma_wsd tag="l&amp;1"/></mod></token><token id="t2" trans="x."><dipl id="t2_d1" trans="x."/><mod id="t2_m1" trans="x." checked="y"><bound_sent tag="Satz"/></mod></token><token id="t9" trans="y"><dipl id="t9_d1" trans="y"/><mod id="t9_m1" trans="y" checked="y"><bound_sent tag="--"/></mod></token></text>', '<text><body><ab><s part="Satz">⏎<pb n="1r"/><cb/>⏎<lb n="1"/><w xml:id="t1_m1" pos="NN&lt;NE" msd="Sg" lemma="l&amp;1">foobar</w>⏎<lb n="2"/><w xml:id="t2_m1" join="right">x</w>.</s><w xml:id="t9_m1">y</w></ab></body></text>'),
])
def tei_sentences(df: DataFrame) -> DataFrame:
    """TEI with words' attributes and sentences that a tag ends."""
    return of_corpus(df, dualxml(strict=False), lambda c: _one_line(c, "tei", sentences="bound_sent"))


@golden("text", [
    ('+H\nSigle: M1_x\nTitel: a:b\n@H\n\nM1-1ra,01\tfoo|bar test. +K note @K +F baz\nM1-1ra,02\tlange(=)\n\tzeile@F ende $o\nM1-1rb,01\tvn\\- <<...>> *[weg*]\n', '{"text":"foobar test. baz\\nlange\\nzeile ende ſo\\nvn̄ [...] weg","sigle":"M1","name":"","header":{"Sigle":[" M1_x"],"Titel":[" a","b"]},"entities":{"Layout:Column":[{"indices":[0,36],"id":"c1","name":"a"},{"indices":[37,50],"id":"c2","name":"b"}],"Layout:Line":[{"indices":[0,16],"id":"l1","name":"01"},{"indices":[17,22],"id":"l2","name":"02"},{"indices":[23,36],"id":"l3","name":"03"},{"indices":[37,50],"id":"l4","name":"01"}],"Layout:Page":[{"indices":[0,50],"id":"p1","name":"1","side":"r"}],"Shifttags:fm":[{"indices":[13,28],"type":"F"}],"Token:Anno":[{"indices":[0,3],"checked":false,"flags":[],"trans":"foo|","utf":"foo","simple":"foo","id":"a1"},{"indices":[3,6],"checked":false,"flags":[],"trans":"bar","utf":"bar","simple":"bar","id":"a2"},{"indices":[7,11],"checked":false,"flags":[],"trans":"test","utf":"test","simple":"test","id":"a3"},{"indices":[11,12],"checked":false,"flags":[],"trans":".","utf":".","simple":".","id":"a4"},{"indices":[13,16],"checked":false,"flags":[],"trans":"baz","utf":"baz","simple":"baz","id":"a5"},{"indices":[17,28],"checked":false,"flags":[],"trans":"lange(=)zeile","utf":"langezeile","simple":"langezeile","id":"a6"},{"indices":[29,33],"checked":false,"flags":[],"trans":"ende","utf":"ende","simple":"ende","id":"a7"},{"indices":[34,36],"checked":false,"flags":[],"trans":"$o","utf":"ſo","simple":"so","id":"a8"},{"indices":[37,40],"checked":false,"flags":[],"trans":"vn\\\\-","utf":"vn̄","simple":"vnd","id":"a9"},{"indices":[41,46],"checked":false,"flags":[],"trans":"<<...>>","utf":"[...]","simple":"","id":"a10"}],"Token:Comment":[{"indices":[12,12],"type":"K","content":"note"}],"Token:Cora":[{"indices":[0,6],"id":"t1","trans":"foo|bar"},{"indices":[7,12],"id":"t2","trans":"test."},{"indices":[13,16],"id":"t3","trans":"baz"},{"indices":[17,28],"id":"t4","trans":"lange(=)zeile"},{"indices":[29,33],"id":"t5","trans":"ende"},{"indices":[34,36],"id":"t6","trans":"$o"},{"indices":[37,40],"id":"t7","trans":"vn\\\\-"},{"indices":[41,46],"id":"t8","trans":"<<...>>"},{"indices":[47,50],"id":"t9","trans":"*[weg*]"}],"Token:Dipl":[{"indices":[0,6],"trans":"foo|bar","utf":"foobar","id":"d1"},{"indices":[7,12],"trans":"test.","utf":"test.","id":"d2"},{"indices":[13,16],"trans":"baz","utf":"baz","id":"d3"},{"indices":[17,22],"trans":"lange(=)","utf":"lange","id":"d4"},{"indices":[23,28],"trans":"zeile","utf":"zeile","id":"d5"},{"indices":[29,33],"trans":"ende","utf":"ende","id":"d6"},{"indices":[34,36],"trans":"$o","utf":"ſo","id":"d7"},{"indices":[37,40],"trans":"vn\\\\-","utf":"vn̄","id":"d8"},{"indices":[41,46],"trans":"<<...>>","utf":"[...]","id":"d9"},{"indices":[47,50],"trans":"*[weg*]","utf":"weg","id":"d10"}]}}'),
])
def gate_sink(df: DataFrame) -> DataFrame:
    """Stand-off JSON: offsets of layout, tokens, annotations, comments and shift marks."""
    return of_corpus(df, trans(), lambda c: _one_line(c, "gatejson"))


@golden("text", [
    ('+H\nSigle: N\n@H\nN-1ra,1\ta{L_b#c}d *LN_n* e§f\nN-1ra,2\tg[…]h \\FU_i\\ +K k*l @K ǂmǂn\nN-2v,1\t$Lücke$ x[y]\n', '%   ⏎  ⏎|  ⏎:-----|:------------------------------------------------------------------  ⏎1ra,1 | a*b c*d **n** ef  ⏎1ra,2 | g[…]h i ^[k\\*l] ~~m~~n  ⏎2v,1 | ^[Lücke] x[y]'),
])
def markdown_sink(df: DataFrame) -> DataFrame:
    """Markdown tables with emphasis, gaps and notes."""
    return of_corpus(df, trans("ren"), lambda c: _one_line(c, "markdown"))


@golden("json", [
    ('+H\nSigle: N\n@H\nN-1r,1\tfoo=\nN-1r,2\tba\\er\n', '{"dipl_trans":["foo=","ba\\\\er"],"dipl_utf":["foo=","baͤr"],"dipl_breaks":[1,0],"mod_trans":["foo=ba\\\\er"],"mod_utf":["foobaͤr"],"mod_ascii":["foobaer"]}'),
    ('+H\nSigle: N\n@H\nN-1r,1\tfoo|bar#b.\n', '{"dipl_trans":["foo|bar#","b."],"dipl_utf":["foobar","b."],"dipl_breaks":[0,0],"mod_trans":["foo|","bar#b","."],"mod_utf":["foo","barb","."],"mod_ascii":["foo","barb","."]}'),
])
def editor_tokens(df: DataFrame) -> DataFrame:
    """The six parallel arrays of a token for the editor."""
    return of_corpus(df, trans(), lambda c: editor_json(c.tokens.where("tok_ord = 1").select(KEY, "chars")).select(KEY, "json"))


@golden("valid header lines dipls annos found", [
    ('<text sigle="B1"><general><title val="T"/><abbreviation ab_ddd="dd"/></general><page no="1"><side no="r"><column no="a"><line><token><form trans="foo" normu="nfoo"/><lemma inst="l" gen="g"/><pos inst="NN"/><infl val="a_b"/></token><token><form trans="bar" normu="nbar"/></token></line><line><token><form trans="baz." normu="nbaz."/></token></line></column><column no="b"><line><token><form trans="x" normu="nx"/></token></line></column></side><side no="v"><column no="a"><line><token><form trans="y" normu="ny"/></token></line></column></side></page></text>', 'true', 'abbr_ddd= dd;sigle= B1;text= T', '1:r:a:01 ~ 1:r:a:02 ~ 1:r:b:01 ~ 1:v:a:01', 'd1:foo:foo:1 ~ d2:bar:bar:1 ~ d3:baz.:baz.:2 ~ d4:x:x:3 ~ d5:y:y:4', 'a1:foo:foo:false:grapho=--;infl=a.b;inflClass=--;inflClass_gen=--;lemma=l;lemma_gen=g;lemma_idmwb=--;norm=nfoo;pos=NN: ~ a2:bar:bar:false:grapho=--;infl=--;inflClass=--;inflClass_gen=--;lemma=--;lemma_gen=--;lemma_idmwb=--;norm=nbar: ~ a3:baz:baz:false:grapho=--;infl=--;inflClass=--;inflClass_gen=--;lemma=--;lemma_gen=--;lemma_idmwb=--;norm=nbaz.: ~ a4:.:.:false:: ~ a5:x:x:false:grapho=--;infl=--;inflClass=--;inflClass_gen=--;lemma=--;lemma_gen=--;lemma_idmwb=--;norm=nx: ~ a6:y:y:false:grapho=--;infl=--;inflClass=--;inflClass_gen=--;lemma=--;lemma_gen=--;lemma_idmwb=--;norm=ny:', ''),
    ('<text sigle="B1"><general><title val="T"/><abbreviation ab_ddd="dd"/></general><page no="2"><line><token><form trans="ab=cd" normu="nab=cd"/></token></line><line><token><form trans="ef|gh" normu="nef|gh"/></token><token><form trans="i" normu="ni"/></token></line></page></text>', 'true', 'abbr_ddd= dd;sigle= B1;text= T', '2:::01 ~ 2:::02', 'd1:ab=:ab=:1 ~ d2:cd:cd:2 ~ d3:ef|gh:efgh:2 ~ d4:i:i:2', 'a1:ab=cd:abcd:false:grapho=--;infl=--;inflClass=--;inflClass_gen=--;lemma=--;lemma_gen=--;lemma_idmwb=--;norm=nab=cd: ~ a2:ef|:ef:false:grapho=--;infl=--;inflClass=--;inflClass_gen=--;lemma=--;lemma_gen=--;lemma_idmwb=--;norm=nef|gh: ~ a3:gh:gh:false:grapho=--;infl=--;inflClass=--;inflClass_gen=--;lemma=--;lemma_gen=--;lemma_idmwb=--;norm=nef|gh: ~ a4:i:i:false:grapho=--;infl=--;inflClass=--;inflClass_gen=--;lemma=--;lemma_gen=--;lemma_idmwb=--;norm=ni:', ''),
    ('<text sigle="B1"><general><title val="T"/><abbreviation ab_ddd="dd"/></general><page no="3"><side no="r"><line><token><form trans="a" normu="na"/></token></line></side></page><page no="4"><column no="b"><line><token><form trans="b" normu="nb"/><ref_second folio2="7" side2="r"/><comment val="c"/></token></line></column></page></text>', 'true', 'abbr_ddd= dd;sigle= B1;text= T', '3:r::01 ~ 4::b:01', 'd1:a:a:1 ~ d2:b:b:2', 'a1:a:a:false:grapho=--;infl=--;inflClass=--;inflClass_gen=--;lemma=--;lemma_gen=--;lemma_idmwb=--;norm=na: ~ a2:b:b:false:comment=c;grapho=--;infl=--;inflClass=--;inflClass_gen=--;lemma=--;lemma_gen=--;lemma_idmwb=--;norm=nb;ref_second_folio=7;ref_second_side=r:', ''),
    ('<no', 'false', '', '', '', '', 'document_empty:- header_empty:-'),
    ('<text sigle="B1"><general><title val="T"/><abbreviation ab_ddd="dd"/></general><page no="1"><line><token><form trans="a[b" normu="na[b"/></token></line></page></text>', 'false', 'abbr_ddd= dd;sigle= B1;text= T', '1:::01', 'd1:a[b:a[...]:1', 'a1:a[b:ab:false:grapho=--;infl=--;inflClass=--;inflClass_gen=--;lemma=--;lemma_gen=--;lemma_idmwb=--;norm=na[b:', 'bracket_not_closed:1'),
])
def bonn_source(df: DataFrame) -> DataFrame:
    """BonnXML: headers, four shapes of layout, moved bounds, annotation aligned with tokens."""
    read = lambda rows: read_bonnxml(rows.select(KEY, F.encode("given", "UTF-8").alias("content")), "anselm")
    entries = F.array_join(F.transform(F.filter(F.array_sort(F.map_entries("header")), lambda e: F.trim(F.array_join(e["value"], ":")) != ""), lambda e: F.concat(e["key"], F.lit("="), F.array_join(e["value"], ":"))), ";")
    return of_corpus(df, read, lambda c: together(c, valid(c), c.documents.select(KEY, entries.alias("header")), layout_rows(c), dipl_rows(c), anno_rows(c), diagnostic_rows(c)))


def _packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each body of a document as a docx file."""
    space = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    for b in batches:
        files = []
        for body in b["given"]:
            data = io.BytesIO()
            with zipfile.ZipFile(data, "w") as z:
                z.writestr("word/document.xml", f'<w:document xmlns:w="{space}"><w:body>{body}</w:body></w:document>')
            files.append(base64.b64encode(data.getvalue()).decode())
        yield pd.DataFrame({KEY: b["given"], "content": files})


@golden("text", [
    ('<w:p><w:r><w:rPr><w:i/></w:rPr><w:t>Sigle: D1</w:t></w:r></w:p><w:p><w:r><w:t>[12r,03] foo </w:t></w:r><w:r><w:rPr><w:highlight/></w:rPr><w:t>bar</w:t></w:r></w:p><w:p><w:r><w:t>baz</w:t></w:r></w:p>', '+H / Sigle: D1 / @H / D1-12r,03\tfoo +Q bar / D1-12r,04\t@Qbaz / '),
    ('<w:p><w:r><w:t>[1va,1] a</w:t></w:r></w:p><w:p><w:r><w:t> </w:t></w:r></w:p><w:p><w:r><w:t>b</w:t></w:r></w:p><w:p><w:r><w:t>[2r,07] c</w:t></w:r></w:p>', '+H /  / @H / D1-1va,01\ta / D1-1va,02\tb / D1-2r,07\tc / '),
])
def docx_source(df: DataFrame) -> DataFrame:
    """Office documents: italics are the header, highlights questions, places in brackets or counted on."""

    def made(t: DataFrame) -> DataFrame:
        prepared(t.sparkSession)
        files = t.mapInPandas(_packed, f"{KEY} string, content string").select(F.lit("D1").alias("k"), KEY, F.unbase64("content").alias("content"))
        texts = docx_texts(files.select(F.concat("k", F.lit("|"), KEY).alias(KEY), "content"))
        text = F.replace(F.replace("text", F.concat(F.lit("D1|"), F.col("given")), F.lit("D1")), F.lit("\n"), F.lit(" / "))
        return texts.select(F.expr(f"substring({KEY}, 4)").alias("given"), "text").select("given", text.alias("text"))

    return once(df, made)


@golden("dipls annos", [
    ('<text><cora-header sigle="S1" name="N"/><header>a:b</header><layoutinfo><page id="p1" no="1" side="r" range="c1"/><column id="c1" range="l1..l3"/><line id="l1" name="1" range="t1_d1..t2_d1"/><line id="l2" name="2" range="t3_d1..t4_d1"/><line id="l3" name="3" range="t5_d1"/></layoutinfo><shifttags></shifttags><token id="t1" trans="x"><dipl id="t1_d1" trans="x"/><mod id="t1_m1" trans="x"/></token><token id="t2" trans="ab(=)cd"><dipl id="t2_d1" trans="ab(=)cd"/><mod id="t2_m1" trans="ab(=)cd"/></token><token id="t3" trans="e"><dipl id="t3_d1" trans="e"/><mod id="t3_m1" trans="e"/></token><token id="t4" trans="f(=)g"><dipl id="t4_d1" trans="f(=)g"/><mod id="t4_m1" trans="f(=)g"/></token><token id="t5" trans="h"><dipl id="t5_d1" trans="h"/><mod id="t5_m1" trans="h"/></token></text>', 't1_d1:x:x:1 ~ t2_d1:ab(=):ab:1 ~ t2_d2:cd:cd:2 ~ t3_d1:e:e:2 ~ t4_d1:f(=):f:2 ~ t4_d2:g:g:3 ~ t5_d1:h:h:3', 't1_m1:x:x:false:: ~ t2_m1:ab(=)cd:abcd:false:: ~ t3_m1:e:e:false:: ~ t4_m1:f(=)g:fg:false:: ~ t5_m1:h:h:false::'),
    ('<text><cora-header sigle="S1" name="N"/><header>a:b</header><layoutinfo><page id="p1" no="1" side="r" range="c1"/><column id="c1" range="l1..l3"/><line id="l1" name="1" range="t1_d1..t2_d1"/><line id="l2" name="2" range="t3_d1..t4_d1"/><line id="l3" name="3" range="t5_d1"/></layoutinfo><shifttags><marg range="t2"/></shifttags><token id="t1" trans="x"><dipl id="t1_d1" trans="x"/><mod id="t1_m1" trans="x"/></token><token id="t2" trans="ab(=)cd"><dipl id="t2_d1" trans="ab(=)cd"/><mod id="t2_m1" trans="ab(=)cd"/></token><token id="t3" trans="e"><dipl id="t3_d1" trans="e"/><mod id="t3_m1" trans="e"/></token><token id="t4" trans="f"><dipl id="t4_d1" trans="f"/><mod id="t4_m1" trans="f"/></token><token id="t5" trans="h(=)i"><dipl id="t5_d1" trans="h(=)i"/><mod id="t5_m1" trans="h(=)i"/></token></text>', 't1_d1:x:x:1 ~ t2_d1:ab(=):ab:1 ~ t2_d2:cd:cd:1 ~ t3_d1:e:e:2 ~ t4_d1:f:f:2 ~ t5_d1:h(=):h:3 ~ t5_d2:i:i:3', 't1_m1:x:x:false:: ~ t2_m1:ab(=)cd:abcd:false:: ~ t3_m1:e:e:false:: ~ t4_m1:f:f:false:: ~ t5_m1:h(=)i:hi:false::'),
    ('<text><cora-header sigle="S1" name="N"/><header>a:b</header><layoutinfo><page id="p1" no="1" side="r" range="c1"/><column id="c1" range="l1..l3"/><line id="l1" name="1" range="t1_d1..t2_d1"/><line id="l2" name="2" range="t3_d1..t4_d1"/><line id="l3" name="3" range="t5_d1"/></layoutinfo><shifttags></shifttags><token id="t1" trans="a(=)b"><dipl id="t1_d1" trans="a(=)b"/><mod id="t1_m1" trans="a(=)b"/></token><token id="t2" trans="c"><dipl id="t2_d1" trans="c"/><mod id="t2_m1" trans="c"/></token><token id="t3" trans="*{D*}iz"><dipl id="t3_d1" trans="*{D*}iz"/><mod id="t3_m1" trans="Diz"/></token><token id="t4" trans="ab"><dipl id="t4_d1" trans="ab"/><mod id="t4_m1" trans="aB"/></token><token id="t5" trans="z"><dipl id="t5_d1" trans="z"/><mod id="t5_m1" trans="z"/></token></text>', 't1_d1:a(=):a:1 ~ t1_d2:b:b:1 ~ t2_d1:c:c:1 ~ t3_d1:*{D*}iz:Diz:2 ~ t4_d1:ab:ab:2 ~ t5_d1:z:z:3', 't1_m1:a(=)b:ab:false:: ~ t2_m1:c:c:false:: ~ t3_m1:*{D*}iz:Diz:false:: ~ t4_m1:aB:ab:false:: ~ t5_m1:z:z:false::'),
])
def anselm_retokenised(df: DataFrame) -> DataFrame:
    """Tokens whose given pieces differ from the parse, cut anew; not past a line in marginal notes."""
    return of_corpus(df, dualxml(strict=False), lambda c: (lambda n: together(n, dipl_rows(n), anno_rows(n)))(modify.retokenised(c)))


@golden("finished back header", [
    ('<text><cora-header sigle="S1" name="N"/><header>Datum: 1\nx: y</header><layoutinfo><page id="p1" no="1" side="r" range="c1"/><column id="c1" range="l1..l2"/><line id="l1" name="1" range="t1_d1"/><line id="l2" name="2" range="t2_d1..t9_d1"/></layoutinfo><shifttags></shifttags><token id="t1" trans="und"><dipl id="t1_d1" trans="und"/><mod id="t1_m1" trans="und" checked="y"><norm tag="und"/><norm_type tag="f"/><pos tag="PDN"/><comment tag="x"/><boundary tag="y"/><cora-flag name="boundary"/><cora-flag name="z"/></mod></token><token id="t2" trans="."><dipl id="t2_d1" trans="."/><mod id="t2_m1" trans="." checked="y"><pos tag="--"/></mod></token><token id="t9" trans="a#b"><dipl id="t9_d1" trans="a#b"/><mod id="t9_m1" trans="a#b" checked="y"><norm tag="a"/><norm_broad tag="c"/><morph tag="Sg"/></mod></token></text>', 't1_m1:und:und:true:morph=--;norm=und;norm_broad=und;norm_type=inflection;pos=PDS:z ~ t2_m1:.:.:true:morph=--;pos=$(: ~ t9_m1:a#b:ab:true:morph=Sg;norm=a;norm_broad=c;token_type=US:', 't1_m1:und:und:true:norm=und;norm_type=f;pos=PDS:z ~ t2_m1:.:.:true:pos=$(: ~ t9_m1:a#b:ab:true:morph=Sg;norm=a;norm_broad=c;token_type=US:', 'Sigle: S1 | Zeit: 1400 | Ort: Ulm | x: y'),
    ('<text><cora-header sigle="S2" name="N"/><header>Datum: 1</header><layoutinfo><page id="p1" no="1" side="r" range="c1"/><column id="c1" range="l1..l2"/><line id="l1" name="1" range="t1_d1"/><line id="l2" name="2" range="t2_d1..t9_d1"/></layoutinfo><shifttags></shifttags><token id="t1" trans="a"><dipl id="t1_d1" trans="a"/><mod id="t1_m1" trans="a" checked="y"></mod></token></text>', 't1_m1:a:a:true:morph=--:', 't1_m1:a:a:true::', 'Datum: 1'),
])
def anselm_steps(df: DataFrame) -> DataFrame:
    """The Anselm corpus's step on tokens, the way back to the editor, and its step on documents."""
    metadata = df.sparkSession.createDataFrame([("S1", "1400", "Ulm")], "Sigle string, Zeit string, Ort string")

    def made(c: Corpus) -> DataFrame:
        done = modify.pipeline(modify.anselm_document(metadata), modify.anselm_finished, modify.unchanged)(c)
        back = modify.on_tags(*modify.PREPARE_FOR_UPLOAD)(done)
        header = F.replace("header_string", F.lit("\n"), F.lit(" | "))
        return together(c, anno_rows(done).withColumnRenamed("annos", "finished"), anno_rows(back).withColumnRenamed("annos", "back"), done.documents.select(KEY, header.alias("header")))

    return of_corpus(df, dualxml(strict=False), made)


@golden("converted finished tokens dipls", [
    ('<text><cora-header sigle="S1" name="N"/><header>a:b</header><layoutinfo><page id="p1" no="1" side="r" range="c1"/><column id="c1" range="l1..l2"/><line id="l1" name="1" range="t1_d1"/><line id="l2" name="2" range="t2_d1..t9_d1"/></layoutinfo><shifttags></shifttags><token id="t1" trans="(&quot;)owe(,)"><dipl id="t1_d1" trans="(&quot;)owe(,)"/><mod id="t1_m1" trans="(&quot;)"/><mod id="t1_m2" trans="owe" checked="y"><pos tag="NN"/><lemmapos tag="NE"/><morph tag="Sg"/><lemma tag="owe [O1]"/></mod><mod id="t1_m3" trans="(,)"/></token><token id="t2" trans="a"><dipl id="t2_d1" trans="a"/><mod id="t2_m1" trans="a" checked="n"><pos tag="VVFIN"/><lemma tag="gehen"/><morph tag="a.b.c.d.*"/></mod></token><token id="t9" trans="b|c"><dipl id="t9_d1" trans="b|c"/><mod id="t9_m1" trans="b|"><pos tag="X&lt;Y"/></mod><mod id="t9_m2" trans="c"/></token></text>', 't1_m2:owe:owe:true:boundary=(") | (,);lemma=owe [O1];pos=NN<NE.Sg:boundary ~ t2_m1:a:a:false:lemma=gehen;pos=VVFIN.a.b.c.d.*: ~ t9_m1:b|:b:false:pos=X<Y: ~ t9_m2:c:c:false::', 't1_m2:owe:owe:true:annoType=man;lemma=owe;lemmaId=[O1];lemmaURL=http://www.woerterbuchnetz.de/DWB?lemid=O1;lemmapos=NE;morph=Sg;pos=NN;punc=(") | (,):punc ~ t2_m1:a:a:false:annoType=auto;lemma=gehen;lemmaURL=http://www.woerterbuchnetz.de/DWB?lemma=gehen;morph=a.b.c.d.Unr;pos=VVFIN: ~ t9_m1:b|:b:false:annoType=auto;pos=X;posLemma=Y;token_type=MS1: ~ t9_m2:c:c:false:annoType=auto;token_type=MS2:', 'owe ~ a ~ b|c', 't1_d1:owe:owe:1 ~ t2_d1:a:a:2 ~ t9_d1:b|c:bc:2'),
])
def reference_steps(df: DataFrame) -> DataFrame:
    """The reference corpus's first and last steps, sentence marks folded out of tokens and dipls."""

    def made(c: Corpus) -> DataFrame:
        one, last = modify.ref_converted(c), modify.ref_finished(c)
        tokens = rows_of(last.tokens, ["tok_ord"], "trans", into="tokens")
        return together(c, anno_rows(one).withColumnRenamed("annos", "converted"), anno_rows(last).withColumnRenamed("annos", "finished"), tokens, dipl_rows(last))

    return of_corpus(df, dualxml("ref", strict=False), made)


@golden("tokens dipls annos glued", [
    ('+H\nSigle: S\n@H\nS-1r,1\ta= b|c d= e\nS-1r,2\tf g=\n', '1:a=b|c ~ 3:d=e ~ 5:f ~ 6:g=', '1:1:a=:1 ~ 1:2:b|c:1 ~ 3:1:d=:1 ~ 3:2:e:1 ~ 5:1:f:2 ~ 6:1:g=:2', '1:1:a= ~ 1:2:b| ~ 1:3:c ~ 3:1:d= ~ 3:2:e ~ 5:1:f ~ 6:1:g=', '1:1:a=b|:ab ~ 1:2:c:c ~ 3:1:d=e:de ~ 5:1:f:f ~ 6:1:g=:g'),
    ('+H\nSigle: S\n@H\nS-1r,1\tx= y= z\n', '1:x=y=z', '1:1:x=:1 ~ 1:2:y=:1 ~ 1:3:z:1', '1:1:x= ~ 1:2:y= ~ 1:3:z', '1:1:x=y=z:xyz'),
])
def merged_corpus(df: DataFrame) -> DataFrame:
    """Tokens that end in a plus of their own joined to the next: dipls follow, annos follow or are glued."""

    def made(c: Corpus) -> DataFrame:
        goes_on = F.lag(F.col("trans").endswith("="), 1).over(modify.Window.partitionBy(KEY).orderBy("tok_ord"))
        tokens = c.tokens.withColumn("goes_on", goes_on)
        marked = c.having(tokens=tokens)
        plain, glued = (modify.tokens_merged(marked, F.col("goes_on"), g) for g in (False, True))
        return together(
            c, rows_of(plain.tokens, ["tok_ord"], "tok_ord", "trans", into="tokens"), rows_of(plain.dipls, ["dipl_ord"], "tok_ord", "dipl_in_tok", "trans", "line_ord", into="dipls"),
            rows_of(plain.annos, ["anno_ord"], "tok_ord", "anno_in_tok", "trans", into="annos"), rows_of(glued.annos, ["anno_ord"], "tok_ord", "anno_in_tok", "trans", "simple", into="glued"),
        )

    return of_corpus(df, trans(), made)


@golden("begins ends", [
    ('+H\nSigle: M1_x\nTitel: a:b\n@H\n\nM1-1ra,01\tfoo|bar test. +K note @K +F baz\nM1-1ra,02\tlange(=)\n\tzeile@F ende $o\nM1-1rb,01\tvn\\- <<...>> *[weg*]\n', 'foo|bar:pcl ~ test.: ~ baz: ~ lange(=):l ~ zeile:l ~ ende: ~ $o: ~ vn\\-:cl ~ <<...>>: ~ *[weg*]:', 'foo|bar: ~ test.: ~ baz:l ~ lange(=):l ~ zeile: ~ ende: ~ $o:cl ~ vn\\-: ~ <<...>>: ~ *[weg*]:pcl'),
    ('+H\nSigle: S2\n@H\nS2-1v,1\ta [b] +L c +R d @R @L\nS2-2r,1\t<e>=\nS2-2r,2\t<f> +E last @E\n', 'a:pcl ~ [b]: ~ c: ~ d: ~ <e>=:pcl ~ <f>:l', 'a: ~ [b]: ~ c: ~ d:pcl ~ <e>=:l ~ <f>:pcl'),
])
def placed_parts(df: DataFrame) -> DataFrame:
    """Dipls with their line, column and page, and which of them begin and end one."""

    def made(c: Corpus) -> DataFrame:
        rows = placed_dipls(c)
        units = lambda which: F.concat_ws("", *[F.when(F.col(f"{u}_{which}"), u[0]) for u in ("page", "col", "line")])
        return together(c, rows_of(rows, ["dipl_ord"], "trans", units("begins"), into="begins"), rows_of(rows, ["dipl_ord"], "trans", units("ends"), into="ends"))

    return of_corpus(df, trans(), made)


@golden("dipls", [
    ('+H\nSigle: M1_x\nTitel: a:b\n@H\n\nM1-1ra,01\tfoo|bar test. +K note @K +F baz\nM1-1ra,02\tlange(=)\n\tzeile@F ende $o\nM1-1rb,01\tvn\\- <<...>> *[weg*]\n', 'd1:foo|bar:foobar:1 ~ d2:test.:test.:1 ~ d3:baz:baz:1 ~ d4:lange(=):lange:2 ~ d5:zeile:zeile:3 ~ d6:ende:ende:3 ~ d7:$o:ſo:3 ~ d8:vn\\-:vn̄:4 ~ d9:<<...>>:[...]:4 ~ d10:*[weg*]:weg:4'),
    ('+H\nSigle: S2\n@H\nS2-1v,1\ta [b] +L c +R d @R @L\nS2-2r,1\t<e>=\nS2-2r,2\t<f> +E last @E\n', 'd1:a:a:1 ~ d2:[b]:[...]:1 ~ d3:c:c:1 ~ d4:d:d:1 ~ d5:<e>=:e=:2 ~ d6:<f>:f:3'),
])
def files_round_trip(df: DataFrame) -> DataFrame:
    """Documents written as files, a folder each, and read from there by format and dialect."""

    def made(c: Corpus) -> DataFrame:
        spark = c.documents.sparkSession
        folder = f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"
        write_corpus(c, folder, "trans")
        again = read_corpus(spark, folder, "trans", "anselm")
        return dipl_rows(again).withColumn(KEY, F.regexp_extract(KEY, "^document=([^/]*)/", 1))

    return of_corpus(df, trans(), made)


@golden("note", [
    ('A1', 'x y'),
    ('B2', '-'),
    ('C3', '-'),
])
def side_table(df: DataFrame) -> DataFrame:
    """A table of tab-separated strings, read from a file and joined by sigle."""
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    spark.createDataFrame([("A1", "x y"), ("B2", None)], "sigle string, note string").write.csv(folder, sep="\t", header=True)
    table = headers.read_side_table(spark, folder, ["sigle", "note"])
    return df.withColumnRenamed("given", "sigle").join(table, "sigle", "left").select("doc_id", F.coalesce("note", F.lit("-")).alias("note"))
