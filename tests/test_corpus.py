"""Sources and sinks: a transcription through the tables to every format, and back."""

import io
import json
import xml.etree.ElementTree as ET
import zipfile

import pytest
from pyspark.sql import functions as F

from scriptorium.model import Corpus
from scriptorium.operators import chunks, headers, modify
from scriptorium.sinks import exported
from scriptorium.sinks.trans import editor_json
from scriptorium.sources import read_corpus
from scriptorium.sources.bonnxml import HEADER, aligned, header_element, header_entries, header_xml, preprocessed, read_bonnxml
from scriptorium.sources.dualxml import read_dualxml
from scriptorium.sources.docx import docx_text
from scriptorium.sources.trans import read_trans

TEXT = (
    "+H\nSigle: M1_x\nTitel: a:b\n@H\n\nM1-1ra,01\tfoo|bar test. +K note @K +F baz\nM1-1ra,02\tlange(=)\n\tzeile@F ende $o\n"
    "M1-1rb,01\tvn\\- <<...>> *[weg*]\n"
)


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory) -> Corpus:
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    rows = [("d1", TEXT), ("d2", "+H\n@H\nX-1r,1\tbad[ token\n"), ("d3", ""), ("d4", None)]
    read = read_trans(spark.createDataFrame(rows, "doc_key string, text string"), "anselm")
    yield read.stored(str(tmp_path_factory.mktemp("corpus")))
    spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_tables(corpus):
    docs = {r.doc_key: r for r in corpus.documents.collect()}
    assert docs["d1"].sigle == "M1" and docs["d1"].valid and docs["d1"].header == {"Sigle": [" M1_x"], "Titel": [" a", "b"]}
    assert not docs["d2"].valid and not docs["d3"].valid and not docs["d4"].valid  # without a line of tokens
    lines = [(r.line_ord, r.col_ord, r.name) for r in corpus.lines.where("doc_key = 'd1'").orderBy("line_ord").collect()]
    assert lines == [(1, 1, "01"), (2, 1, "02"), (3, 1, "03"), (4, 2, "01")]
    dipls = corpus.dipls.where("doc_key = 'd1'").orderBy("dipl_ord").collect()
    assert [(d.trans, d.line_ord) for d in dipls][3:5] == [("lange(=)", 2), ("zeile", 3)]
    tags = corpus.shift_tags.collect()
    assert [(t.tag, t.first_tok_ord, t.last_tok_ord) for t in tags] == [("fm", 3, 4)]
    found = sorted((r.doc_key, r.code) for r in corpus.diagnostics.collect())
    empty = [(d, c) for d in ("d3", "d4") for c in ("document_empty", "header_empty")]
    assert found == [("d2", "bracket_not_closed"), ("d2", "header_empty"), *empty]


def test_trans_round_trip(spark, corpus):
    text = exported(corpus, "trans").where("doc_key = 'd1'").first().text
    assert text.splitlines()[5] == "M1-1ra,01\tfoo|bar test. +K note @K baz"
    again = read_trans(spark.createDataFrame([("d1", text)], "doc_key string, text string"), "anselm")
    keep = ["trans", "utf", "line_ord"]
    assert again.dipls.orderBy("dipl_ord").select(*keep).collect() == corpus.dipls.where("doc_key = 'd1'").orderBy("dipl_ord").select(*keep).collect()
    simple = exported(corpus, "trans", form="anno_simple").where("doc_key = 'd1'").first().text
    assert "foo bar test ." in simple


def test_dualxml_round_trip(spark, corpus, tmp_path):
    first = exported(corpus, "coraxml").where("doc_key = 'd1'").first().text
    files = spark.createDataFrame([("d1", first), ("bad", "<no")], "doc_key string, content string")
    again = read_dualxml(files, "anselm").stored(str(tmp_path))
    assert exported(again, "coraxml").collect()[0].text == first
    assert {(r.doc_key, r.code) for r in again.diagnostics.collect()} == {("bad", "not_xml")}


def test_dualxml_strict(spark, tmp_path):
    xml = (
        '<text><cora-header sigle="S" name="N"/><header>a:b</header><layoutinfo><page id="p1" no="1" range="c1"/><column id="c1" range="l1"/>'
        '<line id="l1" name="1" range="d1..d2"/></layoutinfo><shifttags><fm range="t9"/></shifttags><token id="t1" trans="foobar">'
        '<dipl id="d1" trans="foo"/><dipl id="d2" trans="bar"/><mod id="m1" trans="foobar" checked="y"><pos tag="NN"/><cora-flag name="z"/></mod></token></text>'
    )
    files = spark.createDataFrame([("x", xml)], "doc_key string, content string")
    strict, loose = read_dualxml(files, "anselm").stored(f"{tmp_path}/a"), read_dualxml(files, "anselm", strict=False).stored(f"{tmp_path}/b")
    assert not strict.documents.first().valid and loose.documents.first().valid
    assert "err_nr_dipl" in loose.tokens.first().errors
    assert [d.trans for d in loose.dipls.orderBy("dipl_ord").collect()] == ["foo", "bar"]
    anno = loose.annos.first()
    assert anno.tags == {"pos": "NN"} and anno.flags == ["z"] and anno.checked
    assert {r.code for r in loose.diagnostics.collect()} == {"err_nr_dipl", "shift_tag_without_token"}


def test_gate_offsets_fit(corpus):
    made = json.loads(exported(corpus, "gatejson").where("doc_key = 'd1'").first().text)
    for kind in ("Token:Dipl", "Token:Anno"):
        for e in made["entities"][kind]:
            start, end = e["indices"]
            assert made["text"][start:end].replace("\n", "") == e["utf"], e
    assert made["entities"]["Shifttags:fm"][0]["indices"] == [13, 28]


def test_markdown_and_tei(corpus):
    rows = exported(corpus, "markdown").where("doc_key = 'd1'").first().text.split("  \n")
    assert rows[4] == "1ra,01 | foobar test. ^[note] baz" and rows[-1].endswith("^[Lücke] ~~weg~~")
    root = ET.fromstring(exported(corpus, "tei").where("doc_key = 'd1'").first().text)
    assert [e.get("n") for e in root.iter("lb")] == ["01", "02", "03", "01"]
    words = ["".join(w.itertext()).replace("\n", "") for w in root.iter("w")]
    assert words[:6] == ["foo", "bar", "test", ".", "baz", "langezeile"]
    assert [w.get("join") for w in root.iter("w")][:2] == ["right", "left"]


def test_unknown_formats(spark, corpus):
    with pytest.raises(ValueError):
        exported(corpus, "none")
    with pytest.raises(ValueError):
        read_corpus(spark, "/nowhere", "none")


def test_read_folder(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("﻿" + TEXT, encoding="utf-8")
    read = read_corpus(spark, str(tmp_path / "in"), "trans", "anselm", store=str(tmp_path / "out"))
    assert read.documents.select("doc_key", "sigle", "valid").collect() == [("a", "M1", True)]


def test_files_of_one_name_keep_apart(spark, tmp_path):
    for folder, word in (("a", "one"), ("b", "two")):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "t.v1.txt").write_text(f"+H\nSigle: {word}\n@H\nX-1r,01\t{word}\n", encoding="utf-8")
    read = read_corpus(spark, str(tmp_path), "trans", "anselm")
    assert sorted((r.doc_key, r.trans) for r in read.tokens.collect()) == [("a/t.v1", "one"), ("b/t.v1", "two")]


def test_editor_json(corpus):
    rows = editor_json(corpus.tokens.where("doc_key = 'd1' and tok_ord in (1, 4)").select("tok_ord", "chars")).orderBy("tok_ord").collect()
    one, two = (json.loads(r.json) for r in rows)
    assert one["mod_trans"] == ["foo|", "bar"] and one["dipl_utf"] == ["foobar"]
    assert two["dipl_trans"] == ["lange(=)", "zeile"] and two["dipl_breaks"] == [1, 0] and two["mod_ascii"] == ["langezeile"]


def test_chunk_diagnostics_and_clashing_key(spark):
    df = spark.createDataFrame([(1, "+K a @E x +F y @R\tq\n")], "kind int, t string")
    stream = chunks.chunks(df.withColumnRenamed("kind", "k"), "k", "t")
    assert [r.kind for r in stream.orderBy("chunk_ord").collect()][:4] == ["comment", "space", "token", "space"]
    codes = {r.code for r in chunks.diagnostics(stream, "k").collect()}
    assert codes == {"comment_mismatch", "comment_not_after_blank", "shift_tag_mismatch", "tab_between_tokens"}


def test_verbation_tags_and_punct_fold(spark, corpus):
    df = spark.createDataFrame([("a|b|c",), ("x#y=z",), ("foo(.)",), ('(")foo',)], "trans string")
    from scriptorium.functions.dialects import parsed
    from scriptorium.operators import bounds

    empty = F.expr("cast(map() as map<string,string>)")
    made = bounds.tokenised(parsed(df, "anselm")).withColumn(
        "annos", F.transform("annos", lambda a: a.withField("tags", empty).withField("flags", F.expr("cast(array() as array<string>)")))
    )
    rows = {r.trans: r for r in made.select("trans", modify.verbation_tags(F.col("annos")).alias("v"), modify.punct_fold(F.col("annos")).alias("p")).collect()}
    assert [a.tags.get("token_type") for a in rows["a|b|c"].v] == ["MS1", "MS2", None]
    assert rows["x#y=z"].v[0].tags["token_type"] == "US UH"
    shown = lambda t: [(a.trans, a.tags, a.flags) for a in rows[t].p]
    assert shown("foo(.)") == [("foo", {"punc": "(.)"}, ["punc"])]
    assert shown('(")foo') == [("foo", {"punc": '(") |'}, ["punc"])]


def test_headers(spark):
    text = "Korpus-Sigle: F019, IV-Ba-P1 (H)\nTitel: T\nDruckort: Ulm\nAuswahl Referenzkorpus: 1r\nErgänzung Referenzkorpus: 2v"
    docs = spark.createDataFrame([("d", text), ("e", "Titel: ---")], "doc_key string, header_string string")
    notes = spark.createDataFrame([("F019", "n")], "s string, n string")
    short = spark.createDataFrame([("ABC", "F019")], "a string, s string")
    rows = {r.doc_key: r.header_string.split("\n") for r in headers.reference_header(docs, notes, short).collect()}
    assert {"time: 16,1", "language-area: oberrheinisch", "medium: Handschrift", "place: -", "text-place: Ulm", "abbr_ddd: ABC"} <= set(rows["d"])
    assert "extent: FnhdC: -; compl: 1r, 2v" in rows["d"] and "text: -" in rows["e"] and "notes-transcription: -" in rows["e"]


def test_bonn(spark, tmp_path):
    assert preprocessed(["a | b||c", "foo(=)bar baz", "du foo(=)bar", "x", "a=b"]) == ["a|b|c", "foo(=)bar baz", "du foo(=)", "bar x", "a=b"]
    assert preprocessed(["uil=|", "|er und", "x"]) == ["uil=|", "er und", "x"]  # uil=||er, cut again after the joiner
    assert preprocessed(["du ab|", "cd ef", "x<=>|y", "z"]) == ["du ab|cd", "ef", "x<=>|", "y z"]
    assert preprocessed(["ab |", "cd"]) == ["ab|", "cd"]  # the last word of the text
    assert aligned(["foo", "bar", "."], ["foo|bar."]) == [0, 0, None]
    xml = (
        '<text sigle="B1"><general><title val="T"/></general><page no="1"><side no="r"><column no="a"><line><token><form trans="foo" normu="fu"/>'
        '<lemma inst="l"/><pos inst="NN"/><infl val="a_b"/></token><token><form trans="bar"/></token></line></column></side></page></text>'
    )
    made = read_bonnxml(spark.createDataFrame([("b", xml.encode())], "doc_key string, content binary"), "anselm").stored(str(tmp_path))
    first, second = made.annos.orderBy("anno_ord").collect()
    assert first.tags["norm"] == "fu" and first.tags["infl"] == "a.b" and second.tags["lemma"] == "--" and "pos" not in second.tags
    assert made.documents.first().valid and made.documents.first().header["text"] == [" T"]
    root = ET.fromstring(xml)
    assert header_entries(root)["text"] == "T" and [e.tag for e in header_element(root)] == [name for _, _, name in HEADER]
    assert header_xml(root).startswith("<header><text>T</text><abbr_ddd />")


def test_docx():
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = (
        f'<w:document xmlns:w="{w}"><w:body><w:p><w:r><w:rPr><w:i/></w:rPr><w:t>Sigle: D1</w:t></w:r></w:p>'
        "<w:p><w:r><w:t>[12r,03] foo </w:t></w:r><w:r><w:rPr><w:highlight/></w:rPr><w:t>bar</w:t></w:r></w:p><w:p><w:r><w:t>baz</w:t></w:r></w:p></w:body></w:document>"
    )
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("word/document.xml", body)
    assert docx_text(data.getvalue(), "D1").splitlines() == ["+H", "Sigle: D1", "@H", "D1-12r,03\tfoo +Q bar", "D1-12r,04\t@Qbaz"]


def test_stream(spark, tmp_path):
    from scriptorium.streaming.ingest import ingest, stored

    (tmp_path / "in").mkdir()
    for n in (1, 2):
        (tmp_path / "in" / f"d{n}.txt").write_text(TEXT, encoding="utf-8")
        ingest(spark, str(tmp_path / "in"), str(tmp_path / "store"), str(tmp_path / "state"), "anselm").awaitTermination()
    assert sorted(r.doc_key for r in stored(spark, str(tmp_path / "store")).documents.collect()) == ["d1", "d2"]


def test_plain_texts_take_little_of_the_shared_folder(spark, tmp_path):
    import os

    from scriptorium.plans.text_queries import trans_corpus
    from scriptorium.session import shared_folder

    folder = shared_folder(spark).removeprefix("file:")
    size = lambda: sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(folder) for f in files)
    text = "\n".join(" ".join(f"wort{i % 97}" for i in range(n, n + 50)) for n in range(100)) + "\n{a\nb\nc} x=\ny\n"
    spark.createDataFrame([(n, text) for n in range(20)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    before = size()
    rows = trans_corpus(spark, str(tmp_path)).collect()
    assert size() - before < 2 * 20 * len(text)  # a row a text, not a row a chunk
    n_chars = sum(len(w) for w in text.split("\n{")[0].split()) + len("x=y")
    assert [(r.n_lines, r.n_tokens, r.n_annos, r.n_chars) for r in rows] == [(101, 5001, 5001, n_chars)] * 20


def test_whole_tokens_are_as_parsed_ones(spark):
    from scriptorium.functions.dialects import parsed
    from scriptorium.operators import bounds
    from scriptorium.operators.validate import token_errors

    given = ["foo", "wor=\nden", "wor=\t\n den", "a b", " x", "\n", " \t", "", "\n \n x", "𝔞b\n", "a.|b#c", "(=)", None]
    df = spark.createDataFrame([(t,) for t in given], "trans string")
    old = bounds.tokenised(parsed(df.where("trans is not null"), "plain")).withColumn("errors", token_errors())
    old = {r.trans: (r.kept, r.chars, r.errors, r.dipls, r.annos) for r in old.withColumn("kept", bounds.trans(F.col("chars"))).collect()}
    new = {r.trans: r for r in bounds.whole(df).collect()}
    assert new.pop(None).chars is None and set(new) == set(old)
    for t, r in new.items():
        assert (r.kept, r.chars, r.errors, [r.dipl] * bool(r.kept), [r.anno] * bool(r.kept)) == old[t], t


def test_chunks_and_their_lines(spark):
    import random
    import re

    # the kinds in order, tokens after marks; no text here has other white space than blanks, tabs and line ends
    token, join = r"[^\s{+@][^\s+@]*", r"\[?\[?(?:\(=\)|=\||=)\]?\]?[ \t]*\n[ \t]*"
    plain = re.compile(rf"\+[KEZ][^\n@]+@[KEZ]|\+[FLRÜMQ]p?|@[FLRÜMQ]p?|{token}{join}{token}|{token}|\{{[^}}*÷]+\}}|[ \t]|[ \t]*\n[ \t]*")
    dice = random.Random(1)
    texts = ["".join(dice.choice(["a", "b", "=", "=|", "(=)", "[", "]", " ", "\t", "\n", "\n", "+", "@", "F", "K", "{", "}", "+K x @K"]) for _ in range(60)) for _ in range(200)]
    texts += ["", "\n", "\n\n", "a", "{1\n\n2}\nb {c\nd} e\nf", "a=\n\nb", "a=\n{x}", "a\n"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    expected = []
    for i, t in enumerate(texts):
        line = 1
        for k, m in enumerate(plain.finditer(t)):
            expected.append((i, k, m.group(), line))
            line += m.group().count("\n")
    assert sorted(tuple(r) for r in chunks.chunks(df, "id", "t", lines=True).select("id", "chunk_ord", "raw", "base_line").collect()) == expected
    assert sorted(tuple(r) for r in chunks.chunks(df, "id", "t").select("id", "chunk_ord", "raw").collect()) == [e[:3] for e in expected]
