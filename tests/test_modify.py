"""Steps on annotations and headers that the queries don't cover."""

from pyspark.sql import functions as F

from scriptorium.model import SHIFT_TAGS, shift_tag
from scriptorium.operators import bounds, headers, layout, modify, validate
from scriptorium.sources.trans import read_trans


def tags(spark, rows):
    return spark.createDataFrame([(i, t, c) for i, (t, c) in enumerate(rows)], "i int, tags map<string,string>, checked boolean")


def test_reference_corpus_steps(spark):
    df = tags(spark, [({"pos": "VVFIN<VV", "lemma": "gehen [G123]", "morph": "3.Sg.Pres.Ind.*"}, True), ({"pos": "NN", "lemma": "haus"}, False)])
    one, two = (r.tags for r in modify.ref_postprocess(df).orderBy("i").collect())
    assert one == {
        "pos": "VVFIN", "posLemma": "VV", "lemma": "gehen", "lemmaId": "[G123]", "lemmaURL": "http://www.woerterbuchnetz.de/DWB?lemid=G123",
        "morph": "3.Sg.Pres.Ind.Unr", "annoType": "man",
    }
    assert two == {"pos": "NN", "lemma": "haus", "lemmaURL": "http://www.woerterbuchnetz.de/DWB?lemma=haus", "annoType": "auto"}
    linked = modify.ref_postprocess(df, link=True).where("i = 1").first().tags["lemmaURL"]
    assert linked == "<a href='http://www.woerterbuchnetz.de/DWB?lemma=haus'>haus</a>"
    back = modify.changed(tags(spark, [({"pos": "A", "lemmapos": "B", "morph": "C"}, True)]), *modify.REF_CONVERT).first().tags
    assert back == {"pos": "A<B.C"}


def test_anselm_steps_and_their_inverse(spark):
    df = tags(spark, [({"norm": "und", "norm_type": "f", "pos": "PDN", "comment": "x", "boundary": "y"}, True), ({}, False)])
    done = modify.changed(df, *modify.ANSELM_POSTPROCESS)
    assert [r.tags for r in done.orderBy("i").collect()] == [
        {"norm": "und", "norm_broad": "und", "norm_type": "inflection", "pos": "PDS", "morph": "--"}, {"morph": "--"},
    ]
    back = modify.changed(done, *modify.PREPARE_FOR_UPLOAD)
    assert [r.tags for r in back.orderBy("i").collect()] == [{"norm": "und", "norm_type": "f", "pos": "PDS"}, {}]


def test_split_keeps_the_source_if_it_is_a_result(spark):
    df = tags(spark, [({"a": " x . . y . z"}, True), ({"a": "x"}, True), ({}, True)])
    shown = lambda *names: [r.t for r in df.select("i", modify.split(F.col("tags"), *names).alias("t")).orderBy("i").collect()]
    assert shown("a", "b", "c") == [{"b": "x", "c": "y"}, {"b": "x"}, {}]
    assert shown("a", "b", "a") == [{"b": "x", "a": "y"}, {"a": "x", "b": "x"}, {}]


def test_pipeline_on_words(spark, tmp_path):
    text = "+H\nSigle: S1\n@H\nS1-1r,01\ta|b(.) c.\n"
    corpus = read_trans(spark.createDataFrame([("d", text)], "doc_key string, text string"), "anselm").stored(str(tmp_path))
    steps = modify.pipeline(modify.on_words(modify.verbation_tags, modify.punct_fold, modify.punct_pos), modify.on_tags(lambda t: modify.fill(t, "x", "1")), modify.unchanged)
    rows = steps(corpus).annos.orderBy("anno_ord").collect()
    assert [(r.trans, r.tags) for r in rows] == [
        ("a|", {"token_type": "MS1", "x": "1"}), ("b", {"token_type": "MS2", "punc": "(.)", "x": "1"}), ("c", {"x": "1"}), (".", {"pos": "$(", "x": "1"}),
    ]
    assert [r.anno_ord for r in rows] == [1, 2, 3, 4] and rows[1].flags == ["punc"]


def test_retokenised(spark, tmp_path):
    text = "+H\nSigle: S1\n@H\nS1-1r,01\tab(=)\nS1-1r,02\tcd ef\n"
    corpus = read_trans(spark.createDataFrame([("d", text)], "doc_key string, text string"), "anselm").stored(str(tmp_path))
    wrong = F.when(F.col("tok_ord") == 1, F.array(F.lit("err_nr_dipl"))).otherwise(F.array().cast("array<string>"))
    one = corpus.dipls.where("dipl_in_tok = 1").withColumn("trans", F.when(F.col("tok_ord") == 1, "ab(=)cd").otherwise(F.col("trans")))
    fixed = modify.retokenised(corpus.having(tokens=corpus.tokens.withColumn("errors", wrong), dipls=one.drop("chars")))
    rows = fixed.dipls.orderBy("dipl_ord").collect()
    assert [(r.trans, r.line_ord, r.dipl_id) for r in rows] == [("ab(=)", 1, "t1_d1"), ("cd", 2, "t1_d2"), ("ef", 2, "d3")]


def test_merged_tokens(spark):
    rows = [("d", 1, "a", [], ["e"]), ("d", 2, "b", [], []), ("d", 3, "c", [], ["e", "f"])]
    df = spark.createDataFrame(rows, "k string, o int, trans string, chars array<int>, errors array<string>")
    made = modify.merged_tokens(df, "k", "o", F.col("o") == 3).orderBy("o").collect()
    assert [(r.trans, r.errors) for r in made] == [("a", ["e"]), ("bc", ["e", "f"])]


def test_headers_and_sigles(spark):
    df = spark.createDataFrame([("Sigle: M1_a\nx:1:2\nx:3\nplain",), ("",), (None,), ("no",)], "h string")
    rows = df.select(headers.parse_header(F.col("h")).alias("m"), headers.sigle(F.col("h")).alias("s")).collect()
    assert rows[0].m == {"Sigle": [" M1_a"], "x": ["3"], "plain": []} and rows[0].s == "M1"
    assert rows[1].m == {} and rows[1].s is None and rows[2].m == {} and rows[3].s is None
    side = spark.createDataFrame([("F019", "n1")], "sigle string, note string")
    docs = spark.createDataFrame([("F019x",), ("G1",)], "sigle string")
    assert {r.sigle: (r.note, r.missing) for r in headers.looked_up(docs, side, "note").collect()} == {"F019x": ("n1", False), "G1": (None, True)}


def test_marks_of_places(spark):
    marks = ["M1-1207", "M1-12ra,07", "sig_le_3vb,12", "bad", None]
    rows = spark.createDataFrame([(m,) for m in marks], "m string").select(layout.parse_bibinfo(F.col("m")).alias("b")).collect()
    assert [tuple(r.b) if r.b else None for r in rows] == [("M1", "120", "", "", "7"), ("M1", "12", "r", "a", "07"), ("sig_le", "3", "v", "b", "12"), None, None]
    lines = spark.createDataFrame([("d", i, m) for i, m in enumerate([None, "S-1r,98", None, "bad", "S-1r,5", None])], "k string, o int, m string")
    filled = layout.fill_bibinfo(lines, "k", "o", "m").orderBy("o").collect()
    assert [r.orphan for r in filled] == [True] + [False] * 5
    assert [r.line for r in filled] == [None, "98", "99", "100", "5", "06"] and [r.malformed for r in filled] == [False, False, False, True, False, False]


def test_layout_problems(spark):
    rows = [("d", 1, "d1..d2"), ("d", 2, "d1..d9"), ("d", 3, ""), ("d", 4, "d7")]
    elements = spark.createDataFrame(rows, "k string, ord int, range string")
    members = spark.createDataFrame([("d", "d1", 1), ("d", "d2", 2)], "k string, name string, o int")
    found = layout.resolved(elements, members, "k", "name", "o").withColumn("kind", F.lit("line"))
    codes = {(r.item_ord, r.code) for r in layout.layout_problems(found, "k").collect()}
    assert codes == {(1, "repeated_begin"), (2, "repeated_begin"), (2, "range_end_missing"), (3, "empty_range"), (4, "range_start_missing"), (4, "range_end_missing")}


def test_adjacency_legacy_and_shift_tags(spark):
    from scriptorium.functions.dialects import parsed

    df = parsed(spark.createDataFrame([("hymel(=)|reich",), ("a(=)b",), ("a|=b",), ("a=|b",)], "trans string"), "anselm")
    rows = {r.trans: (r.d, r.l) for r in df.select("trans", validate.token_errors().alias("d"), validate.token_errors(legacy=True).alias("l")).collect()}
    assert rows["hymel(=)|reich"] == (["contradictory_bounds"], [])
    assert rows["a(=)b"] == (["not_at_line_end"], [])
    assert rows["a|=b"] == (["erroneous_bound"], ["erroneous_bound"])
    assert rows["a=|b"] == (["not_at_line_end"], ["not_at_line_end"])
    kinds = spark.createDataFrame([(k,) for k in [*SHIFT_TAGS, "X"]], "k string").select("k", shift_tag(F.col("k")).alias("t")).collect()
    assert {r.k: r.t for r in kinds} == SHIFT_TAGS | {"X": "X"}


def test_keep_and_has(spark):
    from scriptorium.functions.dialects import parsed

    row = parsed(spark.createDataFrame([("<a>.",)], "trans string"), "anselm").select(
        bounds.form(bounds.keep(F.col("chars"), "Bracket"), "string").alias("b"), bounds.form(bounds.keep(F.col("chars"), "MetaChar", drop=True), "string").alias("r"),
        bounds.has(F.col("chars"), "Punct").alias("p"), bounds.has(F.col("chars"), "Lacuna").alias("l"),
    ).first()
    assert (row.b, row.r, row.p, row.l) == ("<>", "a.", True, False)
