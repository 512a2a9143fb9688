"""Golden tokens through dialects, bounds and checks, and a sequential walk against the bounds by position."""

import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from scriptorium.functions.chars import signs
from scriptorium.functions.dialects import dialect, parse_ren, parse_rex, parsed
from scriptorium.functions.replacements import ACCENTED, PLAIN, REPLACEMENTS
from scriptorium.model import BIT
from scriptorium.operators import bounds
from scriptorium.operators.validate import token_errors

#: token: diplomatic pieces, annotatable pieces, simple forms, errors
GOLDEN = {
    "foo": (["foo"], ["foo"], ["foo"], []),
    "foo|bar": (["foo|bar"], ["foo|", "bar"], ["foo", "bar"], []),
    "test.": (["test."], ["test", "."], ["test", "."], []),
    "f%.oo": (["f%.oo"], ["f%.oo"], ["f.oo"], []),
    "foo%.": (["foo%."], ["foo", "%."], ["foo", "."], []),
    "<wa>=<ren>": (["<wa>=", "<ren>"], ["<wa>=<ren>"], ["waren"], []),
    "w[[a=]]ren": (["w[[a=]]", "ren"], ["w[[a=]]ren"], ["waren"], []),
    '(")foo': (['(")foo'], ['(")', "foo"], ['(")', "foo"], []),
    'foo(")': (['foo(")'], ["foo", '(")'], ["foo", '(")'], []),
    "foo(.)|bar": (["foo(.)|bar"], ["foo(.)|", "bar"], ["foo(.)", "bar"], []),
    "a,.": (["a,."], ["a", ",", "."], ["a", ",", "."], []),
    "*1.": (["*1."], ["*1", "."], ["", "."], []),
    "foo#bar": (["foo#", "bar"], ["foo#bar"], ["foobar"], []),
    "*[foo*]": (["*[foo*]"], [], [], []),
    "$chon": (["$chon"], ["$chon"], ["schon"], []),
    "vn\\-": (["vn\\-"], ["vn\\-"], ["vnd"], []),
    "wa$\\$er": (["wa$\\$er"], ["wa$\\$er"], ["wasser"], []),
    "hymel(=)|reich": (["hymel(=)", "|reich"], ["hymel(=)|", "reich"], ["hymel", "reich"], ["contradictory_bounds"]),
    "different(=)text": (["different(=)", "text"], ["different(=)text"], ["differenttext"], ["not_at_line_end"]),
    "foo[": (["foo["], ["foo["], ["foo"], ["bracket_not_closed"]),
    "foo]": (["foo]"], ["foo]"], ["foo"], ["bracket_not_opened"]),
    "a_b€": (["a_b€"], ["a_b€"], ["ab€"], ["invalid_characters:€"]),
}


def test_golden_tokens(spark):
    df = spark.createDataFrame([(t,) for t in GOLDEN], "trans string")
    names = lambda c, f: F.transform(c, lambda x: x[f])
    rows = bounds.tokenised(parsed(df, "anselm")).select(
        "trans", names("dipls", "trans").alias("d"), names("annos", "trans").alias("a"), names("annos", "simple").alias("s"), token_errors().alias("e")
    )
    for r in rows.collect():
        assert (r.d, r.a, r.s, r.e) == GOLDEN[r.trans], r.trans


def test_pieces_add_up(spark):
    df = spark.createDataFrame([(t,) for t in GOLDEN], "trans string")
    for r in bounds.tokenised(parsed(df, "anselm")).select("trans", "dipls", "annos").collect():
        assert "".join(d.trans for d in r.dipls) == r.trans
        assert not r.annos or "".join(a.trans for a in r.annos) == r.trans


def walk(chars):
    """The bounds by one walk over the characters, as flags on characters and the ones after them."""
    blank = {"mask": BIT["Whitespace"], "string": "", "opening": None}
    line = [dict(blank), *[dict(c) for c in chars], dict(blank)]
    for c in line:
        c["d"] = c["a"] = False
    is_a = lambda c, *n: any(c["mask"] & BIT[x] for x in n)
    closes = lambda c: is_a(c, "Bracket") and c["opening"] is False
    for i in range(1, len(line) - 1):
        last, this, after = line[i - 1 : i + 2]
        if is_a(last, *bounds.JOINS):
            (after if closes(this) else this)["d"] = True
        if is_a(last, "MultiverbSpace", "MultiverbNewline"):
            this["a"] = True
        if is_a(last, "Whitespace") and not is_a(last, "LineBreak") and is_a(this, "Punct") and not is_a(after, "Punct"):
            after["a"] = True
        if (is_a(last, "TextChar") or closes(last)) and is_a(this, "Punct") and not is_a(after, "TextChar", "Joiner", "UniverbSpace"):
            this["a"] = True
        if is_a(last, "Punct") and is_a(this, "Punct") and last["string"] != this["string"]:
            this["a"] = True
        if is_a(last, "ParticleLink") and is_a(this, "Punct"):
            this["a"] = True
        if is_a(last, "Bracket") and is_a(this, "Punct") and is_a(after, "Bracket"):
            last["a"] = True
        if is_a(last, "Whitespace", "MultiverbSpace") and is_a(this, "QuotationMark"):
            after["a"] = True
        elif is_a(this, "SentBound") and not is_a(after, "MultiverbSpace", "MultiverbNewline"):
            this["a"] = True
    return [(c["d"], c["a"]) for c in line[1:-1]]


def test_bounds_against_a_walk(spark):
    import random

    rng = random.Random(4)
    parts = ["a", "b", ".", ",", "(.)", '(")', "|", "#", "=", "[", "]", "[[", "]]", "<", ">", "*1", "(=)", "=|", "\n", "%.", " "]
    tokens = sorted({"".join(rng.choice(parts) for _ in range(rng.randint(1, 7))) for _ in range(600)})
    df = parsed(spark.createDataFrame([(t,) for t in tokens], "trans string"), "anselm").withColumn("b", bounds.bounded(F.col("chars")))
    for r in df.select("trans", "b").collect():
        assert [(c.dipl_bound, c.anno_bound) for c in r.b] == walk(parse_rex(r.trans)[0]), r.trans


def test_ren(spark):
    df = spark.createDataFrame([("foo#bar x§y",), ("ǂdeǂ",), ("{L_ab}c",), ("$Lücke$",), ("a]b",)], "trans string")
    rows = {r.trans: r for r in bounds.tokenised(parsed(df, "ren"), carry=True).collect()}
    assert [d.utf for d in rows["foo#bar x§y"].dipls] == ["foo", "bar", "xy"]
    assert [a.simple for a in rows["foo#bar x§y"].annos] == ["foobarx", "y"]
    assert rows["ǂdeǂ"].dipls[0].utf == "de"  # nothing else is left
    assert rows["{L_ab}c"].dipls[0].utf == "abc"
    assert rows["$Lücke$"].chars[0].cls == "Lacuna"
    assert rows["a]b"].lexical == ["not_parsed"]
    assert [c["dipl_utf"] for c in parse_ren("ǂdeǂf")[0]] == ["", "", "", "", "f"]


def test_table_of_replacements():
    """The table's rows by the rules that make them."""
    assert len(REPLACEMENTS) == 171 and len({p for p, _, _ in REPLACEMENTS}) == 170  # one pattern comes twice; the first counts
    circled = lambda n: chr(0x2460 + n - 1) if n <= 20 else chr(0x3251 + n - 21)
    numbers = [*range(10, 36), *range(1, 10)]
    assert REPLACEMENTS[:36] == [(r"\\&99", "□", "{99}"), *[(rf"\\&{n}", circled(n), f"{{{n}}}") for n in numbers]]
    rows = {p: (form, simple) for p, form, simple in REPLACEMENTS}
    for vowels, small in (("äöüaeiouvwy", True), ("ÄÖÜAEIOUVWY", False)):
        of = str.lower if small else str.upper
        for n in "nm":
            assert rows[rf"^{of(n)}\\-"] == (f"{n}\u0304", of(f"e{n}")) == rows[rf"(?<=[^{vowels}]){of(n)}\\-"]
        nasal = of("nm")
        assert rows[rf"(?<=[{vowels}])\\-(?=[{nasal}])"] == ("\u0304", "") and rows[rf"(?<=[{vowels}])\\-(?![{nasal}])"] == ("\u0304", of("n"))
        before = f"(?<![{vowels}])" if small else "(?<=[BCDFGHJKLMNPQRSTWXZ])"
        assert rows[rf"{before}\\-(?=[{nasal}])"] == ("\u0304", of("e")) and rows[rf"{before}\\-(?![{nasal}])"] == ("\u0304", of("en"))
    for letter, at in zip("aeiou", range(0x363, 0x368), strict=True):
        (pattern,) = [p for p in rows if re.fullmatch(r"\[\\\\%\]\[.*\]", p) and p[6] == letter]
        assert rows[pattern] == (chr(at), letter)
    assert ("æ", "æ", "ae") in REPLACEMENTS and len(ACCENTED) == len(PLAIN) == 32
    for c, simple in zip(ACCENTED, PLAIN, strict=True):
        assert unicodedata.normalize("NFD", c)[0] == simple and rows[c] == (c, simple)
    with pytest.raises(ValueError):
        dialect("none")


def test_signs_match_the_parser_on_plain_tokens(spark):
    tokens = ["wort.", "é,à", "a=b", "a#b", "x|y", "...", "Ærø!"]
    rows = spark.createDataFrame([(t,) for t in tokens], "trans string").withColumn("c", signs(F.col("trans"))).collect()
    for r in rows:
        assert [(c.cls, c.string) for c in r.c] == [(c["cls"], c["string"]) for c in parse_rex(r.trans)[0]], r.trans


def test_dipl_tokens_over_line_ends(spark, tmp_path):
    from scriptorium.plans.text_queries import dipl_tokens

    spark.createDataFrame([(1, "wor=\nd two"), (2, "a=\nb")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(tuple(r) for r in dipl_tokens(spark, str(tmp_path)).collect()) == [(1, 3, 8), (2, 2, 3)]
