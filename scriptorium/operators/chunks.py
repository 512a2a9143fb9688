"""Texts to streams of chunks: tokens, blanks, line ends, comments, shift marks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import held

#: The kinds of chunks in the order in which they are tried. What none of them fits is passed over.
_TOKEN = r"[^\s{+@][^\s+@]*"
_JOIN = r"\[?\[?(?:\(=\)|=\||=)\]?\]?[ \t]*\n[ \t]*"
COMMENT = r"\+[KEZ][^\n@]+@[KEZ]"
OPEN, CLOSE = r"\+[FLRÜMQ]p?", r"@[FLRÜMQ]p?"
SECOND = r"\{[^}*÷]+\}"
#: Tokens and blanks come first, as most chunks are of them: no other kind begins like a token, and only a token at a line's
#: end can be joined to the next.
_WORD = r"[^\s{+@][^\s+@]*+(?![ \t]*+\n)"
MASTER = f"(?U){_WORD}|[ \\t]|{COMMENT}|{OPEN}|{CLOSE}|{_TOKEN}{_JOIN}{_TOKEN}|{_TOKEN}|{SECOND}|[ \\t]*\\n[ \\t]*"
#: The ReDI dialect: numbers in braces are tokens, and plus and at signs may stand inside tokens.
_REDI = r"(?:[^\s{][^\s]*|\{\d\d?\})"
MASTER_REDI = f"(?U){COMMENT}|{OPEN}|{CLOSE}|{_REDI}{_JOIN}{_REDI}|{_REDI}|{SECOND}|[ \\t]|[ \\t]*\\n[ \\t]*"


def kind_of(chunk: Column) -> Column:
    """The kind of a chunk; the alternatives differ in shape, so the match itself says which one it was.

    Most chunks are told by their first sign, without a pattern.
    """
    first = F.substring(chunk, 1, 1)
    return (
        F.when(~first.isin(" ", "\t", "\n", "+", "@", "{"), "token")
        .when(first.isin(" ", "\t", "\n"), F.when(F.contains(chunk, F.lit("\n")), "newline").otherwise("space"))
        .when(chunk.rlike(f"^{COMMENT}$"), "comment")
        .when(chunk.rlike(f"^{OPEN}$"), "open")
        .when(chunk.rlike(f"^{CLOSE}$"), "close")
        .when(chunk.rlike(r"^\{[^}*÷]+\}$") & ~chunk.rlike(r"^\{\d\d?\}$"), "second")
        .otherwise("token")
    )


def chunk_array(text: Column, redi: bool = False) -> Column:
    return F.regexp_extract_all(text, F.lit(MASTER_REDI if redi else MASTER), F.lit(0))


def line_breaks(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def chunk_lines(found: Column) -> Column:
    """array<struct<base_line, first, raws>> of a text's chunks, cut after each that ends a line: the line that a stretch
    begins on, from 1, the number of its first chunk, from 0, and its chunks. Linear in the chunks."""

    def made(x: Column) -> Column:
        ends = F.filter(F.transform(x, lambda c, i: F.when(F.contains(c, F.lit("\n")), i)), lambda i: i.isNotNull())
        return held(F.struct(x.alias("x"), ends.alias("ends")), cut)

    def cut(s: Column) -> Column:
        many = F.filter(s["ends"], lambda i: line_breaks(F.get(s["x"], i)) > 1)  # numbers in braces over several lines: few
        return held(F.struct(s["x"].alias("x"), s["ends"].alias("ends"), many.alias("many")), stretches)

    def stretches(s: Column) -> Column:
        def stretch(end: Column, k: Column) -> Column:
            first = F.when(k > 0, F.get(s["ends"], k - 1) + 1).otherwise(0)
            more = F.aggregate(F.filter(s["many"], lambda i: i < first), F.lit(0), lambda n, i: n + line_breaks(F.get(s["x"], i)) - 1)
            return F.struct((k + 1 + more).cast("long").alias("base_line"), first.alias("first"), F.slice(s["x"], first + 1, end - first + 1).alias("raws"))

        return F.transform(F.concat(s["ends"], F.array(F.size(s["x"]) - 1)), stretch)

    return held(found, made)


def chunks(df: DataFrame, key: str, text: str, redi: bool = False, lines: bool = False) -> DataFrame:
    """(key, chunk_ord, kind, type, content, raw): the chunks of each text in order; with ``lines`` also base_line, the line
    that a chunk begins on.

    kind: token, space, newline, comment, open or close. Numbers of a second edition in braces are comments of type Z;
    a comment's content has no marks and no blanks around it; a line end is one newline. One pass, no shuffle.
    """
    found = chunk_array(F.col(text), redi)
    if lines:
        cut = df.select(key, F.inline(chunk_lines(found))).select(key, "base_line", "first", F.posexplode("raws").alias("k", "raw"))
        found = cut.select(key, (F.col("first") + F.col("k")).alias("chunk_ord"), "raw", "base_line")
    else:
        found = df.select(key, F.posexplode(found).alias("chunk_ord", "raw"))
    kind = kind_of(F.col("raw"))
    if not redi:  # without the exception for numbers in braces
        kind = F.when(F.col("raw").startswith("{"), "second").otherwise(kind)
    rows = found.withColumn("_kind", kind)
    return rows.select(
        key, "chunk_ord",
        F.when(F.col("_kind") == "second", "comment").otherwise(F.col("_kind")).alias("kind"),
        F.when(F.col("_kind") == "comment", F.substring("raw", 2, 1)).when(F.col("_kind") == "second", "Z")
        .when(F.col("_kind").isin("open", "close"), F.expr("substring(raw, 2)")).alias("type"),
        F.when(F.col("_kind") == "comment", F.trim(F.expr("substring(raw, 3, length(raw) - 4)"))).when(F.col("_kind") == "newline", "\n")
        .otherwise(F.col("raw")).alias("content"), "raw", *["base_line"] * lines,
    )


def depth_range(text: Column, redi: bool = False) -> Column:
    """struct(deepest, lowest, last) of the number of shift marks open after each chunk; one pass, no shuffle."""
    marks = F.filter(chunk_array(text, redi), lambda x: x.rlike(f"^({OPEN}|{CLOSE})$"))
    zero = F.lit(0)
    start = F.struct(zero.alias("deepest"), zero.alias("lowest"), zero.alias("last"))

    def step(s: Column, m: Column) -> Column:
        now = s["last"] + F.when(m.startswith("+"), 1).otherwise(-1)
        return F.struct(F.greatest(s["deepest"], now).alias("deepest"), F.least(s["lowest"], now).alias("lowest"), now.alias("last"))

    return F.aggregate(marks, start, step)


def _stacked(marks: Column) -> Column:
    """Folds the marks of one text in order over a stack of open types; problems as an array."""
    start = F.struct(
        F.expr("cast(array() as array<string>)").alias("open"),
        F.expr("cast(array() as array<struct<ord:int,code:string,detail:string>>)").alias("found"),
    )

    def step(s: Column, m: Column) -> Column:
        top = F.try_element_at(s["open"], F.lit(-1))
        popped = F.slice(s["open"], 1, F.greatest(F.size(s["open"]) - 1, F.lit(0)))
        code = F.when(top.isNull(), "close_not_opened").when(top != m["type"], "shift_tag_mismatch")
        found = F.when(code.isNull(), s["found"]).otherwise(F.concat(s["found"], F.array(F.struct(m["ord"].alias("ord"), code.alias("code"), m["type"].alias("detail")))))
        return F.when(m["kind"] == "open", F.struct(F.concat(s["open"], F.array(m["type"])).alias("open"), s["found"].alias("found"))).otherwise(
            F.struct(popped.alias("open"), found.alias("found"))
        )

    def end(s: Column) -> Column:
        last = F.transform(s["open"], lambda t: F.struct(F.lit(None).cast("int").alias("ord"), F.lit("shift_tag_unclosed").alias("code"), t.alias("detail")))
        return F.concat(s["found"], last)

    return F.aggregate(marks, start, step, end)


def diagnostics(stream: DataFrame, key: str) -> DataFrame:
    """(key, item_ord, severity, code, detail) for what is wrong with a stream of chunks.

    Comments whose marks differ or that follow something else than a blank, tabs, blanks round line ends, and shift marks
    that are not nested or not closed.
    """
    line = Window.partitionBy(key).orderBy("chunk_ord")
    before = F.lag("kind").over(line)
    simple = stream.withColumn("before", before)
    codes = F.array_compact(F.array(
        F.when((F.col("kind") == "comment") & F.col("raw").startswith("+") & (F.substring("raw", 2, 1) != F.right(F.col("raw"), F.lit(1))), F.struct(F.lit("error").alias("s"), F.lit("comment_mismatch").alias("c"))),
        F.when((F.col("kind") == "comment") & F.col("raw").startswith("+") & ~F.coalesce(F.col("before"), F.lit("")).isin("space", "newline"), F.struct(F.lit("warning").alias("s"), F.lit("comment_not_after_blank").alias("c"))),
        F.when((F.col("kind") == "space") & F.col("raw").contains("\t"), F.struct(F.lit("warning").alias("s"), F.lit("tab_between_tokens").alias("c"))),
        F.when((F.col("kind") == "newline") & (F.col("raw") != "\n"), F.struct(F.lit("warning").alias("s"), F.lit("blanks_at_line_end").alias("c"))),
    ))
    flat = simple.select(key, F.col("chunk_ord").alias("item_ord"), F.explode(codes).alias("x"), F.col("raw").alias("detail"))
    flat = flat.select(key, "item_ord", F.col("x.s").alias("severity"), F.col("x.c").alias("code"), "detail")
    marks = stream.where(F.col("kind").isin("open", "close")).groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct(F.col("chunk_ord").alias("ord"), F.col("kind"), F.col("type")))).alias("marks")
    )
    nested = marks.select(key, F.explode(_stacked(F.col("marks"))).alias("x"))
    return flat.unionByName(nested.select(key, F.col("x.ord").alias("item_ord"), F.lit("error").alias("severity"), F.col("x.code").alias("code"), F.col("x.detail").alias("detail")))
