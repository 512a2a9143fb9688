"""Transcription files: a header, then lines of a bibliographic mark, a tab and transcribed text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dialects import dialect, parsed
from ..model import Corpus, held, shift_tag
from ..operators import bounds, chunks, headers, layout
from ..operators.validate import token_errors
from ..session import checkpointed


def line_array(text: Column) -> Column:
    """The lines of a text as array<struct<line_no, line, part>>; part: mark, header, empty or text.

    The last mark before a line tells whether it stands between +H and @H; marks are few, so they are looked up in a list of
    their own. A byte order mark is left out.
    """
    lines = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), "^\ufeff", ""), "\r\n|\n|\r")

    def marked(x: Column) -> Column:
        marks = F.filter(F.transform(x, lambda x, i: F.struct(i.alias("i"), F.trim(x).alias("m"))), lambda x: x["m"].isin("+H", "@H"))
        return held(F.struct(x.alias("lines"), marks.alias("marks")), told)

    def told(s: Column) -> Column:
        def made(x: Column, i: Column) -> Column:
            last = F.try_element_at(F.filter(s["marks"], lambda m: m["i"] <= i), F.lit(-1))
            inside = F.when(last["i"] == i, "mark").when(last["m"] == "+H", "header")
            part = F.when(F.size(s["marks"]) > 0, inside)
            return F.struct(i.alias("line_no"), x.alias("line"), F.coalesce(part, F.when(x == "", "empty").otherwise("text")).alias("part"))

        return F.transform(s["lines"], made)

    return held(lines, marked)


def of_part(lines: Column, part: str) -> Column:
    return F.filter(lines, lambda x: x["part"] == part)


def text_lines(texts: DataFrame) -> DataFrame:
    """(doc_key, line_no, line, part) for ``texts`` (doc_key, text); no shuffle."""
    return texts.select("doc_key", F.inline(line_array(F.col("text"))))


def marked_array(lines: Column) -> Column:
    """array<struct<mark, content>> of the text lines, trimmed and cut at the first run of tabs."""
    cut = F.transform(of_part(lines, "text"), lambda x: F.split(F.regexp_replace(x["line"], r"^\s+|\s+$", ""), "\t+", 2))
    return F.transform(cut, lambda c: F.struct(F.when(F.size(c) > 1, c[0]).alias("mark"), F.element_at(c, -1).alias("content")))


def _spans(marks: Column) -> Column:
    """Folds shift marks in order into (type, first, last): each mark closes the one opened last, with its own range."""
    start = F.struct(
        F.expr("cast(array() as array<struct<type:string,first:int>>)").alias("open"),
        F.expr("cast(array() as array<struct<type:string,first:int,last:int>>)").alias("done"),
    )

    def step(s: Column, m: Column) -> Column:
        top = F.try_element_at(s["open"], F.lit(-1))
        fewer = F.slice(s["open"], 1, F.greatest(F.size(s["open"]) - 1, F.lit(0)))
        closed = F.array(F.struct(top["type"].alias("type"), top["first"].alias("first"), m["seen"].alias("last")))
        opened = F.array(F.struct(m["type"].alias("type"), (m["seen"] + 1).alias("first")))
        return (
            F.when(m["kind"] == "open", F.struct(F.concat(s["open"], opened).alias("open"), s["done"].alias("done")))
            .when(top.isNull(), s)
            .otherwise(F.struct(fewer.alias("open"), F.concat(s["done"], closed).alias("done")))
        )

    return F.aggregate(marks, start, step, lambda s: s["done"])


def token_tables(tokens: DataFrame, of: str, legacy: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(tokens, dipls, annos) for rows doc_key, item_ord, tok_ord, token_id, trans, base_line: parsed, bounded, split, numbered.

    Tokens of a dialect that never splits them are their own pieces: they are not joined to parsed ones, nor kept.
    """
    if dialect(of).whole:
        made = bounds.whole(tokens)
        pieces = lambda name, as_: made.where("kept <> ''").select("doc_key", "tok_ord", "base_line", F.lit(0).alias("k"), F.col(name).alias(as_))
        trans = F.col("kept")
    else:
        split = lambda t: bounds.tokenised(t, carry=dialect(of).carried).withColumn("errors", token_errors(legacy=legacy))
        made = checkpointed(parsed(tokens, of, then=split))  # three tables come from it
        pieces = lambda name, as_: made.select("doc_key", "tok_ord", "base_line", F.posexplode(f"{name}s").alias("k", as_))
        trans = bounds.trans(F.col("chars"))
    word = made.select("doc_key", "item_ord", "tok_ord", "token_id", trans.alias("trans"), "errors", "chars")
    number = lambda name: F.row_number().over(Window.partitionBy("doc_key").orderBy("tok_ord", name)).cast("int")
    dipls = pieces("dipl", "d").select(
        "doc_key", "tok_ord", (F.col("k") + 1).alias("dipl_in_tok"), number("k").alias("dipl_ord"), F.col("d.trans").alias("trans"),
        F.col("d.utf").alias("utf"), (F.col("base_line") + F.col("d.breaks")).cast("int").alias("line_ord"), F.col("d.chars").alias("chars"),
    )
    annos = pieces("anno", "a").select(
        "doc_key", "tok_ord", (F.col("k") + 1).alias("anno_in_tok"), number("k").alias("anno_ord"), F.col("a.trans").alias("trans"),
        F.col("a.utf").alias("utf"), F.col("a.simple").alias("simple"), F.expr("cast(map() as map<string,string>)").alias("tags"),
        F.expr("cast(array() as array<string>)").alias("flags"), F.lit(False).alias("checked"), F.col("a.chars").alias("chars"),
    )
    dipls = dipls.withColumn("dipl_id", F.concat(F.lit("d"), "dipl_ord"))
    annos = annos.withColumn("anno_id", F.concat(F.lit("a"), "anno_ord"))
    return word, dipls, annos


def read_trans(texts: DataFrame, of: str = "plain", strict: bool = True, legacy: bool = False) -> Corpus:
    """A corpus from ``texts`` (doc_key, text), one row a document. Documents with a faulty token or mark, or a line before
    any good mark, are not valid if ``strict``; documents without a line of tokens never are.

    Lines are told apart inside each row, and so are the lines of chunks, so texts aren't shuffled. Lines without tokens are
    left out. Every table is partitioned by doc_key in its windows, so each shuffle is on it. What is kept in the shared folder
    is a row a text, as long as the text; chunks are cut again for each table, as rows of their own take many times its space.
    """
    key = "doc_key"
    cut = texts.select(key, line_array(F.col("text")).alias("lines")).withColumn("marked", marked_array(F.col("lines")))
    header = F.array_join(F.transform(of_part(F.col("lines"), "header"), lambda x: x["line"]), "\n")
    body = F.array_join(F.transform("marked", lambda x: x["content"]), "\n")
    cut = checkpointed(cut.select(key, header.alias("header_string"), F.transform("marked", lambda x: x["mark"]).alias("marks"), body.alias("body")))
    head = cut.select(key, "header_string")
    marks = cut.select(key, F.posexplode("marks").alias("ln", "mark")).withColumn("ln", F.col("ln") + 1)
    filled = layout.fill_bibinfo(marks, key, "ln", "mark")
    stream = chunks.chunks(cut, key, "body", redi=of == "redi", lines=True)
    w = Window.partitionBy(key).orderBy("chunk_ord")
    is_token = (F.col("kind") == "token").cast("int")
    is_item = F.col("kind").isin("token", "comment").cast("int")
    placed = (
        stream.withColumn("tok_ord", F.sum(is_token).over(w).cast("int"))
        .withColumn("item_ord", F.sum(is_item).over(w).cast("int"))
    )
    tokens = placed.where("kind = 'token'").select(
        key, "item_ord", "tok_ord", F.concat(F.lit("t"), "tok_ord").alias("token_id"), F.col("raw").alias("trans"), "base_line"
    )
    words, dipls, annos = token_tables(tokens, of, legacy)
    comments = placed.where("kind = 'comment'").select(key, "item_ord", "type", "content")
    shifts = placed.where(F.col("kind").isin("open", "close")).groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("chunk_ord", "kind", "type", F.col("tok_ord").alias("seen")))).alias("m")
    )
    tags = shifts.select(key, F.posexplode(_spans(F.col("m"))).alias("k", "s")).select(
        key, (F.col("k") + 1).alias("tag_ord"), F.col("s.type").alias("type"), shift_tag(F.col("s.type")).alias("tag"),
        F.col("s.first").alias("first_tok_ord"), F.col("s.last").alias("last_tok_ord"),
    )
    used = dipls.select(key, F.col("line_ord").alias("ln")).distinct()
    rows = layout.numbered(filled.join(used, [key, "ln"], "left_semi"), key, ["ln"], ["page", "side"], ["col"])
    named = lambda letter, column: F.concat(F.lit(letter), F.col(column))
    line_table = rows.select(key, F.col("ln").alias("line_ord"), named("l", "ln").alias("line_id"), "col_ord", F.col("line").alias("name"))
    column_table = rows.groupBy(key, "col_ord").agg(F.min("page_ord").alias("page_ord"), F.first("col").alias("name"))
    column_table = column_table.select(key, "col_ord", named("c", "col_ord").alias("col_id"), "page_ord", "name")
    page_table = rows.groupBy(key, "page_ord").agg(F.first("page").alias("name"), F.first("side").alias("side"))
    page_table = page_table.select(key, "page_ord", named("p", "page_ord").alias("page_id"), "name", "side")
    problem = lambda df, order, severity, code, detail: df.select(
        key, F.col(order).cast("int").alias("item_ord"), F.lit(severity).alias("severity"), code.alias("code"), detail.alias("detail")
    )
    found = chunks.diagnostics(stream, key)
    found = found.unionByName(problem(words.withColumn("e", F.explode("errors")), "item_ord", "error", F.col("e"), F.col("trans")))
    found = found.unionByName(problem(filled.where("malformed"), "ln", "error", F.lit("bibinfo_malformed"), F.col("mark")))
    found = found.unionByName(problem(filled.join(used, [key, "ln"], "left_anti"), "ln", "warning", F.lit("line_without_tokens"), F.col("line")))
    found = found.unionByName(problem(filled.where("orphan"), "ln", "error", F.lit("bibinfo_missing"), F.lit(None).cast("string")))
    about = head.select(key, "header_string", headers.sigle(F.col("header_string")).alias("s"), F.lit(None).cast("int").alias("o"))
    found = found.unionByName(problem(about.where("header_string = ''"), "o", "warning", F.lit("header_empty"), F.lit(None).cast("string")))
    found = found.unionByName(problem(about.where("header_string <> '' and s is null"), "o", "warning", F.lit("sigle_missing"), F.lit(None).cast("string")))
    wrong = words.where(F.size("errors") > 0).select(key).unionByName(filled.where("malformed or orphan").select(key))
    bad = wrong.distinct().withColumn("bad", F.lit(True))
    whole = used.select(key).distinct().withColumn("whole", F.lit(True))  # has lines and tokens
    documents = (
        head.join(bad, key, "left").join(whole, key, "left")
        .select(
            key, F.coalesce(headers.sigle(F.col("header_string")), F.lit("")).alias("sigle"), F.lit("").alias("name"),
            headers.parse_header(F.col("header_string")).alias("header"), "header_string",
            (F.col("whole").isNotNull() & (F.col("bad").isNull() | F.lit(not strict))).alias("valid"),
        )
    )
    empty = documents.join(whole, key, "left_anti").withColumn("o", F.lit(None).cast("int"))
    found = found.unionByName(problem(empty, "o", "error", F.lit("document_empty"), F.lit(None).cast("string")))
    return Corpus(documents, page_table, column_table, line_table, words, dipls, annos, comments, tags, found)
