"""Checks as data: every operator here gives codes, no operator stops or logs."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import is_a
from .layout import parse_bibinfo


def adjacency(chars: Column, legacy: bool = False) -> Column:
    """Codes for what may not follow what in a token.

    A joiner must stand at a line end, hyphens excepted; a word split before a hyphen and splits next to joins
    contradict. ``legacy`` also excepts the join at line ends, and then sees no contradiction after it.
    """

    def code(c: Column, i: Column) -> Column:
        now = F.get(chars, i + 1)
        m = F.coalesce(now["mask"], F.lit(0).cast("long"))
        joiner = is_a(c["mask"], "Joiner") & ~is_a(m, "LineBreak")
        excepted = is_a(c["mask"], "Hyphen", "UniverbNewline") if legacy else is_a(c["mask"], "Hyphen")
        against = (is_a(c["mask"], "Univerbation") & is_a(m, "Multiverbation")) | (is_a(c["mask"], "Multiverbation") & is_a(m, "Univerbation"))
        against = against & ~joiner if legacy else against
        return F.when(now.isNull(), None).otherwise(
            F.when(against, "contradictory_bounds")
            .when(joiner & ~excepted, "not_at_line_end")
            .when(is_a(c["mask"], "MultiverbSpace") & is_a(m, "Hyphen"), "erroneous_bound")
        )

    return F.array_distinct(F.filter(F.transform(chars, code), lambda x: x.isNotNull()))


def token_errors(chars: str = "chars", lexical: str = "lexical", legacy: bool = False) -> Column:
    """All errors of a parsed token: of brackets and characters, from the parser, and of adjacent bounds."""
    return F.array_union(F.coalesce(F.col(lexical), F.array().cast("array<string>")), adjacency(F.col(chars), legacy))


def against_parse(tokens: DataFrame) -> DataFrame:
    """Codes for tokens whose given pieces differ from the parsed ones.

    ``tokens`` has trans, given_dipls and given_annos (arrays of strings), dipls and annos (parsed, with trans).
    err_cat_dipl, err_cat_anno: the pieces don't add up to the token; err_nr_*: another number than parsed; err_tok_*: the
    same number, other strings.
    """
    dipls, annos = F.transform("dipls", lambda d: d["trans"]), F.transform("annos", lambda a: a["trans"])
    given_d, given_a = F.col("given_dipls"), F.col("given_annos")

    def differ(a: Column, b: Column) -> Column:
        return (F.size(a) == F.size(b)) & F.exists(F.zip_with(a, b, lambda x, y: ~x.eqNullSafe(y)), lambda x: x)

    codes = F.array_compact(F.array(
        F.when(F.size(given_d) + F.size(given_a) == 0, "err_no_pieces"),
        F.when(F.array_join(given_d, "") != F.col("trans"), "err_cat_dipl"),
        F.when((F.size(given_a) > 0) & (F.array_join(given_a, "") != F.array_join(given_d, "")), "err_cat_anno"),
        F.when(F.size(dipls) != F.size(given_d), "err_nr_dipl"), F.when(differ(dipls, given_d), "err_tok_dipl"),
        F.when(F.size(annos) != F.size(given_a), "err_nr_anno"), F.when(differ(annos, given_a), "err_tok_anno"),
    ))
    return tokens.withColumn("errors", F.array_union(F.coalesce("errors", F.array().cast("array<string>")), codes))


def rejected(df: DataFrame, key: str, fatal: Column) -> DataFrame:
    """(key, valid): a document with one fatal row is rejected as a whole."""
    return df.groupBy(key).agg((~F.coalesce(F.bool_or(fatal), F.lit(False))).alias("valid"))


def bibinfo_sequence(lines: DataFrame, key: str, order: str = "line_no", mark: str = "mark") -> DataFrame:
    """``lines`` with ``codes`` for their marks in order, each held against the last good one before it.

    No mark, or a malformed one; another sigle; in one column a number that repeats or skips; a new column, side or page
    that does not begin with line 1; columns out of order on a side, or a side that does not begin without column or with a;
    after a page with sides another page that does not begin with its recto. The first mark is held against none.
    """
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rows = lines.withColumn("_now", parse_bibinfo(F.col(mark))).withColumn("_last", F.last("_now", ignorenulls=True).over(w))
    now = lambda p: F.col(f"_now.{p}")
    last = lambda p: F.coalesce(F.col(f"_last.{p}"), F.lit(""))
    same = lambda *parts: functools.reduce(lambda x, y: x & y, [now(p) == last(p) for p in parts])
    n, before = now("line").cast("long"), F.coalesce(F.col("_last.line").cast("long"), F.lit(0).cast("long"))
    column, side = same("page", "side", "col"), same("page", "side")
    codes = F.array_compact(F.array(
        F.when(F.coalesce(F.col(mark), F.lit("")) == "", "no_bibinfo").when(F.col("_now").isNull(), "bibinfo_malformed"),
        F.when((last("sigle") != "") & ~same("sigle"), "sigle_changed"),
        F.when(column & (n == before), "line_repeated").when(column & (n != before + 1), "line_skipped").when(~column & (n != 1), "block_not_from_1"),
        F.when(side & ~column & (last("col") != "") & (F.ascii(now("col")) != F.ascii(last("col")) + 1), "column_order")
        .when(~side & ~now("col").isin("", "a"), "column_not_from_a"),
        F.when(~same("page") & (last("side") != "") & (now("side") != "r"), "side_not_recto"),
    ))
    return rows.withColumn("codes", codes).drop("_now", "_last")
