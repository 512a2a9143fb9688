"""Pages, columns and lines: bibliographic marks, change detection, ranges, and joins by range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: how a line names its place: sigle, page, side, column, line.
BIBINFO = r"(?U)^(\S+)[-_]([A-Z0-9]*)([vr]?)([a-q]?),?(\d+)$"
PARTS = ["sigle", "page", "side", "col", "line"]


def parse_bibinfo(text: Column) -> Column:
    """struct of PARTS; null if the text is no such mark. The page is greedy."""
    parts = F.struct(*[F.regexp_extract(text, BIBINFO, i + 1).alias(p) for i, p in enumerate(PARTS)])
    return F.when(text.rlike(BIBINFO), parts)


def fill_bibinfo(lines: DataFrame, key: str, order: str, mark: str) -> DataFrame:
    """``lines`` with PARTS, ``filled``, ``malformed`` and ``orphan``, from the column ``mark``.

    A line without a mark, or with a malformed one, goes on from the last good line: its parts, and its number plus the
    distance, padded to two digits. A line before the first good one has nulls and is an orphan, as there is nothing to go on
    from. Padding never cuts longer numbers.
    """
    w = Window.partitionBy(key).orderBy(order)
    good = parse_bibinfo(F.col(mark))
    rows = lines.withColumn("_good", good).withColumn("_n", F.row_number().over(w))
    rows = rows.withColumn("_last", F.last("_good", ignorenulls=True).over(w))
    rows = rows.withColumn("_at", F.last(F.when(F.col("_good").isNotNull(), F.col("_n")), ignorenulls=True).over(w))
    number = (F.col("_last.line").cast("long") + F.col("_n") - F.col("_at")).cast("string")
    padded = F.when(F.length(number) < 2, F.lpad(number, 2, "0")).otherwise(number)
    line = F.when(F.col("_good").isNotNull(), F.col("_good.line")).otherwise(padded)
    rows = rows.select(
        *lines.columns, *[F.col(f"_last.{p}").alias(p) for p in PARTS[:-1]], line.alias("line"),
        F.col("_good").isNull().alias("filled"), (F.col(mark).isNotNull() & F.col("_good").isNull()).alias("malformed"),
        F.col("_last").isNull().alias("orphan"),
    )
    return rows


def numbered(rows: DataFrame, key: str, order: list[str], page: list[str], column: list[str]) -> DataFrame:
    """``rows`` with page_ord and col_ord from 1: a page begins where its columns change, a column with it or at its own."""
    w = Window.partitionBy(key).orderBy(*order)
    up_to = w.rowsBetween(Window.unboundedPreceding, 0)
    first = F.row_number().over(w) == 1
    changed = lambda names: F.array_contains(F.array(*[~F.col(c).eqNullSafe(F.lag(c).over(w)) for c in names]), True)
    marked = rows.withColumn("_p", first | changed(page)).withColumn("_c", first | changed(page) | changed(column))
    return (
        marked.withColumn("page_ord", F.sum(F.col("_p").cast("int")).over(up_to).cast("int"))
        .withColumn("col_ord", F.sum(F.col("_c").cast("int")).over(up_to).cast("int"))
        .drop("_p", "_c")
    )


def range_text(first: Column, last: Column) -> Column:
    """``first..last``, or one name if they are the same."""
    return F.when(first == last, first).otherwise(F.concat(first, F.lit(".."), last))


def parse_range(text: Column) -> Column:
    """struct(first, last) of a range attribute; null if it is empty."""
    parts = F.split(text, r"\.\.")
    return F.when(F.coalesce(text, F.lit("")) != "", F.struct(parts[0].alias("first"), F.element_at(parts, -1).alias("last")))


def ranges(members: DataFrame, group: list[str], order: str, name: str) -> DataFrame:
    """(group, range) for each group: from its first to its last member in order."""
    return members.groupBy(*group).agg(range_text(F.min_by(name, order), F.max_by(name, order)).alias("range"))


def line_flags(dipls: DataFrame, key: str, order: str, line: str) -> DataFrame:
    """``dipls`` with ``begins`` and ``ends``: is it the first, the last of its line?"""
    w = Window.partitionBy(key, line).orderBy(order)
    back = Window.partitionBy(key, line).orderBy(F.desc(order))
    return dipls.withColumn("begins", F.row_number().over(w) == 1).withColumn("ends", F.row_number().over(back) == 1)


def by_range(elements: DataFrame, members: DataFrame, key: str, order: str, first: str = "first_ord", last: str = "last_ord") -> DataFrame:
    """Members inside each element's range of orders; ranges may overlap and nest.

    The join is on the document's key, with the range as a further condition, so it stays a hash or merge join.
    """
    e, m = elements.alias("e"), members.alias("m")
    on = (F.col(f"e.{key}") == F.col(f"m.{key}")) & F.col(f"m.{order}").between(F.col(f"e.{first}"), F.col(f"e.{last}"))
    return e.join(m, on).select("e.*", *[F.col(f"m.{c}") for c in members.columns if c != key])


def resolved(elements: DataFrame, members: DataFrame, key: str, name: str, order: str) -> DataFrame:
    """``elements`` (with ``range``) with first_ord and last_ord of the named members; null where there is no such one."""
    names = members.select(F.col(key).alias("_k"), F.col(name).alias("_n"), F.col(order).alias("_o"))
    rows = elements.withColumn("_r", parse_range(F.col("range")))
    for part in ("first", "last"):
        found = names.withColumnRenamed("_o", f"{part}_ord")
        rows = rows.join(found, (F.col(key) == F.col("_k")) & (F.col(f"_r.{part}") == F.col("_n")), "left").drop("_k", "_n")
    return rows.drop("_r")


def tiled(members: DataFrame, elements: DataFrame, key: str, order: str, number: str) -> DataFrame:
    """``members`` with the ``number`` of the element that began last: for layouts that tile a document, no range join.

    Members before the first element have null: they are orphans.
    """
    begins = elements.select(F.col(key).alias("_k"), F.col("first_ord").alias("_o"), F.col(number)).where("_o is not null")
    w = Window.partitionBy(key).orderBy(order)
    met = members.join(begins, (F.col(key) == F.col("_k")) & (F.col(order) == F.col("_o")), "left").drop("_k", "_o")
    return met.withColumn(number, F.last(number, ignorenulls=True).over(w))


def layout_problems(elements: DataFrame, key: str) -> DataFrame:
    """(key, item_ord, severity, code, detail) for resolved elements: repeated begins, empty ranges, missing ends."""
    same = F.count("*").over(Window.partitionBy(key, "kind", "first_ord"))
    codes = F.array_compact(F.array(
        F.when(F.coalesce("range", F.lit("")) == "", "empty_range"),
        F.when((F.coalesce("range", F.lit("")) != "") & F.col("first_ord").isNull(), "range_start_missing"),
        F.when((F.coalesce("range", F.lit("")) != "") & F.col("last_ord").isNull(), "range_end_missing"),
        F.when(F.col("first_ord").isNotNull() & (F.col("_same") > 1), "repeated_begin"),
    ))
    rows = elements.withColumn("_same", same).withColumn("code", F.explode(codes))
    return rows.select(key, F.col("ord").alias("item_ord"), F.lit("warning").alias("severity"), "code", F.col("range").alias("detail"))


def positional(left: DataFrame, right: DataFrame, key: str, left_order: str, right_order: str) -> DataFrame:
    """The k-th row of ``left`` with the k-th of ``right`` for each key; the longer side's rest is left out."""
    number = lambda df, order: df.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(order)))
    return number(left, left_order).join(number(right, right_order), [key, "_k"]).drop("_k")
