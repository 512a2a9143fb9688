"""Queries over turns, parts and events: layout, ranges, positional joins, annotations, comparison of pieces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import layout, modify, validate
from .text_queries import query


def turns(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/conversations.parquet")


#: Marks of places for turns: every fifth is malformed, every third but those missing.
_MARK_SQL = "CASE WHEN turn % 5 = 4 THEN 'bad mark' WHEN turn % 3 = 2 THEN NULL ELSE 'C' || conv_id || '-' || (turn // 2 + 1) || CASE WHEN turn % 2 = 0 THEN 'r' ELSE 'v' END || 'a,' || (turn + 1) END"
_MARK = (
    "CASE WHEN turn % 5 = 4 THEN 'bad mark' WHEN turn % 3 = 2 THEN NULL ELSE concat('C', conv_id, '-', turn div 2 + 1,"
    " CASE WHEN turn % 2 = 0 THEN 'r' ELSE 'v' END, 'a,', turn + 1) END"
)


@query(f"""
SELECT conv_id, turn, nullif(regexp_extract(mark, '^(\\S+)[-_]([A-Z0-9]*)([vr]?)([a-q]?),?(\\d+)$', 1), '') AS sigle,
  CASE WHEN ok THEN regexp_extract(mark, '^(\\S+)[-_]([A-Z0-9]*)([vr]?)([a-q]?),?(\\d+)$', 2) END AS page,
  CASE WHEN ok THEN regexp_extract(mark, '^(\\S+)[-_]([A-Z0-9]*)([vr]?)([a-q]?),?(\\d+)$', 3) END AS side,
  CASE WHEN ok THEN regexp_extract(mark, '^(\\S+)[-_]([A-Z0-9]*)([vr]?)([a-q]?),?(\\d+)$', 5) END AS line
FROM (SELECT conv_id, turn, mark, regexp_matches(mark, '^(\\S+)[-_]([A-Z0-9]*)([vr]?)([a-q]?),?(\\d+)$') AS ok FROM (SELECT conv_id, turn, {_MARK_SQL} AS mark FROM conversations))
""")
def bibinfo_parse(spark: SparkSession, d: str) -> DataFrame:
    rows = turns(spark, d).withColumn("b", layout.parse_bibinfo(F.expr(_MARK)))
    return rows.select("conv_id", "turn", *[F.col(f"b.{p}").alias(p) for p in ("sigle", "page", "side", "line")])


@query(f"""
WITH m AS (SELECT conv_id, turn, mark, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, mark LIKE 'C%' AS ok FROM (SELECT conv_id, turn, {_MARK_SQL} AS mark FROM conversations)),
f AS (SELECT *, last_value(CASE WHEN ok THEN mark END IGNORE NULLS) OVER w AS last, last_value(CASE WHEN ok THEN n END IGNORE NULLS) OVER w AS place FROM m WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, regexp_extract(last, '-(\\d+)[rv]', 1) AS page, regexp_extract(last, '([rv])a,', 1) AS side,
  CASE WHEN ok THEN regexp_extract(last, ',(\\d+)$', 1) WHEN last IS NOT NULL THEN CASE WHEN CAST(regexp_extract(last, ',(\\d+)$', 1) AS BIGINT) + n - place < 10 THEN '0' ELSE '' END || (CAST(regexp_extract(last, ',(\\d+)$', 1) AS BIGINT) + n - place) END AS line,
  NOT coalesce(ok, false) AS filled, mark IS NOT NULL AND NOT coalesce(ok, false) AS malformed FROM f
""")
def bibinfo_fill(spark: SparkSession, d: str) -> DataFrame:
    rows = turns(spark, d).select("conv_id", "turn", F.expr(_MARK).alias("mark"))
    return layout.fill_bibinfo(rows, "conv_id", "turn", "mark").select("conv_id", "turn", "page", "side", "line", "filled", "malformed")


@query(r"""
WITH c AS (SELECT conv_id, turn, role, length(text) > 300 AS long, row_number() OVER w AS n, role IS DISTINCT FROM lag(role) OVER w AS p,
  (length(text) > 300) IS DISTINCT FROM lag(length(text) > 300) OVER w AS q FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, CAST(sum(CASE WHEN n = 1 OR p THEN 1 ELSE 0 END) OVER w AS INTEGER) AS page_ord, CAST(sum(CASE WHEN n = 1 OR p OR q THEN 1 ELSE 0 END) OVER w AS INTEGER) AS col_ord
FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn)
""")
def layout_change(spark: SparkSession, d: str) -> DataFrame:
    rows = turns(spark, d).select("conv_id", "turn", "role", (F.length("text") > 300).alias("long"))
    return layout.numbered(rows, "conv_id", ["turn"], ["role"], ["long"]).select("conv_id", "turn", "page_ord", "col_ord")


@query(r"""
SELECT conv_id, role, CASE WHEN min(turn) = max(turn) THEN 't' || min(turn) ELSE 't' || min(turn) || '..t' || max(turn) END AS range FROM conversations GROUP BY conv_id, role
""")
def line_ranges(spark: SparkSession, d: str) -> DataFrame:
    rows = turns(spark, d).withColumn("name", F.concat(F.lit("t"), "turn"))
    return layout.ranges(rows, ["conv_id", "role"], "turn", "name")


@query(r"""
SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) = 1 AS begins, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn DESC) = 1 AS ends FROM conversations
""")
def line_bounds_flags(spark: SparkSession, d: str) -> DataFrame:
    return layout.line_flags(turns(spark, d), "conv_id", "turn", "role").select("conv_id", "turn", "begins", "ends")


@query(r"""
SELECT e.conv_id, e.turn AS first, m.turn AS member, m.role FROM conversations e JOIN conversations m ON e.conv_id = m.conv_id AND m.turn BETWEEN e.turn AND e.turn + 2 WHERE e.role = 'user'
""")
def interval_layout_join(spark: SparkSession, d: str) -> DataFrame:
    """Members of overlapping ranges."""
    rows = turns(spark, d)
    elements = rows.where("role = 'user'").select("conv_id", F.col("turn").alias("first_ord"), (F.col("turn") + 2).alias("last_ord"))
    members = rows.select("conv_id", F.col("turn").alias("member"), "role")
    return layout.by_range(elements, members, "conv_id", "member").select("conv_id", F.col("first_ord").alias("first"), "member", "role")


@query(r"""
SELECT e.conv_id, e.turn AS turn, a.turn AS first_ord, b.turn AS last_ord FROM (SELECT conv_id, turn, 't' || turn AS f, 't' || (turn + 3) AS l FROM conversations) e
LEFT JOIN conversations a ON a.conv_id = e.conv_id AND 't' || a.turn = e.f LEFT JOIN conversations b ON b.conv_id = e.conv_id AND 't' || b.turn = e.l
""")
def range_resolve(spark: SparkSession, d: str) -> DataFrame:
    """Ranges of names to orders; null where a name is missing."""
    rows = turns(spark, d)
    elements = rows.select("conv_id", "turn", F.concat(F.lit("t"), "turn", F.lit("..t"), F.col("turn") + 3).alias("range"))
    members = rows.select("conv_id", F.col("turn").alias("o"), F.concat(F.lit("t"), "turn").alias("name"))
    return layout.resolved(elements, members, "conv_id", "name", "o").select("conv_id", "turn", "first_ord", "last_ord")


@query(r"""
SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn) AS line FROM conversations
""")
def forward_fill_layout(spark: SparkSession, d: str) -> DataFrame:
    """The element that began last, for a layout that tiles: no range join."""
    rows = turns(spark, d).select("conv_id", "turn", "role")
    elements = rows.where("role = 'user'").select("conv_id", F.col("turn").alias("first_ord"), F.col("turn").alias("line"))
    return layout.tiled(rows, elements, "conv_id", "turn", "line").select("conv_id", "turn", "line")


@query(r"""
WITH u AS (SELECT conv_id, turn AS asked, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations WHERE role = 'user'),
a AS (SELECT conv_id, turn AS answered, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations WHERE role = 'assistant')
SELECT conv_id, asked, answered FROM u JOIN a USING (conv_id, k)
""")
def positional_zip(spark: SparkSession, d: str) -> DataFrame:
    """The k-th question with the k-th answer."""
    rows = turns(spark, d)
    asked = rows.where("role = 'user'").select("conv_id", F.col("turn").alias("asked"))
    answered = rows.where("role = 'assistant'").select("conv_id", F.col("turn").alias("answered"))
    return layout.positional(asked, answered, "conv_id", "asked", "answered")


@query(r"""
WITH m AS (SELECT conv_id, turn, length(text) AS l, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations),
r AS (SELECT conv_id, turn, CASE WHEN n % 11 = 5 THEN 'C' || conv_id || 'x' ELSE 'C' || conv_id END AS sigle, CAST(1 + (n - 1) // 4 AS VARCHAR) AS page,
  CASE WHEN l % 13 = 0 THEN '' WHEN l % 5 = 0 THEN 'v' ELSE 'r' END AS side, CASE WHEN l % 4 = 0 THEN '' WHEN l % 4 = 1 THEN 'a' WHEN l % 4 = 2 THEN 'b' ELSE 'd' END AS col,
  CAST(1 + (n - 1) % 4 + CASE WHEN l % 7 = 0 THEN 1 WHEN l % 7 = 1 THEN -1 ELSE 0 END AS BIGINT) AS line, CASE WHEN n % 9 = 7 THEN '' WHEN n % 9 = 8 THEN 'bad mark' END AS faulty FROM m),
p AS (SELECT *, last_value(CASE WHEN faulty IS NULL THEN {'sigle': sigle, 'page': page, 'side': side, 'col': col, 'line': line} END IGNORE NULLS)
  OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM r),
q AS (SELECT *, coalesce(b.sigle, '') AS s0, coalesce(b.page, '') AS p0, coalesce(b.side, '') AS d0, coalesce(b.col, '') AS c0, coalesce(b.line, 0) AS l0 FROM p)
SELECT conv_id, turn, CASE WHEN faulty = '' THEN 'no_bibinfo' WHEN faulty IS NOT NULL THEN 'bibinfo_malformed' ELSE concat_ws(',',
  CASE WHEN s0 <> '' AND s0 <> sigle THEN 'sigle_changed' END,
  CASE WHEN page = p0 AND side = d0 AND col = c0 THEN CASE WHEN line = l0 THEN 'line_repeated' WHEN line <> l0 + 1 THEN 'line_skipped' END WHEN line <> 1 THEN 'block_not_from_1' END,
  CASE WHEN page = p0 AND side = d0 THEN CASE WHEN col <> c0 AND c0 <> '' AND (col = '' OR ascii(col) <> ascii(c0) + 1) THEN 'column_order' END WHEN col NOT IN ('', 'a') THEN 'column_not_from_a' END,
  CASE WHEN page <> p0 AND d0 <> '' AND side <> 'r' THEN 'side_not_recto' END) END AS codes FROM q
""")
def validate_bibinfo_seq(spark: SparkSession, d: str) -> DataFrame:
    """Marks of turns, made faulty in every way that the check knows."""
    n, size = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")), F.length("text")
    rows = turns(spark, d).withColumn("n", n).withColumn("l", size)
    side = F.when(F.col("l") % 13 == 0, "").when(F.col("l") % 5 == 0, "v").otherwise("r")
    col = F.when(F.col("l") % 4 == 0, "").when(F.col("l") % 4 == 1, "a").when(F.col("l") % 4 == 2, "b").otherwise("d")
    line = 1 + (F.col("n") - 1) % 4 + F.when(F.col("l") % 7 == 0, 1).when(F.col("l") % 7 == 1, -1).otherwise(0)
    sigle = F.concat(F.lit("C"), "conv_id", F.when(F.col("n") % 11 == 5, "x").otherwise(""))
    page = (1 + F.floor((F.col("n") - 1) / 4)).cast("string")
    mark = F.when(F.col("n") % 9 == 7, "").when(F.col("n") % 9 == 8, "bad mark").otherwise(F.concat(sigle, F.lit("-"), page, side, col, F.lit(","), line.cast("string")))
    return validate.bibinfo_sequence(rows.withColumn("mark", mark), "conv_id", "turn").select("conv_id", "turn", F.array_join("codes", ",").alias("codes"))


# ---------------------------------------------------------------- annotations of parts


def _tagged(spark: SparkSession, d: str) -> DataFrame:
    """Parts with a map of tags: pos from the brand, lemma from the name, morph from the type, for some unset or missing."""
    tags = F.create_map(
        F.lit("pos"), F.when(F.col("p_size") % 4 == 0, "--").otherwise(F.col("p_brand")), F.lit("lemma"), F.col("p_name"),
        F.when(F.col("p_size") % 3 == 0, "other").otherwise("morph"), F.col("p_type"),
    )
    return spark.read.parquet(f"{d}/part.parquet").withColumn("tags", tags)


_TAGGED = """t AS (SELECT p_partkey, p_size, CASE WHEN p_size % 4 = 0 THEN '--' ELSE p_brand END AS pos, p_name AS lemma, CASE WHEN p_size % 3 <> 0 THEN p_type END AS morph FROM part)"""


def _shown(df: DataFrame, tags: Column, *names: str) -> DataFrame:
    return df.withColumn("_t", tags).select("p_partkey", *[modify.get(F.col("_t"), n).alias(n) for n in names])


@query(f"WITH {_TAGGED} SELECT p_partkey, CASE WHEN pos = '--' THEN 'X' ELSE pos || ' X' END AS pos, coalesce(morph || ' Y', 'Y') AS morph FROM t")
def tag_append(spark: SparkSession, d: str) -> DataFrame:
    tags = modify.append(modify.append(F.col("tags"), "pos", F.lit("X")), "morph", F.lit("Y"))
    return _shown(_tagged(spark, d), tags, "pos", "morph")


@query(f"WITH {_TAGGED} SELECT p_partkey, pos, coalesce(morph, '--') AS morph FROM t")
def tag_fill(spark: SparkSession, d: str) -> DataFrame:
    return _shown(_tagged(spark, d), modify.fill(F.col("tags"), "morph", "--"), "pos", "morph")


@query(f"WITH {_TAGGED} SELECT p_partkey, CASE WHEN pos = '--' THEN NULL ELSE pos END AS pos, NULL::VARCHAR AS lemma, morph FROM t")
def tag_remove(spark: SparkSession, d: str) -> DataFrame:
    tags = modify.remove(modify.remove(F.col("tags"), "pos", F.lit("--")), "lemma")
    return _shown(_tagged(spark, d), tags, "pos", "lemma", "morph")


@query(f"WITH {_TAGGED} SELECT p_partkey, CASE pos WHEN 'Brand#1' THEN 'one' WHEN 'Brand#2' THEN 'two' ELSE pos END AS pos, lemma FROM t")
def tag_recode(spark: SparkSession, d: str) -> DataFrame:
    return _shown(_tagged(spark, d), modify.recode(F.col("tags"), "pos", {"Brand#1": "one", "Brand#2": "two"}), "pos", "lemma")


@query(f"""WITH {_TAGGED}
SELECT p_partkey, CASE WHEN morph IS NULL THEN pos ELSE pos || '.' || morph END AS both, NULL::VARCHAR AS pos, CAST(NULL AS VARCHAR) AS morph FROM t""")
def tag_merge(spark: SparkSession, d: str) -> DataFrame:
    return _shown(_tagged(spark, d), modify.merge(F.col("tags"), "pos", "morph", "both"), "both", "pos", "morph")


@query(f"""WITH {_TAGGED}
SELECT p_partkey, CASE WHEN contains(lemma, ' ') THEN split_part(lemma, ' ', 1) ELSE lemma END AS lemma, CASE WHEN contains(lemma, ' ') THEN split_part(lemma, ' ', 2) END AS lemma_id FROM t""")
def tag_split(spark: SparkSession, d: str) -> DataFrame:
    return _shown(_tagged(spark, d), modify.split(F.col("tags"), "lemma", "lemma", "lemma_id", " "), "lemma", "lemma_id")


@query(r"""
SELECT p_partkey, CASE WHEN p_size % 5 = 0 AND p_size % 3 <> 2 THEN 'a.b.c.d.Unr' WHEN p_size % 5 = 0 THEN 'a.b.c.d.*' ELSE 'a.b.*' END AS morph,
  'http://www.woerterbuchnetz.de/DWB?' || CASE WHEN p_size % 2 = 0 THEN 'lemid=L' || p_size ELSE 'lemma=' || lemma END AS url, CASE WHEN p_size % 2 = 0 THEN 'man' ELSE 'auto' END AS annoType
FROM (SELECT p_partkey, p_size, CASE p_size % 3 WHEN 0 THEN 'gehen' WHEN 1 THEN 'sein' ELSE 'machen' END AS lemma FROM part)
""")
def ref_annotation(spark: SparkSession, d: str) -> DataFrame:
    """Irregular verbs, addresses of entries, and who made the annotation."""
    size = F.col("p_size")
    lemma = F.when(size % 3 == 0, "gehen").when(size % 3 == 1, "sein").otherwise("machen")
    tags = F.create_map(
        F.lit("pos"), F.when(size % 3 == 1, "VAFIN").otherwise("VVFIN"),
        F.lit("lemma"), F.when(size % 2 == 0, F.concat(lemma, F.lit(" [L"), size.cast("string"), F.lit("]"))).otherwise(lemma),
        F.lit("morph"), F.when(size % 5 == 0, "a.b.c.d.*").otherwise("a.b.*"),
    )
    parts = spark.read.parquet(f"{d}/part.parquet").withColumn("tags", tags)
    done = modify.ref_postprocess(parts.withColumn("checked", size % 2 == 0))
    get = lambda n: modify.get(F.col("tags"), n)
    return done.select("p_partkey", get("morph").alias("morph"), get("lemmaURL").alias("url"), get("annoType").alias("annoType"))


@query(r"""
SELECT p_partkey, concat_ws(',', CASE WHEN p_size % 3 = 0 AND n > 1 THEN 'err_cat_dipl' END, CASE WHEN p_size % 3 = 0 AND n > 1 THEN 'err_cat_anno' END,
  CASE WHEN p_size % 3 = 0 AND n > 1 THEN 'err_nr_dipl' END) AS errors FROM (SELECT p_partkey, p_size, len(string_split(p_name, ' ')) AS n FROM part)
""")
def error_counts(spark: SparkSession, d: str) -> DataFrame:
    """Given pieces against parsed ones: for some parts the last given piece is missing."""
    words = F.split("p_name", " ")
    fewer = F.when((F.col("p_size") % 3 == 0) & (F.size(words) > 1), F.slice(words, 1, F.size(words) - 1)).otherwise(words)
    rows = spark.read.parquet(f"{d}/part.parquet").select(
        "p_partkey", F.replace("p_name", F.lit(" "), F.lit("")).alias("trans"), fewer.alias("given_dipls"), words.alias("given_annos"),
        F.transform(words, lambda w: F.struct(w.alias("trans"))).alias("dipls"), F.transform(words, lambda w: F.struct(w.alias("trans"))).alias("annos"),
        F.expr("cast(array() as array<string>)").alias("errors"),
    )
    return validate.against_parse(rows).select("p_partkey", F.array_join("errors", ",").alias("errors"))
