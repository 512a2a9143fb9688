"""Queries over the text of documents: lines, chunks, characters, bounds, forms, offsets, checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import chars as signs
from ..operators import bounds, chunks, headers, modify, validate
from ..session import checkpointed, prepared
from ..sources.trans import read_trans, text_lines

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return add


def documents(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet")


#: What is put after the texts of documents, in turn: comments, shift marks, joins over line ends, tabs, numbers, bounds.
SNIPPETS = [
    "", "x +K a note @K y", "x+K near @K +K m @E {12}", "+F open +Lp nested @Lp @F done", "+M never closed", "stray @R close +F a @L b",
    "wor=\nden foo(=)\nbar x[=]\n y=|\nz", "tab\tbed \n next", "a|b c#d e=f, (.) g..!", "{1vf,2} {Kap.6,I} {}", "a@b c+d", "+Rp +K in @K @Rp",
]


def marked_documents(spark: SparkSession, d: str) -> DataFrame:
    put = F.get(F.array(*map(F.lit, SNIPPETS)), (F.col("doc_id") % len(SNIPPETS)).cast("int"))
    return documents(spark, d).withColumn("text", F.concat("text", F.lit("\n"), put))


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_PUT = ", ".join(f"({i}, {quoted(x)})" for i, x in enumerate(SNIPPETS))
_MARKED = f"(SELECT doc_id, lang, text || chr(10) || snippet AS text FROM documents JOIN (VALUES {_PUT}) s(i, snippet) ON doc_id % {len(SNIPPETS)} = i)"
#: The chunks of all documents, in SQL.
_CHUNKS = r"""
chunks AS (
  SELECT doc_id, ord, raw,
    CASE WHEN regexp_full_match(raw, '\+[KEZ][^\n@]+@[KEZ]') OR regexp_full_match(raw, '\{[^}*÷]+\}') THEN 'comment'
      WHEN regexp_full_match(raw, '\+[FLRÜMQ]p?') THEN 'open' WHEN regexp_full_match(raw, '@[FLRÜMQ]p?') THEN 'close'
      WHEN regexp_full_match(raw, '[ \t]*\n[ \t]*') THEN 'newline' WHEN regexp_full_match(raw, '[ \t]') THEN 'space' ELSE 'token' END AS kind
  FROM (SELECT doc_id, unnest(found) AS raw, generate_subscripts(found, 1) AS ord FROM (
    SELECT doc_id, regexp_extract_all(text, '\+[KEZ][^\n@]+@[KEZ]|\+[FLRÜMQ]p?|@[FLRÜMQ]p?|[^\s{+@][^\s+@]*\[?\[?(?:\(=\)|=\||=)\]?\]?[ \t]*\n[ \t]*[^\s{+@][^\s+@]*|[^\s{+@][^\s+@]*|\{[^}*÷]+\}|[ \t]|[ \t]*\n[ \t]*') AS found
    FROM documents))
)"""
_MARKED_CHUNKS = _CHUNKS.replace("FROM documents", f"FROM {_MARKED}")


_HEADED = r"(SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN text WHEN 1 THEN '+H' || chr(10) || 'Sigle: D' || doc_id || chr(10) || ' @H ' || chr(10) || text ELSE text || chr(10) || '+H' || chr(10) || 'a' END AS text FROM documents)"


@query(rf"""
WITH lines AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS ord FROM (SELECT doc_id, regexp_split_to_array(text, '\r\n|\n|\r') AS l FROM {_HEADED})),
marks AS (SELECT *, CASE WHEN trim(line) IN ('+H', '@H') THEN trim(line) END AS m FROM lines)
SELECT doc_id, CAST(ord - 1 AS INTEGER) AS line_no,
  CASE WHEN m IS NOT NULL THEN 'mark' WHEN last_value(m IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY ord) = '+H' THEN 'header' WHEN line = '' THEN 'empty' ELSE 'text' END AS part,
  length(line) AS n_chars FROM marks
""")
def scan_lines(spark: SparkSession, d: str) -> DataFrame:
    """The lines of all documents; some have a header before their text, some one that never ends after it."""
    turn = F.col("doc_id") % 3
    headed = F.when(turn == 0, F.col("text")).when(turn == 1, F.concat(F.lit("+H\nSigle: D"), "doc_id", F.lit("\n @H \n"), "text")).otherwise(F.concat("text", F.lit("\n+H\na")))
    texts = documents(spark, d).select(F.col("doc_id").alias("doc_key"), headed.alias("text"))
    return text_lines(texts).select(F.col("doc_key").alias("doc_id"), "line_no", "part", F.length("line").cast("long").alias("n_chars"))


@query(f"""
WITH {_MARKED_CHUNKS}
SELECT doc_id, kind, count(*) AS n, CAST(sum(length(raw)) AS BIGINT) AS n_chars FROM chunks GROUP BY doc_id, kind
""")
def tokenize_chunks(spark: SparkSession, d: str) -> DataFrame:
    stream = chunks.chunks(marked_documents(spark, d), "doc_id", "text")
    return stream.groupBy("doc_id", "kind").agg(F.count("*").alias("n"), F.sum(F.length("raw")).cast("long").alias("n_chars"))


@query(f"""
WITH {_MARKED_CHUNKS},
d AS (SELECT doc_id, ord, sum(CASE kind WHEN 'open' THEN 1 WHEN 'close' THEN -1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY ord) AS depth FROM chunks)
SELECT doc_id, CAST(greatest(max(depth), 0) AS INTEGER) AS deepest, CAST(least(min(depth), 0) AS INTEGER) AS lowest, CAST(arg_max(depth, ord) AS INTEGER) AS last FROM d GROUP BY doc_id
""")
def shift_tag_depth(spark: SparkSession, d: str) -> DataFrame:
    return marked_documents(spark, d).select("doc_id", chunks.depth_range(F.col("text")).alias("r")).select("doc_id", "r.*")


@query(f"""
WITH RECURSIVE {_MARKED_CHUNKS},
p AS (SELECT doc_id, ord, kind, raw, lag(kind) OVER (PARTITION BY doc_id ORDER BY ord) AS before FROM chunks),
marks AS (SELECT doc_id, ord, kind, substr(raw, 2) AS type, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS k FROM chunks WHERE kind IN ('open', 'close')),
walk(doc_id, k, stack, ord, code) AS (
  SELECT DISTINCT doc_id, CAST(0 AS BIGINT), CAST([] AS VARCHAR[]), CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR) FROM marks
  UNION ALL SELECT m.doc_id, m.k, CASE WHEN m.kind = 'open' THEN list_append(w.stack, m.type) WHEN len(w.stack) > 0 THEN w.stack[1:len(w.stack) - 1] ELSE w.stack END, m.ord,
    CASE WHEN m.kind = 'close' AND len(w.stack) = 0 THEN 'close_not_opened' WHEN m.kind = 'close' AND w.stack[len(w.stack)] <> m.type THEN 'shift_tag_mismatch' END
  FROM walk w JOIN marks m ON m.doc_id = w.doc_id AND m.k = w.k + 1)
SELECT doc_id, CAST(ord - 1 AS INTEGER) AS item_ord, code FROM (
  SELECT doc_id, ord, 'comment_mismatch' AS code FROM p WHERE kind = 'comment' AND raw LIKE '+%' AND raw[2] <> raw[-1]
  UNION ALL SELECT doc_id, ord, 'comment_not_after_blank' FROM p WHERE kind = 'comment' AND raw LIKE '+%' AND coalesce(before, '') NOT IN ('space', 'newline')
  UNION ALL SELECT doc_id, ord, 'tab_between_tokens' FROM p WHERE kind = 'space' AND raw LIKE '%' || chr(9) || '%'
  UNION ALL SELECT doc_id, ord, 'blanks_at_line_end' FROM p WHERE kind = 'newline' AND raw <> chr(10)
  UNION ALL SELECT doc_id, ord, code FROM walk WHERE code IS NOT NULL
  UNION ALL SELECT doc_id, NULL, 'shift_tag_unclosed' FROM (SELECT doc_id, unnest(arg_max(stack, k)) FROM walk GROUP BY doc_id))
""")
def chunk_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    return chunks.diagnostics(chunks.chunks(marked_documents(spark, d), "doc_id", "text"), "doc_id").select("doc_id", "item_ord", "code")


def _tokens(df: DataFrame) -> DataFrame:
    """(doc_id, token, n): each distinct token of a document with its count. Checkpointed, as it is read again for the
    distinct tokens of all documents: texts are cut once."""
    stream = chunks.chunks(df, "doc_id", "text").where("kind = 'token'")
    return checkpointed(stream.groupBy("doc_id", F.col("raw").alias("token")).agg(F.count("*").alias("n")))


def _bounded(tokens: DataFrame) -> DataFrame:
    """Each distinct token once, as characters with bounds; joined back, where adaptive execution picks the join."""
    distinct = tokens.select(F.col("token").alias("_t")).distinct().withColumn("chars", signs.signs(F.col("_t")))
    return bounds.tokenised(distinct)


_SIGNS = r"""
tokens AS (SELECT doc_id, raw AS token, count(*) AS n FROM chunks WHERE kind = 'token' GROUP BY ALL),
parts AS (SELECT DISTINCT token, string_split(token, '') AS c FROM tokens),
cls AS (SELECT token, list_transform(c, lambda x: CASE WHEN x IN ('.', ';', '!', '?', ':', ',', '/') THEN 'P' WHEN x = '=' THEN 'H' WHEN x = '#' THEN 'U'
  WHEN x = '|' THEN 'M' WHEN x = chr(10) THEN 'N' WHEN x = ' ' THEN 'W' ELSE 'T' END) AS k, c FROM parts)"""
#: Bounds by position from 1, with white space before the first and after the last sign; lists give null outside.
_FLAGS = r"""
flags AS (SELECT token, c, k,
  list_transform(range(1, len(k) + 1), lambda i: i > 1 AND k[i-1] IN ('H', 'U')) AS dipl,
  list_transform(range(1, len(k) + 1), lambda i: i > 1 AND coalesce(k[i-1] = 'M', false)) AS split,
  list_transform(range(1, len(k) + 1), lambda i: i > 1 AND (i = 2 OR coalesce(k[i-2] = 'W', false)) AND k[i-1] = 'P' AND k[i] <> 'P') AS initial,
  list_transform(range(1, len(k) + 1), lambda i: i > 1 AND k[i-1] IN ('T', 'H') AND k[i] = 'P' AND (i = len(k) OR k[i+1] NOT IN ('T', 'H', 'U'))) AS final,
  list_transform(range(1, len(k) + 1), lambda i: i > 1 AND k[i-1] = 'P' AND k[i] = 'P' AND c[i-1] <> c[i]) AS unlike
  FROM cls)"""


@query(f"""
WITH {_MARKED_CHUNKS}, {_SIGNS}
SELECT doc_id, CASE k WHEN 'P' THEN 'Punct' WHEN 'H' THEN 'Hyphen' WHEN 'U' THEN 'UniverbSpace' WHEN 'M' THEN 'MultiverbSpace' WHEN 'N' THEN 'LineBreak'
  WHEN 'W' THEN 'Whitespace' ELSE 'TextChar' END AS cls, CAST(sum(n) AS BIGINT) AS n
FROM (SELECT doc_id, n, unnest(k) AS k FROM tokens JOIN cls USING (token)) GROUP BY ALL
""")
def char_class_histogram(spark: SparkSession, d: str) -> DataFrame:
    tokens = _tokens(marked_documents(spark, d))
    classes = F.transform(F.filter(F.split("token", ""), lambda c: c != ""), signs.sign_class)
    return tokens.select("doc_id", "n", F.explode(classes).alias("cls")).groupBy("doc_id", "cls").agg(F.sum("n").alias("n"))


@query(f"""
WITH {_MARKED_CHUNKS}, {_SIGNS}, {_FLAGS}
SELECT doc_id, CAST(sum(n * len(list_filter(initial, lambda x: x))) AS BIGINT) AS n_initial, CAST(sum(n * len(list_filter(final, lambda x: x))) AS BIGINT) AS n_final,
  CAST(sum(n * len(list_filter(unlike, lambda x: x))) AS BIGINT) AS n_unlike, CAST(sum(n * len(list_filter(split, lambda x: x))) AS BIGINT) AS n_split,
  CAST(sum(n * len(list_filter(dipl, lambda x: x))) AS BIGINT) AS n_dipl
FROM tokens JOIN flags USING (token) GROUP BY doc_id
""")
def bounds_by_rule(spark: SparkSession, d: str) -> DataFrame:
    tokens = _tokens(marked_documents(spark, d))
    distinct = tokens.select(F.col("token").alias("_t")).distinct().withColumn("chars", signs.signs(F.col("_t")))
    rules = {
        "n_initial": lambda m: m.is_a(-2, "Whitespace") & ~m.is_a(-2, "LineBreak") & m.is_a(-1, "Punct") & ~m.is_a(0, "Punct"),
        "n_final": lambda m: m.is_a(-1, "TextChar") & m.is_a(0, "Punct") & ~m.is_a(1, "TextChar", "Joiner", "UniverbSpace"),
        "n_unlike": lambda m: m.is_a(-1, "Punct") & m.is_a(0, "Punct") & m.unlike,
        "n_split": lambda m: m.is_a(-1, "MultiverbSpace", "MultiverbNewline"),
        "n_dipl": bounds.dipl_bound,
    }
    seen = distinct.withColumn("near", bounds.around(F.col("chars")))
    count = lambda rule: F.size(F.filter("near", lambda w: rule(bounds.Near(w))))
    counted = seen.select("_t", *[count(r).alias(k) for k, r in rules.items()])
    met = tokens.join(counted, F.col("token") == F.col("_t"))
    return met.groupBy("doc_id").agg(*[F.sum(F.col("n") * F.col(k)).cast("long").alias(k) for k in rules])


@query(f"""
WITH {_CHUNKS}, {_SIGNS}, {_FLAGS},
counted AS (SELECT token, CASE WHEN regexp_full_match(token, '[=#|\\s]+') THEN 0
  ELSE 1 + len(list_filter(range(1, len(k) + 1), lambda i: split[i] OR initial[i] OR final[i] OR unlike[i])) END AS annos, length(regexp_replace(token, '[=#|\\s]', '', 'g')) AS chars FROM flags)
SELECT lang, CAST(sum(n) AS BIGINT) AS n_tokens, CAST(sum(n * annos) AS BIGINT) AS n_annos, CAST(sum(n * chars) AS BIGINT) AS n_chars,
  round(sum(n * chars) / sum(n * annos), 6) AS mean_length
FROM tokens JOIN counted USING (token) JOIN (SELECT doc_id, lang FROM documents) USING (doc_id) GROUP BY lang
""")
def anno_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Annotatable tokens and their mean length by language: text to chunks to characters to bounds to pieces.

    One scan and one shuffle of counted tokens; each token of a language is split once, and nothing is joined.
    """
    stream = chunks.chunks(documents(spark, d), "lang", "text").where("kind = 'token'")
    tokens = stream.groupBy("lang", F.col("raw").alias("token")).agg(F.count("*").alias("n"))
    made = bounds.tokenised(tokens.withColumn("chars", signs.signs(F.col("token"))))
    pieces = made.select("lang", "n", F.size("annos").alias("annos"), F.aggregate("annos", F.lit(0), lambda a, x: a + F.length(x["utf"])).alias("chars"))
    return pieces.groupBy("lang").agg(
        F.sum("n").alias("n_tokens"), F.sum(F.col("n") * F.col("annos")).cast("long").alias("n_annos"),
        F.sum(F.col("n") * F.col("chars")).cast("long").alias("n_chars"),
        F.round(F.sum(F.col("n") * F.col("chars")) / F.sum(F.col("n") * F.col("annos")), 6).alias("mean_length"),
    )


@query(f"""
WITH {_MARKED_CHUNKS}, {_SIGNS}, {_FLAGS}
SELECT doc_id, CAST(sum(n * (1 + len(list_filter(dipl, lambda x: x)))) AS BIGINT) AS n_dipls,
  CAST(sum(n * length(regexp_replace(token, '[#|\\s]', '', 'g'))) AS BIGINT) AS n_chars
FROM tokens JOIN flags USING (token) GROUP BY doc_id
""")
def dipl_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Diplomatic pieces and their signs, those of tokens joined over a line's end too."""
    tokens = _tokens(marked_documents(spark, d))
    pieces = _bounded(tokens).select("_t", F.size("dipls").alias("dipls"), F.aggregate("dipls", F.lit(0), lambda a, x: a + F.length(x["utf"])).alias("chars"))
    met = tokens.join(pieces, F.col("token") == F.col("_t"))
    return met.groupBy("doc_id").agg(F.sum(F.col("n") * F.col("dipls")).cast("long").alias("n_dipls"), F.sum(F.col("n") * F.col("chars")).cast("long").alias("n_chars"))


@query(r"""
SELECT doc_id, md5(simple) AS simple_md5, CAST(length(simple) AS BIGINT) AS n_chars, simple <> text AS changed FROM (
  SELECT doc_id, text, replace(replace(translate(text, 'âêîôûÂÊÎÔÛáéíóúýÁÉÍÓÚÝàèìòùÀÈÌÒÙſ', 'aeiouAEIOUaeiouyAEIOUYaeiouAEIOUs'), 'æ', 'ae'), 'Æ', 'Ae') AS simple FROM documents)
""")
def simplify_chars(spark: SparkSession, d: str) -> DataFrame:
    rows = documents(spark, d).withColumn("simple", signs.simple(F.col("text")))
    return rows.select("doc_id", F.md5(F.encode("simple", "UTF-8")).alias("simple_md5"), F.length("simple").cast("long").alias("n_chars"), (F.col("simple") != F.col("text")).alias("changed"))


@query(r"""
SELECT doc_id, NOT coalesce(bool_or(regexp_matches(line, '[{}@]')), false) AS valid
FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '\r\n|\n|\r')) AS line FROM documents) GROUP BY doc_id
""")
def doc_reject(spark: SparkSession, d: str) -> DataFrame:
    """A document with one faulty line is rejected as a whole."""
    texts = documents(spark, d).select(F.col("doc_id").alias("doc_key"), "text")
    return validate.rejected(text_lines(texts), "doc_key", F.col("line").rlike("[{}@]")).withColumnRenamed("doc_key", "doc_id")


@query(r"""
SELECT doc_id, lang, source, CAST(n_entries AS INTEGER) AS n_entries FROM (SELECT doc_id, lang, source, 3 AS n_entries FROM documents)
""")
def header_parse(spark: SparkSession, d: str) -> DataFrame:
    """Headers made of each document's columns, parsed again; of equal keys the last counts."""
    text = F.concat(F.lit("lang:xx\nlang:"), "lang", F.lit("\nsource:"), "source", F.lit("\nwithout colon"))
    rows = documents(spark, d).withColumn("h", headers.parse_header(text))
    value = lambda k: F.try_element_at(F.try_element_at("h", F.lit(k)), F.lit(1))
    return rows.select("doc_id", value("lang").alias("lang"), value("source").alias("source"), F.size("h").alias("n_entries"))


@query(r"""
SELECT doc_id, md5(coalesce(string_agg(line, chr(10) ORDER BY ord), '')) AS rest_md5, count(line) AS n_lines FROM (
  SELECT doc_id, CASE WHEN NOT regexp_matches(line, '^(The|Der|La |Les )') THEN line END AS line, ord
  FROM (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS ord FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))) GROUP BY doc_id
""")
def header_denylist(spark: SparkSession, d: str) -> DataFrame:
    """Lines that begin with listed words are taken out."""
    marked = F.concat(F.lit("#\n"), "text")  # so that what is left tells no line from an empty one
    rest = headers.without_lines(marked, ["The", "Der", "La ", "Les "])
    rows = documents(spark, d).withColumn("rest", rest)
    return rows.select("doc_id", F.md5(F.encode(F.expr("substring(rest, 3)"), "UTF-8")).alias("rest_md5"), (F.size(F.split("rest", "\n")) - 1).cast("long").alias("n_lines"))


@query(r"""
SELECT doc_id, CASE WHEN m.source IS NULL THEN 'Datum: x' || chr(10) || ' lang: ' || lang || chr(10)
  ELSE CASE WHEN d.source = 'src1' THEN 'source: src1' || chr(10) || 'note: later' || chr(10) ELSE '' END || 'source: ' || m.source || chr(10) || 'note: ' || m.n || chr(10) || 'lang: ' || lang END AS header
FROM documents d LEFT JOIN (SELECT source, count(*) AS n FROM documents WHERE source <> 'src3' GROUP BY source) m ON d.source = m.source
""")
def metadata_join(spark: SparkSession, d: str) -> DataFrame:
    """Headers repaired from a side table of metadata: a sigle that it lacks keeps its header, one that is there twice gets both."""
    docs = documents(spark, d)
    table = docs.where("source <> 'src3'").groupBy("source").agg(F.count("*").cast("string").alias("note")).orderBy("source").coalesce(1)
    later = spark.createDataFrame([("src1", "later")], "source string, note string")
    both = table.unionByName(later).select(F.concat(F.lit(" "), "source").alias("source"), "note").withColumn("source", F.trim("source"))
    heads = docs.select("doc_id", F.col("source").alias("sigle"), F.concat(F.lit("Datum: x\n lang: "), "lang", F.lit("\n")).alias("header_string"))
    return headers.repaired(heads, both).select("doc_id", F.col("header_string").alias("header"))


@query(r"""
SELECT doc_id, CASE WHEN m.source IS NULL THEN '' ELSE 'documents: ' || m.n || chr(10) END || 'lang: ' || lang AS header
FROM documents d LEFT JOIN (SELECT source, count(*) AS n FROM documents WHERE source <> 'src3' GROUP BY source) m ON d.source = m.source
""")
def header_change(spark: SparkSession, d: str) -> DataFrame:
    """Headers of a folder: listed lines go everywhere, entries come where the table has the sigle, without the sigle itself."""
    docs = documents(spark, d)
    table = docs.where("source <> 'src3'").groupBy("source").agg(F.count("*").cast("string").alias("documents"))
    heads = docs.select("doc_id", F.col("source").alias("sigle"), F.concat(F.lit("Datum: x\nlang: "), "lang").alias("header_string"))
    return headers.changed_headers(heads, table, delete=True).select("doc_id", F.col("header_string").alias("header"))


@query(f"""
WITH lines AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS ord FROM (SELECT doc_id, regexp_split_to_array(text, '\\r\\n|\\n|\\r') AS l FROM documents)),
bodies AS (SELECT doc_id, string_agg(regexp_replace(line, '^\\s+|\\s+$', '', 'g'), chr(10) ORDER BY ord) AS text FROM lines WHERE line <> '' GROUP BY doc_id),
{_CHUNKS.strip().replace("FROM documents", "FROM bodies")},
placed AS (SELECT doc_id, ord, kind, raw, 1 + coalesce(sum(length(raw) - length(replace(raw, chr(10), ''))) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS line FROM chunks)
SELECT d.doc_id, count(DISTINCT CASE WHEN kind = 'token' THEN line END) AS n_lines, count(*) FILTER (WHERE kind = 'token') AS n_tokens, count(*) FILTER (WHERE kind = 'token') AS n_annos,
  CAST(coalesce(sum(length(replace(raw, chr(10), ''))) FILTER (WHERE kind = 'token'), 0) AS BIGINT) AS n_chars
FROM documents d LEFT JOIN placed p ON d.doc_id = p.doc_id GROUP BY d.doc_id
""")
def trans_corpus(spark: SparkSession, d: str) -> DataFrame:
    """All documents read as transcriptions into the tables of a corpus, in the plain dialect; what the tables hold."""
    prepared(spark)
    corpus = read_trans(documents(spark, d).select(F.col("doc_id").cast("string").alias("doc_key"), "text"), "plain", strict=False)
    lines = corpus.lines.groupBy("doc_key").agg(F.count("*").alias("n_lines"))
    dipls = corpus.dipls.groupBy("doc_key").agg(F.count("*").alias("n_tokens"), F.sum(F.length("utf")).cast("long").alias("n_chars"))
    annos = corpus.annos.groupBy("doc_key").agg(F.count("*").alias("n_annos"))
    rows = corpus.documents.select("doc_key").join(lines, "doc_key", "left").join(dipls, "doc_key", "left").join(annos, "doc_key", "left")
    return rows.select(F.col("doc_key").cast("long").alias("doc_id"), *[F.coalesce(n, F.lit(0).cast("long")).alias(n) for n in ("n_lines", "n_tokens", "n_annos", "n_chars")])


@query(r"""
SELECT doc_id, CAST(w AS INTEGER) AS tokens, CASE WHEN w >= 2 THEN 'MS1' END AS first, CASE WHEN w >= 2 THEN 'MS2' END AS second, CASE WHEN w >= 4 THEN 'MS1' END AS third, CASE WHEN w >= 4 THEN 'MS4' END AS fourth
FROM (SELECT doc_id, CASE lang WHEN 'en' THEN 1 WHEN 'de' THEN 2 WHEN 'fr' THEN 3 ELSE 4 END AS w FROM documents)
""")
def verbation_tags(spark: SparkSession, d: str) -> DataFrame:
    """Tags of split words: each document has one word split into as many parts as its language's number."""
    parts = F.when(F.col("lang") == "en", 1).when(F.col("lang") == "de", 2).when(F.col("lang") == "fr", 3).otherwise(4)
    rows = documents(spark, d).select("doc_id", F.array_join(F.array_repeat(F.lit("ab"), parts), "|").alias("word"))
    empty = lambda a: a.withField("tags", F.expr("cast(map() as map<string,string>)"))
    made = bounds.tokenised(rows.withColumn("chars", signs.signs(F.col("word"))))
    made = made.withColumn("annos", F.transform("annos", empty)).withColumn("annos", modify.verbation_tags(F.col("annos")))
    tag = lambda k: modify.get(F.get("annos", F.lit(k))["tags"], "token_type")
    return made.select("doc_id", F.size("annos").alias("tokens"), tag(0).alias("first"), tag(1).alias("second"), tag(2).alias("third"), tag(3).alias("fourth"))


@query(f"""
WITH {_CHUNKS}, {_SIGNS}
SELECT doc_id, CAST(sum(n) FILTER (WHERE len(list_filter(k, lambda x: x = 'P')) > 0) AS BIGINT) AS n_punct, CAST(sum(n) AS BIGINT) AS n_tokens FROM tokens JOIN cls USING (token) GROUP BY doc_id
""")
def punct_pos(spark: SparkSession, d: str) -> DataFrame:
    """Tokens that would get the part of speech of punctuation."""
    tokens = _tokens(documents(spark, d)).withColumn("chars", signs.signs(F.col("token")))
    one = F.array(F.struct("chars", F.create_map(F.lit("pos"), F.lit("--")).alias("tags")))
    tagged = tokens.withColumn("a", modify.punct_pos(one))
    hit = modify.get(F.get("a", F.lit(0))["tags"], "pos") == "$("
    return tagged.groupBy("doc_id").agg(F.sum(F.when(hit, F.col("n"))).alias("n_punct"), F.sum("n").alias("n_tokens"))
