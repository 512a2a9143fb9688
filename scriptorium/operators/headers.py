"""Headers: parsing, repair from side tables, and decoding of sigles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Beginnings of header lines that a repair takes out.
DROPPED = [
    "Text eingegeben", "Datum", "Bearbeiter", "Text vorkollationiert", "Text kollationiert", "Lat. Passage", "Kenn-Name",
    "Präeditiert", "Praeditiert", "Grubert-Nummer", "Datierung", "Lokalisierung", "Textart", "Fassung", "Bibliothek", "Archiv",
    "Signatur", "Folio", "Blatt", "Edition", "Provenienz", "Literatur", "vorhandener Text", "Vorhandener Text",
]


def parse_header(text: Column) -> Column:
    """map of key to the pieces after it, between colons; untrimmed; without a colon no piece. The last of equal keys wins."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x != "")
    pairs = F.transform(lines, lambda x: F.split(x, ":"))
    entries = F.transform(pairs, lambda p: F.struct(p[0].alias("key"), F.slice(p, 2, F.size(p) - 1).alias("value")))
    last = F.filter(
        F.transform(entries, lambda e, i: F.when(~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda x: x["key"] == e["key"]), e)),
        lambda e: e.isNotNull(),
    )
    return F.map_from_entries(last)


def sigle(text: Column) -> Column:
    """The first word after a colon and blanks, up to an underscore; null without one."""
    found = F.regexp_extract(text, r"(?U)[^:\s]:\s+(\w+)", 1)
    return F.nullif(F.split_part(found, F.lit("_"), F.lit(1)), F.lit(""))


def without_lines(text: Column, beginnings: list[str]) -> Column:
    """The text without lines that begin with one of the strings."""
    pattern = "^(" + "|".join(quoted(b) for b in beginnings) + ")"
    return F.array_join(F.filter(F.split(text, "\n"), lambda x: ~x.rlike(pattern)), "\n")


def quoted(text: str) -> str:
    return "\\Q" + text + "\\E"


def read_side_table(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A table of tab-separated strings with a header line."""
    return spark.read.csv(path, sep="\t", header=True, schema=", ".join(f"`{c}` string" for c in columns))


def _kept_lines(text: Column, beginnings: list[str]) -> Column:
    """The lines, trimmed, that are not empty and don't begin with one of the strings."""
    pattern = "^(" + "|".join(quoted(b) for b in beginnings) + ")"
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(x))
    return F.filter(lines, lambda x: (x != "") & ~x.rlike(pattern))


def _entries(table: DataFrame, columns: list[str]) -> DataFrame:
    """(_sigle, _rows): for each value of the first column the lines ``column: value`` of its rows, the last row first."""
    key = table.columns[0]
    lines = F.array(*[F.concat(F.lit(f"{c}: "), F.coalesce(F.col(f"`{c}`"), F.lit(""))) for c in columns])
    rows = table.select(F.trim(F.col(f"`{key}`")).alias("_sigle"), lines.alias("lines"), F.monotonically_increasing_id().alias("n"))
    rows = rows.where("_sigle is not null").groupBy("_sigle").agg(F.sort_array(F.collect_list(F.struct("n", "lines")), asc=False).alias("_rows"))
    return rows.withColumn("_rows", F.transform("_rows", lambda x: x["lines"]))


def repaired(documents: DataFrame, metadata: DataFrame, beginnings: list[str] | None = None) -> DataFrame:
    """``documents`` (sigle, header_string) with the header repaired where ``metadata`` knows the sigle, else as they were.

    The first column of ``metadata`` is the sigle. The header loses the listed lines and gets the row's entries before all
    others. Of several rows of one sigle each is put before what was there, so the last one comes first, and what earlier
    ones brought loses listed lines too. A document stays one row. Adaptive execution picks the join.
    """
    listed = beginnings or DROPPED
    met = documents.join(_entries(metadata, metadata.columns), F.col("sigle") == F.col("_sigle"), "left")
    earlier = F.flatten(F.slice("_rows", 2, F.greatest(F.size("_rows") - 1, F.lit(0))))
    rest = _kept_lines(F.concat_ws("\n", F.array_join(earlier, "\n"), "header_string"), listed)
    new = F.array_join(F.concat(F.get("_rows", F.lit(0)), rest), "\n")
    return met.withColumn("header_string", F.when(F.col("_rows").isNotNull(), new).otherwise(F.col("header_string"))).drop("_sigle", "_rows")


def changed_headers(documents: DataFrame, table: DataFrame | None = None, delete: bool = False, beginnings: list[str] | None = None) -> DataFrame:
    """``documents`` (sigle, header_string) with listed lines deleted, if ``delete``, from all of them, and with the entries
    of ``table`` put before the header where it knows the sigle: all columns but the first, which is the sigle; the last of
    several rows counts."""
    body = F.array_join(_kept_lines(F.col("header_string"), beginnings or DROPPED), "\n") if delete else F.col("header_string")
    if table is None:
        return documents.withColumn("header_string", body)
    met = documents.join(_entries(table, table.columns[1:]), F.col("sigle") == F.col("_sigle"), "left")
    entry = F.nullif(F.array_join(F.get("_rows", F.lit(0)), "\n"), F.lit(""))
    return met.withColumn("header_string", F.concat_ws("\n", entry, F.nullif(body, F.lit("")))).drop("_sigle", "_rows")


def looked_up(documents: DataFrame, table: DataFrame, value: str, digits: int = 4) -> DataFrame:
    """``documents`` with ``value`` of the side table whose first column is the beginning of the sigle; ``missing`` if none."""
    key = table.columns[0]
    rows = table.select(F.col(key).alias("_k"), F.col(value).alias(value), F.lit(True).alias("_found"))
    met = documents.join(rows, F.substring("sigle", 1, digits) == F.col("_k"), "left")
    return met.withColumn("missing", F.col("_found").isNull()).drop("_k", "_found")


#: What header keys begin with, and what they are called in the reference corpus, in the order of its headers.
RENAMED = [
    ("Korpus-Sigle", "corpus-sigle"),
    ("Titel", "text"),
    ("Verfasser", "text-author"),
    ("Text[$s]orte", "text-type"),
    ("Zuordnung[$s]qualität", "assignment_quality"),
    ("Hoffmann/Wetter-Nr", "hoffmann_wetter_nr"),
    ("Bibliothek/Archiv", "library"),
    ("[$S]ignatur", "library-shelfmark"),
    ("Datierung", "date"),
    ("Druckort", "place"),
    ("Schreibort", "text-place"),
    ("Drucker", "printer"),
    (r"verwendete\sEdition", "edition"),
    ("Literatur", "literature"),
    (r"Ge[$s]amtumfang|Umfang\s*in\s*Wortformen\s*:|Umfang\s*in\s*Wortformen\s*\(*\s*insgesamt\s*\)*", "size"),
]
#: What header keys of extents and sizes begin with.
EXTENTS = {
    "extent_old": r"Auswahl\s*Bonner\s*Frnhd\.\s*Korpus",
    "extent_new": r"(Auswahl|Ergänzung)\s*Referenzkorpus",
    "size_old": r"Umfang\s*in\s*Wortformen\s*\(\s*Frnhd\.\s*Korpus\s*\)",
    "size_new": r"Umfang\s*in\s*Wortformen\s*\(\s*Referenzkorpus\s*\)",
}
#: What the parts of a sigle stand for.
SIGLE = r"(F\d+)[,\s]*([IV]+)-([A-F])([a-f]+)-([PVT])\d*[,(\s]*(H|D)"
TIMES = {"I": "14,2", "II": "15,1", "III": "15,2", "IV": "16,1", "V": "16,2", "VI": "17,1"}
REGIONS = {"B": ("oberdeutsch", "westoberdeutsch"), "C": ("mitteldeutsch", "westmitteldeutsch")}
AREAS = {
    "Ba": "oberrheinisch", "Bb": "hochalemannisch", "Bc": "schwäbisch", "Bd": "ostschwäbisch", "Bcd": "gesamtschwäbisch",
    "Ca": "ripuarisch", "Cb": "moselfränkisch", "Cc": "hessisch", "Cd": "südrheinfränkisch", "Ccd": "hessisch-südrheinfränkisch",
    "Cabcd": "westmitteldeutsch",
}
MEDIA = {"H": ("Handschrift", "Hs.: Blatt (r/v), Kolumne (a/b), Zeile"), "D": ("Druck", "Seite, Zeile")}


def _table(codes: dict[str, str], value: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in codes.items() for x in pair]), value), F.lit("-"))


def decoded_sigle(text: Column) -> Column:
    """struct of what a sigle says: area, region, type, genre, medium, time, reference; null if it is no such sigle."""
    part = lambda i: F.regexp_extract(text, SIGLE, i)
    made = F.struct(
        _table(AREAS, F.concat(part(3), part(4))).alias("area"),
        _table({k: v[1] for k, v in REGIONS.items()}, part(3)).alias("region"),
        _table({k: v[0] for k, v in REGIONS.items()}, part(3)).alias("type"), part(5).alias("genre"),
        _table({k: v[0] for k, v in MEDIA.items()}, part(6)).alias("medium"), _table(TIMES, part(2)).alias("time"),
        _table({k: v[1] for k, v in MEDIA.items()}, part(6)).alias("reference"),
    )
    return F.when(text.rlike(SIGLE), made)


def _value(lines: Column, pattern: str, several: bool = False) -> Column:
    """What follows the colon in the last line that begins with the pattern, or in all; a dash if it is empty or dashes."""
    found = F.filter(lines, lambda x: x.rlike(f"(?i)^({pattern})"))
    values = F.transform(found, lambda x: F.trim(F.regexp_extract(x, r"(?s)^[^:]*:(.*)$", 1)))
    value = F.array_join(F.filter(values, lambda v: v != ""), ", ") if several else F.element_at(values, -1)
    return F.when(F.size(values) > 0, F.when(value.rlike("^-*$"), "-").otherwise(value))


def reference_header(documents: DataFrame, notes: DataFrame, abbreviations: DataFrame, key: str = "doc_key") -> DataFrame:
    """``documents`` with ``header_string`` rewritten for the reference corpus.

    Header lines get their new names (a dash where there is none), the sigle is decoded, a manuscript's place of printing
    becomes its place of writing, and notes (sigle prefix, note) and abbreviations (abbreviation, sigle prefix) are looked
    up by the first four characters of the corpus sigle; without an entry the value is a dash.
    """
    lines = F.filter(F.transform(F.split(F.trim("header_string"), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    rows = documents.withColumn("_lines", lines)
    values = {new: _value(F.col("_lines"), old) for old, new in RENAMED}
    rows = rows.withColumn("_v", F.struct(*[v.alias(k) for k, v in values.items()])).withColumn("_d", decoded_sigle(F.col("_v.corpus-sigle")))
    by_hand = F.coalesce(F.col("_d.medium") == MEDIA["H"][0], F.lit(False))
    note = notes.select(F.col(notes.columns[0]).alias("_n"), F.trim(F.col(notes.columns[1])).alias("_note"))
    short = abbreviations.select(F.trim(F.col(abbreviations.columns[1])).alias("_a"), F.trim(F.col(abbreviations.columns[0])).alias("_short"))
    prefix = F.substring(F.col("_v.corpus-sigle"), 1, 4)
    rows = rows.join(note, prefix == F.col("_n"), "left").join(short, prefix == F.col("_a"), "left")
    out = []
    line = lambda name, value: F.concat(F.lit(f"{name}: "), F.coalesce(value, F.lit("-")))
    for _, new in RENAMED:
        value = F.col(f"_v.`{new}`")
        if new == "corpus-sigle":
            for name, part in (("language-area", "area"), ("language-region", "region"), ("language-type", "type"), ("genre", "genre"), ("medium", "medium"), ("time", "time"), ("reference", "reference")):
                out.append(F.when(F.col("_d").isNotNull(), line(name, F.col(f"_d.{part}"))))
        if new == "place":
            moved = by_hand & value.isNotNull()
            out.append(F.when(moved, line("place", F.lit(None).cast("string"))).otherwise(line("place", value)))
            out.append(F.when(moved, line("text-place", value)))
        elif new == "text-place":
            out.append(F.when(~(by_hand & F.col("_v.place").isNotNull()), line(new, value)))
        else:
            out.append(line(new, value))
    parts = {k: F.coalesce(_value(F.col("_lines"), p, k == "extent_new"), F.lit("-")) for k, p in EXTENTS.items()}
    out += [
        F.lit("language: fnhd"), F.lit("corpus: ReF.BO"), line("notes-transcription", F.col("_note")), line("abbr_ddd", F.col("_short")),
        F.concat(F.lit("extent: FnhdC: "), parts["extent_old"], F.lit("; compl: "), parts["extent_new"]),
        F.concat(F.lit("extent-size: FnhdC: "), parts["size_old"], F.lit("; compl: "), parts["size_new"]),
    ]
    return rows.withColumn("header_string", F.concat_ws("\n", *out)).drop("_lines", "_v", "_d", "_n", "_note", "_a", "_short")
