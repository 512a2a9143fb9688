"""Changes of annotations, on maps of tags and arrays of flags; each is a column expression or a DataFrame step."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import UNSET, Corpus, is_a
from . import bounds
from .headers import repaired


def get(tags: Column, name: str) -> Column:
    return F.try_element_at(tags, F.lit(name))


def put(tags: Column, name: str, value: Column) -> Column:
    """The map with one value set."""
    return F.map_concat(remove(tags, name), F.create_map(F.lit(name), value))


def remove(tags: Column, name: str, value: Column | None = None) -> Column:
    """Without a tag, or only where it has the value. A tag that is not there is no error."""
    gone = lambda k, v: (k == name) if value is None else (k == name) & (v == value)
    return F.map_filter(tags, lambda k, v: ~F.coalesce(gone(k, v), F.lit(False)))


def append(tags: Column, name: str, value: Column, sep: str = " ") -> Column:
    """Adds to a tag's value; an unset or missing one is replaced."""
    old = F.nullif(get(tags, name), F.lit(UNSET))
    return put(tags, name, F.concat_ws(sep, old, value))


def fill(tags: Column, name: str, default: str) -> Column:
    return F.when(F.map_contains_key(tags, name), tags).otherwise(put(tags, name, F.lit(default)))


def recode(tags: Column, name: str, codes: dict[str, str]) -> Column:
    """Values of a tag by a dictionary; others stay."""
    if not codes:
        return tags
    table = F.create_map(*[F.lit(x) for pair in codes.items() for x in pair])
    return F.transform_values(tags, lambda k, v: F.when(k == name, F.coalesce(F.try_element_at(table, v), v)).otherwise(v))


def merge(tags: Column, a: str, b: str, into: str, sep: str = ".") -> Column:
    """Two tags as one: a, sep, b; a alone is taken over; b alone changes nothing."""
    x, y = get(tags, a), get(tags, b)
    rest = remove(remove(tags, a), b)
    return (
        F.when(x.isNotNull() & y.isNotNull(), put(rest, into, F.concat(x, F.lit(sep), y)))
        .when(x.isNotNull(), put(remove(tags, a), into, x))
        .otherwise(tags)
    )


def split(tags: Column, source: str, first: str, second: str, sep: str = ".") -> Column:
    """A tag as two: its trimmed, non-empty parts; with fewer than two, the first gets the whole value.

    The source goes, unless it is one of the two results.
    """
    value = get(tags, source)
    parts = F.filter(F.transform(F.split(value, F.concat(F.lit("\\Q"), F.lit(sep), F.lit("\\E"))), lambda x: F.trim(x)), lambda x: x != "")
    rest = tags if source in (first, second) else remove(tags, source)
    two = put(put(rest, first, parts[0]), second, F.get(parts, F.lit(1)))
    return F.when(value.isNull(), tags).when(F.size(parts) >= 2, two).otherwise(put(rest, first, value))


def with_flag(flags: Column, name: str) -> Column:
    return F.array_sort(F.array_union(flags, F.array(F.lit(name))))


def without_flag(flags: Column, name: str) -> Column:
    return F.array_remove(flags, name)


# ---------------------------------------------------------------- a token's annos: array<struct<chars, tags, flags, ...>>


def punct_pos(annos: Column) -> Column:
    """The tag pos of punctuation, where it is unset."""
    unset = lambda a: F.coalesce(get(a["tags"], "pos"), F.lit(UNSET)) == UNSET
    return F.transform(
        annos,
        lambda a: F.when(bounds.has(a["chars"], "Punct") & unset(a), a.withField("tags", put(a["tags"], "pos", F.lit("$(")))).otherwise(a),
    )


def verbation_tags(annos: Column) -> Column:
    """The tag token_type: MS or ML and a number for the parts of a split word, US, UL and UH for each join.

    A fold over the annos. The first part of a pair has the number 1, the second the number of parts that were tagged up to
    it; a second part does not begin another pair. What the tag had before stays in front.
    """
    join = lambda a: F.array_join(F.filter(F.transform(a["chars"], lambda c: F.when(is_a(c["mask"], "Hyphen"), "UH").when(is_a(c["mask"], "UniverbSpace"), "US").when(is_a(c["mask"], "UniverbNewline"), "UL")), lambda x: x.isNotNull()), " ")  # noqa: E731, E501
    start = F.struct(F.slice(annos, 1, 0).alias("out"), F.lit("").alias("pending"), F.lit(0).alias("n"))

    def step(s: Column, a: Column) -> Column:
        kind = F.when(bounds.has(a["chars"], "MultiverbNewline"), "ML").when(bounds.has(a["chars"], "MultiverbSpace"), "MS").otherwise("")
        ends = s["pending"] != ""
        mark = F.when(ends, F.concat(s["pending"], (s["n"] + 1).cast("string"))).when(kind != "", F.concat(kind, F.lit("1")))
        value = F.concat_ws(" ", mark, F.nullif(join(a), F.lit("")))
        tagged = F.when(value != "", append(a["tags"], "token_type", value)).otherwise(a["tags"])
        return F.struct(
            F.concat(s["out"], F.array(a.withField("tags", tagged))).alias("out"),
            F.when(ends, F.lit("")).otherwise(kind).alias("pending"),
            (s["n"] + F.when(mark.isNotNull(), 1).otherwise(0)).alias("n"),
        )

    return F.aggregate(annos, start, step, lambda s: s["out"])


def is_mark(anno: Column) -> Column:
    """Is the anno one sentence mark and nothing else?"""
    return (F.size(anno["chars"]) == 1) & is_a(F.get(anno["chars"], F.lit(0))["mask"], "SentBound")


def punct_fold(annos: Column, tag: str = "punc") -> Column:
    """Sentence marks become a tag and flag of the anno before; leading ones of the first anno, before a bar.

    The marks' annos go; marks without any other anno are lost.
    """
    start = F.struct(F.slice(annos, 1, 0).alias("out"), F.lit("").alias("lead"))

    def marked(a: Column, text: Column) -> Column:
        return a.withField("tags", append(a["tags"], tag, text)).withField("flags", with_flag(a["flags"], tag))

    def step(s: Column, a: Column) -> Column:
        text = bounds.form(a["chars"], "string")
        last = F.element_at(s["out"], -1)
        onto = F.concat(F.slice(s["out"], 1, F.greatest(F.size(s["out"]) - 1, F.lit(0))), F.array(marked(last, text)))
        lead = F.when(s["lead"] != "", marked(a, F.concat(s["lead"], F.lit(" |")))).otherwise(a)
        return (
            F.when(is_mark(a) & (F.size(s["out"]) > 0), F.struct(onto.alias("out"), F.lit("").alias("lead")))
            .when(is_mark(a), F.struct(s["out"].alias("out"), F.concat_ws(" ", F.nullif(s["lead"], F.lit("")), text).alias("lead")))
            .otherwise(F.struct(F.concat(s["out"], F.array(lead)).alias("out"), F.lit("").alias("lead")))
        )

    return F.aggregate(annos, start, step, lambda s: s["out"])


# ---------------------------------------------------------------- the corpora's own steps, on the annos table

#: Lemmas of verbs with irregular forms, by the beginning of their part of speech.
IRREGULAR = {
    "VV": ["gönnen", "taugen", "turren", "wissen", "gehen", "stehen", "tun", "lassen"],
    "VA": ["haben", "sein"],
    "VM": ["dürfen", "können", "mögen", "müssen", "sollen", "wollen"],
}
#: Fixed value: where the entries of the dictionary are.
DICTIONARY = "http://www.woerterbuchnetz.de/DWB"
#: Kinds of norms and parts of speech as they are written out.
NORM_TYPES = {"f": "inflection", "s": "semantic", "x": "extinct"}
ANSELM_POS = {"PDN": "PDS", "PIN": "PIS"}


def changed(df: DataFrame, *changes: Callable[[Column], Column], tags: str = "tags") -> DataFrame:
    """The changes one after the other, each in a step of its own: nested expressions would be written out many times."""
    for change in changes:
        df = df.withColumn(tags, change(F.col(tags)))
    return df


REF_CONVERT = [lambda t: merge(t, "pos", "lemmapos", "pos", "<"), lambda t: merge(t, "pos", "morph", "pos", ".")]


def lemma_address(tags: Column, link: bool = False) -> Column:
    """The address of the lemma's entry, by its number or else by the lemma."""
    number = F.regexp_extract(get(tags, "lemmaId"), r"(?U)(\w+)", 1)
    by = F.when(number.isNotNull(), "lemid").otherwise("lemma")
    entry = F.coalesce(number, F.trim(get(tags, "lemma")))
    address = F.concat(F.lit(f"{DICTIONARY}?"), by, F.lit("="), entry)
    if link:
        address = F.concat(F.lit("<a href='"), address, F.lit("'>"), entry, F.lit("</a>"))
    return F.when(entry.isNotNull(), put(tags, "lemmaURL", address)).otherwise(tags)


def irregular_verbs(tags: Column, irregular: dict[str, list[str]] | None = None) -> Column:
    """The last of five parts of morph, an asterisk, becomes Unr for irregular verbs."""
    hit = F.lit(False)
    for pos, lemmas in (irregular or IRREGULAR).items():
        hit = hit | (F.coalesce(get(tags, "pos"), F.lit("")).startswith(pos) & F.coalesce(get(tags, "lemma"), F.lit("")).isin(lemmas))
    parts = F.split(get(tags, "morph"), r"\.")
    ends = F.coalesce((F.size(parts) == 5) & (F.element_at(parts, -1) == "*"), F.lit(False))
    fixed = F.concat(F.array_join(F.slice(parts, 1, 4), "."), F.lit(".Unr"))
    return F.when(hit & ends, put(tags, "morph", fixed)).otherwise(tags)


def anno_type(tags: Column, checked: Column) -> Column:
    return put(tags, "annoType", F.when(checked, "man").otherwise("auto"))


def ref_postprocess(df: DataFrame, tags: str = "tags", checked: str = "checked", link: bool = False) -> DataFrame:
    """posLemma from pos, lemmaId from lemma, addresses, irregular verbs, and who made the annotation: what concerns one anno."""
    return changed(
        df, lambda t: split(t, "pos", "pos", "posLemma", "<"), lambda t: split(t, "lemma", "lemma", "lemmaId", " "),
        lambda t: lemma_address(t, link), irregular_verbs, lambda t: anno_type(t, F.col(checked)), tags=tags,
    )


def _broad(tags: Column) -> Column:
    norm = get(tags, "norm")
    return F.when(~F.map_contains_key(tags, "norm_broad") & norm.isNotNull(), put(tags, "norm_broad", norm)).otherwise(tags)


ANSELM_POSTPROCESS = [
    lambda t: remove(t, "comment"), lambda t: remove(t, "boundary"), lambda t: fill(t, "morph", UNSET), _broad,
    lambda t: recode(t, "norm_type", NORM_TYPES), lambda t: recode(t, "pos", ANSELM_POS),
]
#: The inverse for the editor: short norm types, no unset morph, no norm_broad that repeats norm.
PREPARE_FOR_UPLOAD = [
    lambda t: recode(t, "norm_type", {v: k for k, v in NORM_TYPES.items()}), lambda t: remove(t, "morph", F.lit(UNSET)),
    lambda t: remove(t, "norm_broad", get(t, "norm")),
]


def pipeline(*steps: Callable[[Corpus], Corpus]) -> Callable[[Corpus], Corpus]:
    """Steps one after the other, each on all documents."""

    def run(corpus: Corpus) -> Corpus:
        for step in steps:
            corpus = step(corpus)
        return corpus

    return run


def on_tags(*changes: Callable[[Column], Column]) -> Callable[[Corpus], Corpus]:
    """A step that changes the tags of all annos."""
    return lambda c: c.having(annos=changed(c.annos, *changes))


def on_words(*changes: Callable[[Column], Column]) -> Callable[[Corpus], Corpus]:
    """A step that changes each token's annos in order (verbation_tags, punct_fold, punct_pos): gathered, changed, numbered."""

    def step(c: Corpus) -> Corpus:
        names = [n for n in c.annos.columns if n not in ("doc_key", "tok_ord")]
        words = c.annos.groupBy("doc_key", "tok_ord").agg(F.array_sort(F.collect_list(F.struct("anno_in_tok", F.struct(*names).alias("a"))), _by_place).alias("w"))
        words = words.withColumn("w", F.transform("w", lambda x: x["a"]))
        for change in changes:
            words = words.withColumn("w", change(F.col("w")))
        rows = words.select("doc_key", "tok_ord", F.posexplode("w").alias("k", "a")).select("doc_key", "tok_ord", "k", "a.*")
        order = Window.partitionBy("doc_key").orderBy("tok_ord", "k")
        rows = rows.withColumn("anno_in_tok", F.col("k") + 1).withColumn("anno_ord", F.row_number().over(order).cast("int")).drop("k")
        return c.having(annos=rows.select(*c.annos.columns))

    return step


def _by_place(a: Column, b: Column) -> Column:
    return a["anno_in_tok"] - b["anno_in_tok"]


def unchanged(corpus: Corpus) -> Corpus:
    return corpus


def without_flags(*names: str) -> Callable[[Corpus], Corpus]:
    """A step that takes flags off all annos."""
    return lambda c: c.having(annos=c.annos.withColumn("flags", functools.reduce(without_flag, names, F.col("flags"))))


def marks_folded(tag: str = "punc") -> Callable[[Corpus], Corpus]:
    """A step that folds sentence marks into a tag (see ``punct_fold``) and takes them out of tokens and dipls."""

    def step(c: Corpus) -> Corpus:
        fewer = lambda df: df.withColumn("chars", bounds.keep(F.col("chars"), "SentBound", drop=True))
        tokens = fewer(c.tokens).withColumn("trans", bounds.trans(F.col("chars")))
        dipls = fewer(c.dipls).withColumn("trans", bounds.trans(F.col("chars")))
        dipls = dipls.withColumn("utf", bounds.form(bounds.keep(F.col("chars"), "Whitespace", drop=True), "dipl_utf"))
        return on_words(lambda w: punct_fold(w, tag))(c).having(tokens=tokens, dipls=dipls)

    return step


def ref_converted(corpus: Corpus) -> Corpus:
    """The whole first step of the reference corpus: pos, lemmapos and morph as one tag, marks as the tag boundary."""
    return pipeline(on_tags(*REF_CONVERT), marks_folded("boundary"))(corpus)


def ref_finished(corpus: Corpus, link: bool = False) -> Corpus:
    """The whole last step of the reference corpus: the tags of each anno, then verbation tags, then marks as the tag punc."""
    tagged = corpus.having(annos=ref_postprocess(corpus.annos, link=link))
    return pipeline(on_words(verbation_tags), marks_folded())(tagged)


def anselm_finished(corpus: Corpus) -> Corpus:
    """The whole step on tokens of the Anselm corpus: tags, the flag boundary, verbation tags, punctuation."""
    return pipeline(on_tags(*ANSELM_POSTPROCESS), without_flags("boundary"), on_words(verbation_tags, punct_pos))(corpus)


def anselm_document(metadata: DataFrame) -> Callable[[Corpus], Corpus]:
    """The whole step on documents of the Anselm corpus: tokens cut anew, headers repaired from ``metadata``."""
    return pipeline(retokenised, lambda c: c.having(documents=repaired(c.documents, metadata)))


def merged_tokens(tokens: DataFrame, key: str, order: str, goes_on: Column) -> DataFrame:
    """Rows joined to the one before where ``goes_on``: trans and chars one after the other, errors united."""
    w = Window.partitionBy(key).orderBy(order)
    grouped = tokens.withColumn("_g", F.sum((~F.coalesce(goes_on, F.lit(False))).cast("int")).over(w))
    rows = grouped.groupBy(key, "_g").agg(
        F.min(order).alias(order), F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), "trans", "chars", "errors"))).alias("m")
    )
    return rows.select(
        key, order, F.array_join(F.transform("m", lambda x: x["trans"]), "").alias("trans"),
        F.flatten(F.transform("m", lambda x: x["chars"])).alias("chars"),
        F.array_distinct(F.flatten(F.transform("m", lambda x: x["errors"]))).alias("errors"),
    )


def tokens_merged(corpus: Corpus, goes_on: Column, join_annos: bool = False) -> Corpus:
    """A corpus whose tokens are joined to the one before where ``goes_on``, a condition on the tokens' columns.

    Dipls stay apart, so that the layout does, and follow each other in the merged token; so do annos, but with
    ``join_annos`` the first one of a token is glued to the last one before it, whose tags, flags and id stay.
    """
    key = "doc_key"
    line = Window.partitionBy(key).orderBy("tok_ord")
    first = F.coalesce(~F.coalesce(goes_on, F.lit(False)), F.lit(True)) | (F.row_number().over(line) == 1)
    placed = corpus.tokens.withColumn("_first", first)
    into = placed.select(key, F.col("tok_ord").alias("_old"), F.max(F.when(F.col("_first"), F.col("tok_ord"))).over(line).alias("_new"))
    mapped = lambda df: df.withColumnRenamed("tok_ord", "_old").join(into, [key, "_old"]).withColumnRenamed("_new", "tok_ord")
    whole = merged_tokens(placed, key, "tok_ord", ~F.col("_first"))
    tokens = whole.join(corpus.tokens.select(key, "tok_ord", "item_ord", "token_id"), [key, "tok_ord"])

    def numbered(df: DataFrame, kind: str, more: list[str]) -> DataFrame:
        inside = Window.partitionBy(key, "tok_ord").orderBy(*more)
        return df.withColumn(f"{kind}_in_tok", F.row_number().over(inside).cast("int"))

    dipls = numbered(mapped(corpus.dipls), "dipl", ["_old", "dipl_in_tok"]).select(*corpus.dipls.columns)
    annos = mapped(corpus.annos)
    if join_annos:
        order = Window.partitionBy(key, "tok_ord").orderBy("_old", "anno_in_tok")
        glued = (F.col("anno_in_tok") == 1) & (F.row_number().over(order) > 1)
        groups = annos.withColumn("_g", F.when(glued, 0).otherwise(1)).withColumn("_g", F.sum("_g").over(order))
        kept = [n for n in corpus.annos.columns if n not in (key, "tok_ord", "anno_in_tok", "trans", "utf", "simple", "chars")]
        parts = F.array_sort(F.collect_list(F.struct("_old", "anno_in_tok", "trans", "utf", "simple", "chars")))
        rows = groups.groupBy(key, "tok_ord", "_g").agg(parts.alias("m"), F.min_by(F.struct(*kept), F.struct("_old", "anno_in_tok")).alias("k"))
        glue = lambda name: F.array_join(F.transform("m", lambda x: x[name]), "").alias(name)
        annos = rows.select(
            key, "tok_ord", F.lit(0).alias("_old"), F.col("_g").alias("anno_in_tok"), glue("trans"), glue("utf"), glue("simple"),
            F.flatten(F.transform("m", lambda x: x["chars"])).alias("chars"), "k.*",
        )
    annos = numbered(annos, "anno", ["_old", "anno_in_tok"])
    annos = annos.withColumn("anno_ord", F.row_number().over(Window.partitionBy(key).orderBy("tok_ord", "anno_in_tok")).cast("int"))
    return corpus.having(tokens=tokens, dipls=dipls, annos=annos.select(*corpus.annos.columns))


def retokenised(corpus: Corpus, marginal: str = "marg") -> Corpus:
    """New dipls, from the parse, for tokens whose given ones differ; on the lines of the old ones.

    After a dipl that ends in a joiner the next one goes on the next line, if the document has one: not in tokens of
    marginal notes (an anti join), nor where other tokens follow on the line. Other tokens keep their dipls; all are numbered
    anew. Given annos that differ from the parsed ones get the parsed one's characters where it has an initial.
    """
    key = ["doc_key", "tok_ord"]
    aside = corpus.shift_tags.where(F.col("tag") == marginal).select("doc_key", "first_tok_ord", "last_tok_ord").alias("s")
    wrong = corpus.tokens.where(F.exists("errors", lambda e: e.isin("err_nr_dipl", "err_tok_dipl")))
    in_margin = (F.col("s.doc_key") == F.col("t.doc_key")) & F.col("t.tok_ord").between(F.col("s.first_tok_ord"), F.col("s.last_tok_ord"))
    free = wrong.alias("t").join(aside, in_margin, "left_anti").select(*key, F.lit(True).alias("free"))
    firsts = corpus.dipls.groupBy(*key).agg(F.min("line_ord").alias("line_ord"))
    last_on_line = corpus.dipls.groupBy("doc_key", "line_ord").agg(F.max("tok_ord").alias("tok_ord")).select(*key, "line_ord", F.lit(True).alias("at_end"))
    final = corpus.lines.groupBy("doc_key").agg(F.max("line_ord").alias("final"))
    cut = wrong.withColumn("chars", bounds.bounded(F.col("chars"))).select(*key, "token_id", F.posexplode(bounds.dipl_pieces(F.col("chars"))).alias("k", "piece"))
    w = Window.partitionBy(*key).orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    breaks = F.coalesce(F.sum(bounds.has(F.col("piece"), "Joiner").cast("int")).over(w), F.lit(0))
    new = cut.withColumn("breaks", breaks).join(free, key, "left").join(firsts, key).join(last_on_line, [*key, "line_ord"], "left").join(final, "doc_key", "left")
    down = F.when(F.coalesce(F.col("free") & F.col("at_end"), F.lit(False)), F.col("breaks")).otherwise(0)
    new = new.select(
        *key, (F.col("k") + 1).alias("dipl_in_tok"), F.concat("token_id", F.lit("_d"), F.col("k") + 1).alias("dipl_id"),
        bounds.form(F.col("piece"), "string").alias("trans"), bounds.form(F.col("piece"), "dipl_utf").alias("utf"),
        F.least(F.col("line_ord") + down, F.coalesce("final", F.col("line_ord"))).cast("int").alias("line_ord"),
        *[F.col("piece").alias("chars")] * ("chars" in corpus.dipls.columns),
    )
    kept = corpus.dipls.join(wrong.select(*key), key, "left_anti").drop("dipl_ord")
    both = kept.unionByName(new)
    order = Window.partitionBy("doc_key").orderBy("tok_ord", "dipl_in_tok")
    return corpus.having(dipls=both.withColumn("dipl_ord", F.row_number().over(order).cast("int")), annos=_with_initials(corpus))


def _with_initials(corpus: Corpus) -> DataFrame:
    """Annos of tokens with err_tok_anno as parsed, where the parse has an initial."""
    key = ["doc_key", "tok_ord"]
    wrong = corpus.tokens.where(F.array_contains("errors", "err_tok_anno")).withColumn("chars", bounds.bounded(F.col("chars")))
    parsed = wrong.select(*key, F.posexplode(bounds.anno_pieces(F.col("chars"))).alias("k", "piece")).where(bounds.has(F.col("piece"), "Majuscule"))
    made = parsed.select(
        *key, (F.col("k") + 1).alias("anno_in_tok"), F.col("piece").alias("_chars"), bounds.form(F.col("piece"), "string").alias("_trans"),
        bounds.form(F.col("piece"), "anno_utf").alias("_utf"), bounds.form(F.col("piece"), "anno_simple").alias("_simple"),
    )
    met = corpus.annos.join(made, [*key, "anno_in_tok"], "left")
    names = [n for n in ("chars", "trans", "utf", "simple") if n in corpus.annos.columns]
    return met.withColumns({n: F.coalesce(f"_{n}", n) for n in names}).select(*corpus.annos.columns)
