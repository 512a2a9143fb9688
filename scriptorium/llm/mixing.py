"""Mixing sources to target weights by a low-discrepancy schedule of equal blocks of words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import checkpointed, prepared, unused
from .ranking import rank_in_group, running_total

#: The weights dealt to the sources in order, and how often a source may repeat.
WEIGHTS = (5, 2, 1)
REPEATS = 3
WORD = r"[^ \t-\r]+"
#: Words in a block of the schedule, and cells of [0, 1) by which slots find their source.
BLOCK = 512
CELLS = 1024


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """``target`` for each row of ``sizes`` (source, source_size): its weight's share of all sizes, capped and reshared.

    A source stops at ``repeats`` times its size. With the sources by cap over weight, the capped ones come first, and
    each other one gets the same level of words per unit of weight: the level rises while capped sources are taken out
    and falls after, so the first that fits is the highest that fits. Works on one row per source.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    ranked = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int")))
    ranked = ranked.withColumn("cap", F.col("source_size").cast("double") * repeats)
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    earlier, later = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    ranked = ranked.withColumn(
        "level",
        (F.sum(F.col("source_size").cast("double")).over(everything) - F.coalesce(F.sum("cap").over(earlier), F.lit(0.0)))
        / F.sum("weight").over(later),
    ).withColumn("level", F.max(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))).over(everything))
    return ranked.select(
        "source", "source_size", F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))).alias("target")
    )


def van_der_corput(i: Column, bits: int = 48) -> Column:
    """The bits of ``i`` mirrored at the binary point; exact in a double."""
    return F.conv(F.reverse(F.lpad(F.bin(i), bits, "0")), 2, 10).cast("long") / F.lit(float(1 << bits))


def schedule(sources: DataFrame, block: int = BLOCK) -> DataFrame:
    """The slots of the mix: slot, source, block (of the source's line of words), words.

    ``sources`` has source, source_size and target. Slot i goes to the source whose stretch of the cumulative weights
    holds the i-th van der Corput point; its rank among the source's slots says which block it takes, round and round
    the source's line. Slots that a source has beyond its target go to sources that are still short, at the end, so that
    each source's words equal its target exactly, to a word.
    """
    spark = sources.sparkSession
    size, wanted = F.col("source_size"), F.col("wanted")
    needed = sources.withColumn("wanted", F.floor(F.col("target") + F.lit(1e-6)).cast("long")).where(wanted > 0)
    needed = needed.withColumn("blocks", F.ceil(size / F.lit(block)).cast("long")).withColumn(
        "slots", F.expr("wanted div source_size") * F.col("blocks") + F.ceil((wanted % size) / F.lit(block))
    )
    line = Window.orderBy(F.col("source").isNull(), F.col("source")).rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("slots").over(Window.partitionBy())
    before = F.coalesce(F.sum("slots").over(line), F.lit(0))
    needed = checkpointed(
        needed.withColumn("n", total).withColumn("low", before / total).withColumn("high", (before + F.col("slots")) / total)
    )
    n = needed.agg(F.max("n")).first()[0] or 0
    cells = F.sequence(F.floor(F.col("low") * CELLS), F.least(F.floor(F.col("high") * CELLS), F.lit(CELLS - 1).cast("long")))
    stretches = needed.select("source", "low", "high", F.explode(cells).alias("cell"))
    points = spark.range(n).select(F.col("id").alias("slot"), van_der_corput(F.col("id")).alias("u")).withColumn(
        "cell", F.floor(F.col("u") * CELLS)
    )
    dealt = points.join(stretches, "cell").where((F.col("u") >= F.col("low")) & (F.col("u") < F.col("high")))
    ranked = checkpointed(rank_in_group(dealt.select("slot", "source"), ["source"], ["slot"], "rank"))
    got = ranked.groupBy(F.col("source").alias("_source")).agg(F.count("*").alias("got"))
    short = needed.join(got, F.col("source").eqNullSafe(F.col("_source")), "left").where(F.coalesce("got", F.lit(0)) < F.col("slots"))
    # at most the points' discrepancy, a logarithm of the number of slots for each source
    rest = short.select("source", F.explode(F.sequence(F.coalesce("got", F.lit(0).cast("long")), F.col("slots") - 1)).alias("rank"))
    rest = rest.withColumn("slot", F.lit(n) + F.xxhash64("source", "rank").bitwiseAND(F.lit((1 << 40) - 1)))
    own = needed.select(F.col("source").alias("_source"), "source_size", "wanted", "blocks", "slots")
    lap, at = F.expr("rank div blocks"), F.col("rank") % F.col("blocks")
    return (
        ranked.unionByName(rest.select("slot", "source", "rank"))
        .join(own, F.col("source").eqNullSafe(F.col("_source")))
        .where(F.col("rank") < F.col("slots"))
        .withColumn("block", at)
        .withColumn("words", F.least(F.lit(block).cast("long"), size - at * block, wanted - lap * size - at * block))
        .select("slot", "source", "block", "words")
    )


def shuffled(df: DataFrame, key: str, seed: int) -> Column:
    """A number that scatters the keys: for whole numbers two rounds modulo 2^32, which any SQL can repeat; else a hash."""
    if df.schema[key].dataType.simpleString() not in ("bigint", "int", "smallint", "tinyint"):
        return F.xxhash64(F.lit(seed), F.col(key))
    size = F.lit(1 << 32)
    h = (F.pmod(F.col(key).cast("long"), F.lit(1 << 31)) * 1597334677 + seed) % size
    h = h.bitwiseXOR(F.shiftright(h, 15)) * 1103515245 % size
    return h.bitwiseXOR(F.shiftright(h, 16))


def mix(df: DataFrame, key: str, carry: list[str] | None = None, block: int = BLOCK, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """(documents, slots) for rows of ``df`` with ``key``, source and size (number of words).

    documents: key, the carried columns, size, source, source_size, target, ``taken``, the words that the mix takes from
    the document, repeats counted, and ``copies``, how often it takes the first word. slots: slot (the order of the mix), source, block, words, ``pieces`` of which
    hold each document's stretch: see ``schedule``. The documents of a source stand in a shuffled line (by the key and
    seed; ties by the columns), cut into blocks of equal words; a slot takes the next block of its source. Null
    sources are one source, the last. Documents without words take part with 0. A hot source's line is summed by ranges.
    """
    names = [c for c in carry or [] if c not in (key, "source", "size")]
    rows = df.select(key, *names, "source", F.coalesce(F.col("size"), F.lit(0)).cast("long").alias("size"))
    rows = checkpointed(rows.withColumn("_pos", F.monotonically_increasing_id()))
    sizes = rows.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    sources = checkpointed(source_targets(sizes))
    slots = schedule(sources, block)
    line = running_total(
        rows.withColumn("_order", shuffled(rows, key, seed)), ["source"], ["_order", key, "size", *names, "_pos"], "size", "begin"
    )
    line = checkpointed(line)
    first, last = F.floor(F.col("begin") / block), F.floor((F.col("begin") + F.col("size") - 1) / block)
    pieces = line.where("size > 0").select(
        "_pos", "source", "begin", "size", first.alias("head"), F.explode(F.sequence(first, last)).alias("block")
    )
    start = F.greatest(F.col("begin") - F.col("block") * block, F.lit(0))
    end = F.least(F.col("begin") + F.col("size") - F.col("block") * block, F.lit(block))
    pieces = pieces.select("_pos", "source", "head", "block", start.alias("start"), end.alias("end"))
    # a block is taken at most once a lap, so its slots number REPEATS at most
    takes = slots.groupBy(F.col("source").alias("_source"), F.col("block").alias("_block")).agg(F.collect_list("words").alias("takes"))
    met = pieces.join(takes, F.col("source").eqNullSafe(F.col("_source")) & (F.col("block") == F.col("_block")))
    of = F.transform("takes", lambda t: F.greatest(F.least(F.col("end"), t) - F.col("start"), F.lit(0).cast("long")))
    # a document's first word is in the piece of its first block
    heads = F.when(F.col("block") == F.col("head"), F.array_size(F.filter("takes", lambda t: t > F.col("start")))).otherwise(0)
    taken = met.groupBy("_pos").agg(
        F.sum(F.aggregate(of, F.lit(0).cast("long"), lambda a, x: a + x)).alias("taken"), F.sum(heads).alias("copies")
    )
    about = sources.select(F.col("source").alias("_source"), "source_size", "target")
    documents = (
        line.join(taken, "_pos", "left")
        .join(about, F.col("source").eqNullSafe(F.col("_source")), "left")
        .select(
            key, *names, "source", "size", "source_size", "target",
            F.coalesce("taken", F.lit(0).cast("long")).alias("taken"), F.coalesce("copies", F.lit(0).cast("long")).alias("copies"),
        )
    )
    return documents, slots


def mixed_rows(df: DataFrame, key: str, block: int = BLOCK) -> DataFrame:
    """The rows of ``df`` (key, source, text) as the mix takes them: each as often as slots take its first word.

    A row comes up to REPEATS times; sources' words come to their targets but for the texts at the ends of their lines.
    Rows are told apart by the key and the text's hash, and those equal in both are taken as one row with all their copies.
    Texts without words (null, empty) are not taken. Null keys and null sources are a key and a source. Other columns may
    have any name.
    """
    own, text_hash, many, copy, first = unused(df.columns, "_own", "_hash", "_many", "_copy", "_first")
    rows = df.withColumns({text_hash: F.xxhash64("text"), own: F.col(key)})
    sized = rows.select(own, text_hash, "source", word_count(F.col("text")).alias("size"))
    documents, _ = mix(sized, own, [text_hash], block)
    k, h = unused(rows.columns, "_k", "_h")
    copies = documents.groupBy(F.col(own).alias(k), F.col(text_hash).alias(h)).agg(F.sum("copies").alias(many)).where(F.col(many) > 0)
    line = F.row_number().over(Window.partitionBy(own, text_hash).orderBy(own))
    met = rows.join(copies, F.col(own).eqNullSafe(F.col(k)) & (F.col(text_hash) == F.col(h)))
    once = met.withColumn(first, line).where(F.col(first) == 1)
    return once.select(*df.columns, F.explode(F.sequence(F.lit(1), F.col(many).cast("int"))).alias(copy)).select(*df.columns)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: words, their source's words and target, and the words that the mix takes."""
    prepared(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", word_count(F.col("text")).alias("size"))
    documents, _ = mix(docs, "doc_id")
    return documents.select("doc_id", "size", "source_size", "target", "taken", "source")


QUERIES = {"op7_mixing": op7_mixing}
#: What the schedule comes to: whole laps of a source's line, and a lap up to its remainder.
ORACLE = {
    "op7_mixing": r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^ \t-\r]+')), 0) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT source, source_size, source_size * 3.0::DOUBLE AS cap,
  CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM s),
l AS (SELECT *, ((SELECT sum(source_size) FROM s)::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT source, source_size, least(cap, weight * (SELECT max(level) FROM l WHERE level * weight <= cap)) AS target FROM l),
p AS (SELECT d.doc_id, d.source, d.size, t.source_size, t.target, CAST(floor(t.target + 1e-6) AS BIGINT) AS n,
  CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY xor(h, h >> 16), d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM (SELECT *, xor(g, g >> 15) * 1103515245 % 4294967296 AS h FROM (SELECT *, ((doc_id % 2147483648 + 2147483648) % 2147483648 * 1597334677 + 7) % 4294967296 AS g FROM d)) d
  JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, source,
  CASE WHEN source_size = 0 THEN 0 ELSE (n // source_size) * size + greatest(0, least(start + size, n % source_size) - start) END AS taken FROM p
"""
}
