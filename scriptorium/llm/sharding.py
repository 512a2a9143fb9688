"""Sharding by jump consistent hashing, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import prepared
from .ranking import rank_in_group

#: Fixed value: the multiplier of the generator in the published algorithm.
MULTIPLIER = 2862933555777941757
_C = [(MULTIPLIER >> 16 * i) & 0xFFFF for i in range(4)]
_LOW = 0xFFFFFFFF


def _halves(key: Column) -> tuple[Column, Column]:
    return key.bitwiseAND(F.lit(_LOW)), F.shiftrightunsigned(key, 32)


def _step(low: Column, high: Column) -> tuple[Column, Column]:
    """(high, low) * MULTIPLIER + 1 modulo 2^64; 16-bit limbs of the multiplier keep each product below 2^48."""
    cut = F.lit(0xFFFF)
    mid = low * _C[1]
    below = low * _C[0] + F.shiftleft(mid.bitwiseAND(cut), 16) + 1
    above = (
        F.shiftright(below, 32)
        + F.shiftright(mid, 16)
        + low * _C[2]
        + F.shiftleft((low * _C[3]).bitwiseAND(cut), 16)
        + high * _C[0]
        + F.shiftleft((high * _C[1]).bitwiseAND(cut), 16)
    )
    return below.bitwiseAND(F.lit(_LOW)), above.bitwiseAND(F.lit(_LOW))


def jump_hash(key: Column, *counts: int) -> Column:
    """An array: the shard of the 64-bit ``key`` for each of ``counts`` shards.

    One chain of jumps serves all counts: the shard for n is its last stop below n. Each jump moves up by one at
    least, so max(counts) steps suffice.
    """
    most = max(counts)
    low, high = _halves(key)
    start = F.struct(
        low.alias("low"), high.alias("high"), F.lit(0).cast("long").alias("at"),
        F.array(*[F.lit(0) for _ in counts]).alias("stops"),
    )

    def jump(s: Column, _: Column) -> Column:
        below, above = _step(s["low"], s["high"])
        to = F.floor((s["at"] + 1) * (F.lit(float(1 << 31)) / (F.shiftright(above, 1) + 1).cast("double")))
        to = F.least(to, F.lit(most)).cast("long")
        stops = F.array(*[F.when(to < n, to.cast("int")).otherwise(s["stops"][i]) for i, n in enumerate(counts)])
        return F.when(s["at"] >= most, s).otherwise(
            F.struct(below.alias("low"), above.alias("high"), to.alias("at"), stops.alias("stops"))
        )

    return F.aggregate(F.sequence(F.lit(1), F.lit(most)), start, jump, lambda s: s["stops"])


def shard(df: DataFrame, key: str, shards: int, carry: list[str] | None = None) -> DataFrame:
    """Rows of ``df`` with ``shard``, ``grown_shard`` (with one shard more) and ``slot`` (gapless from 0 in a shard).

    Only ``key`` and the columns in ``carry`` are kept, so other columns' names can't clash. Whole numbers are keys as they
    are, other types by a 64-bit hash; a null key goes where -1 goes; rows with equal keys go to the same shard. Slots follow the key, then the carried columns,
    then the order of the scan. An empty table gives an empty one.
    """
    names = [c for c in carry or [] if c != key]
    whole = df.schema[key].dataType.simpleString() in ("bigint", "int", "smallint", "tinyint")
    keyed = F.coalesce(F.col(key).cast("long") if whole else F.when(F.col(key).isNotNull(), F.xxhash64(key)), F.lit(-1).cast("long"))
    base = (
        df.select(key, *names, F.monotonically_increasing_id().alias("_pos"))
        .withColumn("_to", jump_hash(keyed, shards, shards + 1))
        .select(key, *names, "_pos", F.col("_to")[0].alias("shard"), F.col("_to")[1].alias("grown_shard"))
    )
    return rank_in_group(base, ["shard"], [key, *names, "_pos"], "slot").drop("_pos")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 8 shards by ``doc_id``, law ``key``. A null text has size 1 and the CRC of no bytes."""
    prepared(spark)
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32")
    )
    return shard(docs, "doc_id", 8, ["size", "text_crc32"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), "grown_shard"
    )


QUERIES = {"op8_sharding": op8_sharding}
#: The CRC from its table, the chain of jumps as a recursion over 128-bit products.
ORACLE = {
    "op8_sharding": r"""
WITH RECURSIVE
crc_table AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t),
sized AS (SELECT doc_id, length(h) // 2 + 1 AS size, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(h, '..'), lambda x: ('0x' || x)::BIGINT)),
   lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8))) AS text_crc32 FROM (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents), crc_table),
jumps AS (
  SELECT doc_id, CASE WHEN doc_id < 0 THEN doc_id + 18446744073709551616::HUGEINT ELSE doc_id::HUGEINT END AS key, 0::BIGINT AS place, 0 AS eight, 0 AS nine FROM sized
  UNION ALL
  SELECT doc_id, k, j, CASE WHEN j < 8 THEN j::INTEGER ELSE eight END, CASE WHEN j < 9 THEN j::INTEGER ELSE nine END
  FROM (SELECT doc_id, k, eight, nine, least(floor((place + 1) * (2147483648.0::DOUBLE / ((k >> 33) + 1)::DOUBLE)), 9)::BIGINT AS j
    FROM (SELECT doc_id, (key * 2862933555777941757 + 1) % 18446744073709551616::HUGEINT AS k, place, eight, nine FROM jumps WHERE place < 9))
)
SELECT s.doc_id, s.size, s.text_crc32, 'key' AS law, j.eight AS shard, row_number() OVER (PARTITION BY j.eight ORDER BY s.doc_id, s.size, s.text_crc32) - 1 AS slot, j.nine AS grown_shard
FROM sized s JOIN (SELECT DISTINCT doc_id, eight, nine FROM jumps WHERE place = 9) j ON s.doc_id = j.doc_id
"""
}
