"""Document fingerprints by locally consistent parsing.

Level 0 is the sequence of code points. On each level runs of one symbol become one symbol; deterministic coin tossing
(Cole and Vishkin 1986) then colours the sequence so that neighbours differ, from a few symbols of left context only, and
local maxima of the colours begin phrases. A phrase's name is a hash of its symbols, so equal substrings have equal
phrases inside, whatever their offset: only phrases near the ends of a shared substring can differ. The names of all
long enough phrases fill a one-permutation MinHash sketch, which is the fingerprint.

All texts of a batch are parsed together as flat arrays; text borders count as breaks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import prepared
from .flat import mixed

#: Slots of a fingerprint, 16 bits each (4 hex digits; 0000: empty).
SLOTS = 64
#: Levels whose phrases are left out of the sketch, as short phrases are shared by all texts of a language.
SKIP = 2
#: Code points in a range of keys, and ranges at most: each sends its first key to the driver.
RANGE, MOST_RANGES = 1 << 23, 10_000
_P = np.uint64(0x9E3779B97F4A7C15)
_Q = np.uint64(0xC2B2AE3D27D4EB4F)


def _toss(colour: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One round of coin tossing: twice the lowest bit where a colour differs from its left neighbour's, plus that bit."""
    left = np.empty_like(colour)
    left[1:] = colour[:-1]
    left[first] = ~colour[first]
    differing = colour ^ left
    low = np.bitwise_count((differing & -differing) - differing.dtype.type(1)).astype(colour.dtype)
    return (low << colour.dtype.type(1)) | ((colour >> low) & colour.dtype.type(1))


def _phrases(names: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where phrases begin, for a sequence without equal neighbours inside a text; ``first`` are the texts' beginnings."""
    colour = names
    for kind in (np.uint8, np.uint8, np.uint8, np.uint8):  # 64 bits: below 128, 14, 8, 6
        colour = _toss(colour, first).astype(kind)
    n = len(names)
    left = np.zeros(n, np.int16)
    right = np.full(n, -1, np.int16)
    left[1:] = colour[:-1]
    right[:-1] = colour[1:]
    right[first[1:] - 1] = -1
    begins = (colour > left) & (colour > right)
    begins[1:] &= ~begins[:-1]
    begins[first] = True
    # a phrase of one symbol at a text's beginning joins what follows
    second = first + 1
    second = second[second < n]
    own = np.zeros(n, bool)
    own[first] = True
    begins[second] &= own[second]
    return begins


def sketches(points: np.ndarray, offsets: np.ndarray, slots: int = SLOTS, skip: int = SKIP) -> np.ndarray:
    """(texts, slots) of 16-bit values for texts given as one array of code points and n + 1 offsets.

    Each level at least halves a text, so the work is in proportion to its length. A text's last single name always
    counts, so short texts have fingerprints too; an empty text's fingerprint is all 0.
    """
    n = len(offsets) - 1
    out = np.full((n, slots), np.iinfo(np.uint64).max, np.uint64)
    doc = np.repeat(np.arange(n), np.diff(offsets))
    names, level = mixed(points.astype(np.uint64) + _Q), 0
    while len(names):
        fresh = np.concatenate([[True], doc[1:] != doc[:-1]])
        first = np.flatnonzero(fresh)
        alone = np.zeros(len(names), bool)
        size = np.diff(np.append(first, len(names)))
        alone[first[size == 1]] = True
        use = alone if level < skip else np.ones(len(names), bool)
        if use.any():
            _fill(out, doc[use], mixed(names[use] ^ _P))
        if alone.any():
            names, doc = names[~alone], doc[~alone]
            if not len(names):
                break
            fresh = np.concatenate([[True], doc[1:] != doc[:-1]])
        # runs of one symbol
        heads = np.flatnonzero(fresh | np.concatenate([[True], names[1:] != names[:-1]]))
        length = np.diff(np.append(heads, len(names))).astype(np.uint64)
        names, doc, fresh = np.where(length > 1, mixed(names[heads] + length * _P), names[heads]), doc[heads], fresh[heads]
        begins = np.flatnonzero(_phrases(names, np.flatnonzero(fresh)))
        # the name of a phrase: a hash of its symbols in order
        where = np.arange(len(names)) - np.repeat(begins, np.diff(np.append(begins, len(names))))
        parts = mixed(names + (where.astype(np.uint64) + np.uint64(1)) * _Q)
        names, doc = mixed(np.add.reduceat(parts, begins)), doc[begins]
        level += 1
    values = (out >> np.uint64(20)) % np.uint64(65535) + np.uint64(1)
    return np.where(out == np.iinfo(np.uint64).max, np.uint64(0), values).astype(np.uint16)


def _fill(out: np.ndarray, doc: np.ndarray, hashed: np.ndarray) -> None:
    slots = out.shape[1]
    cell = doc * slots + (hashed % np.uint64(slots)).astype(np.int64)
    order = np.argsort(cell, kind="stable")
    cell, hashed = cell[order], hashed[order]
    heads = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
    lines = out.reshape(-1)
    lines[cell[heads]] = np.minimum(lines[cell[heads]], np.minimum.reduceat(hashed, heads))


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The share of phrases that two texts have in common: 2 J / (1 + J) for the Jaccard index J of their sketches.

    Two empty texts are alike.
    """
    filled = (a != 0) | (b != 0)
    same = ((a == b) & filled).sum(axis=1)
    either = filled.sum(axis=1)
    return np.where(either == 0, 1.0, 2.0 * same / np.maximum(same + either, 1))


def as_text(sketch: np.ndarray) -> pa.Array:
    """Rows of 16-bit values as hex digits."""
    digits = np.frombuffer(b"0123456789abcdef", np.uint8)
    nibbles = np.stack([(sketch >> s) & 15 for s in (12, 8, 4, 0)], axis=2)
    data = digits[nibbles.reshape(-1)]
    offsets = np.arange(len(sketch) + 1, dtype=np.int32) * (sketch.shape[1] * 4)
    return pa.Array.from_buffers(pa.string(), len(sketch), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def points_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    whole = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return whole, np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)]).astype(np.int64)


def _fingerprints(key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for lo, hi in pieces([len(t) for t in texts]):
                rows = batch.slice(lo, hi - lo)
                yield pa.record_batch([rows.column(key), as_text(sketches(*points_of(texts[lo:hi])))], [key, "fingerprint"])

    return run


def pieces(sizes: list[int], most: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Ranges of about ``most`` code points; a longer text is a range of its own."""
    lo = total = 0
    for i, size in enumerate(sizes):
        if i > lo and total + size > most:
            yield lo, i
            lo, total = i, 0
        total += size
    if lo < len(sizes):
        yield lo, len(sizes)


def fingerprints(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, fingerprint) for each row of ``df``; null texts count as empty. No shuffle."""
    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key), F.col(text).alias("text")).mapInArrow(_fingerprints(key), f"{key} {kind}, fingerprint string")


# ---------------------------------------------------------------- the query


def _bucket(order: Column, cuts: list[int]) -> Column:
    """The number of ``cuts`` (sorted) that are at most ``order``, by binary search."""
    if not cuts:
        return F.lit(0)
    line = F.array(*map(F.lit, cuts))
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(len(cuts).bit_length()))])

    def step(at: Column, by: Column) -> Column:
        return F.when((at + by <= len(cuts)) & (F.get(line, at + by - 1) <= order), at + by).otherwise(at)

    return F.aggregate(steps, F.lit(0), step)


def neighbours(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Rows (key, text, bucket, ghost) such that, sorted by bucket, ghost and descending key, each row that is no ghost is
    followed by the row with the next smaller key, the last by the first.

    Keys are cut into ranges of about RANGE code points, MOST_RANGES at most, at approximate quantiles; the first row of each
    range is also sent, as a ghost, to the end of the range before. Rows with equal keys stand in one range; they follow the
    text's hash, which then decides the next one, and equal rows follow each other. A null key counts as the smallest, a null
    text as empty; other columns are not read. A single row follows itself; an empty table stays empty.
    """
    spark = df.sparkSession
    rows = df.select(
        F.col(key), F.coalesce(F.col(key), F.lit(-(1 << 63))).alias("_at"), F.coalesce(F.col(text), F.lit("")).alias("text")
    )
    size = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    ranges = min(MOST_RANGES, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE)))
    quantiles = [(i + 1) / ranges for i in range(ranges - 1)]
    cuts = rows.agg(F.percentile_approx("_at", F.array(*map(F.lit, quantiles)), F.lit(20 * ranges))).first()[0] if ranges > 1 else []
    rows = rows.withColumn("bucket", -_bucket(F.col("_at"), sorted(set(cuts or []))))
    place = F.struct(F.col("_at"), F.xxhash64("text").alias("h"))
    heads = rows.groupBy("bucket").agg(F.max(place).alias("head")).collect()  # one small row for each range
    heads = sorted(heads, key=lambda r: r.bucket)
    before = {h.head: heads[i - 1].bucket for i, h in enumerate(heads)}
    ghosts = spark.createDataFrame([(h._at, h.h, b) for h, b in before.items()], "a long, h long, to int")
    firsts = F.broadcast(ghosts)  # one row for each range
    ghost = (
        rows.where(F.col("_at").isin([h.head._at for h in heads])).withColumn("_h", F.xxhash64("text"))
        .join(firsts, (F.col("_at") == F.col("a")) & (F.col("_h") == F.col("h")))
        .select(key, "_at", "text", F.col("to").alias("bucket"), F.lit(True).alias("ghost"))
    )
    both = rows.select(key, "_at", "text", "bucket", F.lit(False).alias("ghost")).unionByName(ghost)
    # a range is a partition of its own, whatever the session's settings are
    dealt = both.repartitionById(ranges, -F.col("bucket")).sortWithinPartitions("bucket", "ghost", F.desc("_at"), F.desc(F.xxhash64("text")))
    return dealt.select(key, "text", "bucket", "ghost")


def edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _compare(key: str):
    def work(texts: list[str], follows: list[str]) -> tuple:
        changed = [edited(t, f) for t, f in zip(texts, follows, strict=True)]
        n = len(texts)
        # a row's follower is the next row as a rule, so its sketch is there already
        chained = all(texts[i + 1] is follows[i] for i in range(n - 1))
        own = sketches(*points_of([*texts, follows[-1]])) if chained else None
        a, c = (own[:n], own[1:]) if chained else (sketches(*points_of(texts)), sketches(*points_of(follows)))
        return a, sketches(*points_of(changed)), c, changed

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # (key, text, bucket), until the row that follows is there

        def out(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            for lo, hi in pieces([len(r[1]) for r in rows]):
                part = rows[lo:hi]
                a, b, c, changed = work([r[1] for r in part], [r[2] for r in part])
                yield pa.record_batch(
                    [
                        pa.array([r[0] for r in part], pa.int64()), pa.array([len(r[1]) for r in part], pa.int64()),
                        pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed]), as_text(a), as_text(b),
                        pa.array(likeness(a, b)), pa.array(likeness(a, c)),
                    ],
                    ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
                )

        for batch in batches:
            done: list[tuple] = []
            for k, text, bucket, ghost in zip(*[batch.column(c).to_pylist() for c in (key, "text", "bucket", "ghost")], strict=True):
                if held and held[0][2] == bucket:
                    done.append((held[0][0], held[0][1], text))
                    held = []
                if not ghost:
                    held = [(k, text, bucket)]
            yield from out(done)

    return run


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: fingerprints of the text and of the edited text, and their likeness."""
    prepared(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return neighbours(docs, "doc_id").mapInArrow(_compare("doc_id"), schema)


QUERIES = {"op9_fingerprints": op9_fingerprints}
ORACLE: dict[str, str] = {}
