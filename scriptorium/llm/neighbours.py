"""Approximate nearest neighbours by collision-counting hashing.

Vectors are scaled to length 1, where the largest cosine is the smallest distance. A block of vectors has one sorted array
for each of many single projections. A query's windows are centred on its own projections; virtual rehashing widens all
of them from round to round. A vector that is inside THRESHOLD of the windows is verified: its exact cosine is computed.
The search ends when a vector nearer than the k-th verified one would, with the chance CONFIDENCE, have been verified by
now. There is no limit on the vectors verified.

The projections are the axes of turned coordinate systems. Such projections of one vector have a fixed sum of squares, so
the number of windows that hold a vector tells its distance more sharply than independent projections would.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import checkpointed, prepared

PROJECTIONS = 192
THRESHOLD = 116
#: Windows begin at an eighth of the width at which vectors at the usual distance of two begin to be verified; then come that
#: width and growth by this factor.
GROWTH = 1.1
CONFIDENCE, RARE = 0.9, 0.002
#: Vectors in a block. A sorted array has PAGES pages, and windows hold whole pages.
BLOCK, PAGES = 32_768, 256
#: Vectors whose windows are counted at a time, so that what is counted stays in a core's cache.
STRIPE = 4096


def projections(d: int, m: int = PROJECTIONS, seed: int = 3) -> np.ndarray:
    """(d, m): the axes of as many randomly turned coordinate systems as are needed."""
    rng = np.random.default_rng(seed)
    return np.concatenate([np.linalg.qr(rng.standard_normal((d, d)))[0] for _ in range(-(-m // d))], axis=1)[:, :m]


@cache
def scales(d: int, m: int = PROJECTIONS, least: int = THRESHOLD, sure: float = CONFIDENCE) -> tuple[float, float]:
    """(sure, rare): two vectors at distance s are verified once windows are s times this wide to either side, with the
    chance ``sure`` and with the chance ``RARE``.

    They are verified when the ``least``-th smallest of the projections of their difference fits; its quantiles come from
    directions drawn at random.
    """
    directions = np.random.default_rng(11).standard_normal((4000, d))
    directions /= np.linalg.norm(directions, axis=1)[:, None]
    needed = np.sort(np.abs(directions @ projections(d, m)), axis=1)[:, least - 1]
    return float(np.quantile(needed, sure)), float(np.quantile(needed, RARE))


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Rows times a power of two each, so that neither huge nor tiny components leave the doubles' range; cosines stay."""
    _, exponent = np.frexp(np.abs(vectors).max(axis=1))
    return np.ldexp(vectors, -exponent[:, None])


class Index:
    """Sorted projections of a block of vectors."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray):
        self.rows, self.ids, self.vectors = rows, ids, scaled(vectors)
        self.norms = np.sqrt((self.vectors * self.vectors).sum(axis=1))
        unit = self.vectors / self.norms[:, None]
        n, d = unit.shape
        self.lines = projections(d)
        values = np.ascontiguousarray((unit @ self.lines).T.astype(np.float32))
        order = np.argsort(values, axis=1)
        self.sorted = np.take_along_axis(values, order, axis=1)
        self.size = -(-n // PAGES)
        pages = np.empty(values.shape, np.uint8)
        np.put_along_axis(pages, order, (np.arange(n) // self.size).astype(np.uint8)[None], axis=1)
        self.pages = [np.ascontiguousarray(pages[:, a : a + STRIPE]) for a in range(0, n, STRIPE)]
        # the usual distance of two vectors of the block
        self.usual = float(np.sqrt(max(2 - 2 * (unit.mean(axis=0) ** 2).sum(), 1e-12)))
        self.verified = 0

    def windows(self, at: np.ndarray, half: float) -> tuple[np.ndarray, np.ndarray]:
        """First and last page of each window, for queries with the projections ``at`` (queries, projections)."""
        half = np.float32(half)
        first = np.stack([s.searchsorted(a - half, "left") for s, a in zip(self.sorted, at.T, strict=True)], axis=1)
        last = np.stack([s.searchsorted(a + half, "right") for s, a in zip(self.sorted, at.T, strict=True)], axis=1) - 1
        # an empty window becomes the page that it would stand in
        first, last = np.minimum(first, len(self.ids) - 1) // self.size, np.maximum(last, 0) // self.size
        return first, np.maximum(first, last)

    def collisions(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """For each vector the number of windows that hold it."""
        first, more = first.astype(np.uint8)[:, None], (last - first).astype(np.uint8)[:, None]
        out = np.empty(len(self.ids), np.uint8)
        at = 0
        for stripe in self.pages:
            inside = (stripe - first) <= more  # below the first page the difference wraps round
            np.add.reduce(inside.view(np.uint8), axis=0, dtype=np.uint8, out=out[at : at + stripe.shape[1]])
            at += stripe.shape[1]
        return out

    def search(self, queries: np.ndarray, own: list[int], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query (positions, cosines) of the k best verified vectors; the row ``own`` doesn't count."""
        queries = scaled(queries)
        lengths = np.sqrt((queries * queries).sum(axis=1))
        at = ((queries / lengths[:, None]) @ self.lines).astype(np.float32)
        sure, rare = scales(queries.shape[1])
        start = self.usual * rare  # from here on vectors at the usual distance begin to be verified
        early = [(half, self.windows(at, half)) for half in (start / 8, start)]
        rows = set(self.rows.tolist())
        out = []
        for q in range(len(queries)):
            others = len(self.ids) - (own[q] in rows)
            seen = np.zeros(len(self.ids), bool)
            best, cosines = np.zeros(0, np.int64), np.zeros(0)
            rounds = [(half, first[q], last[q]) for half, (first, last) in early]
            while True:
                if rounds:
                    half, first, last = rounds.pop(0)
                else:
                    first, last = (w[0] for w in self.windows(at[q : q + 1], half))
                fresh = np.flatnonzero((self.collisions(first, last) >= THRESHOLD) & ~seen)
                seen[fresh] = True
                fresh = fresh[self.rows[fresh] != own[q]]
                self.verified += len(fresh)
                if len(fresh):
                    # row by row, so equal vectors have equal cosines in any block
                    dots = (self.vectors[fresh] * queries[q]).sum(axis=1) / (self.norms[fresh] * lengths[q])
                    best, cosines = np.concatenate([best, fresh]), np.concatenate([cosines, dots])
                    keep = np.lexsort((self.rows[best], self.ids[best], -cosines))[:k]
                    best, cosines = best[keep], cosines[keep]
                wider = GROWTH * half
                if len(best) == min(k, others):  # all, or the k best: how wide windows must be to have met any better one
                    needed = sure * np.sqrt(max(0.0, 2 - 2 * cosines[-1])) if others > k else 0.0
                    if needed <= half:
                        break
                    wider = min(wider, needed)
                if not rounds:
                    if half > 2:  # the windows hold all
                        break
                    half = max(wider, start)
            out.append((best, cosines))
        return out


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(row, vec_id, v) for each row that takes part: ``row`` tells rows apart that share an id, each of which counts.

    Vectors that are null, empty, zero or hold null or non-finite components, and rows with a null id, take no part.
    Components stay floats or become doubles.
    """
    single = df.schema[vector].dataType.simpleString() == "array<float>"
    v = F.col(vector) if single else F.col(vector).cast("array<double>")
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    rows = df.select(F.col(key).cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & good)
    return checkpointed(rows.withColumn("row", F.monotonically_increasing_id()))


FOUND = "asked long, query_id long, vec_id long, row long, score double"


def _searched(k: int):
    names = [c.split()[0] for c in FOUND.split(", ")]

    def matrix(b: pa.RecordBatch) -> np.ndarray:
        return b.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, -1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by cell, the vectors of a cell's block before its queries."""
        cell, held, index = None, [], None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("dim", "block", "part", "asks")], axis=1)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)], strict=True):
                if lo == hi:
                    continue
                piece, now, asks = batch.slice(lo, hi - lo), tuple(keys[lo, :3].tolist()), keys[lo, 3]
                if now != cell:
                    cell, held, index = now, [], None
                rows, ids, vectors = (piece.column("row").to_numpy(), piece.column("vec_id").to_numpy(), matrix(piece))
                if not asks:
                    held.append((rows, ids, vectors))
                    continue
                if index is None:
                    if not held:
                        continue
                    index, held = Index(*(np.concatenate([h[i] for h in held]) for i in range(3))), []
                found = index.search(vectors, rows.tolist(), k)
                q = np.repeat(np.arange(len(rows)), [len(f[0]) for f in found])
                at, score = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
                yield pa.record_batch([pa.array(x) for x in (rows[q], ids[q], index.ids[at], index.rows[at], score)], names)

    return run


def nearest(rows: DataFrame, is_query: Column, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found to each row of ``rows`` (see ``usable``) where ``is_query``.

    Every row is indexed, in hashed blocks of about BLOCK. A block is indexed once and all queries are streamed past it; only
    where there are fewer blocks than cores, a block is indexed in several cells, each with a part of the queries. Blocks
    keep the k best only, which are merged by query. Equal cosines rank by vec_id. Vectors of another length than the
    query's are no candidates. Rows that share an id are candidates, and queries, of their own; an empty table or a query
    without candidates gives no row.
    """
    spark = rows.sparkSession
    rows = rows.withColumn("dim", F.size("v"))
    n = rows.count()
    blocks = max(1, -(-n // BLOCK))
    parts = -(-spark.sparkContext.defaultParallelism // blocks)
    at = lambda seed, parts: F.pmod(F.xxhash64(F.lit(seed), "row"), F.lit(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    base = rows.select("row", "vec_id", "v", "dim", at(2, blocks).alias("block"), every(parts).alias("part"), F.lit(0).alias("asks"))
    queries = rows.where(is_query).select("row", "vec_id", "v", "dim", every(blocks).alias("block"), at(1, parts).alias("part"), F.lit(1).alias("asks"))
    cell = ["dim", "block", "part"]
    dealt = base.unionByName(queries).repartition(blocks * parts, *cell).sortWithinPartitions(*cell, "asks", "row")
    found = dealt.mapInArrow(_searched(k), FOUND)
    by_query = Window.partitionBy("asked").orderBy(F.desc("score"), "vec_id", "row")
    ranked = found.withColumn("rank", F.row_number().over(by_query)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op1_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest vectors of each row whose vec_id is divisible by 50."""
    prepared(spark)
    rows = usable(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding")
    return nearest(rows, F.col("vec_id") % 50 == 0, 5)


QUERIES = {"op1_neighbours": op1_neighbours}
ORACLE: dict[str, str] = {}
