"""Quality by importance resampling: hashed n-gram models of target and raw text, Gumbel top-k.

Texts are bags of hashed n-grams: byte trigrams, which generalise to unseen words, and bigrams of word shapes, in which a
word that repeats one of the two before it has a shape of its own. The target model counts them in texts labelled good,
the raw model in all texts. A text's weight is the mean log ratio of the two, so that its length doesn't matter; k
is the number of texts whose weight is above the threshold that separates the labelled texts best. Keys of weight plus
Gumbel noise are ranked over all texts, and the k largest are kept: a sample without replacement by weight.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpointed, prepared, unused
from .flat import flat, mixed, slices, spaces, word_hashes, words
from .ranking import rank_in_group

BUCKETS = 1 << 16
SHAPES = 1 << 12
#: Labelled texts that the target model and the threshold are fitted on at most, by the order of a hash of the key.
LABELLED = 20_000


def features(buf: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each family of n-grams (buckets, n + 1 offsets into them for the texts)."""
    n = len(buf)
    out = []
    b = buf.astype(np.uint32)
    grams = ((b[:-2] * np.uint32(0x9E3779B1) + b[1:-1]) * np.uint32(0x85EBCA6B) + b[2:]) * np.uint32(0xC2B2AE35) if n > 2 else b[:0]
    grams = (grams >> np.uint32(16)).astype(np.int64)
    keep = np.ones(len(grams), bool)
    borders = offsets[1:-1]
    for back in (1, 2):  # trigrams that cross into the next text
        at = borders - back
        keep[at[(at >= 0) & (at < len(keep))]] = False
    at = np.concatenate([[0], np.cumsum(keep)])
    out.append((grams[keep], at[np.minimum(offsets, len(grams))]))
    starts, ends, own = words(~spaces(buf), offsets)
    kind = np.zeros(256, np.uint8)
    kind[33:127], kind[48:58], kind[65:91], kind[97:123], kind[128:] = 1, 2, 4, 8, 16
    kind[[ord(c) for c in ".,"]] = 32
    shape = np.bitwise_or.reduceat(kind[buf], starts).astype(np.int64) if len(starts) else np.zeros(0, np.int64)
    if len(starts):
        # reduceat runs to the next start; white space adds nothing
        first, last = kind[buf[starts]].astype(np.int64), kind[buf[ends - 1]].astype(np.int64)
        h = word_hashes(buf, starts, ends)
        place = np.arange(len(h)) - np.repeat(own[:-1], np.diff(own))  # in its own text
        same = np.zeros(len(h), np.int64)
        same[1:] |= (h[1:] == h[:-1]) & (place[1:] >= 1)
        same[2:] |= ((h[2:] == h[:-2]) & (place[2:] >= 2)) * 2
        long = np.minimum(ends - starts, 24) // 4
        shape = (((shape * 64 + first) * 64 + last) * 8 + long) * 4 + same
    pairs = mixed((shape[:-1].astype(np.uint64) << np.uint64(32)) + shape[1:].astype(np.uint64)) if len(shape) > 1 else np.zeros(0, np.uint64)
    keep = np.ones(len(pairs), bool)
    at = own[1:-1] - 1
    keep[at[(at >= 0) & (at < len(keep))]] = False
    at = np.concatenate([[0], np.cumsum(keep)])
    out.append(((pairs[keep] % np.uint64(SHAPES)).astype(np.int64), at[np.minimum(own, len(pairs))]))
    return out


def _counts(labelled: bool):
    size = BUCKETS + SHAPES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, size), np.int64)
        for batch in slices(batches):
            good = batch.column("quality").fill_null(-1).to_numpy(zero_copy_only=False) == 1 if labelled else np.zeros(batch.num_rows, bool)
            (g3, at3), (g2, at2) = features(*flat(batch.column("text")))
            for which in (0, 1) if labelled else (0,):
                for grams, at, base, n in ((g3, at3, 0, BUCKETS), (g2, at2, BUCKETS, SHAPES)):
                    own = grams[np.repeat(good == bool(which), np.diff(at))]
                    total[which, base : base + n] += np.bincount(own, minlength=n)
        which, bucket = np.nonzero(total)
        yield pa.record_batch([pa.array(which.astype(np.int32)), pa.array(bucket.astype(np.int32)), pa.array(total[which, bucket])], ["good", "bucket", "n"])

    return run


def counts(df: DataFrame, labelled: bool = False) -> np.ndarray:
    """(2, buckets): n-grams of all texts, or of texts whose quality is not 1 and is 1. Each task sends a bounded table."""
    columns = ["text", "quality"] if labelled else ["text"]
    found = df.select(*columns).mapInArrow(_counts(labelled), "good int, bucket int, n long")
    out = np.zeros((2, BUCKETS + SHAPES), np.float64)
    table = found.groupBy("good", "bucket").agg(F.sum("n").alias("n")).toArrow()  # BUCKETS + SHAPES rows a class at most
    np.add.at(out, (table["good"].to_numpy(), table["bucket"].to_numpy()), table["n"].to_numpy())
    return out


def log_ratio(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Log of the ratio of the two models in each bucket; each family sums to 1, smoothed towards the raw model."""
    out = np.zeros(len(raw))
    for lo, hi in ((0, BUCKETS), (BUCKETS, BUCKETS + SHAPES)):
        r = (raw[lo:hi] + 0.5) / (raw[lo:hi].sum() + 0.5 * (hi - lo))
        strength = 1e-4 * max(target[lo:hi].sum(), 1.0)
        t = (target[lo:hi] + strength * r) / (target[lo:hi].sum() + strength)
        out[lo:hi] = np.log(t / r)
    return out


def _weigh(ratio: np.ndarray, keys: list[str], into: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = np.round(ratio * (1 << 24)).astype(np.int64)  # sums of whole numbers don't depend on the batch
        for batch in slices(batches):
            weight = np.zeros(batch.num_rows)
            for (grams, at), base in zip(features(*flat(batch.column("text"))), (0, BUCKETS), strict=True):
                sums = np.concatenate([[0], np.cumsum(whole[base + grams])])
                weight += (sums[at[1:]] - sums[at[:-1]]) / np.maximum(np.diff(at), 1) / (1 << 24)
            yield pa.record_batch([*[batch.column(k) for k in keys], pa.array(weight)], [*keys, into])

    return run


def weigh(df: DataFrame, ratio: np.ndarray, keep: list[str], into: str = "weight") -> DataFrame:
    """The columns ``keep`` and ``into``: the mean log ratio of each family's n-grams. A text without any has weight 0."""
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return df.select(*dict.fromkeys([*keep, "text"])).mapInArrow(_weigh(ratio, keep, into), f"{kinds}, {into} double")


def threshold(weights: np.ndarray, good: np.ndarray) -> float:
    """Separates labelled weights with the fewest errors, each class counting the same; the middle of the best gap."""
    if not good.any() or good.all():
        return -np.inf
    order = np.argsort(weights, kind="stable")
    w, g = weights[order], good[order]
    lost = np.concatenate([[0], np.cumsum(g)]) / g.sum()
    kept_bad = 1 - np.concatenate([[0], np.cumsum(~g)]) / (~g).sum()
    cost = lost + kept_bad
    cost[1:-1][w[1:] == w[:-1]] = np.inf
    best = int(np.argmin(cost))
    edges = np.concatenate([[w[0] - 1], w, [w[-1] + 1]])
    return float((edges[best] + edges[best + 1]) / 2)


def _noisy(names: list[str], seed: int, weight: str = "weight") -> Column:
    """Log weight plus standard Gumbel noise, from a hash of the key, so reruns agree; of repeated keys all have the same noise."""
    unit = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *names), 12) + 0.5) / F.lit(float(1 << 52))
    return F.col(weight) - F.log(-F.log(unit))


def fit(df: DataFrame, labels: DataFrame, key: str) -> tuple[np.ndarray, float]:
    """(log ratios, threshold) for ``df`` (key, text) and ``labels`` (key, quality).

    LABELLED bounds the labelled texts (an order by a hash of the key, so the sample is spread and repeatable; of rows that
    share a key the least text counts); the raw model counts all texts. Without labels of both kinds the threshold lets all
    pass.
    """
    mark, of = unused(df.columns, "_mark", "_of")
    some = labels.where("quality in (0, 1)").where(F.col(key).isNotNull()).groupBy(F.col(key).alias(of)).agg(F.max("quality").cast("int").alias(mark))
    some = some.orderBy(F.xxhash64(of), of).limit(LABELLED)
    texts = df.select(key, "text")
    chosen = texts.join(F.broadcast(some), F.col(key) == F.col(of))  # LABELLED pairs at most
    # of rows that share a key one text, so LABELLED bounds the texts as well
    chosen = chosen.groupBy(of).agg(F.min("text").alias("text"), F.max(mark).alias("quality"))
    by_class, raw = counts(chosen, labelled=True), counts(texts)[0]
    ratio = log_ratio(by_class[1], raw)
    marks = weigh(chosen, ratio, ["quality"]).toArrow()
    return ratio, threshold(marks["weight"].to_numpy(), marks["quality"].to_numpy() == 1)


def _least_kept(keyed: DataFrame, noisy: str, weight: str, cut: float) -> float:
    """The k-th largest key, where k is the number of weights above ``cut``."""
    k = keyed.where(F.col(weight) > F.lit(cut)).count()
    down, pos, rank = unused(keyed.columns, "_down", "_pos", "_rank")
    numbered = keyed.select(noisy).withColumn(down, -F.col(noisy)).withColumn(pos, F.monotonically_increasing_id())
    last = rank_in_group(numbered, [], [down, pos], rank).where(F.col(rank) == k - 1).select(noisy).first()
    return last[0] if last else float("inf")


def resample(df: DataFrame, labels: DataFrame, key: str, carry: list[str] | None = None, seed: int = 5) -> DataFrame:
    """(key, carried columns, weight, noisy, keep) for each row of ``df`` (key, text); ``labels`` has key and quality.

    Weights, k and ranks cover all texts; see ``fit``. Null texts are empty; texts too short for an n-gram have log weight
    0. Rows whose key is equal to the k-th are all kept; such ties come from repeated rows only. A null key is a key.
    The columns weight, noisy and keep may not be carried. An empty table gives none.
    """
    names = [key, *[c for c in carry or [] if c != key]]
    ratio, cut = fit(df, labels, key)
    keyed = checkpointed(weigh(df, ratio, names).withColumn("noisy", _noisy([key], seed)))
    return keyed.withColumn("keep", F.col("noisy") >= F.lit(_least_kept(keyed, "noisy", "weight", cut)))


def kept(df: DataFrame, labels: DataFrame, key: str, seed: int = 5) -> DataFrame:
    """The rows of ``df`` that ``resample`` keeps, whatever its other columns are called.

    The k-th largest key is found from the weights alone; a second pass then weighs the rows again and filters by it, so
    that no text is shuffled.
    """
    weight, noisy = unused(df.columns, "_weight", "_noisy")
    ratio, cut = fit(df, labels, key)
    keyed = checkpointed(weigh(df, ratio, [key], weight).withColumn(noisy, _noisy([key], seed, weight)))
    least = _least_kept(keyed, noisy, weight, cut)
    return weigh(df, ratio, df.columns, weight).where(_noisy([key], seed, weight) >= F.lit(least)).select(*df.columns)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: the log weight, the noisy key and whether the resampling keeps the document; see ``resample``."""
    prepared(spark)
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return resample(docs, labels, "doc_id").select("doc_id", F.col("weight").alias("log_weight"), "noisy", "keep")


QUERIES = {"op4_quality": op4_quality}
ORACLE: dict[str, str] = {}
