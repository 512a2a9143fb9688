"""SimHash near-duplicates by bit-sliced comparison.

Documents with equal fingerprints are one node. Nodes meet in tables keyed by some bits of the fingerprint; what meets is
compared bit plane by bit plane: plane b of a block holds bit b of 64 fingerprints in each machine word, and a query's
bit turns a plane into difference bits that are added to vertical counters. Only links that join two groups leave a
cell, so a crowd of copies gives a line of links for each node, not all pairs, and no link between components is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import checkpointed, prepared, unused
from .components import components, hub_join
from .flat import flat, lowered, mixed, slices, spaces, words

#: Fingerprints that one cell compares at most with as many; hot keys are split into pairs of such blocks.
BLOCK = 512
SEED = 42
_MANY = np.uint64(0xFFFFFFFFFFFFFFFF)


# ---------------------------------------------------------------- fingerprints


def shingle_hashes(text: bytes, starts: np.ndarray, ends: np.ndarray, width: int, seed: int = SEED) -> np.ndarray:
    """XXH64 of each run of ``width`` words of ``text``, joined by single spaces; of all words if there are fewer."""
    n = len(starts)
    if not n:
        return np.zeros(0, np.uint64)
    if bool((starts[1:] - ends[:-1] == 1).all()) and bool((np.frombuffer(text, np.uint8)[ends[:-1]] == 32).all()):
        line, begin, stop = text, starts, ends
    else:
        line = b" ".join([text[s:e] for s, e in zip(starts.tolist(), ends.tolist(), strict=True)])
        stop = np.cumsum(ends - starts + 1) - 1
        begin = stop - (ends - starts)
    k = min(width, n)
    digest = xxhash.xxh64_intdigest
    hashed = [digest(line[s:e], seed) for s, e in zip(begin[: n - k + 1].tolist(), stop[k - 1 :].tolist(), strict=True)]
    return np.array(hashed, np.uint64)


def majority(hashes: np.ndarray, lanes: int = 1) -> np.ndarray:
    """Bit b is 1 if it is set in over half of ``hashes``; counted in chunks, so memory stays bounded.

    A longer fingerprint has ``lanes`` parts of 64 bits; part i takes its bits from the hashes mixed with i.
    """
    counts = np.zeros(64 * lanes, np.int64)
    salts = (np.arange(lanes, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[None, :]
    for at in range(0, len(hashes), 4 * 255):
        chunk = hashes[at : at + 4 * 255, None]
        if lanes > 1:
            chunk = np.concatenate([chunk, mixed(chunk ^ salts[:, 1:])], axis=1)
        # sums of up to 255 bits fit into bytes, which are added many at a time
        whole = np.zeros((-(-len(chunk) // 255) * 255, lanes), np.uint64)
        whole[: len(chunk)] = chunk
        bits = np.unpackbits(whole.view(np.uint8).reshape(-1, 255, 8 * lanes), axis=2, bitorder="little")
        counts += np.add.reduce(bits, axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)


def minima(hashes: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Keys of MinHash bands: texts whose sets of hashes have Jaccard index J share a key with chance 1 - (1 - J^rows)^bands."""
    rng = np.random.default_rng(29)
    odd = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    least = np.full(bands * rows, _MANY, np.uint64)
    for at in range(0, len(hashes), 1 << 12):
        chunk = mixed(hashes[at : at + (1 << 12)])[None, :] * odd[:, None]
        least = np.minimum(least, (chunk ^ (chunk >> np.uint64(32))).min(axis=1))
    keys = np.zeros(bands, np.uint64)
    for column in mixed(least).reshape(bands, rows).T:
        keys = mixed(keys + column)
    return keys


def _fingerprints(width: int, lanes: int, repeats: bool, bands: tuple[int, int] | None, named: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            buf, offsets = flat(batch.column("text"))
            buf = lowered(buf)
            starts, ends, at = words(~spaces(buf), offsets)
            data, out, keys, names = buf.tobytes(), [], [], []
            for i in range(batch.num_rows):
                base, own = offsets[i], slice(at[i], at[i + 1])
                hashes = shingle_hashes(data[base : offsets[i + 1]], starts[own] - base, ends[own] - base, width)
                hashes = hashes if repeats else np.unique(hashes)
                out.append(majority(hashes, lanes))
                if bands:
                    keys.append(minima(hashes, *bands))
                if named:
                    names.append(xxhash.xxh64_intdigest(np.unique(hashes).tobytes(), SEED))
            own = batch.select([c for c in batch.schema.names if c != "text"])
            made = {"fp": _lists(out, lanes)}
            if bands:
                made["bands"] = _lists(keys, bands[0])
            if named:
                made["node"] = pa.array(np.array(names, np.uint64).view(np.int64))
            yield pa.record_batch([*own.columns, *made.values()], [*own.schema.names, *made])

    return run


def _lists(rows: list[np.ndarray], width: int) -> pa.ListArray:
    values = np.concatenate(rows) if rows else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(np.arange(0, len(values) + 1, width, dtype=np.int32), pa.array(values.view(np.int64)))


def fingerprints(
    df: DataFrame,
    keep: list[str],
    text: str = "text",
    width: int = 3,
    lanes: int = 1,
    repeats: bool = True,
    bands: tuple[int, int] | None = None,
    named: bool = False,
) -> DataFrame:
    """The columns ``keep`` and ``fp``: an array of ``lanes`` longs, the SimHash of the text's shingles of ``width`` words.

    A-Z counts as a-z; words are runs of other characters than ASCII white space. A text with fewer words is one
    shingle; a null text or one without words has fingerprint zero. Without ``repeats`` a shingle counts once.
    With ``bands`` (number, rows of each) there is also ``bands``, the keys of MinHash bands of the same shingles; if it
    is to be ``named``, also ``node``, a hash of the whole set of shingles.
    """
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    kinds += ", fp array<long>" + ", bands array<long>" * bool(bands) + ", node long" * named
    return df.select(*keep, F.col(text).alias("text")).mapInArrow(_fingerprints(width, lanes, repeats, bands, named), kinds)


# ---------------------------------------------------------------- bit-sliced comparison


def planes_of(fps: np.ndarray) -> np.ndarray:
    """Bit planes of n fingerprints of L 64-bit parts: (64 L, words), 64 fingerprints to a word; the last are padded."""
    n, parts = fps.shape
    padded = np.zeros((-(-n // 64) * 64, parts), np.uint64)
    padded[:n] = fps
    bits = np.unpackbits(np.ascontiguousarray(padded).view(np.uint8).reshape(len(padded), -1), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)


def within(query: np.ndarray, planes: np.ndarray, radius: int, live: np.ndarray) -> np.ndarray:
    """A bit for each fingerprint of the block: is it within ``radius`` differing bits of ``query``, and live?

    Three planes at a time go through a carry-save adder, whose sum and carry ripple into vertical counters. Counters
    start so that a lane overflows, once and for good, when it exceeds the radius; the block is left when all have.
    """
    depth = max(1, radius.bit_length())
    start = (1 << depth) - 1 - radius
    counters = [np.full(planes.shape[1], _MANY if start >> i & 1 else 0, np.uint64) for i in range(depth)]
    over = ~live
    flips = np.where(np.unpackbits(query.view(np.uint8), bitorder="little").astype(bool), _MANY, np.uint64(0))

    def add(bits: np.ndarray, at: int) -> None:
        nonlocal over
        for i in range(at, depth):
            counters[i], bits = counters[i] ^ bits, counters[i] & bits
            if i + 1 < depth and not bits.any():
                return
        over = over | bits

    n = len(planes)
    for p in range(0, n, 3):
        x = [planes[i] ^ flips[i] for i in range(p, min(p + 3, n))]
        if len(x) == 3:
            half = x[0] ^ x[1]
            one, two = half ^ x[2], (x[0] & x[1]) | (half & x[2])
            add(one, 0)
            if depth > 1:
                add(two, 1)
            else:
                add(two, 0)
                add(two, 0)
        else:
            for bits in x:
                add(bits, 0)
        if p % 12 == 9 and bool((over == _MANY).all()):
            return np.zeros_like(over)
    return ~over


def spanning(left: np.ndarray, right: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (as positions) that join what lies within the radius: inside ``left``, or between ``left`` and ``right``.

    A node that is reached leaves the block, and is asked next; each node is asked once against those not reached yet.
    Positions of ``right`` follow those of ``left``. The links span the components, as all pairs within the radius do.
    """
    whole = left if right is None else np.concatenate([left, right])
    n, cut = len(whole), len(left)
    planes = planes_of(whole)
    live = np.zeros(planes.shape[1] * 64, np.uint8)
    live[:n] = 1
    side = np.zeros((2, len(live)), np.uint8)
    side[0, :cut], side[1, cut:n] = 1, 1
    masks = [np.packbits(s, bitorder="little").view(np.uint64) for s in side]
    alive = np.packbits(live, bitorder="little").view(np.uint64)
    a, b = [], []
    first = 0
    place = np.arange(n)
    while True:
        rest = np.flatnonzero(live[first:n])
        if not len(rest):
            break
        first += int(rest[0])
        queue = [first]
        live[first] = 0
        while queue:
            q = queue.pop()
            alive = np.packbits(live, bitorder="little").view(np.uint64)
            lanes = alive if right is None else alive & masks[0 if q >= cut else 1]
            low = first >> 6 if right is None else 0
            found = np.unpackbits(within(whole[q], planes[:, low:], radius, lanes[low:]).view(np.uint8), bitorder="little")
            reached = np.flatnonzero(found) + (low << 6)
            if len(reached):
                a.append(np.full(len(reached), q))
                b.append(reached)
                live[reached] = 0
                queue.extend(reached.tolist())
    if not a:
        return place[:0], place[:0]
    return np.concatenate(a), np.concatenate(b)


def _linked(radius: int):
    def links(ids: np.ndarray, fps: np.ndarray, parts: np.ndarray, roots: np.ndarray, same: bool, sets) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if len(ids) == 2:  # most cells: one pair, no planes needed
            if parts[0] != parts[1] or same:
                if int(np.bitwise_count(fps[0] ^ fps[1]).sum()) <= radius:
                    yield ids[:1], ids[1:]
            return
        if same:
            a, b = spanning(fps, None, radius)
            yield ids[a], ids[b]
        else:
            order = np.argsort(parts, kind="stable")
            cut = int(np.searchsorted(parts[order], parts.max()))
            own = ids[order]
            a, b = spanning(fps[order][:cut], fps[order][cut:], radius)
            yield own[a], own[b]

    return links


def _apart(radius: int, places: int):
    """Pairs of different groups within the radius that are up to ``places`` apart in the cell: a few for each node.

    Places in the other block are counted from the own place on, round.
    """

    def links(ids: np.ndarray, fps: np.ndarray, parts: np.ndarray, roots: np.ndarray, same: bool, sets) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        order = np.argsort(parts, kind="stable")
        ids, fps, roots = ids[order], fps[order], roots[order]
        cut = 0 if same else int(np.searchsorted(parts[order], parts.max()))
        n = len(ids) - cut
        for o in range(1, min(places + 1, n)) if same else range(min(places, n)):
            q = np.arange(n - o if same else cut)
            c = q + o if same else cut + (q + o) % n
            q, c = (x[roots[q] != roots[c]] for x in (q, c))
            near = np.bitwise_count(fps[q] ^ fps[c]).sum(axis=1) <= radius
            yield ids[q[near]], ids[c[near]]

    return links


def shared(sets: tuple[np.ndarray, np.ndarray], most: int = 1 << 21) -> Callable[[int], np.ndarray]:
    """For one of several sets (values, n + 1 offsets) how many values it has in common with each; by lists of owners."""
    values, offsets = sets
    n = len(offsets) - 1
    owner = np.repeat(np.arange(n, dtype=np.int32), np.diff(offsets))
    order = np.argsort(values, kind="stable")
    line, owner = values[order], owner[order]

    def of(q: int) -> np.ndarray:
        own = values[offsets[q] : offsets[q + 1]]
        lo, hi = np.searchsorted(line, own, "left"), np.searchsorted(line, own, "right")
        out, at = np.zeros(n, np.int64), 0
        total = np.concatenate([[0], np.cumsum(hi - lo)])
        while at < len(own):  # in pieces, so what is gathered is bounded
            to = max(at + 1, int(np.searchsorted(total, total[at] + most, "right")) - 1)
            size = hi[at:to] - lo[at:to]
            where = np.arange(total[to] - total[at]) + np.repeat(lo[at:to] - (total[at:to] - total[at]), size)
            out += np.bincount(owner[where], minlength=n)
            at = to
        return out

    return of


def _similar_links(radius: int):
    """Links of an exact index of 0.8 or more that join groups. Every pair of nodes in different groups is looked at: what
    lies within the radius, bit-sliced, is held against the sets themselves. Only links that join two groups leave."""

    def links(ids: np.ndarray, fps: np.ndarray, parts: np.ndarray, roots: np.ndarray, same: bool, sets) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        n = len(ids)
        _, group = np.unique(roots, return_inverse=True)
        planes, common, sizes = planes_of(fps), shared(sets), np.diff(sets[1])
        lanes = np.zeros(planes.shape[1] * 64, np.uint8)
        asked = np.zeros(n, bool)
        a, b = [], []
        # the largest group is found by the others; a pair is looked at once
        for q in np.flatnonzero(group != np.bincount(group).argmax()).tolist():
            asked[q] = True
            lanes[:n] = (group != group[q]) & ~asked
            if not same:
                lanes[:n] &= parts != parts[q]
            if not lanes.any():
                continue
            near = within(fps[q], planes, radius, np.packbits(lanes, bitorder="little").view(np.uint64))
            found = np.flatnonzero(np.unpackbits(near.view(np.uint8), bitorder="little"))
            if not len(found):
                continue
            both = common(q)[found]
            found = found[5 * both >= 4 * (sizes[q] + sizes[found] - both)]
            for c in found.tolist():
                if group[c] != group[q]:
                    a.append(q)
                    b.append(c)
                    group[group == group[c]] = group[q]
        yield ids[np.array(a, np.int64)], ids[np.array(b, np.int64)]

    return links


def _cells(links, lanes: int):
    """Rows sorted by cell to the links of each cell; a cell is bounded, and so are the rows held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None

        def flush() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            t = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            col = {n: t.column(n).combine_chunks() for n in t.schema.names}
            keys = np.stack([col[n].to_numpy(zero_copy_only=False).astype(np.int64) for n in ("tab", "key", "i", "j")], axis=1)
            fps = col["fp"].flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, lanes)
            ids, part, roots = (col[n].to_numpy(zero_copy_only=False) for n in ("node", "part", "root"))
            values = ends = None
            if "shingles" in col:
                values = col["shingles"].flatten().to_numpy(zero_copy_only=False)
                ends = np.concatenate([[0], np.cumsum(pc.list_value_length(col["shingles"]).to_numpy(zero_copy_only=False))]).astype(np.int64)
            heads = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)]))
            tails = np.append(heads[1:], len(keys))
            found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
            for h, t_ in zip(heads.tolist(), tails.tolist(), strict=True):
                i, j = keys[h, 2], keys[h, 3]
                if t_ - h > 1 and (roots[h:t_] != roots[h]).any() and (i == j or (part[h:t_] != part[h]).any()):
                    sets = None if values is None else (values[ends[h] : ends[t_]], ends[h : t_ + 1] - ends[h])
                    found += links(ids[h:t_], fps[h:t_], part[h:t_], roots[h:t_], bool(i == j), sets)
            yield pa.record_batch([pa.array(np.concatenate([f[k] for f in found])) for k in (0, 1)], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("tab", "key", "i", "j")], axis=1)
            if last is not None and last != keys[0].tolist():
                yield from flush()
            changes = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            whole = int(changes[-1]) if len(changes) else 0  # rows before the cell that may go on
            if whole:
                held.append(batch.slice(0, whole))
                yield from flush()
            held.append(batch.slice(whole))
            last = keys[-1].tolist()
        yield from flush()

    return run


def exact_tables(radius: int, segments: int, agree: int) -> list[list[tuple[int, int, int]]]:
    """Tables of (part, shift, bits) for 64-bit fingerprints: pairs within ``radius`` agree in one table at least.

    The bits are cut into segments; ``radius`` differing bits spoil as many segments at most.
    """
    if segments - radius < agree:
        raise ValueError("too few segments for this radius")
    edges = [64 * i // segments for i in range(segments + 1)]
    cuts = [(0, lo, hi - lo) for lo, hi in zip(edges, edges[1:], strict=False)]
    return [list(c) for c in combinations(cuts, agree)]


def _key(table: list[tuple[int, int, int]]) -> Column:
    out, width = F.lit(0).cast("long"), 0
    for part, shift, bits in table:
        piece = F.shiftrightunsigned(F.col("fp")[part], shift).bitwiseAND(F.lit((1 << bits) - 1))
        out = out.bitwiseOR(F.shiftleft(piece, width))
        width += bits
    return out


def table_keys(nodes: DataFrame, tables: list[list[tuple[int, int, int]]]) -> DataFrame:
    """(node, tab, key) for each row of ``nodes`` (node, fp) and each of the tables."""
    keyed = F.array(*[F.struct(F.lit(t).alias("tab"), _key(table).alias("key")) for t, table in enumerate(tables)])
    return nodes.select("node", F.explode(keyed).alias("k")).select("node", "k.tab", "k.key")


def link(nodes: DataFrame, keyed: DataFrame, links, lanes: int = 1, sets: DataFrame | None = None) -> DataFrame:
    """Links (a, b) that ``links`` finds between ``nodes`` (node, root, fp) that meet in ``keyed`` (node, tab, key).

    Keys of more than BLOCK nodes are split into blocks, and each pair of blocks is a cell of its own. Rows whose key is
    theirs alone never leave the JVM, and fingerprints are joined to the others only. With ``sets`` (node, shingles, size)
    rows carry their sets of shingles, and blocks are bounded by the sets' sizes as well.
    """
    counts, size = [F.count("*").alias("n")], F.col("n") / BLOCK
    if sets is not None:
        keyed = keyed.join(sets.select(F.col("node").alias("_s"), "size"), F.col("node") == F.col("_s")).drop("_s")
        counts.append(F.sum("size").alias("size"))
        size = F.greatest(size, F.col("size") / SHINGLES)
    counts = keyed.groupBy("tab", "key").agg(*counts).where("n > 1")
    counts = counts.select(F.col("tab").alias("_t"), F.col("key").alias("_k"), F.ceil(size).cast("int").alias("blocks"))
    met = keyed.join(counts, (F.col("tab") == F.col("_t")) & (F.col("key") == F.col("_k"))).select("node", "tab", "key", "blocks")
    carried = ["root", "fp"]
    met = met.join(nodes.select(F.col("node").alias("_n"), *carried), F.col("node") == F.col("_n"))
    if sets is not None:
        met = met.join(sets.select(F.col("node").alias("_s"), "shingles"), F.col("node") == F.col("_s"))
        carried.append("shingles")
    part = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    other = F.sequence(F.lit(0), F.col("blocks") - 1)
    cells = met.withColumn("part", part).select("node", *carried, "tab", "key", "part", F.explode(other).alias("other"))
    cells = cells.select("node", *carried, "tab", "key", "part", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"))
    # an explicit number of tasks: adaptive execution would put small cells that take long together
    tasks = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        cells.repartition(tasks, "tab", "key", "i", "j")
        .sortWithinPartitions("tab", "key", "i", "j", "node")
        .mapInArrow(_cells(links, lanes), "a long, b long")
    )


def classes(prints: DataFrame, key: str, radius: int, tables: list[list[tuple[int, int, int]]], lanes: int = 1) -> DataFrame:
    """Rows of ``prints`` (key, fp, more) with ``root``, which is equal in a class, and ``class``, its smallest key.

    Rows with equal fingerprints are one node. Nodes meet in ``tables`` of their bits.
    The keys must be longs; rows with a null key are compared like others, and a class of such rows alone has class null.
    """
    none = (1 << 63) - 1
    prints = checkpointed(prints)
    least = F.coalesce(F.col(key), F.lit(none))
    nodes = checkpointed(prints.groupBy("fp").agg(F.min(least).alias("least")).withColumn("node", F.xxhash64("fp")))
    found = components(link(nodes.withColumn("root", F.col("node")), table_keys(nodes, tables), _linked(radius), lanes))
    placed = nodes.join(found.withColumnRenamed("node", "_n"), F.col("node") == F.col("_n"), "left")
    placed = checkpointed(placed.select("fp", "least", F.coalesce("root", "node").alias("root")))
    names = checkpointed(placed.groupBy(F.col("root").alias("_r")).agg(F.min("least").alias("class"), F.count("*").alias("n")))
    by_print = hub_join(placed, "root", names, "_r", "n")
    by_print = by_print.select(F.col("fp").alias("_fp"), "root", F.when(F.col("class") < none, F.col("class")).alias("class"))
    return prints.join(by_print, F.col("fp") == F.col("_fp")).drop("_fp")


#: For near-duplicates: words in a shingle, 64-bit parts of a fingerprint, and MinHash bands and rows by which they meet.
NEAR = {"width": 5, "lanes": 8, "bands": (20, 4)}
#: Differing bits of 512 up to which the exact index is asked for. At an index of 0.8 or more a bit differs with chance
#: 0.1875 at most (sets of 4 and 5, where even counts tie; 0.152 for large sets): 96 bits and six deviations of 8.8.
NEAR_RADIUS = 150
#: How many places apart pairs of the first round are at most: a few pairs for each node.
PLACES = 2
#: Shingles in a block of sets; a larger set is a block of its own.
SHINGLES = 1 << 20
#: Up to so many texts that are asked for are told to all executors; more are joined by a shuffle of the texts.
TOLD = 100_000


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            buf, offsets = flat(batch.column("text"))
            buf = lowered(buf)
            starts, ends, at = words(~spaces(buf), offsets)
            data, rows = buf.tobytes(), []
            for i in range(batch.num_rows):
                base, own = offsets[i], slice(at[i], at[i + 1])
                rows.append(np.unique(shingle_hashes(data[base : offsets[i + 1]], starts[own] - base, ends[own] - base, width)))
            ends_ = np.cumsum([0, *map(len, rows)]).astype(np.int32)
            sets = pa.ListArray.from_arrays(ends_, pa.array(np.concatenate(rows).view(np.int64)))
            yield pa.record_batch([batch.column("node"), sets], ["node", "shingles"])

    return run


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs whose sets have a Jaccard index of 4/5 or more, in whole numbers."""
    for batch in batches:
        keep = np.zeros(batch.num_rows, bool)
        left, right = batch.column("left"), batch.column("right")
        for i in range(batch.num_rows):
            x, y = (np.asarray(c[i].values) for c in (left, right))
            if 5 * min(len(x), len(y)) >= 4 * max(len(x), len(y)):
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep[i] = 5 * both >= 4 * (len(x) + len(y) - both)
        yield batch.select(["a", "b"]).filter(pa.array(keep))


def _sets_of(asked: DataFrame, nodes: DataFrame, rows: DataFrame, text: str) -> DataFrame:
    """(node, shingles, size) of the nodes in ``asked`` (_n); only their texts are hashed again."""
    asked = nodes.join(asked, F.col("node") == F.col("_n")).select("node", F.col("best._key").alias("_k"), F.col("best._hash").alias("_h"))
    asked = checkpointed(asked)
    asked = F.broadcast(asked) if asked.count() <= TOLD else asked
    texts = rows.select("_key", "_hash", F.col(text).alias("text")).join(asked, (F.col("_key") == F.col("_k")) & (F.col("_hash") == F.col("_h")))
    sets = texts.select("node", "text").mapInArrow(_sets(NEAR["width"]), "node long, shingles array<long>")
    return checkpointed(sets.dropDuplicates(["node"]).withColumn("size", F.size("shingles").cast("long")))  # rows may be repeated


def _confirmed(pairs: DataFrame, nodes: DataFrame, rows: DataFrame, text: str) -> DataFrame:
    """The ``pairs`` (a, b) of nodes whose exact index is 0.8 or more."""
    sets = _sets_of(pairs.select(F.explode(F.array("a", "b")).alias("_n")).distinct(), nodes, rows, text)
    left = sets.select(F.col("node").alias("_a"), F.col("shingles").alias("left"))
    right = sets.select(F.col("node").alias("_b"), F.col("shingles").alias("right"))
    both = pairs.join(left, F.col("a") == F.col("_a")).join(right, F.col("b") == F.col("_b"))
    return both.select("a", "b", "left", "right").mapInArrow(_similar, "a long, b long")


def similar_groups(nodes: DataFrame, rows: DataFrame, text: str) -> DataFrame:
    """``nodes`` (node, best, fp, bands) with ``root``, equal in a component of links of an exact index of 0.8 or more.

    Nodes that share a band and lie within NEAR_RADIUS are looked at, in two rounds. First the pairs next to each other in a
    cell, a few for each node, are confirmed by their sets. Then cells that still hold several groups, and pairs not looked
    at yet, get the sets themselves and give the links that join groups. So no cell gives more links than it has nodes.
    """
    keyed = nodes.select("node", F.posexplode("bands").alias("tab", "key"))
    grouped = nodes.select("node", "fp", F.col("node").alias("root"))

    def joined(links: DataFrame) -> DataFrame:
        roots = components(links).withColumnRenamed("node", "_n")
        met = nodes.join(roots, F.col("node") == F.col("_n"), "left")
        return checkpointed(met.select("node", "fp", F.coalesce("root", "node").alias("root")))

    pairs = link(grouped, keyed, _apart(NEAR_RADIUS, PLACES), NEAR["lanes"])
    pairs = checkpointed(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    links = checkpointed(_confirmed(pairs, nodes, rows, text))
    grouped = joined(links)
    # cells of up to PLACES + 1 nodes have been gone through
    placed = keyed.join(grouped.select(F.col("node").alias("_n"), "root"), F.col("node") == F.col("_n")).drop("_n")
    open_ = placed.groupBy("tab", "key").agg(F.count("*").alias("n"), F.min("root").alias("lo"), F.max("root").alias("hi"))
    open_ = open_.where((F.col("n") > PLACES + 1) & (F.col("lo") != F.col("hi"))).select(F.col("tab").alias("_t"), F.col("key").alias("_k"))
    placed = checkpointed(placed.join(open_, (F.col("tab") == F.col("_t")) & (F.col("key") == F.col("_k")), "left_semi"))
    if not placed.isEmpty():
        sets = _sets_of(placed.select(F.col("node").alias("_n")).distinct(), nodes, rows, text)
        more = link(grouped, placed, _similar_links(NEAR_RADIUS), NEAR["lanes"], sets=sets)
        grouped = joined(links.unionByName(more))
    return nodes.join(grouped.select(F.col("node").alias("_n"), "root"), F.col("node") == F.col("_n")).drop("_n")


def distinct_texts(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``df`` without near copies: of texts linked at a similarity of 0.8 or more the one with the smallest key stays.

    Similarity is the Jaccard index of sets of five-word shingles: texts meet by MinHash bands, are compared bit-sliced
    within a wide radius, and what is left is confirmed by the sets themselves. Null keys come last; equal
    keys go by the text's hash, and of equal rows one stays. Null and empty texts are copies of each other. Columns may have
    any name; an empty table stays empty.
    """
    none = (1 << 63) - 1
    own, told, first = unused(df.columns, "_own", "_told", "_first")
    rows = df.withColumns({own: F.coalesce(F.col(key).cast("long"), F.lit(none)), told: F.xxhash64(text)})
    bare = rows.select(F.col(own).alias("_key"), F.col(told).alias("_hash"), F.col(text).alias("text"))
    prints = fingerprints(bare, ["_key", "_hash"], "text", repeats=False, named=True, **NEAR)
    least = F.min(F.struct("_key", "_hash")).alias("best")
    nodes = checkpointed(prints.groupBy("node").agg(least, F.min("fp").alias("fp"), F.min("bands").alias("bands")))
    k, h = unused(rows.columns, "_k", "_h")
    best = similar_groups(nodes, bare, "text").groupBy("root").agg(F.min("best").alias("b")).select(F.col("b._key").alias(k), F.col("b._hash").alias(h))
    kept = rows.join(best.distinct(), (F.col(own) == F.col(k)) & (F.col(told) == F.col(h)))
    place = F.row_number().over(Window.partitionBy(own, told).orderBy(own))
    return kept.withColumn(first, place).where(F.col(first) == 1).select(*df.columns)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their 64-bit fingerprints, linked at 3 or fewer differing bits."""
    prepared(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    prints = fingerprints(docs, ["doc_id"])
    out = classes(prints, "doc_id", 3, tables=exact_tables(3, 5, 2))
    return out.select("doc_id", F.lower(F.lpad(F.hex(F.col("fp")[0]), 16, "0")).alias("fingerprint"), F.col("class").alias("component_id"))


QUERIES = {"op3_simhash": op3_simhash}
ORACLE: dict[str, str] = {}
