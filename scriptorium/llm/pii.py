"""Personal data by patterns and a skip-chain conditional random field.

Patterns give the base spans. The field labels the tokens that hold digits or @ (O or one of the kinds): log-linear
potentials of shape, chain potentials between adjoining tokens, and skip potentials: equal or similar tokens of a document
(same last seven digits, same address apart from case) are tied to one entity node, so a group of n has n edges. Loopy
message passing lets a mention that no pattern knows (a number without its prefix, say) take the label of one that a
pattern does know. All three are fitted together by pseudo-likelihood on tokens that the patterns label. Tokens in base
spans are held to their kind; base spans always stay.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import prepared
from .flat import slices

KINDS = ["email", "ip", "card", "phone"]
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SALIENT = re.compile(r"[0-9@]")
_TOKEN = re.compile(r"\S+")
_DIGITS = re.compile(r"[0-9]+")
_NOT_LOCAL = re.compile(r"[^A-Za-z0-9._%+-]")
#: Texts and tokens that the field is fitted on at most.
FIT_TEXTS = 500
FIT_TOKENS = 20_000
#: A span is added if each of its tokens has this probability of its kind, and if it holds @ or this many digits; a card's
#: must pass the check sum.
SURE = 0.8
LEAST_DIGITS = 7
ROUNDS = 8


def luhn(digits: str) -> bool:
    d = np.frombuffer(digits.encode(), np.uint8)[::-1].astype(np.int64) - 48
    twice = d[1::2] * 2
    return bool((d[::2].sum() + (twice - 9 * (twice > 9)).sum()) % 10 == 0)


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Each @ is looked at once: the longest run of local characters before it, from the last match on, begins a match."""
    done = at = 0
    while (at := text.find("@", at)) >= 0:
        lo = at
        while lo > done:  # in windows, so a long run costs its length
            window = max(done, lo - 64)
            run = _LOCAL.search(text[window:lo])
            if run is None:
                break
            lo = window + run.start()
            if run.start():
                break
        if lo < at and (domain := _DOMAIN.match(text, at + 1)):
            yield lo, domain.end()
            done = at = domain.end()
        else:
            at += 1


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the patterns' spans, by kind, then start."""
    if not _SALIENT.search(text):
        return []
    out = [(0, s, e) for s, e in emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split(".")):
            out.append((1, *m.span()))
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    for m in _PHONE.finditer(text):
        if 8 <= sum(map(str.isdigit, m.group())) <= 15:
            out.append((3, *m.span()))
    return out


# ---------------------------------------------------------------- the field

#: Names of the shape features, one column each.
SHAPES = ["bias", "at", "quad", "luhn", "16 to 19", "1 to 3", "4 to 6", "7", "8 to 15", "20 and more", "plus", "paren", "dash", "letters", "hex", "dots"]


def tokens(text: str) -> list[tuple[int, int]]:
    """Spans of the tokens that hold a digit or @, without punctuation around them."""
    out = []
    for m in _TOKEN.finditer(text):
        word = m.group()
        if _SALIENT.search(word):
            s, e = m.span()
            core = word.rstrip(".,;:!?\"'$%&*#)]}>|")
            out.append((s + len(core) - len(core.lstrip("\"'$%&*#[{<|")), s + len(core)) if core else (s, e))
    return out


def shape(word: str) -> list[float]:
    digits = "".join(_DIGITS.findall(word))
    n = len(digits)
    parts = word.split(".")
    quad = len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts)
    letters = any(map(str.isalpha, word))
    card = 16 <= n <= 19 and not letters
    return [
        1, "@" in word, quad, card and luhn(digits), card, 1 <= n <= 3, 4 <= n <= 6, n == 7, 8 <= n <= 15, n >= 20,
        word.startswith("+"), word.startswith("("), "-" in word, letters, n >= 4 and letters and "@" not in word, len(parts) > 1,
    ]


def likeness_key(word: str) -> str:
    """Tokens with the same key are mentions of one entity; empty: of none."""
    if "@" in word:
        return word.lower()
    digits = "".join(_DIGITS.findall(word))
    return digits[-LEAST_DIGITS:] if len(digits) >= LEAST_DIGITS else ""


def graph(texts: list[str], bases: list[list[tuple[int, int, int]]]) -> dict:
    """The field's nodes for some texts: doc, span, shape, label held (0: none), joined to the one before, entity."""
    doc, spans, shapes, held, joined, entity = [], [], [], [], [], []
    keys: dict[tuple[int, str], int] = {}
    for d, (text, base) in enumerate(zip(texts, bases, strict=True)):
        if not _SALIENT.search(text):
            continue
        by_start = sorted(base, key=lambda b: b[1])
        before, i = None, 0
        open_: list[tuple[int, int, int]] = []
        for s, e in tokens(text):
            while i < len(by_start) and by_start[i][1] < e:
                open_.append(by_start[i])
                i += 1
            open_ = [b for b in open_ if b[2] > s]
            word = text[s:e]
            key = likeness_key(word)
            doc.append(d)
            spans.append((s, e))
            shapes.append(shape(word))
            held.append(open_[0][0] + 1 if open_ else 0)
            joined.append(before is not None and s - before <= 2)
            entity.append(keys.setdefault((d, key), len(keys)) if key else -1)
            before = e
    n = len(doc)
    return {
        "doc": np.array(doc, np.int64), "spans": spans, "shape": np.array(shapes, np.float64).reshape(n, len(SHAPES)),
        "held": np.array(held, np.int64), "joined": np.array(joined, bool), "entity": np.array(entity, np.int64), "entities": len(keys),
    }


#: Strength of the penalty on the weights, and what skip potentials are without evidence: agreement is favoured a little.
PENALTY = 1e-3
AGREEMENT = 2.0


def _ties(k: int) -> np.ndarray:
    """(5, k, k): which entries of the skip potentials are one number: both O, one or the other O, the same, another kind."""
    y, z = np.indices((k, k))
    return np.stack([(y == 0) & (z == 0), (y == 0) & (z > 0), (y > 0) & (z == 0), (y > 0) & (y == z), (y > 0) & (z > 0) & (y != z)]).astype(float)


def observed(g: dict) -> np.ndarray:
    """(tokens, 4) for fitting: each token's label, and the labels of the one before, the one after and its entity, or -1.

    A token that no pattern knows has the kind of the known mentions that it is tied to, else O. An entity's label, as seen
    from one mention, is that of most of the others.
    """
    k, n = len(KINDS) + 1, len(g["doc"])
    tied = g["entity"] >= 0

    def votes(label: np.ndarray) -> np.ndarray:
        out = np.zeros((g["entities"] + 1, k))  # the last row is for tokens of no entity
        np.add.at(out, g["entity"][tied], np.eye(k)[label[tied]])
        return out[g["entity"]]

    known = votes(g["held"])
    known[:, 0] = 0
    label = np.where((g["held"] == 0) & tied & known.any(axis=1), known.argmax(axis=1), g["held"])
    others = votes(label) - np.eye(k)[label] * tied[:, None]
    entity = np.where(others.any(axis=1), others.argmax(axis=1), -1)
    before = np.where(g["joined"], np.roll(label, 1), -1)
    after = np.where(np.roll(g["joined"], -1), np.roll(label, -1), -1) if n else before
    return np.column_stack([label, before, after, entity]).astype(np.int64)


def fit(shapes: np.ndarray, seen: np.ndarray, steps: int = 400) -> dict[str, np.ndarray]:
    """All potentials from labelled tokens (see ``observed``): those that make each label likeliest, given its neighbours'.

    Ascent on the pseudo-likelihood with a small penalty. Tokens that have a neighbour of any kind also count a second
    time without their shape, as if it told nothing, so the potentials between tokens are not left to the shapes. Skip
    potentials are tied over the kinds, as mentions of any kind agree alike.
    """
    k = len(KINDS) + 1
    n = len(seen)
    blind = shapes.copy()
    blind[:, 1:] = 0
    linked = (seen[:, 1:] >= 0).any(axis=1)
    shapes, seen = np.concatenate([shapes, blind[linked]]), np.concatenate([seen, seen[linked]])
    target = np.eye(k)[seen[:, 0]]
    one = [np.where((seen[:, i] >= 0)[:, None], np.eye(k)[seen[:, i]], 0.0) for i in (1, 2, 3)]
    weights, chain, ties = np.zeros((len(SHAPES), k)), np.zeros((k, k)), _ties(k)
    tied = prior = AGREEMENT * np.array([1.0, 0, 0, 1, 0])
    skip = np.tensordot(tied, ties, 1)
    rate = 2.0 / max(1, len(seen))
    for _ in range(steps if n else 0):
        score = shapes @ weights + one[0] @ chain + one[1] @ chain.T + one[2] @ skip.T
        p = np.exp(score - score.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        off = target - p
        weights += rate * (shapes.T @ off) - PENALTY * weights
        chain += rate * (one[0].T @ off + off.T @ one[1]) - PENALTY * chain
        tied = tied + rate * np.tensordot(ties, off.T @ one[2], 2) - PENALTY * (tied - prior)
        skip = np.tensordot(tied, ties, 1)
    return {"shape": weights, "chain": chain, "skip": skip}


def _pass(table: np.ndarray, message: np.ndarray) -> np.ndarray:
    """log sum over y of exp(table[y, z] + message[i, y]), less its maximum."""
    whole = message[:, :, None] + table[None]
    top = whole.max(axis=1)
    out = top + np.log(np.exp(whole - top[:, None]).sum(axis=1))
    return out - out.max(axis=1, keepdims=True)


def posterior(g: dict, model: dict[str, np.ndarray], rounds: int = ROUNDS) -> np.ndarray:
    """Probabilities of the labels by loopy sum-product messages, for all texts' nodes at once."""
    k = len(KINDS) + 1
    own = g["shape"] @ model["shape"]
    held = g["held"] > 0
    own[held] = -12.0
    own[held, g["held"][held]] = 12.0
    left, right = np.flatnonzero(g["joined"]) - 1, np.flatnonzero(g["joined"])
    tied = np.flatnonzero(g["entity"] >= 0)
    group = g["entity"][tied]
    forth, back, skip = np.zeros_like(own), np.zeros_like(own), np.zeros_like(own)
    for _ in range(rounds):
        belief = own + forth + back + skip
        to_entity = _pass(model["skip"], (belief - skip)[tied])
        total = np.zeros((g["entities"], k))
        np.add.at(total, group, to_entity)
        new = np.zeros_like(own)
        new[tied] = _pass(model["skip"].T, total[group] - to_entity)
        forth2, back2 = np.zeros_like(own), np.zeros_like(own)
        forth2[right] = _pass(model["chain"], (belief - back)[left])
        back2[left] = _pass(model["chain"].T, (belief - forth)[right])
        forth, back, skip = (forth + forth2) / 2, (back + back2) / 2, (skip + new) / 2
    belief = own + forth + back + skip
    p = np.exp(belief - belief.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def all_spans(texts: list[str], model: dict[str, np.ndarray]) -> tuple[list[list[tuple]], list[list[tuple]]]:
    """For each text the base spans and all spans, each (kind, start, end) by kind, then start."""
    bases = [base_spans(t) for t in texts]
    more = [list(b) for b in bases]
    g = graph(texts, bases)
    if len(g["doc"]):
        p = posterior(g, model)
        label = p.argmax(axis=1)
        free = (g["held"] == 0) & (label > 0) & (p.max(axis=1) >= SURE)
        # only phone numbers are written as several tokens
        goes_on = g["joined"] & free & np.roll(free, 1) & (np.roll(label, 1) == label) & (label == KINDS.index("phone") + 1)
        for i in np.flatnonzero(free & ~goes_on).tolist():
            j = i + 1
            while j < len(label) and goes_on[j]:
                j += 1
            text, start, end = texts[g["doc"][i]], g["spans"][i][0], g["spans"][j - 1][1]
            said = text[start:end]
            digits = "".join(_DIGITS.findall(said))
            if label[i] == KINDS.index("card") + 1 and not luhn(digits):
                continue
            if "@" in said or len(digits) >= LEAST_DIGITS:
                more[g["doc"][i]].append((int(label[i]) - 1, start, end))
    return bases, [sorted(m) for m in more]


# ---------------------------------------------------------------- on DataFrames


def _samples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        texts = [t or "" for t in batch.column("text").to_pylist()]
        g = graph(texts, [base_spans(t) for t in texts])
        rows = np.column_stack([g["shape"], observed(g)]) if len(g["doc"]) else np.zeros((0, len(SHAPES) + 4))
        n = rows.shape[1]
        column = pa.ListArray.from_arrays(np.arange(0, rows.size + 1, n, dtype=np.int32), pa.array(rows.ravel()))
        yield pa.record_batch([pa.array([zlib.crc32(texts[d].encode()) for d in g["doc"]], pa.int64()), column], ["h", "row"])


def fitted(df: DataFrame, text: str = "text") -> dict[str, np.ndarray]:
    """The field, fitted on a bounded sample: at most FIT_TEXTS texts with digits or @, by the order of a hash of the text,
    and at most FIT_TOKENS of their tokens, labelled by the patterns. Equal texts count once; a table without such texts
    gives a field without weights."""
    some = df.select(F.col(text).alias("text")).where(F.col("text").rlike("[0-9@]")).withColumn("h", F.xxhash64("text"))
    # hashes first, so that no task gathers texts from all others
    cut = some.select("h").distinct().orderBy("h").limit(FIT_TEXTS).agg(F.max("h")).first()[0]
    if cut is None:
        return fit(np.zeros((0, len(SHAPES))), np.zeros((0, 4), np.int64))
    some = some.where(F.col("h") <= F.lit(cut)).groupBy("h").agg(F.min("text").alias("text"))
    some = some.select("text").mapInArrow(_samples, "h long, row array<double>").orderBy("h", "row").limit(FIT_TOKENS)
    rows = np.array([r[1] for r in some.collect()]).reshape(-1, len(SHAPES) + 4)
    return fit(rows[:, : len(SHAPES)], rows[:, len(SHAPES) :].astype(np.int64))


def redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span replaced by its kind in angle brackets; of overlapping spans the first counts for all."""
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], f"<{KINDS[kind].upper()}>"]
            at = end
        elif end > at:
            at = end
    return "".join([*out, text[at:]])


def _listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def _find(model: dict[str, np.ndarray], redact: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            keys = [c for c in batch.schema.names if c != "text"]
            whole = batch.column("text").to_pylist()
            texts = [t or "" for t in whole]
            bases, spans = all_spans(texts, model)
            if redact:
                new = [t if t is None or not s else redacted(t, s) for t, s in zip(whole, spans, strict=True)]
                yield pa.record_batch([*[batch.column(c) for c in keys], pa.array(new, pa.string())], [*keys, "text"])
                continue
            counts = [pa.array([sum(b[0] == k for b in base) for base in bases], pa.int64()) for k in range(len(KINDS))]
            digest = pa.array([hashlib.sha256(_listed(b).encode()).hexdigest() for b in bases], pa.string())
            names = [*keys, *[f"n_{k}" for k in KINDS], "base_sha256", "spans"]
            yield pa.record_batch([*[batch.column(c) for c in keys], *counts, digest, pa.array(map(_listed, spans), pa.string())], names)

    return run


def find(df: DataFrame, keep: list[str], model: dict[str, np.ndarray], text: str = "text") -> DataFrame:
    """The columns ``keep``, the counts and digest of the base spans, and ``spans``: all of them. Null texts are empty.

    Only ``keep`` and the text are read; repeated rows are found in each; an empty table gives none. No shuffle.
    """
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return df.select(*keep, F.col(text).alias("text")).mapInArrow(_find(model, False), f"{kinds}, {counts}, base_sha256 string, spans string")


def redact(df: DataFrame, model: dict[str, np.ndarray]) -> DataFrame:
    """``df`` with all spans of its column text replaced by their kinds; null texts stay null."""
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in df.columns if c != "text")
    rows = df.select(*[c for c in df.columns if c != "text"], "text")
    return rows.mapInArrow(_find(model, True), f"{kinds}, text string").select(*df.columns)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: counts and digest of the base spans, and all spans."""
    prepared(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return find(docs, ["doc_id"], fitted(docs))


QUERIES = {"op6_pii": op6_pii}
ORACLE: dict[str, str] = {}
