"""BPE, personal data, chat, quality, mixing, sharding and the pipeline."""

import base64
import hashlib
import itertools
import math
import random
import re
import struct

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from scriptorium.llm import bpe, chat, mixing, pii, quality, sharding
from scriptorium.llm.ranking import running_total

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
DOCS = "doc_id long, text string"


@pytest.fixture(scope="module")
def theirs():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def some_texts(n, seed=0):
    rng = random.Random(seed)
    wide = [chr(c) for c in [*range(0x180), 0x85, 0xA0, 0x1680, 0x2003, 0x2028, 0x200B, 0x3000, 0x4E2D, 0x1F600, 0x301, 0x660, 0xFEFF, *range(0x400, 0x430)]]
    pools = [wide, "abcdeinrst  \n'!1", "aaab  "]
    return ["".join(rng.choice(pools[k % 3]) for _ in range(rng.randint(0, 60))) for k in range(n)]


def test_bpe_as_the_library(theirs):
    enc, _ = bpe.encoder(PATH)
    for t in [*some_texts(3000), "a" * 20000, "<|endoftext|>", "x" * 300 + " " * 300]:
        assert np.frombuffer(b"".join(enc.parts(t)), "<u4").tolist() == theirs.encode_ordinary(t), t


def test_bpe_small_memories_and_streams(theirs, monkeypatch):
    monkeypatch.setattr(bpe, "STATES", 50)
    monkeypatch.setattr(bpe, "WORDS", 5)
    monkeypatch.setattr(bpe, "STREAM", 20)
    enc = bpe.Encoder(PATH)
    for t in some_texts(300, 4):
        assert np.frombuffer(b"".join(enc.parts(t)), "<u4").tolist() == theirs.encode_ordinary(t)


def test_tokens_before_count_by_what_may_follow():
    enc, _ = bpe.encoder(PATH)
    rng = random.Random(2)
    for _ in range(2000):
        a, b = rng.randrange(len(enc.vocab)), rng.randrange(len(enc.vocab))
        merged = enc.transducer._merge(enc.vocab[a] + enc.vocab[b], 1 << 40)
        assert enc.transducer.follows(a, b) == (merged == [a, b])


def test_streaming_decode():
    enc, clean = bpe.encoder(PATH)
    for t in some_texts(200, 7):
        ids = np.frombuffer(b"".join(enc.parts(t)), "<u4")
        d = bpe.Decoder(enc.vocab, clean)
        assert (b"".join(d.feed(ids[i : i + 1]) for i in range(len(ids))) + d.finish()).decode() == t
    byte = {b: i for i, b in enumerate(enc.vocab) if len(b) == 1}
    for raw in (b"\xff", b"a\xe2\x82", b"\xe2\x28\xa1", b"\xed\xa0\x80", b"\xf4\x90\x80\x80", b"\xc0\xaf"):
        d = bpe.Decoder(enc.vocab, clean)
        out = d.feed(np.array([byte[bytes([b])] for b in raw], np.uint32)) + d.finish()
        assert out.decode() == raw.decode(errors="replace"), raw


def test_bpe_frames(spark):
    rows = [(1, "Hällo  wörld"), (2, None), (3, ""), (3, "")]
    df = spark.createDataFrame([(*r, "n") for r in rows], f"{DOCS}, n_tokens string")
    back = bpe.decode(bpe.encode(df, PATH, ["doc_id"]), PATH, ["doc_id"]).collect()
    assert sorted((r.doc_id, r.text) for r in back) == [(1, "Hällo  wörld"), (2, ""), (3, ""), (3, "")]
    digests = {r.doc_id: r for r in bpe.round_trip(df, PATH, ["doc_id"]).collect()}
    assert digests[1].decoded_sha256 == hashlib.sha256("Hällo  wörld".encode()).hexdigest() and digests[2].n_tokens == 0
    assert bpe.round_trip(df.where("false"), PATH, ["doc_id"]).count() == 0


def brute(text):
    out = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m.group().split(".")):
            out.append((1, *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in reversed(re.sub("[^0-9]", "", m.group()))]
        if 16 <= len(d) <= 19 and sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(d)) % 10 == 0:
            out.append((2, *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            out.append((3, *m.span()))
    return out


def test_base_spans():
    rng = random.Random(3)
    parts = ["1", "2", "25", "0", ".", "@", "a", "-", "+", " ", "(", ")", "b.c", "@d.e", "4111 1111 1111 1111", "é", "%", "\n", "٣", "x" * 70, "1.2.3.4"]
    for _ in range(6000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))
        assert pii.base_spans(t) == brute(t), t
    assert len(pii.base_spans("a" * 200_000 + "@b.cc")) == 1


LINES = [f"call +1 ({n}) 555-{n}1 or mail a{n}.b@mail{n % 9}.example.com from {n % 200}.7.3.{n % 90} now" for n in range(100, 400)]


def test_field_adds_mentions_and_keeps_base(spark):
    df = spark.createDataFrame(list(enumerate(LINES)), DOCS)
    model = pii.fitted(df)
    texts = ["Ring +1 (988) 555-2485. Later (988) 555-2485 or 5552485; not 12345 and (123) 45.", "Nothing here. Version 4.0, page 12.", ""]
    bases, spans = pii.all_spans(texts, model)
    assert [(pii.KINDS[k], texts[0][s:e]) for k, s, e in spans[0]] == [("phone", "+1 (988) 555-2485"), ("phone", "(988) 555-2485"), ("phone", "5552485")]
    assert spans[1] == [] and spans[2] == [] and all(set(b) <= set(s) for b, s in zip(bases, spans, strict=True))
    assert pii.redacted(texts[0], spans[0]).startswith("Ring <PHONE>. Later <PHONE> or <PHONE>; not 12345")


def test_messages_settle_on_the_exact_marginals_of_a_chain():
    rng = np.random.default_rng(0)
    k = len(pii.KINDS) + 1
    model = {"shape": rng.normal(size=(len(pii.SHAPES), k)), "chain": rng.normal(size=(k, k)), "skip": 2 * np.eye(k)}
    shape = rng.random((3, len(pii.SHAPES)))
    g = {"shape": shape, "held": np.zeros(3, int), "joined": np.array([False, True, True]), "entity": np.full(3, -1), "entities": 0}
    got = pii.posterior(g, model, rounds=60)
    u = shape @ model["shape"]
    joint = np.exp(u[0][:, None, None] + u[1][None, :, None] + u[2][None, None] + model["chain"][:, :, None] + model["chain"][None])
    joint /= joint.sum()
    want = [joint.sum(axis=(1, 2)), joint.sum(axis=(0, 2)), joint.sum(axis=(0, 1))]
    assert np.abs(got - np.array(want)).max() < 1e-6


def exact(g, model):
    """Marginals of the tokens by all labellings of tokens and entities."""
    k, n, m = len(pii.KINDS) + 1, len(g["held"]), g["entities"]
    u = g["shape"] @ model["shape"]
    out = np.zeros((n, k))
    for y in itertools.product(range(k), repeat=n):
        if any(h and y[i] != h for i, h in enumerate(g["held"])):
            continue
        w = sum(u[i, y[i]] for i in range(n)) + sum(model["chain"][y[i - 1], y[i]] for i in range(1, n) if g["joined"][i])
        total = np.exp(w)
        for e in range(m):
            total *= sum(np.exp(sum(model["skip"][y[i], z] for i in range(n) if g["entity"][i] == e)) for z in range(k))
        out[range(n), y] += total
    return out / out.sum(axis=1, keepdims=True)


@pytest.mark.parametrize("entity,joined,near", [
    ([0, -1, 0, -1, 1, 1], [0, 0, 0, 0, 0, 0], 1e-4),  # trees: exact
    ([0, 0, 0, 1, 1, 1], [0, 0, 0, 1, 0, 0], 1e-4),
    ([0, 1, 0, 1, -1, 0], [0, 1, 1, 1, 1, 0], 0.05),  # loops
])
def test_messages_against_all_labellings_with_entities(entity, joined, near):
    for seed in range(4):
        rng = np.random.default_rng(seed)
        k = len(pii.KINDS) + 1
        model = {"shape": rng.normal(size=(len(pii.SHAPES), k)) / 2, "chain": rng.normal(size=(k, k)) / 2, "skip": rng.normal(size=(k, k)) / 2 + np.eye(k)}
        g = {
            "shape": rng.random((6, len(pii.SHAPES))), "held": np.array([0, 0, rng.integers(0, k), 0, 0, 0]), "joined": np.array(joined, bool),
            "entity": np.array(entity), "entities": 2,
        }
        assert np.abs(pii.posterior(g, model, rounds=80) - exact(g, model)).max() < near


def test_potentials_are_fitted_and_skip_edges_find_mentions(spark):
    model = pii.fitted(spark.createDataFrame([(i, f"{t} again a{100 + i}.b@mail{(100 + i) % 9}.example.com") for i, t in enumerate(LINES)], DOCS))
    kinds = range(1, len(pii.KINDS) + 1)
    assert all(model["skip"][k, k] > pii.AGREEMENT and model["skip"][k, k] > model["skip"][0, k] + 1 for k in kinds)
    assert np.abs(model["chain"]).max() > 0.5
    text = "Ring +1 (988) 555-2485 today. It was 5552485 before, not 5552486."
    at = text.index("5552485")
    alone = model | {"skip": np.zeros_like(model["skip"])}
    assert (3, at, at + 7) in pii.all_spans([text], model)[1][0] and (3, at, at + 7) not in pii.all_spans([text], alone)[1][0]
    assert not any(s >= text.index("5552486") for _, s, _ in pii.all_spans([text], model)[1][0])


def test_labels_and_neighbours_for_fitting():
    texts = ["+1 988 555-2485 and 5552485, x@y.zz 12"]
    g = pii.graph(texts, [pii.base_spans(t) for t in texts])
    # label, before, after, entity of: +1, 988, 555-2485, 5552485 (tied to it), x@y.zz, 12
    assert pii.observed(g).tolist() == [[4, -1, 4, -1], [4, 4, 4, -1], [4, 4, -1, 4], [4, -1, 1, 4], [1, 4, 0, -1], [0, 1, -1, -1]]


def test_pii_of_long_tokens(spark):
    """A token's digits, signs and key are those of the whole token."""
    model = pii.fitted(spark.createDataFrame(list(enumerate(LINES)), DOCS))
    for filler in ("x", "_", "é"):
        found = [pii.all_spans([f"+1 (988) 555-2485 and {filler * n}5552485"], model)[1][0] for n in (200, 300, 5000)]
        assert len({len(f) for f in found}) == 1
    assert pii.likeness_key("x" * 400 + "5552485") == "5552485" and pii.shape("x" * 400 + "@")[1]


def test_pii_frames(spark):
    df = spark.createDataFrame([(1, "a@b.cc", "s"), (2, None, "s"), (3, "", None), (1, "a@b.cc", "s")], f"{DOCS}, spans string")
    model = pii.fitted(df)
    rows = pii.find(df, ["doc_id"], model).collect()
    assert sorted((r.doc_id, r.n_email, r.spans) for r in rows) == [(1, 1, "email:0:6"), (1, 1, "email:0:6"), (2, 0, ""), (3, 0, "")]
    assert sorted(str(r.text) for r in pii.redact(df, model).collect()) == ["", "<EMAIL>", "<EMAIL>", "None"]
    assert pii.find(df.where("false"), ["doc_id"], pii.fitted(df.where("false"))).count() == 0


def test_chat_round_trip(spark):
    odd = ["<|im_end|>", "<\\|im_end|>", "<\\\\|x", "a<", "|b", "<|im_end|>\n<|im_start|>assistant\nok", "é日😀", "", None, "\\", "\n"]
    rng = random.Random(5)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "ro\nle", "<|r", "\\n", None]), rng.choice(odd)) for c in range(40) for t in range(rng.randint(1, 6))]
    rows += [(None, 0, "user", "x"), (7, 0, "user", "again"), (8, None, "assistant", "first")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    made = {r.conv_id: r for r in chat.format_chat(df).collect()}
    by_conv = {}
    for c, t, role, text in rows:
        by_conv.setdefault(c, []).append((-1 if t is None else t, role is not None, role or "", text is not None, text or ""))
    assert set(made) == set(by_conv)
    for c, turns in by_conv.items():
        turns.sort()
        r = made[c]
        assert [(x, y) for x, y, _ in chat.parse(r.formatted)] == [(t[2], t[4]) for t in turns]
        said = [chat.unescape(r.formatted[s.start : s.end]) for s in r.loss_spans]
        assert said == [t[4] for t in turns if t[2] == "assistant"] and r.n_turns == len(turns)
    assert chat.format_chat(df.where("false")).count() == 0


def test_chat_over_batches():
    n = 900
    batches = [pa.record_batch([pa.array([1] * n), pa.array(["user"] * n), pa.array(["x" * i for i in range(n)])], ["conv_id", "role", "text"])] * 3
    (made,) = pa.Table.from_batches(list(chat._conversations(iter(batches)))).to_pylist()
    assert made["n_turns"] == 3 * n and [t for _, t, _ in chat.parse(made["formatted"])] == ["x" * i for i in range(n)] * 3


def jump(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_hash(spark):
    rng = random.Random(1)
    keys = [0, 1, -1, (1 << 63) - 1, -(1 << 63), *[rng.randrange(-(1 << 63), 1 << 63) for _ in range(500)]]
    rows = spark.createDataFrame([(k,) for k in keys], "k long").select("k", sharding.jump_hash(F.col("k"), 1, 8, 9, 30).alias("s")).collect()
    for r in rows:
        assert r.s == [jump(r.k % (1 << 64), n) for n in (1, 8, 9, 30)]


def test_shards(spark):
    rows = [(i, "x") for i in range(300)] + [(None, "y")] * 200 + [(5, "z")] * 100
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, size string, slot string")
    made = sharding.shard(df, "doc_id", 8, ["size"]).collect()
    assert len(made) == len(rows)
    for s in range(8):
        assert sorted(r.slot for r in made if r.shard == s) == list(range(sum(r.shard == s for r in made)))
    assert all(r.grown_shard in (r.shard, 8) for r in made)
    for k in (None, 5):
        assert len({r.shard for r in made if r.doc_id == k}) == 1
    assert sharding.shard(df.where("false"), "doc_id", 8).count() == 0


def test_running_total(spark):
    rows = [(g, i, i % 5) for g in ("a", "b", None) for i in range(400 if g == "a" else 7)]
    df = spark.createDataFrame(rows, "g string, o int, v long").repartition(6)
    got = {(r.g, r.o): r.t for r in running_total(df, ["g"], ["o"], "v", "t").collect()}
    total = {}
    for g, o, v in rows:
        assert got[(g, o)] == total.get(g, 0)
        total[g] = total.get(g, 0) + v


def test_targets(spark):
    rng = random.Random(2)
    for _ in range(5):
        sizes = {f"s{i}": rng.choice([0, 1, 10, 1000, 50000]) for i in range(rng.randint(1, 12))} | {None: 77}
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r.source: r.target for r in mixing.source_targets(df).collect()}
        names = [*sorted(n for n in sizes if n), None]
        weight = {n: (5, 2, 1)[i % 3] for i, n in enumerate(names)}
        free, left, want = set(names), sum(sizes.values()), {}
        while free:
            over = [n for n in free if left * weight[n] / sum(weight[m] for m in free) > 3 * sizes[n]]
            if not over:
                break
            for n in over:
                want[n] = 3 * sizes[n]
            free -= set(over)
            left -= sum(want[n] for n in over)
        want |= {n: left * weight[n] / sum(weight[m] for m in free) for n in free}
        assert all(abs(got[n] - want[n]) < 1e-6 for n in names)


def test_mix(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice(["a", "a", "a", "b", "c", "d", None]), rng.choice([0, 1, 5, 40, 3000])) for i in range(400)] + [(5, "a", 40)] * 3 + [(None, "b", None)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, source string, size long, taken string")
    docs, slots = mixing.mix(df, "doc_id", block=64)
    made = docs.collect()
    assert len(made) == len(rows) and all(r.taken <= 3 * r.size and r.copies <= 3 for r in made)
    for s in {r.source for r in made}:
        own = [r for r in made if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 1
        assert sum(r.size for r in own) == own[0].source_size
    taken = slots.groupBy("source").agg(F.sum("words").alias("n")).collect()
    assert {r.source: r.n for r in taken} == {s: sum(r.taken for r in made if r.source == s) for s in {r.source for r in taken}}
    again = mixing.mix(df, "doc_id", block=64)[0].collect()
    assert sorted(map(str, again)) == sorted(map(str, made))
    assert mixing.mix(df.where("false"), "doc_id")[0].count() == 0


def test_schedule_is_even(spark):
    df = spark.createDataFrame([("a", 6400, 6400.0), ("b", 3200, 3200.0), ("c", 3200, 3200.0)], "source string, source_size long, target double")
    slots = [r.source for r in mixing.schedule(df, 64).where("slot < 200").orderBy("slot").collect()]
    for n in range(8, 200, 8):
        assert abs(slots[:n].count("a") / n - 0.5) <= 4 / n


GOOD = ["the house is on the hill and the river runs by it", "a man walks along the road to the old town", "we read the book in the evening by the fire"]
JUNK = ["BUY!! NOW!! CHEAP!! DEAL!! FAST!!", "$$$ ### click$$$ here### win*** money&&& now%%%", "spam spam spam spam spam spam spam spam"]


def corpus(spark, n=240):
    rng = random.Random(6)
    rows = []
    for i in range(n):
        base = rng.choice(JUNK if i % 4 == 0 else GOOD).split()
        rng.shuffle(base)
        rows.append((i, " ".join(base * 3), int(i % 4 != 0)))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], DOCS)
    return docs, spark.createDataFrame([(i, q) for i, _, q in rows if i % 2 == 0], "doc_id long, quality int"), rows


def test_quality_on_held_out_labels(spark):
    docs, labels, rows = corpus(spark)
    made = {r.doc_id: r.keep for r in quality.resample(docs, labels, "doc_id").collect()}
    assert len(made) == len(rows)
    held_out = [(made[i], q) for i, _, q in rows if i % 2]
    assert sum(k == bool(q) for k, q in held_out) / len(held_out) >= 0.95
    assert {r.doc_id for r in quality.kept(docs, labels, "doc_id").collect()} == {i for i, k in made.items() if k}


def plain_features(text):
    """The buckets of both families, n-gram by n-gram."""
    b = text.encode()
    m32 = (1 << 32) - 1
    three = [(((((b[i] * 0x9E3779B1 + b[i + 1]) & m32) * 0x85EBCA6B + b[i + 2]) & m32) * 0xC2B2AE35 & m32) >> 16 for i in range(len(b) - 2)]
    kind = lambda c: 0 if c in range(9, 14) or c == 32 else 32 if c in b".," else 2 if 48 <= c < 58 else 4 if 65 <= c < 91 else 8 if 97 <= c < 123 else 16 if c >= 128 else 1 if 33 <= c < 127 else 0  # noqa: E731, E501
    words = re.findall(rb"[^\x20\x09-\x0D]+", b)
    shapes = []
    for i, w in enumerate(words):
        union = 0
        for c in w:
            union |= kind(c)
        same = (1 if i >= 1 and words[i - 1] == w else 0) | (2 if i >= 2 and words[i - 2] == w else 0)
        shapes.append((((union * 64 + kind(w[0])) * 64 + kind(w[-1])) * 8 + min(len(w), 24) // 4) * 4 + same)

    def mixed(h):
        for _ in range(2):
            h = ((h ^ (h >> 32)) * 0xD6E8FEB86659FD93) & ((1 << 64) - 1)
        return h ^ (h >> 32)

    return three, [mixed((x << 32) + y) % quality.SHAPES for x, y in zip(shapes, shapes[1:], strict=False)]


def test_quality_against_brute_force(spark):
    docs, labels, rows = corpus(spark, 120)
    extra = [(500, ""), (501, None), (502, "ab"), (503, "Ünï cödé, 12.5!"), (7, "a second text of seven")]
    rng = random.Random(2)
    extra += [(600 + i, " ".join(rng.choice(GOOD if rng.random() < 0.5 else JUNK).split()[rng.randrange(4)] for _ in range(12))) for i in range(80)]
    docs = docs.unionByName(spark.createDataFrame(extra, DOCS))
    texts = [(i, t) for i, t, _ in rows] + extra
    marks = {r.doc_id: r.quality for r in labels.collect()}
    least = {}
    for i, t in texts:
        if i in marks and t is not None:
            least[i] = min(least.get(i, t), t)
    raw, good = (np.zeros(quality.BUCKETS + quality.SHAPES) for _ in range(2))
    for into, chosen in ((raw, [t for _, t in texts]), (good, [t for i, t in least.items() if marks[i] == 1])):
        for t in chosen:
            three, two = plain_features(t or "")
            np.add.at(into, three, 1)
            np.add.at(into, [quality.BUCKETS + x for x in two], 1)
    ratio = quality.log_ratio(good, raw)

    def weight(t):
        three, two = plain_features(t or "")
        return sum(float(np.mean(ratio[[base + x for x in grams]])) for grams, base in ((three, 0), (two, quality.BUCKETS)) if grams)

    cut = quality.threshold(np.array([weight(t) for t in least.values()]), np.array([marks[i] == 1 for i in least]))
    weights = [weight(t) for _, t in texts]

    def noise(i):
        h = xxhash.xxh64_intdigest(struct.pack("<q", i), xxhash.xxh64_intdigest(struct.pack("<i", 5), 42))
        return -math.log(-math.log(((h >> 12) + 0.5) / (1 << 52)))

    noisy = [w + noise(i) for w, (i, _) in zip(weights, texts, strict=True)]
    k = sum(w > cut for w in weights)
    last = sorted(noisy, reverse=True)[k - 1]
    want = sorted((i, round(w, 5), round(x, 5), x >= last) for (i, _), w, x in zip(texts, weights, noisy, strict=True))
    made = quality.resample(docs, labels, "doc_id").collect()
    assert sorted((r.doc_id, round(r.weight, 5), round(r.noisy, 5), r.keep) for r in made) == want
    # the noise decides: texts above the threshold go, others stay in their place
    assert any((w > cut) != (x >= last) for w, x in zip(weights, noisy, strict=True))


def test_quality_ties_at_the_last_place_and_any_columns(spark):
    docs, labels, _ = corpus(spark)
    same = docs.where("doc_id = 1")
    many = docs.unionByName(same).unionByName(same)
    made = quality.resample(many, labels, "doc_id").collect()
    assert len({r.keep for r in made if r.doc_id == 1}) == 1
    clash = many.withColumn("_weight", F.lit("w")).withColumn("_noisy", F.lit(1)).withColumn("weight", F.lit(None).cast("int")).withColumn("_mark", F.lit(2))
    kept = quality.kept(clash, labels, "doc_id")
    assert kept.columns == clash.columns and sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in made if r.keep)
    assert {r._weight for r in kept.collect()} == {"w"}
    long = docs.unionByName(spark.createDataFrame([(999, "the river runs by the hill " * 100_000)], DOCS))
    assert 999 in {r.doc_id for r in quality.kept(long, labels, "doc_id").collect()}


def test_quality_edges(spark):
    docs, labels, _ = corpus(spark)
    odd = docs.unionByName(spark.createDataFrame([(None, None), (900, ""), (901, "ab"), (0, "again again")], DOCS)).withColumn("weight", F.lit("x"))
    assert quality.resample(odd, labels.unionByName(labels), "doc_id").count() == 244
    assert quality.kept(odd, labels.where("false"), "doc_id").count() == 244  # no labels: all stay
    assert quality.resample(docs.where("false"), labels, "doc_id").count() == 0
    assert quality.kept(docs.where("false"), labels, "doc_id").count() == 0


def test_weights_do_not_depend_on_the_batch(spark):
    docs, labels, _ = corpus(spark)
    ratio, _ = quality.fit(docs, labels, "doc_id")
    one = sorted(tuple(r) for r in quality.weigh(docs.coalesce(1), ratio, ["doc_id"]).collect())
    assert one == sorted(tuple(r) for r in quality.weigh(docs.repartition(7), ratio, ["doc_id"]).collect())


def test_pipeline(spark, tmp_path, theirs):
    docs, labels, rows = corpus(spark)
    rng = random.Random(1)
    more = [" ".join(rng.choice(GOOD).split()[k % 5] + str(rng.randrange(9999)) for k in range(40)) for _ in range(60)]
    extra = [(1000 + i, f"{t} mail a{i}@b{i}.cc end") for i, t in enumerate(more)]
    table = docs.unionByName(spark.createDataFrame(extra, DOCS))
    table = table.select("doc_id", "text", F.lit("en").alias("lang"), F.concat(F.lit("s"), F.col("doc_id") % 2).alias("source"), F.length("text").cast("long").alias("n_chars"))
    table.write.parquet(f"{tmp_path}/documents.parquet")
    labels.withColumn("toxic", F.lit(0)).write.parquet(f"{tmp_path}/labels.parquet")
    step = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before, step = step, stage(spark, step, str(tmp_path))
        step.write.parquet(f"{tmp_path}/{name}")
        step = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = step
        if name != "tokens":
            assert step.columns == before.columns
    junk = {i for i, _, q in rows if not q}
    assert not junk & {r.doc_id for r in seen["quality"].collect()}
    texts = [frozenset(r.text.split()) for r in seen["near_duplicates"].collect()]
    assert len(texts) == len(set(r.text for r in seen["near_duplicates"].collect()))
    assert all("@" not in r.text and r.n_chars == len(r.text) for r in seen["personal_data"].collect())
    assert max(r["count"] for r in seen["mix"].groupBy("doc_id").count().collect()) <= 3
    text_of = {r.doc_id: r.text for r in seen["mix"].collect()}
    for r in seen["tokens"].collect():
        assert r.ids == theirs.encode_ordinary(text_of[r.doc_id]) and r.n_tokens == len(r.ids)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == seen["tokens"].count()


def test_registered_queries_run(spark):
    from scriptorium.llm import registry

    assert len({re.match(r"op(\d+)_", n)[1] for n in registry.QUERIES}) == 10
    for name, query in registry.QUERIES.items():
        assert query(spark, "/root/testdata/sf0.001").count() > 0, name
