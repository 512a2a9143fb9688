"""Stages of the pipeline against brute force."""

import random
import re
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from scriptorium.llm import mixing, pii, simhash

DOCS = "doc_id long, text string"
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def index(x, y):
    return len(x & y) / len(x | y) if x | y else 1.0


def kept_by_brute_force(rows):
    """Keys of the first of each component of texts with an exact index of 0.8 or more."""
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(sorted(sets), 2):
        x, y = sets[i], sets[j]
        if 5 * len(x & y) >= 4 * len(x | y):
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return {find(i) for i in sets}


def edges_of_the_threshold(seed=4):
    """Texts of 4 to 700 words and copies of them with changed, added or cut words, on both sides of 0.8."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    out = [None, "", " \n", "One", "one", "a b c d e f g h", "A  b c d e f g h i"]
    for n in [8, 9, 12, 13, 16, 20, 25, 30, 40, 60, 90, 150, 300, 700] * 6:
        base = [word() for _ in range(n)]
        out.append(" ".join(base))
        for share in (0.7, 0.9, 1.0, 1.1, 1.3):  # of the changes that come to 0.8
            own = list(base)
            cut = max(1, round(n * 0.2 * share))
            way = rng.randrange(3)
            if way == 0:
                own = own[: n - cut]
            elif way == 1:
                own += [word() for _ in range(max(1, round(n * 0.25 * share)))]
            else:
                for k in range(0, n, max(5, round(45 / share))):
                    own[k] = word()
            out.append(" ".join(own))
    rng.shuffle(out)
    return list(enumerate(out))


def test_near_duplicates_against_exact_components(spark):
    rows = edges_of_the_threshold()
    sets = [shingles(t) for _, t in rows]
    pairs = [index(x, y) for x, y in combinations(sets, 2) if x & y]
    assert sum(0.7 <= p < 0.8 for p in pairs) > 50 and sum(0.8 <= p < 0.9 for p in pairs) > 50
    kept = simhash.distinct_texts(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted(r.doc_id for r in kept) == sorted(kept_by_brute_force(rows))


def test_near_duplicates_in_crowds_and_split_cells(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 16)
    monkeypatch.setattr(simhash, "PLACES", 1)
    monkeypatch.setattr(simhash, "SHINGLES", 3000)
    monkeypatch.setattr(simhash, "TOLD", 100)
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    rows = []
    for changes in (1, 2, 3, 4):  # the last ones are just below 0.8, so most of a crowd stays apart
        base = [word() for _ in range(90)]
        for _ in range(60):
            own = list(base)
            for k in rng.sample(range(5, 85), changes):
                own[k] = word()
            rows.append((len(rows), " ".join(own)))
    rng.shuffle(rows)
    kept = simhash.distinct_texts(spark.createDataFrame(rows, DOCS)).collect()
    want = kept_by_brute_force(rows)
    assert 4 < len(want) < len(rows)
    assert sorted(r.doc_id for r in kept) == sorted(want)


def test_a_crowd_round_one_text_gives_a_link_for_each_text():
    """Copies of one text that are near it but not each other: all pairs are looked at, few links leave the cell."""
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 200, dtype=np.uint64)
    sets = [base]
    for _ in range(150):
        own = base.copy()
        own[rng.choice(200, 18, replace=False)] = rng.integers(0, 1 << 63, 18, dtype=np.uint64)
        sets.append(own)
    sets = [np.unique(x) for x in sets]
    rng.shuffle(sets[1:])
    fps = np.stack([simhash.majority(x, 8) for x in sets])
    n = len(sets)
    ends = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
    found = list(simhash._similar_links(simhash.NEAR_RADIUS)(np.arange(n), fps, np.zeros(n, int), np.arange(n), True, (np.concatenate(sets).view(np.int64), ends)))
    a, b = (np.concatenate([f[i] for f in found]) for i in (0, 1))
    assert len(a) == n - 1 and set(a.tolist()) | set(b.tolist()) == set(range(n))
    for i, j in zip(a.tolist(), b.tolist(), strict=True):
        both = len(np.intersect1d(sets[i], sets[j]))
        assert 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both)
    counts = simhash.shared((np.concatenate(sets).view(np.int64), ends), most=1000)(3)
    assert counts.tolist() == [len(np.intersect1d(sets[3], x)) for x in sets]


def test_clashing_columns_and_repeated_rows(spark):
    rows = [(1, "a b c d e f g", "x"), (1, "a b c d e f g", "x"), (2, "a b c d e f g", "y"), (3, "other words here", None), (None, None, "z"), (4, "", "z")]
    names = ["_own", "_told", "_first", "_key", "_hash", "_k", "_h", "_copies", "_many", "_pos", "node", "fp", "bands", "size", "copies"]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").select("*", *[F.lit("MINE").alias(n) for n in names])
    kept = simhash.distinct_texts(df)
    assert kept.columns == df.columns and sorted((str(r.doc_id), r._key, r.node) for r in kept.collect()) == [("1", "MINE", "MINE"), ("3", "MINE", "MINE"), ("4", "MINE", "MINE")]
    mixed = mixing.mixed_rows(df, "doc_id")
    assert mixed.columns == df.columns and {tuple(r[n] for n in names) for r in mixed.collect()} == {("MINE",) * len(names)}
    assert simhash.distinct_texts(df.where("false")).count() == 0 and mixing.mixed_rows(df.where("false"), "doc_id").count() == 0


def test_stages_on_odd_rows(spark, tmp_path):
    """Nulls in every column, empty and very long texts, repeated rows, clashing names, and no rows at all."""
    long = "the river runs by the old house on the hill " * 3000
    rows = [(None, None, None, None, None), (1, "", "en", "a", 0), (2, long, None, None, len(long)), (2, long, None, None, len(long)), (3, "x@y.zz in a text", "de", "a", None), (None, "a text of its own here", "de", "b", 22)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    clash = ["_key", "_hash", "_weight", "_noisy", "node", "root", "size", "copies", "h", "spans"]
    df = df.select("*", *[F.lit(i).alias(n) for i, n in enumerate(clash)])
    spark.createDataFrame([(1, 0), (3, 1), (None, 1)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    count = {"quality": None, "near_duplicates": 4, "personal_data": 6, "mix": None, "tokens": 6}
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, df, str(tmp_path)).collect()
        assert count[name] is None or len(made) == count[name], name
        assert stage(spark, df.where("false"), str(tmp_path)).count() == 0, name
        if name == "tokens":
            assert sorted(r.n_tokens for r in made)[:2] == [0, 0]
        else:
            assert set(made[0].asDict()) == set(df.columns) and all([r[n] for n in clash] == list(range(len(clash))) for r in made), name
        if name == "personal_data":
            assert "<EMAIL> in a text" in {r.text for r in made} and any(r.text == long for r in made)


def test_long_tokens_count_whole():
    start = "漢" * 300 + "1"
    texts = [f"{start}@b {start}5552485 {start}5552486"]
    g = pii.graph(texts, [[]])
    assert len(set(g["entity"].tolist())) == 3 and g["shape"][:, pii.SHAPES.index("at")].tolist() == [1, 0, 0]
