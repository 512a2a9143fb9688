"""License scans by diagonal voting.

Every rolling k-gram of words of every text is hashed, and Spark joins all the hashes to the k-grams of the templates; a hit
votes for the diagonal (place in the text minus place in the template). Votes are summed by diagonal, neighbouring diagonals
are merged, so that words left out or put in don't break a span, and spans are verified by their words, which come along
with the hashes that a template has too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import checkpointed, prepared
from .flat import flat, lowered, slices, word_hashes, words

K = 3
#: The phrases whose places are the base result.
BASE = [
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
]
#: Headers of licenses and longer notices that give further labels; most of their k-grams must stand together.
NOTICES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met 1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer 2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness"),
    ("gpl-3", "licensed under the gnu general public license version 3"),
    ("gpl-2", "licensed under the gnu general public license version 2"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details"),
    ("lgpl", "under the terms of the gnu lesser general public license"),
    ("agpl-3", "gnu affero general public license version 3"),
    ("mpl-2", "subject to the terms of the mozilla public license v 2 0"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0"),
    ("cc-by-nc", "creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-sa", "creative commons attribution sharealike 4 0 international license"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"),
    ("all-rights-reserved", "all rights reserved"),
]
#: A merged span counts if it holds this share of its template's k-grams, or all of up to SHORT (else versions that differ
#: in the last word would pass for each other); diagonals this far apart are merged.
SHARE = 0.8
SHORT = 10
APART = 3
_MIX = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(1)]


def word_mask(buf: np.ndarray) -> np.ndarray:
    """0-9, lower-cased letters a-z and all bytes of other characters than ASCII ones."""
    return ((buf >= 48) & (buf <= 57)) | ((buf >= 97) & (buf <= 122)) | (buf >= 128)


def gram_hashes(hashes: np.ndarray, k: int = K) -> np.ndarray:
    """One hash for each run of ``k`` word hashes."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = out * _MIX[0] + (hashes[i : n + i] ^ (hashes[i : n + i] >> np.uint64(31)))
    return out


def template_grams() -> list[tuple[int, str, bool, int, int, int, str]]:
    """(template, label, is base, its k-grams, place, hash, words) for each k-gram of each template."""
    out = []
    for t, (base, label, text) in enumerate([(True, *x) for x in BASE] + [(False, *x) for x in NOTICES]):
        buf = np.frombuffer(text.encode(), np.uint8)
        starts, ends, _ = words(word_mask(buf), np.array([0, len(buf)]))
        found = gram_hashes(word_hashes(buf, starts, ends))
        tokens = text.split()
        for place, h in enumerate(found.view(np.int64).tolist()):
            out.append((t, label, base, len(found), place, h, " ".join(tokens[place : place + K])))
    return out


def _strings(parts: list[bytes], at: np.ndarray, n: int) -> pa.Array:
    """n strings, null but for those ``at`` the given places."""
    there = np.zeros(n, bool)
    there[at] = True
    lengths = np.zeros(n, np.int64)
    lengths[at] = [len(x) for x in parts]
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    valid = np.packbits(there, bitorder="little")
    return pa.Array.from_buffers(pa.string(), n, [pa.py_buffer(valid), pa.py_buffer(offsets), pa.py_buffer(b"".join(parts))])


def _scan(keys: list[str]):
    wanted = np.unique(np.array([g[5] for g in template_grams()], np.int64).view(np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid = TaskContext.get().partitionId() << 40
        for batch in slices(batches):
            buf, offsets = flat(batch.column("text"))
            buf = lowered(buf)
            starts, ends, at = words(word_mask(buf), offsets)
            grams = gram_hashes(word_hashes(buf, starts, ends))
            n = batch.num_rows
            doc = np.repeat(np.arange(n), np.diff(at))[: len(grams)]
            inside = np.flatnonzero(np.arange(len(grams)) + K <= at[doc + 1])
            # each text's list begins with a place that stands for the text itself, without a hash
            size = np.bincount(doc[inside], minlength=n) + 1
            lists = np.concatenate([[0], np.cumsum(size)])
            where = np.arange(len(inside)) + doc[inside] + 1
            hashes, known = np.zeros(lists[-1], np.int64), np.ones(lists[-1], bool)
            hashes[where] = grams[inside].view(np.int64)
            known[where] = False
            said = np.flatnonzero(np.isin(grams[inside], wanted))
            texts = [b" ".join([buf[s:e].tobytes() for s, e in zip(starts[h : h + K], ends[h : h + K], strict=True)]) for h in inside[said].tolist()]
            cells = pa.StructArray.from_arrays([pa.array(hashes, mask=known), _strings(texts, where[said], int(lists[-1]))], ["gram", "said"])
            yield pa.record_batch(
                [
                    *[batch.column(k) for k in keys], pa.array(np.arange(uid, uid + n)), pa.array(np.diff(at)),
                    pa.ListArray.from_arrays(pa.array(lists.astype(np.int32)), cells),
                ],
                [*keys, "uid", "n_words", "grams"],
            )
            uid += n

    return run


def scan(df: DataFrame, key: str, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(texts, spans). texts: key, uid (one per row of ``df``), n_words. spans: uid, template, label, base, first, last,
    share, whole: a verified span's first and last word, the share of its template's k-grams, and whether all of them
    stand on one diagonal.

    Null texts are empty; repeated rows are texts of their own; only ``key`` and the text are read; an empty table gives no
    rows. All k-grams of all texts are joined to the templates', which are constants of this module (some hundreds of rows,
    so they may be broadcast). What the join leaves, a row for each text and one for each hit, is checkpointed, so all that
    follows sees the same ``uid``.
    """
    spark = df.sparkSession
    kind = df.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, uid long, n_words long, grams array<struct<gram:long,said:string>>"
    rows = df.select(F.col(key), F.col(text).alias("text")).mapInArrow(_scan([key]), schema)
    rows = rows.select(key, "uid", "n_words", F.posexplode("grams").alias("pos", "g")).select(key, "uid", "n_words", "pos", "g.gram", "g.said")
    grams = spark.createDataFrame(template_grams(), "template int, label string, base boolean, n_grams int, at int, hash long, should string")
    found = rows.join(F.broadcast(grams), (F.col("gram") == F.col("hash")) & (F.col("said") == F.col("should")), "left")
    found = checkpointed(found.where((F.col("pos") == 0) | F.col("template").isNotNull()).drop("gram", "said", "hash", "should"))
    texts = found.where("pos = 0").select(key, "uid", "n_words")
    hits = found.where("pos > 0").withColumn("place", F.col("pos").cast("long") - 1)
    hits = hits.withColumn("diagonal", F.col("place") - F.col("at"))
    votes = hits.groupBy("uid", "template", "label", "base", "n_grams", "diagonal").agg(
        F.collect_set("at").alias("ats"), F.min("place").alias("first"), F.max("place").alias("last")
    )
    line = Window.partitionBy("uid", "template").orderBy("diagonal")
    fresh = F.coalesce(F.col("base") | (F.col("diagonal") - F.lag("diagonal").over(line) > APART), F.lit(True))
    merged = (
        votes.withColumn("fresh", fresh.cast("int"))
        .withColumn("span", F.sum("fresh").over(line))
        .groupBy("uid", "template", "label", "base", "n_grams", "span")
        .agg(
            F.array_size(F.array_distinct(F.flatten(F.collect_list("ats")))).alias("met"),
            F.min("first").alias("first"), (F.max("last") + K - 1).alias("last"),
            F.max(F.array_size("ats") == F.col("n_grams")).alias("whole"),
        )
        .withColumn("share", F.col("met") / F.col("n_grams"))
    )
    return texts, merged.where(F.when(F.col("base"), F.col("whole")).otherwise(F.col("share") >= F.when(F.col("n_grams") > SHORT, SHARE).otherwise(1.0)))


def joined(labels: Column) -> Column:
    return F.array_join(F.array_sort(labels), ",")


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their places of base phrases and their license labels."""
    prepared(spark)
    texts, spans = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id")
    base = F.when(F.col("base"), F.col("first"))
    by_text = spans.groupBy(F.col("uid").alias("_uid")).agg(
        F.count(base).alias("n_base"), F.min(base).alias("first_word"), F.max(base).alias("last_word"),
        joined(F.collect_set(F.when(F.col("base"), F.col("label")))).alias("base_labels"),
        joined(F.collect_set("label")).alias("labels"), F.max("share").alias("score"),
    )
    return texts.join(by_text, F.col("uid") == F.col("_uid"), "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )


QUERIES = {"op2_licenses": op2_licenses}
_TEMPLATES = ", ".join(f"({t}, '{label}', {t < len(BASE)}, '{text}')" for t, (label, text) in enumerate([*BASE, *NOTICES]))
#: The same votes, from the words themselves instead of their hashes.
ORACLE = {
    "op2_licenses": rf"""
WITH templates AS (SELECT t, label, base, string_split(text, ' ') AS w FROM (VALUES {_TEMPLATES}) v(t, label, base, text)),
grams AS (SELECT t, label, base, len(w) - 2 AS n, place, w[place + 1] || ' ' || w[place + 2] || ' ' || w[place + 3] AS g FROM (SELECT *, unnest(range(len(w) - 2)) AS place FROM templates)),
texts AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
said AS (SELECT doc_id, place, w[place + 1] || ' ' || w[place + 2] || ' ' || w[place + 3] AS g FROM (SELECT doc_id, w, unnest(range(len(w) - 2)) AS place FROM texts WHERE len(w) > 2)),
votes AS (SELECT doc_id, t, label, base, n, said.place - grams.place AS diagonal, list(DISTINCT grams.place) AS places, min(said.place) AS first FROM said JOIN grams USING (g) GROUP BY ALL),
fresh AS (SELECT *, CASE WHEN base OR coalesce(diagonal - lag(diagonal) OVER (PARTITION BY doc_id, t ORDER BY diagonal) > {APART}, true) THEN 1 ELSE 0 END AS f FROM votes),
spans AS (SELECT *, sum(f) OVER (PARTITION BY doc_id, t ORDER BY diagonal) AS span FROM fresh),
merged AS (SELECT doc_id, label, base, n, min(first) AS first, len(list_distinct(flatten(list(places)))) AS met, max(len(places)) = n AS whole FROM spans GROUP BY doc_id, t, label, base, n, span),
kept AS (SELECT *, met / n AS share FROM merged WHERE CASE WHEN base THEN whole ELSE met / n >= CASE WHEN n > {SHORT} THEN {SHARE} ELSE 1.0 END END)
SELECT texts.doc_id, CAST(len(w) AS BIGINT) AS n_words, count(*) FILTER (WHERE base) AS n_base, CAST(min(first) FILTER (WHERE base) AS BIGINT) AS first_word,
  CAST(max(first) FILTER (WHERE base) AS BIGINT) AS last_word, coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base), '') AS base_labels,
  coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS labels, coalesce(max(share), 0.0)::DOUBLE AS score
FROM texts LEFT JOIN kept ON texts.doc_id = kept.doc_id GROUP BY texts.doc_id, w
"""
}
