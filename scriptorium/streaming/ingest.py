"""New documents as they come: a file stream whose micro-batches are read like a folder and appended to the tables."""

from __future__ import annotations

from dataclasses import fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.dialects import dialect as known
from ..model import Corpus
from ..session import prepared
from ..sources import key_of
from ..sources.trans import read_trans


def ingest(spark: SparkSession, path: str, store: str, state: str, dialect: str | None = None, strict: bool = True) -> StreamingQuery:
    """Watches ``path`` for transcription files and appends each batch to the tables below ``store``.

    Documents are independent of each other, so there is no state besides the files seen, which ``state`` keeps. A batch
    that is run again after a failure replaces its own part, so every document is there once.
    """
    prepared(spark)
    of = known(dialect).name
    files = spark.readStream.format("text").option("wholetext", True).option("recursiveFileLookup", True).load(path)
    rows = files.select(key_of(spark, F.col("_metadata.file_path"), path).alias("doc_key"), F.col("value").alias("text"))

    def append(batch: DataFrame, number: int) -> None:
        corpus = read_trans(batch, of, strict)
        for f in fields(corpus):
            getattr(corpus, f.name).write.mode("overwrite").parquet(f"{store}/{f.name}/batch={number}")

    return rows.writeStream.foreachBatch(append).option("checkpointLocation", state).trigger(availableNow=True).start()


def stored(spark: SparkSession, store: str) -> Corpus:
    """The tables that ``ingest`` has written."""
    return Corpus(**{f.name: spark.read.parquet(f"{store}/{f.name}").drop("batch") for f in fields(Corpus)})
