"""Sources by format; ``read_corpus`` reads a folder of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import Corpus
from ..session import prepared

#: Names of formats.
FORMATS = ("coraxml", "trans", "bonnxml", "docx")


def key_of(spark: SparkSession, file: Column, path: str) -> Column:
    """A file's path below ``path``, without its last ending, so files of one name in different folders keep apart.

    For a pattern, whose base isn't known, the whole path counts.
    """
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    base = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(hadoop).toString()
    bare = lambda c: F.regexp_replace(c, "^file:/+", "file:/")
    own, base = bare(file), base.replace("file:///", "file:/").rstrip("/")
    below = F.when(own.startswith(f"{base}/"), F.substring(own, len(base) + 2, 1 << 20)).when(own == base, F.substring_index(own, "/", -1)).otherwise(own)
    return F.regexp_replace(below, r"(?<=[^/])\.[^./]*$", "")


def files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_key, content) of all files under ``path``; see ``key_of``."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return rows.select(key_of(spark, F.col("path"), path).alias("doc_key"), "content")


def read_corpus(
    spark: SparkSession, path: str, format: str = "trans", dialect: str | None = None, strict: bool = True, legacy: bool = False, store: str | None = None
) -> Corpus:
    """All documents under ``path`` (any file system that Spark reads); ValueError for an unknown format or dialect.

    With ``store`` the tables are written there and read again; see ``Corpus.stored``.
    """
    from ..functions.dialects import dialect as known
    from .bonnxml import read_bonnxml
    from .dualxml import read_dualxml
    from .docx import docx_texts
    from .trans import read_trans

    if format not in FORMATS:
        raise ValueError(f"unknown format: {format}")
    prepared(spark)
    of = known(dialect).name
    rows = files(spark, path)
    if format == "coraxml":
        corpus = read_dualxml(rows, of, strict, legacy)
    elif format == "bonnxml":
        corpus = read_bonnxml(rows, of, strict, legacy)
    else:
        texts = docx_texts(rows) if format == "docx" else rows.select("doc_key", F.decode("content", "UTF-8").alias("text"))
        corpus = read_trans(texts, of, strict, legacy)
    return corpus.stored(store) if store else corpus
