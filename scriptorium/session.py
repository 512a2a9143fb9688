"""Session helpers shared by the operators."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parents[1])


#: Arrow batches are bounded by records and bytes, so that texts of any length leave room in a worker: (setting, Spark's own
#: value, ours). A value that the user has set is left alone.
ARROW = [
    ("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "1000"),
    ("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "4194304"),
]


def prepared(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package, and keeps Arrow batches of long texts small.

    A cluster that installs the package (or ships it by ``--py-files``) needs neither setting; both are idempotent.
    """
    sc = spark.sparkContext
    paths = sc.environment.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep)
    if ROOT not in paths:
        sc.environment["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, paths)])
    for name, default, ours in ARROW:
        if spark.conf.get(name, default) == default:
            spark.conf.set(name, ours)
    return spark


def local_session(app: str = "scriptorium", cores: str = "8", memory: str = "8g") -> SparkSession:
    """A session for tests and the bench on one machine."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which all machines share.

    Only on one machine (a local master, as in tests) a temporary one stands in; on a cluster a missing one is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="scriptorium-"))
    return sc.getCheckpointDir()


def removed(spark: SparkSession, path: str) -> None:
    """Takes a folder of intermediate tables away, on any file system that Spark reads."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def unused(columns: list[str], *names: str) -> list[str]:
    """The names, with underscores put before them until none is the name of a column, in any case of letters."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts the lineage by a copy in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` as a table in the shared folder, read again, and the table's path.

    A checkpoint keeps the estimated size of its plan, and a join's estimate is the product of both sides'; over the rounds of
    a loop such numbers get so long that planning takes minutes. A table has the size of its files.
    """
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path
