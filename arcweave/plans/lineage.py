"""Cutting lineage in iterative and multi-stage plans.

Tables are written to the folder named by ``spark.checkpoint.dir``, which a
cluster shares between its executors, so that a lost executor costs a re-read
and not a re-run. Only where that setting is absent (tests, local shells) a
temporary folder is used instead.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


#: Where the tables of the open :func:`recorded` blocks go, the innermost last.
_records: list[list[str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables; set for the session if it was unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return str(known.get()).rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="arcweave-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Run ``df`` once, keep its rows as Parquet in the shared folder, read them back."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/arcweave/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    for record in _records:
        record.append(path)
    return spark.read.schema(df.schema).parquet(path)


def partitioned(df: DataFrame, key: str) -> DataFrame:
    """``df`` dealt out by a key and kept on the executors, so that joins on the key in a loop move it once.

    Lost partitions are made again from the tables behind ``df``. The caller
    unpersists it when the loop ends.
    """
    return df.repartition(key).persist()


@contextmanager
def recorded() -> Iterator[list[str]]:
    """Lists the folders of the tables made by :func:`materialize` inside the block."""
    made: list[str] = []
    _records.append(made)
    try:
        yield made
    finally:
        _records.remove(made)


def drop_folders(spark: SparkSession, folders: Iterable[str], unless: DataFrame | None = None) -> None:
    """Deletes tables by their folders, but for those that ``unless`` still reads."""
    used = {file.rsplit("/", 1)[0].split("/arcweave/")[-1] for file in unless.inputFiles()} if unless is not None else set()
    for folder in folders:
        if folder.split("/arcweave/")[-1] not in used:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def drop_materialized(df: DataFrame) -> None:
    """Delete the files behind a table made by :func:`materialize`; it can't be read afterwards."""
    drop_folders(df.sparkSession, {file.rsplit("/", 1)[0] for file in df.inputFiles()[:1] if "/arcweave/" in file})
