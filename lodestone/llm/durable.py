"""Lineage cuts that survive the loss of executors."""

from __future__ import annotations

import threading
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from ..session import shared_folder

_lock, _inside, _before = threading.Lock(), Counter(), {}


@contextmanager
def _freeing(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what runs inside go as soon as it is done: the table that it
    makes is in the checkpoint folder then, and nothing goes back before that.  Of
    threads that share a session the last one out puts the setting back."""
    name, session = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", id(spark)
    with _lock:
        if not _inside[session]:
            _before[session] = spark.conf.get(name)
            spark.conf.set(name, "true")
        _inside[session] += 1
    try:
        yield
    finally:
        with _lock:
            _inside[session] -= 1
            if not _inside[session]:
                spark.conf.set(name, _before.pop(session))


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` computed and written to the checkpoint folder, which all executors share."""
    shared_folder(df.sparkSession)
    with _freeing(df.sparkSession):
        return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet in the checkpoint folder, and read again; for whole tables."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    with _freeing(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes the table that ``written`` returned."""
    spark = df.sparkSession
    root = spark._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/table-" in folder:
            fs.delete(spark._jvm.org.apache.hadoop.fs.Path(folder), True)


def fresh(taken: Iterable[str], *wanted: str) -> list[str]:
    """The wanted names, changed where a table has them already."""
    clash = {c.lower() for c in taken}
    return [next(x for k in range(len(clash) + 1) if (x := w + "_" * k).lower() not in clash) for w in wanted]
