"""Sessions that can run the library's Python functions on their executors, and the folder that these share."""

from __future__ import annotations

import os
import re
import shutil
import tempfile

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """The session, after the package was sent to its executors, once for each application.

    Executors import the package to run Python functions; on a cluster it need not be
    installed there.  The archive is made on the driver, whose file server sends it on.
    """
    sc = spark.sparkContext
    if sc.applicationId not in _sent:
        here = os.path.dirname(os.path.abspath(__file__))
        target = os.path.join(tempfile.mkdtemp(prefix="lodestone-"), "lodestone")
        sc.addPyFile(shutil.make_archive(target, "zip", os.path.dirname(here), os.path.basename(here)))
        _sent.add(sc.applicationId)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, for what must outlive an executor.

    It is the one that the session names in spark.checkpoint.dir.  A session that names
    none gets a folder of its own if it runs on one machine, as in tests; on a cluster
    that is an error, as executors would write to the driver's disk by name only.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="lodestone-"))
    return sc.getCheckpointDir()
