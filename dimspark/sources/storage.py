"""Where intermediate results go: the folder that the cluster shares."""

from __future__ import annotations

import re
import tempfile
from functools import cache

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; a private folder only on a single machine where none is set, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not named and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
    return (named or _private(spark.sparkContext.applicationId)).rstrip("/")


@cache
def _private(application: str) -> str:
    return tempfile.mkdtemp(prefix=f"dimspark-{application}-")
