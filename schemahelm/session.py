"""Session helpers: shared scratch space and lineage cuts."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

_CHECKPOINT_CONF = "spark.checkpoint.dir"


def scratch_root(spark: SparkSession) -> str:
    """Shared folder named by ``spark.checkpoint.dir``.

    Where the setting is missing, a session on one machine (master ``local``) gets a temporary folder of its own; on a
    cluster executors could not see such a folder, so that is an error.
    """
    root = spark.conf.get(_CHECKPOINT_CONF, None) or spark.sparkContext.getConf().get(_CHECKPOINT_CONF)
    if not root:
        master = spark.sparkContext.master
        if not re.match(r"local(\[|$)", master):
            raise ValueError(f"{_CHECKPOINT_CONF} names no shared folder for {master}")
        root = tempfile.mkdtemp(prefix="schemahelm-")
        spark.conf.set(_CHECKPOINT_CONF, root)
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    return f"{scratch_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def read_if_there(spark: SparkSession, path: str) -> DataFrame | None:
    """A Parquet table, or None if nothing is at the path; any other error of the read is raised."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def cut_lineage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` once to the shared folder and go on from the files.

    Several branches that read the result then share one computation, and a lost executor costs a re-read
    instead of a recomputation of everything before.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
