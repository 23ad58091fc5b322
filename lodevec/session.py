"""Helpers around the session: checkpoints, table paths, sizes."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a side that may be broadcast; beyond it operators take their shuffled way.
BROADCAST_LIMIT = 64 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster. Where none is set one is made on a single machine (tests); on a cluster that
    raises ValueError, as executors would each write to a folder of their own."""
    jsc = spark.sparkContext._jsc.sc()
    found = jsc.getCheckpointDir()
    if found.isDefined():
        return found.get()
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path is None:
        master = spark.sparkContext.master
        if not re.match(r"local(\[|$)", master):
            raise ValueError(f"spark.checkpoint.dir is not set; on {master} it must name a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="lodevec-")
    spark.sparkContext.setCheckpointDir(path)
    return jsc.getCheckpointDir().get()


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, read back: lineage is cut, and a lost executor loses nothing."""
    path = os.path.join(checkpoint_dir(df.sparkSession), f"{name}-{uuid.uuid4().hex}.parquet")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, row_bytes: int = 64) -> DataFrame:
    """df to be broadcast where its rows, of about row_bytes each, are below the limit; as it is otherwise, so that the
    join shuffles. df is counted: it should be a written table or as cheap as one."""
    return F.broadcast(df) if df.count() * row_bytes < BROADCAST_LIMIT else df
