"""Tables written to the shared folder between steps, so that what follows starts from a scan.

Such files compress well, so millions of rows may look small enough to broadcast, and wouldn't fit the driver. Joins
that start from them are by sort and merge.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def root_of(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where that is unset, one machine's own folder will do."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        root = "file://" + tempfile.gettempdir() + "/lectern-shared"
    return root.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as written to the shared folder and read back; the next join of what comes of it broadcasts neither side."""
    path = f"{root_of(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).hint("merge")
