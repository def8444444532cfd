"""Tables written between the steps of a long plan."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written to the session's ``spark.checkpoint.dir`` and read back: what follows starts from a table, so plans stay small and a lost executor costs its tasks only.

    Where the setting is absent, a local session gets a folder of its own; on a cluster that is an error, as executors could not see it.
    """
    spark = df.sparkSession
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="turnweave-", dir=os.environ.get("TMPDIR") or "/tmp")
        spark.conf.set("spark.checkpoint.dir", at)
    path = f"{at.rstrip('/')}/turnweave/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
