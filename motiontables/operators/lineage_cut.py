"""Materialise an intermediate that several branches or rounds read again."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the folder the cluster names in ``spark.checkpoint.dir``.

    The files survive lost executors, and the result keeps its partitioning. Only where
    the setting is absent and driver and executors share one machine (a local master, as in
    tests) a fresh folder is made; a cluster without the setting is an error.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if folder and (current is None or not current.startswith(folder.rstrip("/"))):
        # The context reports a sub-folder of what was set; compare loosely.
        if current is None or folder.rstrip("/").split("://")[-1] not in current:
            sc.setCheckpointDir(folder)
    elif not folder and current is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return df.checkpoint(eager=True)
