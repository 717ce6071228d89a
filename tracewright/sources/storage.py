"""Written intermediate tables: they cut the lineage of iterative plans."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def stored(df: DataFrame, label: str) -> DataFrame:
    """df written to the folder that executors share (spark.checkpoint.dir) and read back."""
    spark = df.sparkSession
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = os.path.join(tempfile.gettempdir(), f"tracewright-{os.getpid()}")
        spark.conf.set("spark.checkpoint.dir", where)
    path = f"{where.rstrip('/')}/tracewright/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stored_count(df: DataFrame, label: str) -> tuple[DataFrame, int]:
    """stored(df), and the number of its rows, which the same job counts."""
    seen = Observation()
    out = stored(df.observe(seen, F.count(F.lit(1)).alias("n")), label)
    return out, seen.get["n"]
