"""Tables of outputs that are updated in place: staged, then swapped by partition."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a key lie in one of so many partitions of the table, by a hash.
PARTS = 64


def parted(rows: DataFrame, key: str, parts: int = PARTS) -> DataFrame:
    return rows.withColumn("part", F.pmod(F.xxhash64(key), F.lit(parts)).cast("int"))


def read_outputs(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table at `path`; empty where nothing was written."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], f"{schema}, part int")
    return spark.read.schema(f"{schema}, part int").parquet(path)


def staged(updates: DataFrame, path: str, key: str, parts: int = PARTS) -> str:
    """Write, beside the table, the partitions that updates touch, with updated rows in place of those of their key, and return
    where. The table is only read; of updates with one key, the one with the greatest content counts."""
    spark, columns = updates.sparkSession, updates.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in updates.schema)
    value = F.struct(*columns)
    new = parted(updates.groupBy(key).agg(F.max(value).alias("_x")).select("_x.*"), key, parts)
    touched = F.broadcast(new.select("part").distinct())  # at most `parts` rows
    old = read_outputs(spark, path, schema).join(touched, "part", "left_semi").join(new.select(key), key, "left_anti")
    aside = f"{path.rstrip('/')}-stage-{uuid.uuid4().hex}"
    new.unionByName(old.select(*columns, "part")).repartition("part").write.partitionBy("part").parquet(aside)
    return aside


def swapped(spark: SparkSession, aside: str, path: str, schema: str) -> None:
    """Put staged partitions in the place of the table's, and leave the others. Each partition is replaced by a rename; if the
    job is cut off, running upsert() again gives the same table."""
    rows = spark.read.schema(f"{schema}, part int").parquet(aside)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(aside)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def upsert(updates: DataFrame, path: str, key: str, parts: int = PARTS) -> None:
    """Replace or add rows of the table at `path` by key. What was staged before a failure is not read again."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in updates.schema)
    swapped(updates.sparkSession, staged(updates, path, key, parts), path, schema)
