"""Session defaults, table access and durable cut points shared by all operators."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Settings this engine relies on; anything a cluster sets itself wins.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def local_session(cores: int | str = 8, partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and the bench."""
    build = SparkSession.builder.master(f"local[{cores}]").appName("brindle").config("spark.driver.memory", memory).config("spark.sql.shuffle.partitions", partitions)
    for key, value in DEFAULTS.items():
        build = build.config(key, value)
    spark = build.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def read(spark: SparkSession, root: str, table: str) -> DataFrame:
    """One of the project's tables. Column pruning and pushdown reach the Parquet scan."""
    return spark.read.parquet(f"{root}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. It comes from spark.checkpoint.dir; only where
    that is unset (a local run) is one made on this machine."""
    sc = spark.sparkContext
    where = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not where:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="brindle-")
        sc.setCheckpointDir(where)
        where = sc.getCheckpointDir()
    return where.rstrip("/")


def settle(df: DataFrame) -> DataFrame:
    """Write df into the shared folder and read it back: lineage ends there, a lost executor
    costs nothing already written, and later readers prune columns."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._settled_at = path  # type: ignore[attr-defined]
    return out


def unsettle(*frames: DataFrame) -> None:
    """Delete what settle() wrote for these frames, once nothing reads them any more."""
    for df in frames:
        path = getattr(df, "_settled_at", None)
        if path is not None:
            jvm, sc = df.sparkSession._jvm, df.sparkSession.sparkContext
            where = jvm.org.apache.hadoop.fs.Path(path)  # type: ignore[union-attr]
            where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)
            df._settled_at = None  # type: ignore[attr-defined]


def spread(df: DataFrame) -> DataFrame:
    """df over enough partitions for work that is heavy per row. A table of few files is dealt out
    again; one with several partitions for each core, as at scale, is left as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= 3 * cores else df.repartition(4 * cores)


def numeric_key(ref: Column) -> Column:
    """The number an id names, as digits without leading zeros ('cluster:7', ' 007', '7.0' are
    all '7'). Null and blank give null; an id without digits stays as its trimmed text."""
    text = F.regexp_replace(ref, r"^[\s ﻿]+|[\s ﻿]+$", "")
    digits = F.regexp_replace(F.regexp_extract(text, r"([0-9]+)", 1), r"^0+(?=[0-9])", "")
    return F.when(F.length(text) == 0, None).when(F.length(digits) > 0, digits).otherwise(F.lower(text))


def data_path(*parts: str) -> str:
    return os.path.join(os.path.dirname(__file__), *parts)
