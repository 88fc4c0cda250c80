"""What the corpus operators share: column selection, materialisation, checked broadcasts."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most bytes of a table that is sent to every executor; beyond it the same join shuffles.
BROADCAST_BYTES = 16 << 20


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Just these columns, matched exactly; of columns named alike the first, whatever else there is."""
    have = df.columns
    if missing := [n for n in names if n not in have]:
        raise ValueError(f"no column {missing[0]!r} among {have}")
    return df.toDF(*[f"_{i}" for i in range(len(have))]).select(*[F.col(f"_{have.index(n)}").alias(n) for n in names])


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. Only a local session without one gets a temporary folder."""
    have = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not have:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir is not set")
        have = "file://" + tempfile.mkdtemp(prefix="threadloom-")
        spark.sparkContext.setCheckpointDir(have)
    elif not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(have)
    return have


def cut(df: DataFrame) -> DataFrame:
    """The computed rows, kept in the shared folder: lost executors don't bring the work back."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def small_or_hashed(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """A computed (cut) table, hinted for a join: broadcast up to the limit, else the build side of a shuffled hash join."""
    return F.broadcast(df) if df.count() * row_bytes <= limit else df.hint("shuffle_hash")


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
