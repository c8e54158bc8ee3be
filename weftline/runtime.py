"""Shared scratch space of a Spark session."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a written table that a join broadcasts.
FEW_ROWS = 10_000
#: Tasks for each core that rows are dealt to; not more, as each makes its own model.
TASKS_A_CORE = 3


def scratch_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share; a local session without one gets a temporary folder."""
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not at:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='weftline-')}")
        at = sc.getCheckpointDir()
    return at.rstrip("/")


def materialised(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the scratch folder, cut from its lineage."""
    path = f"{scratch_dir(df.sparkSession)}/weftline-core/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def beside(df: DataFrame) -> DataFrame:
    """df written, to be joined with many rows: up to FEW_ROWS are broadcast, so that those stay where they are; more are joined by sorting, as the size of files says little about what their rows take."""
    done = materialised(df)
    return F.broadcast(done) if done.count() <= FEW_ROWS else done.hint("merge")


def spread(df: DataFrame, by: str = "pos") -> DataFrame:
    """df dealt out anew by a column whose values differ, to TASKS_A_CORE tasks, for steps that cost much a row. A file's row group is read by one task, however many rows it has and however many cores wait."""
    return df.repartition(TASKS_A_CORE * max(1, df.sparkSession.sparkContext.defaultParallelism), by)
