"""Cutting a plan's lineage by a table in the folder that the session names for checkpoints."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """df, computed and written once as Parquet. A local session without a folder takes a temporary one; on a cluster that is an error.

    A table, not a checkpoint of rows: what the optimizer has inferred of a checkpoint goes on growing in a loop.
    """
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(f"file://{tempfile.mkdtemp()}")
    path = f"{sc.getCheckpointDir()}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._cut = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables of cut() that nothing reads any more; others are left alone."""
    for df in tables:
        path = getattr(df, "_cut", None)
        if path:
            where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)
            del df._cut
