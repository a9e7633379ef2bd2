"""Shared pieces: scratch tables in the shared folder, skew-safe joins, reading."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key is heavy if it holds at least 1/HEAVY of the rows, so there are at most HEAVY heavy keys.
HEAVY = 1024
#: Rows that may be broadcast; a row here is two or three longs, so this is about 5 MB.
BROADCAST_ROWS = 200_000
#: Values that attach() broadcasts: so few that joins of any size worth measuring go one way.
ATTACH_ROWS = 20_000
ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_written: list[tuple[SparkSession, str, DataFrame]] = []


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; one of our own only where that is unset and all runs on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="matriq-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: lineage ends there and lost executors lose nothing."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/matriq-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _written.append((spark, path, out))
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of materialize() that nothing reads any more: what was made of them must have been written."""
    for k in range(len(_written) - 1, -1, -1):
        if any(_written[k][2] is t for t in tables):
            _delete(*_written.pop(k)[:2])


def release() -> None:
    """Delete what materialize() has written; results that still read it must be consumed before."""
    while _written:
        _delete(*_written.pop()[:2])


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def small_batches(df: DataFrame, rows: int = 1000) -> DataFrame:
    """df, whose session sends at most `rows` rows a batch to Python from now on: texts may be long, and two tasks share an executor."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(name)) <= rows:
        df.sparkSession.conf.set(name, str(rows))
    return df


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z alone, as the contracts say."""
    return F.translate(c, ASCII_UPPER, ASCII_LOWER)


def small(df: DataFrame, rows: int | None = None) -> bool:
    """True if df has at most `rows` rows (BROADCAST_ROWS if not given); counts no further than that."""
    rows = BROADCAST_ROWS if rows is None else rows
    return df.limit(rows + 1).count() <= rows


def broadcast_if_small(df: DataFrame, rows: int | None = None) -> DataFrame:
    return F.broadcast(df) if small(df, rows) else df


def attach(rows: DataFrame, values: DataFrame, key: str, add: Sequence[str], spread: str, count: str | None = None) -> DataFrame:
    """Left join of rows with values (unique by `key`) that no hot key can stall.

    Small values are broadcast. Beyond that, keys with 1/HEAVY of the rows or more, at most HEAVY of them, are joined by
    broadcast; their rows then leave the shuffled join's hot partition, since their key is replaced by a hash of column
    `spread`. Null keys match nothing and are spread likewise. count: a column of values with the number of rows of each
    key, where that is known. rows should be cheap to read twice; values are a written table.
    """
    if small(values, ATTACH_ROWS):
        return rows.join(F.broadcast(values.select(F.col(key).alias("_hk"), *add)), F.col(key) == F.col("_hk"), "left").select(*rows.columns, *add)
    total = rows.count()
    counts = values.select(key, F.col(count).alias("_n")) if count else rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n"))
    heavy = materialize(counts.where(F.col("_n") * HEAVY >= total).select(key))
    top = values.join(F.broadcast(heavy), key, "left_semi").select(F.col(key).alias("_hk"), *(F.col(c).alias(f"_h_{c}") for c in add))
    out = rows.join(F.broadcast(heavy.select(F.col(key).alias("_heavy"))), F.col(key) == F.col("_heavy"), "left")
    out = out.join(F.broadcast(top), F.col(key) == F.col("_hk"), "left")
    away = F.col("_heavy").isNotNull() | F.col(key).isNull()
    out = out.withColumn("_away", away).withColumn("_jk", F.when(away, F.xxhash64(spread)).otherwise(F.xxhash64(key)))
    rest = values.join(F.broadcast(heavy), key, "left_anti").select(
        F.xxhash64(key).alias("_jk"), F.col(key).alias("_lk"), *(F.col(c).alias(f"_l_{c}") for c in add)
    )
    out = out.join(rest, (out["_jk"] == rest["_jk"]) & (~out["_away"]) & (out[key] == rest["_lk"]), "left")
    return out.select(*(rows[c] for c in rows.columns), *(F.coalesce(f"_h_{c}", f"_l_{c}").alias(c) for c in add))
