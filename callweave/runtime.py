"""Session helpers: where lineage is cut, how tables are read, how sizes are checked."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Makes checkpoint() usable without overriding what the cluster names.

    The folder named in spark.checkpoint.dir is taken as it is. Only a single-JVM session that names
    none gets a temporary folder; on a cluster a missing setting is an error, since a folder of one
    machine would be lost with it.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if named:
        sc.setCheckpointDir(named)
    elif sc.master.startswith("local[") or sc.master == "local":
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="callweave-"))
    else:
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")


def cut(df: DataFrame) -> DataFrame:
    """The same rows with their lineage cut, kept in the shared checkpoint folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_counting(df: DataFrame, **measures: Column) -> tuple[DataFrame, dict]:
    """Like cut, with aggregates of the rows that are taken while they are written."""
    seen = Observation()
    kept = cut(df.observe(seen, *[c.alias(n) for n, c in measures.items()]))
    return kept, seen.get


def numbered(rows: DataFrame, *order: str, first: int = 0) -> DataFrame:
    """The rows with a dense, unique ord that follows the order, from first on.

    The rows are sorted over ranges; each range begins where the counts of those before end, so only a
    row for each range meets in one place. Rows that tie are numbered in any order.
    """
    kept = cut(rows.orderBy(*order)).withColumn("_id", F.monotonically_increasing_id())
    return after_counts(kept, first)


def after_counts(rows: DataFrame, first: int = 0, by: tuple[str, ...] = ()) -> DataFrame:
    """ord from _id, which rises within a task: the counts of all earlier blocks, and the place in the block.

    Blocks are tasks, or what the columns by tell apart, in their order.
    """
    rows = rows if by else rows.withColumn("_block", F.shiftright("_id", 33))
    by = by or ("_block",)
    blocks = rows.groupBy(*by).agg(F.min("_id").alias("_least"), F.count(F.lit(1)).alias("_n"))
    starts = blocks.withColumn("_start", F.sum("_n").over(Window.orderBy(*by)) - F.col("_n") + F.lit(first)).select(
        *[F.col(b).alias(f"_b{i}") for i, b in enumerate(by)], "_start", "_least"
    )
    met = F.lit(True)
    for i, b in enumerate(by):
        met = met & (F.col(b) == F.col(f"_b{i}"))
    placed = rows.join(F.broadcast(starts), met)  # a row for each block of a file or task, never for a row
    return placed.select((F.col("_start") + F.col("_id") - F.col("_least")).alias("ord"), *[c for c in rows.columns if c not in ("_id", "ord", *by)])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
