"""Listings that keep arriving: each batch of new files is parsed and appended once."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from callweave.runtime import after_counts, cut
from callweave.sources import lines as L
from callweave.store import Store


def follow(spark: SparkSession, folder: str, store: Store, what: str, checkpoint: str, mode: str = "compat", once: bool = True) -> StreamingQuery:
    """Appends new files of a folder to symbol, def or calls; rejected lines are left out.

    Rows are numbered on from the highest stored ord. A batch is a part of the store named by the
    stream's checkpoint folder and the batch number, so one that is run again after a failure replaces
    itself. With once, what is there now is read and the stream ends; else it goes on.
    """
    own = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]
    source = spark.readStream.option("lineSep", "\n").text(folder)
    load = lambda batch, number: append_batch(store, what, batch, number, own, mode)
    out = source.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if once else out).start()


def append_batch(store: Store, what: str, batch: DataFrame, number: int, stream: str, mode: str = "compat") -> None:
    """One batch (value) of a stream, under its number."""
    kept = cut(batch.select(F.col("value").alias("raw"))).withColumn("_id", F.monotonically_increasing_id())
    lines = after_counts(kept, store.next_ord(what))
    rows = L.import_calls(lines, mode) if what == "calls" else {"symbol": L.import_symbols, "def": L.import_defs}[what](lines)
    store.append(what, rows, part=f"s-{stream}-{number}")
