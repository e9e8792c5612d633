"""The three relations as Parquet tables in one folder.

A table is a folder of versions, each a folder of parts. An append adds a part. Deletes, clearing and
compaction write a new version and then name it in a new pointer file, which is written aside and
renamed, so that readers never meet a half-written pointer; the pointer with the highest number
counts. The version before stays until the next change, for readers that are still at it. All file
work goes through Hadoop's file system interface and so to any storage Spark can reach.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from callweave.functions.text import megabytes
from callweave.operators.relations import statistics
from callweave.schemas import RELATIONS

WARN_MB = 50


class Store:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._io = jvm.org.apache.commons.io.IOUtils
        self._utf8 = jvm.java.nio.charset.StandardCharsets.UTF_8

    def attach(self, max_mb: int = WARN_MB, silent: bool = True, check_size: bool = True) -> dict[str, int]:
        """Makes the tables that are missing and gives all row counts; tells if they are above max_mb."""
        for name in RELATIONS:
            self._made(name)
        if check_size and not silent and (mb := self.size_mb()) > max_mb:
            print(f"Warning: {self.folder} holds {mb} MB, more than {max_mb}")
        return {r["relation"]: r["n_rows"] for r in self.statistics().collect()}

    def size_mb(self) -> float:
        """Megabytes of all files of the store."""
        size = self._fs.getContentSummary(self._path(self.folder)).getLength()
        return self.spark.range(1).select(megabytes(F.lit(size))).first()[0]

    def table(self, name: str) -> DataFrame:
        """The current rows of symbol, def or calls."""
        version = self._version(name)
        if version is None:
            return self.spark.createDataFrame([], RELATIONS[name])
        return self.spark.read.schema(RELATIONS[name]).option("recursiveFileLookup", "true").parquet(f"{self.folder}/{name}/{version}")

    def next_ord(self, name: str) -> int:
        """One more than the highest stored ord, 0 for an empty table."""
        top = self.table(name).agg(F.max("ord")).first()[0]
        return 0 if top is None else top + 1

    def append(self, name: str, rows: DataFrame, part: str | None = None) -> None:
        """Adds rows; nothing is deduplicated. Missing columns become null, others are left out.

        With the name of a part, appending it again replaces it, and once it is noted as done, does nothing.
        """
        done = self._path(f"{self.folder}/{name}/_done/{part}") if part else None
        if done and self._fs.exists(done):
            return
        to = f"{self.folder}/{name}/{self._made(name)}/{part or 'a-' + uuid.uuid4().hex}"
        self._fitted(name, rows).write.mode("overwrite").parquet(to)
        if done:
            self._fs.create(done, True).close()

    def retract_all(self, name: str, condition: Column | None = None, **values) -> None:
        """Deletes the rows that meet the condition and equal all given values; nulls never match."""
        match = F.lit(True) if condition is None else condition
        for column, v in values.items():
            match = match & (F.col(column) == F.lit(v))
        self._swap(name, self.table(name).where(~F.coalesce(match, F.lit(False))))

    def statistics(self) -> DataFrame:
        return statistics(**{n: self.table(n) for n in RELATIONS})

    def clear(self) -> None:
        for name in RELATIONS:
            self._swap(name, self.spark.createDataFrame([], RELATIONS[name]))

    def compact(self, file_mb: int = 256) -> None:
        """Rewrites each table in files of about the given size; repeated rows stay."""
        for name in RELATIONS:
            version = self._made(name)
            size = self._fs.getContentSummary(self._path(f"{self.folder}/{name}/{version}")).getLength()
            rows = self.table(name)
            self._swap(name, rows.coalesce(max(1, min(rows.rdd.getNumPartitions() or 1, int(size // (file_mb << 20)) + 1))))

    def create_views(self) -> None:
        """Temporary views symbol, def and calls for SQL."""
        for name in RELATIONS:
            self.table(name).createOrReplaceTempView(name)

    def _fitted(self, name: str, rows: DataFrame) -> DataFrame:
        have = set(rows.columns)
        return rows.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in RELATIONS[name]])

    def _pointers(self, name: str) -> list[tuple[int, object]]:
        """(number, path) of all pointer files, the highest number last."""
        at = self._path(f"{self.folder}/{name}")
        if not self._fs.exists(at):
            return []
        found = [s.getPath() for s in self._fs.listStatus(at)]
        return sorted(((int(m[1]), p) for p in found if (m := re.fullmatch(r"_current-(\d+)", p.getName()))), key=lambda x: x[0])

    def _read(self, pointer) -> str:
        stream = self._fs.open(pointer)
        try:
            return self._io.toString(stream, self._utf8)
        finally:
            stream.close()

    def _version(self, name: str) -> str | None:
        pointers = self._pointers(name)
        return self._read(pointers[-1][1]) if pointers else None

    def _made(self, name: str) -> str:
        if self._version(name) is None:
            self._swap(name, self.spark.createDataFrame([], RELATIONS[name]))
        return self._version(name)

    def _swap(self, name: str, rows: DataFrame) -> None:
        pointers, new = self._pointers(name), f"v-{uuid.uuid4().hex}"
        home = f"{self.folder}/{name}"
        self._fitted(name, rows).write.parquet(f"{home}/{new}/base")
        aside, named = self._path(f"{home}/_aside-{new}"), self._path(f"{home}/_current-{(pointers[-1][0] if pointers else 0) + 1}")
        out = self._fs.create(aside, True)
        try:
            self._io.write(new, out, self._utf8)
        finally:
            out.close()
        if self._fs.exists(named) or not self._fs.rename(aside, named):
            raise RuntimeError(f"{home} was changed by someone else")
        for _, old in pointers[:-1]:
            self._fs.delete(self._path(f"{home}/{self._read(old)}"), True)
            self._fs.delete(old, False)
