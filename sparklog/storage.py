"""Tables in the folder that all executors share, which cut lineage and outlive executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a temporary folder on one machine, and an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="sparklog-")
        spark.conf.set("spark.checkpoint.dir", found)
        atexit.register(shutil.rmtree, found[7:], ignore_errors=True)
    return found.rstrip("/")


class Stored:
    """Rows of one schema in files that can be added to; each addition is a round, and counts its rows while it is written.

    Every few rounds the files of earlier ones are merged, so that what a later round reads stays a bounded number of files
    for each partition, however many rounds there are.
    """

    #: Rounds after which those before the last are merged.
    MERGE = 8

    def __init__(self, spark: SparkSession, schema: StructType) -> None:
        self.spark, self.schema = spark, schema
        self.rounds: list[tuple[str, int]] = []
        #: The table of the first rounds, with their numbers, and how many these are.
        self.merged: tuple[str, int] = ("", 0)

    def _new(self) -> str:
        return f"{shared_folder(self.spark)}/rows-{uuid.uuid4().hex}"

    def add(self, df: DataFrame) -> int:
        path, seen = self._new(), Observation()
        df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(path)
        n = seen.get["n"]
        self.rounds.append((path, n))
        return n

    def skip(self) -> None:
        """A round without rows, of which nothing is written."""
        self.rounds.append(("", 0))

    def compact(self) -> None:
        """Merge all rounds but the last if there are many that aren't merged."""
        upto = len(self.rounds) - 1
        if upto - self.merged[1] < self.MERGE:
            return
        path, old = self._new(), [self.merged[0], *(p for p, _ in self.rounds[self.merged[1] : upto])]
        self._numbered(upto).write.parquet(path)
        self.merged = path, upto
        self._remove(*old)

    def delete(self) -> None:
        """Remove all files; nothing can be read from now on."""
        self._remove(self.merged[0], *(p for p, _ in self.rounds[self.merged[1] :]))
        self.rounds, self.merged = [], ("", 0)

    def _remove(self, *paths: str) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for name in filter(None, paths):
            path = jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(conf).delete(path, True)

    def _read(self, *paths: str) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def all(self) -> DataFrame:
        return self._read(*filter(None, [self.merged[0]]), *(p for p, n in self.rounds[self.merged[1] :] if n))

    def last(self) -> DataFrame:
        path, n = self.rounds[-1]
        return self._read(*[path][: bool(n)])

    def _numbered(self, upto: int) -> DataFrame:
        parts = [self._read(p).withColumn("_round", F.lit(i)) for i, (p, n) in enumerate(self.rounds[:upto]) if n and i >= self.merged[1]]
        if self.merged[0]:
            parts.append(self.spark.read.schema(StructType([*self.schema.fields, StructField("_round", IntegerType())])).parquet(self.merged[0]))
        out = self._read().withColumn("_round", F.lit(0))
        for part in parts:
            out = out.unionByName(part)
        return out

    def by_round(self) -> DataFrame:
        """All rows with the number of their round, from 0."""
        return self._numbered(len(self.rounds))

    def __len__(self) -> int:
        return sum(n for _, n in self.rounds)
