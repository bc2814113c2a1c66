"""What the operators share: the shared folder, written tables, Arrow helpers."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..storage import shared_folder as shared_dir

#: Text of one slice that the vectorised code works on at a time (a longer document is a slice of its own).
SLICE_BYTES = (1 << 20) - 1
#: Rows of an Arrow batch where the session has Spark's default: with whole texts, that one is too large for small executors.
BATCH_ROWS = 2000


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nobody else uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows, from a table in the shared folder: cuts lineage and outlives any executor."""
    path = new_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return _of_folder(df.sparkSession.read.schema(df.schema).parquet(path), path)


def _of_folder(df: DataFrame, path: str) -> DataFrame:
    df._sparklog_folder = path  # type: ignore[attr-defined]
    return df


def drop_written(df: DataFrame) -> None:
    """Remove the files behind a table that ``written`` or ``bucketed`` gave and nothing will read again; others stay."""
    spark, name = df.sparkSession, getattr(df, "_sparklog_folder", None)
    if name:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        if table := _TABLES.pop(name.rsplit("/", 1)[1], None):
            spark.sql(f"DROP TABLE IF EXISTS {table}")


def checked(df: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns, so that others can't clash; a missing one is an error."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"columns {missing} are missing; there are {df.columns}")
    return df.select(*(F.col(f"`{c}`") for c in columns))


def arrow_schema(**fields: pa.DataType) -> pa.Schema:
    return pa.schema(list(fields.items()))


def ddl(schema: pa.Schema) -> str:
    """The Spark schema of an Arrow schema."""
    from pyspark.sql.pandas.types import from_arrow_schema

    return from_arrow_schema(schema)


def small_batches(df: DataFrame) -> DataFrame:
    """The same DataFrame; its session gets batches of few rows if nobody has set their size in it."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if name not in conf.getAll:
        conf.set(name, str(BATCH_ROWS))
    return df


def release() -> None:
    """Give memory that a worker has freed back to the machine: workers outlive tasks, and there are several beside a heap."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


#: What a worker does now, and what it keeps over tasks while it goes on doing that.
_doing = ""
_kept: list[Callable[[], None]] = []


def dropped_by(drop: Callable[[], None]) -> None:
    """Have a worker call this when it turns from one function to another: what one keeps would be a load for the next."""
    _kept.append(drop)


def _turn(to: str) -> None:
    global _doing
    if to != _doing:
        _doing = to
        for drop in _kept:
            drop()
        release()


Batches = Iterator[pa.RecordBatch]


def arrow_map(df: DataFrame, fn: Callable[[Batches], Batches], schema: pa.Schema | StructType) -> DataFrame:
    """mapInArrow; a worker's free memory goes back at the end of each task."""
    name = f"{fn.__module__}.{fn.__qualname__}"

    def run(batches: Batches) -> Batches:
        from sparklog.llm import common  # this function travels by value, the module's state stays in the worker

        common._turn(name)
        yield from fn(batches)
        release()

    return small_batches(df).mapInArrow(run, ddl(schema) if isinstance(schema, pa.Schema) else schema)


def text_slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES, rows: int = 1 << 30) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cut a batch into at most ``rows`` rows with about ``limit`` bytes of text: (rows, bytes, n + 1 offsets). Null text is empty."""
    values = batch.column(batch.schema.get_field_index(column))
    if values.type != pa.large_string():
        values = values.cast(pa.large_string())
    if values.null_count:
        values = values.fill_null("")
    n = len(values)
    if not n:
        return
    _, offsets, data = values.buffers()
    off = np.frombuffer(offsets, np.int64)[values.offset : values.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = min(i + rows, max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1))
        yield batch.slice(i, j - i), raw[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def spread(df: DataFrame) -> int:
    """Partitions for a shuffle whose tasks hold a share of it: the session's setting."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


#: The catalogue's names of bucketed tables, by folder.
_TABLES: dict[str, str] = {}


def bucketed(df: DataFrame, name: str, key: str) -> DataFrame:
    """One row for each key, from a table in the shared folder whose files are buckets of the key: joins on it don't move it again."""
    spark = df.sparkSession
    n, path = spread(df), new_folder(spark, name)
    table = _TABLES[path.rsplit("/", 1)[1]] = path.rsplit("/", 1)[1].replace("-", "_")
    df.repartition(n, key).dropDuplicates([key]).write.bucketBy(n, key).option("path", path).option("compression", "zstd").saveAsTable(table)
    return _of_folder(spark.table(table), path)
