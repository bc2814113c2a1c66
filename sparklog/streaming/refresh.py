"""A stream as a source: each micro-batch is added to a table, and what depended on it is forgotten.

Queries see whole batches only. A batch that runs again after a failure replaces its own rows, as its number names its part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..engine import Engine


def follow(engine: Engine, name: str, stream: DataFrame, columns: list[str], path: str, checkpoint: str, once: bool = True, **options) -> StreamingQuery:
    """Start to keep the predicate ``name`` at the rows that a streaming DataFrame has given so far.

    path and checkpoint are folders that all executors share. once: take what is there and stop, else go on.
    """
    spark, schema = engine.spark, stream.select(*columns).schema
    engine.register(name, lambda: spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(path), columns, **options)
    spark.createDataFrame([], schema).write.mode("append").parquet(path)

    def add(batch: DataFrame, number: int) -> None:
        batch.select(*columns).write.mode("overwrite").parquet(f"{path}/batch={number}")
        engine.invalidate([(name, len(columns))])

    writer = stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
