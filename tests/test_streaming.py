"""A predicate that follows a stream."""

from sparklog import Engine
from sparklog.streaming.refresh import follow


def test_predicate_follows_a_stream(spark, tmp_path):
    source, table, state = (str(tmp_path / x) for x in ("in", "table", "state"))
    spark.createDataFrame([(1, "a")], "n int, s string").write.parquet(source)
    engine = Engine(spark)
    engine.load("seen(S) :- item(_, S).")

    def run():
        stream = spark.readStream.schema("n int, s string").parquet(source)
        query = follow(engine, "item", stream, ["n", "s"], table, state)
        query.awaitTermination()
        engine.catalog.externals[("item", 2)] = engine.catalog.externals[("item", 2)][-1:]
        return {r[0] for r in engine.ask("seen(S)").collect()}

    assert run() == {"a"}
    spark.createDataFrame([(2, "b"), (3, "c")], "n int, s string").write.mode("append").parquet(source)
    assert run() == {"a", "b", "c"}
