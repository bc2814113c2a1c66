"""The pipeline against a plain version of its stages, and the registered queries."""

import zlib
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from sparklog.llm import language, queries
from sparklog.llm.common import written
from tests.llm import brute

TABLES = "documents pages benchmark labels conversations".split()


def test_stages(spark, tiny):
    """Each stage on what the one before it kept; the language stage's model is the operator's own."""
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    state = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert len(corpus_pipeline.STAGES) == 5
    for name, stage in corpus_pipeline.STAGES:
        columns = docs.columns
        source = docs
        docs = written(stage(spark, docs, tiny), name)
        rows = docs.collect()
        if name == "language_id":
            found = language.predict(source, language.fit(source)).collect()
            state = {i: state[i] for i in (r["doc_id"] for r in found if r["lang_pred"] != "und" and r["score"] >= language.LEAST)}
        elif name == "near_dedup":
            state = {i: state[i] for i, (_, c) in brute.components(sorted(state.items()), 5).items() if i == c}
        elif name == "substring_dedup":
            state = {i: kept if gone else state[i] for i, (_, gone, kept) in brute.kept(state.items()).items()}
        elif name == "decontamination":
            items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{tiny}/benchmark.parquet").collect()]
            state = {i: state[i] for i, (n, hit, _) in brute.decontaminated(state.items(), items).items() if not (hit and 20 * hit >= n)}
        else:
            ids_of, by = brute.tokenizer("word_bpe_49k.json"), defaultdict(list)
            for r in rows:
                by[r["doc_id"]].append(r)
            assert by.keys() == state.keys()
            for i, t in state.items():
                joined = b"".join(bytes(r["ids"]) for r in sorted(by[i], key=lambda r: r["start"]))
                assert zlib.crc32(joined) == brute.crc([*ids_of(t), 2])
            continue
        assert docs.columns == columns
        assert {r["doc_id"]: r["text"] for r in rows} == state, name


def test_stages_of_odd_tables(spark, tiny, tmp_path):
    """Null and repeated ids, null, empty and long texts, columns that clash, and no rows at all, through every stage."""
    extra = [(None, "the cat and the dog " * 20, "en", "h", 1, 1), (None, None, None, None, None, 2), (3, "", None, "h", 0, 3), (3, "12 34", "en", "h", 5, 4)]
    extra += [(10**6, "the of and in " * 30_000, "en", "h", 7, 5), (10**6, "the of and in " * 30_000, "en", "h", 7, 6), (10**6, "un mot et la suite " * 9, "fr", "h", 7, 7)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, row long"
    docs = spark.read.parquet(f"{tiny}/documents.parquet").limit(60)
    docs = docs.withColumn("row", F.lit(0).cast("long")).select(*(F.col(x.split()[0]).cast(x.split()[1]) for x in schema.split(", "))).unionByName(spark.createDataFrame(extra, schema))
    for df in (docs, docs.limit(0)):
        now = written(df, "odd")
        for name, stage in corpus_pipeline.STAGES:
            before = now
            now = written(stage(spark, now, tiny), name)
            if name == "language_id":  # what has no letters goes
                rows = {r["row"] for r in now.collect()}
                assert not rows & {2, 3, 4} and (df is not docs or {1, 5, 6, 7} <= rows)
            elif name == "near_dedup":  # rows of the kept document stay as they are, and rows without an id
                rows = {r["row"] for r in now.collect()}
                assert df is not docs or {1, 5, 6, 7} <= rows
            if name != "packing":
                assert now.schema == df.schema and now.count() <= before.count()
        if df is docs:
            assert now.where("doc_id is null").count() >= 1 and now.agg(F.sum("length")).first()[0] > 60_000
        else:
            assert now.count() == 0


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, tiny, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tiny}/{t}.parquet'")
    expected = con.sql(queries.oracle_sql()[name])
    df = queries.queries()[name](spark, tiny)
    columns = sorted(expected.columns)
    assert sorted(df.columns) == columns
    places = [expected.columns.index(c) for c in columns]
    assert sorted(tuple(r[c] for c in columns) for r in df.collect()) == sorted(tuple(r[i] for i in places) for r in expected.fetchall())


def test_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
