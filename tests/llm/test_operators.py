"""Each operator on tables with nulls, empty and long texts, ties, repeated rows, clashing columns, and none at all."""

import hashlib
import itertools
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparklog.llm import chat, decontaminate, html, language, media, neardup, pack, quality, records, substring
from sparklog.llm.bloom import Bloom
from sparklog.llm.graph import components, joined
from tests.llm import brute

RNG = random.Random(5)
VOCAB = ["".join(RNG.choices("abcdefgh", k=RNG.randrange(1, 6))) for _ in range(400)]


def text(n, seed):
    return " ".join(random.Random(seed).choices(VOCAB, k=n))


def changed(base, n, seed):
    """The text with n words replaced."""
    rng, w = random.Random(seed), base.split(" ")
    for i in rng.sample(range(len(w)), n):
        w[i] = "changed" + str(rng.randrange(10**6))
    return " ".join(w)


PASSAGE, ITEM = text(60, 900), text(20, 901)
BASE = text(200, 1)
DOCS = (
    [(1, BASE), (2, BASE), (3, changed(BASE, 3, 7)), (4, changed(BASE, 9, 8)), (5, changed(BASE, 40, 9))]
    + [(10 + i, f"{text(30, i)} {PASSAGE}\n{text(25, 50 + i)}") for i in range(6)]
    + [(20 + i, f"{text(5 + 40 * i, 70 + i)} {ITEM.upper()}, {text(12, 80 + i)}") for i in range(4)]
    + [(30, None), (31, ""), (32, " \n\t "), (33, "one"), (34, "one"), (35, "One  two"), (36, "é ü 中文 !"), (37, text(30_000, 3)), (38, PASSAGE), (39, f"{PASSAGE} {PASSAGE}"), (40, "x " * 300), (41, "x " * 300 + "y")]
    + [(50 + i, changed(BASE, 12, 100 + i)) for i in range(12)]
)
ITEMS = [(1, ITEM), (2, "one two"), (3, None), (4, ""), (5, ITEM + " more"), (6, text(40, 902)), (7, "...")]


@pytest.fixture(scope="module")
def docs(spark):
    """The documents with columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "h", 7, "n") for i, t in DOCS], "doc_id long, text string, h string, row int, node string").repartition(5)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


def by_id(df):
    rows = df.collect()
    assert len(rows) == len({r["doc_id"] for r in rows})
    return {r["doc_id"]: r for r in rows}


def odd(spark, more=""):
    """Rows that repeat, and rows without an id."""
    rows = [(1, "a b c d e"), (1, "a b c d e"), (None, "a b c d e"), (None, None), (2, None), (2, "z")]
    return spark.createDataFrame(rows, "doc_id long, text string")


def path(name):
    import public_tokenizers

    return public_tokenizers.path(name)


def test_records(spark, docs, nothing):
    got, ids_of, at = by_id(records.op1(docs, path("byte_bpe_50k.json"))), brute.tokenizer("byte_bpe_50k.json"), 0
    for i, t in sorted(DOCS):
        ids = [*ids_of(t), 2]
        r = got[i]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), brute.crc(ids))
        at += len(ids)
    assert records.op1(nothing, path("byte_bpe_50k.json")).count() == 0
    assert records.op1(odd(spark), path("byte_bpe_50k.json")).count() == 6


def test_records_in_any_order_and_broken_files(spark, docs):
    shards = records.write_records(docs, path("byte_bpe_50k.json"), 2)
    rows = [r.asDict() for r in shards.collect()]
    places = [(s, k) for s in rows for k in range(s["n_docs"])]
    random.Random(1).shuffle(places)
    ids_of, texts = brute.tokenizer("byte_bpe_50k.json"), dict(DOCS)
    for s, k in places:
        doc, ids = records.read_record(s, k)
        assert ids.tolist() == [*ids_of(texts[doc]), 2]
    name = rows[0]["path"].replace("file://", "") + ".rec"
    data = bytearray(open(name, "rb").read())
    data[14] ^= 255
    open(name, "wb").write(data)
    with pytest.raises(Exception, match="checksum"):
        records.read_records(shards).count()


def test_records_of_failed_attempts_do_not_count(docs, tmp_path):
    """An attempt that is lost at any point, and one that runs besides, leave files that no returned row names."""
    from sparklog.llm.common import arrow_map

    folder = f"file://{tmp_path}/out"
    (tmp_path / "out").mkdir()
    lost = arrow_map(docs.select("doc_id", "text").limit(5).coalesce(1), records._writer(folder, path("byte_bpe_50k.json"), 2), records.SHARDS)
    lost.collect()
    (tmp_path / "out" / "000000-half.rec").write_bytes(b"torn")
    shards = records.write_records(docs, path("byte_bpe_50k.json"), 2, folder)
    names = {r["path"].rsplit("/", 1)[1] for r in shards.collect()}
    assert {f.name for f in (tmp_path / "out").iterdir() if not f.name.startswith(".")} == {f"{n}.{kind}" for n in names for kind in ("rec", "idx")}
    assert sorted(r["doc_id"] for r in records.read_records(shards).collect()) == sorted(i for i, _ in DOCS)


def test_records_of_one_doc_id_lie_in_several_shards(spark):
    rows = [(None, text(20, i)) for i in range(400)] + [(7, text(20, 1000 + i)) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    shards = records.write_records(df, path("byte_bpe_50k.json"), 2).collect()
    assert len(shards) == 4 and max(r["n_docs"] for r in shards) < 400
    got = records.op1(df, path("byte_bpe_50k.json")).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None] * 400 + [7] * 400 and [r["start"] for r in got] == [0, *itertools.accumulate(r["n_tokens"] for r in got)][:-1]


def test_packing(spark, docs, nothing):
    rows, ids_of = pack.op3(docs, path("word_bpe_49k.json")).collect(), brute.tokenizer("word_bpe_49k.json")
    by, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert by.keys() == dict(DOCS).keys()
    for i, t in DOCS:
        ids, at = [*ids_of(t), 2], 0
        for r in sorted(by[i], key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"], r["ids_crc32"]) == (at, len(ids), brute.crc(ids[at : at + r["length"]]))
            at += r["length"]
        assert at == len(ids)
    sizes = []
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        sizes.append(at)
    assert sum(s != 4096 for s in sizes) <= 1 and max(sizes) <= 4096
    assert pack.op3(nothing, path("word_bpe_49k.json")).count() == 0
    assert pack.packed(odd(spark), path("word_bpe_49k.json")).count() == 6


def test_packing_keeps_relatives_together(spark):
    groups = [(100 * g + k, changed(text(150, 1000 + g), 2, k)) for g in range(8) for k in range(3)]
    random.Random(2).shuffle(groups)
    df = spark.createDataFrame(groups, "doc_id long, text string")
    rows = pack.packed(df, path("word_bpe_49k.json"), length=256, most=20).orderBy("sequence_id", "offset").collect()
    order = list(dict.fromkeys(r["doc_id"] // 100 for r in rows))
    changes = sum(a["doc_id"] // 100 != b["doc_id"] // 100 for a, b in itertools.pairwise(rows))
    assert len(order) == 8 and changes <= 14
    r = pack.padding(pack.packed(df, path("word_bpe_49k.json")), 4096).first()
    assert r["padding"] < 4096


def test_packing_links_across_blocks(spark):
    """Relatives that share few bins lie side by side, however few documents a task's walk holds."""
    rows = [(10 * g + k, changed(text(60, 3000 + g), 9 * k, 10 * g + k)) for g in range(120) for k in range(2)]
    random.Random(3).shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    apart = {}
    for block in (1000, 4):
        pieces = pack.packed(df, path("word_bpe_49k.json"), length=256, most=4 * block).orderBy("sequence_id", "offset").collect()
        line = list(dict.fromkeys(r["doc_id"] for r in pieces))
        assert sorted(line) == sorted(i for i, _ in rows)
        apart[block] = sum(abs(line.index(10 * g) - line.index(10 * g + 1)) > 1 for g in range(120))
    assert apart[4] <= apart[1000] + 6, apart


def test_near_duplicates(spark, docs, nothing):
    got = by_id(neardup.op4(docs))
    for i, (n, c) in brute.components(DOCS).items():
        assert (got[i]["n_shingles"], got[i]["component_id"], got[i]["kept"]) == (n, c, i == c), i
    assert neardup.op4(nothing).count() == 0
    rows = neardup.op4(odd(spark)).collect()
    assert len(rows) == 6 and all(r["kept"] for r in rows) and {r["component_id"] for r in rows} == {1, 2, None}


def test_near_duplicates_of_each_text_of_a_document(spark):
    one, two, three = text(120, 11), text(120, 12), text(120, 13)
    rows = [(1, one), (1, two), (1, ""), (5, changed(one, 2, 1)), (6, changed(two, 2, 2)), (7, two), (8, three), (9, three), (9, changed(one, 3, 4)), (20, ""), (None, one)]
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        got = neardup.op4(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
        assert len(got) == len(rows)
        assert {(r["doc_id"], r["component_id"], r["kept"]) for r in got} == {(i, 1, i == 1) for i in (1, 5, 6, 7, 8, 9)} | {(20, 20, True), (None, None, True)}


def test_many_near_duplicates_of_one(spark):
    """A hot group whose members are often below the threshold to one another, and one that shares a passage only."""
    base, shared = text(120, 5), text(80, 6)
    rows = [(i, base if i == 77 else changed(base, 1 + i % 4, i)) for i in range(150)] + [(1000 + i, f"{shared} {text(30, 2000 + i)}") for i in range(150)]
    got = by_id(neardup.op4(spark.createDataFrame(rows, "doc_id long, text string")))
    for i, (n, c) in brute.components(rows).items():
        assert (got[i]["n_shingles"], got[i]["component_id"]) == (n, c), i


def test_labels_after_more_links(spark):
    """Links that come later give the components of all links, whatever nodes they touch."""
    rng = random.Random(4)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100, 101), (102, 101), (7, 7)]
    label = {x: x for pair in links for x in pair}
    for _ in label:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    parts = [links[i::3] for i in range(3)]
    labels = components(spark.createDataFrame(parts[0], "a long, b long"))
    for part in parts[1:]:
        labels = joined(labels, spark.createDataFrame(part, "a long, b long"))
    got = {r["node"]: r["label"] for r in labels.collect()}
    assert {x: got.get(x, x) for x in label} == label and len(got) == labels.count()


def test_near_dedup_keeps_one_of_each(spark, docs):
    out = neardup.one_of_each(docs, 4)
    assert out.columns == docs.columns
    label = brute.components(DOCS)
    assert sorted(r["doc_id"] for r in out.collect()) == sorted(i for i, (_, c) in label.items() if i == c)


def test_filter_has_no_false_negatives(spark):
    keys = spark.range(0, 50_000, 7).toDF("k")
    b = Bloom(keys, keys.count())
    have = np.arange(0, 50_000, 7)
    assert b.may_have(have).all()
    assert b.may_have(np.arange(10**6, 10**6 + 20_000)).mean() < 0.01


def test_sets_are_found_by_the_join_too(spark, docs, monkeypatch):
    from sparklog.llm import bloom

    expected = sorted(map(tuple, neardup.op4(docs).collect()))
    monkeypatch.setattr(bloom, "MOST", -1)
    assert sorted(map(tuple, neardup.op4(docs).collect())) == expected


def test_language(spark, nothing, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    rows = language.op5(docs).collect()
    lang = {r["doc_id"]: r["lang"] for r in docs.collect()}
    held = [r for r in rows if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i in lang if zlib.crc32(str(i).encode()) % 5 == 0}
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 for r in rows)
    extra = [(10**6, None, "en"), (10**6 + 1, "", "en"), (10**6 + 2, "12 $", None), (None, "the and", "en"), (10**6 + 3, "the and", None)]
    more = docs.select("doc_id", "text", "lang").union(spark.createDataFrame(extra, "doc_id long, text string, lang string"))
    got = {r["doc_id"]: r for r in language.op5(more).collect()}
    assert [got[10**6 + k]["lang_pred"] for k in range(3)] == ["und"] * 3 and got[None]["held_out"]
    assert language.op5(nothing).count() == 0
    assert {r["lang_pred"] for r in language.op5(odd(spark).withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    kept = language.known_language(more)
    assert kept.columns == more.columns and not {r["doc_id"] for r in kept.collect()} & {10**6, 10**6 + 1, 10**6 + 2}
    assert kept.where("doc_id < 1000000").count() >= 0.97 * docs.count()
    unlabelled = language.known_language(more.withColumn("lang", F.lit(None).cast("string")))
    assert sorted(str(r["doc_id"]) for r in unlabelled.collect()) == sorted(str(r["doc_id"]) for r in more.collect() if language.has_letter(np.frombuffer((r["text"] or "").encode(), np.uint8)))


def test_substrings(spark, docs, nothing):
    got = by_id(substring.op6(docs))
    for i, (n, gone, kept) in brute.kept(DOCS).items():
        assert (got[i]["n_words"], got[i]["n_removed"], got[i]["kept_sha256"]) == (n, gone, brute.sha(kept)), i
    assert substring.op6(nothing).count() == 0
    rows = substring.op6(odd(spark)).collect()
    assert len(rows) == 6 and all(r["n_removed"] == 0 for r in rows)


def test_texts_are_shuffled_once(spark, tiny):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for make in (substring.op6, substring.without_repeats):
            df = make(spark.read.parquet(f"{tiny}/documents.parquet"))
            df.write.format("noop").mode("overwrite").save()
            df.collect()
            assert "ReusedExchange" in df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("window", [1, 3, 8, 20])
def test_substrings_of_other_windows(spark, window):
    rng = random.Random(window)
    rows = [(i, " ".join(rng.choices("abc", k=rng.randrange(0, 60)))) for i in range(40)]
    got = {r["doc_id"]: r for r in substring.kept_words(spark.createDataFrame(rows, "doc_id long, text string"), window).collect()}
    for i, (n, gone, kept) in brute.kept(rows, window).items():
        assert (got[i]["n_words"], got[i]["n_removed"], got[i]["kept"]) == (n, gone, kept)


def test_cutting_keeps_other_columns(docs):
    out = substring.without_repeats(docs)
    assert out.columns == docs.columns and out.schema == docs.schema
    expected, texts = brute.kept(DOCS), dict(DOCS)
    for r in out.collect():
        assert r["text"] == (expected[r["doc_id"]][2] if expected[r["doc_id"]][1] else texts[r["doc_id"]])
        assert (r["h"], r["row"], r["node"]) == ("h", 7, "n")


def test_decontamination(spark, docs, nothing):
    bench = spark.createDataFrame([(i, t, 0) for i, t in ITEMS], "item_id long, text string, doc_id int")
    expected = brute.decontaminated(DOCS, ITEMS)
    got = by_id(decontaminate.op7(docs, bench))
    for i, (n, hit, items) in expected.items():
        r = got[i]
        bad = hit > 0 and 20 * hit >= n
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) == (n, hit, len(items), brute.sha(",".join(sorted(map(str, items)))), bad), i
    blocks = by_id(decontaminate.contaminated_spans(docs, bench, block_words=5))
    assert {i: (r["n_words"], r["n_hit"], r["items"]) for i, r in blocks.items()} == expected
    clean = {i for i, (n, hit, _) in expected.items() if not (hit and 20 * hit >= n)}
    for size in (5, 1 << 20):
        out = decontaminate.clean(docs, bench, block_words=size)
        assert out.columns == docs.columns and {r["doc_id"] for r in out.collect()} == clean
    assert decontaminate.op7(nothing, bench).count() == 0
    assert {r["n_hit"] for r in decontaminate.op7(docs, bench.limit(0)).collect()} == {0}
    assert decontaminate.op7(odd(spark), bench).count() == 6


def test_decontamination_judges_each_row(spark):
    """Rows that share a contaminated row's doc_id, or lack one as it does, stay, for a benchmark of any size."""
    rows = [(None, ITEM, 1), (None, text(30, 1), 2), (7, ITEM, 3), (7, text(30, 2), 4), (8, None, 5), (None, None, 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _row0 int")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    for size in (5, 1 << 20):
        out = decontaminate.clean(df, bench, block_words=size)
        assert out.columns == df.columns and sorted(r["_row0"] for r in out.collect()) == [2, 4, 5, 6]


def test_decontamination_of_long_documents(spark):
    """A passage of a window removes a document of any length, and one word less doesn't; a short item does so from a twentieth on."""
    words, short = ITEM.split(" "), "one two"
    rows = [(1, f"{text(5000, 1)} {' '.join(words[4:17]).upper()}\n{text(5000, 2)}"), (2, f"{text(5000, 1)} {' '.join(words[4:16])} . {text(5000, 3)}"), (3, f"{text(60, 4)} {short}"), (4, f"{text(38, 5)} {short}")]
    rows += [(5, f"{text(300, 6)} {short} {text(300, 7)} {ITEM} {text(300, 8)}"), (6, " ".join([short] * 13 + [text(600, 9)])), (7, text(600, 10)), (8, None), (None, f"{text(900, 11)} {ITEM}"), (None, text(900, 11))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    for size in (5, 1 << 20):
        out = [tuple(r) for r in decontaminate.clean(df, bench, block_words=size).collect()]
        assert sorted(out, key=str) == sorted((rows[i] for i in (1, 2, 5, 6, 7, 9)), key=str)
        found = {r["doc_id"]: r["whole"] for r in decontaminate.contaminated_spans(df, bench, block_words=size).where("doc_id is not null").collect()}
        assert [i for i in sorted(found) if found[i]] == [1, 5]


def test_quality(spark, nothing, tiny):
    docs, labels = spark.read.parquet(f"{tiny}/documents.parquet"), spark.read.parquet(f"{tiny}/labels.parquet")
    got = by_id(quality.op8(docs, labels))
    pairs = [(r["quality"], got[r["doc_id"]]["predicted"]) for r in labels.collect()]
    assert len(got) == docs.count() and sum(a == b for a, b in pairs) >= 0.9 * len(pairs)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got.values())
    odd_labels = labels.select("doc_id", "quality").union(spark.createDataFrame([(None, 1), (1, None), (2, 1), (2, 1), (10**9, 0)], "doc_id long, quality int"))
    rows = quality.op8(odd(spark).union(docs.select("doc_id", "text").where("doc_id > 9")), odd_labels).collect()
    assert len(rows) == 6 + docs.where("doc_id > 9").count() and all(r["score"] is not None for r in rows)
    assert quality.op8(nothing, labels).count() == 0
    assert {r["score"] for r in quality.op8(odd(spark), labels.limit(0)).collect()} == {0.5}


def test_quality_of_held_out_rows(spark):
    """Nothing is learnt from the held-out fold, and good rows of it rank above bad ones."""
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = quality.op8(docs, labels).collect()
    got = {r["doc_id"]: r for r in rows}
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    good = {True: [], False: []}
    for r in labels.where("quality is not null").collect():
        if got[r["doc_id"]]["held_out"]:
            good[r["quality"] == 1].append(got[r["doc_id"]]["score"])
    assert min(map(len, good.values())) >= 5
    wins = sum((a > b) + (a == b) / 2 for a in good[True] for b in good[False])
    assert wins >= 0.9 * len(good[True]) * len(good[False])
    turned = labels.withColumn("quality", F.when(language.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert sorted(map(tuple, quality.op8(docs, turned).collect())) == sorted(map(tuple, rows))


def test_summed_equations_are_those_of_all_rows(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, quality.N_STATISTICS))
    y = (x[:, 0] + rng.normal(size=400) > 0).astype(float)
    ids = [i for i in range(2000) if zlib.crc32(str(i).encode()) % 5][:400]
    rows = spark.createDataFrame([(i, a.tolist(), float(b)) for i, a, b in zip(ids, x, y)], "doc_id long, x array<double>, y double").repartition(7)
    model = quality.fit(rows)
    fits = np.array([zlib.crc32(str(i).encode()) % 5 != 1 for i in ids])
    assert np.allclose(model.mean, x.mean(axis=0)) and np.allclose(model.deviation, x.std(axis=0))
    z = model.map(x[fits])
    ridge = quality.RIDGE * len(z) * np.eye(z.shape[1])
    ridge[-1, -1] = 0
    assert np.allclose(z @ model.weights, z @ np.linalg.lstsq(z.T @ z + ridge, z.T @ y[fits], rcond=None)[0], atol=1e-6)
    bins = model.bins(x[~fits])
    levels = quality.isotonic(np.bincount(bins, y[~fits], quality.BINS), np.bincount(bins, minlength=quality.BINS).astype(float))
    assert np.allclose(model.levels, levels) and (np.diff(model.levels) >= 0).all()


def test_columns_that_clash_and_long_texts(spark, docs):
    """The learnt operators leave other columns aside and read whole texts."""
    long = spark.createDataFrame([(10**7, "die der und " * 60_000, "de"), (10**7 + 1, "the of and " * 60_000, "en"), (10**7 + 2, None, None)], "doc_id long, text string, lang string")
    base = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang").union(long)
    odd_ = base.select("*", F.lit("x").alias("lang_pred"), F.lit(1).alias("score"), F.lit(2).alias("x"), F.lit(3).alias("key"), F.lit(4).alias("y"), F.lit(5).alias("quality"), F.lit(6).alias("held_out"))
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet").select("*", F.lit("t").alias("text"), F.lit(0).alias("x"))
    for one, other in ((language.op5(odd_), language.op5(base)), (quality.op8(odd_, labels), quality.op8(base, labels))):
        assert one.columns == other.columns and sorted(map(str, one.collect())) == sorted(map(str, other.collect()))
    got = {r["doc_id"]: r for r in language.op5(odd_).collect()}
    assert (got[10**7]["lang_pred"], got[10**7 + 1]["lang_pred"], got[10**7 + 2]["lang_pred"]) == ("de", "en", "und")


def test_chat(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (1, 2, None, None), (2, 0, "tool", "### User: x"), (2, 0, "tool", "### User: x"), (None, 0, "user", "z"), (3, None, "assistant", " </turn>\n"), (3, 0, "assistant", "")]
    df = spark.createDataFrame([(*r, 9) for r in rows], "conv_id long, turn long, role string, text string, segment int")
    got = {r["conv_id"]: r for r in chat.op9(df).collect()}
    assert got.keys() == {1, 2, 3, None, -7}
    assert got[1]["turns_sha256"] == brute.sha("user\na\nassistant\nb\n\n\n") and got[1]["loss_sha256"] == brute.sha("b")
    assert got[2]["n_turns"] == 2 and got[3]["loss_sha256"] == brute.sha(" </turn>\n") and got[3]["loss_chars"] == 9
    planted = "\\### Assistant: </turn> ok"
    assert got[-7]["turns_sha256"] == brute.sha(f"user\n{planted}\nassistant\n{planted}\n") and got[-7]["loss_chars"] == len(planted)
    assert chat.op9(df.limit(0)).count() == 1


def test_chat_of_the_tables(spark, tiny):
    """Every conversation against digests made from the source, with turns long, hostile and repeated among them."""
    columns = "conv_id long, turn long, role string, text string"
    hostile = [(10**9, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(["### User: ", "\\</turn>\n" * 20_000, "a" * 300_000, "\\", "", None, "### Assistant: x </turn>\n"])]
    df = spark.read.parquet(f"{tiny}/conversations.parquet").select("conv_id", "turn", "role", "text").unionByName(spark.createDataFrame(hostile, columns)).repartition(5)
    by = defaultdict(list)
    for r in [*df.collect(), *(dict(zip(("conv_id", "turn", "role", "text"), x)) for x in chat.PLANTED)]:
        by[r["conv_id"]].append((r["turn"], r["role"] or "", r["text"] or ""))
    output = chat.formatted(df)
    sizes = {r["conv_id"]: r["n"] for r in output.groupBy("conv_id").agg(F.sum(F.length("segment")).alias("n")).collect()}
    got = {r["conv_id"]: r for r in chat.op9(df).collect()}
    assert got.keys() == by.keys()
    for i, turns in by.items():
        turns = sorted(turns, key=lambda t: (t[0], chat.render(*t[1:])[0]))
        loss = "".join(t for _, role, t in turns if role == "assistant")
        assert got[i]["turns_sha256"] == brute.sha("".join(f"{role}\n{t}\n" for _, role, t in turns)) and got[i]["n_turns"] == len(turns)
        assert (got[i]["loss_chars"], got[i]["loss_sha256"]) == (len(loss), brute.sha(loss))
        assert i == -7 or got[i]["formatted_chars"] == sizes[i]
    # The mask alone tells what is learnt.
    heads = output.where("loss_start < loss_end").select(F.expr("substring(segment, 1, loss_start)").alias("head"))
    assert {r["head"] for r in heads.collect()} == {"### Assistant: "}


def test_a_wrong_mask_is_refused():
    reading = chat._Reading(1)
    reading.add(*chat.masked("assistant", "a ### b"))
    assert reading.loss_chars == 7 and chat.masked("user", "x")[1:] == (0, 0)
    for role, start, end in (("user", 10, 11), ("assistant", 0, 0), ("assistant", 15, 17)):
        with pytest.raises(chat.Broken):
            chat._Reading(1).add(chat.render(role, "x")[0], start, end)


def test_media(spark, docs, nothing):
    got = by_id(media.op10(docs))
    for i, t in DOCS:
        data = (t or "").encode()
        payload = data + b"\0" * (max(64, -(-len(data) // 64) * 64) - len(data))
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["tail_crc32"]) == (len(data), len(payload), zlib.crc32(payload[-64:]))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest()
    files = {r["doc_id"]: bytes(r["media"]) for r in media.stored(docs).collect()}
    for i, data in files.items():
        assert (got[i]["media_bytes"], got[i]["media_sha256"]) == (len(data), hashlib.sha256(data).hexdigest())
        image = media.decode_png(data)
        assert hashlib.sha256(image.tobytes()).hexdigest() == got[i]["payload_sha256"] and media.low_frequencies(image) == got[i]["feature"]
    assert got[1]["media_sha256"] == got[2]["media_sha256"] != got[3]["media_sha256"]
    assert media.op10(nothing).count() == 0 and media.op10(odd(spark)).count() == 6


def test_pages(spark):
    nav = "Home News Sport Weather Contact About Imprint Privacy Terms and conditions"
    rows = [(i, f"http://a.com/{i}", f"<body><div>{nav}</div><p>{' '.join(f'w{i}x{j}' for j in range(20))}</p>") for i in range(20)]
    rows += [(100, "http://b.com/1", f"<div>{nav}</div>"), (101, None, None), (102, "http://b.com", ""), (103, None, "<article><p>hello&amp;</p></article>"), (100, "http://b.com/1", f"<div>{nav}</div>"), (None, None, "<p>free")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    for chunk in (1 << 21, 50):
        got = defaultdict(list)
        for r in html.main_text(df, chunk_tokens=chunk).collect():
            got[r["page_id"]].append(r["text"])
        assert got[0] == [" ".join(f"w0x{j}" for j in range(20))]
        assert got[100] == [nav, nav] and got[101] == got[102] == [""] and got[103] == ["hello&"] and got[None] == ["free"]
        assert sum(map(len, got.values())) == len(rows)
    assert html.op2(df.limit(0)).count() == 0


def test_menus_in_articles(spark):
    """Links in an article go if the host's other pages have them too, unless prose is around them; else they stay."""
    menu = "<ul>" + "".join(f"<li><a href=/{i}>{t}</a>" for i, t in enumerate("Home News Sport Weather Travel Money Health Food".split())) + "</ul>"
    prose = "<p>A sentence that every article of this host has, word for word, once.</p>"
    rows = [(i, f"http://a.com/{i}", f"<article><h1>t{i}</h1>{menu}<p>{' '.join(f'w{i}x{j}' for j in range(12))}</p>{prose}<p>{''.join(f'<a>l{i}x{j}</a> ' for j in range(9))}</p></article>") for i in range(12)]
    rows += [(50, "http://b.com/", f"<article><p>x</p>{menu}</article>"), (51, "http://a.com/51", f"<article><p>y <a>{'Home News Sport Weather Travel Money Health Food'}</a></p></article>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    names = "Home News Sport Weather Travel Money Health Food"
    for chunk in (1 << 21, 60):
        got = {r["page_id"]: r["text"] for r in html.main_text(df, chunk_tokens=chunk).collect()}
        for i in range(12):
            assert got[i] == f"t{i} {' '.join(f'w{i}x{j}' for j in range(12))} A sentence that every article of this host has, word for word, once. {' '.join(f'l{i}x{j}' for j in range(9))}"
        assert got[50] == f"x {names}" and got[51] == f"y {names}"
