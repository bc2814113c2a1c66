"""MinHash near-dedup by fast similarity sketching.

A document's set holds the distinct shingles of its words (A-Z folded), as 64-bit hashes. The sketch of a set
(Dahlgaard, Knudsen, Thorup, 2017): in round i every member is hashed to one bin, with a value above those of the
earlier rounds; each bin keeps its smallest. Rounds stop once all bins are filled; after t random rounds round t + b
sends every member to bin b, so all t coordinates fill, each agrees with chance J, and estimates concentrate.
Sketches are cut into bands; documents that share a band are candidates; links are confirmed on the full sets.

With 36 bands of 5 rows a pair of similarity 0.8 shares none with chance 6e-7. Before sets are fetched, candidates are
dropped whose sizes can't reach the similarity, or whose sketches agree so seldom that a pair at the threshold does so
with a chance below 1e-8.

Copies (equal sets) become one node first. Within a band's bucket no list of all pairs is made: a few members are
centres, tested against the rest; members that verified links have joined need no further tests, and centres leave the
bucket with all their pairs tested. Rounds go on until each bucket holds one component only, so the components are those
of all links that share a band. Buckets are never gathered; links and labels stay in tables.

Null or empty texts have an empty set, linked with nothing; so are rows with a null doc_id, which stay. Rows that repeat
a doc_id are one document, taken with each of its texts: nodes are sets, not documents, and sets of one document are
linked. A row with an empty set belongs to its document's other rows, if there are any. Columns other than doc_id and text are left aside.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from . import bloom
from .common import arrow_map, arrow_schema, bucketed, checked, drop_written, text_slices, written
from .graph import components, joined

SIMILARITY, SHINGLE = 80, 5
BANDS, ROWS = 36, 5
SIGMAS = 6

FEATURES = arrow_schema(doc_id=pa.int64(), n=pa.int64(), same=pa.binary(), bands=pa.list_(pa.int64()), sketch=pa.binary())
SETS = arrow_schema(same=pa.binary(), members=pa.binary())
PAIRS = arrow_schema(a=pa.int64(), b=pa.int64())

_ROUND = np.random.default_rng(5).integers(0, 1 << 63, 4096, dtype=np.uint64) | np.uint64(1)
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_sets(raw: np.ndarray, off: np.ndarray, size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; with fewer words, the whole sequence is the one shingle."""
    start, end, first = W.spans(raw, off, W.BY_SPACE)
    h = W.hashes(W.FOLD[raw], start, end)
    g = W.grams(h, size)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= size:
            x = np.sort(g[a : b - size + 1])
            out.append(x[np.concatenate(([True], x[1:] != x[:-1]))])
        else:
            out.append(W.grams(h[a:b], b - a) if b > a else np.zeros(0, np.uint64))
    return out


def sketches(members: np.ndarray, first: np.ndarray, t: int) -> np.ndarray:
    """The t coordinates of each set's sketch; those of an empty set stay empty."""
    n = len(first) - 1
    out = np.full(n * t, _EMPTY, np.uint64)
    of = W.owners(first)
    left = np.diff(first) > 0
    for i in range(2 * t):
        if not left.any():
            break
        use = left[of]
        if use.all():
            x, at = members, of
        else:
            members, of = members[use], of[use]
            x, at = members, of
        x = W.mix(x + _ROUND[i])
        bins = (((x >> np.uint64(44)) * np.uint64(t)) >> np.uint64(20)).astype(np.int64) if i < t else i - t
        np.minimum.at(out, at * t + bins, (np.uint64(i) << np.uint64(44)) | (x & np.uint64((1 << 44) - 1)))
        left &= (out.reshape(n, t) == _EMPTY).any(axis=1)
    return out.reshape(n, t)


def digest(members: np.ndarray) -> bytes:
    return hashlib.blake2b(members.tobytes(), digest_size=16).digest()


def _features(size: int, bands: int, rows_per_band: int):
    t = bands * rows_per_band

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, raw, off in text_slices(batch, "text"):
                sets = shingle_sets(raw, off, size)
                n = np.array([len(x) for x in sets])
                first = np.concatenate(([0], np.cumsum(n)))
                s = sketches(np.concatenate(sets), first, t)
                keys = W.mix(W.mix(s).reshape(len(sets), bands, rows_per_band) * _ROUND[:rows_per_band]).sum(axis=2, dtype=np.uint64)
                keys = W.mix(keys + _ROUND[100 : 100 + bands])
                small = (W.mix(s) >> np.uint64(56)).astype(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column(0).cast(pa.int64()),
                        pa.array(n, pa.int64()),
                        pa.array([digest(x) for x in sets], pa.binary()),
                        pa.ListArray.from_arrays(np.arange(0, len(sets) * bands + 1, bands, dtype=np.int32), pa.array(keys.ravel().view(np.int64))),
                        pa.array([x.tobytes() for x in small], pa.binary()),
                    ],
                    schema=FEATURES,
                )

    return run


def _sets(size: int, wanted=None):
    """Full sets of documents, of those alone that may be in a filter if there is one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if wanted is not None:
                batch = batch.filter(pa.array(wanted.value.may_have(batch.column(0).to_numpy())))
            for rows, raw, off in text_slices(batch, "text"):
                sets = shingle_sets(raw, off, size)
                yield pa.RecordBatch.from_arrays([pa.array([digest(x) for x in sets], pa.binary()), pa.array([x.tobytes() for x in sets], pa.binary())], schema=SETS)

    return run


def _likely(least: float):
    """Pairs whose sketches agree in at least that share of their coordinates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for i in (2, 3))
                yield batch.select(["a", "b"]).filter(pa.array((a == b).mean(axis=1) >= least))

    return run


def _linked(percent: int):
    """Pairs whose full sets reach the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2), batch.column(3)):
                a, b = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.concatenate((a, b))
                both.sort(kind="stable")  # two sorted runs: merged in one pass
                common = int((both[1:] == both[:-1]).sum())
                ok.append(100 * common >= percent * (len(a) + len(b) - common))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def _verified(pairs: DataFrame, known: DataFrame, sets: DataFrame, percent: int, bands: int, rows_per_band: int) -> DataFrame:
    """Of candidate pairs (a, b), those that are links. known: node, sketch."""
    t, s = bands * rows_per_band, percent / 100
    least = max(0.0, s - SIGMAS * (s * (1 - s) / t) ** 0.5)
    a, b = (known.select(F.col("node").alias(x), F.col("sketch").alias(f"sketch_{x}")) for x in "ab")
    likely = arrow_map(pairs.join(a, "a").join(b, "b").select("a", "b", "sketch_a", "sketch_b"), _likely(least), PAIRS)
    a, b = (sets.select(F.col("node").alias(x), F.col("members").alias(f"members_{x}")) for x in "ab")
    return arrow_map(likely.join(a, "a").join(b, "b").select("a", "b", "members_a", "members_b"), _linked(percent), PAIRS)


def _full_sets(docs: DataFrame, known: DataFrame, shingle: int) -> DataFrame:
    """The sets of known nodes, in buckets by node. Up to a number of nodes, a filter of bounded size picks the documents
    where they are read; beyond it, they are joined. Other sets of these documents come along."""
    count, ids = known.count(), known.select("doc_id")
    if count <= bloom.MOST:
        wanted = docs.sparkSession.sparkContext.broadcast(bloom.Bloom(ids, count))
        found = arrow_map(docs, _sets(shingle, wanted), SETS)
    else:
        found = arrow_map(docs.join(ids, "doc_id", "left_semi"), _sets(shingle), SETS)
    return bucketed(found.select(F.xxhash64("same").alias("node"), "members"), "sets", "node")


def near_duplicates(documents: DataFrame, shingle: int = SHINGLE, percent: int = SIMILARITY, bands: int = BANDS, rows_per_band: int = ROWS) -> DataFrame:
    """A row for each document row: doc_id, n_shingles, component_id (the smallest doc_id that links reach)."""
    docs = checked(documents, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    features = written(arrow_map(docs, _features(shingle, bands, rows_per_band), FEATURES), "sketches")
    features = features.withColumn("node", F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.xxhash64("same")))
    full = features.where("node is not null")
    # Equal sets are one node; its doc_id is the smallest of theirs.
    copies = full.groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    nodes = full.select("node", "doc_id", "n", "bands", "sketch").join(copies, ["node", "doc_id"], "left_semi").dropDuplicates(["node"])
    # Sets of one document are linked.
    own = full.groupBy("doc_id").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high")
    own = written(full.select("doc_id", "node").join(own, "doc_id").where("node <> low").select(F.col("low").alias("a"), F.col("node").alias("b")).distinct(), "own")
    entries = nodes.select("node", "n", F.explode("bands").alias("key"))
    first = entries.groupBy("key").agg(F.min(F.struct(F.xxhash64("node").alias("h"), "node", "n")).alias("c"), F.count("*").alias("m")).where("m > 1").select("key", F.col("c.node").alias("centre"), F.col("c.n").alias("centre_n"))
    buckets = written(entries.join(first, "key"), "buckets")
    met = buckets.select("node").distinct()
    known = written(nodes.join(met, "node", "left_semi").select("node", "doc_id", "sketch"), "known")
    sets = _full_sets(docs.where("doc_id is not null"), known, shingle)

    def fits(x: str, y: str):
        return F.least(x, y) * 100 >= F.greatest(x, y) * percent

    def pair(x: str, y: str) -> list:
        return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]

    pairs = written(buckets.where("node <> centre").where(fits("n", "centre_n")).select(*pair("node", "centre")).distinct(), "pairs")
    tested = pairs
    links = written(_verified(pairs, known, sets, percent, bands, rows_per_band), "found").unionByName(own)
    labels = components(links)
    open_, centres = buckets.where("node <> centre").select("key", "node", "n"), 16
    while True:
        now = open_.join(labels, "node", "left").select("key", "node", "n", F.coalesce("label", "node").alias("label"))
        mixed = now.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("m")).where("low < high").select("key", "m")
        now = written(now.join(mixed, "key").withColumn("centre", F.pmod(F.xxhash64("node", F.lit(centres)), F.lit(1 << 20)) * F.col("m") < F.lit(centres << 20)), "open")
        if now.isEmpty():
            break
        c = now.where("centre").select("key", F.col("node").alias("other"), F.col("n").alias("other_n"), F.col("label").alias("other_label"))
        pairs = now.join(c, "key").where("label <> other_label").where(fits("n", "other_n")).select(*pair("node", "other")).distinct()
        pairs = written(pairs.join(tested, ["a", "b"], "left_anti"), "pairs")
        tested = tested.unionByName(pairs)
        more = written(_verified(pairs, known, sets, percent, bands, rows_per_band), "found")
        if not more.isEmpty():
            labels = joined(labels, more)
        open_, centres = now.where("not centre").select("key", "node", "n"), 2 * centres
    for table in (buckets, known, sets, now):
        drop_written(table)
    named = copies.join(labels, "node", "left").select("node", "doc_id", F.coalesce("label", "node").alias("label"))
    lowest = named.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    named = named.select("node", "label").join(lowest, "label").select("node", "component_id")
    empty = features.where("n = 0 and doc_id is not null").select("doc_id").distinct()
    others = full.select("doc_id", "node").join(empty, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("node").alias("other"))
    rows = features.select("doc_id", "n", "node").join(others, "doc_id", "left").select("doc_id", "n", F.coalesce("node", "other").alias("node"))
    return rows.join(named, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def op4(documents: DataFrame) -> DataFrame:
    return near_duplicates(documents, shingle=4).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def one_of_each(documents: DataFrame, shingle: int = SHINGLE, percent: int = SIMILARITY) -> DataFrame:
    """The documents, with all their columns, of which each component keeps that with the smallest doc_id."""
    gone = near_duplicates(documents, shingle, percent).where("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct()
    return documents.join(gone, documents["doc_id"] == gone["_gone"], "left_anti")
