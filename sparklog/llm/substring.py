"""Substring dedup by difference-cover anchors.

A window is ``window`` consecutive words of one document. A word is removed if a window covers it whose words
also start in a document with a smaller doc_id.

The cover D modulo v has, for any shift, two members that differ by it. Runs of window - v + 1 words are hashed
only where their start modulo v is in D. If two documents share a window, starting at i and at j, there is a
0 <= s < v with both (i + s) mod v and (j + s) mod v in D: both have an anchor at s in the window, with the same
hash. So windows need to be looked at only around anchors that occur in two documents or more; these are extended
to whole windows, and the 64-bit hashes of whole windows decide.

Anchors, then windows, are shuffled once by hash and judged by a window function. Each slice of documents settles
beforehand what it can: of a hash that many of its documents hold, all but two rows (anchors) or all but those of the
smallest document (windows) are marked and get a key of their own, so that no hot hash gathers its rows in one task. The
documents' texts are shuffled once, by doc_id, and this one exchange serves both the extension and the removal.

The documents should come from a table, so that a task that runs again reads its rows in the same order.

Null or empty texts have no words. Rows that repeat a doc_id are taken as copies of one document: each gives a row, and
only a smaller doc_id removes. A null doc_id is smaller than all and never a cause of removal. Other columns are left aside.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W
from .common import arrow_map, arrow_schema, checked, ddl, text_slices

WINDOW = 50
#: A perfect difference set: every residue modulo 31 but 0 is a difference of two members exactly once.
PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)

#: at: a place, or for a settled row -1 - place. h: the hash, or for a row apart from its group a number of its own.
RUNS = arrow_schema(h=pa.int64(), doc_id=pa.int64(), at=pa.int32())
KEPT = arrow_schema(doc_id=pa.int64(), n_words=pa.int64(), n_removed=pa.int64(), kept=pa.large_string())


def covers(period: int, cover: tuple[int, ...]) -> bool:
    """Whether each shift modulo the period is a difference of two members."""
    return {(a - b) % period for a in cover for b in cover} == set(range(period))


def cover_for(window: int) -> tuple[int, tuple[int, ...]]:
    """A difference cover whose period leaves anchors of at least a third of the window."""
    known = [(PERIOD, COVER), (21, (0, 1, 4, 14, 16)), (13, (0, 1, 3, 9)), (7, (0, 1, 3)), (3, (0, 1)), (1, (0,))]
    return next((v, d) for v, d in known if window - v + 1 >= max(1, window // 3))


def _groups(h: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows in order of (hash, doc_id), the group of each, and the smallest and largest doc_id of each group."""
    order = np.lexsort((ids, h))
    edge = np.concatenate(([True], h[order][1:] != h[order][:-1]))
    begin = np.flatnonzero(edge)
    return order, np.cumsum(edge) - 1, ids[order[begin]], ids[order[np.append(begin[1:], len(h)) - 1]]


def _runs(h: np.ndarray, ids: np.ndarray, at: np.ndarray, settled: np.ndarray, apart: np.ndarray) -> pa.RecordBatch:
    key = np.where(apart, W.mix(h ^ W.mix((ids * 1_000_003 + at).view(np.uint64))), h)
    return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(ids), pa.array(np.where(settled, -1 - at, at).astype(np.int32))], schema=RUNS)


def _ids(rows: pa.RecordBatch) -> np.ndarray:
    return rows.column(0).to_numpy(zero_copy_only=False).astype(np.int64)


def _anchors(window: int, period: int, cover: tuple[int, ...]):
    """Hashed runs at cover places; settled: another document of the slice has it too."""
    length, member = window - period + 1, np.isin(np.arange(period), cover)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, raw, off in text_slices(batch, "text"):
                start, end, first = W.spans(raw, off, W.BY_SPACE)
                at = W.inside(first, length)
                of = W.owners(first)
                at = at[(np.diff(first) >= window)[of[at]]]
                place = at - first[of[at]]
                use = member[place % period]
                at, place = at[use], place[use]
                if len(at):
                    h, ids = W.grams(W.hashes(raw, start, end), length)[at], _ids(rows)[of[at]]
                    order, group, low, high = _groups(h, ids)
                    h, ids, place = h[order], ids[order], place[order]
                    shared = (low < high)[group]
                    new = np.concatenate(([True], group[1:] != group[:-1]))
                    last = np.concatenate((new[1:], [True]))
                    yield _runs(h, ids, place, shared, shared & ~new & ~last)

    return run


def _extended(window: int, period: int):
    """Hashes of all whole windows that hold one of the document's shared anchors within the first ``period`` words.

    settled: a smaller document of the slice has it too.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, raw, off in text_slices(batch, "text"):
                start, end, first = W.spans(raw, off, W.BY_SPACE)
                places = rows.column(2)
                counts = np.asarray(pc.list_value_length(places).to_numpy(zero_copy_only=False), np.int64)
                of = np.repeat(np.arange(rows.num_rows), counts)
                at = first[of] + places.flatten().to_numpy()
                fits = at < first[of + 1]  # a row that repeats a doc_id may have a shorter text
                of, at = of[fits], at[fits]
                near = np.zeros(len(start) + 1, np.int32)
                np.add.at(near, np.maximum(at - period + 1, first[of]), 1)
                np.add.at(near, at + 1, -1)
                ok = np.zeros(len(start), bool)
                ok[W.inside(first, window)] = True
                use = np.flatnonzero((np.cumsum(near[:-1]) > 0) & ok)
                if len(use):
                    owner = W.owners(first)[use]
                    h, ids, place = W.grams(W.hashes(raw, start, end), window)[use], _ids(rows)[owner], use - first[owner]
                    order, group, low, _ = _groups(h, ids)
                    h, ids, place = h[order], ids[order], place[order]
                    gone = ids > low[group]
                    yield _runs(h, ids, place, gone, gone)

    return run


def _kept(window: int, originals: bool):
    """The words that stay, or with originals the whole text where all of them stay; columns after the third are passed on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, raw, off in text_slices(batch, "text"):
                start, end, first = W.spans(raw, off, W.BY_SPACE)
                places = rows.column(2)
                counts = np.asarray(pc.list_value_length(places).fill_null(0).to_numpy(zero_copy_only=False), np.int64)
                of = np.repeat(np.arange(rows.num_rows), counts)
                at = first[of] + places.flatten().to_numpy() if len(of) else np.zeros(0, np.int64)
                at = at[at + window <= first[of + 1]]
                gone = np.zeros(len(start) + 1, np.int32)
                np.add.at(gone, at, 1)
                np.add.at(gone, at + window, -1)
                gone = np.cumsum(gone[:-1]) > 0
                # Kept words with one space before each: bytes of words stay, and the one byte before a word becomes a space.
                edge = np.zeros(len(raw) + 1, np.int32)
                np.add.at(edge, start[~gone], 1)
                np.add.at(edge, end[~gone], -1)
                stay = np.cumsum(edge[:-1]) > 0
                n_removed = np.bincount(W.owners(first)[gone], minlength=rows.num_rows)
                sizes = np.zeros(len(raw) + 1, np.int64)
                np.cumsum(stay, out=sizes[1:])
                keep = ~gone
                gaps = np.zeros(len(start) + 1, np.int64)
                np.cumsum(keep, out=gaps[1:])
                letters, kept = np.diff(sizes[off]), np.diff(gaps[first])
                length = letters + np.maximum(kept - 1, 0)
                out_off = np.concatenate(([0], np.cumsum(length)))
                out = np.full(int(out_off[-1]), 0x20, np.uint8)
                # A kept byte's place: bytes before it in its document, and a space for each kept word before its own.
                byte = np.flatnonzero(stay)
                doc = np.searchsorted(off, byte, "right") - 1
                word = np.searchsorted(start, byte, "right") - 1
                out[out_off[doc] + (sizes[byte] - sizes[off[doc]]) + (gaps[word] - gaps[first[doc]])] = raw[byte]
                text = pa.LargeStringArray.from_buffers(rows.num_rows, pa.py_buffer(out_off.astype(np.int64)), pa.py_buffer(out))
                if originals:
                    text = pc.if_else(pa.array(n_removed > 0), text, rows.column(1).cast(pa.large_string()))
                found = [rows.column(0).cast(pa.int64()), pa.array(np.diff(first), pa.int64()), pa.array(n_removed, pa.int64()), text]
                yield pa.RecordBatch.from_arrays([*found, *rows.columns[3:]], names=[*KEPT.names, *rows.schema.names[3:]])

    return run


def kept_words(documents: DataFrame, window: int = WINDOW) -> DataFrame:
    """A row for each document row: doc_id, n_words, n_removed, kept (the words that stay, joined by one space)."""
    return _cleaned(checked(documents, "doc_id", "text"), window, False)


def _cleaned(docs: DataFrame, window: int, originals: bool) -> DataFrame:
    """docs: doc_id, text, and columns to pass on, which take part in the one exchange of texts."""
    period, cover = cover_for(window)
    more = docs.columns[2:]
    if dict(docs.dtypes)["doc_id"] != "bigint":  # a cast of its own, though idle, would keep the exchange from being reused
        docs = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    named, nameless = docs.where("doc_id is not null"), docs.where("doc_id is null")
    key, place = Window.partitionBy("h"), F.expr("if(at < 0, -1 - at, at)")
    anchors = arrow_map(named.select("doc_id", "text"), _anchors(window, period, cover), RUNS)
    shared = anchors.withColumn("low", F.min("doc_id").over(key)).withColumn("high", F.max("doc_id").over(key)).where("at < 0 or low < high")
    places = shared.groupBy("doc_id").agg(F.collect_set(place).alias("places"))
    by_doc = named.repartition("doc_id")  # one exchange for both joins
    # What a slice settles depends on its rows: in order of doc_id, as the join leaves them, a task that runs again settles the same.
    near = by_doc.join(places, "doc_id").select("doc_id", "text", "places", *more).sortWithinPartitions("doc_id")
    windows = arrow_map(near, _extended(window, period), RUNS)
    later = windows.withColumn("low", F.min("doc_id").over(key)).where("at < 0 or doc_id > low").groupBy("doc_id").agg(F.collect_set(place).alias("gone"))
    all_docs = by_doc.join(later, "doc_id", "left").select("doc_id", "text", "gone", *more).unionByName(nameless.withColumn("gone", F.lit(None).cast("array<int>")))
    return arrow_map(all_docs.select("doc_id", "text", "gone", *more), _kept(window, originals), T.StructType([*ddl(KEPT).fields, *docs.select(*more).schema.fields]))


def op6(documents: DataFrame) -> DataFrame:
    return kept_words(documents).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def without_repeats(documents: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents with repeated passages cut out: text is that of the words that stay, if any word went."""
    others = [F.col(f"`{c}`") for c in documents.columns if c not in ("doc_id", "text")]
    docs = documents.select("doc_id", "text", (F.struct(*others) if others else F.lit(0)).alias("rest"))
    found = _cleaned(docs, window, True)
    columns = {c: F.col(f"rest.`{c}`") for c in documents.columns} | {"doc_id": F.col("doc_id"), "text": F.col("kept")}
    if "n_chars" in documents.columns:
        columns["n_chars"] = F.when(F.col("n_removed") > 0, F.length("kept").cast(documents.schema["n_chars"].dataType)).otherwise(columns["n_chars"])
    return found.select(*(columns[c].cast(documents.schema[c].dataType).alias(c) for c in documents.columns))
