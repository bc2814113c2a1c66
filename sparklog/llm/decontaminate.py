"""Benchmark decontamination by winnowing.

Words are runs of letters, digits and code points beyond ASCII, A-Z folded. Of every ``w`` consecutive
hashes of k words, with k + w - 1 equal to the window, the smallest is kept as a fingerprint, on either
side by the same rule: any span of a window's length that both sides share holds a kept hash at the same
place. Document fingerprints that occur in the benchmark are extended: each whole window around one is
looked up among the benchmark's windows, and its words are marked. Benchmark items with fewer words than
a window are windows of their own length, looked up at every position (at most window - 1 lengths).

Two rules tell which documents are bad. ``contaminated``, that of op7's column: hit words are a twentieth of all or more.
``leaked``, by which ``clean`` removes rows: that, or a whole window occurs, however long the document is. Items of fewer words
than a window may occur by chance, so they alone remove a row only from a twentieth on.

The benchmark goes to the executors in blocks of about ``block_words`` words, by a hash of item_id, so its broadcast is
bounded and the driver holds one block at a time; documents are read once for each block, and a document's marks are
merged when there are several.

Null or empty texts have no words; null item texts have no windows. Rows of documents that repeat give a
row each. Other columns of either input are left aside. Empty inputs give empty results, or no hits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import arrow_map, arrow_schema, checked, dropped_by, text_slices, written

WINDOW, K = 13, 7
BLOCK_WORDS = 1 << 20

SPANS = arrow_schema(doc_id=pa.int64(), row=pa.int64(), n_words=pa.int64(), n_hit=pa.int64(), whole=pa.bool_(), hit_starts=pa.list_(pa.int32()), hit_ends=pa.list_(pa.int32()), items=pa.list_(pa.int64()))


def winnow(grams: np.ndarray, first: np.ndarray, k: int, w: int) -> np.ndarray:
    """Places of the kept hashes: in every w consecutive ones of a text, the smallest (the last, if several are)."""
    starts = W.inside(first, k + w - 1)
    if not len(starts):
        return starts
    view = np.lib.stride_tricks.sliding_window_view(grams, w)[starts]
    return np.unique(starts + (w - 1 - np.argmin(view[:, ::-1], axis=1)))


class Index:
    """What a block of the benchmark gives: sorted fingerprints, and sorted window hashes with their items."""

    def __init__(self, items: list[tuple[int, str | None]], window: int, k: int) -> None:
        self.window, self.k, self.w = window, k, window - k + 1
        texts = [(t or "").encode() for _, t in items]
        raw = np.frombuffer(b"".join(texts), np.uint8)
        off = np.cumsum([0, *map(len, texts)])
        raw = W.FOLD[raw]
        start, end, first = W.spans(raw, off, W.BY_SIGN)
        h = W.hashes(raw, start, end)
        ids = np.array([i for i, _ in items], np.int64)
        grams = W.grams(h, k)
        self.prints = np.unique(grams[winnow(grams, first, k, self.w)]) if len(grams) else np.zeros(0, np.uint64)
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        counts, of = np.diff(first), W.owners(first)
        for n in sorted({min(int(c), window) for c in counts if c}):
            at = W.inside(first, n)
            at = at[counts[of[at]] == n] if n < window else at
            key, item = W.grams(h, n)[at], ids[of[at]]
            order = np.lexsort((item, key))
            key, item = key[order], item[order]
            keys, begin = np.unique(key, return_index=True)
            self.by_length[n] = keys, np.append(begin, len(key)), item

    @staticmethod
    def found(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which keys occur, and where in sorted_keys."""
        if not len(sorted_keys):
            return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
        at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
        return sorted_keys[at] == keys, at

    def hits(self, h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Occurring windows in texts: starts, lengths and places in by_length, as (start, length, key place)."""
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for n in self.by_length:
            at = W.inside(first, n)
            if n == self.window:
                grams = W.grams(h, self.k)
                near = winnow(grams, first, self.k, self.w)
                near = near[self.found(self.prints, grams[near])[0]] if len(near) else near
                if not len(near):
                    continue
                around = np.unique((near[:, None] - np.arange(self.w)).ravel())
                at = np.intersect1d(around, at, assume_unique=True)
            if len(at):
                ok, place = self.found(self.by_length[n][0], W.grams(h, n)[at])
                out.append((at[ok], np.full(int(ok.sum()), n), place[ok]))
        return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 3  # type: ignore[return-value]


#: A worker's index of the block that it worked with last, by the broadcast items, which all tasks of a worker share.
_latest: dict[str, object] = {}
dropped_by(_latest.clear)


def index_of(items: list[tuple[int, str | None]], window: int, k: int) -> Index:
    """The index of a block, made once in a worker."""
    if _latest.get("items") is not items or _latest.get("sizes") != (window, k):
        _latest.update(items=items, sizes=(window, k), index=Index(items, window, k))
    return _latest["index"]  # type: ignore[return-value]


def marked(batches: Iterator[pa.RecordBatch], index: Index) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, raw, off in text_slices(batch, "text"):
            raw = W.FOLD[raw]
            start, end, first = W.spans(raw, off, W.BY_SIGN)
            h = W.hashes(raw, start, end)
            at, length, place = index.hits(h, first)
            hit = np.zeros(len(h) + 1, np.int32)
            np.add.at(hit, at, 1)
            np.add.at(hit, at + length, -1)
            hit = np.cumsum(hit[:-1]) > 0
            of = W.owners(first)
            n_hit = np.bincount(of[hit], minlength=rows.num_rows)
            whole = np.bincount(of[at[length == index.window]], minlength=rows.num_rows) > 0
            starts: list[list[int]] = [[] for _ in range(rows.num_rows)]
            ends: list[list[int]] = [[] for _ in range(rows.num_rows)]
            items: list[list[int]] = [[] for _ in range(rows.num_rows)]
            for d in np.flatnonzero(n_hit):
                edge = np.flatnonzero(np.diff(np.concatenate(([0], hit[first[d] : first[d + 1]].view(np.int8), [0]))))
                starts[d], ends[d] = edge[::2].tolist(), edge[1::2].tolist()
            for d in np.unique(of[at]) if len(at) else ():
                mine = (at >= first[d]) & (at < first[d + 1])
                seen: set[int] = set()
                for n, p in set(zip(length[mine].tolist(), place[mine].tolist())):
                    _, begin, item = index.by_length[n]
                    seen.update(item[begin[p] : begin[p + 1]].tolist())
                items[d] = sorted(seen)
            yield pa.RecordBatch.from_arrays([rows.column(0).cast(pa.int64()), rows.column(1), pa.array(np.diff(first), pa.int64()), pa.array(n_hit, pa.int64()), pa.array(whole), pa.array(starts, pa.list_(pa.int32())), pa.array(ends, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.int64()))], schema=SPANS)


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row of a document's rows from each block: the union of its spans and items."""
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            runs: list[list[int]] = []
            for a, b in sorted((x["a"], x["b"]) for part in r["spans"] for x in part):
                if runs and a <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], b)
                else:
                    runs.append([a, b])
            out.append({"doc_id": r["doc_id"], "row": r["row"], "n_words": r["n_words"], "n_hit": sum(b - a for a, b in runs), "whole": r["whole"], "hit_starts": [a for a, _ in runs], "hit_ends": [b for _, b in runs], "items": sorted({i for part in r["all_items"] for i in part})})
        yield pa.RecordBatch.from_pylist(out, schema=SPANS)


class Blocks:
    """A benchmark's items in blocks of about ``block_words`` words."""

    def __init__(self, benchmark: DataFrame, block_words: int) -> None:
        self.items = checked(benchmark, "item_id", "text").where("item_id is not null")
        words = self.items.agg(F.sum(F.length("text") / 4 + 1)).first()[0] or 0
        self.count = max(1, -(-int(words) // block_words))

    def fetch(self, block: int) -> list[tuple[int, str | None]]:
        mine = F.pmod(F.xxhash64("item_id"), F.lit(self.count)) == block
        return sorted(((r["item_id"], r["text"]) for r in self.items.where(mine).collect()), key=lambda r: r[0])


def contaminated_spans(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, k: int = K, block_words: int = BLOCK_WORDS) -> DataFrame:
    """A row for each document row: doc_id, n_words, n_hit, whole (a window of full length occurs), hit_starts, hit_ends (word places,
    end excluded), items.

    k words make a hash; window - k + 1 hashes make a winnowing window; k may be at most the window.
    """
    docs = checked(documents, "doc_id", "text").select("doc_id", F.lit(0).cast("long").alias("row"), "text")
    parts = Blocks(benchmark, block_words)
    if parts.count > 1:  # the rows of one document, from different blocks, must be told from repeated rows
        docs = written(docs.withColumn("row", F.monotonically_increasing_id()), "decontaminate")
    return _spans(docs, parts, window, k).drop("row")


def _spans(docs: DataFrame, parts: Blocks, window: int, k: int) -> DataFrame:
    """The spans of documents (doc_id, row, text), with row; with several blocks, row is each one's own."""
    if not 1 <= k <= window:
        raise ValueError("k must be between 1 and the window")
    spark = docs.sparkSession
    found = None
    for block in range(parts.count):
        shared = spark.sparkContext.broadcast(parts.fetch(block))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            return marked(batches, index_of(shared.value, window, k))

        one = arrow_map(docs, run, SPANS)
        if parts.count > 1:
            one = written(one, "marks")
            shared.destroy()
        found = one if found is None else found.unionByName(one)
    if parts.count > 1:
        spans = F.arrays_zip(F.col("hit_starts").alias("a"), F.col("hit_ends").alias("b"))
        grouped = found.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.max("whole").alias("whole"), F.collect_list(spans).alias("spans"), F.collect_list("items").alias("all_items"))
        found = arrow_map(grouped, _merged, SPANS)
    return found


def contaminated(found: DataFrame):
    """Whether hit words are at least a twentieth of a document's words."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def leaked(found: DataFrame):
    """Whether a whole window occurs, or hit words are at least a twentieth."""
    return F.col("whole") | contaminated(found)


def op7(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    found = contaminated_spans(documents, benchmark)
    names = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), contaminated(found).alias("contaminated"))


def clean(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, k: int = K, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The documents in which nothing leaked, with all their columns. Each row is judged by itself. With one block of the benchmark nothing is shuffled."""
    parts = Blocks(benchmark, block_words)
    if parts.count > 1:
        names = {c.lower() for c in documents.columns}
        row = next(c for i in range(len(names) + 1) if (c := f"_row{i}") not in names)
        numbered = written(documents.withColumn(row, F.monotonically_increasing_id()), "decontaminate")
        found = _spans(numbered.select(F.lit(None).cast("long").alias("doc_id"), F.col(row).alias("row"), "text"), parts, window, k)
        return numbered.join(found.where(leaked(found)).select(F.col("row").alias(row)), row, "left_anti").select(documents.columns)
    shared = documents.sparkSession.sparkContext.broadcast(parts.fetch(0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = index_of(shared.value, window, k)
        for batch in batches:
            plain = pa.RecordBatch.from_arrays([pa.nulls(batch.num_rows, pa.int64()), pa.array(np.arange(batch.num_rows)), batch.column(batch.schema.get_field_index("text"))], names=["doc_id", "row", "text"])
            judged = [x for part in marked(iter([plain]), index) for x in zip(*(part.column(part.schema.get_field_index(c)).to_pylist() for c in ("n_words", "n_hit", "whole")))]
            yield batch.filter(pa.array([not whole and (hit == 0 or 20 * hit < n) for n, hit, whole in judged], pa.bool_()))

    return arrow_map(documents, run, documents.schema)
