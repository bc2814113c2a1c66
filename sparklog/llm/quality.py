"""Quality classifier: random Fourier features over document statistics, ridge scores, isotonic calibration.

Statistics of the whole text (shares of kinds of bytes, words, lines and their repetition) are standardised by the
learning rows' mean and deviation. Cosines of random projections approximate a Gaussian kernel over them. Each partition
sums its normal equations, these are summed in a few groups and solved for ridge weights. Scores of a fold left out of
the fit are counted in bins; pooling neighbours until the share of good rows never falls gives the calibrated score.

Learning uses all labelled rows whose crc32(doc_id) mod 5 is not 0: rest 1 calibrates, the others fit. The driver gets
means, one set of normal equations for each of ``GROUPS`` groups, and counts by bin, of a size that rows don't change.

Null and empty texts have all statistics 0 and are scored too. Null labels are left out; a document labelled twice counts
twice. Rows that repeat get equal scores. A null doc_id is scored and never learnt from. Other columns are left aside.
Without both labels the score is the share of good rows, or one half.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import arrow_map, arrow_schema, checked, text_slices, written
from .language import held_out

DIMENSIONS, WIDTH, RIDGE = 256, 3.0, 1e-4
BINS, GROUPS, THRESHOLD = 1024, 16, 0.3

_KINDS = np.full(256, 9, np.int64)
for _k, _bytes in enumerate((range(0x61, 0x7B), range(0x41, 0x5B), range(0x80, 0x100), range(0x30, 0x3A), b" ", b"\n", b".,;:'\"-()", b"!?", b"|")):
    _KINDS[list(_bytes)] = _k
N_STATISTICS = 22
_BY_LINE = np.ones(256, bool)
_BY_LINE[0x0A] = False

STATISTICS = arrow_schema(doc_id=pa.int64(), x=pa.list_(pa.float64()))
SUMS = arrow_schema(part=pa.int64(), sums=pa.binary())
SCORED = arrow_schema(doc_id=pa.int64(), score=pa.float64())


def _distinct(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """How many different hashes each text has."""
    of = W.owners(first)
    order = np.lexsort((h, of))
    h, of = h[order], of[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
    return np.bincount(of[new], minlength=len(first) - 1)


def statistics(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    n = len(off) - 1
    of = np.repeat(np.arange(n), np.diff(off))
    kinds = np.bincount(of * 10 + _KINDS[raw], minlength=n * 10).reshape(n, 10)
    size = np.maximum(np.diff(off), 1)[:, None]
    start, end, first = W.spans(raw, off, W.BY_SPACE)
    h = W.hashes(raw, start, end)
    n_words = np.diff(first)
    at_least = np.maximum(n_words, 1)
    word_of = W.owners(first)
    length = end - start
    mean = np.bincount(word_of, length, minlength=n) / at_least
    spread = np.sqrt(np.maximum(0, np.bincount(word_of, length.astype(float) ** 2, minlength=n) / at_least - mean**2))
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (word_of[1:] == word_of[:-1])
    pairs = W.inside(first, 2)
    pair_first = np.searchsorted(pairs, first)
    distinct_pairs = _distinct(W.grams(h, 2)[pairs], pair_first) / np.maximum(np.diff(pair_first), 1)
    a, b, lines = W.spans(raw, off, _BY_LINE)
    n_lines = np.diff(lines)
    capital = np.bincount(word_of[(raw[start] >= 0x41) & (raw[start] <= 0x5A)], minlength=n) / at_least
    symbol = np.bincount(word_of[_KINDS[raw[end - 1]] == 9], minlength=n) / at_least
    stop = np.bincount(word_of[_KINDS[raw[end - 1]] == 6], minlength=n) / at_least
    return np.column_stack(
        [
            kinds / size,
            np.log1p(n_words),
            mean,
            spread,
            _distinct(h, first) / at_least,
            distinct_pairs,
            np.bincount(word_of[again], minlength=n) / at_least,
            np.log1p(n_lines),
            _distinct(W.hashes(raw, a, b), lines) / np.maximum(n_lines, 1),
            np.log1p(n_words / np.maximum(n_lines, 1)),
            capital,
            symbol,
            stop,
        ]
    )


class Model:
    """From statistics to a calibrated score."""

    def __init__(self, mean: np.ndarray, deviation: np.ndarray) -> None:
        rng = np.random.default_rng(11)
        self.mean, self.deviation = mean, np.maximum(deviation, 1e-6)
        self.project = rng.normal(size=(N_STATISTICS, DIMENSIONS)) / WIDTH
        self.shift = rng.uniform(0, 2 * np.pi, DIMENSIONS)
        self.weights = np.zeros(DIMENSIONS + 1)
        self.levels = np.full(BINS, 0.5)

    def map(self, x: np.ndarray) -> np.ndarray:
        """Cosines that stand for the kernel, and a constant."""
        z = np.clip((x - self.mean) / self.deviation, -5, 5)
        return np.hstack([np.sqrt(2 / DIMENSIONS) * np.cos(z @ self.project + self.shift), np.ones((len(x), 1))])

    def bins(self, x: np.ndarray) -> np.ndarray:
        raw = self.map(x) @ self.weights
        return np.clip((raw + 0.5) / 2 * BINS, 0, BINS - 1).astype(np.int64)

    def score(self, x: np.ndarray) -> np.ndarray:
        return self.levels[self.bins(x)]


def isotonic(good: np.ndarray, all_: np.ndarray) -> np.ndarray:
    """A level for each bin that never falls: neighbours are pooled; bins without rows lie between those around them."""
    runs: list[list[float]] = []
    for b in np.flatnonzero(all_):
        runs.append([b, b, good[b], all_[b]])
        while len(runs) > 1 and runs[-2][2] * runs[-1][3] >= runs[-1][2] * runs[-2][3]:
            _, end, g, n = runs.pop()
            runs[-1] = [runs[-1][0], end, runs[-1][2] + g, runs[-1][3] + n]
    if not runs:
        return np.full(len(all_), 0.5)
    at = [x for r in runs for x in ((r[0], r[1]) if r[0] < r[1] else (r[0],))]
    level = [r[2] / r[3] for r in runs for _ in range(2 if r[0] < r[1] else 1)]
    return np.interp(np.arange(len(all_)), at, level)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, raw, off in text_slices(batch, "text"):
            x = statistics(raw, off)
            lists = pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([rows.column(0).cast(pa.int64()), lists], schema=STATISTICS)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), N_STATISTICS)


def _equations(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = np.zeros((DIMENSIONS + 1, DIMENSIONS + 2))
        for batch in batches:
            if batch.num_rows:
                z = shared.value.map(_matrix(batch.column(0)))
                total += z.T @ np.hstack([z, batch.column(1).to_numpy()[:, None]])
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([total.tobytes()], pa.binary())], schema=SUMS)

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        for raw in batch.column(1).to_pylist():
            part = np.frombuffer(raw)
            total = part if total is None else total + part
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int64()), pa.array([total.tobytes()], pa.binary())], schema=SUMS)


def fit(rows: DataFrame) -> Model:
    """Learn from rows (doc_id, x, y) of the learning folds."""
    spark = rows.sparkSession
    moments = rows.select(F.posexplode("x").alias("k", "v")).groupBy("k").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s")).orderBy("k").collect()
    good = rows.agg(F.avg("y")).first()[0]
    if not moments:
        return Model(np.zeros(N_STATISTICS), np.ones(N_STATISTICS))
    model = Model(np.array([r["m"] for r in moments]), np.array([r["s"] for r in moments]))
    model.levels[:] = good
    calibrate = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1
    shared = spark.sparkContext.broadcast(model)
    sums = arrow_map(rows.where(~calibrate).select("x", "y"), _equations(shared), SUMS)
    sums = arrow_map(sums.repartition(GROUPS, F.col("part") % GROUPS), _summed, SUMS).collect()
    total = sum((np.frombuffer(bytes(r["sums"])) for r in sums), np.zeros((DIMENSIONS + 1) * (DIMENSIONS + 2))).reshape(DIMENSIONS + 1, -1)
    n = total[-1, -2]
    if not n:
        return model
    ridge = RIDGE * n * np.eye(DIMENSIONS + 1)
    ridge[-1, -1] = 0
    model.weights = np.linalg.lstsq(total[:, :-1] + ridge, total[:, -1], rcond=None)[0]
    shared = spark.sparkContext.broadcast(model)

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(shared.value.bins(_matrix(batch.column(0)))), batch.column(1)], names=["bin", "y"])

    counts = rows.where(calibrate).select("x", "y").mapInArrow(binned, "bin long, y double").groupBy("bin").agg(F.sum("y").alias("good"), F.count("*").alias("n")).collect()
    good_, all_ = np.zeros(BINS), np.zeros(BINS)
    for r in counts:
        good_[r["bin"]], all_[r["bin"]] = r["good"], r["n"]
    if all_.any():
        model.levels = isotonic(good_, all_)
    return model


def scored(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each document row: doc_id, score (0 to 1)."""
    docs = checked(documents, "doc_id", "text").select(F.col("doc_id").cast("long"), "text")
    stats = written(arrow_map(docs, _counted, STATISTICS), "statistics")
    marks = checked(labels, "doc_id", "quality").where("quality in (0, 1)").select(F.col("doc_id").cast("long"), F.col("quality").cast("double").alias("y"))
    rows = written(stats.where(~held_out(F.col("doc_id"))).join(marks, "doc_id").select("doc_id", "x", "y"), "labelled")
    shared = documents.sparkSession.sparkContext.broadcast(fit(rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.clip(shared.value.score(_matrix(batch.column(1))), 0, 1))], schema=SCORED)

    return arrow_map(stats, run, SCORED)


def op8(documents: DataFrame, labels: DataFrame) -> DataFrame:
    return scored(documents, labels).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
