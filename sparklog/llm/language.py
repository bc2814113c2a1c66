"""Language ID by hierarchical discrimination: first the family, then one-versus-one linear SVMs within it.

Features of a whole text: counts of byte pairs and triples within words (A-Z folded, other ASCII that isn't a letter is
a space), hashed to ``DIMENSIONS``, square roots, scaled to length one. A linear SVM (squared hinge, classes weighted
equally) stands between every two families, and between every two languages of one family; each votes with its
probability, a logistic of its margin. A language without an entry in ``FAMILIES`` is a family of its own.

The models are fitted on the driver on a sample of the labelled rows of the learning folds, about ``SAMPLE`` of each
language, chosen by a hash of doc_id; counts of languages cover all rows. Predictions read the text only.

Null texts and texts without a letter are ``und`` with score 0; so is everything if nothing was labelled. Rows that repeat
get equal predictions; a null doc_id is held out of learning. Other columns are left aside.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import arrow_map, arrow_schema, checked, release, text_slices

#: Families of languages by code; of those that share a writing system, relatives are hardest to tell apart.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb yi",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz tt",
    "celtic": "ga cy gd br",
    "baltic": "lt lv",
}
FAMILY_OF = {code: name for name, codes in FAMILIES.items() for code in codes.split()}
SAMPLE, DIMENSIONS = 800, 4096
#: Texts whose features are held at a time, and the least score of a document that known_language keeps.
ROWS, LEAST = 256, 0.35
UNKNOWN = "und"

_LETTERS = np.full(256, 0x20, np.uint8)
_LETTERS[0x61:0x7B], _LETTERS[0x80:] = np.arange(0x61, 0x7B), np.arange(0x80, 0x100)
_LETTERS[0x41:0x5B] = np.arange(0x61, 0x7B)

FEATURES = arrow_schema(lang=pa.string(), key=pa.int64(), x=pa.binary())
PREDICTED = arrow_schema(doc_id=pa.int64(), lang_pred=pa.string(), score=pa.float64())


def features(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    n = len(off) - 1
    line = np.insert(_LETTERS[raw], np.repeat(off, 2), 0x20)  # two spaces before each text and at the end
    of = np.repeat(np.arange(n), np.diff(off) + 2)
    x = line.astype(np.uint32)
    pair = x[: len(of)] * np.uint32(0x9E3779B1) ^ x[1 : len(of) + 1] * np.uint32(0x85EBCA6B)
    last = np.append(x[2 : len(of) + 2], np.uint32(0x20))[: len(of)]
    triple = (pair ^ (pair >> np.uint32(15))) * np.uint32(0x2C1B3C6D) ^ last * np.uint32(0xC2B2AE35)
    shift = np.uint32(33 - DIMENSIONS.bit_length())
    letters = (line != 0x20).astype(np.int8)
    out = np.zeros((n, DIMENSIONS), np.float32)
    for code, use in ((pair, letters[: len(of)] + letters[1 : len(of) + 1] > 0), (triple, letters[1 : len(of) + 1] > 0)):
        code = (code ^ (code >> np.uint32(13))) * np.uint32(0x297A2D39) >> shift
        out += np.bincount(of[use] * DIMENSIONS + code[use], minlength=n * DIMENSIONS).reshape(n, -1)
    np.sqrt(out, out=out)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def svm(x: np.ndarray, y: np.ndarray, penalty: float = 1e-4, rounds: int = 150) -> np.ndarray:
    """Weights of a linear SVM by accelerated descent, the intercept last; y is 1 or -1."""
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(x.dtype)
    w = at = np.zeros(x.shape[1] + 1, x.dtype)
    step, t = 1 / (penalty + 4), 1.0
    for _ in range(rounds):
        pull = share * y * np.maximum(0, 1 - y * (x @ at[:-1] + at[-1]))
        new = at - step * (penalty * at - 2 * np.append(pull @ x, pull.sum()))
        t, before = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        at = new + (before - 1) / t * (new - w)
        w = new
    return w


class Model:
    """SVMs between families, and between the languages of each."""

    def __init__(self, x: np.ndarray, langs: list[str], family_of: dict[str, str] | None = None) -> None:
        of = FAMILY_OF if family_of is None else family_of
        family = [of.get(lang, lang) for lang in langs]
        self.families = sorted(set(family))
        self.langs = {f: sorted({a for a, b in zip(langs, family) if b == f}) for f in self.families}
        self.between = self._pairs(x, family, self.families)
        self.within = {f: self._pairs(x, langs, self.langs[f]) for f in self.families}

    @staticmethod
    def _pairs(x: np.ndarray, labels: list[str], names: list[str]) -> list[tuple[int, int, np.ndarray]]:
        of = np.array(labels, object)
        out = []
        for i, j in itertools.combinations(range(len(names)), 2):
            use = (of == names[i]) | (of == names[j])
            out.append((i, j, svm(x if use.all() else x[use], np.where(of[use] == names[i], 1, -1).astype(x.dtype))))
        return out

    @staticmethod
    def _votes(x: np.ndarray, pairs: list[tuple[int, int, np.ndarray]], n: int) -> tuple[np.ndarray, np.ndarray]:
        """The winner of each row among n, and its mean probability against the others."""
        votes = np.full((len(x), n), 1.0 if n == 1 else 0.0)
        for i, j, w in pairs:
            p = 1 / (1 + np.exp(-np.clip(4 * (x @ w[:-1] + w[-1]), -30, 30)))
            votes[:, i] += p / (n - 1)
            votes[:, j] += (1 - p) / (n - 1)
        best = votes.argmax(axis=1)
        return best, votes[np.arange(len(x)), best]

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        family, score = self._votes(x, self.between, len(self.families))
        out = np.empty(len(x), object)
        for k, name in enumerate(self.families):
            use = np.flatnonzero(family == k)
            if len(use):
                best, p = self._votes(x[use], self.within[name], len(self.langs[name]))
                out[use] = np.array(self.langs[name], object)[best]
                score[use] = score[use] * p
        return out, score


def has_letter(raw: np.ndarray) -> bool:
    lower = raw | 0x20
    if ((lower >= 0x61) & (lower <= 0x7A)).any():
        return True
    return bool((raw >= 0x80).any()) and any(c.isalpha() for c in raw.tobytes().decode(errors="replace"))


def held_out(doc_id):
    """The fold that nothing is learnt from; a null doc_id belongs to it."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, raw, off in text_slices(batch, "text", rows=ROWS):
            x = features(raw, off).astype(np.float16)
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array([r.tobytes() for r in x], pa.binary())], schema=FEATURES)


def fit(documents: DataFrame, sample: int = SAMPLE, family_of: dict[str, str] | None = None) -> Model | None:
    """Learn from labelled rows that aren't held out; about ``sample`` rows of each language reach the driver."""
    docs = checked(documents, "doc_id", "text", "lang").where("lang is not null and text is not null").where(~held_out(F.col("doc_id")))
    counts = {r["lang"]: r["count"] for r in docs.groupBy("lang").count().collect()}
    if not counts:
        return None
    share = F.create_map(*(F.lit(v) for k, n in counts.items() for v in (k, min(1.0, sample / n))))
    chance = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    chosen = docs.where(chance < share[F.col("lang")]).select("lang", F.col("doc_id").cast("long").alias("key"), "text")
    table = arrow_map(chosen, _sampled, FEATURES).toArrow().sort_by([("lang", "ascending"), ("key", "ascending"), ("x", "ascending")]).combine_chunks()
    if not table.num_rows:
        return None
    langs, x = table["lang"].to_pylist(), np.empty((table.num_rows, DIMENSIONS), np.float32)
    for i, row in enumerate(table["x"]):  # one copy of the sample, not one for each form that it takes
        x[i] = np.frombuffer(row.as_buffer(), np.float16)
    del table
    release()
    model = Model(x, langs, family_of)
    del x
    release()
    return model


def _predicted(rows: pa.RecordBatch, raw: np.ndarray, off: np.ndarray, model: Model | None) -> tuple[np.ndarray, np.ndarray]:
    langs, score = np.full(rows.num_rows, UNKNOWN, object), np.zeros(rows.num_rows)
    known = np.array([has_letter(raw[a:b]) for a, b in zip(off[:-1], off[1:])], bool)
    if model is not None and known.any():
        langs[known], score[known] = model.predict(features(raw, off)[known])
    return langs, score


def predict(documents: DataFrame, model: Model | None) -> DataFrame:
    """A row for each document row: doc_id, lang_pred, score."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, raw, off in text_slices(batch, "text", rows=ROWS):
                langs, score = _predicted(rows, raw, off, shared.value)
                yield pa.RecordBatch.from_arrays([rows.column(0).cast(pa.int64()), pa.array(langs.tolist(), pa.string()), pa.array(score)], schema=PREDICTED)

    docs = checked(documents, "doc_id", "text").select(F.col("doc_id").cast("long"), "text")
    return arrow_map(docs, run, PREDICTED)


def op5(documents: DataFrame) -> DataFrame:
    return predict(documents, fit(documents)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def known_language(documents: DataFrame, least: float = LEAST) -> DataFrame:
    """The documents, with all their columns, whose language is found with at least that score; where nothing is labelled and
    so no language can be told, all that have a letter. Nothing is shuffled."""
    shared = documents.sparkSession.sparkContext.broadcast(fit(documents))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, raw, off in text_slices(batch, "text", rows=ROWS):
                langs, score = _predicted(rows, raw, off, shared.value)
                if shared.value is None:
                    keep = [has_letter(raw[a:b]) for a, b in zip(off[:-1], off[1:])]
                else:
                    keep = ((langs != UNKNOWN) & (score >= least)).astype(bool)
                yield rows.filter(pa.array(keep, pa.bool_()))

    return arrow_map(documents, run, documents.schema)
