"""What is kept over queries, until something that it depends on changes: frames of predicates, and answers by call pattern."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame

from .terms import Key, Literal, meet


@dataclass(frozen=True)
class Report:
    """What an invalidation cleared: predicates whose frames went, how many frames are left, and answers that went."""

    cleared: tuple[Key, ...] = ()
    left: int = 0
    answers: tuple[Literal, ...] = ()

    @property
    def count(self) -> int:
        return len(self.cleared)


@dataclass
class Answer:
    frame: DataFrame
    stored: DataFrame | None = None

    def store(self) -> None:
        """Keep the rows, in memory or on disk, once they are computed; rows that an executor loses are computed again."""
        if self.stored is None:
            self.stored = self.frame.persist(StorageLevel.MEMORY_AND_DISK)
            self.frame = self.stored.select(*self.stored.columns)  # a frame that has run keeps the plan with which it did


@dataclass
class Cache:
    """frames: plans by predicate. answers: by variant of the literal that was asked; hits counts how often one served again."""

    frames: dict[Key, DataFrame] = field(default_factory=dict)
    answers: dict[Literal, Answer] = field(default_factory=dict)
    hits: int = 0

    def __len__(self) -> int:
        return len(self.frames)

    def find(self, variant: Literal) -> DataFrame | None:
        """The answer of an earlier query; its rows are stored from now on."""
        answer = self.answers.get(variant)
        if answer is None:
            return None
        self.hits += 1
        answer.store()
        return answer.frame

    def keep(self, variant: Literal, frame: DataFrame, store: bool) -> None:
        self.answers[variant] = Answer(frame)
        if store:
            self.answers[variant].store()

    def clear(self, patterns: Iterable[Literal]) -> Report:
        """Forget frames of these predicates, and the answers that rows of these patterns may be among."""
        patterns = list(patterns)
        gone = tuple(sorted({p.key for p in patterns if p.key in self.frames}))
        for k in gone:
            del self.frames[k]
        answers = tuple(v for v in self.answers if any(p.key == v.key and meet(v, p) is not None for p in patterns))
        for v in answers:
            answer = self.answers.pop(v)
            if answer.stored is not None:
                answer.stored.unpersist()
        return Report(gone, len(self.frames), answers)
