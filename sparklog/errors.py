"""Errors of programs and their evaluation."""

from __future__ import annotations


class DatalogError(ValueError):
    """A program, a query or a source is wrong."""


class ParseError(DatalogError):
    def __init__(self, message: str, line: int, column: int) -> None:
        super().__init__(f"line {line}, column {column}: {message}")
        self.line, self.column = line, column
        #: The commands before the one that is wrong.
        self.commands: list = []


class UnsafeClause(DatalogError):
    """A variable isn't bound, or a literal stands where it can't."""


class NotStratified(DatalogError):
    """A predicate depends on its own negation."""


class NoFixpoint(DatalogError):
    """The bound on rounds was met before the fixpoint."""
