"""A Datalog engine on DataFrames: facts, rules with recursion and stratified negation, and sources of any kind."""

from .engine import Engine, Sweeper
from .errors import DatalogError, NoFixpoint, NotStratified, ParseError, UnsafeClause
from .parser import parse
from .plans.evaluate import Options
from .terms import Ask, Assert, C, Clause, Command, Const, InSet, L, Literal, Negate, Retract, V, Var

__all__ = ["Ask", "Assert", "C", "Clause", "Command", "Const", "DatalogError", "Engine", "InSet", "L", "Literal", "Negate", "NoFixpoint", "NotStratified", "Options", "ParseError", "Retract", "Sweeper", "UnsafeClause", "V", "Var", "parse"]
