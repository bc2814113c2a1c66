"""External relations: DataFrames, tables or callables under a predicate's name."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import DatalogError
from ..functions.canonical import equals, kind_of, native
from ..functions.encoders import Encoder
from ..terms import Key

Bindings = dict[int, str]
Supplier = Callable[[Bindings], DataFrame]


@dataclass
class External:
    """A source: rows with columns in the order of the predicate's arguments.

    on_null: "drop" leaves out rows with a null in one of the columns, "error" raises when one is read.
    A ttl in seconds makes what was read stale after that time.
    """

    name: str
    supplier: Supplier
    columns: Sequence[str]
    encoders: Mapping[str, Encoder] = field(default_factory=dict)
    on_null: str = "drop"
    ttl: float | None = None
    bound_calls: bool = False
    version: int = 0
    loaded: float | None = None
    frame: DataFrame | None = None

    @property
    def key(self) -> Key:
        return self.name, len(self.columns)

    def load(self, bindings: Bindings, now: float) -> DataFrame:
        if self.bound_calls and bindings:  # a source that wants the bound arguments is asked each time
            return self._whole(self.supplier(bindings))
        if self.frame is None:
            self.frame, self.loaded = self._whole(self.supplier({})), now
        return self.frame

    def _whole(self, df: DataFrame) -> DataFrame:
        if missing := [c for c in self.columns if c not in df.columns]:
            raise DatalogError(f"the source of {self.name} has no columns {missing}; it has {df.columns}")
        return df

    def forget(self) -> None:
        self.frame, self.loaded = None, None
        self.version += 1

    def stale(self, now: float) -> bool:
        return self.ttl is not None and self.loaded is not None and now - self.loaded >= self.ttl

    def kinds(self, now: float) -> list[str]:
        df = self.load({}, now)
        return ["string" if c in self.encoders else kind_of(df.schema[c].dataType) for c in self.columns]

    def rows(self, bindings: Bindings, now: float) -> DataFrame:
        """Columns c0, c1, ... in their kinds, of the rows whose arguments have the bound values."""
        df = self.load(bindings, now)
        col = {c: F.col(f"`{c}`") for c in self.columns}
        if self.on_null == "drop":
            for c in dict.fromkeys(self.columns):
                if df.schema[c].nullable:
                    df = df.where(col[c].isNotNull())
        for i, value in bindings.items():
            c = self.columns[i]
            dtype, encoder = df.schema[c].dataType, self.encoders.get(c)
            if encoder:
                df = df.where(encoder.equals(col[c], dtype, value))
            else:
                kind = kind_of(dtype)
                df = df.where(equals(native(col[c], dtype) if kind == "string" else col[c], kind, value))
        out = []
        for i, c in enumerate(self.columns):
            value = self.encoders[c].name(col[c]) if c in self.encoders else native(col[c], df.schema[c].dataType)
            if self.on_null == "error":
                value = F.coalesce(value, F.raise_error(F.lit(f"a null in column {c} of {self.name}")).cast(kind_of(df.schema[c].dataType) if c not in self.encoders else "string"))
            out.append(value.alias(f"c{i}"))
        return df.select(*out) if out else df.select(F.lit(True).alias("u"))


class Catalog:
    """All external relations; several may share a predicate, and are united."""

    def __init__(self, spark: SparkSession, clock: Callable[[], float] = time.monotonic) -> None:
        self.spark, self.clock = spark, clock
        self.externals: dict[Key, list[External]] = {}
        self.lock = threading.RLock()

    def register(
        self,
        name: str,
        source: DataFrame | Callable[..., DataFrame],
        columns: Sequence[str] | None = None,
        encoders: Mapping[str, Mapping[object, str] | Encoder] | None = None,
        on_null: str = "drop",
        ttl: float | None = None,
        bound_calls: bool = False,
    ) -> External:
        """A DataFrame, or a callable that gives one: without arguments, or with bound_calls of {place: constant}."""
        if on_null not in ("drop", "error"):
            raise DatalogError("on_null is drop or error")
        if isinstance(source, DataFrame):
            frame = source
            supplier: Supplier = lambda _: frame
            columns = source.columns if columns is None else columns
        else:
            call = source
            supplier = call if bound_calls else (lambda _: call())
            if columns is None:
                raise DatalogError("a callable source needs the names of its columns")
        coded = {c: e if isinstance(e, Encoder) else Encoder.of(e) for c, e in (encoders or {}).items()}
        if unknown := set(coded) - set(columns):
            raise DatalogError(f"encoders of {name} name other columns: {sorted(unknown)}")
        external = External(name, supplier, list(columns), coded, on_null, ttl, bound_calls)
        with self.lock:
            self.externals.setdefault(external.key, []).append(external)
        return external

    def parquet(self, name: str, path: str, columns: Sequence[str], **options) -> External:
        """A Parquet table, read when it is first asked for."""
        return self.register(name, lambda: self.spark.read.parquet(path), columns, **options)

    def jdbc(self, name: str, url: str, table: str, columns: Sequence[str], properties: Mapping[str, str] | None = None, partition: Mapping[str, object] | None = None, **options) -> External:
        """A table of a database; partition has column, lowerBound, upperBound and numPartitions for a parallel read."""
        return self.register(name, lambda: self.spark.read.jdbc(url, table, properties=dict(properties or {}), **dict(partition or {})), columns, **options)

    def of(self, key: Key) -> list[External]:
        return self.externals.get(key, [])

    def expired(self) -> list[Key]:
        """Keys of sources that are past their time; these are read anew when next asked for."""
        now = self.clock()
        out = []
        with self.lock:
            for key, sources in self.externals.items():
                for source in sources:
                    if source.stale(now):
                        source.forget()
                        out.append(key)
        return out
