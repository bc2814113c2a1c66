"""Related-document packing: a nearest-neighbour graph, greedy paths that start at low degrees, windows along the paths.

1. Each document is encoded once and stored with a sketch: the least hash of its id pairs in each of 16 bins.
2. Graph: for each of 8 pairs of bins, all documents are sorted by the one bin's hash, then by the other's; each is linked
   with the 2 before it that share the first, weighted by the number of equal bins. Each document keeps its 4 nearest.
   Sorting by ranges that end in the row's number splits a group of any size over tasks, and no group lists its pairs.
3. Paths: at first each document is a path. In rounds, every path names the one at the other end of its strongest link (the
   nearest, of those the one with an end of the lowest degree), and the trees of these form cells of a few paths each. In a
   cell the greedy walk starts at the unvisited end of the lowest degree and goes on to the nearest unvisited neighbour, until
   there is none; what it goes through becomes one path. When few links between ends of different paths are left, they
   are one cell. What a task holds doesn't grow with the input, and no document is cut off from its links by a border. A
   round leaves about a quarter of the links or less; its links and joints are written tables.
4. Windows: documents lie along the paths, one path after the other, as one line of ids that is cut every ``length`` ids. Only the
   last sequence can be short, so padding is below one sequence, however many documents or paths there are.

Null and empty texts are one end id. Rows that repeat are documents of their own; a null doc_id is kept. Other columns
are left aside. An empty table gives no pieces.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import arrow_map, arrow_schema, checked, drop_written, written
from .encode import encoder

LENGTH, END = 4096, 2
BINS, TABLES, BEFORE, NEAREST = 16, 8, 2, 4
#: Links that one task's walk holds, and documents that one task places.
WALK, PLACE = 10_000, 1_000_000

TOKENS = arrow_schema(row=pa.int64(), doc_id=pa.int64(), n=pa.int64(), ids=pa.binary(), width=pa.int32(), sketch=pa.list_(pa.int32()))
KEYS = arrow_schema(table=pa.int32(), first=pa.int32(), second=pa.int32(), row=pa.int64(), bins=pa.binary())
EDGES = arrow_schema(a=pa.int64(), b=pa.int64(), near=pa.int32())
LINKS = arrow_schema(a=pa.int64(), b=pa.int64(), near=pa.int32(), degree=pa.int32())
JOINTS = arrow_schema(path=pa.int64(), new=pa.int64(), sign=pa.int64(), plus=pa.int64(), n=pa.int64())
PLACED = arrow_schema(row=pa.int64(), block=pa.int64(), before=pa.int64(), n=pa.int64())
PIECES = arrow_schema(doc_id=pa.int64(), start=pa.int64(), length=pa.int64(), doc_tokens=pa.int64(), sequence_id=pa.int64(), offset=pa.int64(), ids=pa.binary())


def sketch(ids: list[np.ndarray]) -> np.ndarray:
    """For each document, the least hash of its neighbouring id pairs in each bin; an empty bin takes the next one's."""
    n = np.array([len(x) for x in ids])
    x = np.concatenate(ids).astype(np.uint64)
    pairs = W.mix(x[:-1] * np.uint64(0x9E3779B1) + x[1:])
    of = np.repeat(np.arange(len(ids)), n)
    same = of[:-1] == of[1:]
    pairs, of = pairs[same], of[:-1][same]
    empty = np.iinfo(np.int32).max
    out = np.full(len(ids) * BINS, empty, np.int32)
    np.minimum.at(out, of * BINS + (pairs & np.uint64(BINS - 1)).astype(np.int64), (pairs >> np.uint64(33)).astype(np.int32))
    out = out.reshape(-1, BINS)
    for _ in range(BINS - 1):
        if not (out == empty).any():
            break
        out = np.where(out == empty, np.roll(out, -1, axis=1), out)
    return out


def _encoded(path: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, row = encoder(path), TaskContext.get().partitionId() << 33
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                rows = batch.slice(i, 256)
                ids = enc.encode(rows.column(1).to_pylist(), end)
                s = sketch(ids)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.arange(row, row + len(ids))),
                        rows.column(0).cast(pa.int64()),
                        pa.array([len(x) for x in ids], pa.int64()),
                        pa.array([x.tobytes() for x in ids], pa.binary()),
                        pa.array(np.full(len(ids), enc.dtype.itemsize, np.int32)),
                        pa.ListArray.from_arrays(np.arange(0, len(ids) * BINS + 1, BINS, dtype=np.int32), pa.array(s.ravel())),
                    ],
                    schema=TOKENS,
                )
                row += len(ids)

    return run


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each document (row, sketch) a row in each table: two bins to sort by, and a byte of each bin."""
    for batch in batches:
        s = batch.column(1).flatten().to_numpy().reshape(-1, BINS)
        bins = np.ascontiguousarray((W.mix(s.astype(np.uint64)) >> np.uint64(56)).astype(np.uint8))
        raw = pa.FixedSizeBinaryArray.from_buffers(pa.binary(BINS), len(s), [None, pa.py_buffer(bins)]).cast(pa.binary())
        for table in range(TABLES):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), table, np.int32)), pa.array(s[:, 2 * table]), pa.array(s[:, 2 * table + 1]), batch.column(0), raw], schema=KEYS)


def _adjacent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of rows (table, first, row, bins) with the rows just before them that share table and first."""
    held: tuple[np.ndarray, ...] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = (*(batch.column(i).to_numpy() for i in range(3)), np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).reshape(-1, BINS))
        now = tuple(np.concatenate(x) for x in zip(held, now)) if held else now
        old = len(held[0]) if held else 0
        table, first, row, s = now
        for back in range(1, BEFORE + 1):
            at = np.arange(max(old, back), len(row))
            at = at[(table[at] == table[at - back]) & (first[at] == first[at - back]) & (row[at] != row[at - back])]
            if len(at):
                near = (s[at] == s[at - back]).sum(axis=1).astype(np.int32)
                for a, b in ((row[at], row[at - back]), (row[at - back], row[at])):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(near)], schema=EDGES)
        held = tuple(x[-BEFORE:] for x in now)


def _nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of edges in order of a, in both directions, the nearest of each a, once each, with the number of its neighbours."""

    def best(a: np.ndarray, b: np.ndarray, near: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((b, -near, a))
        a, b, near = a[order], b[order], near[order]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        a, b, near = a[new], b[new], near[new]
        first = np.flatnonzero(np.concatenate((np.ones(min(len(a), 1), bool), a[1:] != a[:-1])))
        degree = np.diff(np.append(first, len(a)))
        take = np.arange(len(a)) - np.repeat(first, degree) < NEAREST
        arrays = np.minimum(a, b), np.maximum(a, b), near, np.repeat(degree, degree).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(x[take]) for x in arrays], schema=LINKS)

    held: tuple[np.ndarray, ...] = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32))
    for batch in batches:
        now = tuple(np.concatenate((x, batch.column(i).to_numpy())) for i, x in enumerate(held))
        end = int(np.searchsorted(now[0], now[0][-1])) if len(now[0]) else 0
        held = tuple(x[end:] for x in now)  # the last a may go on
        if end:
            yield best(*(x[:end] for x in now))
    yield best(*held)


def paths(rows: list[int], edges: dict[int, list[tuple[int, int]]], across: dict[int, int] | None = None) -> list[list[int]]:
    """The greedy paths through all rows. edges: of a row, (nearness, other row); others that aren't here are passed over.

    across: of an end of a path, the other one; of these two rows, that by which the path is entered is given.
    """
    here, across = set(rows), across or {}
    out: list[list[int]] = []
    waiting = [(sum(b in here for _, b in edges.get(r, ())), r) for r in rows]
    heapq.heapify(waiting)
    while waiting:
        at: int | None = heapq.heappop(waiting)[1]
        if at in here:
            out.append([])
        while at is not None and at in here:
            far = across.get(at, at)
            here -= {at, far}
            out[-1].append(at)
            at = max(((near, -b) for near, b in edges.get(far, ()) if b in here), default=(0, None))[1]
            at = None if at is None else -at
    return out


def walk(rows: list[int], edges: dict[int, list[tuple[int, int]]]) -> list[int]:
    """All rows in order of the greedy paths."""
    return [r for path in paths(rows, edges) for r in path]


def _joints(links: list[tuple]) -> Iterator[tuple[int, int, int, int, int]]:
    """The joints of the paths that a cell's links walk through; each gets the smallest number in it."""
    edges: dict[int, list[tuple[int, int]]] = {}
    size: dict[int, int] = {}  # of a path; its ends are 2 * path, and 2 * path + 1 if it has another
    for s, path_a, tail_a, n_a, path_b, tail_b, n_b in links:
        a, b, near = 2 * path_a + tail_a, 2 * path_b + tail_b, s >> NEAR
        size[path_a], size[path_b] = n_a, n_b
        edges.setdefault(a, []).append((near, b))
        edges.setdefault(b, []).append((near, a))
    across = {2 * p + tail: 2 * p + 1 - tail for p, n in size.items() if n > 1 for tail in (0, 1)}
    for ends in paths([2 * p + tail for p, n in size.items() for tail in range(min(n, 2))], edges, across):
        if len(ends) > 1:
            new, before, n_new = min(ends) >> 1, 0, sum(size[e >> 1] for e in ends)
            for end in ends:
                n = size[end >> 1]
                yield (end >> 1, new, -1, before + n - 1, n_new) if end & 1 else (end >> 1, new, 1, before, n_new)
                before += n


def _walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links in order of their cells (the first column) to the joints of their paths."""
    cell, links, out = None, [], []
    for batch in batches:
        for now, *link in zip(*(batch.column(i).to_pylist() for i in range(8))):
            if now != cell:
                out += _joints(links)
                cell, links = now, []
            links.append(tuple(link))
        if len(out) > 1000:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], schema=JOINTS)
            out = []
    out += _joints(links)
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], schema=JOINTS)


#: A link's strength: nearness, then the lower degree of its ends (the lower the stronger), then a number of its own.
NEAR, LOW = 58, 53


def _strength(near, degree, number):
    """One number in which links are ordered; the last part, a bijection of the link's number, makes them all differ."""
    mask = F.lit((1 << LOW) - 1)
    for shift in (21, -17, 13, -29):
        moved = F.shiftleft(number, shift).bitwiseAND(mask) if shift > 0 else F.shiftright(number, -shift)
        number = number.bitwiseXOR(moved)
    return F.shiftleft(near.cast("long"), NEAR).bitwiseOR(F.shiftleft(F.lit(31) - F.least(degree, F.lit(31)).cast("long"), LOW)).bitwiseOR(number)


def _cells(links: DataFrame) -> DataFrame:
    """Links (all columns, cell_a, cell_b): cells are trees of paths and those that they name, to a depth of a few steps."""
    sides = links.select(F.col("path_a").alias("path"), "s", F.col("path_b").alias("other")).unionByName(links.select(F.col("path_b").alias("path"), "s", F.col("path_a").alias("other")))
    named = written(sides.groupBy("path").agg(F.max_by("other", "s").alias("up")), "named")

    def after(of: DataFrame, then: DataFrame) -> DataFrame:
        """Where one more step leads."""
        return of.join(then.select(F.col("path").alias("up"), F.col("up").alias("last")), "up").select("path", F.col("last").alias("up"))

    two = after(named, named)
    four = after(two, two)
    # The last two of a tree name each other: the smaller number stands for both.
    cells = four.join(named.select(F.col("path").alias("up"), F.col("up").alias("next")), "up").select("path", F.least("up", "next").alias("cell"))
    cells = written(cells, "cells")
    for side in "ab":
        links = links.join(cells.select(F.col("path").alias(f"path_{side}"), F.col("cell").alias(f"cell_{side}")), f"path_{side}")
    out = written(links, "links")
    drop_written(named)
    drop_written(cells)
    return out


def _moved(links: DataFrame, joints: DataFrame, side: str) -> DataFrame:
    """Links whose ends of that side are still ends after joints, with the paths and places they have then."""
    j = joints.select(F.col("path").alias(f"path_{side}"), "new", "sign", "plus", F.col("n").alias("_n"))
    df = links.join(j, f"path_{side}", "left")
    at = F.col("sign") * F.when(F.col(f"tail_{side}") == 1, F.col(f"n_{side}") - 1).otherwise(0) + F.col("plus")
    df = df.withColumn("_at", at).where("_at is null or _at = 0 or _at = _n - 1")
    df = df.withColumn(f"tail_{side}", F.when(F.col("_at").isNull(), F.col(f"tail_{side}")).otherwise((F.col("_at") > 0).cast("int")))
    df = df.withColumn(f"path_{side}", F.coalesce("new", f"path_{side}")).withColumn(f"n_{side}", F.coalesce("_n", f"n_{side}"))
    return df.select(links.columns)


def joints(graph: DataFrame, most: int = WALK) -> list[DataFrame]:
    """How paths are joined, round after round; a document is a path at first. At most ``most`` links are left to one task.

    graph: a, b, near, degree. A round's table has each path that is joined: its new number, and sign and plus, by which
    the place of a document in the path becomes sign * place + plus; n is the number of documents of the new path.
    """
    links = graph.groupBy("a", "b").agg(F.max("near").alias("near"), F.min("degree").alias("degree"))
    none, one = F.lit(0), F.lit(1).cast("long")
    s = _strength(F.col("near"), F.col("degree"), F.monotonically_increasing_id())
    left = written(links.select(s.alias("s"), F.col("a").alias("path_a"), none.alias("tail_a"), one.alias("n_a"), F.col("b").alias("path_b"), none.alias("tail_b"), one.alias("n_b")), "links")
    rounds: list[DataFrame] = []
    columns = left.columns
    while left.count() > most:
        old, links = left, _cells(left)
        same = links.where("cell_a = cell_b").select(F.col("cell_a").alias("cell"), *columns)
        rounds.append(written(arrow_map(same.repartition("cell").sortWithinPartitions("cell", "s"), _walked, JOINTS), "joints"))
        left = written(_moved(_moved(links.select(columns), rounds[-1], "a"), rounds[-1], "b").where("path_a <> path_b"), "links")
        drop_written(old)
        drop_written(links)
    rest = left.select(F.lit(0).cast("long").alias("cell"), *columns).coalesce(1).sortWithinPartitions("s")
    rounds.append(written(arrow_map(rest, _walked, JOINTS), "joints"))
    drop_written(left)
    return rounds


def composed(rounds: list[DataFrame]) -> DataFrame:
    """All rounds as one: path (a document at first), new, sign, plus. From the last round back, so that each join is of tables
    no larger than what is left of the paths then."""
    all_ = rounds[-1].select("path", "new", "sign", "plus")
    for early in rounds[-2::-1]:
        late = all_.select(F.col("path").alias("then"), F.col("new").alias("last"), F.col("sign").alias("turn"), F.col("plus").alias("more"))
        both = early.select("path", "new", "sign", "plus").join(late, F.col("new") == F.col("then"), "full")
        # A path that isn't in the early round came to the late one under its own number.
        sign, plus, turn, more = F.coalesce("sign", F.lit(1)), F.coalesce("plus", F.lit(0)), F.coalesce("turn", F.lit(1)), F.coalesce("more", F.lit(0))
        all_ = both.select(F.coalesce("path", "then").alias("path"), F.coalesce("last", "new").alias("new"), (sign * turn).alias("sign"), (turn * plus + more).alias("plus"))
    return all_


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (row, n) of a partition, in order, with the ids before them in it."""
    from pyspark import TaskContext

    block, before = TaskContext.get().partitionId(), 0
    for batch in batches:
        n = batch.column(1).to_numpy()
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(len(n), block, np.int64)), pa.array(before + np.cumsum(n) - n), batch.column(1)], schema=PLACED)
        before += int(n.sum())


def _cut(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[dict] = []
            for doc_id, raw, width, at in zip(*(batch.column(i).to_pylist() for i in range(4))):
                ids = np.frombuffer(raw, f"<u{width}").astype("<u4")
                start = 0
                while start < len(ids):
                    n = min(length - (at + start) % length, len(ids) - start)
                    out.append({"doc_id": doc_id, "start": start, "length": n, "doc_tokens": len(ids), "sequence_id": (at + start) // length, "offset": (at + start) % length, "ids": ids[start : start + n].tobytes()})
                    start += n
                if len(out) > 1000:
                    yield pa.RecordBatch.from_pylist(out, schema=PIECES)
                    out = []
            yield pa.RecordBatch.from_pylist(out, schema=PIECES)

    return run


def neighbours(tokens: DataFrame) -> DataFrame:
    """The graph, as links of each document to its nearest: a, b (a < b), near, degree. Links of both ends' choice are there twice."""
    order = ["table", "first", "second", "row"]
    keys = arrow_map(tokens.select("row", "sketch"), _keys, KEYS).repartitionByRange(*order).sortWithinPartitions(*order)
    # A row has at most 2 * BEFORE * TABLES links.
    edges = arrow_map(keys.select("table", "first", "row", "bins"), _adjacent, EDGES).repartition("a").sortWithinPartitions("a")
    return arrow_map(edges, _nearest, LINKS)


def packed(documents: DataFrame, tokenizer: str, length: int = LENGTH, end: int = END, most: int = WALK) -> DataFrame:
    """A row for each piece of a document: doc_id, start, length, doc_tokens, sequence_id, offset, ids (little-endian u4)."""
    spark = documents.sparkSession
    docs = checked(documents, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    tokens = written(arrow_map(docs, _encoded(tokenizer, end), TOKENS), "tokens")
    blocks = max(1, -(-tokens.count() // PLACE))
    moved = composed(joints(neighbours(tokens), most)).withColumnRenamed("path", "row")
    order = tokens.select("row", "n").join(moved, "row", "left").select("row", "n", F.coalesce("new", "row").alias("path"), F.coalesce("plus", F.lit(0)).alias("at"))
    order = order.repartitionByRange(blocks, "path", "at").sortWithinPartitions("path", "at").select("row", "n")
    placed = written(arrow_map(order, _placed, PLACED), "placed")
    sizes = placed.groupBy("block").agg(F.sum("n").alias("n")).orderBy("block").collect()  # one row for each block
    low, lows = 0, []
    for r in sizes:
        lows.append((r["block"], low))
        low += r["n"]
    placed = placed.join(F.broadcast(spark.createDataFrame(lows, "block long, low long")), "block").select("row", (F.col("low") + F.col("before")).alias("at"))
    return arrow_map(tokens.select("row", "doc_id", "ids", "width").join(placed, "row").select("doc_id", "ids", "width", "at"), _cut(length), PIECES)


def padding(pieces: DataFrame, length: int = LENGTH) -> DataFrame:
    """ids and padding over all sequences; one whose size is a power of two isn't padded."""
    n = F.sum("length").alias("n")
    full = pieces.groupBy("sequence_id").agg(n).withColumn("power", F.expr("n & (n - 1)") == 0)
    return full.agg(F.sum("n").alias("ids"), F.sum(F.when(F.col("power"), 0).otherwise(length - F.col("n"))).alias("padding"))


def op3(documents: DataFrame, tokenizer: str) -> DataFrame:
    pieces = packed(documents, tokenizer)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
