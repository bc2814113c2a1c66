"""Token ids in length-delimited binary records, with an index of offsets beside them.

A record is framed as in the TFRecord format: the payload's length (u64), the length's masked CRC-32C, the payload,
the payload's masked CRC-32C, all little-endian. A payload is a document's ids, as u2 or u4. Shards hold ranges of
doc_id, in order. Beside each shard, an index of fixed rows (doc_id i8, byte offset u8, count of ids u8) lets a reader
fetch any record, in any order, without a scan. A shard and its index are one attempt's own: their name holds the
attempt, and the row that the attempt returns tells which pair counts. What attempts that failed, or ran besides, have
left is removed at the end, and is never read.

Null and empty texts give a record with the end id alone. Rows that repeat a doc_id, in the order of a hash of their texts, and a
null doc_id (first, written as the least integer, marked in the index) keep a record each; shards may part them. Other columns are left aside.
An empty table gives no shard. Ids of the tokenizer must fit the width.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, arrow_schema, checked, new_folder, spread
from .encode import encoder

NULL_ID = -(1 << 63)
#: Bytes of documents, as they are stored, for which there is a shard of their own.
SHARD_BYTES = 128 << 20
INDEX = np.dtype([("doc_id", "<i8"), ("offset", "<u8"), ("count", "<u8")])
SHARDS = arrow_schema(shard=pa.int64(), path=pa.string(), low=pa.int64(), n_docs=pa.int64(), n_ids=pa.int64(), width=pa.int32())
RECORDS = arrow_schema(doc_id=pa.int64(), start=pa.int64(), ids=pa.binary())


def _tables(poly: int) -> np.ndarray:
    """table[k][b]: what byte b at place k of a little-endian 32-bit word does to a zero register, over 4 bytes."""
    one = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        one = np.where(one & 1, (one >> 1) ^ np.uint32(poly), one >> 1).astype(np.uint32)
    out = [one]
    for _ in range(3):
        out.append(one[out[-1] & 0xFF] ^ (out[-1] >> 8))
    return np.array(out[::-1])


_CRC = _tables(0x82F63B78)


def _word(x: np.ndarray) -> np.ndarray:
    """The register 4 bytes on, whose first 4 bytes were xored in already."""
    return _CRC[0][x & 0xFF] ^ _CRC[1][(x >> 8) & 0xFF] ^ _CRC[2][(x >> 16) & 0xFF] ^ _CRC[3][x >> 24]


def _halves(f) -> tuple[np.ndarray, np.ndarray]:
    """A linear map of 32-bit registers as two tables of 16 bits each."""
    x = np.arange(1 << 16, dtype=np.uint32)
    return f(x), f(x << np.uint32(16))


_SKIP = [_halves(_word)]
for _ in range(31):
    _a, _b = _SKIP[-1]
    _SKIP.append(_halves(lambda x, a=_a, b=_b: (lambda y: a[y & 0xFFFF] ^ b[y >> 16])(a[x & 0xFFFF] ^ b[x >> 16])))


def _skip(x: np.ndarray, k: int) -> np.ndarray:
    """The register after 2**k words of zeros."""
    a, b = _SKIP[k]
    return a[x & 0xFFFF] ^ b[x >> 16]


def crc32c(items: list[bytes]) -> np.ndarray:
    """The CRC-32C of each item. The register is linear in the bytes: words' parts are joined pairwise, all items at once.

    Items of alike length (up to a power of two) form a table, with zeros before them, which leave a zero register as it is.
    """
    sizes = np.array([len(x) for x in items], np.int64)
    out = np.zeros(len(items), np.uint32)
    words = np.maximum((sizes + 3) // 4, 1)
    level = np.ceil(np.log2(words)).astype(int)
    for k in np.unique(level):
        mine, width = np.flatnonzero(level == k), 4 << int(k)
        for part in np.array_split(mine, max(1, len(mine) * width // (8 << 20))):
            table = np.frombuffer(b"".join(items[i].rjust(width, b"\0") for i in part), "<u4").reshape(len(part), -1)
            x = _word(table)
            for step in range(int(k)):
                x = _skip(x[:, ::2], step) ^ x[:, 1::2]
            out[part] = x[:, 0]
    # The register starts with all bits set: what these become over the item's bytes.
    first = np.full(len(items), 0xFFFFFFFF, np.uint32)
    for k in range(int(sizes.max(initial=0) // 4).bit_length()):
        on = (sizes // 4 >> k) & 1 == 1
        first[on] = _skip(first[on], k)
    for i in range(3):
        on = sizes % 4 > i
        first[on] = _CRC[3][first[on] & 0xFF] ^ (first[on] >> 8)
    return out ^ first ^ np.uint32(0xFFFFFFFF)


def masked(crc: np.ndarray) -> np.ndarray:
    """Rotated by 15 and shifted by a constant, so that a checksum of data with checksums isn't special."""
    return ((crc >> np.uint32(15)) | (crc << np.uint32(17))) + np.uint32(0xA282EAD8)


def frames(payloads: list[bytes]) -> list[bytes]:
    lengths = [len(p).to_bytes(8, "little") for p in payloads]
    heads, tails = masked(crc32c(lengths)), masked(crc32c(payloads))
    return [b"".join((n, int(h).to_bytes(4, "little"), p, int(t).to_bytes(4, "little"))) for n, h, p, t in zip(lengths, heads, payloads, tails)]


def payloads(raw: bytes, offsets: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """The payloads of frames at these offsets, whose payloads have these sizes; ValueError if anything differs."""
    heads = [raw[o : o + 8] for o in offsets.tolist()]
    out = [raw[o + 12 : o + 12 + n] for o, n in zip(offsets.tolist(), sizes.tolist())]
    if any(int.from_bytes(h, "little") != n for h, n in zip(heads, sizes.tolist())) or any(len(p) != n for p, n in zip(out, sizes.tolist())):
        raise ValueError("a record's length differs from its index")
    sums = [np.frombuffer(b"".join(raw[o + a : o + a + 4] for o, a in zip(offsets.tolist(), at)), "<u4") for at in ([8] * len(out), (sizes + 12).tolist())]
    if (masked(crc32c(heads)) != sums[0]).any() or (masked(crc32c(out)) != sums[1]).any():
        raise ValueError("a record's checksum is wrong")
    return out


def filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _writer(folder: str, path: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc = encoder(path)
        shard = TaskContext.get().partitionId()
        files, root = filesystem(folder)
        name = f"{shard:06d}-{uuid.uuid4().hex}"
        at, index, n_ids = 0, [], 0
        out = None
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                rows = batch.slice(i, 256)
                ids = enc.encode(rows.column(1).to_pylist(), end)
                done = frames([x.tobytes() for x in ids])
                part = np.zeros(len(ids), INDEX)
                part["doc_id"] = rows.column(0).cast(pa.int64()).fill_null(NULL_ID).to_numpy()
                sizes = np.array([len(x) for x in done])
                part["offset"], part["count"] = at + np.cumsum(sizes) - sizes, [len(x) for x in ids]
                at += int(sizes.sum())
                n_ids += int(part["count"].sum())
                index.append(part.tobytes())
                if out is None:
                    out = files.open_output_stream(f"{root}/{name}.rec")
                out.write(b"".join(done))
        if out is None:
            return
        out.close()
        rows = b"".join(index)
        with files.open_output_stream(f"{root}/{name}.idx") as f:
            f.write(rows)
        yield pa.RecordBatch.from_pylist([{"shard": shard, "path": f"{folder}/{name}", "low": 0, "n_docs": len(rows) // INDEX.itemsize, "n_ids": n_ids, "width": enc.dtype.itemsize}], schema=SHARDS)

    return run


def shards_for(documents: DataFrame) -> int:
    """As many shards as the stored size of the documents asks for, where it is known, and the session's partitions at least."""
    size = int(documents._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return max(spread(documents), -(-size // SHARD_BYTES) if size < 1 << 60 else 0)


def write_records(documents: DataFrame, tokenizer: str, end: int, folder: str | None = None) -> DataFrame:
    """Encode and write all documents; a row for each shard: shard, path, low (ids in the shards before it), n_docs, n_ids, width.

    Documents are range-partitioned by doc_id and a hash of the text. The driver sees one row for each shard.
    """
    spark = documents.sparkSession
    folder = folder or new_folder(spark, "records")
    files, root = filesystem(folder)
    files.create_dir(root, recursive=True)
    docs = checked(documents, "doc_id", "text").select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("h"))
    ordered = docs.repartitionByRange(shards_for(docs), "doc_id", "h").sortWithinPartitions("doc_id", "h")
    rows, low = [], 0
    for r in sorted(arrow_map(ordered, _writer(folder, tokenizer, end), SHARDS).collect(), key=lambda r: r["shard"]):
        rows.append((*(r[c] for c in ("shard", "path")), low, r["n_docs"], r["n_ids"], r["width"]))
        low += r["n_ids"]
    remove_others(folder, {r[1].rsplit("/", 1)[1] for r in rows})
    kinds = {pa.int64(): T.LongType(), pa.string(): T.StringType(), pa.int32(): T.IntegerType()}
    return spark.createDataFrame(rows, T.StructType([T.StructField(f.name, kinds[f.type]) for f in SHARDS]))


def remove_others(folder: str, names: set[str]) -> None:
    """Remove the files of a folder that no shard has."""
    from pyarrow import fs

    files, root = filesystem(folder)
    for info in files.get_file_info(fs.FileSelector(root)):
        if info.base_name.rsplit(".", 1)[0] not in names:
            files.delete_file(info.path)


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for shard in batch.to_pylist():
            files, name = filesystem(shard["path"])
            with files.open_input_file(f"{name}.idx") as f:
                index = np.frombuffer(f.read(), INDEX)
            dtype, start = np.dtype(f"<u{shard['width']}"), shard["low"]
            with files.open_input_file(f"{name}.rec") as f:
                i = 0
                while i < len(index):
                    base = int(index["offset"][i])
                    j = max(i + 1, int(np.searchsorted(index["offset"], base + (4 << 20))))
                    part = index[i:j]
                    sizes = part["count"].astype(np.int64) * dtype.itemsize
                    f.seek(base)
                    raw = f.read(int(part["offset"][-1]) - base + int(sizes[-1]) + 16)
                    ids = [np.frombuffer(p, dtype).astype("<u4").tobytes() for p in payloads(raw, part["offset"].astype(np.int64) - base, sizes)]
                    counts = part["count"].astype(np.int64)
                    starts = start + np.cumsum(counts) - counts
                    start += int(counts.sum())
                    doc = pa.array(part["doc_id"], mask=part["doc_id"] == NULL_ID)
                    yield pa.RecordBatch.from_arrays([doc, pa.array(starts), pa.array(ids, pa.binary())], schema=RECORDS)
                    i = j


def read_records(shards: DataFrame) -> DataFrame:
    """The records of all shards, tested: doc_id, start (ids of all documents before it), ids (little-endian u4)."""
    n = max(1, shards.count())
    return arrow_map(shards.repartition(n, "shard"), _reader, RECORDS)


def read_record(shard: dict, place: int) -> tuple[int | None, np.ndarray]:
    """One document of a shard, by its place, through the index: (doc_id, ids). For readers in a shuffled order."""
    files, name = filesystem(shard["path"])
    with files.open_input_file(f"{name}.idx") as f:
        f.seek(place * INDEX.itemsize)
        row = np.frombuffer(f.read(INDEX.itemsize), INDEX)[0]
    size = int(row["count"]) * shard["width"]
    with files.open_input_file(f"{name}.rec") as f:
        f.seek(int(row["offset"]))
        (ids,) = payloads(f.read(size + 16), np.zeros(1, np.int64), np.array([size]))
    return None if row["doc_id"] == NULL_ID else int(row["doc_id"]), np.frombuffer(ids, np.dtype(f"<u{shard['width']}"))


def op1(documents: DataFrame, tokenizer: str, end: int = 2) -> DataFrame:
    read = read_records(write_records(documents, tokenizer, end))
    return read.select("doc_id", "start", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
