"""Token ids as binary shards: blocks of ids transposed into byte or bit planes, each plane compressed with
zstandard, with a chunk index beside them.

The format. A store is a Parquet folder, so that Spark's committer publishes it whole and any store that
Spark writes to can hold it. Each row is a chunk: whole documents in ascending doc_id order, at least
`CHUNK_IDS` ids together (a longer document makes a longer chunk). A chunk holds

* its place: `shard` (number of the range of documents), `chunk` (number within the shard), `first` (ids of
  the shard before it);
* its documents: `doc_ids` and `doc_lengths`;
* its blocks: ids in fixed blocks of `BLOCK_IDS`, each transposed into planes. `planes` are the compressed
  planes, block by block, and `index` the end of each plane in `planes`. A plane of zeros only is empty.

Byte planes put the k-th bytes of all ids of a block together, bit planes the k-th bits.

Defined results: a null text is an empty one (its only id is the end id); repeated rows and rows that share
a doc_id each have their own ids, ordered by text; a null doc_id comes first; an empty table gives an empty
store and no rows; other columns are ignored; a text of any length is stored whole.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomlog.llm.shared import portions
from loomlog.llm.tokens import ENCODE_BYTES, VOCABULARY, encode, tokenizer

END_ID = 2
BLOCK_IDS = 1 << 14
CHUNK_IDS = 1 << 18
LEVEL = 3
STORE = "shard int, chunk long, first long, n_ids long, kind string, doc_ids array<bigint>, doc_lengths array<bigint>, index array<int>, planes binary"
PACKED = "doc_id long, tie long, row long, range int, n int, ids binary"
Key = tuple[bool, int, int, int]  # has a doc_id, doc_id, hash of the text, number of the row


def to_planes(ids: np.ndarray, kind: str) -> list[np.ndarray]:
    """The planes of one block, lowest first."""
    octets = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if kind == "byte":
        return [np.ascontiguousarray(octets[:, k]) for k in range(4)]
    bits = np.unpackbits(octets, axis=1, bitorder="little")
    return [np.packbits(bits[:, k], bitorder="little") for k in range(32)]


def from_planes(planes: list[np.ndarray], n: int, kind: str) -> np.ndarray:
    if kind == "byte":
        return np.stack(planes, axis=1).reshape(-1).view("<u4")
    bits = np.stack([np.unpackbits(x, count=n, bitorder="little") for x in planes], axis=1)
    return np.packbits(bits, axis=1, bitorder="little").reshape(-1).view("<u4")


def compress(ids: np.ndarray, kind: str, block: int = BLOCK_IDS, level: int = LEVEL) -> tuple[list[int], bytes]:
    """The index (end of each plane) and the planes of all blocks."""
    packer = zstandard.ZstdCompressor(level=level)
    index, parts, end = [], [], 0
    for k in range(0, len(ids), block):
        for plane in to_planes(ids[k : k + block], kind):
            if plane.any():
                parts.append(packer.compress(plane.tobytes()))
                end += len(parts[-1])
            index.append(end)
    return index, b"".join(parts)


def expand(n: int, index: list[int], planes: bytes, kind: str, block: int = BLOCK_IDS) -> np.ndarray:
    """All ids of a chunk."""
    unpacker, count = zstandard.ZstdDecompressor(), 4 if kind == "byte" else 32
    out, begin = [], 0
    for k, at in enumerate(range(0, n, block)):
        size = min(block, n - at)
        width = size if kind == "byte" else -(-size // 8)
        own = []
        for end in index[k * count : (k + 1) * count]:
            own.append(np.frombuffer(unpacker.decompress(planes[begin:end]), np.uint8) if end > begin else np.zeros(width, np.uint8))
            begin = end
        out.append(from_planes(own, size, kind))
    return np.concatenate(out) if out else np.zeros(0, "<u4")


def _encode_task(batches: Iterator[pa.RecordBatch], path: str, end_id: int, begins: list[Key]) -> Iterator[pa.RecordBatch]:
    """PACKED rows: the ids of each text in two bytes each, or four if the vocabulary needs them; `range` is the last one that begins at its key or before."""
    kind = "<u2" if max(end_id, tokenizer(path)[0].get_vocab_size() - 1) < 1 << 16 else "<u4"
    width = np.dtype(kind).itemsize
    for batch in batches:
        texts, own = batch.column(3), [batch.column(k) for k in range(3)]
        ranges = [max(0, bisect_right(begins, (d is not None, d or 0, t, r)) - 1) for d, t, r in zip(*(x.to_pylist() for x in own), strict=True)]
        for lo, hi in portions(texts, ENCODE_BYTES):
            ids, at = encode(texts[lo:hi], path, end_id)
            held = pa.BinaryArray.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer((at * width).astype(np.int32)), pa.py_buffer(ids.astype(kind))])
            yield pa.RecordBatch.from_arrays([*(x[lo:hi] for x in own), pa.array(ranges[lo:hi], pa.int32()), pa.array(np.diff(at), pa.int32()), held], names=[x.split()[0] for x in PACKED.split(", ")])


def _write_task(batches: Iterator[pa.RecordBatch], kind: str, chunk_ids: int) -> Iterator[pa.RecordBatch]:
    shard, chunk, first = TaskContext.get().partitionId(), 0, 0
    held: list[np.ndarray] = []
    doc_ids: list[int | None] = []
    lengths: list[int] = []

    def row() -> pa.RecordBatch:
        nonlocal chunk, first, held, doc_ids, lengths
        ids = np.concatenate(held)
        index, planes = compress(ids, kind)
        out = pa.RecordBatch.from_arrays(
            [pa.array([shard], pa.int32()), pa.array([chunk], pa.int64()), pa.array([first], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([kind]), pa.array([doc_ids], pa.list_(pa.int64())), pa.array([lengths], pa.list_(pa.int64())), pa.array([index], pa.list_(pa.int32())), pa.array([planes], pa.binary())],
            names=[x.split()[0] for x in STORE.split(", ")],
        )
        chunk, first, held, doc_ids, lengths = chunk + 1, first + len(ids), [], [], []
        return out

    ready = 0
    for batch in batches:
        for doc_id, n, octets in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            ids = np.frombuffer(octets.as_buffer(), f"<u{octets.as_buffer().size // n}").astype("<u4")  # a copy: the batch may go
            doc_ids.append(doc_id)
            lengths.append(n)
            held.append(ids)
            ready += n
            if ready >= chunk_ids:
                yield row()
                ready = 0
    if held:
        yield row()


def write_tokens(docs: DataFrame, path: str, vocabulary: str = VOCABULARY, end_id: int = END_ID, kind: str = "byte", chunk_ids: int = CHUNK_IDS) -> None:
    """Writes the ids of all documents, in ascending doc_id order, as a store at `path`.

    Texts are encoded where they are read; what is shuffled, once, are their ids, two bytes each. Rows are dealt to ranges
    of (doc_id, hash of the text, number of the row), as many as the session has shuffle partitions, so rows that
    share a doc_id, or are alike, don't have to meet in one task. Where ranges begin is found on the keys alone.
    """
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = (F.col("doc_id").asc_nulls_first(), F.col("tie"), F.col("row"))
    rows = docs.select("doc_id", F.xxhash64("text").alias("tie"), F.monotonically_increasing_id().alias("row"), "text")
    key = F.struct(F.col("doc_id").isNotNull().alias("known"), F.coalesce("doc_id", F.lit(0)).alias("doc_id"), "tie", "row")
    first = rows.select("doc_id", "tie", "row").repartitionByRange(n, *keys).groupBy(F.spark_partition_id().alias("range")).agg(F.min(key).alias("k"))
    begins = sorted(tuple(r["k"]) for r in first.collect())  # one a range
    packed = rows.mapInArrow(lambda batches: _encode_task(batches, vocabulary, end_id, begins), PACKED)
    ordered = packed.repartitionById(max(1, len(begins)), F.col("range")).sortWithinPartitions(*keys)
    ordered.select("doc_id", "n", "ids").mapInArrow(lambda batches: _write_task(batches, kind, chunk_ids), STORE).write.option("compression", "none").parquet(path)


def _read_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for x in batch.to_pylist():
            ids = expand(x["n_ids"], x["index"], x["planes"], x["kind"])
            ends = np.cumsum(np.array(x["doc_lengths"], np.int64))
            begins = ends - x["doc_lengths"]
            crc = [zlib.crc32(ids[b:e]) for b, e in zip(begins, ends, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(x["doc_ids"], pa.int64()), pa.array(begins + x["before"] + x["first"]), pa.array(x["doc_lengths"], pa.int64()), pa.array(crc, pa.int64())],
                names=["doc_id", "start", "n_tokens", "ids_crc32"],
            )


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Reads a store back: per document its place among the ids of all, its length and the crc32 of its ids.

    The chunk index (one row per shard after a sum) is broadcast: it has as many rows as the store has files.
    """
    store = spark.read.schema(STORE).parquet(path)
    shards = store.groupBy("shard").agg(F.sum("n_ids").alias("ids"))
    before = shards.select("shard", (F.sum("ids").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1))).alias("before")).fillna(0)
    placed = store.join(F.broadcast(before), "shard").select("first", "before", "n_ids", "kind", "doc_ids", "doc_lengths", "index", "planes")
    return placed.mapInArrow(_read_task, "doc_id long, start long, n_tokens long, ids_crc32 long")
