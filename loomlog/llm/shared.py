"""What several of the training-data operators need: tables, shared scratch tables, Arrow text."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that a task works on at once (one longer document is still taken whole).
WORK_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Only a session on one machine (local, as in tests) that names none gets a temporary folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder; what is written there goes when the application ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(where.getParent())
    files.deleteOnExit(where)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes `df` into the shared folder and reads it back: lineage ends here, any executor may be lost.

    The rows that come back have a known size on disk, so the planner picks joins by it.
    """
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """For each name one that is no column of `df`, whatever its case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts in a row, and the offsets of each; null is empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    held = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return held[at[0] : at[-1]], at - at[0]


def portions(texts: pa.Array, limit: int = WORK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most `limit` bytes of text, or one row."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)) if len(texts) else []
    lo, before = 0, 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(sizes, before + limit, "right")))
        yield lo, hi
        lo, before = hi, int(sizes[hi - 1])


#: Bytes that part words: the space and \t \n \v \f \r.
BLANK = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word `[^\\x20\\x09-\\x0D]+` in bytes, and each text's first word (one more at the end)."""
    inside = ~BLANK[data]
    full = at[:-1][at[:-1] < at[1:]]
    before = np.empty_like(inside)
    before[:1], before[1:] = False, inside[:-1]
    before[full] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1:], after[:-1] = False, inside[1:]
    after[full[1:] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, at)


def ragged(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The numbers first[i] .. first[i] + count[i] - 1, one run after the other."""
    count = count.astype(np.int64)
    ends = np.cumsum(count)
    return np.repeat(first - (ends - count), count) + np.arange(ends[-1] if len(ends) else 0)
