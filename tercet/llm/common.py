"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DOC_COLUMNS = {"doc_id": T.LongType(), "text": T.StringType(), "lang": T.StringType(), "source": T.StringType()}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a temporary one where it is unset and all runs on one machine. On a cluster it must be set."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir isn't set: intermediate tables need a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tercet-checkpoint-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


#: The tables that written() made and that are still there.
_PATHS: list[tuple[SparkSession, str]] = []


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
        jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)
    except Exception:  # the session has ended; the folder's owner clears it
        pass


@atexit.register
def _delete_all() -> None:
    while _PATHS:
        _delete(*_PATHS.pop())


@contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Settings of the session, until the end of the block; in names _ stands for a dot."""
    values = {k.replace("_", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def written(df: DataFrame, batch: int | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage ends there, and a lost executor costs
    only the tasks that it was running. The files of its shuffles go when it is there. The table goes when the driver's process ends, or before by alone().
    batch: how many rows at most go to a Python worker at once."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tercet-{uuid.uuid4().hex}"
    with settings(spark, spark_sql_classic_shuffleDependency_fileCleanup_enabled="true", **({"spark_sql_execution_arrow_maxRecordsPerBatch": str(batch)} if batch else {})):
        df.write.parquet(path)
    _PATHS.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def alone(make: Callable[[], DataFrame], before: int = 0, batch: int | None = None) -> DataFrame:
    """written(make(), batch); then what was written on the way to it is deleted, from the table number `before` on."""
    out = written(make(), batch)
    *gone, own = _PATHS[before:]
    _PATHS[before:] = [own]
    for x in gone:
        _delete(*x)
    return out


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, for mapInArrow; at the end of a task its worker gives back the memory that it else keeps while it waits for another."""

    def released_run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)

    return released_run


def tables_written() -> int:
    return len(_PATHS)


#: What is broadcast has this many bytes at most.
BROADCAST_BYTES = 32 << 20


def is_small(written: DataFrame, row_bytes: int) -> bool:
    return written.count() * row_bytes <= BROADCAST_BYTES


def sized(small: DataFrame, row_bytes: int) -> DataFrame:
    """A written table as the small side of a join: broadcast if its rows, of about row_bytes each, are few enough; else by a shuffle."""
    return F.broadcast(small) if is_small(small, row_bytes) else small.hint("shuffle_merge")


def reduce_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def as_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string column's bytes and its n+1 offsets; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    n, start = len(column), column.offset
    _, offsets, data = column.buffers()
    if n == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[start : start + n + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(offsets: np.ndarray, most: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about `most` bytes, one row at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[[c for c in range(128) if not chr(c).isalnum()]] = 32


def normalised_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts, normalised, each between spaces; and where each begins."""
    data, offsets = as_buffer(pc.utf8_lower(texts))
    n = len(offsets) - 1
    padded = np.full(len(data) + 2 * n, 32, np.uint8)
    begins = offsets + 2 * np.arange(n + 1)
    at = np.ones(len(padded), bool)
    at[begins[:-1]] = False
    at[begins[1:] - 1] = False
    padded[at] = _CLASS[data]
    space = padded == 32
    keep = np.ones(len(padded), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    keep[begins[:-1]] = True
    return padded[keep], np.concatenate([[0], np.cumsum(keep)])[begins]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, on uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHasher:
    """Hashes of the words of many texts at once, by a polynomial over bytes modulo 2**64."""

    BASE = 0x9E3779B97F4A7C15

    def __init__(self) -> None:
        self.grow(1 << 21)

    def grow(self, n: int) -> None:
        inverse = pow(self.BASE, -1, 1 << 64)
        self.powers = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, self.BASE, np.uint64))])
        self.inverses = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, inverse, np.uint64))])

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A hash for each word (a longest run of bytes above 32), and where each text's words begin."""
        n = len(data)
        if n == 0:
            return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
        if n >= len(self.powers):
            self.grow(n)
        word = np.zeros(n + 1, bool)
        np.greater(data, 32, out=word[:n])
        first, last = word[:n].copy(), word[:n].copy()
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        first[1:] &= ~word[: n - 1] | edge[1:n]
        last[:] &= ~word[1 : n + 1] | edge[1 : n + 1]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.powers[:n], out=sums[1:])
        return mix((sums[ends] - sums[starts]) * self.inverses[starts]), np.searchsorted(starts, offsets)


def ngram_hashes(words: np.ndarray, begins: np.ndarray, n: int) -> list[np.ndarray]:
    """Each text's distinct hashed n-grams in ascending order; a text of fewer than n words, but
    not of none, has one n-gram of all its words."""
    total = len(words)
    grams = np.zeros(max(total - n + 1, 0), np.uint64)
    for j in range(n):
        grams += words[j : j + len(grams)] * np.uint64(pow(0xD1342543DE82EF95, j + 1, 1 << 64))
    grams = mix(grams)
    out = []
    for a, b in zip(begins[:-1].tolist(), begins[1:].tolist()):
        if b - a >= n:
            own = np.sort(grams[a : b - n + 1])
            out.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
        elif b > a:
            whole = np.uint64(b - a)
            for j, w in enumerate(words[a:b]):
                whole = whole + w * np.uint64(pow(0xA24BAED4963EE407, j + 1, 1 << 64))
            out.append(mix(np.array([whole], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names that df hasn't, like the given ones."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name in taken:
            name += "_"
        out.append(name)
    return out


def least_hashed(rows: DataFrame, column: str, most: int, *ties: str) -> DataFrame:
    """The `most` rows of least hash of a column. A count tells which hashes may be among them, so that few other rows are sorted or sent."""
    n = rows.count()
    likely = (most + 10 * most**0.5 + 100) / max(n, 1)
    h = F.xxhash64(column)
    if likely < 1:
        rows = rows.where(h < int(likely * 2**64) - 2**63)
    return rows.orderBy(h, column, *ties).limit(most)
