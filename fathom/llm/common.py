"""Helpers shared by the corpus operators: Arrow buffers, word and k-gram hashing, sizing."""

from __future__ import annotations

import ctypes
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Odd multipliers: the word base, the k-gram base and the finalizer of all hashes here.
WORD_BASE = 0x9E3779B97F4A7C15
GRAM_BASE = 0xD6E8FEB86659FD93
GRAM_BASE_2 = 0xA0761D6478BD642F
MIX_1, MIX_2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
#: Rows in an Arrow batch.  Texts can be long, so batches are short.
BATCH_ROWS = 128
#: Bytes of text that are worked on at a time, unless a single text has more.
AT_ONCE = 1 << 18
#: Values that are worked on at a time where several passes go over them.
CACHED = 1 << 14
#: Powers of a base that a worker keeps between batches.
KEPT_POWERS = 1 << 21


def short_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bound the Arrow batches of the Python stages planned in this session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def small(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most AT_ONCE bytes of text, so that long texts don't pile up."""
    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at, done = 0, 0
        while at < len(batch):
            to = max(at + 1, int(np.searchsorted(size, done + AT_ONCE, side="right")))
            yield batch.slice(at, to - at)
            at, done = to, int(size[to - 1])


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; also set as Spark's checkpoint folder.

    A cluster names it in spark.checkpoint.dir.  Only where that is unset and Spark runs on
    this machine alone (tests) a temporary folder is made; on a cluster that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        import tempfile

        folder = "file://" + tempfile.mkdtemp(prefix="fathom-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", folder)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def id_and_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The id and the text (null: empty) as columns doc_id and text, and nothing else."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def text_blocks(docs: DataFrame, rows_per_block: int, floor: int = 1) -> int:
    """How many blocks of about rows_per_block rows hold docs (one count over all rows)."""
    return max(floor, math.ceil(docs.count() / rows_per_block))


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijective finalizer on uint64: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * MIX_1
    h = h ^ (h >> np.uint64(33))
    h = h * MIX_2
    return h ^ (h >> np.uint64(33))


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, from one table per base that grows by doubling."""
    table = _POWERS.get(base)
    if table is None or len(table) < n:
        table = np.full(1 << max(10, (max(n, 1) - 1).bit_length()), base, dtype=np.uint64)
        table[0] = 1
        np.multiply.accumulate(table, out=table)
        if len(table) > KEPT_POWERS:
            return table[:n]
        _POWERS[base] = table
    return table[:n]


def inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def prefix_sums(values: np.ndarray, base: int) -> np.ndarray:
    """P with P[i] = sum of values[j] * base**j for j < i, modulo 2**64."""
    out = np.empty(len(values) + 1, dtype=np.uint64)
    out[0] = 0
    np.multiply(values, powers(base, len(values)), out=out[1:])
    np.cumsum(out[1:], out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, base: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of values[start:end] for each span, wherever it starts; the length counts too."""
    raw = (prefix[end] - prefix[start]) * powers(inverse(base), len(prefix))[start]
    return mix64(raw + (end - start).astype(np.uint64) * np.uint64(WORD_BASE))


def window_hashes(prefix: np.ndarray, base: int, width: int) -> np.ndarray:
    """span_hashes of `width` values from each place on; entries that leave the values mean nothing."""
    out = np.zeros(len(prefix), np.uint64)
    inv, length = powers(inverse(base), len(prefix)), np.uint64(width * WORD_BASE & (1 << 64) - 1)
    shifted = np.empty(CACHED, np.uint64)
    for at in range(0, len(prefix) - width, CACHED):  # in place, in a core's cache
        to = min(at + CACHED, len(prefix) - width)
        part, high = out[at:to], shifted[: to - at]
        np.subtract(prefix[at + width : to + width], prefix[at:to], out=part)
        part *= inv[at:to]
        part += length
        for factor in (MIX_1, MIX_2, None):
            part ^= np.right_shift(part, np.uint64(33), out=high)
            if factor is not None:
                part *= factor
    return out


def joined(texts: pa.Array, end: str | bytes = "\n") -> tuple[np.ndarray, np.ndarray]:
    """The (UTF-8) bytes of all texts, each followed by `end`, and the offsets of the texts."""
    kind = pa.large_string() if isinstance(end, str) else pa.large_binary()
    texts = pc.fill_null(texts.cast(kind), pa.scalar(end[:0], kind))
    both = pc.binary_join_element_wise(texts, pa.scalar(end[:0], kind), pa.scalar(end, kind)) if end else texts
    if len(both) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(both.buffers()[1], np.int64)[both.offset : both.offset + len(both) + 1]
    buf = np.frombuffer(both.buffers()[2], np.uint8)[off[0] : off[-1]] if off[-1] > off[0] else np.zeros(0, np.uint8)
    return buf, off - off[0]


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


class Words:
    """The words `[^\\x20\\x09-\\x0D]+` of a column of texts.

    buf, start, end: the bytes and where each word lies in them; hash: 64 bits a word;
    first: the index of each text's first word (one more entry at the end).
    """

    def __init__(self, texts: pa.Array, lower: bool = False):
        self.buf, off = joined(texts)
        space = np.ones(len(self.buf) + 1, dtype=bool)
        space[1:] = _SPACE[self.buf]
        edge = np.flatnonzero(space[1:] != space[:-1])
        self.start, self.end = edge[::2], edge[1::2]
        self.first = np.searchsorted(self.start, off)
        data = _LOWER[self.buf] if lower else self.buf
        prefix = prefix_sums(data.astype(np.uint64) + np.uint64(1), WORD_BASE)
        self.hash = span_hashes(prefix, WORD_BASE, self.start, self.end)

    def grams(self, n: int, base: int = GRAM_BASE) -> np.ndarray:
        """Hash of the n words from each word on; entries that leave their text mean nothing."""
        at = np.arange(max(0, len(self.hash) - n + 1))
        return span_hashes(prefix_sums(self.hash, base), base, at, at + n)


def sliding_min(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of keys[i : i+width] for each i, by prefix and suffix minima of blocks."""
    n = len(keys) - width + 1
    if n <= 0:
        return keys[:0]
    blocks = -(-len(keys) // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[: len(keys)] = keys
    grid = padded.reshape(blocks, width)
    before = np.minimum.accumulate(grid, axis=1).ravel()
    after = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[:n], before[width - 1 : width - 1 + n])


def ragged(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, .. for length[0] values, then the next range, in one array."""
    total = int(length.sum())
    if total == 0:
        return np.zeros(0, dtype=np.int64)
    skip = np.repeat(np.cumsum(length) - length, length)
    return np.arange(total) - skip + np.repeat(start, length)


def give_back() -> None:
    """Return freed memory to the system: Spark keeps Python workers, and with them their peak."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


#: Keys that a skewed join may treat as heavy at most; their rows are broadcast.
HEAVY = 1024


def join_skewed(rows: DataFrame, table: DataFrame, key: str, total: int) -> DataFrame:
    """rows joined with table (key, n: rows of that key, ..; a written table) so that no key lands in one task.

    Keys of more than total / HEAVY rows are at most HEAVY (total: sum of n), so they are broadcast;
    the others are shuffled.  The column n goes.
    """
    heavy = F.broadcast(table.where(F.col("n") > total // HEAVY).drop("n"))
    light = table.where(F.col("n") <= total // HEAVY).drop("n")
    rest = rows.join(heavy.select(key), key, "left_anti").join(light, key)
    return rows.join(heavy, key).unionByName(rest)


def fewer(df: DataFrame, share: int) -> DataFrame:
    """The same rows in a share'th of the shuffle partitions, but in no fewer than 4 a core.

    For Python stages behind a shuffle whose tasks have few rows each: a task costs tens of
    milliseconds before its first row.  Their number still follows the shuffle partitions.
    """
    spark = df.sparkSession
    return df.coalesce(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) // share))


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: computed once, lineage cut, no executor needed.

    The files go when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/fathom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return spark.read.schema(df.schema).parquet(path)
