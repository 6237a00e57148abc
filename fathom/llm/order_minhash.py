"""Order MinHash fingerprints of texts.

Each of `rows` hash functions orders the text's k-mers, numbered by occurrence so that
repeats count; the `tuple_size` least of them, put back into text order, are hashed together
into one component.  Two texts agree in a component about as often as they share k-mers *in
the same order*, so the share of equal components follows edit distance, not only overlap.

k-mers are `k` code points (a shorter text is one k-mer).  Hash functions are odd multiples
of one 32-bit hash of the numbered k-mer.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, mix64, short_batches, text_blocks

K, ROWS, TUPLE = 12, 64, 2
_U32 = np.uint64(32)


@lru_cache(maxsize=8)
def multipliers(rows: int) -> np.ndarray:
    return (mix64(np.arange(1, rows + 1, dtype=np.uint64)) >> _U32).astype(np.uint32) | np.uint32(1)


def numbered_kmers(codes: np.ndarray, k: int) -> np.ndarray:
    """32-bit hashes of the k-mers of one text with their occurrence numbers."""
    k = min(k, len(codes))
    hashes, size, base = codes.astype(np.uint64) + np.uint64(1), 1, 0x9E3779B97F4A7C15
    whole, have = None, 0
    while size <= k:  # h(2s) from h(s), and h(k) from the binary digits of k
        if k & size:
            whole = hashes if whole is None else whole[: len(hashes) - have] * np.uint64(pow(base, size, 1 << 64)) + hashes[have:]
            have += size
        if 2 * size > k:
            break
        hashes = hashes[: len(hashes) - size] * np.uint64(pow(base, size, 1 << 64)) + hashes[size:]
        size *= 2
    n = len(codes) - k + 1
    hashes = mix64(whole[:n])
    place = np.uint64(max(1, (n - 1).bit_length()))
    low = (np.uint64(1) << place) - np.uint64(1)
    keyed = np.sort(hashes & ~low | np.arange(n, dtype=np.uint64))
    top = keyed >> place
    same = top[1:] == top[:-1]
    if same.any():
        run = np.flatnonzero(np.concatenate([[True], ~same]))
        number = np.arange(n) - np.repeat(run, np.diff(np.append(run, n)))
        hashes[(keyed & low).astype(np.int64)] += number.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        hashes = mix64(hashes)
    else:
        hashes = mix64(hashes)
    return (hashes >> _U32).astype(np.uint32)


#: Hash values worked on at a time, unless a text alone has more.
GRID = 32768


@lru_cache(maxsize=1)
def _kept_buffer() -> np.ndarray:
    return np.empty(GRID, np.uint32)


def _buffer(size: int) -> np.ndarray:
    return _kept_buffer() if size <= GRID else np.empty(size, np.uint32)


def fingerprint(text: str, k: int = K, rows: int = ROWS, tuple_size: int = TUPLE) -> np.ndarray:
    """`rows` components of 32 bits; all zero for the empty text only."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(codes):
        return np.zeros(rows, np.uint32)
    kmers, odd = numbered_kmers(codes, k), multipliers(rows)
    n, want = len(kmers), min(tuple_size, len(kmers))
    chosen, step = np.empty((rows, want), np.int64), max(1, GRID // n)
    whole = _buffer(step * n)
    for first in range(0, rows, step):
        size = (min(step, rows - first), n)
        grid = np.multiply(odd[first : first + step, None], kmers, out=whole[: size[0] * n].reshape(size))
        line = np.arange(size[0])
        for column in range(want):
            least = grid.argmin(axis=1)
            chosen[first : first + step, column] = least
            grid[line, least] = np.iinfo(np.uint32).max
    chosen.sort(axis=1)
    out = np.zeros(rows, np.uint64)
    for column in range(want):
        out = mix64(out * np.uint64(0xA0761D6478BD642F) + kmers[chosen[:, column]].astype(np.uint64) + np.uint64(1))
    return np.maximum((out >> _U32).astype(np.uint32), 1)


def to_hex(components: np.ndarray) -> str:
    return components.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float(np.mean(a == b))


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, rows: int = ROWS, tuple_size: int = TUPLE) -> DataFrame:
    """doc_id, n_chars and fingerprint (hex) of each text.  Null and empty texts: all zeros."""
    short_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch["text"].to_pylist()
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([len(t) for t in texts], pa.int64()), pa.array([to_hex(fingerprint(t, k, rows, tuple_size)) for t in texts], pa.string())], names=["doc_id", "n_chars", "fingerprint"])

    return id_and_text(df, id_col, text_col).mapInArrow(run, "doc_id long, n_chars long, fingerprint string")


def with_next(docs: DataFrame, docs_in_run: int) -> DataFrame:
    """Deal the documents (doc_id, text) into runs of ascending doc_id, each closed by the next run's first.

    Adds run and extra (true for the closing copy).  Runs are cut at quantiles of doc_id; only
    their heads, one row a run, are looked up across runs.
    """
    spark = docs.sparkSession
    runs = min(text_blocks(docs, docs_in_run), MOST_RUNS)
    key = F.coalesce(F.col("doc_id"), F.lit(-(2**63)))
    cuts = sorted({int(c) for c in docs.select(key.cast("double").alias("d")).approxQuantile("d", [i / runs for i in range(1, runs)], 0.2 / runs)}) if runs > 1 else []
    edges = np.array(cuts, np.int64)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.append_column("run", pa.array(np.searchsorted(edges, batch["k"].to_numpy(), side="right").astype(np.int32)))

    keyed = docs.withColumn("k", key).withColumn("tie", F.xxhash64("text")).mapInArrow(place, "doc_id long, text string, k long, tie long, run int")
    heads = keyed.groupBy("run").agg(F.min(F.struct("k", "tie")).alias("head"))
    found = sorted((r["run"], r["head"]["k"], r["head"]["tie"]) for r in heads.collect())
    before = {(k, tie): found[i - 1][0] for i, (_, k, tie) in enumerate(found)}
    close = spark.createDataFrame([(k, tie, run) for (k, tie), run in before.items()], "k long, tie long, before int")
    copies = keyed.join(F.broadcast(close), ["k", "tie"]).select("doc_id", "text", "k", "tie", F.col("before").alias("run"), F.lit(True).alias("extra"))
    return keyed.select("doc_id", "text", "k", "tie", "run", F.lit(False).alias("extra")).unionByName(copies)


EDITED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
#: Documents in a run, and the most runs (their heads pass through the driver; longer runs are streamed).
RUN_DOCS, MOST_RUNS = 1024, 65_536


def compare_with_edited(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", run_docs: int = RUN_DOCS) -> DataFrame:
    """Each text's fingerprint against that of its edited text and that of the next document.

    The edited text has its last floor(n_chars / 2) code points replaced by as many first
    ones (or all) of the next document in ascending doc_id; the last document's next is the
    first.  Rows of equal doc_id follow each other in the order of a hash of their texts (null
    ids first); a table of one row is its own next.
    """
    short_batches(df.sparkSession)
    dealt = with_next(id_and_text(df, id_col, text_col), run_docs)
    runs = dealt.repartition("run").sortWithinPartitions("run", "extra", "k", "tie")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # (run, doc_id, text, fingerprint) that waits for its next
        for batch in batches:
            out = []
            for doc, text, run, extra in zip(*(batch[c].to_pylist() for c in ("doc_id", "text", "run", "extra")), strict=True):
                closed = held is not None and held[0] == run
                if extra and not closed:
                    continue  # a second copy of a repeated head
                mark = held[3] if closed and held[2] == text else fingerprint(text)
                if closed:
                    _, before, old, known = held
                    half = len(old) // 2
                    edited = old[: len(old) - half] + text[:half]
                    other = known if edited == old else fingerprint(edited)
                    out.append((before, len(old), hashlib.sha256(edited.encode()).hexdigest(), to_hex(known), to_hex(other), likeness(known, other), likeness(known, mark)))
                held = None if extra else (run, doc, text, mark)
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
            columns = list(zip(*out, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[f.split()[0] for f in EDITED.split(", ")])

    return runs.select("doc_id", "text", "run", "extra").mapInArrow(compare, EDITED)
