"""Fuzzy line dedup: MinHash over character shingles, banding, exact Jaccard, union-find.

Lines are separated by newlines; blank ones (spaces and tabs only) are never touched.  Two
lines are alike if the Jaccard coefficient of their sets of 8-character shingles (a shorter
line is one shingle) is at least 0.8.  Candidates share one of 16 bands of 4 minima: a pair
at the threshold is found with probability 0.9998, each candidate is checked exactly.  Of a
component of alike lines the first in the order of doc_id, text hash and line stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import linking
from .common import WORD_BASE, id_and_text, join_skewed, materialize, mix64, prefix_sums, short_batches, small, span_hashes, window_hashes

SHINGLE, BANDS, ROWS = 8, 16, 4
SHARE = (80, 100)
#: Shingles that are hashed at a time.
CACHED = 1 << 15
_ODD = (mix64(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


class Lines:
    """Lines of some texts in code points: start, end, hash (node, 0 if blank), and the text each is of."""

    def __init__(self, texts: list[str]):
        whole = "\n".join(texts) + "\n" if texts else ""
        self.code = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        self.end = np.flatnonzero(self.code == 10)
        self.start = np.concatenate([[0], self.end[:-1] + 1]) if len(self.end) else self.end
        size = np.array([len(t) + 1 for t in texts], np.int64)
        first = np.searchsorted(self.start, np.cumsum(size) - size)
        self.of = np.repeat(np.arange(len(texts)), np.diff(np.append(first, len(self.start))))
        self.number = np.arange(len(self.start)) - first[self.of] if len(texts) else self.end
        self.prefix = prefix_sums(self.code.astype(np.uint64) + np.uint64(1), WORD_BASE)
        ink = (self.code != 32) & (self.code != 9) & (self.code != 13) & (self.code != 10)
        blank = ~np.logical_or.reduceat(ink, self.start) if len(self.start) else np.zeros(0, bool)
        node = np.maximum(mix64(span_hashes(self.prefix, WORD_BASE, self.start, self.end)), 1)
        self.node = np.where(blank, 0, node).astype(np.uint64)

    def shingles(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Shingle hashes of the chosen lines (ascending), one after the other, and where each line's begin."""
        start, end = self.start[which], self.end[which]
        count = np.maximum(end - start - SHINGLE + 1, 1)
        first = np.cumsum(count) - count
        # those of all places, without looking up any; then the places of the chosen lines
        inside = np.zeros(len(self.prefix), np.int8)
        inside[start] += 1
        inside[start + count] -= 1
        out = window_hashes(self.prefix, WORD_BASE, SHINGLE)[np.cumsum(inside, dtype=np.int8).view(bool)]
        short = np.flatnonzero(end - start < SHINGLE)
        out[first[short]] = span_hashes(self.prefix, WORD_BASE, start[short], end[short])
        return out, first


def bands(shingle: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Band keys [line, BANDS] from the lines' shingle hashes."""
    short = (shingle >> np.uint64(32)).astype(np.uint32)
    least = np.empty((len(_ODD), len(first)), np.uint32)
    edge = np.append(first, len(short))
    at = 0
    while at < len(first):  # as many lines at a time as fit in a core's cache
        to = max(at + 1, int(np.searchsorted(edge, edge[at] + CACHED, side="right")) - 1)
        part, begin = short[edge[at] : edge[to]], first[at:to] - edge[at]
        product = np.empty_like(part)
        for i, odd in enumerate(_ODD):
            least[i, at:to] = np.minimum.reduceat(np.multiply(part, odd, out=product), begin)
        at = to
    least = least.reshape(BANDS, ROWS, len(first))
    out = np.repeat(np.arange(1, BANDS + 1, dtype=np.uint64)[:, None], len(first), axis=1)
    for row in range(ROWS):
        out = mix64(out * np.uint64(0xA0761D6478BD642F) + least[:, row])
    return out.T


def line_sets(raw: list[bytes]) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each line."""
    out: list[np.ndarray] = []
    for at in range(0, len(raw), 1 << 15):
        lines = Lines([x.decode("utf-8", "surrogatepass") for x in raw[at : at + (1 << 15)]])
        shingle, first = lines.shingles(np.arange(len(lines.start)))
        edge = np.append(first, len(shingle))
        new = np.ones(len(shingle), bool)
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):  # each line's own sort stays in a core's cache
            shingle[a:b].sort()
        new[1:] = shingle[1:] != shingle[:-1]
        new[first] = True
        out += np.split(shingle[new], np.cumsum(np.add.reduceat(new, first, dtype=np.int64))[:-1])
    return out


def accept(common: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    return (SHARE[1] * common >= SHARE[0] * (one + two - common)) & (common > 0)


def duplicate_lines(docs: DataFrame) -> DataFrame:
    """doc_id, tie, gone (line numbers) of the documents (doc_id, tie, text) that lose lines."""
    spark = docs.sparkSession

    def list_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            lines = Lines(batch["text"].to_pylist())
            keep = np.flatnonzero(lines.node)
            of = pa.array(lines.of[keep])
            yield pa.RecordBatch.from_arrays([batch["doc_id"].take(of), batch["tie"].take(of), pa.array(lines.number[keep]), pa.array(lines.node[keep].view(np.int64))], names=["doc_id", "tie", "line", "node"])

    lines = materialize(docs.mapInArrow(list_lines, "doc_id long, tie long, line long, node long"), "lines")
    nodes = materialize(lines.groupBy("node").agg(F.min(F.struct("doc_id", "tie", "line")).alias("first"), F.count(F.lit(1)).alias("n")), "line-nodes")
    total, distinct = nodes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    bits = linking.bucket_bits(distinct * BANDS, linking.PER_BUCKET)

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()

        def parts() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for batch in small(batches):
                own = Lines(batch["text"].to_pylist())
                new = np.array([i for i, x in enumerate(own.node.tolist()) if x and x not in seen and not seen.add(x)], np.int64)
                yield bands(*own.shingles(new)).ravel(), np.repeat(own.node[new], BANDS)

        yield from linking.send_entries(parts(), bits)

    def contents_of(wanted: DataFrame) -> DataFrame:
        some = spark.sparkContext.broadcast(linking.needed(wanted))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: set[int] = set()
            for batch in small(batches):
                own = Lines(batch["text"].to_pylist())
                hit = np.flatnonzero((own.node != 0) & linking.passes(some.value, own.node))
                hit = np.array([i for i in hit.tolist() if (x := int(own.node[i])) not in seen and not seen.add(x)], np.int64)
                raw = [own.code[own.start[i] : own.end[i]].tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass") for i in hit]
                yield pa.RecordBatch.from_arrays([pa.array(own.node[hit].view(np.int64)), pa.array(raw, pa.binary())], names=["node", "content"])

        return docs.mapInArrow(run, "node long, content binary")

    linked = linking.components(docs.select("text").mapInArrow(enter, linking.ENTRIES), contents_of, line_sets, accept, "line")
    # by node first: a very common line is one row until the last join
    labelled = materialize(nodes.join(linked, "node", "left").select("node", "first", F.col("n").alias("lines"), F.coalesce("component", "node").alias("label")), "line-labels")
    kept = materialize(labelled.groupBy("label").agg(F.min("first").alias("kept"), F.count(F.lit(1)).alias("n"), F.sum("lines").alias("lines")).where("lines > 1").drop("lines"), "line-kept")
    kept_of = materialize(join_skewed(labelled.select("label", "node", F.col("lines").alias("rows")), kept, "label", distinct).select("node", "kept", F.col("rows").alias("n")), "line-kept-of")
    lost = join_skewed(lines, kept_of, "node", total).where(F.struct("doc_id", "tie", "line") > F.col("kept")).select("doc_id", "tie", "line").distinct()
    return materialize(lost.groupBy("doc_id", "tie").agg(F.collect_list("line").alias("gone")), "line-gone")


def dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_lines, n_removed, kept (the text without its removed lines), one row per row of df.

    Null and empty texts have one line, which is blank and stays.  Rows of equal id and text
    are one document and get the same result; a null id sorts first.  An empty table gives none.
    """
    short_batches(df.sparkSession)
    docs = id_and_text(df, id_col, text_col).withColumn("tie", F.xxhash64("text"))
    return drop_lines(docs, duplicate_lines(docs), [])


def drop_lines(docs: DataFrame, gone: DataFrame, more: list[str]) -> DataFrame:
    """docs (doc_id, tie, text and the columns `more`) without the lines that gone lists."""
    key = F.coalesce("doc_id", F.lit(-(2**63))).alias("key")
    both = docs.select(key, "tie", "doc_id", "text", *more).join(gone.select(key, "tie", "gone"), ["key", "tie"], "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, total, removed = [], [], []
            for text, lines in zip(batch["text"].to_pylist(), batch["gone"].to_pylist(), strict=True):
                drop, parts = set(lines or ()), text.split("\n")
                kept.append("\n".join(p for i, p in enumerate(parts) if i not in drop) if drop else text)
                total.append(len(parts))
                removed.append(len(drop))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string()), *(batch[c] for c in more)], names=["doc_id", "n_lines", "n_removed", "kept", *more])

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    schema = "doc_id long, n_lines long, n_removed long, kept string" + "".join(f", `{c}` {kinds[c]}" for c in more)
    return both.select("doc_id", "text", "gone", *more).mapInArrow(cut, schema)


def rewrite(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """df with its own columns, texts without their removed lines and lengths to match.

    Documents that lose all their lines go; null and empty texts stay as they are.
    """
    short_batches(df.sparkSession)
    docs = id_and_text(df, id_col, text_col).withColumn("tie", F.xxhash64("text"))
    more = [c for c in df.columns if c not in (id_col, text_col)]
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("tie"), F.struct(F.col(text_col).isNull().alias("null"), *more).alias("row"))
    out = drop_lines(rows, duplicate_lines(docs), ["row"]).where("n_removed = 0 or kept rlike '[^ \\\\t\\\\r\\\\n]'")
    value = {id_col: F.col("doc_id").cast(df.schema[id_col].dataType), text_col: F.when(~F.col("row.null"), F.col("kept"))}
    value |= {c: F.when(F.col("n_removed") > 0, F.length("kept")).otherwise(F.col(f"row.{c}")).cast(df.schema[c].dataType) if c == length_col else F.col(f"row.{c}") for c in more}
    return out.select(*(value[c].alias(c) for c in df.columns))
