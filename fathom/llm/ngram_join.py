"""Jaccard join of documents on word 5-gram sets, by filtering under several global token orders.

If two sets reach the threshold t, then under *any* order of all tokens the first
n - ceil(t n) + 1 tokens of each share one.  Candidates come from the prefixes under a first
order (rare tokens first, from a counting sketch over all documents, ties by a hash); before
a pair is verified exactly it must also share a prefix token under each further order (same
rarity, other ties): the prefixes themselves are sent and intersected, so what an order
rejects shares no token of its prefixes.  Sizes must agree within t as well, and before
prefixes are sent, bits of all tokens bound from below how many tokens the sets do not share.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import linking
from .common import AT_ONCE, Words, give_back, id_and_text, join_skewed, materialize, mix64, short_batches, small

WORDS = 5
#: The threshold as a fraction of integers, so that no rounding decides a link.
SHARE = (80, 100)
ORDERS = 3
#: Counters of the rarity sketch: a fixed 1 MB, whatever the size of the corpus.
SKETCH_BITS, SLICES = 20, 64
#: Documents under a prefix token up to which all pairs are candidates; of more, those with the leader.
ALL_PAIRS = 12
#: Bits per token of a document's bit table (rounded up to a power of two), and the least number.
TOKEN_BITS, LEAST_BITS = 4, 512


def gram_sets(texts: pa.Array, n: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """first, token: each text's sorted distinct n-gram hashes; node: a hash of the set (0: no words).

    A text of fewer words has its whole word sequence as its only n-gram.
    """
    words = Words(texts, lower=True)
    count = np.diff(words.first)
    grams = words.grams(n)
    rows = len(count)
    full = np.maximum(count - n + 1, 0)
    place = np.repeat(words.first[:-1] - (np.cumsum(full) - full), full) + np.arange(full.sum())
    token, of = grams[place], np.repeat(np.arange(rows), full)
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        whole = [mix64(np.array([hash_words(words.hash[words.first[i] : words.first[i + 1]])], np.uint64))[0] for i in short]
        token, of = np.concatenate([token, np.array(whole, np.uint64)]), np.concatenate([of, short])
    order = np.lexsort((token, of))
    token, of = token[order], of[order]
    keep = np.concatenate([[True], (token[1:] != token[:-1]) | (of[1:] != of[:-1])]) if len(token) else np.zeros(0, bool)
    token, of = token[keep], of[keep]
    first = np.searchsorted(of, np.arange(rows + 1))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(token + np.uint64(1)), dtype=np.uint64)])
    node = mix64(sums[first[1:]] - sums[first[:-1]] + np.diff(first).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return first, token, np.where(np.diff(first) > 0, np.maximum(node, 1), 0).astype(np.uint64)


def hash_words(hashes: np.ndarray) -> int:
    out = len(hashes)
    for h in hashes.tolist():
        out = (out * 0x9E3779B97F4A7C15 + h) & (1 << 64) - 1
    return out


def prefix_lengths(size: np.ndarray, share: tuple[int, int] = SHARE) -> np.ndarray:
    return size - -(-size * share[0] // share[1]) + 1


def rarity(token: np.ndarray, levels: np.ndarray, order: int) -> np.ndarray:
    """Sort keys of the order'th global order: level of the sketch, then a hash."""
    level = levels[(token >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)].astype(np.uint64)
    return level << np.uint64(58) | mix64(token + np.uint64(1000 + order)) >> np.uint64(6)


def prefix(token: np.ndarray, levels: np.ndarray, order: int) -> np.ndarray:
    length = int(prefix_lengths(np.array([len(token)]))[0])
    keys = rarity(token, levels, order)
    return token if length >= len(token) else token[np.argpartition(keys, length - 1)[:length]]


def to_content(token: np.ndarray) -> bytes:
    return np.ascontiguousarray(token).tobytes()


def from_content(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.uint64)


def bit_table(token: np.ndarray) -> bytes:
    """Size and bits of all tokens; tables of different lengths fold onto each other."""
    width = max(LEAST_BITS, 1 << (TOKEN_BITS * len(token) - 1).bit_length())
    bits = np.zeros(width, np.uint8)
    bits[(token >> np.uint64(8)).astype(np.int64) & (width - 1)] = 1
    return len(token).to_bytes(8, "little") + np.packbits(bits).tobytes()


class BitTables:
    """Sizes and bit tables of some documents."""

    def __init__(self, raw: list[bytes]):
        self.raw = raw
        self.size = np.array([int.from_bytes(r[:8], "little") for r in raw], np.int64)
        self.width = np.array([len(r) - 8 for r in raw], np.int64)
        self.folded: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def at(self, width: int, rows: np.ndarray) -> np.ndarray:
        """Tables of rows folded to width bytes; theirs are no shorter and at most twice as long."""
        if width not in self.folded:
            place, parts = np.zeros(len(self.raw), np.int64), []
            for own in (width, 2 * width):
                some = np.flatnonzero(self.width == own)
                place[some] = np.arange(len(some)) + sum(map(len, parts))
                grid = np.frombuffer(b"".join(self.raw[i][8:] for i in some), np.uint64).reshape(len(some), own // width, width // 8)
                parts.append(np.bitwise_or.reduce(grid, axis=1))
            self.folded[width] = place, np.concatenate(parts)
        place, table = self.folded[width]
        return table[place[rows]]


def enough(p: BitTables, one: np.ndarray, q: BitTables, two: np.ndarray) -> np.ndarray:
    """Of the pairs (one[i] of p, two[i] of q): whether sizes and bits leave room for enough common tokens."""
    n, m = p.size[one], q.size[two]
    out = accept(np.minimum(n, m), n, m)  # so widths are equal or twice each other
    width = np.minimum(p.width[one], q.width[two])
    for w in np.unique(width[out]).tolist():
        at = np.flatnonzero(out & (width == w))
        for i in range(0, len(at), max(1, AT_ONCE // w)):
            some = at[i : i + max(1, AT_ONCE // w)]
            x, y = p.at(w, one[some]), q.at(w, two[some])
            only_x, only_y = np.bitwise_count(x & ~y).sum(-1, dtype=np.int64), np.bitwise_count(y & ~x).sum(-1, dtype=np.int64)
            out[some] = accept(np.minimum(n[some] - only_x, m[some] - only_y), n[some], m[some])
    return out


def numbered(left: list[bytes], right: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The distinct values of two lists, and the number of each entry."""
    number: dict[bytes, int] = {}
    one, two = (np.array([number.setdefault(x, len(number)) for x in side], np.int64) for side in (left, right))
    return list(number), one, two


def bit_sieve(left: list[bytes], right: list[bytes]) -> np.ndarray:
    """Pairs of bit tables that may link."""
    values, one, two = numbered(left, right)
    own = BitTables(values)
    return enough(own, one, own, two)


def sieve_sets(left: list[bytes], right: list[bytes]) -> Iterator[tuple[int, int]]:
    """All pairs of two lists of bit tables that may link."""
    p, q = BitTables(left), BitTables(right)
    every = np.arange(len(right))
    for i in range(len(left)):
        yield from ((i, j) for j in np.flatnonzero(enough(p, np.full(len(right), i), q, every)).tolist())


def sketch(token: np.ndarray, levels: np.ndarray) -> bytes:
    """Size, and the prefix under each further order (the high 32 bits of its tokens, sorted)."""
    prefixes = [np.sort((prefix(token, levels, order) >> np.uint64(32)).astype("<u4")) for order in range(1, ORDERS)]
    return len(token).to_bytes(8, "little") + b"".join(p.tobytes() for p in prefixes)


def sieve(left: list[bytes], right: list[bytes]) -> np.ndarray:
    """Pairs whose prefixes meet under each further order."""
    values, one, two = numbered(left, right)
    length = prefix_lengths(np.array([int.from_bytes(r[:8], "little") for r in values], np.int64)).tolist()
    live = np.arange(len(one))
    for order in range(ORDERS - 1):
        prefixes = [np.frombuffer(r, "<u4", n, 8 + 4 * n * order) for r, n in zip(values, length, strict=True)]
        live = live[linking.pair_overlaps(prefixes, one[live], two[live]) > 0]
    out = np.zeros(len(one), bool)
    out[live] = True
    return out


def accept(common: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    return (SHARE[1] * common >= SHARE[0] * (one + two - common)) & (common > 0)


def nodes_of(docs: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """doc_id, tie, node, n_shingles of every document (doc_id, text, tie), and the sketch's levels (log2 of counts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, seen = ["doc_id", "tie", "node", "n_shingles", "slice", "counts"], set()
        counts = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in small(batches):
            first, token, node = gram_sets(batch["text"])
            new = np.array([x not in seen and not seen.add(x) for x in node.tolist()], bool)
            counts += np.bincount((token[np.repeat(new, np.diff(first))] >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(counts))
            n = len(batch)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["tie"], pa.array(node.view(np.int64)), pa.array(np.diff(first).astype(np.int64)), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names=names)
        parts = np.minimum(counts, 2**31 - 1).astype("<u4").reshape(SLICES, -1)
        yield pa.RecordBatch.from_arrays([*(pa.nulls(SLICES, pa.int64()) for _ in range(4)), pa.array(range(SLICES), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], names=names)
        del counts, parts, seen
        give_back()

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, "<u4").astype(np.int64) for x in table["counts"].to_pylist())
        return pa.table({"slice": pa.array([table["slice"][0].as_py()], pa.int32()), "levels": pa.array([np.log2(total + 1).astype(np.uint8).tobytes()], pa.binary())})

    both = materialize(docs.mapInArrow(run, "doc_id long, tie long, node long, n_shingles long, slice int, counts binary"), "ngram-nodes")
    rows = both.where("slice is not null").select("slice", "counts").groupBy("slice").applyInArrow(add, "slice int, levels binary").collect()
    levels = np.zeros((SLICES, (1 << SKETCH_BITS) // SLICES), np.uint8)
    for row in rows:
        levels[row["slice"]] = np.frombuffer(row["levels"], np.uint8)
    return both.where("slice is null").select("doc_id", "tie", "node", "n_shingles"), levels.ravel()


def _once(batches: Iterator[pa.RecordBatch], some: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Sizes, tokens and nodes of the texts whose pick passes the filter, each node of the partition once."""
    seen: set[int] = set()
    for batch in batches:
        picked = batch.filter(pa.array(linking.passes(some, batch["pick"].to_numpy().view(np.uint64))))
        for part in small([picked]):
            first, token, node = gram_sets(part["text"])
            new = np.array([x != 0 and x not in seen and not seen.add(x) for x in node.tolist()], bool)
            size = np.diff(first)
            yield size[new], token[np.repeat(new, size)], node[new]


def label(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, tie (a hash of the text), n_shingles, first (the least (doc_id, tie) of its component).

    Texts are equal here if their sets are.  A text without words, or null, has n_shingles 0
    and is alone in its component.  Rows of equal id and text are one document; a null id
    comes first.
    """
    spark = df.sparkSession
    short_batches(spark)
    docs = id_and_text(df, id_col, text_col).withColumn("tie", F.xxhash64("text"))
    rows, levels = nodes_of(docs)
    shared = spark.sparkContext.broadcast(levels)
    nodes = materialize(rows.where("node <> 0").groupBy("node").agg(F.min(F.struct("doc_id", "tie")).alias("least"), F.first("n_shingles").alias("n_shingles"), F.count(F.lit(1)).alias("n")), "ngram-sets")
    total, distinct, tokens = nodes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1)), F.coalesce(F.sum("n_shingles"), F.lit(0))).first()
    bits = linking.bucket_bits(tokens * (SHARE[1] - SHARE[0]) // SHARE[1] + distinct, linking.PER_BUCKET)

    # a set is made from its least document alone, wherever its copies lie
    picks = nodes.select("node", F.xxhash64("least.doc_id", "least.tie").alias("pick"))
    texts = docs.select("text", F.xxhash64("doc_id", "tie").alias("pick"))
    every = spark.sparkContext.broadcast(linking.needed(picks.select(F.col("pick").alias("node"))))

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for size, token, node in _once(batches, every.value):
                of = np.repeat(np.arange(len(size)), size)
                order = np.lexsort((rarity(token, shared.value, 0), of))
                rank = np.arange(len(token)) - np.repeat(np.cumsum(size) - size, size)
                chosen = order[rank < np.repeat(prefix_lengths(size), size)]
                yield token[chosen], node[of[chosen]]

        yield from linking.send_entries(parts(), bits)

    def values_of(wanted: DataFrame, **values: Callable[[np.ndarray], bytes]) -> DataFrame:
        some = spark.sparkContext.broadcast(linking.needed(picks.join(wanted.select("node").distinct(), "node").select(F.col("pick").alias("node"))))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for size, token, node in _once(batches, some.value):
                sets = np.split(token, np.cumsum(size)[:-1]) if len(size) else []
                yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), *(pa.array([value(x) for x in sets], pa.binary()) for value in values.values())], names=["node", *values])
            give_back()

        return texts.mapInArrow(run, "node long" + "".join(f", {c} binary" for c in values))

    def contents_of(wanted: DataFrame) -> DataFrame:
        return values_of(wanted, sketch=lambda token: sketch(token, shared.value), content=to_content)

    def bits_of(wanted: DataFrame) -> DataFrame:
        return values_of(wanted, bits=bit_table)

    sizes = nodes.select("node", F.col("n_shingles").alias("n"))

    def sift(pairs: DataFrame) -> DataFrame:
        one, two = sizes.select(F.col("node").alias("a"), F.col("n").alias("n_a")), sizes.select(F.col("node").alias("b"), F.col("n").alias("n_b"))
        return pairs.join(one, "a").join(two, "b").where(f"{SHARE[1]} * least(n_a, n_b) >= {SHARE[0]} * greatest(n_a, n_b)").select("a", "b")

    linked = linking.components(texts.mapInArrow(enter, linking.ENTRIES), contents_of, lambda raw: [from_content(x) for x in raw], accept, "ngram", sift, bits_of, bit_sieve, sieve, sieve_sets, ALL_PAIRS)
    # by distinct set first: a third of all rows may be one text
    own = materialize(nodes.join(linked, "node", "left").select("node", "least", F.col("n").alias("rows"), F.coalesce("component", "node").alias("label")), "ngram-labels")
    least = materialize(own.groupBy("label").agg(F.min("least").alias("first"), F.count(F.lit(1)).alias("n")), "ngram-least")
    first = materialize(join_skewed(own.select("label", "node", "rows"), least, "label", distinct).select("node", "first", F.col("rows").alias("n")), "ngram-first")
    some = join_skewed(rows, first, "node", total).select("doc_id", "tie", "n_shingles", "first")
    return some.unionByName(rows.where("node = 0").select("doc_id", "tie", "n_shingles", F.struct("doc_id", "tie").alias("first")))


def component_ids(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id reachable by links, itself included); see label."""
    return label(df, id_col, text_col).select("doc_id", "n_shingles", F.col("first.doc_id").alias("component_id"))


def keep_first(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df, with all their columns, that come first in their component."""
    found = label(df, id_col, text_col)
    gone = found.where(~F.struct("doc_id", "tie").eqNullSafe(F.col("first"))).select(F.coalesce("doc_id", F.lit(-(2**63))).alias("gone_doc"), F.col("tie").alias("gone_tie")).distinct()
    own = (F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))) == F.col("gone_doc")) & (F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))) == F.col("gone_tie"))
    return df.join(gone, own, "left_anti")
