"""From shared keys to connected components, for similarity joins without a list of all pairs.

A *node* is a distinct content (its 64-bit hash); copies are one node from the start.  Nodes
meet under *keys* (prefix tokens, bands).  Under a key of few nodes all pairs are candidates.
Under a key of many nodes only the pairs with a leader are; once these are verified and
merged, whoever is still in another component than most of its fellows is compared with all
of them, in blocks, so no link is lost and no group is ever expanded into its pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fewer, give_back, materialize, mix64, short_batches

#: Nodes under a key up to which all pairs are candidates.
SMALL = 12
#: Nodes in a block of the comparison of a large family.
BLOCK = 512
#: Likely pairs per node of a meeting above which it first tells a spanning forest of them.
CROWD = 2
#: Bits of the filter that tells which nodes' contents are needed: 2 MB, however many there are.
FILTER_BITS = 24
#: Edges left up to which one task finishes the union-find: a round of it has several jobs, however few the edges.
FEW = 100_000
ENTRY = np.dtype([("key", "<u8"), ("node", "<u8")])
BUCKETS = 10
ENTRIES = "bucket int, data binary"


def entry_batches(key: np.ndarray, node: np.ndarray, bits: int = BUCKETS) -> pa.RecordBatch:
    """Entries as one binary value per bucket of the key's high bits."""
    data = np.empty(len(key), ENTRY)
    data["key"], data["node"] = key, node
    data = data[np.argsort(key, kind="stable")]
    bucket = (data["key"] >> np.uint64(64 - bits)).astype(np.int32)
    at = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(data) else np.zeros(0, np.int64)
    parts = [data[a:b].tobytes() for a, b in zip(at, [*at[1:], len(data)], strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(bucket[at], pa.int32()), pa.array(parts, pa.binary())], names=["bucket", "data"])


#: Entries that a task holds before it sends them on, and entries in a bucket: a row sent holds
#: HELD / buckets entries, so rows grow with the entries as long as there are fewer than HELD buckets.
HELD, PER_BUCKET = 2_000_000, 1_000_000


def send_entries(parts: Iterator[tuple[np.ndarray, np.ndarray]], bits: int) -> Iterator[pa.RecordBatch]:
    """The (key, node) arrays of one task as packed rows."""
    keys, nodes, size = [], [], 0
    for key, node in parts:
        keys.append(key)
        nodes.append(node)
        size += len(key)
        if size >= HELD:
            yield entry_batches(np.concatenate(keys), np.concatenate(nodes), bits)
            keys, nodes, size = [], [], 0
            give_back()
    if size:
        yield entry_batches(np.concatenate(keys), np.concatenate(nodes), bits)
    keys.clear(), nodes.clear()
    give_back()


def bucket_bits(rows: int, per_bucket: int = 20_000) -> int:
    return int(np.clip(int(np.ceil(np.log2(max(rows / per_bucket, 1)))), 6, 24))


def _meetings(table: pa.Table, most: int = SMALL) -> pa.Table:
    """kind 0: a candidate pair (a < b); kind 1: node a meets leader b under a large key."""
    data = np.frombuffer(b"".join(table["data"].to_pylist()), ENTRY)
    data = data[np.argsort(data["key"], kind="stable")]
    twin = np.zeros(len(data), bool)
    twin[1:] = data["key"][1:] == data["key"][:-1]
    twin[:-1] |= twin[1:]
    data = data[twin]  # most keys are of one node
    data = data[np.lexsort((data["node"], data["key"]))]
    data = data[np.concatenate([[True], (data["key"][1:] != data["key"][:-1]) | (data["node"][1:] != data["node"][:-1])])] if len(data) else data
    first = np.flatnonzero(np.concatenate([[True], data["key"][1:] != data["key"][:-1]])) if len(data) else np.zeros(0, np.int64)
    size = np.diff(np.append(first, len(data)))
    out = []
    for n in np.unique(size[(size >= 2) & (size <= most)]):
        grid = data["node"][first[size == n][:, None] + np.arange(n)]
        i, j = np.triu_indices(n, 1)
        out.append(np.unique(np.stack([grid[:, i].ravel(), grid[:, j].ravel()], 1), axis=0))
    pairs = np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 2), np.uint64)
    large = size > most
    if large.any():
        count = size[large]
        place = np.repeat(first[large] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        member = np.unique(np.stack([data["node"][place], np.repeat(data["node"][first[large]], count)], 1), axis=0)
    else:
        member = np.zeros((0, 2), np.uint64)
    both = np.concatenate([pairs, member]).view(np.int64)
    kind = np.repeat(np.array([0, 1], np.int32), [len(pairs), len(member)])
    give_back()
    return pa.table({"kind": kind, "a": both[:, 0], "b": both[:, 1]})


def meetings(entries: DataFrame, most: int = SMALL) -> DataFrame:
    """kind, a, b from entries of (key, node); most: nodes under a key up to which all pairs are candidates."""
    return entries.groupBy("bucket").applyInArrow(lambda table: _meetings(table, most), "kind int, a long, b long")


def needed(nodes: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """A bit filter of fixed size over column node: it never misses a node, but may let others pass."""
    slices = 1 << 4
    size = (1 << bits) // slices

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << bits, bool)
        for batch in batches:
            table[filter_places(batch["node"].to_numpy().view(np.uint64), bits)] = True
        place = np.flatnonzero(table)
        edge = np.searchsorted(place, np.arange(slices + 1) * size)
        some = np.flatnonzero(np.diff(edge))
        # few marks of a slice go as places, many as bits
        data = [(place[edge[i] : edge[i + 1]] - i * size).astype("<u4").tobytes() if 4 * (edge[i + 1] - edge[i]) < size // 8 else np.packbits(table[i * size : (i + 1) * size]).tobytes() for i in some]
        del table
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(data, pa.binary())], names=["slice", "data"])
        give_back()

    def merge(table: pa.Table) -> pa.Table:
        whole = np.zeros(size, bool)
        for raw in table["data"].to_pylist():
            if len(raw) == size // 8:
                whole |= np.unpackbits(np.frombuffer(raw, np.uint8)).view(bool)
            else:
                whole[np.frombuffer(raw, "<u4")] = True
        return pa.table({"slice": pa.array([table["slice"][0].as_py()], pa.int32()), "data": pa.array([np.packbits(whole).tobytes()], pa.binary())})

    # distinct first: what is sent is bounded by the nodes, not by the tasks that name them
    parts = fewer(nodes.select("node").distinct(), 8).mapInArrow(mark, "slice int, data binary").groupBy("slice").applyInArrow(merge, "slice int, data binary").collect()
    out = np.zeros((slices, (1 << bits) // 8 // slices), np.uint8)
    for row in parts:
        out[row["slice"]] = np.frombuffer(row["data"], np.uint8)
    return out.ravel()


def passes(table: np.ndarray, node: np.ndarray, bits: int = FILTER_BITS) -> np.ndarray:
    """Which nodes the filter lets pass."""
    place = filter_places(node, bits)
    return (table[place >> 3] >> (7 - (place & 7)).astype(np.uint8) & 1).astype(bool)


def filter_places(node: np.ndarray, bits: int = FILTER_BITS) -> np.ndarray:
    return (mix64(node + np.uint64(99)) >> np.uint64(64 - bits)).astype(np.int64)


def connected(edges: DataFrame, name: str) -> DataFrame:
    """node, component (its least node) for the nodes of edges (a, b).

    Distributed union-find: each round first replaces a partition's edges by a spanning
    forest, then every root hooks onto the least root next to it and pointers are halved.
    Only edges between different roots go on; rounds grow as the logarithm of a path.  The last
    FEW edges are one task's.
    """

    def trees(batches: Iterator[pa.RecordBatch], names: list[str], with_roots: bool) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (up := parent.setdefault(x, x)) != x:
                parent[x] = x = parent[up] if up in parent else up
            return x

        for batch in batches:
            for a, b in zip(batch["a"].to_pylist(), batch["b"].to_pylist(), strict=True):
                p, q = root(a), root(b)
                if p != q:
                    parent[max(p, q)] = min(p, q)
        pairs = [(root(x), x) for x in parent if with_roots or root(x) != x]
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in pairs], pa.int64()), pa.array([x for _, x in pairs], pa.int64())], names=names)

    def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return trees(batches, ["a", "b"], False)

    left = materialize(edges.select("a", "b").where("a <> b").mapInArrow(forest, "a long, b long"), f"{name}-edges")
    labels = None
    while n := left.count():
        if n <= FEW:
            up = left.coalesce(1).mapInArrow(lambda batches: trees(batches, ["up", "node"], True), "up long, node long").select("node", "up")
        else:
            both = left.union(left.select("b", "a"))
            up = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("up"))
            above = up.select(F.col("node").alias("up"), F.col("up").alias("top"))
            up = up.join(above, "up", "left").select("node", F.coalesce("top", "up").alias("up"))
        up = materialize(up, f"{name}-up")
        labels = up if labels is None else labels.join(up.select(F.col("node").alias("was"), F.col("up").alias("now")), labels["up"] == F.col("was"), "full_outer").select(F.coalesce("node", "was").alias("node"), F.coalesce("now", "up").alias("up"))
        if n <= FEW:
            break
        labels = materialize(labels, f"{name}-labels")
        one, two = up.select(F.col("node").alias("a"), F.col("up").alias("p")), up.select(F.col("node").alias("b"), F.col("up").alias("q"))
        moved = left.join(one, "a").join(two, "b").where("p <> q").select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"))
        left = materialize(moved.distinct().mapInArrow(forest, "a long, b long").distinct(), f"{name}-edges")
    spark = edges.sparkSession
    if labels is None:
        return spark.createDataFrame([], "node long, component long")
    return labels.select("node", F.col("up").alias("component"))


def pair_overlaps(sets: list[np.ndarray], one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Intersection size of sets[one[i]] and sets[two[i]], by one sort for each pair: short ones stay in a core's cache."""
    out = np.zeros(len(one), np.int64)
    for i, (p, q) in enumerate(zip(one.tolist(), two.tolist(), strict=True)):
        both = np.concatenate([sets[p], sets[q]])
        both.sort()
        out[i] = np.count_nonzero(both[1:] == both[:-1])
    return out


def only(rows: DataFrame, nodes: DataFrame, column: str) -> DataFrame:
    """node and a binary value (the column) of the rows whose node is among nodes, each node once."""
    some = rows.sparkSession.sparkContext.broadcast(needed(nodes))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(passes(some.value, batch["node"].to_numpy().view(np.uint64))))
        give_back()

    return rows.select("node", F.col(column).alias("value")).mapInArrow(pick, "node long, value binary").dropDuplicates(["node"])


def ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node")))


def verify(pairs: DataFrame, contents: DataFrame, alike: Callable[[list[bytes], list[bytes]], np.ndarray], column: str) -> DataFrame:
    """The pairs (a, b) that alike accepts; contents: node and the column that alike looks at."""
    values = only(contents, ends(pairs), column)
    one, two = values.select(F.col("node").alias("a"), F.col("value").alias("x")), values.select(F.col("node").alias("b"), F.col("value").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = alike(batch["x"].to_pylist(), batch["y"].to_pylist())
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
        give_back()

    return fewer(pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y"), 4).mapInArrow(run, "a long, b long")


def spanning_pairs(part: np.ndarray, pairs: Iterator[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Of pairs of rows (part: their component) a spanning forest of the components."""
    parent = {p: p for p in part.tolist()}

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for x, y in pairs:
        p, q = root(int(part[x])), root(int(part[y]))
        if p != q:
            parent[max(p, q)] = min(p, q)
            yield x, y


def crosswise(members: DataFrame, components: DataFrame, contents: DataFrame, column: str, pairs_of: Callable[[list[bytes], list[bytes]], Iterator[tuple[int, int]]], name: str, spanning: bool) -> DataFrame:
    """Pairs that leaders missed: among those who share a leader, all outside its main component against all others.

    members: a (node), b (leader).  All nodes under one large key share its leader.  They are
    dealt into blocks of about BLOCK nodes (small groups are one) and blocks are paired, so no task holds a whole
    group and work is outsiders x members.  Of the pairs that pairs_of finds (by the column of
    contents) those between different components count.  spanning: a meeting of two blocks
    with more than CROWD pairs per node tells only as many as would join its components if all
    held, and its leader in column again (a row without a pair).
    """
    rows = members.select(F.col("a").alias("node"), F.col("b").alias("family")).distinct().join(components, "node", "left").select("node", "family", F.coalesce("component", "node").alias("component"))
    rows = materialize(rows, f"{name}-members")
    sizes = rows.groupBy("family", "component").agg(F.count(F.lit(1)).alias("n"))
    main = sizes.groupBy("family").agg(F.max(F.struct("n", "component")).alias("main"), F.sum("n").alias("all"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    main = main.select("family", F.col("main.component").alias("main"), F.ceil(F.col("main.n") / BLOCK).cast("int").alias("inside"), F.ceil((F.col("all") - F.col("main.n")) / BLOCK).cast("int").alias("outside"), (F.col("all") <= BLOCK).alias("whole"))
    dealt = rows.join(main, "family").withColumn("out", F.col("component") != F.col("main")).withColumn("h", F.xxhash64("node"))
    dealt = dealt.withColumn("block", F.when(F.col("whole"), F.lit(0)).when(F.col("out"), F.pmod("h", "outside")).otherwise(F.col("outside") + F.pmod("h", "inside")).cast("int"))
    others = F.when(F.col("whole"), F.array(F.lit(0))).when(F.col("out"), F.sequence(F.lit(0), F.col("outside") + F.col("inside") - 1)).otherwise(F.sequence(F.lit(0), F.col("outside") - 1))
    meet = dealt.select("node", "family", "component", "block", "out", F.explode(others).alias("other"))
    meet = meet.select("node", "component", "block", "out", "family", F.xxhash64("family", F.least("block", "other"), F.greatest("block", "other")).alias("meeting"), F.least("block", "other").alias("low"))
    meet = materialize(meet, f"{name}-meet")
    full = meet.join(only(contents, meet, column), "node")

    def compare(table: pa.Table) -> pa.Table:
        low = table["low"][0].as_py()
        block, part, node = table["block"].to_numpy(), table["component"].to_numpy(), table["node"].to_numpy()
        value = table["value"].to_pylist()
        out = table["out"].to_numpy()
        mine = np.flatnonzero((block == low) & out)
        rest = np.flatnonzero(block != low) if (block != low).any() else np.arange(len(node))
        pairs = ((int(mine[i]), int(rest[j])) for i, j in pairs_of([value[i] for i in mine], [value[j] for j in rest]))
        pairs = [(x, y) for x, y in pairs if part[x] != part[y]]
        again = [table["family"][0].as_py()] if spanning and len(pairs) > CROWD * len(node) else []
        if again:
            pairs = list(spanning_pairs(part, iter(pairs)))
        ends = [sorted((int(node[x]), int(node[y]))) for x, y in pairs]
        nothing = [None] * len(again)
        del value, pairs
        if len(node) >= BLOCK:  # dear beside the work of a small meeting
            give_back()
        return pa.table({"a": pa.array([p for p, _ in ends] + nothing, pa.int64()), "b": pa.array([q for _, q in ends] + nothing, pa.int64()), "again": pa.array([None] * len(ends) + again, pa.int64())})

    return full.select("node", "component", "block", "out", "family", "meeting", "low", "value").groupBy("meeting").applyInArrow(compare, "a long, b long, again long").distinct()


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
    """For each left set its intersection size with every right set, through an inverted index."""
    token = np.concatenate(right) if right else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(right)), [len(s) for s in right])
    order = np.argsort(token, kind="stable")
    token, owner = token[order], owner[order]
    for i, own in enumerate(left):
        a, b = np.searchsorted(token, own), np.searchsorted(token, own, side="right")
        count = b - a
        place = np.repeat(a - (np.cumsum(count) - count), count) + np.arange(count.sum())
        yield i, np.bincount(owner[place], minlength=len(right))


def components(entries: DataFrame, contents_of: Callable[[DataFrame], DataFrame], to_sets: Callable[[list[bytes]], list[np.ndarray]], accept: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray], name: str, sift: Callable[[DataFrame], DataFrame] | None = None, bits_of: Callable[[DataFrame], DataFrame] | None = None, bit_sieve: Callable[[list[bytes], list[bytes]], np.ndarray] | None = None, sieve: Callable[[list[bytes], list[bytes]], np.ndarray] | None = None, sieve_sets: Callable[[list[bytes], list[bytes]], Iterator[tuple[int, int]]] | None = None, most: int = SMALL) -> DataFrame:
    """node, component for all nodes with a link.

    contents_of(nodes): node, content (and sketch, for sieve) of the nodes, at least once each,
    maybe with others.  accept(common, size, size): which pairs link.  sift: a filter on
    candidate pairs by what is known without contents.  bits_of(nodes): node, bits, far smaller
    than contents; bit_sieve filters pairs by two of them, sieve_sets all pairs of two lists;
    sketches and contents are then made only for the pairs left, and sieve filters these by two
    sketches.  None of these may reject a pair that links.
    """
    spark = entries.sparkSession
    short_batches(spark)
    met = materialize(meetings(entries, most), f"{name}-met")
    pairs = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
    pairs = materialize(sift(pairs) if sift else pairs, f"{name}-pairs")
    members = met.where("kind = 1").select("a", "b")
    raw = materialize((bits_of or contents_of)(ends(pairs).union(members.select(F.col("a").alias("node")))), f"{name}-contents")
    if bits_of:
        pairs = materialize(verify(pairs, raw, bit_sieve, "bits"), f"{name}-likely")

    def alike(left: list[bytes], right: list[bytes]) -> np.ndarray:
        number: dict[bytes, int] = {}
        one, two = (np.array([number.setdefault(x, len(number)) for x in side], np.int64) for side in (left, right))
        sets = to_sets(list(number))
        size = np.array([len(s) for s in sets], np.int64)
        out = np.array(accept(np.minimum(size[one], size[two]), size[one], size[two]))  # sizes leave room for enough
        out[out] = accept(pair_overlaps(sets, one[out], two[out]), size[one[out]], size[two[out]])
        return out

    def every_pair(left: list[bytes], right: list[bytes]) -> Iterator[tuple[int, int]]:
        sets = to_sets(left + right)
        p, q = sets[: len(left)], sets[len(left) :]
        size = np.array([len(s) for s in q])
        for i, common in overlaps(p, q):
            yield from ((i, int(j)) for j in np.flatnonzero(accept(common, np.full(len(q), len(p[i])), size)))

    def linked(pairs: DataFrame, kind: str) -> DataFrame:
        contents = materialize(contents_of(ends(pairs)), f"{name}-sets") if bits_of else raw
        if sieve:
            pairs = materialize(verify(pairs, contents, sieve, "sketch"), f"{name}-sieved")
        return materialize(verify(pairs, contents, alike, "content"), f"{name}-{kind}")

    edges = linked(pairs, "links")
    first = connected(edges, f"{name}-first")
    if members.isEmpty():
        return first
    if not sieve_sets:  # contents are small: compared exactly in the blocks, so a spanning forest of links is enough
        more = materialize(crosswise(members, first, raw, "content", every_pair, name, True).where("a is not null"), f"{name}-more")
        return connected(edges.union(more.select("a", "b")), f"{name}-all") if not more.isEmpty() else first
    # by bits: crowded meetings first tell what would join everything likely, then all that is likely and still apart
    for spanning in (True, False):
        likely = materialize(crosswise(members, first, raw, "bits", sieve_sets, name, spanning), f"{name}-likely")
        more = linked(likely.where("a is not null").select("a", "b"), "more")
        if not more.isEmpty():
            edges = edges.union(more)
            first = connected(edges, f"{name}-all")
        again = likely.where("again is not null").select(F.col("again").alias("b")).distinct()
        if not spanning or again.isEmpty():
            break
        members = members.join(again, "b", "left_semi").select("a", "b")
    return first
