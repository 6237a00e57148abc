"""Where repeated windows may lie in a corpus: the routing below both substring dedup operators.

Hashes only route here; what repeats is decided by the operators, on units or bytes.

1. Texts that occur under several ids are one string with several owners (128 bits of hash):
   copies are settled at once and only the first goes on.
2. Every window is assigned to an anchor inside it (anchors.py).  One packed entry per chunk of
   neighbouring windows goes to the bucket of its core's hash.  A chunk whose core occurs
   nowhere else can't hold a repeated window; the others are open.
3. The units of open chunks go to the bucket of their core, equal ones of a task only once,
   and an operator's solver decides there.

A core in more than HOT different surroundings would make one large group.  Its windows are
dealt again, each under the hash of the whole window: then a group holds equal windows only,
of which each task sends one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import anchors
from .common import give_back, id_and_text, materialize, mix64, prefix_sums, ragged, short_batches, small, span_hashes
from .linking import bucket_bits, needed, passes

ENTRY = np.dtype([("core", "<u8"), ("context", "<u4"), ("stands", "<u4"), ("doc", "<i8"), ("tie", "<u4"), ("start", "<u4"), ("n", "<u2"), ("lead", "<u2"), ("many", "u1")])
#: Entries that a task holds before it sends them on, and entries in a bucket.  Rows sent are
#: entries / HELD x buckets; both are large, so a row holds many entries at any size.
HELD, PER_BUCKET = 300_000, 100_000
#: Surroundings of one core that a task sends as entries of their own; the rest is only counted.
SEEN = 256
#: Surroundings of one core from which on its windows are dealt one by one.
HOT = 16_000
#: Bytes that a task holds (units, and so much for each place) to send equal units once.
HELD_BYTES, PLACE_BYTES = 12 << 20, 400
#: Pieces in a group of the solver, about; a core's pieces stay together.
PER_GROUP = 4000
FOUND = "doc long, tie long, start long, n long, core long, lead long, hot boolean"
PIECES = "bucket long, core long, lead long, doc long, tie long, start long, n long, many boolean, units binary"
LOWEST = -(2**63)
#: Length of a span over a whole text, whatever its size.
WHOLE = 1 << 40


@dataclass(frozen=True)
class Scale:
    """Windows of `window` units, anchored by grams, in chunks of up to `chunk`; pieces reach `depth` units from each start."""

    window: int
    gram: int
    chunk: int
    depth: int
    hot: int


#: (number per unit of all texts, base of their hash, first unit of each text and the end, bytes of each unit range)
Units = Callable[[pa.Array], tuple[np.ndarray, int, np.ndarray, Callable[[int, int], bytes]]]
#: From the pieces of one bucket (a table of PIECES, each place once) to rows of the operator.
Solver = Callable[[pa.Table], pa.Table]


def keyed_docs(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc (the id, null: lowest), tie (32 bits of the text's hash), doc_id, text."""
    docs = id_and_text(df, id_col, text_col)
    return docs.select(F.coalesce("doc_id", F.lit(LOWEST)).alias("doc"), F.xxhash64("text").bitwiseAND(F.lit(2**32 - 1)).alias("tie"), "doc_id", "text")


def copies(docs: DataFrame) -> tuple[DataFrame, int]:
    """doc, tie, first (the least doc of that text) of the texts under several ids, and the bytes of all texts."""
    ids = materialize(docs.select("doc", "tie", F.xxhash64("text").alias("h"), F.xxhash64(F.lit(7), "text").alias("g"), F.octet_length("text").cast("long").alias("size")), "repeat-texts")
    twins = ids.groupBy("h", "g").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last").select("h", "g", "first")
    return materialize(ids.join(twins, ["h", "g"]).select("doc", "tie", "first").distinct(), "repeat-copies"), ids.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]


def _grouped(entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entries whose core is theirs alone, the others sorted by core, context and place, each place once)."""
    entry = entry[np.argsort(entry["core"], kind="stable")]
    twin = np.zeros(len(entry), bool)
    twin[1:] = entry["core"][1:] == entry["core"][:-1]
    twin[:-1] |= twin[1:]
    alone, rest = entry[~twin], entry[twin]
    rest = rest[np.lexsort([rest[c] for c in ("start", "tie", "doc", "context", "core")])]
    if len(rest):
        new = np.ones(len(rest), bool)
        new[1:] = np.logical_or.reduce([rest[c][1:] != rest[c][:-1] for c in ("core", "context", "doc", "tie", "start")])
        head = np.flatnonzero(new)
        many, stands = np.maximum.reduceat(rest["many"], head), np.maximum.reduceat(rest["stands"], head)
        rest = rest[new]
        rest["many"], rest["stands"] = many, stands
    return alone, rest


def thinned(entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries to send, one per context and at most SEEN per core, and those that are open already."""
    alone, rest = _grouped(entry)
    if not len(rest):
        return alone, rest
    core = np.concatenate([[True], rest["core"][1:] != rest["core"][:-1]])
    context = core | np.concatenate([[True], rest["context"][1:] != rest["context"][:-1]])
    group = np.cumsum(core) - 1
    order = np.cumsum(context)
    order -= order[np.flatnonzero(core)][group]
    rest["many"] |= (np.bincount(group)[group] > 1).astype(np.uint8)
    over = np.bincount(group, context)[group] - SEEN
    rest["stands"] += np.where((order == SEEN - 1) & (over > 0), over, 0).astype(np.uint32)
    go = context & (order < SEEN)
    left = np.concatenate([alone, rest[go]])
    return left[np.argsort(left["core"], kind="stable")], rest[~go]


def _cuts(value: np.ndarray) -> Iterator[tuple[int, int]]:
    """Begin and end of the runs of equal values."""
    edge = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1], [True]])).tolist() if len(value) else []
    return zip(edge[:-1], edge[1:], strict=True)


def sent(entry: np.ndarray, open_: np.ndarray, bits: int) -> pa.RecordBatch:
    """Rows (bucket, data): entries by core; open ones under negative buckets, spread evenly."""
    bucket = (entry["core"] >> np.uint64(64 - bits)).astype(np.int64)
    rows = [(int(bucket[a]), entry[a:b].tobytes()) for a, b in _cuts(bucket)]
    by = (mix64(open_["doc"].view(np.uint64) + open_["tie"]) >> np.uint64(64 - bits)).astype(np.int64) if len(open_) else np.zeros(0, np.int64)
    order = np.argsort(by, kind="stable")
    open_, by = open_[order], by[order]
    rows += [(-1 - int(by[a]), open_[a:b].tobytes()) for a, b in _cuts(by)]
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["bucket", "data"])


def send_all(parts: Iterator[np.ndarray], bits: int) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for part in parts:
        held.append(part)
        size += len(part)
        if size >= HELD:
            yield sent(*thinned(np.concatenate(held)), bits)
            held, size = [], 0
            give_back()
    if size:
        yield sent(*thinned(np.concatenate(held)), bits)
    give_back()


def opened(table: pa.Table, most: int) -> pa.Table:
    """The open chunks of one bucket; hot: its core has more than `most` surroundings."""
    entry, direct = np.frombuffer(b"".join(table["data"].to_pylist()), ENTRY), table["bucket"][0].as_py() < 0
    hot = np.zeros(len(entry), bool)
    if not direct:
        alone, rest = _grouped(entry)
        core = np.concatenate([[True], rest["core"][1:] != rest["core"][:-1]]) if len(rest) else np.zeros(0, bool)
        group = np.cumsum(core) - 1
        entry = np.concatenate([rest, alone[alone["many"] > 0]])
        hot = np.concatenate([np.bincount(group, rest["stands"].astype(np.int64) + 1)[group] if len(rest) else np.zeros(0), entry["stands"][len(rest) :] + 1]) > most
    column = lambda name: pa.array(entry[name].astype(np.int64))
    return pa.table({"doc": column("doc"), "tie": column("tie"), "start": column("start"), "n": column("n"), "core": pa.array(entry["core"].view(np.int64) if len(entry) else np.zeros(0, np.int64)), "lead": column("lead"), "hot": pa.array(hot)})


def chunk_entries(unit: np.ndarray, base: int, first: np.ndarray, doc: np.ndarray, tie: np.ndarray, scale: Scale) -> np.ndarray:
    """Entries of the chunks of some texts.  unit: a number per unit of all texts; first: where each begins, and the end."""
    prefix = prefix_sums(unit, base)
    at = np.arange(max(0, len(unit) - scale.gram + 1))
    text, s0, s1, core = anchors.chunks(span_hashes(prefix, base, at, at + scale.gram), first, scale.window, scale.gram, scale.chunk)
    out = np.zeros(len(text), ENTRY)
    out["core"] = span_hashes(prefix, base, core, core + scale.window - scale.chunk + 1)
    out["context"] = anchors.keyed(out["core"], span_hashes(prefix, base, s0, s1 + scale.window), core - s0) >> np.uint64(32)
    out["doc"], out["tie"], out["start"], out["n"], out["lead"] = doc[text], tie[text], s0 - first[text], s1 - s0 + 1, core - s0
    return out


def window_entries(unit: np.ndarray, base: int, start: np.ndarray, n: np.ndarray, text: np.ndarray, first: np.ndarray, doc: np.ndarray, tie: np.ndarray, window: int) -> np.ndarray:
    """One entry for each window of the chunks (start, n) of texts, under the window's own hash."""
    at, of = ragged(start, n), np.repeat(text, n)
    inside = at + window <= first[of + 1]
    at, of = at[inside], of[inside]
    out = np.zeros(len(at), ENTRY)
    out["core"] = span_hashes(prefix_sums(unit, base), base, at, at + window)
    out["doc"], out["tie"], out["start"], out["n"] = doc[of], tie[of], at - first[of], 1
    return out


def passing(docs: DataFrame, keys: DataFrame, inside: bool) -> DataFrame:
    """The documents that a bit filter over (doc, tie) of keys lets pass (inside), or the others."""
    spark = docs.sparkSession
    node = F.xxhash64("doc", "tie").alias("node")
    table = spark.sparkContext.broadcast(needed(keys.select(node)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = passes(table.value, batch["node"].to_numpy().view(np.uint64))
            yield batch.filter(pa.array(hit if inside else ~hit)).drop_columns(["node"])

    return docs.withColumn("node", node).mapInArrow(run, docs.schema)


def with_spans(docs: DataFrame, rows: DataFrame, value: list[str], name: str, later: DataFrame) -> DataFrame:
    """The documents that rows (doc, tie, ..) names and later (doc, tie) doesn't, with the array `name` of their rows; others are left out.

    later is taken off what is grouped by document already, so the rows are dealt out only once.
    """
    listed = rows.groupBy("doc", "tie").agg(F.collect_list(F.struct(*value)).alias(name)).join(later, ["doc", "tie"], "left_anti")
    keys = rows.select("doc", "tie").distinct().join(later, ["doc", "tie"], "left_anti")
    return passing(docs, keys, True).join(listed, ["doc", "tie"])


def _spans(batch: pa.RecordBatch) -> tuple[np.ndarray, list[np.ndarray]]:
    """Row number and columns of the open chunks of a batch."""
    spans = batch["open"]
    flat = spans.flatten()
    return np.repeat(np.arange(len(batch)), spans.value_lengths().to_numpy()), [flat.field(i).to_numpy() for i in range(flat.type.num_fields)]


def candidates(docs: DataFrame, units: Units, scale: Scale, bits: int, name: str) -> DataFrame:
    """Open chunks (FOUND) of docs (doc, tie, text); with a column open (start, n), its windows of scale.window one by one."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts() -> Iterator[np.ndarray]:
            for batch in small(batches):
                unit, base, first, _ = units(batch["text"])
                doc, tie = batch["doc"].to_numpy(), batch["tie"].to_numpy()
                if "open" in batch.schema.names:
                    text, (start, n) = _spans(batch)
                    yield window_entries(unit, base, start + first[text], n, text, first, doc, tie, scale.window)
                else:
                    yield chunk_entries(unit, base, first, doc, tie, scale)

        yield from send_all(parts(), bits)

    return materialize(docs.mapInArrow(index, "bucket long, data binary").groupBy("bucket").applyInArrow(lambda table: opened(table, scale.hot), FOUND), name)


def solved(docs: DataFrame, chunks: DataFrame, later: DataFrame, units: Units, depth: int, solve: Solver, settle: Callable[[list[tuple], tuple], tuple], schema: str) -> DataFrame:
    """Rows of the solver over the units of the chunks of documents that aren't in later; a group holds one core's chunks.

    Of equal pieces in a task the least place is sent; what is known of the others is a row of
    settle(their place, n and units' size, the least place), under a negative bucket.
    """
    rows = with_spans(docs, chunks, ["start", "n", "core", "lead"], "open", later).select("doc", "tie", "text", "open")
    bits = bucket_bits(chunks.count(), PER_GROUP)
    names = [f.split()[0] for f in PIECES.split(", ")]
    out_names = [f.split()[0] for f in schema.split(", ")]

    def flush(held: dict[tuple, list]) -> pa.RecordBatch:
        sent_rows = []
        for (core, lead, raw), places in held.items():
            sent_rows.append(((core >> (64 - bits)) & ((1 << bits) - 1), core, lead, *min(places), len(places) > 1, raw))
        columns = list(zip(*sent_rows, strict=True))
        kinds = [*(pa.int64() for _ in range(7)), pa.bool_(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    def rest(held: dict[tuple, list]) -> pa.RecordBatch:
        """Pieces that equal an earlier one of the task: the places only, with the first one's in place of units."""
        out = []
        for (core, lead, raw), places in held.items():
            if len(places) > 1:
                least = min(places)
                first = np.array([*least, len(raw)], np.int64).tobytes()
                out += [(-1 - (hash(p) & ((1 << bits) - 1)), core, lead, *p, True, first) for p in places if p != least]
        columns = list(zip(*out, strict=True)) or [()] * 9
        kinds = [*(pa.int64() for _ in range(7)), pa.bool_(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, set] = {}
        size = 0
        for batch in small(batches):
            _, _, first, raw_of = units(batch["text"])
            doc, tie = batch["doc"].to_pylist(), batch["tie"].to_pylist()
            text, (start, n, core, lead) = _spans(batch)
            at = start + first[text]
            end = np.minimum(at + n + depth - 1, first[text + 1])
            for t, s, m, c, x, a, b in zip(text.tolist(), start.tolist(), n.tolist(), core.tolist(), lead.tolist(), at.tolist(), end.tolist(), strict=True):
                raw = raw_of(a, b)
                places = held.setdefault((c, x, raw), set())
                places.add((doc[t], tie[t], s, m))
                size += PLACE_BYTES + (len(raw) if len(places) == 1 else 0)
            if size > HELD_BYTES:
                yield flush(held)
                yield rest(held)
                held, size = {}, 0
                give_back()
        if held:
            yield flush(held)
            yield rest(held)
        give_back()

    def decide(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        if table["bucket"][0].as_py() >= 0:
            return solve(table)
        first = np.frombuffer(b"".join(table["units"].to_pylist()), np.int64).reshape(-1, 5)
        place = tuple(table[c].to_numpy() for c in ("doc", "tie", "start", "n"))
        return pa.table(dict(zip(out_names, settle(place, tuple(first.T)), strict=True)))

    return rows.mapInArrow(cut_out, PIECES).groupBy("bucket").applyInArrow(decide, schema)


def repeated(df: DataFrame, id_col: str, text_col: str, units: Units, scale: Scale, windows: tuple[int, ...], unit_bytes: int, solve: Solver, settle: Callable, schema: str, name: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, copies, the solver's rows).  windows: the lengths that hot cores' windows are dealt by."""
    spark = df.sparkSession
    short_batches(spark)
    docs = keyed_docs(df, id_col, text_col)
    twins, size = copies(docs)
    bits = bucket_bits(size // unit_bytes, PER_BUCKET)
    text = docs.select("doc", "tie", "text")
    found = candidates(text, units, scale, bits, f"{name}-chunks")
    # of a text under several ids only the first goes on
    later = twins.where("doc > first").select("doc", "tie")
    hot = materialize(found.where("hot").select("core").distinct(), f"{name}-cores")
    rare = found
    out = []
    if not hot.isEmpty():
        hot = F.broadcast(hot)  # at most a chunk in HOT has one, and chunks are many: they stay where they are
        rare = found.join(hot, "core", "left_anti")
        crowded = materialize(with_spans(text, found.join(hot, "core", "left_semi"), ["start", "n"], "open", later).select("doc", "tie", "text", "open"), f"{name}-hot")
        for window in windows:
            one = Scale(window, window, 1, window, scale.hot)
            single = candidates(crowded, units, one, bits, f"{name}-windows")
            out.append(solved(text, single, later, units, window, solve, settle, schema))
    rows = solved(text, rare, later, units, scale.depth, solve, settle, schema)
    for more in out:
        rows = rows.unionByName(more)
    return docs, twins, materialize(rows, f"{name}-spans")


def merged(start: np.ndarray, length: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of the union of spans; spans that touch are one run."""
    if not len(start):
        return []
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate((start + length)[order])
    head = np.flatnonzero(np.concatenate([[True], start[1:] > end[:-1]]))
    return list(zip(start[head].tolist(), end[np.append(head[1:], len(end)) - 1].tolist(), strict=True))


def cut(docs: DataFrame, spans: DataFrame, keep: Callable[[str, list[np.ndarray]], tuple], schema: str, kinds: tuple) -> DataFrame:
    """Apply keep(text, columns start, n and kind of its spans) to every document; texts without spans are not shuffled."""
    names = [f.split()[0] for f in schema.split(", ")]
    nothing = [np.zeros(0, np.int64)] * 3

    def table(batch: pa.RecordBatch, rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
        return pa.RecordBatch.from_arrays([batch["doc_id"], *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=names)

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [keep(text, [cover.values.field(i).to_numpy() for i in range(3)] if cover.is_valid else nothing) for text, cover in zip(batch["text"].to_pylist(), batch["cover"], strict=True)]
            yield table(batch, rows)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield table(batch, [keep(text, nothing) for text in batch["text"].to_pylist()])

    listed = spans.groupBy("doc", "tie").agg(F.collect_list(F.struct("start", "n", "kind")).alias("cover"))
    touched = passing(docs, spans, True).join(listed, ["doc", "tie"], "left").select("doc_id", "text", "cover").mapInArrow(some, schema)
    return touched.unionByName(passing(docs, spans, False).select("doc_id", "text").mapInArrow(whole, schema))
