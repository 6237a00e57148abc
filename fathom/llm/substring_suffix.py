"""Suffix-array dedup of byte strings, by deep-shallow sorting.

The suffixes that can repeat (repeats.py finds where they lie) are sorted in groups that are
fixed by content, so a suffix and all that agree with it are in one group: multikey quicksort
to a shallow depth, then blind tries (suffix_sort).  Neighbours in that order tell each
suffix's longest common prefix with any other, up to `window` bytes, from which on the string
repeats and goes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import repeats
from .common import GRAM_BASE, joined, ragged
from .suffix_sort import sorted_suffixes

#: A string of WINDOW bytes that starts elsewhere too is removed.
WINDOW, GRAM, CHUNK = 400, 64, 128
#: Bytes per entry of the routing, for the number of buckets.
ENTRY_BYTES = 70
#: UTF-8 never has this byte: it ends the suffixes that reach their text's end.
END = 0xFF
SPANS = "doc long, tie long, start long, n long"


def _bytes(texts: pa.Array) -> tuple:
    buf, first = joined(texts, "")
    return buf.astype(np.uint64) + np.uint64(1), GRAM_BASE, first, lambda a, b: buf[a:b].tobytes()


def _spans(doc: np.ndarray, tie: np.ndarray, start: np.ndarray, n: np.ndarray, size: np.ndarray, window: int) -> tuple:
    """Spans of pieces of which every suffix repeats: n starts, size bytes."""
    starts = np.minimum(n, size - window + 1)
    hit = starts > 0
    return doc[hit], tie[hit], start[hit], starts[hit] + window - 1


def _table(parts: list[tuple]) -> pa.Table:
    columns = [np.concatenate(c).astype(np.int64) for c in zip(*parts, strict=True)]
    return pa.table(dict(zip(("doc", "tie", "start", "n"), map(pa.array, columns), strict=True)))


def sort_group(table: pa.Table, window: int) -> pa.Table:
    """Repeated spans among the pieces of one bucket, by the order of their suffixes."""
    names = ("core", "lead", "doc", "tie", "start", "n")
    column = [table[c].to_numpy() for c in names]
    place = np.lexsort(column[::-1])
    key = np.stack(column, 1)[place]
    new = np.concatenate([[True], (key[1:] != key[:-1]).any(1)])  # a repeated row is one document
    many = np.maximum.reduceat(table["many"].to_numpy(zero_copy_only=False)[place], np.flatnonzero(new))
    place = place[new]
    core, lead, doc, tie, start, n = (c[place] for c in column)
    raw = table["units"].take(pa.array(place)).to_pylist()
    size = np.array([len(r) for r in raw])
    # equal pieces are one string with several places
    number: dict[tuple, int] = {}
    which = np.array([number.setdefault(k, len(number)) for k in zip(core.tolist(), lead.tolist(), raw, strict=True)])
    many = np.bincount(which, weights=many) + np.bincount(which) > 1
    sure = many[which]
    parts = [_spans(doc[sure], tie[sure], start[sure], n[sure], size[sure], window)]
    one = np.unique(which, return_index=True)[1]
    together = np.unique(core[one], return_inverse=True)[1]
    one = one[np.bincount(together)[together] > 1]  # with other pieces of the core
    count, long = n[one], size[one]
    pad = count + window - 1
    text = np.full(int(pad.sum()), END, np.uint8)
    begin = np.cumsum(pad) - pad
    text[ragged(begin, long)] = np.frombuffer(b"".join(raw[i] for i in one.tolist()), np.uint8)
    suffix, of = ragged(begin, count), np.repeat(np.arange(len(one)), count)
    left = long[of] - (suffix - begin[of])
    # equal strings lie equally far before their core, so only those are sorted together
    shift = (lead[one][of] - (suffix - begin[of])).astype(np.uint64)
    group = core[one][of].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + shift if len(of) else np.zeros(0, np.uint64)
    order, common = sorted_suffixes(text, suffix, group, window)
    common = np.minimum(common, np.minimum(left[order], np.concatenate([[0], left[order][:-1]]))) if len(order) else common
    best = np.zeros(len(order), np.int64)
    best[order] = np.maximum(common, np.append(common[1:], 0)) if len(order) else 0
    hit = np.flatnonzero(best >= window)
    if len(hit):
        head = np.flatnonzero(np.concatenate([[True], (hit[1:] != hit[:-1] + 1) | (of[hit[1:]] != of[hit[:-1]])]))
        last = np.append(head[1:], len(hit)) - 1
        row = of[hit[head]]
        at = one[row]
        parts.append((doc[at], tie[at], start[at] + suffix[hit[head]] - begin[row], hit[last] - hit[head] + window))
    return _table(parts)


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, chunk: int = CHUNK, with_bytes: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, unless with_bytes is false, kept (binary).

    A byte goes if a string of `window` bytes over it also starts anywhere else, in this
    document or another.  Null and empty texts have no bytes.  Rows of equal id and text are
    one document, which does not repeat itself, and get equal results; an empty table gives
    none.
    """
    scale = repeats.Scale(window, min(gram, window), min(chunk, window - min(gram, window) + 1), window, repeats.HOT)

    def settle(place: tuple, first: tuple) -> tuple:
        return tuple(_table([_spans(*place, first[4], window)]).columns)

    docs, twins, rows = repeats.repeated(df, id_col, text_col, _bytes, scale, (window,), ENTRY_BYTES, lambda table: sort_group(table, window), settle, SPANS, "suffix")
    whole = twins.select("doc", "tie", F.lit(0).cast("long").alias("start"), F.lit(repeats.WHOLE).alias("n"))

    def keep(text: str, cover: list[np.ndarray]) -> tuple:
        raw, at, parts = text.encode(), 0, []
        start, n, _ = cover
        runs = ([(0, len(raw))] if len(raw) >= window else []) if (n == repeats.WHOLE).any() else repeats.merged(start, n)
        for a, b in runs:
            parts.append(raw[at:a])
            at = b
        kept = b"".join([*parts, raw[at:]])
        return len(raw), len(raw) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), kept if with_bytes else None

    spans = rows.unionByName(whole).withColumn("kind", F.lit(0).cast("long"))
    out = repeats.cut(docs, spans, keep, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary", (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()))
    return out if with_bytes else out.drop("kept")
