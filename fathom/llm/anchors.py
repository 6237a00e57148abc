"""Repeated fixed-length windows by content-defined anchors.

A window of W units (words or bytes) is assigned to the anchor it contains: the leftmost of
its k-unit grams with the least hash.  Equal windows have equal anchors, so only windows of
equal anchors need comparing.  Windows of one anchor are grouped into *chunks* of up to C
neighbours: the units all of them share are the chunk's core, the units that any of them
touches its context.  Chunks with equal context repeat as a whole; chunks with equal core but
different context are the only ones whose windows must be looked at one by one.
"""

from __future__ import annotations

import numpy as np

from .common import mix64, ragged, sliding_min

#: Positions that fit below 40 bits of hash in one sort key; longer arrays are done in pieces.
_PLACE = 24


def leftmost_least(hashes: np.ndarray, width: int) -> np.ndarray:
    """Position of the leftmost least hash (by its high 40 bits) in each run of `width`."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    out, piece = np.empty(n, np.int64), (1 << _PLACE) - width
    low = np.uint64((1 << _PLACE) - 1)
    for at in range(0, n, piece):
        part = hashes[at : min(at + piece, n) + width - 1]
        keys = part & ~low | np.arange(len(part), dtype=np.uint64)
        out[at : at + piece] = (sliding_min(keys, width) & low).astype(np.int64) + at
    return out


def chunks(hashes: np.ndarray, first: np.ndarray, window: int, gram: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, s0, s1, core's start) of each chunk: windows s0 .. s1 (positions in the whole array).

    hashes: of the gram from each unit on; first: each text's first unit, and the end.
    """
    count = np.maximum(np.diff(first) - window + 1, 0)
    start = ragged(first[:-1], count)
    if not len(start):
        return (np.zeros(0, np.int64),) * 4
    anchor = leftmost_least(hashes, window - gram + 1)[start]
    block = (anchor - start) // size
    text = np.repeat(np.arange(len(count)), count)
    new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (block[1:] != block[:-1]) | (text[1:] != text[:-1])])
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(start)) - 1
    return text[head], start[head], start[tail], anchor[head] - size * block[head]


def keyed(core: np.ndarray, context: np.ndarray, lead: np.ndarray) -> np.ndarray:
    """The context's hash together with how far its first window lies before the core."""
    return mix64(context + lead.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
