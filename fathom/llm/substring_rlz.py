"""Substring dedup over words by relative Lempel-Ziv parsing.

The reference is the whole corpus in blocks: the words around all occurrences of one gram (the
anchor of their windows, see repeats.py), so a window and everything that equals it are in one
block, and a document meets every block that can hold a match.  In a block the pieces of
documents are indexed in corpus order.  Each piece is parsed greedily against what the block
has indexed before: at a word the longest match of at least 20 words is a factor, and the
parse goes on at the first window that crosses the factor's end, so that windows over a
factor boundary are looked up as well.  Words under factors are duplicates.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import repeats
from .common import GRAM_BASE, Words

WINDOW, GRAM = 20, 6
#: Bytes of text per entry of the routing, for the number of buckets.
ENTRY_BYTES = 45
FACTORS = "doc long, tie long, start long, n long, ref_doc long, ref_tie long, ref_start long"
NAMES = [f.split()[0] for f in FACTORS.split(", ")]
WORD = 8


def _words(texts: pa.Array) -> tuple:
    words = Words(texts)
    return words.hash, GRAM_BASE, words.first, lambda a, b: words.hash[a:b].tobytes()


class Block:
    """Indexed pieces of one block: each run of at least `window` words, by a hash of it and its distance from the core."""

    def __init__(self, window: int):
        self.window, self.pieces, self.at = window, [], {}

    def add(self, piece: bytes, starts: int, lead: int) -> None:
        number = len(self.pieces)
        self.pieces.append(piece)
        for a in range(starts):
            for b in range(a + self.window, len(piece) // WORD + 1):
                self.at.setdefault(hash((lead - a, piece[a * WORD : b * WORD])), (number << 16) + a)

    def find(self, run: bytes, distance: int) -> tuple[int, int] | None:
        """Number and offset of the first piece with that run; the words are compared."""
        found = self.at.get(hash((distance, run)))
        if found is None:
            return None
        number, a = found >> 16, found & 0xFFFF
        return (number, a) if self.pieces[number].startswith(run, a * WORD) else None


def parse(piece: bytes, starts: int, lead: int, block: Block) -> list[tuple[int, int, tuple[int, int]]]:
    """Greedy factors (offset, words, number and offset of the reference) of a piece of word hashes; windows begin at `starts` offsets."""
    out, at, size, window = [], 0, len(piece) // WORD, block.window
    while at < starts:
        low = at + window
        place = block.find(piece[at * WORD : low * WORD], lead - at) if low <= size else None
        if place is None:
            at += 1
            continue
        while low < size and (longer := block.find(piece[at * WORD : (low + 1) * WORD], lead - at)) is not None:
            low, place = low + 1, longer
        out.append((at, low - at, place))
        at = low - window + 1
    return out


def parse_block(table: pa.Table, window: int) -> pa.Table:
    """Factors of the pieces of one bucket, block by block, in corpus order."""
    names = ("core", "doc", "tie", "start", "n", "lead")
    column = [table[c].to_numpy() for c in names]
    order = np.lexsort(column[3::-1])
    core, doc, tie, start, n, lead = (c[order].tolist() for c in column)
    raw = table["units"].take(pa.array(order)).to_pylist()
    out: list[tuple] = []
    at = 0
    while at < len(core):
        to = at + 1
        while to < len(core) and core[to] == core[at]:
            to += 1
        block, places = Block(window), []
        known: dict[tuple[int, bytes], tuple] = {}
        for i in range(at, to if to - at > 1 else at):
            place = doc[i], tie[i], start[i]
            first = known.setdefault((lead[i], raw[i]), place)
            if first != place:  # a piece that is indexed as a whole is one factor
                out.append((*place, len(raw[i]) // WORD, *first))
            if first is not place:  # (or a repeated row, which is no earlier place)
                continue
            for a, m, (number, ref) in parse(raw[i], n[i], lead[i], block):
                out.append((*place[:2], place[2] + a, m, *places[number][:2], places[number][2] + ref))
            if i + 1 < to:
                block.add(raw[i], n[i], lead[i])
                places.append(place)
        at = to
    columns = list(zip(*out, strict=True)) or [()] * len(NAMES)
    return pa.table({c: pa.array(v, pa.int64()) for c, v in zip(NAMES, columns, strict=True)})


def _parsed(df: DataFrame, id_col: str, text_col: str, window: int, gram: int) -> tuple[DataFrame, DataFrame]:
    scale = repeats.Scale(window, gram, window - gram + 1, window, repeats.HOT)

    def settle(place: tuple, first: tuple) -> tuple:
        doc, tie, start, _ = place
        return tuple(map(pa.array, (doc, tie, start, first[4] // WORD, first[0], first[1], first[2])))

    docs, twins, rows = repeats.repeated(df, id_col, text_col, _words, scale, (window,), ENTRY_BYTES, lambda table: parse_block(table, window), settle, FACTORS, "rlz")
    zero = F.lit(0).cast("long")
    whole = twins.where("doc > first").select("doc", "tie", zero.alias("start"), F.lit(repeats.WHOLE).alias("n"), F.col("first").alias("ref_doc"), F.col("tie").alias("ref_tie"), zero.alias("ref_start"))
    return docs, rows.unionByName(whole)


def factors(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """The parse: doc, tie (32 bits of the text's hash), start, n (words), ref_doc, ref_tie, ref_start.

    A null id is the lowest long.  A factor lies in one block; longer matches are several
    overlapping ones.  A text that occurs under a lesser id has one factor from word 0 on whose
    n is repeats.WHOLE (it counts only if the text has a window at all).
    """
    return _parsed(df, id_col, text_col, window, gram)[1]


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, with_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, unless with_text is false, kept (words joined by a space).

    A word goes if a window of `window` words over it also starts earlier (lesser id, then
    text hash; or same document, earlier start).  Null and empty texts have no words.  Rows
    of equal id and text are one document and get equal results; a null id comes first; an
    empty table gives none.
    """
    docs, rows = _parsed(df, id_col, text_col, window, gram)

    def keep(text: str, cover: list[np.ndarray]) -> tuple:
        words = text.encode().split()
        total = len(words)
        start, n, _ = cover
        runs = ([(0, total)] if total >= window else []) if (n == repeats.WHOLE).any() else repeats.merged(start, n)
        for a, b in reversed(runs):
            del words[a:b]
        kept = b" ".join(words)
        return total, total - len(words), hashlib.sha256(kept).hexdigest(), kept.decode() if with_text else None

    spans = rows.select("doc", "tie", "start", "n", F.lit(0).cast("long").alias("kind"))
    out = repeats.cut(docs, spans, keep, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string", (pa.int64(), pa.int64(), pa.string(), pa.string()))
    return out if with_text else out.drop("kept")
