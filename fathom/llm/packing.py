"""Packing documents into fixed-length token sequences by best-fit decreasing.

A document's ids are cut into full windows, each a sequence of its own, and one remainder.
Remainders are packed longest first; a segment tree over remaining capacities finds the
tightest open sequence.  Packing is dealt over shards of a few thousand documents, so no
task ever holds more than a shard and each shard wastes at most a few partly filled
sequences.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, short_batches, text_blocks

WINDOW = 2048
END_ID = 1
#: Documents in a shard on average; fixed, so that a task's work does not grow with the input.
SHARD_DOCS = 4096
VOCABULARY = "byte_bpe_50k"


@lru_cache(maxsize=4)
def encoder(vocabulary: str = VOCABULARY, folder: str | None = None):
    """text -> ids of ordinary text.  The ranks file holds the vocabulary of the .json tokenizer and gives the same ids faster."""
    import tiktoken

    if folder is None:
        import public_tokenizers

        path, pattern = public_tokenizers.path(f"{vocabulary}.tiktoken"), public_tokenizers.PATTERN
    else:
        from public_tokenizers import PATTERN as pattern

        path = f"{folder}/{vocabulary}.tiktoken"
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding(vocabulary, pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


@lru_cache(maxsize=4)
def added_tokens(vocabulary: str = VOCABULARY, folder: str | None = None) -> dict[str, int]:
    """The tokens that the .json tokenizer finds in a text before it splits and merges, with their ids."""
    if folder is None:
        import public_tokenizers

        path = public_tokenizers.path(f"{vocabulary}.json")
    else:
        path = f"{folder}/{vocabulary}.json"
    with open(path, encoding="utf-8") as file:
        tokens = json.load(file)["added_tokens"]
    for token in tokens:
        if token["single_word"] or token["lstrip"] or token["rstrip"]:
            raise ValueError(f"added token {token['content']!r} is not a plain literal")
    return {token["content"]: token["id"] for token in tokens}


@lru_cache(maxsize=4)
def full_encoder(vocabulary: str = VOCABULARY, folder: str | None = None):
    """text -> ids of the .json tokenizer: added tokens by their own ids, the text between them as ordinary text."""
    ordinary, added = encoder(vocabulary, folder), added_tokens(vocabulary, folder)
    split = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")").split if added else lambda text: [text]

    def encode(text: str) -> list[int]:
        if not any(token in text for token in added):
            return ordinary(text)
        ids: list[int] = []
        for k, part in enumerate(split(text)):
            ids += [added[part]] if k % 2 else ordinary(part)
        return ids

    return encode


class CapacityTree:
    """Open sequences by remaining capacity, in a binary segment tree over 0 .. size."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.used = bytearray(2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(size + 1)]

    def add(self, capacity: int, sequence: int) -> None:
        self.open[capacity].append(sequence)
        node = self.leaves + capacity
        while node and not self.used[node]:
            self.used[node] = 1
            node >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """The open sequence of least capacity >= need, with that capacity, removed from the tree."""
        node = self.leaves + need
        if not self.used[node]:
            while node > 1 and (node & 1 or not self.used[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node + (not self.used[2 * node])
        capacity = node - self.leaves
        sequence = self.open[capacity].pop()
        if not self.open[capacity]:
            while node and not (node < self.leaves and (self.used[2 * node] or self.used[2 * node + 1])):
                self.used[node] = 0
                node >>= 1
        return capacity, sequence


def best_fit_decreasing(lengths: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each piece; pieces of equal length go in input order."""
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    tree, opened = CapacityTree(window), 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        capacity, where = tree.take(need) or (window, -1)
        if where < 0:
            where, opened = opened, opened + 1
        sequence[i], offset[i] = where, window - capacity
        if capacity > need:
            tree.add(capacity - need, where)
    return sequence, offset


PIECES = "doc_id long, shard int, start long, length long, ids_crc32 long, doc_tokens long, ids array<int>"


def token_pieces(docs: DataFrame, shards: int, window: int = WINDOW, with_ids: bool = True, folder: str | None = None) -> DataFrame:
    """Each document's windows and remainder.  docs: doc_id, text, shard."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = full_encoder(VOCABULARY, folder)
        for batch in batches:
            rows, known = [], {}
            for doc, shard, text in zip(batch["doc_id"].to_pylist(), batch["shard"].to_pylist(), batch["text"].to_pylist(), strict=True):
                if (pieces := known.get(text)) is None:
                    ids = np.array([*encode(text), END_ID], dtype="<u4")
                    pieces = known[text] = [(s, len(part := ids[s : s + window]), zlib.crc32(part.tobytes()), len(ids), part.astype(np.int32) if with_ids else None) for s in range(0, len(ids), window)]
                rows += [(doc, shard, *piece) for piece in pieces]
            columns = zip(*rows, strict=True) if rows else [()] * 7
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "shard", "start", "length", "ids_crc32", "doc_tokens", "ids"])

    return docs.mapInArrow(cut, PIECES)


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, shard_docs: int = SHARD_DOCS, with_ids: bool = True, folder: str | None = None) -> DataFrame:
    """Pack all documents; one row per piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset and, unless with_ids is false, ids.

    Null and empty texts give one piece that holds only the end id.  Equal lengths are
    packed in the order of id, start and content, so a shard's result does not depend on the
    order of its rows; repeated rows are packed as often as they occur.  An empty table
    gives no rows.  sequence_id is the shard's number times 2**32 plus a number from 0.
    """
    short_batches(df.sparkSession)
    docs = id_and_text(df, id_col, text_col)
    shards = text_blocks(docs, shard_docs)
    docs = docs.withColumn("shard", F.pmod(F.xxhash64("doc_id", "text"), F.lit(shards)).cast("int"))
    pieces = token_pieces(docs, shards, window, with_ids, folder)

    def place(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        sequence, offset = best_fit_decreasing(table["length"].to_numpy(), window)
        first = table["shard"][0].as_py() << 32
        return table.drop_columns(["shard"]).append_column("sequence_id", pa.array(sequence + first)).append_column("offset", pa.array(offset))

    if not with_ids:
        pieces = pieces.drop("ids")
    tail = ", ids array<int>" if with_ids else ""
    return pieces.groupBy("shard").applyInArrow(place, f"doc_id long, start long, length long, ids_crc32 long, doc_tokens long{tail}, sequence_id long, offset long")
