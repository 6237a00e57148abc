"""Exact vector top-n by cosine similarity, and a native form of the same score."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULTS, Settings
from . import predicates
from .lexical import ranked


def cosine(a: Column, b: Column) -> Column:
    """Native cosine in double precision (null if either vector has no length)."""
    product = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return product(a, b) / F.nullif(F.sqrt(product(a, a)) * F.sqrt(product(b, b)), F.lit(0.0))


#: Scores that a task holds at a time (8 bytes each), and numbers of the query vectors that it gets at a time.
SCORES, SHIPPED = 1 << 21, 1 << 23
#: Queries that are scored together.
TOGETHER = 1024


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Unit rows; a null or zero vector, or one of another width, is a row of NaN."""
    good = pc.fill_null(pc.equal(pc.list_value_length(column), width), False)
    out = np.full((len(column), width), np.nan)
    out[good.to_numpy(zero_copy_only=False)] = column.filter(good).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    with np.errstate(invalid="ignore", divide="ignore"):
        return out / np.sqrt((out * out).sum(1, keepdims=True))


def top_n(vectors: DataFrame, queries: DataFrame, n: int, id_col: str = "id", vector_col: str = "embedding", settings: Settings = DEFAULTS, exclude_self: bool = False, restricted: bool = False) -> DataFrame:
    """qid, id, score, rank for queries (qid, vector).

    Each task keeps its best n per query, so the shuffle carries tasks x queries x n rows at
    most.  Queries go to the tasks in blocks of settings.broadcast_queries (fewer if vectors are
    long), and a task scores a bounded block of pairs at a time; ties go by id.  If restricted,
    queries also have tickers and years, vectors ticker and year, and a query sees only what
    predicates.Allowed lets it.
    """
    asked = queries.select("qid", F.col("vector").cast("array<double>").alias("vector"), *(("tickers", "years") if restricted else ()))
    total, width = asked.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("vector")), F.lit(0))).first()
    base = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"), *(("ticker", "year") if restricted else ()))
    parts = max(1, -(-total // max(1, min(settings.broadcast_queries, SHIPPED // max(width, 1)))))
    out = None
    for part in range(parts):
        block = asked.where(F.pmod(F.xxhash64("qid"), F.lit(parts)) == part) if parts > 1 else asked
        rows = block.toArrow()
        qids, matrix = rows["qid"].to_numpy(), _matrix(rows["vector"].combine_chunks(), width) if len(rows) and width > 0 else np.zeros((0, 0))
        allowed = predicates.Allowed(rows["tickers"].to_pylist(), rows["years"].to_pylist()) if restricted else None
        found = base.mapInArrow(_scorer(qids, matrix, n, exclude_self, allowed), "qid long, id long, score double")
        out = found if out is None else out.unionByName(found)
    return ranked(out, n)


class _Best:
    """The n best (query's place, id, score) of each query of a block, and the score of its n-th."""

    def __init__(self, matrix: np.ndarray, n: int):
        self.n, self.edge = n, np.where(np.isnan(matrix).any(axis=1), np.inf, -np.inf)
        self.q = self.i = np.zeros(0, np.int64)
        self.s = np.zeros(0)

    def add(self, ids: np.ndarray, score: np.ndarray) -> None:
        """score: [queries, ids], NaN where there is none."""
        edge = self.edge
        if len(ids) > self.n and np.isneginf(edge).any():
            edge = np.maximum(edge, np.partition(np.where(np.isnan(score), -np.inf, score), len(ids) - self.n, axis=1)[:, len(ids) - self.n])
        q, i = np.nonzero(score >= edge[:, None] - 2e-6)  # rounding moves a score by half of 1e-6 at most
        if not len(q):
            return
        q, i, s = np.concatenate([self.q, q]), np.concatenate([self.i, ids[i]]), np.concatenate([self.s, np.round(score[q, i], 6) + 0.0])
        order = np.lexsort((i, -s, q))
        q, i, s = q[order], i[order], s[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        self.edge[q[place == self.n - 1]] = s[place == self.n - 1]
        self.q, self.i, self.s = q[place < self.n], i[place < self.n], s[place < self.n]


def _scorer(qids: np.ndarray, matrix: np.ndarray, n: int, exclude_self: bool, allowed: predicates.Allowed | None = None):
    blocks = [slice(at, at + TOGETHER) for at in range(0, len(matrix), TOGETHER)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [_Best(matrix[b], n) for b in blocks]
        step = max(1, SCORES // max(1, min(TOGETHER, len(matrix))))
        for whole in batches:
            for at in range(0, len(whole) if blocks else 0, step):
                batch = whole.slice(at, step)
                ids, rows = batch["id"].to_numpy(), _matrix(batch["vector"], matrix.shape[1])
                for block, kept in zip(blocks, best, strict=True):
                    score = matrix[block] @ rows.T
                    if exclude_self:
                        score[qids[block][:, None] == ids[None]] = np.nan
                    if allowed is not None:
                        score[~allowed.mask(batch["ticker"], batch["year"], block)] = np.nan
                    kept.add(ids, score)
        for block, kept in zip(blocks, best, strict=True):
            yield pa.RecordBatch.from_arrays([pa.array(qids[block][kept.q], pa.int64()), pa.array(kept.i, pa.int64()), pa.array(kept.s, pa.float64())], names=["qid", "id", "score"])

    return run
