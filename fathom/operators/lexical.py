"""Okapi BM25 over an inverted index of plain DataFrames."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULTS, Settings
from ..functions.text import tokens
from . import predicates


@dataclass
class Index:
    """docs: id, toks, dl and the columns kept; terms: term, df (kept for all questions); and the statistics, which one pass over the documents has computed."""

    docs: DataFrame
    terms: DataFrame
    n: int
    avgdl: float
    n_terms: int
    avg_idf: float

    def idf(self, df: Column) -> Column:
        """A negative idf becomes a quarter of the vocabulary's mean idf."""
        raw = _raw_idf(self.n, df)
        return F.when(raw < 0, F.lit(0.25 * self.avg_idf)).otherwise(raw)


def _raw_idf(n: int, df: Column) -> Column:
    return F.log(F.lit(float(n)) - df + 0.5) - F.log(df + 0.5)


def build(df: DataFrame, id_col: str, text_col: str = "text", keep: tuple[str, ...] = ()) -> Index:
    """Tokenize lazily; one job counts the documents of each term, and with a row of no term the documents and their lengths.

    The term table is persisted (a lost executor's part is computed again); the driver gets the
    number of terms by df only, which are at most the square root of twice the postings.
    """
    docs = df.select(F.col(id_col).alias("id"), tokens(text_col).alias("toks"), *keep).withColumn("dl", F.size("toks"))
    each = docs.select(F.explode(F.concat(F.array_distinct("toks"), F.array(F.lit(None).cast("string")))).alias("term"), "dl")
    counted = each.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum(F.when(F.col("term").isNull(), F.col("dl"))).alias("length")).persist()
    rows = counted.groupBy(F.col("term").isNull().alias("all"), "df").agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("length")).collect()
    whole = next((r for r in rows if r["all"]), None)
    n = whole["df"] if whole else 0
    by_df = [(r["df"], r["n"]) for r in rows if not r["all"]]
    n_terms = sum(k for _, k in by_df)
    mean = math.fsum(k * (math.log(n - d + 0.5) - math.log(d + 0.5)) for d, k in by_df) / n_terms if n_terms else 0.0
    return Index(docs, counted.where("term is not null").select("term", "df"), n, (whole["length"] / n if n else 0.0) or 1.0, n_terms, mean)


def term_idf(index: Index) -> DataFrame:
    """term, df, idf of the whole vocabulary."""
    return index.terms.select("term", "df", index.idf(F.col("df")).alias("idf"))


def scores(index: Index, queries: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """qid, id, score of the documents that share a term with a query (qid, query).

    A query's repeated token counts each time; an unknown term adds nothing.  Only postings of
    query terms are formed, and document frequencies are counted from them.
    """
    asked = queries.select("qid", F.explode(tokens("query")).alias("term")).groupBy("qid", "term").agg(F.count(F.lit(1)).alias("qtf"))
    small = queries.limit(settings.broadcast_queries + 1).count() <= settings.broadcast_queries
    mark = F.broadcast if small else lambda d: d
    words = index.docs.select("id", "dl", F.explode("toks").alias("term")).join(mark(asked.select("term").distinct()), "term", "left_semi")
    postings = words.groupBy("id", "term", "dl").agg(F.count(F.lit(1)).alias("tf"))
    known = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df")).select("term", index.idf(F.col("df")).alias("idf"))
    weight = F.col("tf") * (settings.bm25_k1 + 1) / (F.col("tf") + settings.bm25_k1 * (1 - settings.bm25_b + settings.bm25_b * F.col("dl") / F.lit(index.avgdl)))
    joined = postings.join(mark(asked.join(known, "term")), "term")
    return joined.groupBy("qid", "id").agg(F.sum(F.col("qtf") * F.col("idf") * weight).alias("score"))


def _weights(index: Index, queries: DataFrame, settings: Settings) -> tuple[list, list[str], np.ndarray] | None:
    """(qids, terms, qtf x idf [term, question]) of a bounded set of questions; None if it is too large."""
    if queries.limit(settings.broadcast_queries + 1).count() > settings.broadcast_queries:
        return None
    asked = queries.select("qid", F.explode(tokens("query")).alias("term")).groupBy("qid", "term").agg(F.count(F.lit(1)).alias("qtf"))
    if asked.limit(ASKED + 1).count() > ASKED:
        return None
    known = index.terms.join(F.broadcast(asked.select("term").distinct()), "term", "left_semi").select("term", index.idf(F.col("df")).alias("idf"))
    rows = asked.join(known, "term").select("qid", "term", (F.col("qtf") * F.col("idf")).alias("w")).toArrow()
    qids = sorted({r["qid"] for r in queries.select("qid").collect()})
    terms = sorted(set(rows["term"].to_pylist()))
    if len(qids) * len(terms) > CELLS:
        return None
    place, column = {q: i for i, q in enumerate(qids)}, {t: i for i, t in enumerate(terms)}
    out = np.zeros((len(terms), len(qids)))
    for q, t, w in zip(rows["qid"].to_pylist(), rows["term"].to_pylist(), rows["w"].to_pylist(), strict=True):
        out[column[t], place[q]] += w
    return qids, terms, out


#: Bounds of what a task gets of the questions: distinct words of all, and cells of their weights (8 bytes each).
ASKED, CELLS = 1_000_000, 1 << 24
#: Hits per question up to which tasks keep their own best.
MOST_IN_PLACE = 1000
#: Cells of the document x term block that is scored at a time.
BLOCK_CELLS = 1 << 20
#: Questions whose restrictions are looked up together.
TOGETHER = 1024


def _best_in_place(docs: DataFrame, found: tuple[list, list[str], np.ndarray], avgdl: float, n: int, settings: Settings, kind: str, allowed: predicates.Allowed | None = None) -> DataFrame:
    """qid, id, score: each task's n best documents of each question; a term count is local to its row, so no posting is shuffled.

    allowed (then docs also have ticker and year) restricts the documents of each question.
    """
    qids, terms, weights = found
    k1, b = settings.bm25_k1, settings.bm25_b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = pa.array(terms, pa.string())
        score, ids = np.zeros((len(qids), 0)), None
        for whole in batches:
            rows = max(1, BLOCK_CELLS // max(len(terms), len(qids), 1))
            for at in range(0, len(whole), rows):
                batch = whole.slice(at, rows)
                toks = batch["toks"]
                length = pc.fill_null(pc.list_value_length(toks), 0).to_numpy().astype(np.int64)
                term = pc.fill_null(pc.index_in(toks.flatten(), vocabulary), -1).to_numpy(zero_copy_only=False).astype(np.int64)
                of = np.repeat(np.arange(len(batch)), length)
                hit = term >= 0
                tf = np.bincount(of[hit] * len(terms) + term[hit], minlength=len(batch) * len(terms)).reshape(len(batch), len(terms)).astype(np.float64)
                size = batch["dl"].to_numpy().astype(np.float64)[:, None]
                tf *= (k1 + 1) / (tf + k1 * (1 - b + b * size / avgdl))
                own = np.asarray(batch["id"].to_pylist() if kind == "string" else batch["id"].to_numpy())
                new = (tf @ weights).T
                for some in range(0, len(qids) if allowed is not None else 0, TOGETHER):
                    new[some : some + TOGETHER][~allowed.mask(batch["ticker"], batch["year"], slice(some, some + TOGETHER))] = -np.inf
                place = np.empty(len(own), np.int64)
                place[np.argsort(own, kind="stable")] = np.arange(len(own))  # the block's best go by numbers, ids may be long strings
                first = np.lexsort((np.broadcast_to(place, new.shape), -np.round(new, 6)), axis=-1)[:, :n]
                score = np.hstack([score, np.take_along_axis(new, first, 1)])
                ids = own[first] if ids is None else np.hstack([ids, own[first]])
                first = np.lexsort((ids, -np.round(score, 6)), axis=-1)[:, :n]
                score, ids = np.take_along_axis(score, first, 1), np.take_along_axis(ids, first, 1)
        if ids is not None:
            some = np.isfinite(score)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.asarray(qids), score.shape[1])[some.ravel()]), pa.array(ids[some].tolist() if kind == "string" else ids[some]), pa.array(score[some])], names=["qid", "id", "score"])

    return docs.select("id", "toks", "dl", *(("ticker", "year") if allowed is not None else ())).where("id is not null").mapInArrow(run, f"qid long, id {kind}, score double")


def ranked(scored: DataFrame, n: int, by: str = "qid") -> DataFrame:
    """The first n rows per query: descending score (6 decimals), then id; adds rank from 1."""
    order = Window.partitionBy(by).orderBy(F.desc("score"), "id")
    return scored.withColumn("score", F.round("score", 6)).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def top_n_restricted(index: Index, docs: DataFrame, queries: DataFrame, n: int, settings: Settings = DEFAULTS) -> DataFrame | None:
    """top_n in place over docs (id, toks, dl, ticker, year), each question (qid, query, tickers, years) as predicates.Allowed lets it; None if the questions are too many."""
    kind = docs.schema["id"].dataType.simpleString()
    if kind not in ("bigint", "int", "string") or n > MOST_IN_PLACE or (found := _weights(index, queries.withColumn("qid", F.col("qid").cast("long")), settings)) is None:
        return None
    entities = {r["qid"]: (r["tickers"], r["years"]) for r in queries.select(F.col("qid").cast("long").alias("qid"), "tickers", "years").collect()}
    allowed = predicates.Allowed([entities[q][0] for q in found[0]], [entities[q][1] for q in found[0]])
    return ranked(_best_in_place(docs, found, index.avgdl, n, settings, kind, allowed), n)


def top_n(index: Index, queries: DataFrame, n: int, settings: Settings = DEFAULTS, allowed: DataFrame | None = None, within: DataFrame | None = None) -> DataFrame:
    """qid, id, score, rank: always n rows per query as long as there are n documents.

    Documents without any query term score 0 and fill up, by id.  allowed (qid, id) restricts
    the documents of each query, within (id) those of all; statistics stay those of the whole
    corpus.
    """
    kind = index.docs.schema["id"].dataType.simpleString()
    bounded = _weights(index, queries.withColumn("qid", F.col("qid").cast("long")), settings) if allowed is None and kind in ("bigint", "int", "string") and n <= MOST_IN_PLACE else None
    if bounded is not None:
        docs = index.docs if within is None else index.docs.join(within.select("id"), "id", "left_semi")
        return ranked(_best_in_place(docs, bounded, index.avgdl, n, settings, kind), n)
    found = scores(index, queries, settings)
    if within is not None:
        found = found.join(within.select("id"), "id", "left_semi").select("qid", "id", "score")
    if allowed is not None:
        found = found.join(allowed, ["qid", "id"], "left_semi")
        rest = allowed.join(found, ["qid", "id"], "left_anti").withColumn("r", F.row_number().over(Window.partitionBy("qid").orderBy("id"))).where(F.col("r") <= n).drop("r")
        return ranked(found.unionByName(rest.withColumn("score", F.lit(0.0))), n)
    pool_size = 2 * n
    if index.avg_idf < 0:  # scores can be negative, so a query may have seen many documents and still need others
        ahead = F.count(F.when(F.col("score") >= 0, 1))
        seen = found.groupBy("qid").agg(ahead.alias("ahead"), F.count(F.lit(1)).alias("seen")).where(F.col("ahead") < n)
        pool_size = n + max(n, seen.agg(F.max("seen")).first()[0] or 0)
    pool = (index.docs if within is None else within).select("id").orderBy("id").limit(pool_size)  # holds n documents that a query short of hits has not seen
    fill = queries.select("qid", F.lit(1).alias("one")).join(F.broadcast(pool.withColumn("one", F.lit(1))), "one").drop("one").join(found, ["qid", "id"], "left_anti")
    return ranked(found.unionByName(fill.withColumn("score", F.lit(0.0))), n)
