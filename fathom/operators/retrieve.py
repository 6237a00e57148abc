"""Retrieval for a batch of questions: one lazy plan per configuration."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import ALL_CONFIGS, DEFAULTS, Settings
from ..functions import entities
from . import dense, fusion, lexical, predicates, rerank


@dataclass
class Collection:
    """chunks: id, text and metadata.  vectors: id, embedding.  index: of the same chunks."""

    chunks: DataFrame
    vectors: DataFrame
    index: lexical.Index
    ticker: str = "ticker"
    year: str = "fiscal_year"


def with_entities(queries: DataFrame, aliases: dict[str, str] | None = None, year_pattern: str = entities.YEAR) -> DataFrame:
    return queries.withColumn("tickers", entities.companies(F.col("query"), aliases)).withColumn("years", entities.years(F.col("query"), year_pattern))


def allowed_pairs(queries: DataFrame, chunks: DataFrame, ticker: str = "ticker", year: str = "fiscal_year") -> DataFrame:
    """(qid, id) that the entities of restricted questions allow, by equi joins per kind of restriction."""
    meta = chunks.select("id", F.col(ticker).alias("ticker"), F.col(year).cast("int").alias("year"))
    asked = queries.select("qid", "tickers", F.when(F.size("years") == 1, F.get("years", F.lit(0))).alias("year"))
    named = asked.where("size(tickers) > 0").withColumn("ticker", F.explode("tickers"))
    both = named.where("year is not null").join(meta, ["ticker", "year"])
    by_ticker = named.where("year is null").drop("year").join(meta, "ticker")
    by_year = asked.where("size(tickers) = 0 and year is not null").join(meta, "year")
    return both.select("qid", "id").union(by_ticker.select("qid", "id")).union(by_year.select("qid", "id"))


def _by_term_filtered(collection: Collection, queries: DataFrame, chunks: DataFrame, meta: DataFrame, within: DataFrame | None, n: int, settings: Settings) -> DataFrame:
    """BM25 under the questions' entities: in place over the documents, whose index may hold the metadata; by pairs if the questions are too many."""
    docs, names = collection.index.docs, (collection.ticker, collection.year)
    if within is not None:
        docs = docs.join(within, "id", "left_semi")
    if set(names) <= set(docs.columns):
        docs = docs.select("id", "toks", "dl", F.col(names[0]).cast("string").alias("ticker"), F.col(names[1]).cast("int").alias("year"))
    else:
        docs = docs.join(meta, "id", "left")
    found = lexical.top_n_restricted(collection.index, docs, queries, n, settings)
    if found is not None:
        return found
    restricted = (F.size("tickers") > 0) | (F.size("years") == 1)
    bound = queries.where(restricted)
    free = lexical.top_n(collection.index, queries.where(~restricted), n, settings, within=within)
    return free.unionByName(lexical.top_n(collection.index, bound, n, settings, allowed_pairs(bound, chunks, *names)))


def retrieve(queries: DataFrame, collection: Collection, config: str, top_k: int = DEFAULTS.top_k, settings: Settings = DEFAULTS, score: Callable[[DataFrame], DataFrame] = rerank.lexical_scores, where: dict | None = None) -> DataFrame:
    """Hits: qid, rank, id, score, retrieval_method and the chunk's columns.

    queries: qid (long), query, vector; for filter configurations also tickers and years
    (with_entities).  where is a clause for all questions.  Candidate ids are ranked first;
    texts and metadata join last.
    """
    if config not in ALL_CONFIGS:
        raise ValueError(f"unknown config {config!r}; known: {', '.join(ALL_CONFIGS)}")
    pool = settings.candidate_pool if "rerank" in config else max(4 * top_k, settings.candidate_pool)
    n = top_k if config == "dense" else pool
    chunks, vectors, within = collection.chunks, collection.vectors, None
    if where is not None:
        chunks = predicates.apply(chunks, where)
        within = chunks.select("id")
        vectors = vectors.join(within, "id", "left_semi")
    filtered = config.endswith("_filter")  # questions without entities search everything, the others what they allow
    if filtered:
        meta = chunks.select("id", F.col(collection.ticker).cast("string").alias("ticker"), F.col(collection.year).cast("int").alias("year"))
        by_vector = dense.top_n(vectors.join(meta, "id", "left"), queries, n, settings=settings, restricted=True)
    else:
        by_vector = dense.top_n(vectors, queries, n, settings=settings)
    if config == "dense":
        found = by_vector.select("qid", "id", "score", "rank")
    else:
        by_term = _by_term_filtered(collection, queries, chunks, meta, within, pool, settings) if filtered else lexical.top_n(collection.index, queries, pool, settings, within=within)
        fused = fusion.top_k(fusion.fuse([by_vector, by_term], settings.rrf_k), 2, pool if "rerank" in config else top_k)
        found = fused.select("qid", "id", "score", "rank")
    if "rerank" in config:
        pairs = found.drop("score").join(queries.select("qid", "query"), "qid").join(collection.chunks.select("id", "text"), "id")
        found = rerank.reorder(score(pairs), top_k).select("qid", "id", "score", "rank")
    return found.join(collection.chunks, "id").withColumn("retrieval_method", F.lit(config))


def point_lookup(chunks: DataFrame, wanted: DataFrame, id_col: str = "id") -> DataFrame:
    """Chunks of an ordered list of ids (qid, ids), with their place from 0; unknown ids are reported as nulls."""
    asked = wanted.select("qid", F.posexplode("ids").alias("place", id_col))
    return asked.join(chunks, id_col, "left")
