"""Embeddings: a pluggable encoder and a deterministic offline default."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens

METADATA = ("chunk_id", "ticker", "fiscal_year", "filing_date", "strategy", "section_id", "section_title", "char_count", "chunk_index_in_filing")


class Encoder(Protocol):
    """Loads a model once per worker and encodes a list of texts."""

    def load(self) -> None: ...
    def encode(self, texts: list[str]) -> list[list[float]]: ...


def hashed(df: DataFrame, id_col: str, text_col: str = "text", dimensions: int = 64) -> DataFrame:
    """id, embedding: hashed bag of words, L2-normalised.  Native; a text without words gets zeros.

    A token's place is the last byte of its md5, so any engine can repeat it.
    """
    place = F.pmod(F.conv(F.substring(F.md5("t"), 31, 2), 16, 10).cast("int"), F.lit(dimensions))
    words = df.select(F.col(id_col).alias("id"), F.explode(tokens(text_col)).alias("t")).groupBy("id", place.alias("place")).agg(F.count(F.lit(1)).alias("c"))
    spread = words.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("place", "c"))).alias("m"), F.sqrt(F.sum(F.col("c") * F.col("c"))).alias("norm"))
    every = F.sequence(F.lit(0), F.lit(dimensions - 1))
    dense = F.transform(every, lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0)).cast("double") / F.col("norm"))
    zero = F.array_repeat(F.lit(0.0), dimensions)
    return df.select(F.col(id_col).alias("id")).join(spread.select("id", dense.alias("e")), "id", "left").select("id", F.coalesce("e", zero).alias("embedding"))


def encode(df: DataFrame, encoder: Encoder, id_col: str = "chunk_id", text_col: str = "text", batch: int = 64) -> DataFrame:
    """id, embedding by a model that each worker loads once; texts go to it in batches."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder.load()
        for rows in batches:
            texts = [t or "" for t in rows["text"].to_pylist()]
            found = [v for at in range(0, len(texts), batch) for v in encoder.encode(texts[at : at + batch])]
            yield pa.RecordBatch.from_arrays([rows["id"], pa.array(found, pa.list_(pa.float32()))], names=["id", "embedding"])

    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, embedding array<float>")


def metadata(chunks: DataFrame) -> DataFrame:
    return chunks.select(*METADATA)
