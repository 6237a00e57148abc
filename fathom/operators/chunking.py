"""Two chunkers: over a filing's joined sections, and section by section."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULTS, Settings
from .sections import slices

SEPARATORS = ("\n\n", "\n", ". ", " ", "")


def _pieces(text: str, separator: str) -> list[str]:
    """Cut before every separator, which opens the piece that follows."""
    if not separator:
        return list(text)
    head, *rest = text.split(separator)
    return [p for p in (head, *(separator + r for r in rest)) if p]


def _windows(pieces: list[str], size: int, overlap: int) -> Iterator[str]:
    """Greedy windows of whole pieces; each starts with up to `overlap` characters of the one before."""
    window: list[str] = []
    total = begin = 0
    for piece in pieces:
        if total + len(piece) > size and begin < len(window):
            text = "".join(window[begin:]).strip()
            if text:
                yield text
            while begin < len(window) and (total > overlap or (total + len(piece) > size and total > 0)):
                total -= len(window[begin])
                begin += 1
        window.append(piece)
        total += len(piece)
    text = "".join(window[begin:]).strip()
    if text:
        yield text


def split_text(text: str, size: int = DEFAULTS.chunk_size, overlap: int = DEFAULTS.chunk_overlap, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Split by the coarsest separator that occurs; what is still too long, by the finer ones."""
    level = next(i for i, s in enumerate(separators) if s in text)
    finer, out, short = separators[level + 1 :], [], []
    for piece in _pieces(text, separators[level]):
        if len(piece) < size:
            short.append(piece)
            continue
        out += _windows(short, size, overlap)
        short = []
        out += split_text(piece, size, overlap, finer) if finer else [piece]
    return out + list(_windows(short, size, overlap))


def attribute(texts: list[str], settings: Settings = DEFAULTS) -> list[tuple[int, int, str]]:
    """(chunk's index, section's index, chunk) over sections joined by blank lines.

    A chunk is found from a cursor on; it belongs to the section its start lies in (the last
    one if in none).  Chunks below the minimum are left out, but use up an index.
    """
    whole, starts, at = "\n\n".join(texts), [], 0
    for text in texts:
        starts.append(at)
        at += len(text) + 2
    out, cursor = [], 0
    for index, chunk in enumerate(split_text(whole, settings.chunk_size, settings.chunk_overlap)):
        place = whole.find(chunk, cursor)
        if place < 0:
            place = whole.find(chunk)
        if place >= 0:
            cursor = place + max(1, len(chunk) - settings.chunk_overlap)
        if len(chunk) < settings.min_chunk_chars:
            continue
        place = max(place, 0)
        home = bisect_right(starts, place) - 1
        if place >= starts[home] + len(texts[home]):
            home = len(texts) - 1
        out.append((index, home, chunk))
    return out


def chunk_id(ticker: Column, year: Column, strategy: str, index: Column) -> Column:
    return F.format_string("%s_%s_%s_%s", ticker, year.cast("string"), F.lit(strategy), F.when(index < 10_000, F.lpad(index.cast("string"), 4, "0")).otherwise(index.cast("string")))


_SPLIT = "ticker string, fiscal_year int, filing_date string, section_id string, section_title string, text string, chunk_index_in_filing int"


def _run(filings: DataFrame, cut) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for filing in batch.to_pylist():
                parts = sorted(filing["sections"] or [], key=lambda s: s["order"])
                rows += [(filing["ticker"], filing["fiscal_year"], filing["filing_date"], parts[home]["section_id"], parts[home]["section_title"], text, index) for index, home, text in cut(parts)]
            kinds = (pa.string(), pa.int32(), *[pa.string()] * 4, pa.int32())
            columns = list(zip(*rows, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[f.split()[0] for f in _SPLIT.split(", ")])

    return filings.select("ticker", "fiscal_year", "filing_date", "sections").mapInArrow(run, _SPLIT)


def _finish(rows: DataFrame, strategy: str) -> DataFrame:
    named = rows.withColumn("chunk_id", chunk_id(F.col("ticker"), F.col("fiscal_year"), strategy, F.col("chunk_index_in_filing")))
    return named.select("chunk_id", "ticker", "fiscal_year", "filing_date", F.lit(strategy).alias("strategy"), "section_id", "section_title", "text", F.length("text").alias("char_count"), "chunk_index_in_filing")


def recursive(filings: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Chunks over all sections of a filing; indexes have gaps where short chunks were dropped."""

    def cut(parts: list[dict]) -> list[tuple[int, int, str]]:
        kept = [i for i, s in enumerate(parts) if len(s["text"]) >= settings.min_section_chars]
        return [(index, kept[home], text) for index, home, text in attribute([parts[i]["text"] for i in kept], settings)] if kept else []

    return _finish(_run(filings, cut), "recursive")


def section_aware(filings: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Chunks that never cross a section; indexes run without gaps over a filing."""

    def cut(parts: list[dict]) -> list[tuple[int, int, str]]:
        out: list[tuple[int, int, str]] = []
        for home, section in enumerate(parts):
            text = section["text"]
            if len(text) < settings.min_section_chars:
                continue
            chunks = [text] if len(text) <= settings.chunk_size else split_text(text, settings.chunk_size, settings.chunk_overlap)
            out += [(len(out) + i, home, c) for i, c in enumerate(c for c in chunks if len(c) >= settings.min_chunk_chars)]
        return out

    return _finish(_run(filings, cut), "section_aware")


def containment_violations(chunks: DataFrame, sections: DataFrame, keys: list[str]) -> DataFrame:
    """Chunks whose first 100 characters don't occur in their own section."""
    own = sections.select(*keys, "section_id", F.col("text").alias("section_text"))
    return chunks.join(own, [*keys, "section_id"]).where(~F.contains("section_text", F.substring("text", 1, 100))).drop("section_text")


def counts(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("ticker", "fiscal_year", "strategy").agg(F.count(F.lit(1)).alias("n_chunks"))
