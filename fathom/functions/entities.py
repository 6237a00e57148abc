"""Companies and years named in a question."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Company aliases and their tickers, and the years of the corpus.
ALIASES = {
    "apple": "AAPL", "microsoft": "MSFT", "nvidia": "NVDA", "meta": "META", "facebook": "META", "google": "GOOGL", "alphabet": "GOOGL",
    "amazon": "AMZN", "jpmorgan": "JPM", "jp morgan": "JPM", "goldman sachs": "GS", "goldman": "GS", "walmart": "WMT", "tesla": "TSLA",
}
YEAR = r"(?U)\b(20(?:22|23|24))\b"


def companies(question: Column, aliases: dict[str, str] | None = None, word_boundary: bool = False) -> Column:
    """Tickers of the aliases found, longest alias first, each once.

    Aliases match anywhere in the text ("metadata" names META) unless word_boundary is set.
    """
    names = sorted((ALIASES if aliases is None else aliases).items(), key=lambda item: -len(item[0]))
    low = F.lower(question)
    found = [F.when(low.rlike(rf"(?U)\b\Q{name}\E\b") if word_boundary else F.contains(low, F.lit(name)), F.lit(ticker)) for name, ticker in names]
    return F.array_distinct(F.array_compact(F.array(*found))) if found else F.array().cast("array<string>")


def years(question: Column, pattern: str = YEAR) -> Column:
    """All years in order; repeats stay, so a year named twice sets no filter."""
    return F.transform(F.regexp_extract_all(question, F.lit(pattern), F.lit(1)), lambda y: y.cast("int"))
