"""Answers: refusals, citations, prompts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

# The refusal sentence, what counts as a citation in scoring and in parsing, and denial words.
REFUSAL = "the provided filings do not contain this information"
CITATION_LIKE = r"(?U)\[\w*\d+\]"
CITATION = r"(?U)\[(\d+)\]"
DENIAL = r"(?U)\b(?:do not|cannot|not contain|not available|not disclose)\b"
SHORT = 150

SYSTEM = (
    "You answer questions about company filings from the numbered excerpts alone. "
    "Put the number of the excerpt in square brackets after every statement that rests on it, copy figures as they stand, and do not guess. "
    "If some excerpt helps, answer as far as it goes and say in your own words what is missing. "
    "If none does, reply with this sentence only: The provided filings do not contain this information."
)


def has_refusal(answer: Column) -> Column:
    return F.contains(F.lower(answer), F.lit(REFUSAL))


def is_refusal(answer: Column) -> Column:
    """A full refusal: the sentence without any citation, or a short denial."""
    return F.when(has_refusal(answer), ~answer.rlike(CITATION_LIKE)).otherwise((F.length(answer) < SHORT) & F.lower(answer).rlike(DENIAL))


def append_violation(answer: Column) -> Column:
    """The refusal sentence and a citation in one answer."""
    return has_refusal(answer) & answer.rlike(CITATION_LIKE)


def cited(answer: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(answer, F.lit(CITATION), F.lit(1)), lambda n: n.cast("decimal(38,0)"))))


def citations(answer: Column, n_chunks: Column) -> Column:
    """Valid excerpt numbers, ascending."""
    return F.transform(F.filter(cited(answer), lambda n: n.between(1, n_chunks)), lambda n: n.cast("int"))


def hallucinated(answer: Column, n_chunks: Column) -> Column:
    """Numbers that no excerpt has, 0 included, ascending."""
    return F.transform(F.filter(cited(answer), lambda n: ~n.between(1, n_chunks)), lambda n: n.cast("long"))


def excerpt_block(rank: Column, ticker: Column, year: Column, section: Column, text: Column) -> Column:
    missing = lambda c: F.coalesce(c.cast("string"), F.lit("?"))
    return F.concat(F.lit("["), rank.cast("string"), F.lit("] ("), missing(ticker), F.lit(" FY"), missing(year), F.lit(", "), missing(section), F.lit("):\n"), strip(F.coalesce(text, F.lit(""))))


def user_message(question: Column, context: Column) -> Column:
    return F.concat(F.lit("Question: "), question, F.lit("\n\nExcerpts:\n"), context, F.lit("\n\nAnswer:"))
