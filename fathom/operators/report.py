"""A Markdown report of an evaluation (small aggregates only reach the driver)."""

from __future__ import annotations

from pyspark.sql import DataFrame


def table(df: DataFrame, most: int = 1000) -> str:
    """A Markdown table of at most `most` rows; nulls read N/A."""
    head = "| " + " | ".join(df.columns) + " |\n|" + " --- |" * len(df.columns)
    rows = ["| " + " | ".join("N/A" if v is None else str(v) for v in row) + " |" for row in df.limit(most).collect()]
    return "\n".join([head, *rows])


def markdown(summary: DataFrame, generation: DataFrame, types: DataFrame, boundary: DataFrame, title: str = "Evaluation") -> str:
    parts = (("Retrieval", summary.orderBy("collection", "config")), ("Answers", generation), ("By question type", types.orderBy("ordinal").drop("ordinal")), ("Boundary-sensitive questions", boundary.orderBy("collection")))
    return "\n\n".join([f"# {title}", *(f"## {name}\n\n{table(df)}" for name, df in parts)]) + "\n"
