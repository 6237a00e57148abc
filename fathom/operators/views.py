"""Presentation of hits: excerpts, labels, marks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import escape_html, excerpt, fixed3


def sources(hits: DataFrame, cited: DataFrame | None = None, ticker: str = "ticker", year: str = "fiscal_year", section: str = "section_id", size: int = 800) -> DataFrame:
    """qid, rank, id, label, excerpt (escaped) and is_cited, from hits and cited pairs (qid, id)."""
    label = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.coalesce(F.col(ticker).cast("string"), F.lit("?")), F.lit(" FY"), F.coalesce(F.col(year).cast("string"), F.lit("?")), F.lit(" · "), F.coalesce(F.col(section).cast("string"), F.lit("?")), F.lit(" · score "), fixed3(F.col("score").cast("double")))
    out = hits.withColumn("label", label).withColumn("excerpt", escape_html(excerpt(F.col("text"), size)))
    if cited is None:
        return out.select("qid", "rank", "id", "label", "excerpt", F.lit(False).alias("is_cited"))
    marks = cited.select("qid", "id", F.lit(True).alias("mark")).distinct()
    return out.join(marks, ["qid", "id"], "left").select("qid", "rank", "id", "label", "excerpt", F.coalesce("mark", F.lit(False)).alias("is_cited"))
