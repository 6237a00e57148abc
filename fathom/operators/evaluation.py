"""Scoring of retrieval and answers: run matrix, hits, rates, percentiles, breakdowns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import COLLECTIONS, CONFIGS
from ..functions import answers, amounts


def id_set(column: Column) -> Column:
    return F.split(column, ";")


def truth(rows: DataFrame) -> DataFrame:
    """Ground truth with arrays and booleans in place of strings; years that aren't digits are left out."""
    years = F.transform(F.filter(id_set(F.col("relevant_years")), lambda y: F.trim(y).rlike(r"^\d+$")), lambda y: F.trim(y).cast("int"))
    return rows.withColumn("is_answerable", F.col("is_answerable") == "True").withColumn("sections", id_set(F.col("relevant_section_ids"))).withColumn("tickers", id_set(F.col("relevant_tickers"))).withColumn("years", years)


def run_matrix(questions: DataFrame, collections: tuple[str, ...] = COLLECTIONS, configs: tuple[str, ...] = CONFIGS) -> DataFrame:
    combos = F.explode(F.array(*(F.struct(F.lit(c).alias("collection"), F.lit(g).alias("config")) for c in collections for g in configs)))
    return questions.withColumn("combo", combos).select(*questions.columns, "combo.*")


def sample(questions: DataFrame, n: int, by: str = "qid") -> DataFrame:
    return questions.orderBy(by).limit(n)


def hit_at(hits: DataFrame, relevant: DataFrame, ks: tuple[int, ...] = (5, 10), keys: tuple[str, ...] = ("qid",)) -> DataFrame:
    """keys and hit{k}: whether any of the first k hits is relevant (qid, id); no hits: false."""
    marked = hits.join(relevant.select("qid", "id", F.lit(True).alias("good")).distinct(), ["qid", "id"], "left")
    return marked.groupBy(*keys).agg(*(F.coalesce(F.bool_or(F.col("good") & (F.col("rank") <= k)), F.lit(False)).alias(f"hit{k}") for k in ks))


def relevant_by_metadata(hits: DataFrame, known: DataFrame) -> DataFrame:
    """Hits whose section, ticker and year all are among a question's relevant ones."""
    good = F.array_contains("sections", F.col("section_id")) & F.array_contains("tickers", F.col("ticker")) & F.array_contains("years", F.col("fiscal_year"))
    return hits.join(known.select("qid", "sections", "tickers", "years"), "qid").where(good).select("qid", "id")


def index_percentile(values: Column, share: float) -> Column:
    """The value at place floor(n * share) of the ascending values (null if there are none)."""
    ordered = F.sort_array(F.filter(F.collect_list(values), lambda v: v.isNotNull()))
    return F.get(ordered, F.floor(F.size(ordered) * F.lit(share)).cast("int"))


def rate(flag: Column) -> tuple[Column, Column]:
    """(percent with one decimal, or null; number of rows where the flag isn't null)."""
    n = F.count(flag)
    return F.when(n > 0, F.round(100.0 * F.count(F.when(flag, 1)) / n, 1)), n


def summary(results: DataFrame) -> DataFrame:
    """Per collection and config: hit rates over answerable questions, latency percentiles over all."""
    asked5, asked10 = (F.when(F.col("is_answerable"), F.col(c)) for c in ("recall5", "recall10"))
    return results.groupBy("collection", "config").agg(
        rate(asked5)[0].alias("recall5_pct"), rate(asked10)[0].alias("recall10_pct"), rate(asked5)[1].alias("n_answerable"),
        index_percentile(F.col("retrieval_ms"), 0.5).alias("p50_ms"), index_percentile(F.col("retrieval_ms"), 0.95).alias("p95_ms"),
    )


def by_type(results: DataFrame, types: DataFrame) -> DataFrame:
    """Hits and total per question type, for all types (question_type, ordinal), absent ones as 0."""
    counted = results.where(F.col("is_answerable") & F.col("recall5").isNotNull()).groupBy("question_type").agg(F.count(F.when(F.col("recall5"), 1)).alias("hits"), F.count(F.lit(1)).alias("total"))
    return types.join(counted, "question_type", "left").select("ordinal", "question_type", F.coalesce("hits", F.lit(0)).alias("hits"), F.coalesce("total", F.lit(0)).alias("total"))


def slice_by_collection(results: DataFrame, question_type: str) -> DataFrame:
    rows = results.where((F.col("question_type") == question_type) & F.col("is_answerable") & F.col("recall5").isNotNull())
    return rows.groupBy("collection").agg(F.count(F.when(F.col("recall5"), 1)).alias("hits"), F.count(F.lit(1)).alias("total"))


def rescore(results: DataFrame) -> DataFrame:
    """Derive the answer columns anew from stored answers; rows without an answer get nulls."""
    refused, has = answers.is_refusal(F.col("answer")), F.col("answer").isNotNull()
    numeric = has & F.col("is_answerable") & F.col("expected_value").try_cast("double").isNotNull()
    return (
        results.withColumn("is_refusal", F.when(has, refused))
        .withColumn("correct_refusal", F.when(has & ~F.col("is_answerable"), refused))
        .withColumn("false_refusal", F.when(has & F.col("is_answerable"), refused))
        .withColumn("numerical_match", F.when(numeric, amounts.numeric_match(F.col("expected_value"), F.col("answer"))))
    )


def generation_summary(scored: DataFrame) -> DataFrame:
    """One row: numeric matches, refusals, false refusals, append violations, generation latency."""
    n = lambda c: F.count(F.when(c, 1))
    return scored.agg(
        n(F.col("numerical_match")).alias("numeric_hits"), F.count("numerical_match").alias("numeric_total"),
        n(F.col("correct_refusal")).alias("refusals"), n(~F.col("is_answerable")).alias("refusal_total"),
        n(F.col("false_refusal")).alias("false_refusals"), n(F.col("is_answerable")).alias("answerable_total"),
        n(answers.append_violation(F.col("answer"))).alias("append_violations"),
        index_percentile(F.col("generation_ms"), 0.5).alias("p50_ms"), index_percentile(F.col("generation_ms"), 0.95).alias("p95_ms"),
    )
