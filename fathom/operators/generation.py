"""Prompts from hits, answers from a pluggable generator, citations resolved to chunks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import answers

#: (system text, user messages) -> answers, once per Arrow batch.
Generator = Callable[[str, list[str]], list[str]]


def prompts(hits: DataFrame, queries: DataFrame, ticker: str = "ticker", year: str = "fiscal_year", section: str = "section_id") -> DataFrame:
    """qid, message, chunks (in rank order), n_chunks; a question without hits gets an empty context."""
    block = answers.excerpt_block(F.col("rank"), F.col(ticker), F.col(year), F.col(section), F.col("text"))
    chunk = F.struct(F.col("id").cast("string").alias("chunk_id"), F.col(ticker).alias("ticker"), F.col(year).cast("string").alias("fiscal_year"), F.col(section).alias("section_id"))
    grouped = hits.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("rank", block.alias("block"), chunk.alias("chunk")))).alias("h"))
    out = queries.select("qid", "query").join(grouped, "qid", "left")
    context = F.coalesce(F.array_join(F.transform("h", lambda x: x["block"]), "\n\n"), F.lit(""))
    return out.select("qid", answers.user_message(F.col("query"), context).alias("message"), F.transform("h", lambda x: x["chunk"]).alias("chunks"), F.coalesce(F.size("h"), F.lit(0)).alias("n_chunks"))


def extractive(system: str, messages: list[str]) -> list[str]:
    """Offline stand-in for a model: the first sentence of the first excerpt, cited; else the refusal."""
    out = []
    for message in messages:
        head, _, rest = message.partition("\n\nExcerpts:\n")[2].partition(":\n")
        sentence = rest.partition("\n\nAnswer:")[0].partition(". ")[0].partition("\n")[0].strip()
        out.append(f"{sentence} [1]" if head and sentence else "The provided filings do not contain this information.")
    return out


def generate(prompted: DataFrame, generator: Generator = extractive, model: str = "extractive") -> DataFrame:
    """Adds answer (stripped) and generation_ms (its share of the batch's time)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import time

        for batch in batches:
            began = time.perf_counter()
            found = [a.strip() for a in generator(answers.SYSTEM, batch["message"].to_pylist())] if len(batch) else []
            spent = (time.perf_counter() - began) * 1000 / max(len(batch), 1)
            yield batch.append_column("answer", pa.array(found, pa.string())).append_column("generation_ms", pa.array([spent] * len(batch), pa.float64()))

    schema = T.StructType([*prompted.schema.fields, T.StructField("answer", T.StringType()), T.StructField("generation_ms", T.DoubleType())])
    return prompted.mapInArrow(run, schema).withColumn("model", F.lit(model))


def resolve(answered: DataFrame) -> DataFrame:
    """Adds citations (chunks, ascending by number) and hallucinated_citations."""
    n = F.coalesce(F.col("n_chunks"), F.lit(0))
    valid = answers.citations(F.col("answer"), n)
    return answered.withColumn("citations", F.transform(valid, lambda i: F.get("chunks", i - 1))).withColumn("hallucinated_citations", answers.hallucinated(F.col("answer"), n))
