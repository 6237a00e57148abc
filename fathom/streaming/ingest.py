"""Incremental ingest: pages land as files, chunks are appended, each page once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..config import DEFAULTS, Settings
from ..operators import chunking, html, sections
from ..sources.filings import not_landed


def filings_of(pages: DataFrame, strict: bool = False) -> DataFrame:
    """Filings (nested sections) of pages: ticker, fiscal_year, filing_date, html."""
    from pyspark.sql import functions as F

    keyed = pages.withColumn("page", F.concat_ws("|", "ticker", F.col("fiscal_year").cast("string"), "filing_date"))
    texts = html.parse_pages(keyed, keep=("page", "ticker", "fiscal_year", "filing_date")).where("text is not null")
    rolled = sections.roll_up(sections.extract(texts, "page", strict=strict), texts.select("page"), "page")
    return texts.drop("text", "error").join(rolled, "page").drop("page")


def ingest(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, settings: Settings = DEFAULTS) -> StreamingQuery:
    """Read JSON pages as they arrive and append both strategies' chunks to target.

    A batch that is repeated after a failure adds nothing: filings that target already holds
    are skipped.
    """

    def add(batch: DataFrame, _: int) -> None:
        filings = filings_of(batch.dropDuplicates(["ticker", "fiscal_year"]))
        for strategy, cut in (("recursive", chunking.recursive), ("section_aware", chunking.section_aware)):
            fresh = filings
            path = f"{target}/{strategy}"
            hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            if hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
                fresh = not_landed(filings, spark.read.parquet(path).select("ticker", "fiscal_year").distinct(), ["ticker", "fiscal_year"])
            cut(fresh, settings).write.mode("append").parquet(path)

    return spark.readStream.schema(schema).json(source).writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
