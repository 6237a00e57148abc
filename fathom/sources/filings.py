"""Filing indexes, manifests and downloaded pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schemas import MANIFEST

ARCHIVE = "https://www.sec.gov/Archives/edgar/data"
FORM = "10-K"


def explode_index(index: DataFrame, keep: tuple[str, ...] = (), form: str = FORM) -> DataFrame:
    """One row per filing of exactly this form from columnar arrays (amendments are other forms)."""
    arrays = F.arrays_zip("form", "accessionNumber", "filingDate", "reportDate", "primaryDocument")
    rows = index.select(*keep, F.inline(arrays))
    return rows.where(F.col("form") == form).select(*keep, F.col("accessionNumber").alias("accession"), F.col("filingDate").alias("filing_date"), F.col("reportDate").alias("report_date"), F.col("primaryDocument").alias("primary_doc"))


def relevant_pages(pages: DataFrame, missing: DataFrame, by: str = "ticker") -> DataFrame:
    """Index pages (filingFrom, filingTo) that may hold a filing of a missing year (by, year).

    A year's filing is filed between its 1 January and the 30 June after it; dates compare as
    ISO strings.
    """
    years = missing.select(F.col(by).alias("of"), F.concat(F.col("year").cast("string"), F.lit("-01-01")).alias("low"), F.concat((F.col("year") + 1).cast("string"), F.lit("-06-30")).alias("high"))
    overlap = (F.col(by) == F.col("of")) & (F.col("filingTo") >= F.col("low")) & (F.col("filingFrom") <= F.col("high"))
    return pages.join(years, overlap, "left_semi")


def latest_per_year(filings: DataFrame, by: str = "ticker") -> DataFrame:
    """The filing with the latest report date of each company and year, ties by accession."""
    year = F.substring("report_date", 1, 4).cast("int")
    order = Window.partitionBy(by, "fiscal_year").orderBy(F.desc("report_date"), F.desc("accession"))
    return filings.withColumn("fiscal_year", year).withColumn("rn", F.row_number().over(order)).where("rn = 1").drop("rn")


def grid(companies: DataFrame, years: list[int], filings: DataFrame, by: str = "ticker") -> DataFrame:
    """Every company in every year, with its filing or nulls."""
    cells = companies.withColumn("fiscal_year", F.explode(F.array(*map(F.lit, years))))
    return cells.join(filings, [by, "fiscal_year"], "left")


def missing(companies: DataFrame, years: list[int], filings: DataFrame, by: str = "ticker") -> DataFrame:
    cells = companies.select(by).withColumn("fiscal_year", F.explode(F.array(*map(F.lit, years))))
    return cells.join(filings, [by, "fiscal_year"], "left_anti")


def url(cik: Column, accession: Column, document: Column, archive: str = ARCHIVE) -> Column:
    return F.concat_ws("/", F.lit(archive), cik.cast("long").cast("string"), F.translate(accession, "-", ""), document)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Rows with a file, paths with forward slashes."""
    rows = spark.read.schema(MANIFEST).csv(path, header=True)
    return rows.withColumn("file_path", F.replace("file_path", F.lit("\\"), F.lit("/"))).where("file_path is not null and file_path <> ''")


def write_manifest(manifest: DataFrame, path: str) -> None:
    manifest.select(*(f.split()[0] for f in MANIFEST.split(", "))).write.mode("overwrite").csv(path, header=True)


def not_landed(wanted: DataFrame, landed: DataFrame, keys: list[str]) -> DataFrame:
    """What still has to be fetched."""
    return wanted.join(landed.select(*keys), keys, "left_anti")


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """path, html of every file: UTF-8, undecodable bytes replaced; each file is one row."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.decode("content", F.lit("UTF-8")).alias("html")) if _lenient(spark) else files.mapInArrow(_decode, "path string, html string")


def _lenient(spark: SparkSession) -> bool:
    return spark.conf.get("spark.sql.legacy.codingErrorAction", "false") == "true"


def _decode(batches):
    import pyarrow as pa

    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch["path"], pa.array([b.decode("utf-8", "replace") for b in batch["content"].to_pylist()], pa.string())], names=["path", "html"])
