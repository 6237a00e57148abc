"""Sections of a filing: header scan, segmentation, choice of one body per item, roll-up.

The scan yields header positions (code points) in one Arrow stage; everything after it is
relational.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip

# The items of an annual report with their section ids and default titles, and those required.
ITEMS = {
    "1": ("item_1", "Business"),
    "1a": ("item_1a", "Risk Factors"),
    "1b": ("item_1b", "Cybersecurity"),
    "2": ("item_2", "Properties"),
    "3": ("item_3", "Legal Proceedings"),
    "4": ("item_4", "Mine Safety Disclosures"),
    "5": ("item_5", "Market Information"),
    "6": ("item_6", "Reserved"),
    "7": ("item_7", "MD&A"),
    "7a": ("item_7a", "Quantitative Risk"),
    "8": ("item_8", "Financial Statements"),
    "9": ("item_9", "Changes in Disagreements"),
    "9a": ("item_9a", "Controls and Procedures"),
    "9b": ("item_9b", "Other Information"),
    "9c": ("item_9c", "Insider Trading"),
    "10": ("item_10", "Directors and Officers"),
    "11": ("item_11", "Executive Compensation"),
    "12": ("item_12", "Security Ownership"),
    "13": ("item_13", "Certain Relationships"),
    "14": ("item_14", "Principal Accountant Fees"),
    "15": ("item_15", "Exhibits"),
    "16": ("item_16", "Form 10-K Summary"),
}
REQUIRED = ("item_1", "item_1a", "item_7", "item_7a", "item_8", "item_9a")
HEADER = r"(?:^|\n)[ \t]*item\s+(\d+\s*[a-z]?)[ \t]*[.\-—–:]?[ \t]*([^\n]{0,120})"
STRICT_HEADER = r"(?:^|\n)[ \t]*item[ \t]+(\d+[a-z]?)\b[ \t]*[.\-—–:]?[ \t]*([^\n]{0,120})"


#: Bytes of a batch that are Python objects at a time (a single row may have more).
AT_ONCE = 1 << 20


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in order, about AT_ONCE bytes at a time; freed Arrow memory goes back to the system after each batch."""
    for batch in batches:
        step = max(1, len(batch) * AT_ONCE // max(batch.nbytes, 1))
        for at in range(0, len(batch), step):
            yield batch.slice(at, step)
        del batch
        pa.default_memory_pool().release_unused()


def scan_headers(df: DataFrame, key: str, text_col: str = "text", strict: bool = False) -> DataFrame:
    """key, item, title, pos of every item header.

    Unless strict, the item's key may take in a letter after white space, even of the next line.
    """
    pattern = re.compile(STRICT_HEADER if strict else HEADER, re.I | re.M)
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = [(i, "".join(m[1].split()).lower(), m[2].strip().rstrip("."), m.start()) for i, text in enumerate(batch["text"].to_pylist()) for m in pattern.finditer(text or "")]
            at, item, title, pos = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch["key"].take(pa.array(at, pa.int64())), pa.array(item, pa.string()), pa.array(title, pa.string()), pa.array(pos, pa.int64())], names=[key, "item", "title", "pos"])

    return df.select(F.col(key).alias("key"), F.col(text_col).alias("text")).mapInArrow(run, f"`{key}` {kind}, item string, title string, pos long")


def item_dimension(df: DataFrame) -> DataFrame:
    rows = [(k, s, t) for k, (s, t) in ITEMS.items()]
    return df.sparkSession.createDataFrame(rows, "item string, section_id string, default_title string")


def segment(headers: DataFrame, texts: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """Known headers with the body up to the next known header of their document: adds body_len, text_end."""
    known = headers.join(F.broadcast(item_dimension(headers)), "item")
    full = texts.select(key, F.length(text_col).cast("long").alias("n"))
    order = Window.partitionBy(key).orderBy("pos")
    return known.join(full, key).withColumn("text_end", F.coalesce(F.lead("pos").over(order), F.col("n"))).withColumn("body_len", F.col("text_end") - F.col("pos")).drop("n")


def longest(segments: DataFrame, key: str) -> DataFrame:
    """One segment per item: the longest, the earliest among equals; adds order from 0 by position."""
    best = Window.partitionBy(key, "item").orderBy(F.desc("body_len"), "pos")
    one = segments.withColumn("rn", F.row_number().over(best)).where("rn = 1").drop("rn")
    return one.withColumn("order", (F.row_number().over(Window.partitionBy(key).orderBy("pos")) - 1).cast("int"))


def extract(texts: DataFrame, key: str, text_col: str = "text", strict: bool = False, strip_header: bool = False) -> DataFrame:
    """Sections: key, section_id, section_title, text, char_count, order.

    A body begins at its header; unless strip_header is set, the header's line stays in it
    except where the header opens the document.
    """
    chosen = longest(segment(scan_headers(texts, key, text_col, strict), texts, key, text_col), key)
    full = chosen.join(texts.select(key, F.col(text_col).alias("whole")), key)
    body = F.substring("whole", (F.col("pos") + 1).cast("int"), F.col("body_len").cast("int"))
    lead = F.regexp_replace(body, r"^\n", "") if strip_header else body
    cut = F.instr(lead, "\n")
    text = F.when(cut > 0, strip(F.substring(lead, cut, F.length(lead)))).otherwise(lead)
    title = F.when(F.length("title") > 4, F.col("title")).otherwise(F.col("default_title"))
    out = full.select(key, "section_id", title.alias("section_title"), text.alias("text"), "order")
    return out.withColumn("char_count", F.length("text")).select(key, "section_id", "section_title", "text", "char_count", "order")


def warnings(sections: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """key, warnings: the required sections that are missing, or that there are no headers at all."""
    found = sections.groupBy(key).agg(F.collect_set("section_id").alias("have"))
    want = F.array(*map(F.lit, sorted(REQUIRED)))
    gaps = F.transform(F.array_except(want, "have"), lambda s: F.concat(s, F.lit(" not detected")))
    return keys.select(key).join(found, key, "left").select(key, F.when(F.col("have").isNull(), F.array(F.lit("no item headers found"))).otherwise(gaps).alias("warnings"))


def roll_up(sections: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """One row per filing: sections in order, total_chars and extraction_warnings."""
    part = F.struct("order", "section_id", "section_title", "text", "char_count")
    grouped = sections.groupBy(key).agg(F.sort_array(F.collect_list(part)).alias("sections"), F.sum("char_count").alias("total_chars"))
    out = warnings(sections, keys, key).join(grouped, key, "left")
    return out.select(key, "sections", F.coalesce("total_chars", F.lit(0)).alias("total_chars"), F.col("warnings").alias("extraction_warnings"))
