"""Mixing sources to target weights by Poisson replication.

A source with n documents and target weight w (weights sum to 1) gets the mean repetition
rate  w * epochs * N / n.  Each document's count inverts the Poisson distribution of that
mean at a uniform number hashed from seed and document; a mean above LIMIT is the sum of
equal parts with a number each.  The document is exploded by its count, and all copies are
shuffled globally in the order of another hash.

All in DataFrame functions: counts come from a per-source array of cumulative
probabilities, so no row is looked at more than once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Terms of a distribution, as a multiple of its mean plus a constant; the rest is below 1e-15.
TERMS_A, TERMS_B = 3, 40
#: Largest mean inverted at once: exp(-mean) and the terms after it are normal doubles.
LIMIT = 700.0
#: Most sources whose rates are broadcast; with more, both sides are dealt by source and a salt.
BROADCAST_SOURCES = 10_000
SALTS = 64


def uniform(*parts: Column) -> Column:
    """52 bits of an md5 of the parts, as a number in [0, 1)."""
    text = F.concat_ws(":", *(F.coalesce(p.cast("string"), F.lit("null")) for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def source_rates(df: DataFrame, source_col: str = "source", weights: dict[str | None, float] | None = None, epochs: float = 1.0) -> DataFrame:
    """source, n, rate.  Without weights a source's weight is the square root of its documents' number.

    Sources that `weights` leaves out get no copies; a null source is a source of its own.
    """
    sizes = df.groupBy(F.col(source_col).cast("string").alias("source")).agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        weighed = sizes.withColumn("w", F.sqrt("n"))
    else:
        given = df.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], "source string, w double")
        weighed = sizes.join(F.broadcast(given).withColumnRenamed("source", "given"), F.col("source").eqNullSafe(F.col("given")), "left").select("source", "n", F.coalesce("w", F.lit(0.0)).alias("w"))
    total = weighed.agg(F.sum("n").alias("n"), F.sum("w").alias("w")).first()
    return weighed.select("source", "n", (F.col("w") / F.lit(total["w"] or 1.0) * F.lit(epochs) * F.lit(total["n"] or 0) / F.col("n")).alias("rate"))


def cumulative(rate: Column) -> Column:
    """P(X <= 0), P(X <= 1), .. of a Poisson variable of a mean up to LIMIT, as an array."""
    start = F.struct(F.exp(-rate).alias("p"), F.array(F.exp(-rate)).alias("c"))
    terms = F.sequence(F.lit(1), (F.ceil(rate) * TERMS_A + TERMS_B).cast("int"))
    return F.aggregate(terms, start, lambda acc, k: F.struct((acc["p"] * rate / k).alias("p"), F.concat(acc["c"], F.array(F.element_at(acc["c"], -1) + acc["p"] * rate / k)).alias("c")), lambda acc: acc["c"])


def mix(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", weights: dict[str | None, float] | None = None, epochs: float = 1.0, seed: int = 17, partitions: int | None = None) -> DataFrame:
    """All columns of df, then mix_copy (from 0) and mix_key, sorted by mix_key over all partitions.

    A mean above LIMIT is split into equal parts, whose counts add up to a Poisson count of
    the whole mean.  Rows with equal id, repeated or null, draw the same numbers: a repeated
    row is repeated alike.  An empty table gives no rows.
    """
    parts = F.greatest(F.lit(1), F.ceil(F.col("rate") / LIMIT).cast("int"))
    rates = source_rates(df, source_col, weights, epochs).withColumn("parts", parts).select("source", "parts", cumulative(F.col("rate") / F.col("parts")).alias("cumulative"))
    names = df.columns
    rows = df.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"), F.col(source_col).cast("string").alias("of"), uniform(F.lit(seed), F.col(id_col)).alias("u"))
    if rates.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        drawn = rows.join(F.broadcast(rates), F.col("of").eqNullSafe(F.col("source")))
    else:
        salted = rates.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        drawn = rows.withColumn("by", F.pmod(F.hash("u"), F.lit(SALTS))).join(salted, F.col("of").eqNullSafe(F.col("source")) & (F.col("by") == F.col("salt")))
    count = lambda u: F.size(F.filter("cumulative", lambda c: c <= u))
    others = F.transform(F.sequence(F.lit(1), F.col("parts") - 1), lambda k: uniform(F.lit(seed), F.col(f"row.{id_col}"), k))
    times = count(F.col("u")) + F.when(F.col("parts") > 1, F.aggregate(others, F.lit(0), lambda n, u: n + count(u))).otherwise(0)
    copies = drawn.withColumn("times", times).where("times > 0").select("row", F.posexplode(F.array_repeat(F.lit(True), F.col("times"))).alias("mix_copy", "one"))
    keyed = copies.withColumn("mix_key", F.substring(F.md5(F.concat_ws(":", F.lit(f"order:{seed}"), F.coalesce(F.col(f"row.{id_col}").cast("string"), F.lit("null")), F.col("mix_copy").cast("string"))), 1, 16))
    out = keyed.select(*(F.col(f"row.`{c}`").alias(c) for c in names), "mix_copy", "mix_key")
    return out.repartitionByRange(partitions, "mix_key").sortWithinPartitions("mix_key") if partitions else out.orderBy("mix_key")


ORACLE_SQL = """
WITH RECURSIVE sizes AS (SELECT source, count(*) AS n, sqrt(count(*)) AS w FROM documents GROUP BY source),
rates AS (SELECT source, w / sum(w) OVER () * 1.0::DOUBLE * sum(n) OVER () / n AS rate FROM sizes),
terms(source, rate, k, p, c) AS (
  SELECT source, rate, 0, exp(-rate), exp(-rate) FROM rates
  UNION ALL
  SELECT source, rate, k + 1, p * rate / (k + 1), c + p * rate / (k + 1) FROM terms WHERE k + 1 <= ceil(rate) * 3 + 40),
drawn AS (SELECT d.*, ('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS u FROM documents d),
counted AS (SELECT d.doc_id, d.source, d.lang, d.n_chars, d.text, count(*) AS times FROM drawn d JOIN terms t ON d.source IS NOT DISTINCT FROM t.source AND t.c <= d.u GROUP BY ALL),
copies AS (SELECT *, unnest(range(times)) AS mix_copy FROM counted)
SELECT doc_id, source, lang, n_chars, text, mix_copy::INTEGER AS mix_copy, substr(md5('order:17:' || coalesce(doc_id::VARCHAR, 'null') || ':' || mix_copy::VARCHAR), 1, 16) AS mix_key FROM copies
"""
