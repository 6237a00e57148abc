"""Registered queries: each operator over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Settings
from ..functions import amounts, answers, entities, text
from ..operators import chunking, dense, embedding, evaluation, fusion, generation, html, lexical, predicates, rerank, retrieve, sections, views
from ..sources import filings

TYPES = ("de", "en", "es", "fr", "it")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))


def index(spark: SparkSession, sf_dir: str) -> lexical.Index:
    return lexical.build(documents(spark, sf_dir), "doc_id")


def tokenize_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", F.explode(text.tokens("text")).alias("term")).groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"))


def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = index(spark, sf_dir)
    return spark.createDataFrame([(found.n, round(found.avgdl, 6), round(found.avg_idf, 6), found.n_terms)], "n long, avgdl double, avg_idf double, n_terms long")


def term_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.term_idf(index(spark, sf_dir)).select("term", "df", F.round("idf", 6).alias("idf"))


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.top_n(index(spark, sf_dir), items(spark, sf_dir), 5).select("qid", F.col("id").alias("doc_id"), "score", "rank")


def bm25_zero_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries of one license word, one unknown word and nothing: lists fill up to 20."""
    asked = items(spark, sf_dir).where("qid < 3").select("qid", F.when(F.col("qid") == 0, "apache 2").when(F.col("qid") == 1, "zzzunknown").otherwise("").alias("query"))
    return lexical.top_n(index(spark, sf_dir), asked, 20).select("qid", F.col("id").alias("doc_id"), "score", "rank")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row whose id is divisible by 20 asks for its neighbours."""
    return vectors(spark, sf_dir).where("id % 20 = 0").select(F.col("id").alias("qid"), F.col("embedding").alias("vector"))


def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dense.top_n(vectors(spark, sf_dir), vector_queries(spark, sf_dir), 10).select("qid", F.col("id").alias("vec_id"), "score", "rank")


def dense_filtered_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    where = {"$or": [{"label": {"$in": [1, 2, 3]}}, {"label": 7}]}
    return dense.top_n(predicates.apply(vectors(spark, sf_dir), where), vector_queries(spark, sf_dir), 10).select("qid", F.col("id").alias("vec_id"), "score", "rank")


def dense_native_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The native form of the score, between vectors of one label that follow each other by id."""
    v = vectors(spark, sf_dir)
    w = v.select((F.col("id") - 1).alias("id"), F.col("embedding").alias("next"), F.col("label").alias("next_label"))
    return v.join(w, "id").select(F.col("id").alias("vec_id"), "label", "next_label", F.round(dense.cosine(F.col("embedding"), F.col("next")), 6).alias("score"))


def collection(spark: SparkSession, sf_dir: str) -> retrieve.Collection:
    docs = documents(spark, sf_dir).select(F.col("doc_id").alias("id"), F.col("lang").alias("ticker"), (2022 + F.col("doc_id") % 3).cast("int").alias("fiscal_year"), F.col("source").alias("section_id"), "text")
    return retrieve.Collection(docs, vectors(spark, sf_dir).select("id", "embedding"), lexical.build(docs, "id", keep=("ticker", "fiscal_year")))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items with the vector of the same number, a language each, and every other one a year."""
    langs = F.array(*map(F.lit, ("en", "fr", "de", "es")))
    asked = items(spark, sf_dir).join(vectors(spark, sf_dir).select(F.col("id").alias("qid"), F.col("embedding").alias("vector")), "qid")
    year = F.array((2022 + F.col("qid") % 3).cast("int"))
    return asked.withColumn("tickers", F.array(F.get(langs, (F.col("qid") % 4).cast("int")))).withColumn("years", F.when(F.col("qid") % 2 == 0, year).otherwise(F.array().cast("array<int>")))


def _hits(config: str, top_k: int = 5):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = retrieve.retrieve(questions(spark, sf_dir), collection(spark, sf_dir), config, top_k)
        return found.select("qid", "rank", F.col("id").alias("doc_id"), F.round("score", 6).alias("score"), "ticker", "fiscal_year", "section_id", "retrieval_method")

    run.__name__ = f"retrieve_{config}"
    run.__doc__ = f"Top {top_k} of every question under the {config} configuration."
    return run


def rrf_fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = questions(spark, sf_dir)
    near = dense.top_n(vectors(spark, sf_dir), asked, 20)
    found = fusion.fuse([near, lexical.top_n(index(spark, sf_dir), asked, 20)])
    return found.select("qid", F.col("id").alias("doc_id"), F.round("score", 6).alias("score"), F.get("ranks", F.lit(0)).alias("dense_rank"), F.get("ranks", F.lit(1)).alias("bm25_rank"))


def rerank_cache_miss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the BM25 candidates a third is in the cache (with score 2): the merged order, top 5."""
    docs = documents(spark, sf_dir).select(F.col("doc_id").alias("id"), "text")
    asked = items(spark, sf_dir)
    pairs = lexical.top_n(index(spark, sf_dir), asked, 20).drop("score").join(asked, "qid").join(docs, "id")
    cache = pairs.where("id % 3 = 0").select(text.query_hash(F.col("query")).alias("query_hash"), "id", F.lit("lexical").alias("model"), F.md5("text").alias("text_hash"), F.lit(2.0).alias("score"))
    merged, _ = rerank.cached(pairs, cache, rerank.lexical_scores)
    return rerank.reorder(merged, 5).select("qid", F.col("id").alias("doc_id"), "score", "rank")


def hashed_embedding_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = embedding.hashed(documents(spark, sf_dir), "doc_id")
    asked = embedding.hashed(items(spark, sf_dir).withColumnRenamed("query", "text"), "qid").select(F.col("id").alias("qid"), F.col("embedding").alias("vector"))
    return dense.top_n(docs, asked, 5).select("qid", F.col("id").alias("doc_id"), "score", "rank")


def entity_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions rendered from orders: companies and years found in them."""
    names = F.array(*map(F.lit, ("Apple", "goldman sachs", "Meta and Google", "metadata", "nobody")))
    asked = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("What did "), F.get(names, (F.col("o_orderkey") % 5).cast("int")), F.lit(" report for "), (2021 + F.col("o_orderkey") % 4).cast("string"), F.lit(" and FY2023?")).alias("q"))
    return asked.select("o_orderkey", F.array_join(entities.companies(F.col("q")), ",").alias("tickers"), F.array_join(entities.years(F.col("q")).cast("array<string>"), ",").alias("years"))


def where_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    where = {"$and": [{"$or": [{"o_orderstatus": {"$eq": "F"}}, {"o_orderpriority": {"$in": ["1-URGENT", "2-HIGH"]}}]}, {"o_custkey": {"$in": list(range(0, 100))}}]}
    return predicates.apply(table(spark, sf_dir, "orders"), where).select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")


def _filing(first: Column, second: Column, third: Column) -> Column:
    """A table of contents, then one section per item; odd documents have no third."""
    toc = F.lit("Contents\nItem 1. Business\nItem 1A. Risk Factors\nItem 7. Discussion\n")
    last = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("\nItem 7: Discussion of results\n"), third)).otherwise(F.lit(""))
    return F.concat(toc, F.lit("Item 1. Business overview.\n"), first, F.lit("\nITEM 1A - Risks\n"), second, last)


def _body() -> Column:
    return F.replace(F.replace("text", F.lit("item"), F.lit("thing")), F.lit("Item"), F.lit("Thing"))


def filing_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filings written from documents as the SQL of the section queries fixes them: thirds rounded down, of odd documents two."""
    body, size = _body(), F.length(_body())
    part = lambda i: F.substring(body, (F.floor(size * i / 3) + 1).cast("int"), F.floor(size / 3).cast("int"))
    return documents(spark, sf_dir).select("doc_id", _filing(part(0), part(1), part(2)).alias("text"))


def full_filing_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filings that hold the whole document: the second section of odd documents runs to the end."""
    body, size = _body(), F.length(_body())
    at = lambda i: F.floor(size * i / 3).cast("int")
    part = lambda i, end: F.substring(body, at(i) + 1, end - at(i))
    return documents(spark, sf_dir).select("doc_id", _filing(part(0, at(1)), part(1, F.when(F.col("doc_id") % 2 == 0, at(2)).otherwise(size)), part(2, size)).alias("text"))


def section_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections.scan_headers(filing_texts(spark, sf_dir), "doc_id")


def section_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sections.extract(filing_texts(spark, sf_dir), "doc_id")
    return found.select("doc_id", "section_id", "section_title", F.md5("text").alias("text_md5"), "char_count", "order")


def section_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arg-max and order from given positions: events as headers, their type as item, value as length."""
    headers = table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("item"), F.col("event_id").alias("pos"), F.floor("value").cast("long").alias("body_len"))
    return sections.longest(headers, "user_id")


def section_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = filing_texts(spark, sf_dir)
    found = sections.warnings(sections.extract(docs, "doc_id"), docs, "doc_id")
    return found.select("doc_id", F.array_join("warnings", ";").alias("warnings"))


def html_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", html.flat_text(F.col("html")).alias("text"))


def html_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.parse_pages(table(spark, sf_dir, "pages"), keep=("page_id",))


def filing_rows(docs: DataFrame) -> DataFrame:
    """Filings (nested sections) from their texts."""
    rolled = sections.roll_up(sections.extract(docs, "doc_id"), docs, "doc_id")
    return rolled.select(F.col("doc_id").cast("string").alias("ticker"), F.lit(2024).alias("fiscal_year"), F.lit("2024-01-31").alias("filing_date"), "sections", "total_chars", "extraction_warnings")


def filing_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filing_rows(filing_texts(spark, sf_dir)).select("ticker", F.size("sections").alias("n_sections"), "total_chars", F.size("extraction_warnings").alias("n_warnings"))


def chunk_recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.recursive(filing_rows(full_filing_texts(spark, sf_dir)))


def chunk_section_aware(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.section_aware(filing_rows(full_filing_texts(spark, sf_dir)))


def _exploded(rows: DataFrame) -> DataFrame:
    return rows.select("ticker", "fiscal_year", F.explode("sections").alias("s")).select("ticker", "fiscal_year", "s.*")


def chunk_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row of zeros: chunks too long, too short, out of their section, or in a gap of indexes."""
    rows = filing_rows(full_filing_texts(spark, sf_dir))
    chunks = chunking.section_aware(rows)
    outside = chunking.containment_violations(chunks, _exploded(rows), ["ticker", "fiscal_year"]).agg(F.count(F.lit(1)))
    gaps = chunks.groupBy("ticker").agg((F.max("chunk_index_in_filing") + 1 - F.count(F.lit(1))).alias("gap")).agg(F.coalesce(F.sum("gap"), F.lit(0)))
    n = lambda c: F.count(F.when(c, 1))
    return chunks.agg(n(F.col("char_count") > 1000).alias("too_long"), n(F.col("char_count") < 100).alias("too_short")).withColumns({"outside": outside.scalar(), "gaps": gaps.scalar().cast("long")})


def chunk_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = filing_rows(full_filing_texts(spark, sf_dir))
    return chunking.counts(chunking.recursive(rows).unionByName(chunking.section_aware(rows)))


def amounts_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences with the order's price in four notations, against the price."""
    price = F.col("o_totalprice")
    sentence = (
        F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit("Revenue was $"), F.format_string("%.2f", price), F.lit(" million [1].")))
        .when(F.col("o_orderkey") % 4 == 1, F.concat(F.lit("Revenue was $"), F.format_string("%.4f", price / 1000), F.lit(" billion [1].")))
        .when(F.col("o_orderkey") % 4 == 2, F.concat(F.lit("It fell to "), F.format_string("%.2f", price * 1.03), F.lit(" million.")))
        .otherwise(F.lit("No figure is given."))
    )
    found = table(spark, sf_dir, "orders").select("o_orderkey", F.format_string("%.2f", price).alias("expected"), sentence.alias("sentence"))
    return found.select("o_orderkey", amounts.numeric_match(F.col("expected"), F.col("sentence")).alias("matched"), F.size(amounts.amounts(F.col("sentence"))).alias("n_amounts"))


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    suffix = F.when(F.col("turn") % 4 == 0, " The provided filings do not contain this information.").when(F.col("turn") % 4 == 1, " The provided filings do not contain this information. [2]").when(F.col("turn") % 4 == 2, " It is not available [N1] [12] [2] [0] [2].").otherwise("")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat("text", suffix).alias("answer"))


def refusal_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.col("answer")
    return _answers(spark, sf_dir).select("conv_id", "turn", answers.is_refusal(a).alias("is_refusal"), answers.append_violation(a).alias("append_violation"))


def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, n = F.col("answer"), F.lit(5)
    joined = lambda c: F.array_join(c.cast("array<string>"), ",")
    return _answers(spark, sf_dir).select("conv_id", "turn", joined(answers.citations(a, n)).alias("cited"), joined(answers.hallucinated(a, n)).alias("hallucinated"))


def context_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bm25_topk(spark, sf_dir).join(collection(spark, sf_dir).chunks.withColumnRenamed("id", "doc_id"), "doc_id").withColumnRenamed("doc_id", "id")
    made = generation.prompts(found, items(spark, sf_dir))
    return made.select("qid", F.md5("message").alias("message_md5"), F.length("message").alias("message_chars"), "n_chunks")


def generated_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bm25_topk(spark, sf_dir).join(collection(spark, sf_dir).chunks.withColumnRenamed("id", "doc_id"), "doc_id").withColumnRenamed("doc_id", "id")
    made = generation.resolve(generation.generate(generation.prompts(found, items(spark, sf_dir))))
    return made.select("qid", "answer", F.size("citations").alias("n_citations"), F.size("hallucinated_citations").alias("n_hallucinated"))


def truth(asked: DataFrame, docs: DataFrame) -> DataFrame:
    """(qid, id): the documents (doc_id, text) that contain a passage (qid, query).

    Both are cut at spaces and newlines.  A word between two cuts of the passage is a whole
    word of each document that holds the passage; the longest of them keys the equi join.
    Passages without such a word are compared with every document.
    """
    cut = lambda c: F.split(c, r"[ \n]")
    inner = F.filter(cut(F.col("query")), lambda w, i: (i > 0) & (i < F.size(cut(F.col("query"))) - 1) & (w != ""))
    keyed = asked.select("qid", "query", F.get(F.array_sort(inner, lambda a, b: F.length(b) - F.length(a)), F.lit(0)).alias("word"))
    whole = F.contains("text", F.col("query"))
    words = docs.select("doc_id", "text", F.explode(F.array_distinct(cut(F.col("text")))).alias("word"))
    found = words.join(F.broadcast(keyed.where("word is not null")), "word").where(whole)
    other = docs.select("doc_id", "text").join(F.broadcast(keyed.where("word is null")), whole)
    return found.select("qid", F.col("doc_id").alias("id")).unionByName(other.select("qid", F.col("doc_id").alias("id"))).distinct()


def _truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truth(items(spark, sf_dir), documents(spark, sf_dir))


def hit_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lexical.top_n(index(spark, sf_dir), items(spark, sf_dir), 10)
    return evaluation.hit_at(found, _truth(spark, sf_dir))


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A result table over all 8 runs of each question, from labelled documents."""
    rows = table(spark, sf_dir, "labels").join(documents(spark, sf_dir), "doc_id").select(F.col("doc_id").cast("string").alias("qid"), F.col("lang").alias("question_type"), (F.col("toxic") == 0).alias("is_answerable"), F.col("quality"), F.col("n_chars"))
    runs = evaluation.run_matrix(rows)
    salt = F.length("config") + F.length("collection")
    recall = F.when(F.col("is_answerable"), ((F.col("n_chars") + salt) % 3 > 0))
    return runs.select("qid", "question_type", "is_answerable", "collection", "config", recall.alias("recall5"), F.when(F.col("is_answerable"), recall | (F.col("quality") == 1)).alias("recall10"), (F.col("n_chars") + salt).cast("double").alias("retrieval_ms"))


def eval_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _results(spark, sf_dir)


def eval_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.summary(_results(spark, sf_dir))


def eval_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    types = spark.createDataFrame(list(enumerate(TYPES)), "ordinal int, question_type string")
    return evaluation.by_type(_results(spark, sf_dir).where("collection = 'section_aware' and config = 'hybrid_rerank_filter'"), types)


def eval_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.slice_by_collection(_results(spark, sf_dir).where("config = 'hybrid_rerank_filter'"), "de")


def eval_rescore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored answers scored anew, in one row of counts."""
    rows = _answers(spark, sf_dir).select((F.col("conv_id") % 5 > 0).alias("is_answerable"), F.lit("12").alias("expected_value"), "answer", (F.col("turn") * 10.0).alias("generation_ms"))
    return evaluation.generation_summary(evaluation.rescore(rows))


def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), evaluation.index_percentile(F.col("value"), 0.5).alias("p50"), evaluation.index_percentile(F.col("value"), 0.95).alias("p95"))


def _filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as filings of customers: forms by status."""
    form = F.when(F.col("o_orderstatus") == "F", "10-K").when(F.col("o_orderstatus") == "O", "10-K/A").otherwise("10-Q")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("ticker"), form.alias("form"), F.col("o_orderkey").cast("string").alias("accessionNumber"), day.alias("filingDate"), day.alias("reportDate"), F.concat(F.lit("d"), F.col("o_orderkey"), F.lit(".htm")).alias("primaryDocument"))
    return rows.groupBy("ticker").agg(*(F.collect_list(c).alias(c) for c in ("form", "accessionNumber", "filingDate", "reportDate", "primaryDocument")))


def filing_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = filings.explode_index(_filings(spark, sf_dir), ("ticker",))
    return rows.withColumn("url", filings.url(F.format_string("%010d", F.col("ticker")), F.concat(F.lit("00-"), F.col("accession")), F.col("primary_doc")))


def latest_per_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filings.latest_per_year(filings.explode_index(_filings(spark, sf_dir), ("ticker",))).select("ticker", "fiscal_year", "accession", "report_date")


def _companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("ticker"), F.col("c_name").alias("company_name"))


YEARS = [1995, 1996, 1997]


def manifest_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filings.grid(_companies(spark, sf_dir), YEARS, latest_per_year(spark, sf_dir))


def manifest_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filings.missing(_companies(spark, sf_dir), YEARS, latest_per_year(spark, sf_dir))


def page_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index pages (a customer's orders by status) that may hold a missing year's filing."""
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    pages = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("ticker"), F.col("o_orderstatus").alias("name")).agg(F.min(day).alias("filingFrom"), F.max(day).alias("filingTo"))
    lost = manifest_missing(spark, sf_dir).select("ticker", F.col("fiscal_year").alias("year"))
    return filings.relevant_pages(pages, lost)


def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last three hits of each item, looked up again in reverse order of rank."""
    wanted = bm25_topk(spark, sf_dir).where("rank >= 3").groupBy("qid").agg(F.reverse(F.sort_array(F.collect_list(F.struct("rank", "doc_id")))).alias("h")).select("qid", F.transform("h", lambda x: x["doc_id"]).alias("ids"))
    chunks = documents(spark, sf_dir).select(F.col("doc_id").alias("id"), "lang", "n_chars")
    return retrieve.point_lookup(chunks, wanted).select("qid", "place", F.col("id").alias("doc_id"), "lang", "n_chars")


def excerpt_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bm25_topk(spark, sf_dir).join(collection(spark, sf_dir).chunks.withColumnRenamed("id", "doc_id"), "doc_id").withColumnRenamed("doc_id", "id")
    shown = views.sources(found, found.where("id % 2 = 0").select("qid", "id"))
    return shown.select("qid", "rank", F.col("id").alias("doc_id"), "label", "excerpt", "is_cited")


def chunk_pipeline_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """End to end: filings, sections, chunks, index, BM25 top 5 over chunks."""
    chunks = chunking.section_aware(filing_rows(full_filing_texts(spark, sf_dir)), Settings())
    return lexical.top_n(lexical.build(chunks, "chunk_id"), items(spark, sf_dir), 5).select("qid", F.col("id").alias("chunk_id"), "score", "rank")


RETRIEVALS = {f"retrieve_{c}": _hits(c) for c in ("dense", "hybrid", "hybrid_filter", "hybrid_rerank", "hybrid_rerank_filter")}
