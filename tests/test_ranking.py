"""BM25, vectors, fusion, rerank, retrieval, generation, evaluation."""

import math
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fathom.config import Settings
from fathom.operators import dense, embedding, evaluation, fusion, generation, lexical, predicates, report, rerank, retrieve, views
from fathom.plans import queries

DOCS = ["the cat sat", "the dog sat down", "the the the", "a bird", "", "cat and dog and cat"]


def docs(spark):
    return spark.createDataFrame(list(enumerate(DOCS)), "id long, text string")


def okapi(query):
    toks = [d.split() for d in DOCS]
    n, avg = len(toks), sum(map(len, toks)) / len(toks)
    vocabulary = {t for d in toks for t in d}
    df = {t: sum(t in d for d in toks) for t in vocabulary}
    raw = {t: math.log(n - df[t] + 0.5) - math.log(df[t] + 0.5) for t in vocabulary}
    mean = sum(raw.values()) / len(raw)
    idf = {t: v if v >= 0 else 0.25 * mean for t, v in raw.items()}
    return [sum(idf.get(t, 0) * d.count(t) * 2.5 / (d.count(t) + 1.5 * (0.25 + 0.75 * len(d) / avg)) for t in query.split()) for d in toks]


@pytest.mark.parametrize("query", ["cat", "the cat", "the the dog", "zebra", "", "bird down"])
def test_bm25(spark, query):
    asked = spark.createDataFrame([(1, query)], "qid long, query string")
    found = lexical.top_n(lexical.build(docs(spark), "id"), asked, 4).orderBy("rank").collect()
    want = sorted(enumerate(okapi(query)), key=lambda x: (-round(x[1], 6), x[0]))[:4]
    assert [(r["id"], r["score"]) for r in found] == [(i, pytest.approx(s, abs=1e-6)) for i, s in want]


def test_bm25_allowed_keeps_global_statistics(spark):
    asked = spark.createDataFrame([(1, "cat")], "qid long, query string")
    allowed = spark.createDataFrame([(1, 5), (1, 3)], "qid long, id long")
    found = lexical.top_n(lexical.build(docs(spark), "id"), asked, 4, allowed=allowed).orderBy("rank").collect()
    assert [(r["id"], round(r["score"], 5)) for r in found] == [(5, round(okapi("cat")[5], 5)), (3, 0.0)]


def test_dense_against_numpy(spark):
    random.seed(3)
    rows = [(i, [random.gauss(0, 1) for _ in range(8)]) for i in range(60)] + [(60, None), (61, [0.0] * 8)]
    vectors = spark.createDataFrame(rows, "id long, embedding array<float>").repartition(5)
    asked = vectors.where("id < 5").select(F.col("id").alias("qid"), F.col("embedding").alias("vector"))
    m = np.array([np.float32(v) for _, v in rows[:60]], dtype=float)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    for q, group in enumerate(range(5)):
        found = [r["id"] for r in dense.top_n(vectors, asked, 7, settings=Settings(broadcast_queries=2)).where(f"qid = {q}").orderBy("rank").collect()]
        assert found == sorted(range(60), key=lambda i: (-round(float(m[i] @ m[group]), 6), i))[:7]


def test_hashed_embedding(spark):
    found = {r["id"]: r["embedding"] for r in embedding.hashed(docs(spark), "id").collect()}
    assert len(found) == 6 and sum(found[4]) == 0 and abs(sum(v * v for v in found[0]) - 1) < 1e-9


def test_fusion_ties_and_missing(spark):
    a = spark.createDataFrame([(1, 7, 1), (1, 8, 2)], "qid long, id long, rank int")
    b = spark.createDataFrame([(1, 9, 1), (1, 8, 2)], "qid long, id long, rank int")
    found = fusion.top_k(fusion.fuse([a, b]), 2, 3).orderBy("rank").collect()
    assert [r["id"] for r in found] == [8, 7, 9]
    assert found[0]["score"] == pytest.approx(2 / 62) and found[1]["score"] == pytest.approx(1 / 61)
    swapped = {r["id"]: r["score"] for r in fusion.fuse([b, a]).collect()}
    assert swapped == pytest.approx({r["id"]: r["score"] for r in found})


def test_rerank_cache_and_guard(spark):
    pairs = spark.createDataFrame([(1, 1, 1, "cat dog", "cat"), (1, 2, 2, "cat dog", "dog cat"), (1, 3, 3, "cat dog", "bird")], "qid long, id long, rank int, query string, text string")
    empty = spark.createDataFrame([], "query_hash string, id long, model string, text_hash string, score double")
    scored, fresh = rerank.cached(pairs, empty, rerank.lexical_scores)
    assert {r["id"]: r["score"] for r in scored.collect()} == {1: 0.5, 2: 1.0, 3: 0.0} and fresh.count() == 3
    again, none = rerank.cached(pairs, fresh.withColumn("score", F.col("score") + 1), rerank.lexical_scores)
    assert {r["id"]: r["score"] for r in again.collect()} == {1: 1.5, 2: 2.0, 3: 1.0} and none.count() == 0
    changed = pairs.withColumn("text", F.concat("text", F.lit("!")))
    assert rerank.cached(changed, fresh, rerank.lexical_scores)[1].count() == 3
    assert [r["id"] for r in rerank.reorder(scored, 2).orderBy("rank").collect()] == [2, 1]
    flat = scored.withColumn("score", F.lit(1.0))
    assert rerank.degenerate(flat).count() == 1 and rerank.degenerate(flat.limit(1)).count() == 0
    model = rerank.model_scores(pairs, lambda q, t: [float(len(x)) for x in t])
    assert {r["id"]: r["score"] for r in model.collect()} == {1: 3.0, 2: 7.0, 3: 4.0}


def collection(spark):
    chunks = docs(spark).withColumn("ticker", F.when(F.col("id") % 2 == 0, "AAPL").otherwise("TSLA")).withColumn("fiscal_year", (2022 + F.col("id") % 3).cast("int")).withColumn("section_id", F.lit("item_1"))
    return retrieve.Collection(chunks, embedding.hashed(docs(spark), "id"), lexical.build(docs(spark), "id"))


def asked(spark):
    rows = spark.createDataFrame([(1, "Apple cat in 2022"), (2, "the dog"), (3, "Tesla bird")], "qid long, query string")
    vectors = embedding.hashed(rows.withColumnRenamed("query", "text"), "qid")
    return retrieve.with_entities(rows.join(vectors.select(F.col("id").alias("qid"), F.col("embedding").alias("vector")), "qid"))


@pytest.mark.parametrize("config", ["dense", "hybrid", "hybrid_filter", "hybrid_rerank", "hybrid_rerank_filter"])
def test_retrieve(spark, config):
    found = retrieve.retrieve(asked(spark), collection(spark), config, 3).collect()
    assert {r["qid"] for r in found} == {1, 2, 3}
    for q in (1, 2, 3):
        assert sorted(r["rank"] for r in found if r["qid"] == q) == list(range(1, 1 + sum(r["qid"] == q for r in found)))
    if config.endswith("filter"):
        assert all(r["ticker"] == "AAPL" and r["fiscal_year"] == 2022 for r in found if r["qid"] == 1)
        assert all(r["ticker"] == "TSLA" for r in found if r["qid"] == 3)


def test_retrieve_where_and_unknown(spark):
    found = retrieve.retrieve(asked(spark), collection(spark), "hybrid", 3, where={"ticker": "TSLA"}).collect()
    assert found and all(r["ticker"] == "TSLA" for r in found)
    with pytest.raises(ValueError, match="unknown config"):
        retrieve.retrieve(asked(spark), collection(spark), "magic")


def test_generation_and_views(spark):
    hits = retrieve.retrieve(asked(spark), collection(spark), "hybrid", 2)
    made = generation.resolve(generation.generate(generation.prompts(hits, asked(spark)))).collect()
    assert {r["qid"] for r in made} == {1, 2, 3}
    assert all(r["hallucinated_citations"] == [] and r["n_chunks"] == 2 for r in made)
    bare = generation.resolve(generation.generate(generation.prompts(hits.where("false"), asked(spark)))).first()
    assert bare["answer"].startswith("The provided") and bare["n_chunks"] == 0
    shown = views.sources(hits, hits.where("rank = 1").select("qid", "id")).collect()
    assert {r["is_cited"] for r in shown if r["rank"] == 1} == {True} and shown[0]["label"].startswith("[")


def test_point_lookup_keeps_order(spark):
    wanted = spark.createDataFrame([(1, [5, 0, 77])], "qid long, ids array<long>")
    found = retrieve.point_lookup(docs(spark), wanted).orderBy("place").collect()
    assert [(r["id"], r["text"]) for r in found] == [(5, DOCS[5]), (0, DOCS[0]), (77, None)]


def test_index_percentiles(spark):
    for values, p50, p95 in (([], None, None), ([3.0], 3.0, 3.0), ([1.0, 2.0, 3.0, 4.0], 3.0, 4.0), ([float(i) for i in range(20)], 10.0, 19.0)):
        rows = spark.createDataFrame([(v,) for v in values], "x double")
        assert tuple(rows.agg(evaluation.index_percentile(F.col("x"), 0.5), evaluation.index_percentile(F.col("x"), 0.95)).first()) == (p50, p95)


def test_truth_and_report(spark):
    rows = spark.createDataFrame([("q1", "?", "lookup", "True", "1", "item_1;item_7", "AAPL", "2022; 2023;x")], "qid string, question string, question_type string, is_answerable string, expected_value string, relevant_section_ids string, relevant_tickers string, relevant_years string")
    known = evaluation.truth(rows)
    assert known.first()["years"] == [2022, 2023]
    hits = spark.createDataFrame([("q1", 1, 1, "item_2", "AAPL", 2022), ("q1", 2, 7, "item_7", "AAPL", 2023)], "qid string, id long, rank int, section_id string, ticker string, fiscal_year int")
    found = evaluation.hit_at(hits, evaluation.relevant_by_metadata(hits, known)).first()
    assert (found["hit5"], found["hit10"]) == (False, True)
    assert evaluation.run_matrix(known).count() == 8 and evaluation.sample(known, 1).count() == 1
    assert "| hit5 |" in report.table(evaluation.hit_at(hits, evaluation.relevant_by_metadata(hits, known)).select("hit5"))


def test_truth_is_plain_containment(spark):
    """Passages with a newline after the second word, of one or two words, cut inside words, empty and null."""
    passages = ["one two\nthree four", "two", "two\nthree", "ne two\nthree fo", "e  f", "\nfour ", "", None, "absent words here"]
    texts = ["zero one two\nthree four five", "one two three four", "wone two\nthree four", "a e  f b", "\nfour two ", "", None, "two"]
    asked = spark.createDataFrame(list(enumerate(passages)), "qid long, query string")
    found = queries.truth(asked, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    want = {(q, d) for q, p in enumerate(passages) for d, t in enumerate(texts) if p is not None and t is not None and p in t}
    assert len(found) == len(want) and {(r["qid"], r["id"]) for r in found} == want


def test_label_rounds_the_score_as_sql_does(spark):
    hits = spark.createDataFrame([(1, 1, 7, 37.3035, "en", 2022, "web", "a")], "qid long, rank int, id long, score double, ticker string, fiscal_year int, section_id string, text string")
    assert views.sources(hits).first()["label"] == "[1] en FY2022 · web · score 37.303"


def scored_in_blocks(n_queries, n_rows, n):
    """What a task gives for whole-number vectors with many ties, one query and some rows without length, and its peak of memory."""
    rng = np.random.default_rng(5)
    rows, asked = rng.integers(-2, 3, (n_rows, 4)).astype(float), rng.integers(-2, 3, (n_queries, 4)).astype(float)
    asked[1], rows[::50] = 0, 0
    with np.errstate(invalid="ignore"):
        unit = [m / np.sqrt((m * m).sum(1, keepdims=True)) for m in (rows, asked)]
    batches = [pa.RecordBatch.from_arrays([pa.array(np.arange(at, min(at + 6000, n_rows))), pa.array(rows[at : at + 6000].tolist(), pa.list_(pa.float64()))], names=["id", "vector"]) for at in range(0, n_rows, 6000)]
    tracemalloc.start()
    found = list(dense._scorer(np.arange(n_queries) * 7, unit[1], n, False)(iter(batches)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return unit, pa.Table.from_batches(found).to_pylist(), peak


def test_dense_task_memory_is_bounded():
    _, found, peak = scored_in_blocks(6000, 6000, 3)
    assert len({r["qid"] for r in found}) > 5900 and peak < 250e6


def test_dense_task_keeps_the_best_of_each_query():
    (rows, asked), found, _ = scored_in_blocks(1100, 7000, 3)
    by_query = {}
    for r in found:
        by_query.setdefault(r["qid"] // 7, []).append((-r["score"], r["id"]))
    assert 1 not in by_query
    for q in (0, 2, 3, 1023, 1024, 1099):
        score = np.round(rows @ asked[q], 6)
        want = sorted((-s, i) for i, s in enumerate(score.tolist()) if s == s)[:3]
        assert [i for _, i in sorted(by_query.get(q, []))] == [i for _, i in want]


def test_dense_filtered_survives_a_vector_of_another_width(spark):
    rows = spark.createDataFrame([(0, [1.0, 0.0], 1), (1, [1.0, 0.0, 0.0], 1), (2, [0.0, 1.0], 1), (3, [1.0, 0.1], 2)], "id long, embedding array<float>, label int").coalesce(1)
    asked = spark.createDataFrame([(9, [1.0, 0.0])], "qid long, vector array<float>")
    found = dense.top_n(predicates.apply(rows, {"label": 1}), asked, 3).orderBy("rank").collect()
    assert [(r["id"], r["score"]) for r in found] == [(0, 1.0), (2, 0.0)]


@pytest.mark.parametrize("where", [None, {"section_id": "item_1"}])
def test_filtered_retrieval_forms_no_pairs(spark, monkeypatch, where):
    """Bounded questions are filtered inside the scoring tasks, with and without metadata in the index, and as by pairs."""
    some = collection(spark)
    kept = retrieve.Collection(some.chunks, some.vectors, lexical.build(some.chunks, "id", keep=("ticker", "fiscal_year")))
    many = Settings(broadcast_queries=1)
    by_pairs = sorted(map(str, retrieve.retrieve(asked(spark), some, "hybrid_filter", 3, many, where=where).collect()))

    def fail(*_):
        raise AssertionError("pairs of questions and documents")

    monkeypatch.setattr(retrieve, "allowed_pairs", fail)
    for c in (some, kept):
        assert sorted(map(str, retrieve.retrieve(asked(spark), c, "hybrid_filter", 3, where=where).collect())) == by_pairs


def test_allowed_is_the_clause_of_pairs(spark):
    questions = [(0, [], []), (1, ["A"], []), (2, ["A", "B"], [2022]), (3, [], [2023]), (4, ["C"], [2022, 2023]), (5, [], [2022, 2023]), (6, ["A"], [None]), (7, [], [None])]
    rows = [(0, "A", 2022), (1, "B", 2022), (2, "A", 2023), (3, None, 2023), (4, "A", None), (5, "Z", 2022)]
    of = spark.createDataFrame(questions, "qid long, tickers array<string>, years array<int>")
    pairs = {(r["qid"], r["id"]) for r in retrieve.allowed_pairs(of, spark.createDataFrame(rows, "id long, ticker string, fiscal_year int")).collect()}
    mask = predicates.Allowed([q[1] for q in questions], [q[2] for q in questions]).mask(pa.array([r[1] for r in rows]), pa.array([r[2] for r in rows], pa.int32()), slice(0, 99))
    free = {(q, i) for q in (0, 5) for i in range(6)}
    assert {(int(q), int(i)) for q, i in zip(*np.nonzero(mask), strict=True)} == pairs | free


def test_in_place_scoring_of_long_ids_is_bounded():
    """Few terms and many questions: the block of scores is bounded too, and ids of text are not copied for every score."""

    class Taken:
        def select(self, *_):
            return self

        where = select

        def mapInArrow(self, run, _):  # noqa: N802
            self.run = run
            return self

    rng = np.random.default_rng(7)
    terms, n_docs, n_queries = ["a", "b", "c"], 3000, 400
    counts = rng.integers(0, 3, (n_docs, 3))
    ids = [f"{'x' * 40}_{(i * 7919) % n_docs:05d}" for i in range(n_docs)]
    toks = [[t for t, c in zip(terms, row, strict=True) for _ in range(c)] for row in counts.tolist()]
    batch = pa.RecordBatch.from_arrays([pa.array(ids), pa.array(toks, pa.list_(pa.string())), pa.array([len(t) for t in toks], pa.int32())], names=["id", "toks", "dl"])
    weights = rng.integers(0, 3, (3, n_queries)).astype(float)
    taken = Taken()
    lexical._best_in_place(taken, (list(range(n_queries)), terms, weights), 3.0, 4, Settings(), "string")
    tracemalloc.start()
    found = pa.Table.from_batches(list(taken.run(iter([batch.slice(0, 1500), batch.slice(1500)])))).to_pylist()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    size = counts.sum(1, keepdims=True)
    score = np.round((counts * 2.5 / (counts + 1.5 * (0.25 + 0.75 * size / 3.0))) @ weights, 6)
    for q in (0, 1, 399):
        want = sorted(zip((-score[:, q]).tolist(), ids, strict=True))[:4]
        assert sorted((-round(r["score"], 6), r["id"]) for r in found if r["qid"] == q) == want
    assert peak < 60e6
