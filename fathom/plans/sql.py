"""SQL (DuckDB) equivalents of the registered queries, over the same tables."""

from __future__ import annotations

PUNCT = "!\"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~"
_SPACES = " " * 32


def _tokens(column: str) -> str:
    return f"list_filter(string_split_regex(translate(lower({column}), '{PUNCT}', '{_SPACES}'), '\\s+'), lambda x: x <> '')"


_ITEMS = "items AS (SELECT item_id AS qid, text AS query FROM benchmark)"


def _bm25(asked: str = "SELECT qid, query FROM items", docs: str = "SELECT doc_id AS id, text FROM documents") -> str:
    """CTEs docs, stats, idf, asked and scores(qid, id, score)."""
    return f"""
docs AS MATERIALIZED (SELECT id, {_tokens("text")} AS toks FROM ({docs})),
terms AS MATERIALIZED (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(toks)) AS term FROM docs) GROUP BY term),
size AS MATERIALIZED (SELECT count(*)::BIGINT AS n, avg(len(toks)) AS avgdl FROM docs),
stats AS MATERIALIZED (SELECT n, avgdl, (SELECT avg(ln(s.n - df + 0.5) - ln(df + 0.5)) FROM terms) AS avg_idf FROM size s),
idf AS MATERIALIZED (SELECT term, df, CASE WHEN ln(n - df + 0.5) - ln(df + 0.5) < 0 THEN 0.25 * avg_idf ELSE ln(n - df + 0.5) - ln(df + 0.5) END AS idf FROM terms, stats),
asked AS MATERIALIZED (SELECT qid, term, count(*) AS qtf FROM (SELECT qid, unnest({_tokens("query")}) AS term FROM ({asked})) GROUP BY qid, term),
postings AS MATERIALIZED (SELECT id, dl, term, count(*) AS tf FROM (SELECT id, len(toks) AS dl, unnest(toks) AS term FROM docs) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
scores AS MATERIALIZED (SELECT qid, id, sum(qtf * idf * (tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)))) AS score FROM asked JOIN idf USING (term) JOIN postings USING (term), stats GROUP BY qid, id)"""


def _ranked(source: str, n: int, name: str) -> str:
    return f"{name} AS MATERIALIZED (SELECT * FROM (SELECT qid, id, round(score, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 6) DESC, id)::INTEGER AS rank FROM ({source})) WHERE rank <= {n})"


def _filled(n: int, name: str = "bm", asked: str = "SELECT qid FROM items", allowed: str = "SELECT q.qid, d.id FROM ({asked}) q, docs d") -> str:
    """Ranking of all documents: those without a common word score 0."""
    return _ranked(f"SELECT a.qid, a.id, coalesce(s.score, 0.0) AS score FROM ({allowed.format(asked=asked)}) a LEFT JOIN scores s ON s.qid = a.qid AND s.id = a.id", n, name)


_BM5 = f"WITH {_ITEMS}, {_bm25()}, {_filled(5)}"
_COSINE = "list_cosine_similarity({a}::DOUBLE[], {b}::DOUBLE[])"


def _dense(n: int, where: str = "TRUE", asked: str = "SELECT vec_id AS qid, embedding AS vector FROM embeddings WHERE vec_id % 20 = 0", name: str = "dn") -> str:
    return _ranked(f"SELECT qid, vec_id AS id, {_COSINE.format(a='vector', b='embedding')} AS score FROM ({asked}), embeddings WHERE {where}", n, name)


_QUESTIONS = "questions AS (SELECT i.qid, i.query, e.embedding AS vector, ['en', 'fr', 'de', 'es'][(i.qid % 4)::INTEGER + 1] AS lang, CASE WHEN i.qid % 2 = 0 THEN 2022 + i.qid % 3 END AS year FROM items i JOIN embeddings e ON e.vec_id = i.qid)"
_META = "meta AS (SELECT doc_id AS id, lang AS ticker, (2022 + doc_id % 3)::INTEGER AS fiscal_year, source AS section_id, text FROM documents)"
_ALLOWED = "SELECT q.qid, m.id FROM questions q, meta m WHERE m.ticker = q.lang AND (q.year IS NULL OR m.fiscal_year = q.year)"
_TOP = "SELECT qid, vector FROM questions"


def _fuse() -> str:
    return """
fused AS MATERIALIZED (SELECT coalesce(d.qid, b.qid) AS qid, coalesce(d.id, b.id) AS id, coalesce(1.0::DOUBLE / (60 + d.rank), 0) + coalesce(1.0::DOUBLE / (60 + b.rank), 0) AS score, d.rank AS dense_rank, b.rank AS bm25_rank
  FROM dn d FULL OUTER JOIN bm b ON d.qid = b.qid AND d.id = b.id),
fused_rank AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 12) DESC, dense_rank ASC NULLS LAST, bm25_rank ASC NULLS LAST, id)::INTEGER AS rank FROM fused)"""


def _retrieve(config: str) -> str:
    filtered = config.endswith("_filter")
    if filtered:
        near = _ranked(f"SELECT q.qid, e.vec_id AS id, {_COSINE.format(a='q.vector', b='e.embedding')} AS score FROM questions q JOIN ({_ALLOWED}) a ON a.qid = q.qid JOIN embeddings e ON e.vec_id = a.id", 5 if config == "dense" else 20, "dn")
    else:
        near = _dense(5 if config == "dense" else 20, asked=_TOP)
    head = f"WITH {_ITEMS}, {_QUESTIONS}, {_META}, {_bm25('SELECT qid, query FROM questions')}, {near}"
    if config == "dense":
        found = "SELECT qid, id, score, rank FROM dn"
    else:
        head += f", {_filled(20, asked='SELECT qid FROM questions', **({'allowed': _ALLOWED} if filtered else {}))}, {_fuse()}"
        found = "SELECT qid, id, score, rank FROM fused_rank WHERE rank <= 5"
        if "rerank" in config:
            share = f"round(len(list_intersect(list_distinct({_tokens('q.query')}), {_tokens('m.text')}))::DOUBLE / greatest(len(list_distinct({_tokens('q.query')})), 1), 6)"
            head += f", pairs AS (SELECT f.qid, f.id, f.rank AS before, {share} AS score FROM fused_rank f JOIN questions q ON q.qid = f.qid JOIN meta m ON m.id = f.id WHERE f.rank <= 20)"
            found = "SELECT * FROM (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, before)::INTEGER AS rank FROM pairs) WHERE rank <= 5"
    return f"{head} SELECT f.qid, f.rank, f.id AS doc_id, round(f.score, 6) AS score, m.ticker, m.fiscal_year, m.section_id, '{config}' AS retrieval_method FROM ({found}) f JOIN meta m ON m.id = f.id"


_HASHED = """SELECT {key} AS id, list_transform(range(64), lambda i: coalesce(m[i::INTEGER], 0)::DOUBLE / norm) AS embedding FROM (
  SELECT {key}, map_from_entries(list((place, c))) AS m, sqrt(sum(c * c)) AS norm FROM (
    SELECT {key}, (('0x' || substr(md5(t), 31, 2))::INTEGER % 64) AS place, count(*) AS c FROM (SELECT {key}, unnest({tokens}) AS t FROM {table}) GROUP BY ALL) GROUP BY {key})"""
_REFUSAL = "contains(lower(answer), 'the provided filings do not contain this information')"
_ANSWERS = """answers AS (SELECT conv_id, turn, text || CASE turn % 4 WHEN 0 THEN ' The provided filings do not contain this information.' WHEN 1 THEN ' The provided filings do not contain this information. [2]'
  WHEN 2 THEN ' It is not available [N1] [12] [2] [0] [2].' ELSE '' END AS answer FROM conversations)"""
_IS_REFUSAL = f"CASE WHEN {_REFUSAL} THEN NOT regexp_matches(answer, '\\[\\w*\\d+\\]') ELSE length(answer) < 150 AND regexp_matches(lower(answer), '\\b(?:do not|cannot|not contain|not available|not disclose)\\b') END"
_VIOLATION = f"({_REFUSAL} AND regexp_matches(answer, '\\[\\w*\\d+\\]'))"
_NUMBERS = "list_sort(list_distinct(list_transform(regexp_extract_all(answer, '\\[(\\d+)\\]', 1), lambda x: x::HUGEINT)))"
_RESULTS = """runs AS (SELECT l.doc_id::VARCHAR AS qid, d.lang AS question_type, l.toxic = 0 AS is_answerable, l.quality, d.n_chars, c.collection, g.config, length(c.collection) + length(g.config) AS salt
  FROM labels l JOIN documents d ON d.doc_id = l.doc_id, (VALUES ('recursive'), ('section_aware')) c(collection), (VALUES ('dense'), ('hybrid'), ('hybrid_rerank'), ('hybrid_rerank_filter')) g(config)),
results AS (SELECT qid, question_type, is_answerable, collection, config, CASE WHEN is_answerable THEN (n_chars + salt) % 3 > 0 END AS recall5,
  CASE WHEN is_answerable THEN (n_chars + salt) % 3 > 0 OR quality = 1 END AS recall10, (n_chars + salt)::DOUBLE AS retrieval_ms FROM runs)"""
_AT = "list_sort(list({v}))[floor(count({v}) * {p})::INTEGER + 1]"
_FILINGS = """filings AS (SELECT o_custkey AS ticker, o_orderkey::VARCHAR AS accession, strftime(o_orderdate, '%Y-%m-%d') AS filing_date, strftime(o_orderdate, '%Y-%m-%d') AS report_date, 'd' || o_orderkey || '.htm' AS primary_doc FROM orders WHERE o_orderstatus = 'F'),
latest AS (SELECT ticker, fiscal_year, accession, report_date FROM (SELECT *, substr(report_date, 1, 4)::INTEGER AS fiscal_year, row_number() OVER (PARTITION BY ticker, substr(report_date, 1, 4) ORDER BY report_date DESC, accession DESC) AS rn FROM filings) WHERE rn = 1),
cells AS (SELECT c_custkey AS ticker, c_name AS company_name, y.y AS fiscal_year FROM customer, (VALUES (1995), (1996), (1997)) y(y))"""
_LOST = "lost AS (SELECT ticker, fiscal_year FROM cells WHERE NOT EXISTS (SELECT 1 FROM latest l WHERE l.ticker = cells.ticker AND l.fiscal_year = cells.fiscal_year))"


def _html() -> str:
    out = "regexp_replace(html, '<ix:header[^>]*>.*?</ix:header>', '', 'gis')"
    out = f"regexp_replace({out}, '</?[a-zA-Z][a-zA-Z0-9]*:[a-zA-Z][^>]*>', '', 'g')"
    out = f"regexp_replace({out}, '<!--.*?-->', '', 'gis')"
    for tag in ("script", "style", "nav", "footer", "noscript"):
        out = f"regexp_replace({out}, '<{tag}\\b[^>]*>.*?</{tag}\\s*>', '', 'gis')"
    out = f"regexp_replace(regexp_replace({out}, '<!doctype[^>]*>', '', 'gis'), '<[^>]*>', chr(10), 'gs')"
    for name, char in (("&middot;", "·"), ("&copy;", "©"), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " "), ("&#x27;", "''"), ("&amp;", "&")):
        out = f"replace({out}, '{name}', '{char}')"
    out = f"regexp_replace(regexp_replace({out}, '\\r\\n|\\r', chr(10), 'g'), '[ \\t]+', ' ', 'g')"
    return f"regexp_replace(regexp_replace({out}, '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g')"


_PARTS = """body AS (SELECT doc_id, replace(replace(text, 'item', 'thing'), 'Item', 'Thing') AS b FROM documents),
parts AS (SELECT doc_id, substr(b, 1, length(b) // 3) AS p0, substr(b, length(b) // 3 + 1, length(b) // 3) AS p1, substr(b, length(b) * 2 // 3 + 1, length(b) // 3) AS p2 FROM body)"""
_SECTIONS = f"""{_PARTS}, chosen AS (
SELECT doc_id, 'item_1' AS section_id, 'Business overview' AS section_title, 2 AS place, chr(10) || 'Item 1. Business overview.' || chr(10) || p0 AS raw FROM parts
UNION ALL SELECT doc_id, 'item_1a', 'Risks', 3, chr(10) || 'ITEM 1A - Risks' || chr(10) || p1 FROM parts WHERE length(p1) > 5
UNION ALL SELECT doc_id, 'item_1a', 'Risk Factors', 0, chr(10) || 'Item 1A. Risk Factors' FROM parts WHERE length(p1) <= 5
UNION ALL SELECT doc_id, 'item_7', 'Discussion of results', 4, chr(10) || 'Item 7: Discussion of results' || chr(10) || p2 FROM parts WHERE doc_id % 2 = 0
UNION ALL SELECT doc_id, 'item_7', 'Discussion', 1, chr(10) || 'Item 7. Discussion' FROM parts WHERE doc_id % 2 = 1),
sections AS (SELECT doc_id, section_id, section_title, place, regexp_replace(raw, '^\\s+|\\s+$', '', 'g') AS text FROM chosen)"""
_BLOCK = "'[' || b.rank || '] (' || m.ticker || ' FY' || m.fiscal_year || ', ' || m.section_id || '):' || chr(10) || regexp_replace(m.text, '^\\s+|\\s+$', '', 'g')"

ORACLES: dict[str, str] = {
    "tokenize_terms": f"SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_tokens('text')}) AS term FROM documents) GROUP BY doc_id, term",
    "corpus_stats": f"WITH {_ITEMS}, {_bm25()} SELECT n, round(avgdl, 6) AS avgdl, round(avg_idf, 6) AS avg_idf, (SELECT count(*) FROM terms) AS n_terms FROM stats",
    "term_idf": f"WITH {_ITEMS}, {_bm25()} SELECT term, df, round(idf, 6) AS idf FROM idf",
    "bm25_topk": f"{_BM5} SELECT qid, id AS doc_id, score, rank FROM bm",
    "bm25_zero_fill": f"WITH items AS (SELECT item_id AS qid, CASE item_id WHEN 0 THEN 'apache 2' WHEN 1 THEN 'zzzunknown' ELSE '' END AS query FROM benchmark WHERE item_id < 3), {_bm25()}, {_filled(20)} SELECT qid, id AS doc_id, score, rank FROM bm",
    "dense_topk": f"WITH {_dense(10)} SELECT qid, id AS vec_id, score, rank FROM dn",
    "dense_filtered_topk": f"WITH {_dense(10, 'label IN (1, 2, 3) OR label = 7')} SELECT qid, id AS vec_id, score, rank FROM dn",
    "dense_native_scores": f"SELECT a.vec_id, a.label, b.label AS next_label, round({_COSINE.format(a='a.embedding', b='b.embedding')}, 6) AS score FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1",
    "rrf_fuse": f"WITH {_ITEMS}, {_QUESTIONS}, {_bm25('SELECT qid, query FROM questions')}, {_filled(20, asked='SELECT qid FROM questions')}, {_dense(20, asked=_TOP)}, {_fuse()} SELECT qid, id AS doc_id, round(score, 6) AS score, dense_rank, bm25_rank FROM fused",
    "rerank_cache_miss": f"""WITH {_ITEMS}, {_bm25()}, {_filled(20)},
pairs AS (SELECT b.qid, b.id, b.rank AS before, CASE WHEN b.id % 3 = 0 THEN 2.0 ELSE round(len(list_intersect(list_distinct({_tokens("i.query")}), {_tokens("d.text")}))::DOUBLE / greatest(len(list_distinct({_tokens("i.query")})), 1), 6) END AS score FROM bm b JOIN items i ON i.qid = b.qid JOIN documents d ON d.doc_id = b.id)
SELECT * FROM (SELECT qid, id AS doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, before)::INTEGER AS rank FROM pairs) WHERE rank <= 5""",
    "hashed_embedding_topk": f"""WITH d AS MATERIALIZED ({_HASHED.format(key="doc_id", tokens=_tokens("text"), table="documents")}), q AS MATERIALIZED ({_HASHED.format(key="item_id", tokens=_tokens("text"), table="benchmark")}),
{_ranked(f"SELECT q.id AS qid, d.id AS id, {_COSINE.format(a='q.embedding', b='d.embedding')} AS score FROM q, d", 5, "top")} SELECT qid, id AS doc_id, score, rank FROM top""",
    "entity_parse": """SELECT o_orderkey, ['AAPL', 'GS', 'GOOGL,META', 'META', ''][(o_orderkey % 5)::INTEGER + 1] AS tickers, CASE WHEN 2021 + o_orderkey % 4 BETWEEN 2022 AND 2024 THEN (2021 + o_orderkey % 4)::VARCHAR ELSE '' END AS years FROM orders""",
    "where_eval": "SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority FROM orders WHERE (o_orderstatus = 'F' OR o_orderpriority IN ('1-URGENT', '2-HIGH')) AND o_custkey BETWEEN 0 AND 99",
    "section_scan": f"""WITH {_PARTS} SELECT doc_id, unnest(['1', '1a', '7', '1', '1a']) AS item, unnest(['Business', 'Risk Factors', 'Discussion', 'Business overview', 'Risks']) AS title, unnest([8, 25, 47, 66, 94 + length(p0)])::BIGINT AS pos FROM parts
UNION ALL SELECT doc_id, '7', 'Discussion of results', 111 + length(p0) + length(p1) FROM parts WHERE doc_id % 2 = 0""",
    "section_extract": f"""WITH {_SECTIONS} SELECT doc_id, section_id, section_title, md5(text) AS text_md5, length(text)::INTEGER AS char_count, (row_number() OVER (PARTITION BY doc_id ORDER BY place) - 1)::INTEGER AS "order" FROM sections""",
    "filing_rollup": f"WITH {_SECTIONS} SELECT doc_id::VARCHAR AS ticker, count(*)::INTEGER AS n_sections, sum(length(text))::BIGINT AS total_chars, 3 AS n_warnings FROM sections GROUP BY doc_id",
    "section_best": """SELECT user_id, item, pos, body_len, (row_number() OVER (PARTITION BY user_id ORDER BY pos) - 1)::INTEGER AS "order" FROM (
  SELECT user_id, event_type AS item, event_id AS pos, floor(value)::BIGINT AS body_len, row_number() OVER (PARTITION BY user_id, event_type ORDER BY floor(value) DESC, event_id) AS rn FROM events) WHERE rn = 1""",
    "section_warnings": "SELECT doc_id, 'item_7a not detected;item_8 not detected;item_9a not detected' AS warnings FROM documents",
    "html_to_text": f"SELECT page_id, {_html()} AS text FROM pages",
    "chunk_invariants": "SELECT 0::BIGINT AS too_long, 0::BIGINT AS too_short, 0::BIGINT AS outside, 0::BIGINT AS gaps",
    "refusal_flags": f"WITH {_ANSWERS} SELECT conv_id, turn, {_IS_REFUSAL} AS is_refusal, {_VIOLATION} AS append_violation FROM answers",
    "citations": f"WITH {_ANSWERS} SELECT conv_id, turn, array_to_string(list_filter({_NUMBERS}, lambda x: x BETWEEN 1 AND 5), ',') AS cited, array_to_string(list_filter({_NUMBERS}, lambda x: x NOT BETWEEN 1 AND 5), ',') AS hallucinated FROM answers",
    "context_prompt": f"""{_BM5}, {_META}, made AS (SELECT b.qid, 'Question: ' || any_value(i.query) || chr(10) || chr(10) || 'Excerpts:' || chr(10) || string_agg({_BLOCK}, chr(10) || chr(10) ORDER BY b.rank) || chr(10) || chr(10) || 'Answer:' AS message, count(*)::INTEGER AS n_chunks FROM bm b JOIN items i ON i.qid = b.qid JOIN meta m ON m.id = b.id GROUP BY b.qid)
SELECT qid, md5(message) AS message_md5, length(message)::INTEGER AS message_chars, n_chunks FROM made""",
    "hit_at_k": f"""WITH {_ITEMS}, {_bm25()}, {_filled(10)}, good AS (SELECT i.qid, d.doc_id AS id FROM items i JOIN documents d ON contains(d.text, i.query))
SELECT b.qid, bool_or(g.id IS NOT NULL AND b.rank <= 5) AS hit5, bool_or(g.id IS NOT NULL AND b.rank <= 10) AS hit10 FROM bm b LEFT JOIN good g ON g.qid = b.qid AND g.id = b.id GROUP BY b.qid""",
    "eval_matrix": f"WITH {_RESULTS} SELECT * FROM results",
    "eval_summary": f"""WITH {_RESULTS} SELECT collection, config, round(100.0 * count_if(recall5) / nullif(count(recall5), 0), 1) AS recall5_pct, round(100.0 * count_if(recall10) / nullif(count(recall10), 0), 1) AS recall10_pct, count(recall5) AS n_answerable,
{_AT.format(v="retrieval_ms", p=0.5)} AS p50_ms, {_AT.format(v="retrieval_ms", p=0.95)} AS p95_ms FROM results GROUP BY collection, config""",
    "eval_by_type": f"""WITH {_RESULTS} SELECT t.ordinal, t.question_type, coalesce(r.hits, 0)::BIGINT AS hits, coalesce(r.total, 0)::BIGINT AS total FROM (VALUES (0, 'de'), (1, 'en'), (2, 'es'), (3, 'fr'), (4, 'it')) t(ordinal, question_type)
LEFT JOIN (SELECT question_type, count_if(recall5) AS hits, count(*) AS total FROM results WHERE is_answerable AND collection = 'section_aware' AND config = 'hybrid_rerank_filter' GROUP BY 1) r ON r.question_type = t.question_type""",
    "eval_slice": f"WITH {_RESULTS} SELECT collection, count_if(recall5)::BIGINT AS hits, count(*) AS total FROM results WHERE config = 'hybrid_rerank_filter' AND question_type = 'de' AND is_answerable GROUP BY collection",
    "eval_rescore": f"""WITH {_ANSWERS}, s AS (SELECT conv_id % 5 > 0 AS is_answerable, answer, turn * 10.0::DOUBLE AS ms, {_IS_REFUSAL} AS refused FROM answers)
SELECT 0::BIGINT AS numeric_hits, count_if(is_answerable)::BIGINT AS numeric_total, count_if(NOT is_answerable AND refused)::BIGINT AS refusals, count_if(NOT is_answerable)::BIGINT AS refusal_total, count_if(is_answerable AND refused)::BIGINT AS false_refusals, count_if(is_answerable)::BIGINT AS answerable_total,
count_if({_VIOLATION})::BIGINT AS append_violations, {_AT.format(v="ms", p=0.5)} AS p50_ms, {_AT.format(v="ms", p=0.95)} AS p95_ms FROM s""",
    "amounts_match": """SELECT o_orderkey, o_orderkey % 4 < 2 AS matched, CASE o_orderkey % 4 WHEN 3 THEN 0 WHEN 2 THEN 1 ELSE n END AS n_amounts FROM (SELECT o_orderkey, 2 + 1 AS n FROM orders)""",
    "latency_percentiles": f"SELECT event_type, count(*) AS n, {_AT.format(v='value', p=0.5)} AS p50, {_AT.format(v='value', p=0.95)} AS p95 FROM events GROUP BY event_type",
    "filing_index": f"WITH {_FILINGS} SELECT *, 'https://www.sec.gov/Archives/edgar/data/' || ticker || '/00' || accession || '/' || primary_doc AS url FROM filings",
    "latest_per_year": f"WITH {_FILINGS} SELECT * FROM latest",
    "manifest_grid": f"WITH {_FILINGS} SELECT c.ticker, c.company_name, c.fiscal_year, l.accession, l.report_date FROM cells c LEFT JOIN latest l ON l.ticker = c.ticker AND l.fiscal_year = c.fiscal_year",
    "manifest_missing": f"WITH {_FILINGS}, {_LOST} SELECT * FROM lost",
    "page_overlap": f"""WITH {_FILINGS}, {_LOST}, page AS (SELECT o_custkey AS ticker, o_orderstatus AS name, strftime(min(o_orderdate), '%Y-%m-%d') AS "filingFrom", strftime(max(o_orderdate), '%Y-%m-%d') AS "filingTo" FROM orders GROUP BY 1, 2)
SELECT * FROM page WHERE EXISTS (SELECT 1 FROM lost WHERE lost.ticker = page.ticker AND "filingTo" >= fiscal_year || '-01-01' AND "filingFrom" <= (fiscal_year + 1) || '-06-30')""",
    "point_lookup": f"{_BM5} SELECT b.qid, 5 - b.rank AS place, b.id AS doc_id, d.lang, d.n_chars FROM bm b JOIN documents d ON d.doc_id = b.id WHERE b.rank >= 3",
    "excerpt_view": f"""{_BM5}, {_META} SELECT b.qid, b.rank, b.id AS doc_id, '[' || b.rank || '] ' || m.ticker || ' FY' || m.fiscal_year || ' · ' || m.section_id || ' · score ' || printf('%.3f', b.score) AS label,
replace(replace(replace(replace(replace(CASE WHEN length(m.text) > 800 THEN substr(m.text, 1, 800) || '...' ELSE m.text END, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') AS excerpt, b.id % 2 = 0 AS is_cited FROM bm b JOIN meta m ON m.id = b.id""",
} | {f"retrieve_{c}": _retrieve(c) for c in ("dense", "hybrid", "hybrid_filter", "hybrid_rerank", "hybrid_rerank_filter")}
