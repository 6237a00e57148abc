"""Schemas of the engine's tables, as DDL."""

from __future__ import annotations

MANIFEST = "ticker string, company_name string, fiscal_year int, filing_date date, url string, file_path string, file_size_bytes long"
GROUND_TRUTH = "qid string, question string, question_type string, is_answerable string, expected_value string, relevant_section_ids string, relevant_tickers string, relevant_years string"
SECTION = "struct<section_id:string,section_title:string,text:string,char_count:int,`order`:int>"
FILING = f"ticker string, fiscal_year int, filing_date string, sections array<{SECTION}>, total_chars long, extraction_warnings array<string>"
CHUNK = "chunk_id string, ticker string, fiscal_year int, filing_date string, strategy string, section_id string, section_title string, text string, char_count int, chunk_index_in_filing int"
EMBEDDING = "chunk_id string, embedding array<float>"
RERANK_CACHE = "query_hash string, chunk_id string, model string, text_hash string, score double"
EVAL_ROW = (
    "qid string, collection string, config string, question_type string, is_answerable boolean, retrieval_ms double, top5_chunk_ids array<string>,"
    " recall5 boolean, recall10 boolean, answer string, generation_ms double, numerical_match boolean, is_refusal boolean, correct_refusal boolean, false_refusal boolean"
)
