"""HTML, sections, chunking, sources, streaming."""

import json

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fathom.operators import chunking, html, sections
from fathom.plans import queries
from fathom.sources import filings, tables
from fathom.streaming import ingest


def test_tables_become_lines():
    page = "<p>Hi</p><table><tr><td>a</td><td> </td><td>b<br>c</td></tr><tr><th>d</th></tr></table><table></table><p>&amp; on</p>"
    assert html.page_text(page) == "Hi\n\na | b c\nd\n\n& on"


def test_nested_tables_and_dropped_elements():
    page = "<!DOCTYPE html><!-- c --><script>x</p></script><style>y</style><nav>n</nav><ix:header>gone <b>x</b></ix:header><ix:nonFraction name='q'>12</ix:nonFraction><table><tr><td>o<table><tr><td>i</td><td>j</td></tr></table></td></tr></table>"
    assert html.page_text(page) == "12\n\no i | j"


def test_bad_page_is_an_error_not_a_failure(spark, monkeypatch):
    rows = spark.createDataFrame([(1, "<p>x"), (2, None)], "id int, html string")
    assert [(r["id"], r["text"], r["error"]) for r in html.parse_pages(rows, keep=("id",)).orderBy("id").collect()] == [(1, "x", None), (2, None, None)]


FILING = "Contents\nItem 1. Business\nItem 7. MD&A\nItem 1. Business.\nWe make things.\nMany things.\nITEM 1C Other\nmore\nitem 7: Discussion of results...\nAll good.\nsee Item 7A"


def extracted(spark, text, **options):
    docs = spark.createDataFrame([("f", text)], "k string, text string")
    return {r["section_id"]: r for r in sections.extract(docs, "k", **options).collect()}, docs


def test_sections(spark):
    found, docs = extracted(spark, FILING)
    assert set(found) == {"item_1", "item_7"}
    assert found["item_1"]["text"] == "Item 1. Business.\nWe make things.\nMany things.\nITEM 1C Other\nmore"
    assert found["item_1"]["section_title"] == "Business" and found["item_1"]["order"] == 0
    assert found["item_7"]["section_title"] == "Discussion of results"
    warned = sections.warnings(sections.extract(docs, "k"), docs, "k").first()["warnings"]
    assert warned == ["item_1a not detected", "item_7a not detected", "item_8 not detected", "item_9a not detected"]


def test_header_at_start_is_stripped_and_key_swallows_a_letter(spark):
    assert extracted(spark, "Item 8. Statements\nbody")[0]["item_8"]["text"] == "body"
    assert set(extracted(spark, "Item 7 Mgmt\nx")[0]) == set()
    assert set(extracted(spark, "Item 7 Mgmt\nx", strict=True)[0]) == {"item_7"}
    assert extracted(spark, "x\nItem 1\nBusiness\ny")[0]["item_1b"]["section_title"] == "usiness"
    assert extracted(spark, "a\nItem 8. S\nb", strip_header=True)[0]["item_8"]["text"] == "b"


def test_no_headers(spark):
    _, docs = extracted(spark, "nothing")
    assert sections.roll_up(sections.extract(docs, "k"), docs, "k").first()["extraction_warnings"] == ["no item headers found"]


def test_splitter_goldens():
    assert chunking.split_text("x" * 2500) == ["x" * 1000, "x" * 1000, "x" * 800]
    assert chunking.split_text("a\n\nb", 1000) == ["a\n\nb"]
    words = " ".join(["word"] * 400)
    parts = chunking.split_text(words)
    assert all(len(p) <= 1000 for p in parts) and parts[0][-149:] in parts[1][:160]
    assert chunking.split_text("é😀" * 600, 1000, 0) == ["é😀" * 500, "é😀" * 100]
    paragraphs = "\n\n".join(c * 400 for c in "abcd")
    assert chunking.split_text(paragraphs) == ["a" * 400 + "\n\n" + "b" * 400, "c" * 400 + "\n\n" + "d" * 400]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab .\n", max_size=400), st.integers(5, 60), st.integers(0, 4))
def test_splitter_properties(text, size, overlap):
    for chunk in chunking.split_text(text, size, overlap):
        assert chunk and chunk == chunk.strip() and len(chunk) <= size and chunk in text


def filing(spark, texts):
    parts = [(f"item_{i}", f"T{i}", t, len(t), i) for i, t in enumerate(texts)]
    return spark.createDataFrame([("TEST", 2023, "2024-01-01", parts)], "ticker string, fiscal_year int, filing_date string, sections array<struct<section_id:string,section_title:string,text:string,char_count:int,`order`:int>>")


def test_chunkers(spark):
    rows = filing(spark, ["This is a sentence of section A. " * 80, "tiny", "UNIQUEMARK sentence in section B. " * 60])
    aware = chunking.section_aware(rows).orderBy("chunk_index_in_filing").collect()
    assert [r["chunk_index_in_filing"] for r in aware] == list(range(len(aware)))
    assert aware[0]["chunk_id"] == "TEST_2023_section_aware_0000" and all(r["char_count"] >= 100 for r in aware)
    assert all(("UNIQUEMARK" in r["text"]) == (r["section_id"] == "item_2") for r in aware)
    assert not any(r["section_id"] == "item_1" for r in aware)
    whole = chunking.recursive(rows).collect()
    assert {r["section_id"] for r in whole} == {"item_0", "item_2"} and len({r["chunk_id"] for r in whole}) == len(whole)
    assert chunking.recursive(filing(spark, ["short"])).count() == 0


def test_attribution_follows_a_cursor():
    same = "The same words again and again, over and over. " * 50
    found = chunking.attribute([same, same])
    assert {home for _, home, _ in found} == {0, 1}


def test_manifest_round_trip(spark, tmp_path):
    (tmp_path / "m.csv").write_text("ticker,company_name,fiscal_year,filing_date,url,file_path,file_size_bytes\nA,Aco,2022,2022-10-28,u,data\\raw\\A.html,12\nB,Bco,2022,,,,\n")
    rows = filings.read_manifest(spark, str(tmp_path / "m.csv")).collect()
    assert [(r["ticker"], r["file_path"], r["file_size_bytes"]) for r in rows] == [("A", "data/raw/A.html", 12)]


def test_pages_are_read_with_replacement(spark, tmp_path):
    (tmp_path / "a.html").write_bytes(b"<p>ok \xff</p>")
    assert filings.read_pages(spark, str(tmp_path)).first()["html"] == "<p>ok �</p>"


def test_collection_and_guards(spark, tmp_path):
    chunks = chunking.section_aware(filing(spark, ["Words and more words here. " * 30]))
    tables.build_collection(chunks, str(tmp_path / "c"))
    back = tables.read_collection(spark, str(tmp_path / "c"), "section_aware")
    assert back.count() == chunks.count()
    assert tables.lookup(back, "TEST_2023_section_aware_0000")["ticker"] == "TEST"
    try:
        tables.lookup(back, "none")
        raise AssertionError("no KeyError")
    except KeyError:
        pass
    vectors = back.select("chunk_id", F.array(F.lit(1.0)).alias("embedding")).union(spark.createDataFrame([("other", [1.0])], "chunk_id string, embedding array<double>"))
    assert [(r["chunk_id"], r["problem"]) for r in tables.vector_mismatch(back, vectors).collect()] == [("other", "no chunk")]
    cache = tables.read_rerank_cache(spark, str(tmp_path / "cache"))
    assert cache.count() == 0


def test_streaming_ingest_appends_each_filing_once(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    page = {"ticker": "T", "fiscal_year": 2023, "filing_date": "2024-01-01", "html": "<p>Item 1. Business</p><p>" + "We make many useful things. " * 60 + "</p>"}
    schema = "ticker string, fiscal_year int, filing_date string, html string"
    counts = []
    for i in range(2):
        (source / f"{i}.json").write_text(json.dumps(page))
        ingest.ingest(spark, str(source), schema, str(tmp_path / "out"), str(tmp_path / f"cp{i}")).awaitTermination()
        counts.append(spark.read.parquet(str(tmp_path / "out" / "section_aware")).count())
    assert counts[0] > 0 and counts[0] == counts[1]


def test_chunked_filings_hold_whole_documents(spark):
    sf = "/root/testdata/sf0.001"
    text = {r["doc_id"]: (r["text"] or "").replace("item", "thing").replace("Item", "Thing") for r in queries.documents(spark, sf).collect()}
    for r in queries.full_filing_texts(spark, sf).collect():
        _, rest = r["text"].split("Item 1. Business overview.\n", 1)
        assert rest.replace("\nITEM 1A - Risks\n", "", 1).replace("\nItem 7: Discussion of results\n", "", 1) == text[r["doc_id"]]
    ends = {(int(r["ticker"]), r["text"].rstrip()[-40:]) for r in queries.chunk_section_aware(spark, sf).collect()}
    long = [i for i, t in text.items() if i % 2 and len(t) > 3000]
    assert long and sum((i, text[i].rstrip()[-40:]) in ends for i in long) >= 0.9 * len(long)


class Taken:
    """Stands for a DataFrame and keeps the function of its Arrow stage."""

    def select(self, *_):
        return self

    def mapInArrow(self, run, _):  # noqa: N802
        self.run = run
        return self


def test_chunking_holds_a_part_of_a_batch():
    import tracemalloc

    import pyarrow as pa

    section = {"order": 0, "section_id": "item_1", "section_title": "Business"}
    filings = [{"ticker": str(i), "fiscal_year": 2024, "filing_date": "", "sections": [section | {"text": f"{i} " + "word and more. " * 200}]} for i in range(5000)]
    batch = pa.RecordBatch.from_pylist(filings)
    taken = Taken()
    chunking._run(taken, lambda parts: [(0, 0, parts[0]["text"][:1000]), (1, 0, parts[0]["text"][1000:])])
    tracemalloc.start()
    found = [(t, i) for out in taken.run(iter([batch])) for t, i in zip(out["ticker"].to_pylist(), out["chunk_index_in_filing"].to_pylist(), strict=True)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == [(str(i), k) for i in range(5000) for k in (0, 1)]
    assert peak < 10e6


def test_slices_keep_rows_and_order_in_small_parts():
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"text": ["x" * 10_000] * 500, "i": list(range(500))})
    parts = list(sections.slices(iter([batch, batch.slice(0, 0)])))
    assert [i for p in parts for i in p["i"].to_pylist()] == list(range(500)) and max(p.num_rows for p in parts) <= 110
