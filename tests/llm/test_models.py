"""Classifier, personal data, mixing, pipeline."""

import hashlib
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from fathom.llm import mixing, ordinal, pii, queries

SF = "/root/testdata/sf0.001"


def labelled(spark, n=400):
    pick = random.Random(4)
    good, poor, bad = "river stone light morning".split(), "buy!!! click### free$$$".split(), "vile hateful".split()
    rows = []
    for i in range(n):
        grade = i % 3
        words = [pick.choice(good) for _ in range(30)]
        if grade == 1:
            words[5:20] = [pick.choice(poor) for _ in range(15)]
        if grade == 0:
            words[3] = pick.choice(bad)
        rows.append((i, " ".join(words), grade))
    return spark.createDataFrame(rows, "doc_id long, text string, grade int")


def test_ordinal_held_out(spark):
    rows = labelled(spark)
    model = ordinal.train(rows, rows.where("doc_id < 300").select("doc_id", "grade"))
    assert list(model.thresholds) == sorted(model.thresholds)
    held = rows.where("doc_id >= 300").select("doc_id", "grade").join(ordinal.score(rows, model), "doc_id").collect()
    right = sum(r["keep"] == (r["grade"] == 2) for r in held)
    assert right >= 0.97 * len(held)
    means = [np.mean([r["expected_grade"] for r in held if r["grade"] == g]) for g in range(3)]
    assert means == sorted(means) and all(r["p_good"] <= r["p_not_toxic"] for r in held)


def test_ordinal_awkward_rows(docs, texts, empty, spark):
    model = ordinal.train(docs, spark.createDataFrame([(3, 2), (4, 1), (999, 0)], "doc_id long, grade int"))
    assert ordinal.score(docs, model).count() == len(texts) and ordinal.score(empty, model).count() == 0
    kept = ordinal.select(docs, model)
    assert kept.columns == docs.columns
    nothing = ordinal.train(docs, spark.createDataFrame([], "doc_id long, grade int"))
    assert ordinal.select(docs, nothing).count() == len(texts)
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 1), (2, 0, None), (3, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    assert {r["doc_id"]: r["grade"] for r in ordinal.graded(labels).collect()} == {1: 0, 2: 1}


def test_features_are_per_text():
    texts = ["A cat, a cat.", "", None, "dog"]
    first, feature, value = ordinal.features(pa.array(texts))
    for i, text in enumerate(texts):
        alone = ordinal.features(pa.array([text], pa.string()))
        assert feature[first[i] : first[i + 1]].tolist() == alone[1].tolist() and value[first[i] : first[i + 1]].tolist() == alone[2].tolist()


EMAIL, IP = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")


def plain_spans(text):
    out = [(0, *m.span()) for m in EMAIL.finditer(text)]
    out += [(1, *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m.group())
        if 13 <= len(digits) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0:
            out.append((2, *m.span()))
    return out + [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15]


def test_base_patterns():
    pick = random.Random(1)
    for alphabet, n in (("a@.-+01 9é(5", 20_000), ("0123456789 -", 8_000)):
        for _ in range(n):
            text = "".join(pick.choice(alphabet) for _ in range(pick.randrange(45)))
            assert pii.base_spans(text) == plain_spans(text), text


def test_bootstrap_finds_unseen_identifiers(spark):
    """Numbers with a wrong check digit stand where cards stand; elsewhere they stay out."""
    cards = [c for c in map(str, range(4111111111111111, 4111111111111211)) if pii.luhn(c)][:9]
    rows = [(i, f"order {i} paid with card {c} today") for i, c in enumerate(cards)]
    rows += [(10, "later paid with card 5111111111111111 again"), (11, "batch number 5111111111111112 shipped"), (12, None), (13, "")]
    found = {r["doc_id"]: r for r in pii.digest(pii.find(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert found[10]["spans"] == "card:21:37" and found[10]["n_card"] == 0 and found[11]["spans"] == "" and found[12]["spans"] == ""
    assert all(found[i]["n_card"] == 1 and found[i]["n_discovered"] == 0 for i in range(9))


def test_bootstrap_finds_unseen_spaced_identifiers(spark):
    """Phones without a country and spaced cards with a wrong check digit, where such seeds stand; elsewhere they stay out."""
    cards = [f"{c[:4]} {c[4:8]} {c[8:12]} {c[12:]}" for c in map(str, range(4111111111111111, 4111111111111211)) if pii.luhn(c)][:9]
    rows = [(i, f"order {i} paid with card {c} today") for i, c in enumerate(cards)]
    rows += [(20 + i, f"please phone me at +1 (376) 555-43{i}3 soon") for i in range(9)]
    unseen = {40: ("card", "later paid with card 4111 1111 1111 1112 again", "4111 1111 1111 1112"), 41: ("phone", "please phone me at (376) 555-4399, please", "(376) 555-4399")}
    rows += [(i, text) for i, (_, text, _) in unseen.items()] + [(50, "batch number 4111 1111 1111 1113 shipped"), (51, "in 1999. 12 men")]
    found = {r["doc_id"]: r for r in pii.digest(pii.find(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    for i, (kind, text, span) in unseen.items():
        assert found[i]["spans"] == f"{kind}:{text.index(span)}:{text.index(span) + len(span)}" and found[i]["n_discovered"] == 1
    assert found[50]["spans"] == found[51]["spans"] == "" and all(found[i]["n_discovered"] == 0 for i in (*range(9), *range(20, 29)))


def test_identifier_runs():
    cut = lambda text: [text[a:b] for a, b in pii.identifier_runs(text, pii.base_spans(text))]
    assert cut("tel (376) 555-4393, card (4111 1111 1111 1112) and 4111 1111 1111 1112 5th") == ["(376) 555-4393", "4111 1111 1111 1112", "4111 1111 1111 1112"]
    assert cut("4111 1111 1111 1112 2024 1.2.3.4 555 43 93 99") == ["4111 1111 1111 1112", "555 43 93 99"]
    assert cut("in 1999. 12 men, a12 3456, 555-4393 or 12 34") == []


def test_pii_digest_columns(spark):
    text = "é x.y@mail.example.com 1.2.3.4 300.1.1.1 +1 (376) 555-4393 and 4111 1111 1111 1111, a@b.cd 9.9.9.9"
    row = pii.digest(pii.find(spark.createDataFrame([(1, text)], "doc_id long, text string"))).first()
    spans = plain_spans(text)
    assert (row["n_email"], row["n_ip"], row["n_card"], row["n_phone"]) == tuple(sum(k == i for k, _, _ in spans) for i in range(4)) == (2, 2, 1, 1)
    joined = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))
    assert row["spans"] == joined and row["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()


def test_pii_awkward_rows(docs, texts, empty):
    assert pii.find(docs).count() == len(texts) and pii.find(empty).count() == 0


def test_mix_matches_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    want = con.sql(mixing.ORACLE_SQL).df()
    mine = queries.op6_poisson_mix(spark, SF).toPandas()
    key = ["doc_id", "mix_copy"]
    assert mine[want.columns].sort_values(key).values.tolist() == want.sort_values(key).values.tolist()


def test_mix_rates_and_order(spark):
    rows = spark.createDataFrame([(i, "a" if i % 10 else "b") for i in range(5000)], "doc_id long, source string")
    out = mixing.mix(rows, weights={"a": 1.0, "b": 3.0}, epochs=1.0)
    got = Counter(r["source"] for r in out.collect())
    assert abs(got["a"] - 1250) < 150 and abs(got["b"] - 3750) < 250
    keys = [r["mix_key"] for r in out.select("mix_key").collect()]
    assert keys == sorted(keys)
    assert {r["source"] for r in mixing.mix(rows, weights={"b": 1.0}).select("source").distinct().collect()} == {"b"}


@pytest.mark.parametrize("rate", [650.0, 720.0, 819.0, 3000.0])
def test_mix_large_rates(spark, rate):
    """Counts of a large mean have the mean and the variance of a Poisson variable."""
    rows = spark.createDataFrame([(i, "rare") for i in range(200)], "doc_id long, source string")
    out = mixing.mix(rows, epochs=rate)
    per = np.array([r["count"] for r in out.groupBy("doc_id").count().collect()])
    assert len(per) == 200 and abs(per.mean() - rate) < 5 * (rate / 200) ** 0.5 and 0.6 < per.var() / rate < 1.6
    assert out.groupBy("doc_id", "mix_copy").count().where("count > 1").isEmpty()


def test_mix_awkward_rows(docs, empty):
    out = mixing.mix(docs, epochs=3.0)
    assert out.columns == [*docs.columns, "mix_copy", "mix_key"] and out.count() > 0
    assert mixing.mix(empty).count() == 0


@pytest.mark.parametrize("case", ["docs", "empty"])
def test_pipeline_stages(spark, request, case):
    rows = request.getfixturevalue(case).select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, rows, SF)
        assert out.columns == rows.columns, name
    assert [n for n, _ in corpus_pipeline.STAGES][0].startswith("quality") and corpus_pipeline.STAGES[-1][1](spark, rows, SF).columns[0] == "doc_id"


def test_pipeline_runs(spark):
    rows = corpus_pipeline.run(spark, SF).toPandas()
    assert len(rows) and rows.groupby("sequence_id")["length"].sum().max() <= 2048


def test_pipeline_removes_repeated_rows(spark):
    """A row that occurs three times and null-id copies pass both dedup stages once."""
    texts = {i: " ".join(f"w{i}x{k}" for k in range(40)) for i in range(4)}
    rows = [(1, texts[1]), (1, texts[1]), (1, texts[1]), (2, texts[2]), (None, texts[0]), (None, texts[0]), (None, texts[3]), (5, None), (5, "")]
    docs = spark.createDataFrame([(i, t, "en", "web", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.near_duplicates(spark, corpus_pipeline.lines(spark, docs, SF), SF)
    assert out.columns == docs.columns
    assert Counter((r["doc_id"], r["text"] or "") for r in out.collect()) == Counter({(i, t or "") for i, t in rows})


def test_bootstrap_by_shape_and_what_follows(spark):
    """A number whose base match fails as it runs into another one has the shape of the seeds; long identifiers count too."""
    rows = [(i, f"w{i} x{i} +1 (376) 555-43{i:02d} y{i} z{i}") for i in range(20)]
    rows += [(20, "p q +1 (843) 555-7672 170.106.47.218 r s"), (21, "p q 1234567 r s")]
    rows += [(30 + i, f"a{i} b{i} u{i}@host.org is my address") for i in range(12)]
    long = "9" * 70 + "@x"
    rows += [(50, f"m n {long} is my address")]
    found = {r["doc_id"]: r for r in pii.digest(pii.find(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    text = rows[20][1]
    assert found[20]["n_phone"] == 0 and f"phone:{text.index('+')}:{text.index(' 170')}" in found[20]["spans"].split(",")
    assert found[50]["spans"] == f"email:4:{4 + len(long)}" and found[21]["spans"] == ""
    assert all(found[i]["n_discovered"] == 0 for i in range(20))
