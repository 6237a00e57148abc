import pytest
from pyspark.sql import functions as F

from fathom.functions import amounts, answers, entities, text
from fathom.operators import predicates


def one(spark, column, **values):
    names = list(values)
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} string" for n in names)).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("expected", "answer", "match"),
    [
        ("49552", "It reported $49,552 million [1].", True),
        ("49552", "It reported $49.6 billion [1].", True),
        ("211900", "Revenue was $211.9 billion [2].", True),
        ("1000000", "Assets were $1.0 trillion [3].", True),
        ("49552", "Revenue was $952 million [1].", False),
        ("10000", "Revenue was $10.3 billion [1].", False),
        ("10000", "Revenue was $10.2 billion [1].", True),
        ("", "Revenue was $49 billion [1].", False),
        ("N/A", "Revenue was $49 billion [1].", False),
        ("952", "It was $952 billion.", True),  # the bare-dollar reading counts too
    ],
)
def test_numeric_match(spark, expected, answer, match):
    assert one(spark, amounts.numeric_match(F.col("e"), F.col("a")), e=expected, a=answer) is match


def test_amounts_read_twice(spark):
    assert one(spark, amounts.amounts(F.col("a")), a="$952 billion") == [952000.0, 952.0, 952000.0]
    assert 49.0 in one(spark, amounts.amounts(F.col("a")), a="$49,552M")


@pytest.mark.parametrize(
    ("answer", "refusal", "violation"),
    [
        ("The provided filings do not contain this information.", True, False),
        ("Sales grew [1]. The provided filings do not contain this information.", False, True),
        ("Sales grew [N1]. The provided filings do not contain this information.", False, True),
        ("This is not available.", True, False),
        ("It cannot be said " + "x" * 131, True, False),
        ("It cannot be said " + "x" * 132, False, False),
        ("All is well.", False, False),
    ],
)
def test_refusals(spark, answer, refusal, violation):
    assert one(spark, answers.is_refusal(F.col("a")), a=answer) is refusal
    assert one(spark, answers.append_violation(F.col("a")), a=answer) is violation


def test_citations(spark):
    text_ = "[2] [1] [2] [0] [9] [N1] [99999999999999999]"
    assert one(spark, answers.citations(F.col("a"), F.lit(3)), a=text_) == [1, 2]
    assert one(spark, answers.hallucinated(F.col("a"), F.lit(3)), a=text_) == [0, 9, 99999999999999999]


def test_tokens_and_spaces(spark):
    assert one(spark, text.tokens("a"), a="It's  A Test, ok é!") == ["it", "s", "a", "test", "ok", "é"]
    assert one(spark, text.strip(F.col("a")), a="  x \n") == "x"
    assert one(spark, text.normalize_space(F.col("a")), a=" a \t b\r\n\r\n\r\nc ") == "a b\n\nc"
    assert one(spark, text.escape_html(F.col("a")), a="<a href='x'>&\"") == "&lt;a href=&#x27;x&#x27;&gt;&amp;&quot;"
    assert one(spark, text.excerpt(F.col("a"), 3), a="abcd") == "abc..."


@pytest.mark.parametrize(
    ("question", "tickers", "years"),
    [
        ("What did Apple earn in 2023?", ["AAPL"], [2023]),
        ("Goldman Sachs in 2022 and 2024", ["GS"], [2022, 2024]),
        ("Compare Facebook and Tesla", ["META", "TSLA"], []),
        ("metadata of FY2023 in 2019", ["META"], []),
        ("2024 or 2024?", [], [2024, 2024]),
    ],
)
def test_entities(spark, question, tickers, years):
    assert sorted(one(spark, entities.companies(F.col("q")), q=question)) == tickers
    assert one(spark, entities.years(F.col("q")), q=question) == years


def test_entities_on_word_boundaries(spark):
    assert one(spark, entities.companies(F.col("q"), word_boundary=True), q="metadata") == []


def test_where_builder():
    assert predicates.build([], []) is None
    assert predicates.build(["A"], []) == {"ticker": {"$eq": "A"}}
    assert predicates.build(["A", "B"], [2023]) == {"$and": [{"ticker": {"$in": ["A", "B"]}}, {"fiscal_year": {"$eq": 2023}}]}
    assert predicates.build(["A"], [2022, 2023]) == {"ticker": {"$eq": "A"}}


@pytest.mark.parametrize(
    ("where", "kept"),
    [
        (None, {1, 2, 3}),
        ({"t": "A"}, {1}),
        ({"t": {"$in": ["A", "B"]}}, {1, 2}),
        ({"t": {"$eq": None}}, {3}),
        ({"t": {"$gt": "A"}}, {1, 2, 3}),
        ({"missing": "A"}, set()),
        ({"$and": [{"t": "A"}, {"y": 1}], "y": 9}, {1}),
        ({"$or": [{"t": "A"}, {"y": 2}]}, {1, 2}),
        ({"t": "A", "y": 2}, set()),
        ({"t": {"$in": []}}, set()),
    ],
)
def test_where(spark, where, kept):
    rows = spark.createDataFrame([(1, "A", 1), (2, "B", 2), (3, None, None)], "id int, t string, y int")
    assert {r["id"] for r in predicates.apply(rows, where).collect()} == kept


def test_three_decimals_as_c_prints_them(spark):
    """Halves in decimal go by the stored value, halves in binary to even; Spark's own format rounds both up."""
    values = [37.3035, 50.0545, 1.0005, 2.0005, 0.0625, 0.1875, -0.0625, -3.3905, 0.0005, -0.0004, 0.0, 0.9995, 12.9996, 5.1234567, 1e-20, 1e15 + 0.5, *(n / 1000 + 0.0005 for n in range(0, 60_000, 37))]
    found = spark.createDataFrame(list(enumerate(values)), "i int, x double").select("i", text.fixed3(F.col("x")).alias("s"), F.format_string("%.3f", "x").alias("java")).orderBy("i").collect()
    assert [r["s"] for r in found] == [f"{v:.3f}" for v in values]
    assert sum(r["s"] != r["java"] for r in found) > 100
