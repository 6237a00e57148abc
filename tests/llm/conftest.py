import random

import pytest

PHRASES = "the cat sat on a mat while rain fell over green hills and old men told long tales of the sea to young boys who did not listen at all".split()


def prose(seed: int, words: int = 60) -> str:
    pick = random.Random(seed)
    return " ".join(pick.choice(PHRASES) + (str(pick.randrange(30)) if pick.random() < 0.3 else "") for _ in range(words))


@pytest.fixture(scope="session")
def texts() -> list[tuple[int | None, str | None]]:
    """Rows with nulls, empty and long texts, copies, near copies, repeats and a repeated row."""
    base = prose(1, 80)
    near = base.split()
    near[40] = "changed"
    shared = prose(2, 45)
    rows = [(i, prose(100 + i)) for i in range(3, 12)]
    rows += [(1, base), (2, " ".join(near)), (20, base), (21, base), (30, f"{prose(7, 10)} {shared} {prose(8, 12)}"), (31, f"{shared}\n{prose(9, 30)}"), (32, f"x {shared}")]
    rows += [(40, None), (41, ""), (42, "   \n\t "), (43, "two words"), (44, "Two WORDS"), (45, "é" * 500 + " 😀 " + "é" * 500), (50, prose(3, 20_000)), (60, "ab " * 900), (None, "no id here but words enough to count"), (70, base + "\n" + prose(71, 20) + "\n" + shared)]
    return rows + [(5, prose(105)), (43, "another text under the same id")]


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The rows with extra columns whose names clash with the operators' own."""
    rows = [(i, t, "en", None if (i or 0) % 4 == 0 else f"src{(i or 0) % 3}", len(t or ""), 1, "z", None) for i, t in texts]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, node int, key string, tie long").repartition(3)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.where("false")
