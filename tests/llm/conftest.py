import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, key int, id int, n double, a string, b string, task int, gone int"


def nasty_texts() -> list[tuple[int | None, str | None, str | None]]:
    """Nulls, empty and very long texts, ties, repeated rows and ids, copies and near copies."""
    rng = random.Random(5)
    words = ["the", "of", "alpha", "bête", "größe", "niño", "x1", "Stone", "river,", "cloud", "née", "under", "green.", "tower", "b2b"]

    def prose(n: int) -> str:
        return " ".join(rng.choice(words) for _ in range(n))

    base, shared = prose(120), prose(60)
    near = base.split()
    near[40] = "CHANGED"
    rows = [
        (None, None, None), (None, base, "en"), (1, None, "en"), (2, "", "en"), (3, "   \n\t ", None), (4, "a", "en"), (5, "a", "en"),
        (6, base, "en"), (7, base, "en"), (8, " ".join(near), None), (9, base, "en"), (9, base, "en"), (9, prose(50), "fr"),
        (10, prose(30) + " " + shared + " " + prose(30), "de"), (11, shared + "\n" + prose(80), "de"), (12, (shared + "  ") * 3, "es"),
        (13, prose(30_000), "en"), (14, "z" * 20_000, "fr"), (15, "\x00\x1f 12 … “quoted” 　 x", None), (16, "12 34 !!", "en"),
        (2**40, prose(200), "es"), (-5, shared, "fr"), (17, "no. " * 40, "en"), (18, "no. " * 41, "en"),
    ]
    return rows + [(20 + i, prose(rng.randint(1, 90)), rng.choice(["en", "de", "fr", None])) for i in range(25)]


@pytest.fixture(scope="session")
def rows():
    return nasty_texts()


@pytest.fixture(scope="session")
def docs(spark, rows):
    extra = ["r", 1, 2, 3.0, "x", "y", 7, 8]
    made = [(i, t, lang, "src0", len(t) if t is not None else None, *extra) for i, t, lang in rows]
    return spark.createDataFrame(made, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
