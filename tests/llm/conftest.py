import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, row string, h int, band int, spans string"


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def odd_rows():
    """Nulls, empty and long texts, exact and near copies, repeated passages; extra columns with clashing names."""
    rng = random.Random(5)
    base = words(rng, 120)
    passage = words(rng, 40)
    near = base.split()
    near[60] = "changed"
    rows = [
        (0, base, "en", "a"), (1, base, "en", "a"), (2, " ".join(near), "en", "b"), (3, None, "en", "a"), (4, "", None, None), (5, " \n\t ", "en", "b"),
        (6, words(rng, 30) + "\n" + passage + "\n" + words(rng, 30), "de", "b"), (7, passage + " " + words(rng, 70), None, "b"), (8, "one two", "de", None),
        (9, words(rng, 6000, 3000), "en", "a"), (10, "été ñandú Straße 12 ½ <|endoftext|> it's", "fr", "a"), (11, "x " * 300, "en", "a"), (12, "日本語 テキスト", "en", "a"),
        (13, passage + " " + passage, "en", "b"), (14, "HELLO World hello world again", "en", "b"),
    ]
    return [(*r, None if r[1] is None else len(r[1]), "k", "r", 1, 2, "s") for r in rows]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


@pytest.fixture(scope="session")
def repeated(spark):
    """The same with repeated rows and null ids."""
    rows = odd_rows()
    return spark.createDataFrame([*rows, rows[0], rows[6], (None, *rows[0][1:]), (None, None, *rows[0][2:]), (7, "another text of id seven", *rows[0][2:])], SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def folder(odd, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    odd.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{path}/documents.parquet")
    return str(path)
