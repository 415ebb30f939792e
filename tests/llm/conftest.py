import pytest

from tests.conftest import SF, spark  # noqa: F401

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def docs(spark):  # noqa: F811
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def texts(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


@pytest.fixture(scope="session")
def odd(spark):  # noqa: F811
    """Nulls in any column, empty and long texts, copies, repeated rows, columns whose names
    the operators use themselves."""
    long = "palabra la nación " * 4000 + "x" * 3000
    rows = [
        (1, "the cat sat on the mat and the dog ran", "en", "a", 38), (2, None, "en", "a", None), (3, "", None, None, 0),
        (4, "the  cat sat\ton the mat and the\n\ndog ran", "en", "b", 41), (5, long, "es", "b", len(long)), (6, long, "es", None, len(long)),
        (7, " \t\n ", "en", "c", 4), (8, "12345 !!", None, "c", 8), (9, "le chat est sur la table et il dort", "fr", "c", 35),
        (9, "le chat est sur la table et il dort", "fr", "c", 35), (None, "no id here but words", "en", "d", 20),
        (None, "no id here but words", "en", "d", 20), (12, "漢字かな混じり文です。" * 30, "ja", "d", 330), (13, "Ünïcode\u00a0spaß 😀 it's 10²", "de", "e", 22),
        (14, "<|endoftext|> is only text here", "en", "e", 31), (-3, "the cat sat on the mat and the dog ran", "en", "e", 38),
    ]
    names = ["row", "fp", "sha", "run", "key", "norm", "lead", "kept", "score", "held", "words", "shard", "fingerprint", "path", "rule"]
    extra = ", ".join(f"{c} string" for c in names)
    return spark.createDataFrame([(*r, *("?" for _ in names)) for r in rows], f"{SCHEMA}, {extra}")


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
