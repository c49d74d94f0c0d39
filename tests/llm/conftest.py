import pytest
from pyspark.sql import Row

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r.doc_id: r.text for r in documents.select("doc_id", "text").collect()}


ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "word"), (5, "a b c d"), (6, "É ÉÉ ñ"), (7, "same text here for all of us"), (7, "same text here for all of us"),
    (8, "same text here for all of us"), (None, "no id but some words in it"), (None, None), (9, "x" * 300_000), (10, "one two three four five six seven eight nine ten " * 8000),
    (11, "mail me at a.b@c.de, or +1 (555) 010-9999 now"), (12, "1.2.3.4 999.1.1.1 4111 1111 1111 1111 " + "7" * 5000), (13, "@@@ a@ @b.c a@b a@b.c@d.e"),
    (14, "MIT License and the Apache License, the GNU General Public License"), (15, "\x00 nul \x7f sep"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Null ids and texts, empty and very long texts, repeated rows, and columns with clashing names."""
    rows = [Row(doc_id=i, text=t, lang=None, source="s", n_chars=len(t) if t else None, kept="clash", score="clash", node=1, fp=2, rate=3, n_words="x",
                n_tokens=None, spans="x", words=["x"], labels="x", label=0) for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string, score string, node int, fp int, "
                                 "rate int, n_words string, n_tokens long, spans string, words array<string>, labels string, label int")


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def odd_labels(spark):
    rows = [(1, 1, 0), (2, 1, 0), (4, 0, 0), (5, 0, 1), (7, 1, 0), (7, 1, 0), (9, 0, 0), (10, 1, 1), (11, None, 0), (None, 1, 0)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
