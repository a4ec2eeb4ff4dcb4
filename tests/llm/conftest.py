import os

import pytest

#: Odd rows every operator must take: nulls, empty and blank texts, repeats, ties, odd characters, one long text.
ODD = [
    (1, None, "en", "a", 0),
    (2, "", "en", "a", 0),
    (3, "  \n\t ", None, "a", 5),
    (4, "one two three four five six seven eight nine ten", "en", "a", 48),
    (4, "one two three four five six seven eight nine ten", "en", "a", 48),
    (5, "ONE two three\nfour five six seven eight nine ten", "en", "b", 48),
    (6, "onetwothreefourfivesixseveneightnineten", "en", "b", 39),
    (7, "Größe naïve İstanbul ﬁ é   x\u0085y \x1c don't I'VE we'Ll 12 ½ 漢字 🙂🙂", "de", None, None),
    (8, "a", "fr", "b", 1),
    (9, "<|endoftext|> a <|startoftext|>b", "en", "b", 10),
    (10, "!!! ??? 123", "en", "b", 11),
    (None, "no id here but some words for the text", "en", "c", 3),
    (11, "word " * 30000, "es", "c", 150000),
    (12, "x" * 5000 + " " + "ab" * 3000, "es", "c", 11001),
    (13, "trailing spaces   and  double\n\n lines \r\n end ", "en", "c", 40),
]
KIND = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ODD, KIND).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], KIND)


@pytest.fixture(scope="session")
def sf_dir():
    return os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def texts(sf_dir):
    import pyarrow.parquet as pq

    t = pq.read_table(f"{sf_dir}/documents.parquet", columns=["doc_id", "text"])
    return dict(zip(t.column(0).to_pylist(), t.column(1).to_pylist(), strict=True))
