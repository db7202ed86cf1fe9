import pytest

#: Odd rows that every operator takes: nulls, blanks, ties, repeats, a long text, names that clash.
LONG = " ".join(f"w{i % 977} x{i}" for i in range(20_000))
ROWS = [
    (1, "one two three four five six seven eight nine ten"),
    (2, None),
    (3, ""),
    (4, " \n\t "),
    (5, "one two three four five six seven eight nine ten"),
    (5, "one two three four five six seven eight nine ten"),
    (None, "mail a.b+c@d-e.org, 10.0.0.255 or 4111 1111 1111 1111 and +1 (499) 555-6503!"),
    (7, LONG),
    (8, "ÉTÉ déjà-vu 😀 ß\r\nzwei  Zeilen \n"),
    (9, "a"),
]


@pytest.fixture(scope="session")
def odd(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    return df.selectExpr("doc_id", "text", "'x' AS score", "1 AS n_words", "'y' AS spans", "2 AS _id", "'z' AS h", "3 AS n_tokens")


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.filter("doc_id = -1")
