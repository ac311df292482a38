import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, w string, score double, kept string, fp int, `a.b` int, `x``y` string, found string, hit boolean, row int, carried int, later bigint, key string, n int, component_id string"

EN = "the quick brown fox and the lazy dog were in the old house near the river when rain began to fall on them"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, blanks, repeated rows, ties, a very long text and extra columns with clashing names."""
    long = " ".join(f"word{k % 977} thing{k % 31}." + "\n" * (k % 13 == 0) for k in range(60_000))
    rows = [
        (1, EN, "en"), (2, EN, "en"), (2, EN, "en"), (3, None, "en"), (4, "", None), (None, EN + " again", "en"), (5, " \t\n", "de"),
        (6, "one", "en"), (7, long, "en"), (8, "x" * 5000, None), (9, "İstanbul 你好 🙂 <|endoftext|> é ﬁ", "xx"), (10, "mail a.b@c.example.com +1 (743) 555-3824", "en"),
    ]
    return spark.createDataFrame([(i, t, lang, "s", len(t or ""), "w", 0.5, "k", 3, 4, "y", "f", True, 5, 6, 7, "q", 8, "c") for i, t, lang in rows], SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
