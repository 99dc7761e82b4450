import pytest



@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, repeated rows, ties, and columns whose names operators use inside."""
    words = "the quick brown fox jumps over the lazy dog while seven wizards quietly box".split()
    passage = " ".join(words[i % 14] + str(i // 14) for i in range(60))
    long_text = " ".join(f"{words[i % 14]}{i % 97}" for i in range(30_000))
    rows = [
        (1, "Hello big world out there.", "en", "a", 26),
        (2, "Hello big world out there.", "en", "a", 26),
        (2, "Hello big world out there.", "en", "a", 26),
        (3, None, "en", None, None),
        (4, "", None, "b", 0),
        (5, long_text, "en", "a", len(long_text)),
        (6, long_text + " tail", "en", None, 1),
        (7, "x", None, None, None),
        (8, f"alpha beta {passage} gamma\ndelta", "de", "b", 1),
        (9, f"other start {passage} different end", "de", "b", 1),
        (10, " \t\n ", "fr", "b", 4),
        (11, "1234 5678 !!", "fr", "c", 12),
        (12, "Äpfel ÖL ßtraße " * 9, "de", "c", 1),
        (13, "HELLO big world out there.", "en", "c", 26),
    ]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("_text", "fp", "n", "rank", "length", "shard", "_slot", "recipe", "chunk", "digest", "block", "start", "hash"):
        frame = frame.selectExpr("*", f"'clash' AS `{name}`")
    return frame


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)


@pytest.fixture(scope="session")
def docs001(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
