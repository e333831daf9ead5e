import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, ids string, score string, row long"


@pytest.fixture(scope="session")
def odd_rows():
    """Null, empty, blank, very short, long and repeated texts; null and repeated ids; columns with clashing names."""
    long_text = " ".join(f"word{i % 977} {'abc' * (i % 5)}{i}" for i in range(12_000))
    texts = [None, "", " \n\t ", "one", "the cat sat on the mat", "the cat sat on the mat", "The CAT sat on\nthe mat", "x" * 5000, long_text, long_text + " tail", "Σας <|endoftext|> it's I'LL été.   中文 \U0001f600, \x1c ½."]
    rows = [(i, t, "en" if i % 2 else None, "s", 1, "own", "own", 7) for i, t in enumerate(texts)]
    return [*rows, rows[4], (None, "the cat sat on the mat", "de", None, None, None, None, None), (None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    return spark.createDataFrame(odd_rows, COLUMNS)


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"
