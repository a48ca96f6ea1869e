import pytest

SF = "/root/testdata/sf0.001"
LONG = "word " * 3000 + "\n" + "x" * 5000


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, repeated rows and ids, and columns whose names the operators use themselves."""
    rows = [
        (1, "a b c d e f", "en"), (2, None, None), (3, "", "en"), (4, "a b c d e f", None), (4, "a b c d e f", None), (None, "A B C D E F", "fr"), (5, " \n\t ", "en"),
        (6, LONG, "en"), (7, "one\ntwo\nthree\nfour", "x"), (8, "zero\none\ntwo\nthree", "x"), (9, "é ▁ 日本\x00 token=abcdefghijklmnop", "x"), (7, "other text", "x"),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long, fp long, slot int, n_tokens string, score double, ids string, t string, __text string, spans string"
    return spark.createDataFrame([(*r, "s", 1, 2, 3, "n", 0.5, "i", "t", "u", "v") for r in rows], schema)
