import random

import pytest

WORDS = "the of and to in is river stone market letter winter garden question answer window table summer village morning paper".split()


@pytest.fixture(scope="session")
def odd_rows():
    """Rows that must not crash anything: nulls, empty, blank, long, repeated, tied, odd characters."""
    rng = random.Random(4)
    prose = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    same = prose(80)
    return [
        (1, None, "en"),
        (2, "", "en"),
        (3, " \t\n ", None),
        (None, prose(60), "en"),
        (None, None, None),
        (4, "x" * 20_000, "en"),
        (5, prose(30_000), "en"),
        (6, same, "en"),
        (6, same, "en"),
        (7, same, "fr"),
        (8, same.upper(), "en"),
        (9, "日本語 テキスト <|endoftext|> it's ½ é̂ 😀\x00", "xx"),
        (10, "one two three", "en"),
        (11, "one two three", "en"),
        (12, "\n".join(["same line again"] * 40), "en"),
        (13, "12345 67890 !!! ???", "en"),
    ]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    """The odd rows with further columns of names that operators use themselves."""
    rows = [(*r, "s", i, 1.0, "k", 7, "n") for i, r in enumerate(odd_rows)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, range string, h int, node string").repartition(3)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def tokenizer_path():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
