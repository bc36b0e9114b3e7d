import pytest

#: Texts that are awkward for every operator.
ODD = [
    None, "", " ", "\n\n", "a", "ÀÉ ñandú  two  spaces\tand tab \n new", "it's we'll  I'd  wide space 123 456x", "…!!  ?? %%%", "日本語 テキスト と 漢字",
    "x" * 3000, "word " * 2000, " lead and trail ", "same text here for two", "same text here for two", "emoji 😀 family 👨‍👩‍👧 end", "a\x00b \x1c c\x85d", "<|endoftext|> is text", "tab\t word\r\n next \v x \f y",
]


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Odd texts, null ids and languages, a repeated row, and extra columns with names that operators use inside."""
    rows = [(i, t, ["en", "fr", None][i % 3], ["src0", None][i % 2], None if t is None else len(t), "x", 1) for i, t in enumerate(ODD)]
    rows += [rows[5], (None, "no id at all", None, None, None, None, None), (-7, "negative id", "en", "s", 11, "y", 2)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _id string, shard int")


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
