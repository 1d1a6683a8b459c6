import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def long_text():
    return " ".join(f"wort{i % 977}" for i in range(60_000))


def odd_rows():
    """Null ids and texts, empty and very long texts, ties, repeated rows, special strings, odd white space, marks beyond Latin-1."""
    passage = " ".join(f"passage{i}" for i in range(60))
    line = "A line that several of these documents have in common"
    rows = [
        (1, None, None, None, None), (2, "", "de", "a", 0), (3, " \t\n\x0b\r\n ", "de", "a", 6), (None, passage, "en", "b", None), (4, f"before {passage} after", "en", "b", 1),
        (5, f"x {passage}\nlast", "en", "b", 2), (5, f"x {passage}\nlast", "en", "b", 2), (6, f"{line}\n  {line.upper()}\t\nown words", "en", "c", 3), (7, f"{line}\nother", "en", "c", 3),
        (8, f"other\n{line}", "en", "c", 3), (9, "short\nshort\nshort", "en", "c", 3), (10, "<|endoftext|>in<|endoftext|> text 12345 don't we'll", "en", "c", 3),
        (11, "Ünïcödé ТЕКСТ 漢字 é    wide", "de", "c", 3), (12, long_text(), "de", "d", 4), (13, long_text(), "de", "d", 4), (14, "12 34 !!", None, "d", 4),
        (15, "one two three", "en", "d", 4), (16, "one two three", "en", "d", 4), (17, "Zeile\n\n\nZeile", "de", "d", 4), (18, "İstanbul ẞ K", "tr", "d", 4), (2**40 + 1, "far id", "en", "d", 4),
    ]
    return rows


@pytest.fixture(scope="session")
def odd(spark):
    """The odd rows with extra columns of clashing names."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(odd_rows(), DOCS)
    return df.select("*", F.lit(1).alias("did"), F.lit("k").alias("k1"), F.lit("x").alias("piece"), F.lit(0).alias("start"), F.lit(2).alias("rid"), F.lit("z").alias("_drop"), F.lit(3).alias("a.b"))


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def empty(docs):
    return docs.where("false")


@pytest.fixture(scope="session")
def mixed(docs, odd):
    """Ordinary and odd documents in one table."""
    return docs.unionByName(odd.select(*docs.columns))
