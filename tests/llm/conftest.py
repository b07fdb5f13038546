import pytest
from pyspark.sql import types as T

LONG = " ".join(f"word{i % 977} item{i}" for i in range(12_000))
SHARED = "This line of prose is shared by quite a number of documents in the table.\n"
PASSAGE = "a passage of text that two documents have in common, long enough to count as one and then some more of it, " * 3
CHAIN = [" ".join(f"t{k}" for k in range(i * 2, 60 + i * 2)) for i in range(6)]  # each like the next, the first unlike the last

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # names that the operators use themselves
        *[T.StructField(n, T.StringType()) for n in ("id", "kept", "n_words", "size", "group", "row", "tag", "key")],
    ]
)


def edge_texts():
    """Texts with nulls, blanks, ties, repeats, long ones, other scripts, shared lines and passages."""
    out = [None, "", " \t\n \x0b", "one", "one", "One", "two words", "\n\n", "a\nb\na\n", "naïve café — “quotes” …", "漢字とかな 한국어 текст", "emoji 😀😀 and é", "tab\there\r\nand there", LONG, LONG, LONG + " end"]
    out += [f"{SHARED}own line number {i} of a document\n" + SHARED.upper() * (i % 2) + ("x" * 45 + "\n" if i < 4 else "") for i in range(7)]
    out += [f"start {i} " + PASSAGE + f" end {i}" for i in range(3)] + ["aaaa " * 400, "ab" * 700]
    out += CHAIN + ["<|endoftext|> in a <|endoftext|>text", "don't we'll I'M   three spaces  12345 6 ½²  x y　z\u0085q"]
    return out


def rows_of(texts, first=0):
    return [(first + 3 * i, t, ("en", "de", None)[i % 3], ("web", "book", None, "wiki", "é")[i * i % 5], None if t is None else len(t), *["x"] * 8) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def edge_rows():
    return rows_of(edge_texts())


@pytest.fixture(scope="session")
def edge_docs(spark, edge_rows):
    return spark.createDataFrame(edge_rows, DOCS).repartition(3)


@pytest.fixture(scope="session")
def empty_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def null_id_docs(spark, edge_rows):
    """All rows twice, and once more without an id."""
    return spark.createDataFrame(edge_rows + edge_rows + [(None, *r[1:]) for r in edge_rows], DOCS)


@pytest.fixture(scope="session")
def table_rows(spark, sf_dir):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
