import pytest

SF = "/root/testdata/sf0.001"

# nulls in every column, empty and white-space texts, one long text, repeated rows, a repeated key
EDGE_DOCS = [
    (1, "the quick brown fox jumps over the lazy dog by the river bank today", "en", "a", 10),
    (1, "the quick brown fox jumps over the lazy dog by the river bank today", "en", "a", 10),
    (2, None, None, None, None),
    (3, "", "en", "b", 0),
    (4, " \t\n ", "en", "b", 4),
    (None, "a text without any key at all but with several words in it", "de", None, 3),
    (5, "two words", "en", "a", 9),
    (6, "Grüße aus Köln \U0001f600 token = \"24be64439e3e49cf46b2d7c90f3602a3d0b907ff\" Ende", "de", "c", 50),
    (7, "word " * 30_000, "en", "c", 150_000),
    (8, "x" * 5000, "en", "c", 5000),
    (5, "another text under the key five with more words than two", "en", "b", 9),
]
DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def edge_docs(spark):
    from ledgerwise.llm.common import ship

    ship(spark)
    return spark.createDataFrame(EDGE_DOCS, DOC_SCHEMA)


@pytest.fixture(scope="session")
def clashing(edge_docs):
    """Extra columns whose names operators may use inside."""
    from pyspark.sql import functions as F

    names = ["key", "blob", "path", "copies", "size", "target", "_e", "_part", "row", "id", "nth", "cls", "slot", "shard",
             "words_vec", "p_toxic", "_text", "state", "edits", "after", "ids", "sequence_id", "h"]
    return edge_docs.select("*", *[F.lit("clash").alias(n) for n in names])


def docs_of(sf):
    import pyarrow.parquet as pq

    t = pq.read_table(f"{sf}/documents.parquet").to_pydict()
    return list(zip(t["doc_id"], t["text"], t["source"]))


@pytest.fixture(scope="session")
def docs():
    return docs_of(SF)
