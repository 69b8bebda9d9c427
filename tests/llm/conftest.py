import pytest
from pyspark.sql import Row

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, ids string, media string, leader long, root long, __gone string"

LONG = " ".join(f"word{k % 97} thing{k % 89}" for k in range(30_000))
PASSAGE = " ".join(f"alpha{k} beta{k}" for k in range(40))


@pytest.fixture(scope="session")
def odd_texts():
    """Null, empty, blank, short, long, repeated and odd texts."""
    return [None, "", " \n\t ", "One", "one two", "Ärger über Öl.\nZeile zwei.", LONG, "same text here now", "same text here now", "a\x00b \x1c c\u0085d", "😀 <|endoftext|> fin", PASSAGE + "\ntail one", "head two\n" + PASSAGE, "no letters: 123 456 !!!"]


@pytest.fixture(scope="session")
def odd(spark, odd_texts):
    """Documents with odd texts, a null id, a repeated row, and columns that clash with internal names."""
    rows = [(k, t, None if k % 5 == 3 else "en", f"s{k % 3}", None if t is None else len(t), "x", "y", "z", 1, 2, None) for k, t in enumerate(odd_texts)]
    rows.append((None, "an id is missing here", "en", "s", 21, "x", "y", "z", 1, 2, None))
    rows.append(rows[5])
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def tokenizer():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    return public_tokenizers.path("word_bpe_49k.json")
