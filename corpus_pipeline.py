"""The corpus pipeline: language ID, line dedup, near-duplicate removal,
benchmark decontamination, BPE encoding.

Each stage works on all that its predecessor kept; between stages the documents
are written as Parquet in the shared folder and read again.

Defined cases of every stage: a null text has no language, so its document goes in
the first stage; an empty table stays empty; very long texts are handled whole; rows
that repeat a doc_id are kept or dropped together; a null doc_id is kept wherever its
text is; of copies the least doc_id stays, which settles ties; further columns stay,
whatever their names, until the last stage, which returns its own columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quern.llm import bpe, contamination, langid, lines, setjoin
from quern.llm.queries import table, tokenizer_path
from quern.llm.shared import materialize


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a known language go."""
    return langid.keep_known(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated runs of lines go, and documents that held nothing else."""
    return lines.drop_emptied(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8) the least doc_id stays."""
    return setjoin.keep_one(docs, width=5, num=80, den=100)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark passages go."""
    return contamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded texts."""
    return bpe.encode_decode(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("bpe_codec", bpe_encoding),
]

#: The stages' models and tokenizer have no SQL form; tests hold each stage against a brute-force version on its own input.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, name)
    return docs
