"""A corpus clean-up in five stages, each one of the training-data operators.

Each stage takes (spark, docs, sf_dir) and returns the documents it keeps, with the
columns of ``documents``; the last returns one row of digests for each document left.

Cases, the same in all stages: a null or empty text is a document like any other (it has
no toxic word, no line, no shingle, no benchmark passage, no token) and stays; a null
doc_id stays too, as nothing can be told of it by id; repeated rows are judged alike and
stay or go together, except that a stage never adds rows; among near-duplicates that tie,
the smallest doc_id stays; extra columns of any name are carried through to the last
stage but one; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbitile.llm import bpe_tree, decontaminate, line_dedup, near_dedup, toxicity
from orbitile.llm.queries import pretoken_pattern, tokenizer_file
from orbitile.llm.shared import materialize, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of alike lines the first stays; n_chars, where there is one, follows the text.

    A document that loses all its lines stays with an empty text; a null text stays null.
    """
    # a column of the name of the operator's count waits under another name
    other = next(n for n in (f"n_removed_{k}" for k in range(len(docs.columns) + 1)) if n not in docs.columns)
    out = line_dedup.line_dedup(docs.withColumnRenamed("n_removed", other), floor=1).drop("n_removed").withColumnRenamed(other, "n_removed")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document of the smallest doc_id stays."""
    return near_dedup.without_near_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what is left."""
    return bpe_tree.encode_and_decode(docs, tokenizer_file("byte_bpe_multi_50k.tiktoken"), pretoken_pattern())


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("minhash_near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("bpe", encode),
]

#: No stage but the last could be said in SQL; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
