"""Corpus pipeline: language identification, exact and near-duplicate removal, removal of personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on what its predecessor kept; ``run`` writes each stage's rows to the shared
folder and reads them again. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from hourglass.llm.common import documents, set_aside, settle
from hourglass.llm.exact import deduplicate
from hourglass.llm.langid import Scorer, predict, scrambled, train, training_sample
from hourglass.llm.ngram_join import linked_rows
from hourglass.llm.packing import pack
from hourglass.llm.pii import sanitise
from hourglass.llm.queries import pattern, vocabulary


#: The class of text in no language; no label has this name.
NO_LANGUAGE = "no language"


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network finds to be in a language, as given.

    The network learns the labelled languages and, as one more class, scrambled text in none. A text goes where that class wins
    by more than a limit, which lies halfway between certainty and the most that any window of the training sample gets. NULL
    texts and texts without letters go. Where there is nothing to learn from, all texts with letters stay.
    """
    given, back = set_aside(docs, ("doc_id", "text"))
    sample = training_sample(docs)
    if not sample:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    net = train(sample + scrambled(sample, NO_LANGUAGE))
    most = float(Scorer(net).texts([text for _, text in sample])[:, net.languages.index(NO_LANGUAGE)].max())
    found = predict(given, net)
    return found.filter(f"lang_pred <> 'und' AND NOT (lang_pred = '{NO_LANGUAGE}' AND score > {(1 + most) / 2})").select(*back)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (white space apart) the row with the smallest doc_id."""
    return deduplicate(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that 5-gram Jaccard links of 0.8 or more connect, the one with the smallest doc_id. A text goes, not an id: rows
    that share a doc_id are kept or dropped by their own texts; a NULL doc_id stays."""
    gone = linked_rows(docs).filter("class_id <> doc_id").select(F.col("doc_id").alias("__id"), F.col("version").alias("__text")).distinct()
    same = (F.col("doc_id").cast("long") == F.col("__id")) & (F.xxhash64("text") == F.col("__text"))
    return docs.join(gone, same, "left_anti").select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with entities replaced by their kind and disclosing words generalised or removed; n_chars follows the text."""
    clean = sanitise(docs, near=None)
    return clean.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else clean


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 1024 tokens."""
    return pack(docs, vocabulary("byte_bpe_50k.json"), pattern())


STAGES = [("language_id", language_id), ("exact_dedup", exact_dedup), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("packing", packing)]

#: The language model, the disclosure statistics' text patterns and the tokeniser have no SQL form; tests check the pipeline by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
