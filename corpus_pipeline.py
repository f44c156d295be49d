"""From raw documents to packed token windows."""

from __future__ import annotations

import threading
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from codeloom.llm import _common as C
from codeloom.llm import mixing, packing, pii, quality_model, simhash


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality_model.keep_good(docs, C.table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, Jaccard similarity 0.8 or more."""
    return simhash.one_of_each(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind."""
    return pii.cleaned(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their windows."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


_thread = threading.local()


def _tidy(stage: Callable[..., DataFrame], first: bool) -> Callable[..., DataFrame]:
    """The stage, which begins by deleting what the stage before it in this thread left in the shared folder: that
    stage's result has been written by then, as the contract between stages says. The last stage's tables stay, as its
    result reads them."""

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if not first:
            C.delete_folders(spark, getattr(_thread, "left", []))
        known = len(C.folders())
        out = stage(spark, docs, sf_dir)
        _thread.left = C.folders()[known:]
        return out

    return run


STAGES = [(name, _tidy(stage, stage is quality)) for name, stage in (("quality classifier", quality), ("SimHash near-dedup", near_dedup), ("PII", personal_data), ("mixing", mix), ("packing", pack))]
#: No SQL: the classifier and the tokenizer have none.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again before the next."""
    docs = C.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = C.cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
