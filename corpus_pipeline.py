"""From raw documents to packed training sequences, stage by stage.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

from recordaudit.llm import language, mixing, nearcopies, packing, quality
from recordaudit.llm.common import stored, table


def identify_language(spark, docs, sf_dir):
    """Drop the documents whose language cannot be told."""
    return language.keep_identified(docs)


def keep_quality(spark, docs, sf_dir):
    """Drop the documents that the quality classifier takes for label 0."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark, docs, sf_dir):
    """Keep one document of each group that five-word resemblances of 0.8 or more link."""
    return nearcopies.keep_one(docs)


def mix_sources(spark, docs, sf_dir):
    """The mix as documents: each as often as the mix takes it, rounded, under its own id; those it does not take go."""
    return mixing.mixed_documents(docs)


def pack_sequences(spark, docs, sf_dir):
    """Pieces of the documents in sequences of at most 1024 tokens."""
    return packing.pack(docs)


STAGES = [
    ("language ID", identify_language),
    ("quality classifier", keep_quality),
    ("SimHash near-dedup", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: The first three stages and the tokenizer are beyond SQL; tests/llm holds run() against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
