"""The corpus pipeline: five stages over the documents table.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
each result as Parquet below the shared folder and reads it again, so that a
lost executor costs no earlier stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracewright.llm import bpe, lines, mixing, scratch, simhash, toxicity
from tracewright.llm.registry import tokenizer
from tracewright.llm.scratch import table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores below 0.5; labels of the held-out fifth are not learnt.

    Null and empty texts score as the bias alone and so stay, as do rows without
    doc_id, on their text; repeated rows are judged alike; without labels of both
    classes the score is constant; an empty table stays empty.
    """
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def strip_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that three or more sites share (the first place stays).

    Null texts stay null, a text of nothing but such lines becomes empty; a null
    source is a site; rows without doc_id come first in order; ``n_chars``
    follows the new text.
    """
    return lines.cleaned(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of texts at least 0.8 similar over five-word shingles: that with the smallest doc_id.

    Null, empty and blank texts are one class; rows without doc_id stay only
    where their class has no other; of repeated rows one stays.
    """
    return simhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents repeated as their source's target asks.

    A null source is the last one; texts without words weigh nothing but are
    repeated like others of their source; a source without words takes nothing.
    """
    return mixing.sampled(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of the ids of every document of the mix, and of the text decoded from them.

    Null and empty texts have no ids; each repetition is a row.
    """
    return bpe.digests(docs, tokenizer("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", strip_boilerplate),
    ("simhash near-dedup", drop_near_copies),
    ("source mixing", mix_sources),
    ("bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = scratch.store(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
        if before is not None:
            scratch.discard(before)  # the stage that read it is written
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)


#: Toxicity, fingerprints and byte-pair encoding have no SQL form.
ORACLE_SQL = None
