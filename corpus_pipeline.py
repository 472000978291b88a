"""A corpus pipeline in five stages: language, near duplicates, test items, personal data, mix.

Each stage gets what the one before it kept, written as Parquet and read again. All but the last return the columns of
``documents``; the last returns the mix: how many words to take of each document that is left. ``write`` makes the mix
itself, the texts in the order in which they are to be read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from probata.llm.decontam import decontaminate
from probata.llm.langid import fit as fit_languages
from probata.llm.langid import held_out, keep_identified
from probata.llm.mixing import mix
from probata.llm.mixing import write as write_mix
from probata.llm.neardup import keep_one
from probata.llm.pii import fit as fit_labelers
from probata.llm.pii import mask
from probata.session import removed, scratch, stored


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language is found; those without a letter, or like no language that was learned, go."""
    return keep_identified(docs, fit_languages(docs, F.col("doc_id").isNotNull() & ~held_out()))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group of equal or near texts."""
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of ``benchmark``."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind and ``n_chars`` that of the new text."""
    return mask(docs, fit_labelers(docs))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, size, source_size, target, taken of all documents."""
    return mix(docs)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("mixture", mixture),
]

#: Sketches, alignment and prototypes are beyond SQL: tests/llm/test_pipeline.py holds every stage against a plain version.
ORACLE_SQL: str | None = None


def kept(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, str]:
    """What all stages but the last keep of ``documents``, and the folder that it is in; those of the stages before are deleted on the way."""
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), ""
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(path := scratch(spark, f"stage-{name}"))
        if folder:
            removed(spark, folder)
        docs, folder = spark.read.parquet(path), path
    return docs, folder


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for ``documents``."""
    docs, folder = kept(spark, sf_dir)
    out = stored(STAGES[-1][1](spark, docs, sf_dir), "stage-last")
    removed(spark, folder)
    return out


def write(spark: SparkSession, sf_dir: str, path: str) -> DataFrame:
    """The mix itself, as Parquet under ``path``: (slot, doc_id, source, begin, lo, text), to be read in that order."""
    docs, folder = kept(spark, sf_dir)
    out = write_mix(docs, path)
    removed(spark, folder)
    return out
