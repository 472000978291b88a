"""The queries of this subpackage: opN_<name> over the whole table it is meant for, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import identify

    return identify(read(spark, sf_dir, "documents"))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neardup import near_duplicates

    return near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontam import contaminated

    return contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(read(spark, sf_dir, "documents"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import detect, fit

    docs = read(spark, sf_dir, "documents")
    return detect(docs, fit(docs))


def op1_url_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .urlrank import judge

    return judge(read(spark, sf_dir, "pages"))


def op4_warc_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..session import scratch
    from .warc import read as read_archives
    from .warc import write

    write(read(spark, sf_dir, "pages"), folder := scratch(spark, "warc"))
    return read_archives(spark, folder, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .spans import remove_repeated

    return remove_repeated(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import fit, score

    docs = read(spark, sf_dir, "documents")
    return score(docs, fit(docs, read(spark, sf_dir, "labels")))


def op3_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann import nearest

    return nearest(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op11_hamerly_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quantize import codes

    return codes(read(spark, sf_dir, "embeddings"))


def op12_lobpcg_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .whiten import whitened

    return whitened(read(spark, sf_dir, "embeddings"))


def op13_boosted_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .extract import extracted, fit

    return extracted(read(spark, sf_dir, "pages"), fit())


QUERIES = {
    "op13_boosted_extraction": op13_boosted_extraction,
    "op11_hamerly_codes": op11_hamerly_codes,
    "op12_lobpcg_whitening": op12_lobpcg_whitening,
    "op3_cross_polytope": op3_cross_polytope,
    "op7_toxicity_chain": op7_toxicity_chain,
    "op6_sentence_spans": op6_sentence_spans,
    "op4_warc_dictionary": op4_warc_dictionary,
    "op1_url_trust": op1_url_trust,
    "op8_pii": op8_pii,
    "op5_source_mixing": op5_source_mixing,
    "op9_benchmark_decontamination": op9_benchmark_decontamination,
    "op2_minhash_near_dedup": op2_minhash_near_dedup,
    "op10_language_id": op10_language_id,
}
