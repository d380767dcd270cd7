"""Raw documents to packed training sequences: five stages, each written as Parquet and read by the next one.

A stage deletes nothing that it has not written itself; run() deletes the working tables of a stage, and the output of the
stage before, once its own output is written, and on failure. What the last stage gives stays in the shared folder.

Cases, in every stage: rows with nulls in any column are rows like any other (a null text fails the quality rules);
repeated rows are one after the near-duplicate stage; an empty table gives an empty one; other columns come along in all
stages but the last, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixar.llm import common, decontam, line_dedup, minhash, packing, quality


def _through(docs: DataFrame, made: tuple[str, ...], stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """stage(docs) with the columns of docs alone; those named like one that the stage makes step aside meanwhile."""
    aside = {c: common.free_name(docs.columns, f"_own_{c}") for c in docs.columns if c.lower() in made}
    out = stage(docs.withColumnsRenamed(aside)).drop(*made).withColumnsRenamed({v: k for k, v in aside.items()})
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return _through(docs, quality.MADE, lambda d: quality.assess(d, labels).filter("kept"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without their source's boilerplate lines; n_chars follows the text."""

    def drop(d: DataFrame) -> DataFrame:
        out = line_dedup.drop_boilerplate(d)
        if "n_chars" not in d.columns:
            return out
        return out.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast(d.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))

    return _through(docs, line_dedup.MADE, drop)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates, the one of the least doc_id: sets of five-word shingles link by SimHash
    fingerprints that differ in up to 3 bits, and where these lie further apart at a similarity from 0.8."""
    return minhash.keep_one(docs, radius=3)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no span with the benchmark."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _through(docs, decontam.MADE, lambda d: decontam.find_contamination(d, benchmark, carry=d.columns).filter("n_hit = 0"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the packed sequences."""
    return packing.pack(docs, with_ids=False)


STAGES = [("quality_rules", quality_rules), ("line_dedup", dedup_lines), ("simhash_dedup", dedup_documents), ("decontamination", decontaminate), ("packing", pack)]

#: Shingle sets, tokenizer and packing have no SQL form; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with common.Working(spark) as outputs:
        for name, stage in STAGES:
            path = common.new_path(spark, f"pipeline-{name}")
            with common.Working(spark) as working:
                stage(spark, docs, sf_dir).write.parquet(path)
            working.release()
            outputs.release(but=path)
            docs = spark.read.parquet(path)
    return docs
