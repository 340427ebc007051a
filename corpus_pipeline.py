"""A training corpus from raw documents: five stages, each over all that the one before kept.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame.
:func:`run` applies them to ``documents``, settling each result in the shared folder.

1. quality classifier: documents that score under 0.3 go;
2. line dedup: frequent lines stay in the largest id only, ``n_chars`` follows the text;
3. MinHash near-dedup on shingles of five words at 80 %: the smallest id of each group stays;
4. benchmark decontamination: documents that hold a benchmark item go;
5. mixing to target weights: rows repeat, ``copy`` numbers them.

All but the last return the columns of the documents, unknown ones untouched.  Rows without an id
pass the dedup and decontamination stages unchanged and are mixed under the key ``null``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakstone.llm import decontaminate, line_runs, minhash, mixing, quality_model
from cloakstone.sources.session import keep, tune


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tune(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_model.keep_good(docs, _read(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    tune(spark)
    cleaned = line_runs.dedup_lines(docs).select(*docs.columns)
    if "n_chars" not in docs.columns:
        return cleaned
    kind = docs.schema["n_chars"].dataType
    return cleaned.withColumn("n_chars", F.coalesce(F.length("text").cast(kind), F.col("n_chars")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    tune(spark)
    return minhash.drop_near_duplicates(docs, width=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, _read(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


STAGES = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("near dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixture),
]

#: Trees, minimum hashes and edit distances are not expressible in SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES):
            docs = keep(docs, f"stage{number}")
    return docs
