"""A corpus pipeline: quality rules, line dedup, near-duplicates, mixing, tokenizing.

``STAGES`` lists (name, function). A function takes (spark, docs, sf_dir) and
returns a DataFrame; the runner writes it as Parquet and reads it again as the next
function's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.llm import line_dedup, poisson_mix, quality, similar_sets, simhash, wfst_pieces
from pointloom.llm._util import read_table, shared_folder
from pointloom.llm.queries import MIX_OTHER, MIX_SEED, MIX_WEIGHTS


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    model = quality.fit(docs, read_table(spark, sf_dir, "labels"))
    return quality.keep_good(docs, model)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in several documents stay in the first one only; n_chars follows the text."""
    return line_dedup.dedup_lines(docs).withColumn("n_chars", F.length("text").cast("long"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (5-word Jaccard of 0.8 or more) stays, the smallest.

    SimHash fingerprints meet on the popcount grid and are checked on whole sets; pairs beyond the grid's radius are found exactly.
    """
    return simhash.keep_one_of_each(docs, similar_sets.near_duplicates)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out so that sources have their target shares, and shuffled."""
    return poisson_mix.replicate_to_weights(docs, MIX_WEIGHTS, MIX_OTHER, seed=MIX_SEED).select(*docs.columns)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts become piece ids; every other column stays."""
    return wfst_pieces.encode_texts(docs, wfst_pieces.model_bytes())


STAGES = [
    ("quality", keep_quality),
    ("line_dedup", drop_repeated_lines),
    ("near_duplicates", drop_near_duplicates),
    ("mix", mix_sources),
    ("pieces", encode_pieces),
]

#: The multinomials, XXH64 fingerprints and pieces have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def _remove(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever store it is."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``, each written to the shared folder and read again.

    A stage's rows are deleted once the next stage has been written; those that the last one reads stay.
    """
    folder = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs, before = read_table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        here = f"{folder}/{k}-{name}"
        out.write.parquet(here)
        docs = spark.read.parquet(here)
        if before is not None:
            _remove(spark, before)
        before = here
    return docs
