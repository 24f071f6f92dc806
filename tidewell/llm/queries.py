"""The queries of problems 6 to 8, and their SQL where there is any."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewell.llm import bpe, packing, sentences
from tidewell.session import table


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_corpus(table(spark, sf_dir, "documents"))


def _packed(spark: SparkSession, sf_dir: str) -> packing.Packed:
    counts = bpe.encode_corpus(table(spark, sf_dir, "documents"), counts_only=True)
    capacities = {r[0]: r[1] for r in table(spark, sf_dir, "pack_capacities").select("pack_name", "capacity_tokens").dropna().toLocalIterator()}  # three rows, fixed
    return packing.pack(counts, capacities)


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each piece of each document with its container, for every capacity."""
    return _packed(spark, sf_dir).pieces


def p7_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each capacity the containers used and the number that no packing can go below."""
    return _packed(spark, sf_dir).bounds


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentence units; disclaimers are prose: of the blocks that are one unit TESTDATA.md names footers, and no notices."""
    return sentences.split_sentences(table(spark, sf_dir, "documents"), notices=False)


def queries() -> dict:
    return {f.__name__: f for f in (p6_ids, p7_containers, p7_bounds, p8_found)}


def oracles() -> dict[str, str]:
    return {}
