"""The corpus pipeline: documents to a deduplicated, decontaminated, weighted mixture.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame that is written as Parquet and read again as
the next stage's docs. All but the last keep the columns of documents; the last adds `copies`.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from tercet.llm import decontamination, jaccard, line_dedup, mixing, toxicity
from tercet.llm.common import alone, table, tables_written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labels of those here, rejects go; null and empty texts stay, repeated rows go together."""
    return toxicity.without_toxic(docs, toxicity.model_of(docs, table(spark, sf_dir, "labels")))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go, and documents of which nothing else is left; null and empty texts stay."""
    return line_dedup.dedup_lines(docs, drop_emptied=True)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are linked by pairs of alike ones that of least doc_id stays. Rows without doc_id, and those without words, stay."""
    return jaccard.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in whose text eight words in a row of a benchmark item occur go; null and empty texts stay."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A column copies by the sources' weights; documents of none go. A null source is one of its own, rows that repeat an id have equal copies."""
    return mixing.mixed(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line dedup", dedup_lines),
    ("n-gram Jaccard join", keep_one_of_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("mixing sources to target weights", mix_sources),
]

#: SQL can't express the compression distances of the first stage; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixture: the columns of documents and `copies`, a row for each row of the documents that stays and has a copy. Each stage's result is
    written and read again, and what was written before it goes. An empty documents table gives an empty mixture."""
    docs, before = table(spark, sf_dir, "documents"), tables_written()
    for _, stage in STAGES[:-1]:
        docs = alone(partial(stage, spark, docs, sf_dir), before)
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
