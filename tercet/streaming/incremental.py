"""Texts that keep coming: extraction batch by batch, and running counts."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.files import Checkpoint


def extract_stream(texts: DataFrame, extract: Callable[[DataFrame], DataFrame], store: Checkpoint, state: str, *, once: bool = True) -> StreamingQuery:
    """Runs `extract` (texts to text, status, states) over each micro-batch's texts that the store doesn't have, and adds them to it. A batch that is run again adds nothing twice."""

    def batch(df: DataFrame, _: int) -> None:
        store.add(extract(store.remaining(df.select("text").distinct())))

    writer = texts.writeStream.foreachBatch(batch).option("checkpointLocation", state)
    return (writer.trigger(availableNow=True) if once else writer).start()


def running_counts(wide: DataFrame, features: Sequence[str], by: str) -> DataFrame:
    """(label, n, p_<feature>, a_<feature>): a streaming aggregate of rows, present and absent states."""
    sums = [x for f in features for x in (F.count_if(F.col(f) == 1).alias(f"p_{f}"), F.count_if(F.col(f) == 0).alias(f"a_{f}"))]
    return wide.groupBy(F.col(by).alias("label")).agg(F.count("*").alias("n"), *sums)
