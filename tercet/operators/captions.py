"""Texts to be read by an extractor: deduplication, sampling, batches, replication of answers, resumption."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_blank, strip


def first_of_each(df: DataFrame, text: str, order: str, by: str | None = None) -> DataFrame:
    """The first row, by `order`, of each text (less white space at its ends) of each label; blank texts go. An aggregate, so that copies are dropped before the shuffle."""
    rest = [c for c in df.columns]
    keys = ([by] if by else []) + ["__key"]
    keyed = df.where(~is_blank(text)).withColumn("__key", strip(text))
    best = keyed.groupBy(*(F.md5("__key").alias("__key") if k == "__key" else F.col(k) for k in keys)).agg(F.min_by(F.struct(*rest), order).alias("__row"))
    return best.select("__row.*")


def dedup_stats(df: DataFrame, text: str) -> DataFrame:
    """(total_rows, unique_texts, duplicates_saved, empty_texts)."""
    blank = is_blank(text)
    out = df.agg(F.count("*").alias("total_rows"), F.countDistinct(F.when(~blank, F.md5(strip(text)))).alias("unique_texts"), F.count_if(blank).alias("empty_texts"))
    return out.withColumn("duplicates_saved", F.col("total_rows") - F.col("unique_texts") - F.col("empty_texts"))


def replicate(df: DataFrame, text: str, answers: DataFrame, features: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Each row with the states that its text was given; unknown where it has none. answers: (text, one column a feature), a row a text."""
    # By digests: texts themselves would be shuffled on both sides.
    own = answers.select(F.md5(strip("text")).alias("__key"), *features)
    out = df.select(*keep, F.md5(strip(text)).alias("__key")).join(own, "__key", "left")
    return out.select(*keep, *(F.coalesce(f, F.lit(2).cast("tinyint")).alias(f) for f in features))


def remaining(texts: DataFrame, done: DataFrame, failed: DataFrame) -> DataFrame:
    """The texts still to be done: those that aren't, and those that failed."""
    return texts.join(done.join(failed, "text", "left_anti"), "text", "left_anti")


def sample_size(n: Column, tiers: Sequence[tuple[int, int]] = ((5000, 500), (1000, 300), (200, 200))) -> Column:
    """How many of a label's n rows are sampled: the first tier's size whose bound n is above, else all."""
    out = None
    for bound, size in tiers:
        out = F.when(n > bound, size) if out is None else out.when(n > bound, size)
    return out.otherwise(n).cast("long")


def stratified_sample(df: DataFrame, by: str, within: str, key: str, seed: int = 42, tiers: Sequence[tuple[int, int]] = ((5000, 500), (1000, 300), (200, 200))) -> DataFrame:
    """A label's sample, spread over its sublabels: each gives up to an equal part, one at least; what is above the label's size goes. The order is by md5 of seed and key, so a sample
    is the same on any cluster. Rows without label or sublabel are never sampled."""
    rows = df.where(F.col(by).isNotNull() & F.col(within).isNotNull())
    sizes = rows.groupBy(by, within).agg(F.count("*").alias("__n"))
    part_sizes = sizes
    label = sizes.groupBy(by).agg(F.sum("__n").alias("__total"), F.count("*").alias("__parts"))
    label = label.withColumn("__wanted", sample_size(F.col("__total"), tiers))
    part = F.when((F.col("__parts") > 1) & (F.col("__wanted") < F.col("__total")), F.greatest(F.lit(1), F.floor(F.col("__wanted") / F.col("__parts")))).otherwise(F.col("__wanted"))
    label = label.withColumn("__each", part)
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))
    ranked = rows.join(F.broadcast(part_sizes.join(label, by)), [by, within]).withColumn("__order", order)  # a row a label and sublabel
    # Digests are evenly spread: those of a sublabel's first rows lie below a bound, ten deviations and more above what is expected, so that few rows are sorted.
    share = (F.col("__each") + 10 * F.sqrt(F.col("__each").cast("double")) + 100) / F.col("__n")
    ranked = ranked.where(F.conv(F.substring("__order", 1, 8), 16, 10).cast("double") / 2.0**32 <= share)
    ranked = ranked.withColumn("__r", F.row_number().over(Window.partitionBy(by, within).orderBy("__order", key))).where("__r <= __each")
    ranked = ranked.withColumn("__s", F.row_number().over(Window.partitionBy(by).orderBy("__order", key))).where("__s <= __wanted")
    return ranked.select(*df.columns)


def tiers_of(df: DataFrame, by: str, bounds: Sequence[int] = (5000, 1000, 200)) -> DataFrame:
    """(tier, n_labels, n_rows, n_sampled)."""
    n = F.col("n")
    names = None
    for b in bounds:
        names = F.when(n > b, f"over_{b}") if names is None else names.when(n > b, f"over_{b}")
    sizes = df.where(F.col(by).isNotNull()).groupBy(by).agg(F.count("*").alias("n"))
    return sizes.groupBy(names.otherwise("all").alias("tier")).agg(F.count("*").alias("n_labels"), F.sum("n").alias("n_rows"), F.sum(sample_size(n)).alias("n_sampled"))


def batches(df: DataFrame, by: str, order: str, size: int, span: int = 100_000) -> DataFrame:
    """df with `batch`, from 0 within each label, of `size` rows in order.

    Rows are numbered within ranges of `span` values of a numeric order, to which the ranges' running counts are added: no task has a whole
    label. By another order a label's rows are numbered at once."""
    if df.schema[order].dataType.typeName() not in ("byte", "short", "integer", "long"):
        return df.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy(by).orderBy(order)) - 1) / size).cast("long"))
    rows = df.withColumn("__range", F.floor(F.col(order) / span))
    counts = rows.groupBy(F.col(by).alias("__by"), F.col("__range").alias("__at")).agg(F.count("*").alias("__n"))
    # Nulls come first, as they do in a window.
    before = F.coalesce(F.sum("__n").over(Window.partitionBy("__by").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("__by", "__at", before.alias("__before"))
    joined = rows.join(counts, F.col(by).eqNullSafe(F.col("__by")) & F.col("__range").eqNullSafe(F.col("__at")))
    place = F.row_number().over(Window.partitionBy(by, "__range").orderBy(order)) - 1 + F.col("__before")
    return joined.withColumn("batch", F.floor(place / size).cast("long")).select(*df.columns, "batch")


def sampled(df: DataFrame, mode: str, by: str, within: str, key: str, **options: int) -> DataFrame:
    """The rows to be read: all that have a label, or a sample of each label."""
    if mode == "full":
        return df.where(F.col(by).isNotNull())
    if mode == "stratified":
        return stratified_sample(df, by, within, key, **options)
    raise ValueError(f"a sampling mode is 'stratified' or 'full', not {mode!r}")


def calls(df: DataFrame, by: str, text: str, size: int, done: Sequence[str] = ()) -> DataFrame:
    """(n_labels, n_done, n_unique, n_calls): how many calls the labels that aren't done take, at `size` different texts a call. Blank texts don't count."""
    own = df.where(F.col(by).isNotNull()).withColumn("__done", F.col(by).isin(list(done)))
    texts = F.countDistinct(F.when(~F.col("__done") & ~is_blank(text), F.md5(strip(text))))
    labels = own.groupBy(by, "__done").agg(texts.alias("__n"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return labels.agg(F.count("*").alias("n_labels"), F.count_if("__done").alias("n_done"), zero(F.sum("__n")).alias("n_unique"), zero(F.sum(F.ceil(F.col("__n") / size))).alias("n_calls"))


def length_histogram(df: DataFrame, text: str, edges: Sequence[int] = (50, 100, 150, 200, 250, 300, 400, 500, 1000)) -> DataFrame:
    """(bin, n_texts, percentage) of texts' lengths; a bin is named by its least length."""
    n = F.char_length(text)
    at = F.lit(0)
    for e in edges:
        at = F.when(n >= e, e).otherwise(at) if e == edges[0] else F.when(n >= e, e).otherwise(at)
    out = df.where(~is_blank(text)).groupBy(at.cast("int").alias("bin")).agg(F.count("*").alias("n_texts"))
    return out.withColumn("percentage", F.bround(F.col("n_texts") * 100.0 / F.sum("n_texts").over(Window.partitionBy()), 1))
