"""Vocabularies (category, value): normalisation, consolidation and the schema document."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import feature_name, normalised, singular_candidates

#: Values that say nothing, in normalised form.
NOISE = ("miscellaneous", "n_a", "na", "nan", "no_history", "no_treatment", "none", "none_mentioned", "not_mentioned", "not_specified", "null", "other", "unknown", "various")
#: Categories whose values are enumerated.
ENUMS = {
    "demographics_age": ("0-5", "5-10", *(f"{k}-{k + 10}" for k in range(10, 80, 10)), "80-plus"),
    "demographics_sex": ("female", "male", "other"),
    "duration": ("hours", "days", "weeks", "months", "years", "chronic"),
    "lesion_count": ("single", "few_2_to_5", "multiple_6_to_20", "many_20_plus", "numerous"),
    "severity": ("mild", "moderate", "severe", "very_severe"),
}
#: A category with two scales: where one value of the first is there, only those of the first stay, else only those of the second.
SCALES = {"demographics_skin_type": (tuple(f"fst{k}" for k in range(1, 7)), ("fair", "light", "medium", "olive", "brown", "dark", "deeply_pigmented"))}


def merged(raw: DataFrame) -> DataFrame:
    """raw: (category, value, position). Each normalised value of a category once, with its first position; blank ones go."""
    rows = raw.select(normalised("category").alias("category"), normalised("value").alias("value"), "position").where("value <> '' and category <> ''")
    return rows.groupBy("category", "value").agg(F.min("position").alias("position"))


def without_plurals(vocabulary: DataFrame) -> DataFrame:
    """Less the values of which a singular is there too, in the same category."""
    plural = vocabulary.select("category", "value", F.explode(singular_candidates("value")).alias("singular"))
    gone = plural.join(vocabulary.select("category", F.col("value").alias("singular")), ["category", "singular"], "left_semi").select("category", "value").distinct()
    return vocabulary.join(gone, ["category", "value"], "left_anti")


def allowed(vocabulary: DataFrame, enums: Mapping[str, Sequence[str]], noise: Sequence[str] = NOISE) -> DataFrame:
    """Of a category with an enumeration its members, of others what isn't noise."""
    members = vocabulary.sparkSession.createDataFrame([(c, v) for c, vs in enums.items() for v in vs] or [(None, None)], "category string, value string")
    closed = F.col("category").isin(list(enums))
    inside = vocabulary.where(closed).join(F.broadcast(members), ["category", "value"], "left_semi")
    return inside.unionByName(vocabulary.where(~closed & ~F.col("value").isin(list(noise))))


def one_scale(vocabulary: DataFrame, scales: Mapping[str, tuple[Sequence[str], Sequence[str]]] = SCALES) -> DataFrame:
    """Of a category with two scales the values of the first, if it has any, else those of the second; others stay as they are."""
    out = vocabulary
    for category, (first, second) in scales.items():
        own = F.col("category") == category
        some = F.max(own & F.col("value").isin(list(first))).over(Window.partitionBy("category"))
        kept = F.when(F.col("__some"), F.col("value").isin(list(first))).otherwise(F.col("value").isin(list(second)))
        out = out.withColumn("__some", some).where(~own | kept).drop("__some")
    return out


def enforced(vocabulary: DataFrame, enums: Mapping[str, Sequence[str]] = ENUMS, scales: Mapping[str, tuple[Sequence[str], Sequence[str]]] = SCALES, noise: Sequence[str] = NOISE) -> DataFrame:
    """Enumerations, scales and noise at once, on normalised values; a category with scales has no noise of its own."""
    scaled = F.col("category").isin(list(scales))
    return one_scale(vocabulary.where(scaled), scales).unionByName(allowed(vocabulary.where(~scaled), enums, noise))


def with_values(vocabulary: DataFrame, wanted: Sequence[tuple[str, str]]) -> DataFrame:
    """The union with values that must be there, and whether they were added."""
    own = vocabulary.sparkSession.createDataFrame(list(wanted), "category string, value string").distinct()
    new = own.join(vocabulary, ["category", "value"], "left_anti")
    return vocabulary.select("category", "value", F.lit(False).alias("added")).union(new.select("category", "value", F.lit(True)))


def schema_document(vocabulary: DataFrame, compared: Sequence[str] = ()) -> DataFrame:
    """(category, n_features, document): a category's features in order, as JSON."""
    name = feature_name("category", "value")
    own = vocabulary.groupBy("category").agg(F.array_sort(F.collect_set("value")).alias("features"), F.array_sort(F.collect_set(F.when(name.isin(list(compared)), F.col("value")))).alias("comparable_features"))
    return own.select("category", F.size("features").cast("long").alias("n_features"), F.to_json(F.struct("category", "features", "comparable_features")).alias("document"))


def merged_records(records: DataFrame, keys: Sequence[str], lists: Mapping[str, int | None]) -> DataFrame:
    """A row for each combination of keys, with the distinct values of each column of `lists` in order, the first so many of them (None: all)."""
    out = None
    for column, most in lists.items():
        own = records.where(F.col(column).isNotNull()).select(*keys, column).distinct()
        if most is not None:
            own = own.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(column))).where(F.col("__r") <= most)
        own = own.groupBy(*keys).agg(F.array_sort(F.collect_list(column)).alias(column))
        out = own if out is None else out.join(own, list(keys), "full_outer")
    return out
