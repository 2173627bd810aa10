"""Tables of three-valued features: 1 present, 0 absent, 2 unknown.

A category is a closed world: if any of its values is seen in a row, its others are absent; else all are unknown.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip

Lexicon = Mapping[str, Mapping[str, Sequence[str]]]


def features_of(lexicon: Lexicon) -> list[str]:
    return [f"{category}_{value}" for category, values in lexicon.items() for value in values]


def categories_of(lexicon: Lexicon) -> dict[str, str]:
    return {f"{category}_{value}": category for category, values in lexicon.items() for value in values}


def scoped(hits: Mapping[str, Column]) -> dict[str, Column]:
    """A category's columns from whether each of its values is seen."""
    some = reduce(Column.__or__, hits.values())
    return {name: F.when(hit, 1).when(some, 0).otherwise(2).cast("tinyint") for name, hit in hits.items()}


def keyword_columns(text: str, lexicon: Lexicon) -> dict[str, Column]:
    """Each feature by whether one of its terms is a part of the text in lower case."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    out: dict[str, Column] = {}
    for category, values in lexicon.items():
        out |= scoped({f"{category}_{value}": reduce(Column.__or__, (F.contains(low, F.lit(t)) for t in terms)) for value, terms in values.items()})
    return out


def keyword_matrix(df: DataFrame, text: str, lexicon: Lexicon, keep: Sequence[str] = ()) -> DataFrame:
    """The columns `keep` and one for each feature. Terms are looked for once a row."""
    terms = {t for values in lexicon.values() for own in values.values() for t in own}
    names = {t: f"__hit{i}" for i, t in enumerate(sorted(terms))}
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    hit = df.select(*keep, *(F.contains(low, F.lit(t)).alias(n) for t, n in names.items()))
    out: dict[str, Column] = {}
    for category, values in lexicon.items():
        out |= scoped({f"{category}_{value}": reduce(Column.__or__, (F.col(names[t]) for t in own)) for value, own in values.items()})
    return hit.select(*keep, *(c.alias(n) for n, c in out.items()))


def encode(answers: DataFrame, lexicon: Lexicon, key: str, keep: Sequence[str] = ()) -> DataFrame:
    """answers: (key, category, value) as a model gave them, in any number. One row a key with each feature's state, and `fixes`, the number of
    answers that are no known value of a known category. Values are compared in lower case with underscores for blanks, with or without the category's name before them."""
    known = answers.sparkSession.createDataFrame([(c, v) for c, values in lexicon.items() for v in values], "category string, known string")
    value = F.regexp_replace(F.lower(strip("value")), " ", "_")
    prefix = F.concat("category", F.lit("_"))
    bare = F.when(F.startswith(value, prefix), F.substr(value, F.char_length(prefix) + 1)).otherwise(value)
    met = answers.withColumn("bare", bare).join(F.broadcast(known.withColumnRenamed("category", "its")), (F.col("category") == F.col("its")) & (F.col("bare") == F.col("known")), "left")
    seen = met.groupBy(key, *keep).agg(
        F.collect_set(F.concat_ws("_", "its", "known")).alias("__seen"), F.collect_set("its").alias("__categories"), F.count_if(F.col("value").isNotNull() & F.col("its").isNull()).alias("fixes")
    )
    states = [F.when(F.array_contains("__seen", f), 1).when(F.array_contains("__categories", c), 0).otherwise(2).cast("tinyint").alias(f) for f, c in categories_of(lexicon).items()]
    return seen.select(key, *keep, *states, "fixes")


def to_long(wide: DataFrame, features: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """(keep..., feature_idx, feature, value): a row for each feature of a row."""
    pairs = F.array(*(F.struct(F.lit(i).alias("feature_idx"), F.lit(f).alias("feature"), F.col(f).alias("value")) for i, f in enumerate(features)))
    return wide.select(*keep, F.inline(pairs))


def infer_features(df: DataFrame, meta: Sequence[str], share: float = 0.8) -> list[str]:
    """The columns other than `meta` of whose values more than `share` are 0, 1 or 2; one pass over all."""
    names = [c for c, kind in df.dtypes if c not in meta and kind in ("tinyint", "smallint", "int", "bigint", "float", "double", "string")]
    if not names:
        return []
    value = {c: F.expr(f"try_cast(`{c}` as double)") for c in names}
    row = df.agg(*(F.avg(F.coalesce(value[c].isin(0, 1, 2), F.lit(False)).cast("int")).alias(c) for c in names)).first()
    return [c for c in names if (row[c] or 0) > share]


def yes_no(df: DataFrame, column: str) -> Column:
    """A questionnaire's answer. Of a string: YES present, NO absent, else unknown; of another type: present unless null, never unknown."""
    if dict(df.dtypes)[column] == "string":
        said = F.upper(strip(column))
        return F.when(said == "YES", 1).when(said == "NO", 0).otherwise(2).cast("tinyint")
    return F.col(column).isNotNull().cast("tinyint")


def available(df: DataFrame, column: str) -> Column:
    """Whether a questionnaire's answer counts as given: a string if it is YES, without regard to case but to blanks; another type unless null."""
    if dict(df.dtypes)[column] == "string":
        return F.coalesce(F.upper(F.col(column)) == "YES", F.lit(False))
    return F.col(column).isNotNull()


def either(a: Column, b: Column) -> Column:
    """Present if one is, unknown if both are, else absent."""
    return F.when((a == 1) | (b == 1), 1).when((a == 2) & (b == 2), 2).otherwise(0).cast("tinyint")


def known(c: Column) -> Column:
    """Null where unknown."""
    return F.nullif(c, F.lit(2).cast("tinyint"))


def all_unknown(wide: DataFrame, features: Sequence[str], text: str, least: int = 15) -> DataFrame:
    """(reason, rows) of the rows whose every feature is unknown: of those with `least` characters or more something was missed."""
    silent = wide.where(F.forall(F.array(*features), lambda v: v == 2))
    return silent.groupBy(F.when(F.char_length(strip(text)) >= least, "silent_empty").otherwise("short_text").alias("reason")).agg(F.count("*").alias("n_rows"))


def coerced(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Features of any type as whole states; what isn't a number is unknown."""
    return df.withColumns({f: F.coalesce(F.col(f).try_cast("double").try_cast("int"), F.lit(2)) for f in features})


def lanes(features: DataFrame) -> DataFrame:
    """features: (.., by_rule). With `lane`: whether rules or a model find it; without a word a model does."""
    return features.withColumn("lane", F.when(F.coalesce(F.col("by_rule"), F.lit(False)), "rule").otherwise("model"))
