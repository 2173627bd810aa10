"""Column functions over strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"(?U)\s+"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Without Unicode white space at either end; trim() knows the blank only."""
    return F.regexp_replace(col(c), r"(?U)^\s+|\s+$", "")


def is_blank(c: Column | str) -> Column:
    return F.coalesce(strip(c) == "", F.lit(True))


def normalised(c: Column | str) -> Column:
    """A vocabulary value: lower case, runs of white space and underscores as one underscore, none at the ends."""
    low = F.regexp_replace(F.lower(strip(c)), SPACE, "_")
    return F.regexp_replace(F.regexp_replace(low, "_+", "_"), "^_|_$", "")


def safe_name(c: Column | str, length: int = 60) -> Column:
    """A file name: what is neither a word character nor a hyphen becomes an underscore."""
    return F.substring(F.regexp_replace(col(c), r"(?U)[^\w\-]", "_"), 1, length)


def short_label(c: Column | str, most: int = 42) -> Column:
    """On one line, cut to `most` characters with three dots."""
    flat = strip(F.regexp_replace(col(c), "\n", " "))
    return F.when(F.char_length(flat) > most, F.concat(F.substring(flat, 1, most - 3), F.lit("..."))).otherwise(flat)


def feature_name(category: Column | str, value: Column | str) -> Column:
    return F.concat_ws("_", col(category), col(value))


def value_of(feature: Column | str, category: Column | str) -> Column:
    """The feature's name less its category's prefix."""
    f, c = col(feature), F.concat(col(category), F.lit("_"))
    return F.when(F.startswith(f, c), F.substr(f, F.char_length(c) + 1)).otherwise(f)


def category_before_first(feature: Column | str) -> Column:
    return F.split_part(col(feature), F.lit("_"), F.lit(1))


def category_before_last(feature: Column | str) -> Column:
    f = col(feature)
    return F.when(F.contains(f, F.lit("_")), F.regexp_extract(f, "^(.*)_[^_]*$", 1)).otherwise(f)


def singular_candidates(c: Column | str) -> Column:
    """The singulars that a plural may have."""
    w = col(c)
    n = F.char_length(w)

    def less(k: int, more: str = "") -> Column:
        return F.concat(F.substr(w, F.lit(1), n - k), F.lit(more))

    none = F.array().cast("array<string>")
    return (
        F.when(w.endswith("ies") & (n > 3), F.array(less(3, "y")))
        .when(w.rlike("(ch|sh|x|z)es$") & (n > 4), F.array(less(2)))
        .when(w.endswith("es") & ~w.endswith("ses") & (n > 2), F.array(less(2), less(1)))
        .when(w.endswith("s") & ~w.rlike("(ss|us)$") & (n > 1), F.array(less(1)))
        .otherwise(none)
    )


def without_thoughts(c: Column | str) -> Column:
    """A model's answer without code fences and without what stands in think tags, closed or only ended."""
    text = F.regexp_replace(col(c), r"(?is)<think>.*?</think>", "")
    text = F.regexp_replace(text, r"(?is)^.*</think>", "")
    return strip(F.regexp_replace(text, r"(?i)```(?:json)?", ""))


def numbered(texts: Column | str) -> Column:
    """A prompt: each text behind its number, from 1, with blank lines between."""
    return F.concat_ws("\n\n", F.transform(col(texts), lambda t, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), t)))


def truncated(c: Column | str, most: int = 500) -> Column:
    return F.substring(col(c), 1, most)
