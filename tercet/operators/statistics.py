"""Statistics of three-valued features, each from one pass of counts over the table."""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tristate import available


def counts(wide: DataFrame, features: Sequence[str], by: str | None = None) -> DataFrame:
    """(by, feature_idx, feature, n, n1, n0): rows, present ones and absent ones. Sums over the wide row are combined before the shuffle; nothing is exploded but the result."""
    sums = [x for i, f in enumerate(features) for x in (F.count_if(F.col(f) == 1).alias(f"p{i}"), F.count_if(F.col(f) == 0).alias(f"a{i}"))]
    grouped = (wide.where(F.col(by).isNotNull()).groupBy(F.col(by).alias("label")) if by else wide.groupBy()).agg(F.count("*").alias("n"), *sums)
    rows = F.array(*(F.struct(F.lit(i).alias("feature_idx"), F.lit(f).alias("feature"), F.col(f"p{i}").alias("n1"), F.col(f"a{i}").alias("n0")) for i, f in enumerate(features)))
    return grouped.select(*(["label"] if by else []), "n", F.inline(rows))


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    return F.bround(F.coalesce(F.try_divide(part * 100.0, whole), F.lit(0.0)), digits)


def coverage(wide: DataFrame, features: Sequence[str]) -> DataFrame:
    """A row a feature: how many rows say present, absent, unknown; the percentages; the informed percentage."""
    n, n1, n0 = F.col("n"), F.col("n1"), F.col("n0")
    return counts(wide, features).select(
        "feature", n1.alias("n_present"), n0.alias("n_absent"), (n - n1 - n0).alias("n_unknown"),
        percent(n1, n).alias("pct_present"), percent(n0, n).alias("pct_absent"), percent(n - n1 - n0, n).alias("pct_unknown"), percent(n1 + n0, n).alias("informativeness"),
    )


def coverage_of_long(long: DataFrame) -> DataFrame:
    """The same of the long form (feature, value)."""
    n, n1, n0 = F.count("*"), F.count_if(F.col("value") == 1), F.count_if(F.col("value") == 0)
    return long.groupBy("feature").agg(n1.alias("n_present"), n0.alias("n_absent"), (n - n1 - n0).alias("n_unknown"), percent(n1 + n0, n).alias("informativeness"))


def gap(wide: DataFrame, comparison: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Of each mapped feature and column that both tables have: the informed percentage here, the available one there, and the difference of the two."""
    pairs = [(f, c) for f, c in mapping.items() if f in wide.columns and c in comparison.columns]
    out_schema = "feature string, comparison_column string, primary_pct_informed double, comparison_pct_available double, gap double"
    if not pairs:
        return wide.sparkSession.createDataFrame([], out_schema)
    here = counts(wide, [f for f, _ in pairs]).select("feature", F.try_divide((F.col("n1") + F.col("n0")) * 100.0, F.col("n")).alias("here"))
    there = comparison.agg(F.count("*").alias("n"), *(F.count_if(available(comparison, c)).alias(f"c{i}") for i, (_, c) in enumerate(pairs)))
    there = there.select(F.inline(F.array(*(F.struct(F.lit(f).alias("feature"), F.lit(c).alias("comparison_column"), F.try_divide(F.col(f"c{i}") * 100.0, F.col("n")).alias("there")) for i, (f, c) in enumerate(pairs)))))
    return here.join(there, "feature").select("feature", "comparison_column", F.bround("here", 2).alias("primary_pct_informed"), F.bround("there", 2).alias("comparison_pct_available"), F.bround(F.col("here") - F.col("there"), 2).alias("gap"))


def _cells(wide: DataFrame, features: Sequence[str], by: str) -> DataFrame:
    """(feature, label, v, nxy, nx, ny, total) of informed rows, cells of absent and of present ones."""
    c = counts(wide, features, by)
    cells = c.select("feature", "label", F.inline(F.array(F.struct(F.lit(0).alias("v"), F.col("n0").alias("nxy")), F.struct(F.lit(1).alias("v"), F.col("n1").alias("nxy")))))
    w = Window.partitionBy("feature")
    return cells.withColumns({"nx": F.sum("nxy").over(Window.partitionBy("feature", "v")), "ny": F.sum("nxy").over(Window.partitionBy("feature", "label")), "total": F.sum("nxy").over(w)})


def mutual_information(wide: DataFrame, features: Sequence[str], by: str, least: int = 100) -> DataFrame:
    """(feature, mutual_information, n_informed): of the state and the label, in nats, over informed rows; 0 below `least` of them."""
    nxy, nx, ny, n = (F.col(c) for c in ("nxy", "nx", "ny", "total"))
    term = F.when(nxy > 0, nxy / n * F.ln(n * 1.0 * nxy / (nx * 1.0 * ny))).otherwise(0.0)
    mi = _cells(wide, features, by).groupBy("feature").agg(F.sum(term).alias("mi"), F.max("total").alias("n_informed"))
    return mi.select("feature", F.when(F.col("n_informed") < least, 0.0).otherwise(F.bround(F.greatest(F.col("mi"), F.lit(0.0)), 5)).alias("mutual_information"), "n_informed")


def _upper_gamma(a: float, x: float) -> float:
    """The regularised upper incomplete gamma function."""
    if x <= 0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > 1e-17 * abs(total):
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1 - total * front)
    b = x + 1 - a
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return front * h


@F.pandas_udf(T.DoubleType())
def chi2_survival(x: pd.Series, dof: pd.Series) -> pd.Series:
    """P of a chi-square as great or greater; 1 without degrees of freedom."""
    return pd.Series([1.0 if not k or k <= 0 or v is None else _upper_gamma(k / 2, v / 2) for v, k in zip(x, dof)])


def chi_square(wide: DataFrame, features: Sequence[str], by: str, least: int = 100) -> DataFrame:
    """(feature, chi2_statistic, dof, cramers_v, n_informed) of the state against the label. Rows and columns of zeros are dropped; with one degree of freedom the
    difference is lessened by up to a half; a table of one row or column, or of fewer than `least` informed rows, has 0."""
    cells = _cells(wide, features, by).where("nx > 0 and ny > 0")
    shape = cells.groupBy("feature").agg(F.countDistinct("v").alias("r"), F.countDistinct("label").alias("k"), F.max("total").alias("n_informed"))
    full = cells.join(shape, "feature")
    expected = F.col("nx") * 1.0 * F.col("ny") / F.col("total")
    off = F.abs(F.col("nxy") - expected)
    off = F.when((F.col("r") - 1) * (F.col("k") - 1) == 1, off - F.least(off, F.lit(0.5))).otherwise(off)
    chi = full.groupBy("feature").agg(F.sum(off * off / expected).alias("chi"), F.first("r").alias("r"), F.first("k").alias("k"), F.first("n_informed").alias("n_informed"))
    sound = (F.col("r") > 1) & (F.col("k") > 1) & (F.col("n_informed") >= least)
    v = F.least(F.lit(1.0), F.sqrt(F.col("chi") / (F.col("n_informed") * (F.least("r", "k") - 1))))
    names = wide.sparkSession.createDataFrame([(f,) for f in features], "feature string")
    return F.broadcast(names).join(chi, "feature", "left").select(
        "feature", F.coalesce(F.when(sound, F.bround("chi", 4)), F.lit(0.0)).alias("chi2_statistic"), F.coalesce(F.when(sound, (F.col("r") - 1) * (F.col("k") - 1)), F.lit(0)).cast("long").alias("dof"),
        F.coalesce(F.when(sound, F.bround(v, 5)), F.lit(0.0)).alias("cramers_v"), F.coalesce("n_informed", F.lit(0)).cast("long").alias("n_informed"),
    )


def with_p_value(chi: DataFrame) -> DataFrame:
    return chi.withColumn("chi2_pvalue", chi2_survival(F.col("chi2_statistic"), F.col("dof").cast("double")))


EPSILON = 1e-6


def classwise_odds(wide: DataFrame, features: Sequence[str], by: str, top: int = 20) -> DataFrame:
    """For each label its `top` features by odds ratio, against all other labels' rows: those come of totals, without a second scan. Ties go by the features' order."""
    c = counts(wide, features, by)
    w = Window.partitionBy("feature")
    rest_n, rest_1 = F.sum("n").over(w) - F.col("n"), F.sum("n1").over(w) - F.col("n1")
    inside, outside = F.try_divide(F.col("n1"), F.col("n")), F.coalesce(F.try_divide(rest_1, rest_n), F.lit(0.0))
    e = F.lit(EPSILON)
    both = c.select("label", "feature_idx", "feature", inside.alias("i"), outside.alias("o"))
    odds = ((F.col("i") + e) / (1 - F.col("i") + e)) / ((F.col("o") + e) / (1 - F.col("o") + e))
    out = both.select(
        "label", "feature_idx", "feature", F.bround(F.col("i") * 100, 2).alias("in_class_pct"), F.bround(F.col("o") * 100, 2).alias("out_class_pct"),
        F.bround(odds, 3).alias("odds_ratio"), F.bround(F.log2(F.greatest(odds, F.lit(1e-9))), 4).alias("log2_odds_ratio"),
    )
    rank = F.row_number().over(Window.partitionBy("label").orderBy(F.desc("odds_ratio"), "feature_idx"))
    return out.withColumn("rank", rank).where(F.col("rank") <= top).drop("feature_idx")


def questionnaire(odds: DataFrame, clusters: DataFrame, questions: Mapping[str, str], top: int = 10) -> DataFrame:
    """clusters: (cluster, label). For each cluster the `top` features by mean odds ratio over the members whose list has the feature, with a question."""
    known = odds.sparkSession.createDataFrame(list(questions.items()) or [(None, None)], "feature string, known string")
    # Odds have three digits: as whole thousandths their mean doesn't hang on the order of summation.
    thousandths = F.sum(F.round(F.col("odds_ratio") * 1000).cast("decimal(38,0)"))
    mean = odds.join(F.broadcast(clusters), "label").groupBy("cluster", "feature").agg((thousandths / F.count("*")).alias("mean"))
    mean = mean.select("cluster", "feature", (F.bround("mean", 0).cast("double") / 1000).alias("discriminatory_score"))
    rank = F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("discriminatory_score"), "feature"))
    best = mean.withColumn("rank", rank).where(F.col("rank") <= top).join(F.broadcast(known), "feature", "left")
    template = F.concat(F.lit("Does the patient show signs of "), F.regexp_replace("feature", "_", " "), F.lit("?"))
    return best.select("cluster", "rank", "feature", "discriminatory_score", F.coalesce("known", template).alias("question"))


def importance(wide: DataFrame, features: Sequence[str], by: str) -> DataFrame:
    return mutual_information(wide, features, by).join(chi_square(wide, features, by).drop("n_informed", "dof"), "feature")


def importance_in_context(important: DataFrame, gaps: DataFrame, compared: Sequence[str]) -> DataFrame:
    """Importance with the gap where there is one, and whether the feature is among those compared."""
    return important.join(F.broadcast(gaps.drop("comparison_column")), "feature", "left").withColumn("is_compared", F.col("feature").isin(list(compared)))


def pair_counts(wide: DataFrame, features: Sequence[str], by: str | None = None) -> DataFrame:
    """(label, i, j, n, n11, n1x, nx1) for features i < j over the rows where both are informed: n rows, both present, the first present, the second.

    A batch's counts are products of its 0/1 matrices; a task sends one row a label and pair."""
    m, label = len(features), [F.col(by).cast("string").alias("label")] if by else [F.lit("").alias("label")]
    i, j = np.triu_indices(m, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            codes = batch.column(0).dictionary_encode()
            x = np.stack([batch.column(1 + k).fill_null(2).to_numpy(zero_copy_only=False) for k in range(m)], 1)
            own = codes.indices.to_numpy(zero_copy_only=False)
            for c, name in enumerate(codes.dictionary.to_pylist()):
                rows = x[own == c]
                one, informed = (rows == 1).astype(np.float64), (rows != 2).astype(np.float64)
                found = np.stack([informed.T @ informed, one.T @ one, one.T @ informed, informed.T @ one])[:, i, j]
                sums[name] = sums.get(name, 0) + found
        for name, s in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(i), pa.string()), pa.array(i, pa.int32()), pa.array(j, pa.int32()), *(pa.array(s[k].astype(np.int64)) for k in range(4))], ["label", "i", "j", "n", "n11", "n1x", "nx1"])

    source = wide.where(F.col(by).isNotNull()) if by else wide
    partial = source.select(*label, *(F.col(f).cast("tinyint") for f in features)).mapInArrow(run, "label string, i int, j int, n long, n11 long, n1x long, nx1 long")
    return partial.groupBy("label", "i", "j").agg(*(F.sum(c).alias(c) for c in ("n", "n11", "n1x", "nx1")))


def phi(n: Column, n11: Column, n1x: Column, nx1: Column, least: int = 10) -> Column:
    """The correlation of two 0/1 variables; 0 where one of them is constant, or of fewer than `least` rows."""
    root = F.sqrt(n1x * 1.0 * (n - n1x) * nx1 * (n - nx1))
    return F.when(n < least, 0.0).otherwise(F.coalesce(F.try_divide(n * 1.0 * n11 - n1x * 1.0 * nx1, root), F.lit(0.0)))


def _named(pairs: DataFrame, features: Sequence[str]) -> DataFrame:
    names = F.array(*map(F.lit, features))
    return pairs.withColumns({"feature_1": names[F.col("i")], "feature_2": names[F.col("j")]})


def phi_matrix(wide: DataFrame, features: Sequence[str], by: str, top: int = 60) -> DataFrame:
    """(label, feature_1, feature_2, phi_coefficient) over each label's `top` features by the share of rows that have them, both ways and with the diagonal."""
    rank = F.row_number().over(Window.partitionBy("label").orderBy(F.desc(F.col("n1") / F.col("n")), "feature_idx"))
    chosen = counts(wide, features, by).withColumn("rank", rank).where(F.col("rank") <= top).select("label", F.col("feature_idx").alias("x"), "feature")
    p = F.bround(phi(*(F.col(c) for c in ("n", "n11", "n1x", "nx1"))), 4)
    pairs = _named(pair_counts(wide, features, by), features).withColumn("phi_coefficient", p)
    own = pairs.join(chosen.select("label", F.col("x").alias("i")), ["label", "i"]).join(chosen.select("label", F.col("x").alias("j")), ["label", "j"])
    one = own.select("label", "feature_1", "feature_2", "phi_coefficient")
    return one.union(one.select("label", "feature_2", "feature_1", "phi_coefficient")).union(chosen.select("label", "feature", "feature", F.lit(1.0)))


def strongest(matrix: DataFrame, top: int = 20) -> DataFrame:
    """(label, feature, strongest): each label's features by their strongest coefficient that isn't exactly one."""
    size = F.abs("phi_coefficient")
    most = matrix.groupBy("label", F.col("feature_1").alias("feature")).agg(F.max(F.when(size == 1, 0.0).otherwise(size)).alias("strongest"))
    return most.withColumn("rank", F.row_number().over(Window.partitionBy("label").orderBy(F.desc("strongest"), "feature"))).where(F.col("rank") <= top)


def redundant_pairs(wide: DataFrame, features: Sequence[str], threshold: float = 0.8, least: int = 50) -> DataFrame:
    """Pairs over the whole table whose coefficient is of size `threshold` or more."""
    p = phi(*(F.col(c) for c in ("n", "n11", "n1x", "nx1")), least=least)
    found = _named(pair_counts(wide, features), features).withColumn("p", p).where(F.abs("p") >= threshold)
    return found.select("feature_1", "feature_2", F.bround("p", 4).alias("phi_coefficient"), F.col("n").alias("n_informed"))


def label_distribution(df: DataFrame, by: str) -> DataFrame:
    n = F.count("*")
    return df.where(F.col(by).isNotNull()).groupBy(F.col(by).alias("label")).agg(n.alias("n_rows")).withColumn("percentage", F.bround(F.col("n_rows") * 100.0 / F.sum("n_rows").over(Window.partitionBy()), 2))


def prevalence(wide: DataFrame, features: Sequence[str], by: str, labels: int = 10, most: int = 50) -> DataFrame:
    """(label, one column a feature): the percentage of rows that have it, for the most frequent labels; a row a label, so no pivot of rows is needed."""
    shares = [F.bround(F.avg((F.col(f) == 1).cast("int")) * 100, 2).alias(f) for f in features[:most]]
    table = wide.where(F.col(by).isNotNull()).groupBy(F.col(by).alias("label")).agg(F.count("*").alias("n_rows"), *shares)
    return table.orderBy(F.desc("n_rows"), "label").limit(labels)


def eda(wide: DataFrame, features: Sequence[str], by: str) -> DataFrame:
    """One row about the table."""
    whole = wide.agg(F.count("*").alias("total_records"), F.countDistinct(by).alias("total_labels"))
    info = coverage(wide, features).agg(
        F.count("*").alias("total_features"), F.bround(F.avg("informativeness"), 2).alias("mean_informativeness"), F.bround(F.median("informativeness"), 2).alias("median_informativeness"),
        F.count_if(F.col("informativeness") > 50).alias("n_over_50"), F.count_if(F.col("informativeness") < 10).alias("n_under_10"),
    )
    return whole.crossJoin(info)


def category_mean(covered: DataFrame, categories: Mapping[str, str]) -> DataFrame:
    own = covered.sparkSession.createDataFrame(list(categories.items()), "feature string, known string")
    category = F.coalesce("known", F.split_part("feature", F.lit("_"), F.lit(1)))
    return covered.join(F.broadcast(own), "feature", "left").groupBy(category.alias("category")).agg(F.bround(F.avg("informativeness"), 2).alias("mean_informativeness"), F.count("*").alias("n_features"))


def histogram(covered: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """(bin, n): equal bins from the least to the greatest value, the last of them closed."""
    ends = covered.agg(F.min(column).alias("least"), F.max(column).alias("most"))
    at = F.when(F.col("most") == F.col("least"), bins // 2).otherwise(F.least(F.lit(bins - 1), F.floor((F.col(column) - F.col("least")) / ((F.col("most") - F.col("least")) / bins))))
    return covered.crossJoin(F.broadcast(ends)).groupBy(at.cast("int").alias("bin")).agg(F.count("*").alias("n_features"))


def coverage_report(covered: DataFrame, mapping: Mapping[str, str], categories: Mapping[str, str]) -> DataFrame:
    """Coverage with each feature's category and its column in the comparison, if any."""
    spark = covered.sparkSession
    columns = spark.createDataFrame(list(mapping.items()) or [(None, None)], "feature string, comparison_column string")
    own = spark.createDataFrame(list(categories.items()), "feature string, category string")
    joined = covered.join(F.broadcast(own), "feature", "left").join(F.broadcast(columns), "feature", "left")
    return joined.select("feature", F.coalesce("category", F.split_part("feature", F.lit("_"), F.lit(1))).alias("category"), F.col("comparison_column").isNotNull().alias("has_equivalent"), F.coalesce("comparison_column", F.lit("")).alias("comparison_column"), "informativeness", "pct_present")


def extremes(rows: DataFrame, measure: str, key: str, k: int = 20) -> DataFrame:
    """(side, rank, key, measure): the k greatest and the k least; ties go by the key."""
    pick = lambda side, *order: rows.orderBy(*order, key).limit(k).select(F.lit(side).alias("side"), key, measure).withColumn("rank", F.row_number().over(Window.partitionBy("side").orderBy(*order, key)))
    return pick("top", F.desc(measure)).unionByName(pick("bottom", F.asc(measure)))


def without_counterpart(rows: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Rows of features that the other data set doesn't have. mapping: feature to column."""
    return rows.where(~F.col("feature").isin(list(mapping)))


def telling_but_uncompared(context: DataFrame, least: float = 0.01, k: int = 10) -> DataFrame:
    """Of features that aren't compared, with mutual information above `least`, those of least p-value."""
    return context.where((F.col("mutual_information") > least) & ~F.col("is_compared")).orderBy("chi2_pvalue", "feature").limit(k)


def report(context: DataFrame, label: str, k: int = 15) -> str:
    """A short summary in Markdown: the features of most mutual information, and those that tell much but have no counterpart."""

    def block(df: DataFrame, columns: Sequence[str]) -> list[str]:
        rows = [tuple("" if v is None else f"{v:.4g}" if isinstance(v, float) else str(v) for v in r) for r in df.select(*columns).collect()]
        return ["| " + " | ".join(r) + " |" for r in [tuple(columns), tuple("---" for _ in columns), *rows]] if rows else ["None."]

    top = context.orderBy(F.desc("mutual_information"), "feature").limit(k)
    lines = ["# What tells labels apart", "", f"Label: `{label}`", "", f"## The {k} features of most mutual information", "", *block(top, ("feature", "mutual_information", "cramers_v", "is_compared"))]
    rest = block(telling_but_uncompared(context), ("feature", "mutual_information", "cramers_v", "chi2_pvalue"))
    return "\n".join([*lines, "", "## Telling features without a counterpart", "", *rest, ""])
