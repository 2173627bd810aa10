"""Signatures of labels: their frequent features, pairs and triples; and what follows from comparing them."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .statistics import counts, pair_counts, phi


def least_support(n: Column) -> Column:
    return F.when(n <= 0, 0.15).otherwise(F.greatest(F.lit(0.05), F.least(F.lit(0.15), 30.0 / n)))


def least_pair_support(n: Column) -> Column:
    return F.when(n <= 0, 0.10).otherwise(F.greatest(F.lit(0.05), F.least(F.lit(0.10), 20.0 / n)))


def singles(wide: DataFrame, features: Sequence[str], by: str, least: int = 20) -> DataFrame:
    """(label, rank, feature_idx, feature, support, n_present, n_informed, pct_of_informed, n): the features that enough of the label's rows have, by rounded support and the
    features' order; labels of fewer than `least` rows have none."""
    n, n1, informed = F.col("n"), F.col("n1"), F.col("n1") + F.col("n0")
    frequent = counts(wide, features, by).where((n >= least) & (n1 / n >= least_support(n)))
    out = frequent.select(
        "label", "feature_idx", "feature", F.bround(n1 / n, 3).alias("support"), n1.alias("n_present"), informed.alias("n_informed"),
        F.bround(F.coalesce(F.try_divide(n1 * 1.0, informed), F.lit(0.0)), 3).alias("pct_of_informed"), "n",
    )
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("label").orderBy(F.desc("support"), "feature_idx")))


def pairs(wide: DataFrame, features: Sequence[str], by: str, own: DataFrame, among: int = 15, top: int = 30) -> DataFrame:
    """(label, rank, feature_1, feature_2, joint_support, n_both, phi_coefficient): of the label's first `among` singles; the lesser feature in the features' order comes first."""
    chosen = own.where(F.col("rank") <= among)
    a = chosen.select("label", "n", F.col("feature_idx").alias("i"), F.col("feature").alias("feature_1"))
    b = chosen.select("label", F.col("feature_idx").alias("j"), F.col("feature").alias("feature_2"))
    found = pair_counts(wide, features, by).withColumnRenamed("n", "both_informed").join(a, ["label", "i"]).join(b, ["label", "j"])
    share = F.col("n11") / F.col("n")
    p = phi(F.col("both_informed"), F.col("n11"), F.col("n1x"), F.col("nx1"))
    out = found.where(share >= least_pair_support(F.col("n"))).select("label", "i", "j", "feature_1", "feature_2", F.bround(share, 3).alias("joint_support"), F.col("n11").alias("n_both"), F.bround(p, 4).alias("phi_coefficient"))
    rank = F.row_number().over(Window.partitionBy("label").orderBy(F.desc("joint_support"), "i", "j"))
    return out.withColumn("rank", rank).where(F.col("rank") <= top)


def triplets(wide: DataFrame, features: Sequence[str], by: str, own: DataFrame, among: int = 10, top: int = 20) -> DataFrame:
    """(label, rank, features, joint_support, n_all). A row gives the triples of its present features among the label's first `among`: 120 at most."""
    chosen = own.where(F.col("rank") <= among).groupBy("label").agg(F.array_sort(F.collect_list("feature_idx")).alias("wanted"), F.first("n").alias("n"))
    present = F.array_compact(F.array(*(F.when(F.col(f) == 1, F.lit(i)) for i, f in enumerate(features))))
    rows = wide.where(F.col(by).isNotNull()).select(F.col(by).cast("string").alias("label"), present.alias("present")).join(F.broadcast(chosen), "label")
    rows = rows.select("label", "n", F.array_intersect("wanted", "present").alias("x")).where(F.size("x") > 2).groupBy("label", "n", "x").agg(F.count("*").alias("c"))
    three = F.flatten(F.flatten(F.transform("x", lambda a: F.transform(F.filter("x", lambda b: b > a), lambda b: F.transform(F.filter("x", lambda c: c > b), lambda c: F.array(a, b, c))))))
    found = rows.select("label", "n", "c", F.explode(three).alias("t")).groupBy("label", "n", "t").agg(F.sum("c").alias("n_all"))
    share = F.col("n_all") / F.col("n")
    names = F.array(*map(F.lit, features))
    out = found.where(share >= least_pair_support(F.col("n"))).select("label", "t", F.concat_ws(" + ", F.transform("t", lambda k: names[k])).alias("features"), F.bround(share, 3).alias("joint_support"), "n_all")
    rank = F.row_number().over(Window.partitionBy("label").orderBy(F.desc("joint_support"), "t"))
    return out.withColumn("rank", rank).where(F.col("rank") <= top).drop("t")


def completeness(own: DataFrame, own_pairs: DataFrame, theirs: DataFrame, their_pairs: DataFrame) -> DataFrame:
    """How much of each label's signature another table can show. theirs: (label, feature, pct_informed, pct_present); their_pairs: (label, feature_1, feature_2, their_phi).

    A single is covered if 5 % of the other table's rows are informed; a pair is intact if its coefficient is positive and at least half is left there."""
    single = own.join(theirs, ["label", "feature"], "left").groupBy("label").agg(F.count("*").alias("n_signature_features"), F.count_if(F.coalesce("pct_informed", F.lit(0.0)) >= 0.05).alias("n_covered"))
    kept = (F.col("phi_coefficient") > 0) & (F.coalesce("their_phi", F.lit(0.0)) >= 0.5 * F.col("phi_coefficient"))
    pair = own_pairs.join(their_pairs, ["label", "feature_1", "feature_2"], "left").groupBy("label").agg(F.count("*").alias("n_signature_pairs"), F.count_if(kept).alias("n_pairs_intact"))
    both = single.join(pair, "label", "left").fillna(0, ["n_signature_pairs", "n_pairs_intact"])
    c = F.coalesce(F.try_divide(F.col("n_covered") * 1.0, F.col("n_signature_features")), F.lit(0.0))
    i = F.coalesce(F.try_divide(F.col("n_pairs_intact") * 1.0, F.col("n_signature_pairs")), F.lit(0.0))
    return both.select("*", F.bround(c, 3).alias("single_coverage"), F.bround(i, 3).alias("pair_integrity"), F.bround((c + i) / 2, 3).alias("reproducibility"))


def confusion_singles(own: DataFrame, confused: DataFrame, least: float = 0.10, top: int = 10) -> DataFrame:
    """confused: (true_label, confused_with), both with signatures. The features that the one has more often by `least`, and how many there are before the cut."""
    labels = own.select("label").distinct()
    both = confused.join(F.broadcast(labels.withColumnRenamed("label", "true_label")), "true_label").join(F.broadcast(labels.withColumnRenamed("label", "confused_with")), "confused_with")
    a = own.select(F.col("label").alias("true_label"), "feature_idx", "feature", F.col("support").alias("support_in_a"))
    b = own.select(F.col("label").alias("confused_with"), "feature", F.col("support").alias("b"))
    met = both.join(a, "true_label").join(b, ["confused_with", "feature"], "left").withColumn("support_in_b", F.coalesce("b", F.lit(0.0)))
    lift = F.col("support_in_a") - F.col("support_in_b")
    found = met.where(F.bround(lift, 6) >= least).withColumn("discriminating_lift", F.bround(lift, 3))
    w = Window.partitionBy("true_label", "confused_with")
    ranked = found.withColumns({"rank": F.row_number().over(w.orderBy(F.desc("discriminating_lift"), "feature_idx")), "n_discriminators": F.count("*").over(w)})
    return ranked.where(F.col("rank") <= top).select("true_label", "confused_with", "rank", "feature", "support_in_a", "support_in_b", "discriminating_lift", "n_discriminators")


def confusion_pairs(own: DataFrame, confused: DataFrame, top: int = 10) -> DataFrame:
    """The first `top` pairs of the one that aren't among the other's."""
    labels = own.select("label").distinct()
    both = confused.join(F.broadcast(labels.withColumnRenamed("label", "true_label")), "true_label").join(F.broadcast(labels.withColumnRenamed("label", "confused_with")), "confused_with")
    a = own.withColumnRenamed("label", "true_label")
    b = own.select(F.col("label").alias("confused_with"), "feature_1", "feature_2")
    only = both.join(a, "true_label").join(b, ["confused_with", "feature_1", "feature_2"], "left_anti")
    place = F.row_number().over(Window.partitionBy("true_label", "confused_with").orderBy("rank"))
    return only.withColumn("place", place).where(F.col("place") <= top).select("true_label", "confused_with", "place", "feature_1", "feature_2", "joint_support", "phi_coefficient")


def weighted(confusions: DataFrame, information: DataFrame) -> DataFrame:
    """Confusion singles with their lift weighted by the features' mutual information with the label, ranked anew."""
    mi = F.coalesce("mutual_information", F.lit(0.0))
    out = confusions.join(F.broadcast(information.select("feature", "mutual_information")), "feature", "left").withColumns({"global_mi": F.bround(mi, 5), "weighted_lift": F.bround(F.col("discriminating_lift") * (1 + 10 * mi), 4)})
    w = Window.partitionBy("true_label", "confused_with").orderBy(F.desc("weighted_lift"), "rank")
    return out.withColumn("new_rank", F.row_number().over(w)).select("true_label", "confused_with", F.col("new_rank").alias("rank"), "feature", "discriminating_lift", "global_mi", "weighted_lift")


def label_similarity(own: DataFrame, top: int = 20) -> DataFrame:
    """(label_a, label_b, jaccard) for each two labels a < b, of the sets of their first `top` singles. Only labels that share a feature meet in the join; the rest are 0."""
    chosen = own.where(F.col("rank") <= top).select("label", "feature")
    sizes = chosen.groupBy("label").agg(F.count("*").alias("k"))
    a, b = chosen.toDF("label_a", "feature"), chosen.toDF("label_b", "feature")
    shared = a.join(b, "feature").where("label_a < label_b").groupBy("label_a", "label_b").agg(F.count("*").alias("o"))
    every = sizes.toDF("label_a", "ka").crossJoin(F.broadcast(sizes.toDF("label_b", "kb"))).where("label_a < label_b")  # a row a label on either side
    met = every.join(shared, ["label_a", "label_b"], "left").fillna(0, ["o"])
    return met.select("label_a", "label_b", F.bround(F.coalesce(F.try_divide(F.col("o") * 1.0, F.col("ka") + F.col("kb") - F.col("o")), F.lit(0.0)), 4).alias("jaccard"))


def cross_dataset(own: DataFrame, theirs: DataFrame, top: int = 20) -> DataFrame:
    """(label, own_top, their_top, overlap, jaccard, own_only, their_only) for labels with singles in both tables; the differences' first five names in order."""

    def sets(df: DataFrame, name: str) -> DataFrame:
        return df.where(F.col("rank") <= top).groupBy("label").agg(F.array_sort(F.collect_set("feature")).alias(name))

    a, b = F.col("a"), F.col("b")
    first = lambda x: F.concat_ws(", ", F.slice(F.array_sort(x), 1, 5))
    overlap = F.size(F.array_intersect(a, b))
    return sets(own, "a").join(sets(theirs, "b"), "label").select(
        "label", F.size(a).cast("long").alias("own_top"), F.size(b).cast("long").alias("their_top"), overlap.cast("long").alias("overlap"), F.bround(overlap * 1.0 / F.size(F.array_union(a, b)), 3).alias("jaccard"),
        first(F.array_except(a, b)).alias("own_only"), first(F.array_except(b, a)).alias("their_only"),
    )


def upgma(distance: np.ndarray, cut: float) -> list[list[int]]:
    """Groups by average linkage, merged while the least distance is at most `cut`."""
    groups = [[i] for i in range(len(distance))]
    d = distance.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    alive = list(range(len(groups)))
    while len(alive) > 1:
        sub = d[np.ix_(alive, alive)]
        at = int(np.argmin(sub))
        x, y = sorted((alive[at // len(alive)], alive[at % len(alive)]))
        if sub.ravel()[at] > cut + 1e-12:
            break
        a, b = len(groups[x]), len(groups[y])
        d[x] = d[:, x] = (a * d[x] + b * d[y]) / (a + b)
        d[x, x] = np.inf
        groups[x] += groups[y]
        alive.remove(y)
    return [sorted(groups[i]) for i in alive]


def label_clusters(similar: DataFrame, cut: float = 0.7, least: int = 2) -> DataFrame:
    """(cluster, label) by average linkage of 1 - jaccard. The linkage runs in one task over a row for each two labels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in zip(*(c.to_pylist() for c in b.columns))]
        names = sorted({x for a, b, _ in rows for x in (a, b)})
        at = {x: i for i, x in enumerate(names)}
        d = np.ones((len(names), len(names)))
        for a, b, j in rows:
            d[at[a], at[b]] = d[at[b], at[a]] = 1 - j
        found = sorted(g for g in upgma(d, cut) if len(g) >= least)
        out = [(k + 1, names[i]) for k, g in enumerate(found) for i in g]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.int32()), pa.array([x for _, x in out], pa.string())], ["cluster", "label"])

    return similar.select("label_a", "label_b", "jaccard").coalesce(1).mapInArrow(run, "cluster int, label string")


def summary(own: DataFrame, own_pairs: DataFrame, complete: DataFrame) -> DataFrame:
    """A row a label: its size, first feature and scores."""
    top = own.groupBy("label").agg(F.first("n").alias("n_cases"), F.count("*").alias("n_signature_features"), F.min_by("feature", "rank").alias("top_feature"), F.max("support").alias("top_feature_support"))
    n = own_pairs.groupBy("label").agg(F.count("*").alias("n_pairs"))
    return top.join(n, "label", "left").fillna(0, ["n_pairs"]).join(complete.select("label", "reproducibility", "single_coverage", "pair_integrity"), "label", "left")


def clusters_of(confused: DataFrame, fixed: Mapping[str, Sequence[str]]) -> DataFrame:
    """(cluster, label): the fixed clusters, and for each label that is confused with others a cluster of them all, which replaces a fixed one of its name."""
    spark = confused.sparkSession
    given = spark.createDataFrame([(c, x) for c, xs in fixed.items() for x in xs] or [(None, None)], "cluster string, label string").where("cluster is not null")
    name = F.substring(F.regexp_replace("true_label", r"[/ ]", "_"), 1, 40).alias("cluster")
    own = confused.select(name, F.explode(F.array("true_label", "confused_with")).alias("label")).distinct()
    return given.join(own, "cluster", "left_anti").unionByName(own)
