"""Decision tables and scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: (image, symptoms, case, whether a differential follows, action); what isn't here is undefined.
GATE = (
    ("NORMAL", "NORMAL", "A", False, "reassure"), ("NORMAL", "MILD", "B", False, "gp_if_persistent"), ("NORMAL", "CONCERNING", "C", False, "gp_referral"), ("BORDERLINE", "NORMAL", "D", False, "monitor"),
    ("BORDERLINE", "MILD", "E", True, "low_confidence_differential"), ("BORDERLINE", "CONCERNING", "F", True, "moderate_differential"), ("ABNORMAL", "NORMAL", "G", True, "differential_asymptomatic"),
    ("ABNORMAL", "CONCERNING", "H", True, "full_differential"),
)


def gated(cases: DataFrame, gate: Sequence[tuple] = GATE) -> DataFrame:
    """cases: (.., image, symptoms). With the gate's case, whether it goes on to a differential, and its action; null where it has none."""
    table = cases.sparkSession.createDataFrame(list(gate), "image string, symptoms string, gate_case string, proceeds boolean, action string")
    return cases.join(F.broadcast(table), ["image", "symptoms"], "left")


def blended(visual: DataFrame, said: DataFrame, weight: float = 0.7) -> DataFrame:
    """visual, said: (case_id, condition, score). (case_id, condition, blended): the weighted sum of both, a missing one being 0, as a share of the case's; null if the case has nothing."""
    both = visual.withColumnRenamed("score", "v").join(said.withColumnRenamed("score", "s"), ["case_id", "condition"], "full_outer")
    mixed = both.withColumn("m", weight * F.coalesce("v", F.lit(0.0)) + (1 - weight) * F.coalesce("s", F.lit(0.0)))
    return mixed.select("case_id", "condition", F.bround(F.try_divide("m", F.sum("m").over(Window.partitionBy("case_id"))), 3).alias("blended"))


REPORT = "struct<diagnoses:array<struct<condition:string,confidence:int,severity:string,distinguishingFeatures:array<string>>>>"


def report_faults(report: Column) -> Column:
    """What is wrong with a report in JSON, by name; an empty list if nothing is."""
    d = F.from_json(report, REPORT)["diagnoses"]
    tests = {
        "unreadable": d.isNull() | (F.size(d) == 0),
        "too_many": F.size(d) > 3,
        "confidence": F.exists(d, lambda x: ~F.coalesce(x["confidence"].between(50, 95), F.lit(False))),
        "severity": F.exists(d, lambda x: ~F.coalesce(x["severity"].isin("mild", "moderate", "severe"), F.lit(False))),
        "few_features": F.exists(d, lambda x: F.coalesce(F.size(x["distinguishingFeatures"]), F.lit(0)) < 3),
        "repeated": F.size(F.array_distinct(F.transform(d, lambda x: x["condition"]))) < F.size(d),
    }
    return F.array_compact(F.array(*(F.when(F.coalesce(t, F.lit(False)), F.lit(name)) for name, t in tests.items())))
