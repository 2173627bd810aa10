"""Names of a questionnaire's columns, the canonical names that they stand for, and the categories and values of these.

The tables are put together from what the names have in common; they are small and static.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import vocabulary

_SKIN_SYMPTOMS = "bleeding bothersome_appearance burning darkening increasing_size itching pain"
_BODY_SYMPTOMS = "chills fatigue fever joint_pain mouth_sores shortness_of_breath"
_TEXTURES = {"flat": "flat", "fluid_filled": "fluid_filled", "raised": "raised_or_bumpy", "rough_flaky": "rough_or_flaky"}
_PLACES = {"arm": "arm", "back_of_hand": "back_of_hand", "buttocks": "buttocks", "foot_sole": "foot_sole", "foot_top_side": "foot_top_or_side", "genitalia_groin": "genitalia_or_groin", "head_neck": "head_or_neck", "leg": "leg", "palm": "palm", "torso_back": "torso_back", "torso_front": "torso_front"}
_RACES = {
    "american_indian_alaska_native": "american_indian_or_alaska_native", "asian": "asian", "black_african_american": "black_or_african_american", "hispanic_latino": "hispanic_latino_or_spanish_origin",
    "middle_eastern_north_african": "middle_eastern_or_north_african", "native_hawaiian_pacific_islander": "native_hawaiian_or_pacific_islander", "other": "other_race", "prefer_not_to_answer": "prefer_not_to_answer",
    "two_or_more": "two_or_more_after_mitigation", "white": "white",
}

#: Questionnaire column to canonical name.
CANONICAL: dict[str, str] = (
    {"age_group": "age_group", "condition_duration": "duration", "fitzpatrick_skin_type": "fitzpatrick_skin_type", "related_category": "related_category", "sex_at_birth": "sex"}
    | {f"race_ethnicity_{column}": f"race_{name}" for name, column in _RACES.items()}
    | {f"textures_{column}": f"texture_{name}" for name, column in _TEXTURES.items()}
    | {f"body_parts_{column}": f"location_{name}" for name, column in (_PLACES | {"other": "other"}).items()}
    | {f"condition_symptoms_{name}": f"symptom_{name}" for name in [*_SKIN_SYMPTOMS.split(), "no_relevant_experience"]}
    | {f"other_symptoms_{name}": f"symptom_{name}" for name in [*_BODY_SYMPTOMS.split(), "no_relevant_symptoms"]}
)

#: Canonical name to category and value. A column with several values of its own has none here: its values have, one by one.
VALUES: dict[str, tuple[str, str]] = (
    {f"age_group_{a}_to_{b}": ("demographics_age", v) for a, b, v in ((18, 29, "20-30"), *((k, k + 9, f"{k}-{k + 10}") for k in range(30, 80, 10)), (80, 89, "80_plus"))}
    | {f"sex_{x}": ("demographics_sex", x) for x in ("female", "male", "other")}
    | {f"fitzpatrick_skin_type_FST{k}": ("demographics_skin_type", f"fst{k}") for k in range(1, 7)}
    | {f"race_{x}": ("demographics_ethnicity", {"other": "other_race", "two_or_more": "two_or_more_races"}.get(x, x)) for x in _RACES}
    | {f"texture_{x}": ("morphology_texture", x) for x in _TEXTURES}
    | {f"location_{x}": ("body_location", {"other": "other_location"}.get(x, x)) for x in [*_PLACES, "other"]}
    | {f"symptom_{x}": ("symptoms_dermatological", x) for x in [*_SKIN_SYMPTOMS.split(), "no_relevant_experience"]}
    | {f"symptom_{x}": ("symptoms_systemic", x) for x in [*_BODY_SYMPTOMS.split(), "no_relevant_symptoms"]}
    | {f"duration_{x}": ("duration", v) for x, v in (("1-3_months", "months"), ("1-4_weeks", "weeks"), ("1_day", "days"), ("3-12_months", "months"), ("less_than_1_week", "days"), ("over_1_year", "1_year"), ("over_5_years", "years"), ("since_childhood", "since_childhood"))}
    | {f"related_category_{x}": ("other", "normal" if x == "normal" else f"{x}_related".replace("pigment_birthmark", "pigment_birthmark")) for x in ("acne", "growth_or_mole", "hair_issue", "hair_loss", "nail_issue", "normal", "pigment_birthmark", "rash")}
)

#: Questionnaire column to the feature that it is compared with.
COMPARED: dict[str, str] = (
    {f"textures_{column}": f"morphology_texture_{name}" for name, column in _TEXTURES.items()}
    | {f"condition_symptoms_{x}": f"symptoms_dermatological_{x}" for x in _SKIN_SYMPTOMS.split()}
    | {f"other_symptoms_{x}": f"symptoms_systemic_{x}" for x in _BODY_SYMPTOMS.split()}
    | {f"body_parts_{column}": f"body_location_{name}" for name, column in _PLACES.items()}
)


def resolved(spark: SparkSession, columns: Mapping[str, str] = CANONICAL, values: Mapping[str, tuple[str, str]] = VALUES) -> DataFrame:
    """(column, canonical, category, value) of the columns whose canonical name has a category and a value."""
    names = spark.createDataFrame(list(columns.items()), "column string, canonical string")
    known = spark.createDataFrame([(k, *v) for k, v in values.items()], "canonical string, category string, value string")
    return names.join(F.broadcast(known), "canonical").select("column", "canonical", "category", "value")


def verified(vocab: DataFrame, wanted: Sequence[tuple[str, str]] | None = None) -> DataFrame:
    """(category, value, added, comparable): the vocabulary with the questionnaire's values put back where consolidation lost them, and which ones are those."""
    pairs = sorted(set(wanted if wanted is not None else (VALUES[c] for c in CANONICAL.values() if c in VALUES)))
    own = vocab.sparkSession.createDataFrame(pairs, "category string, value string").withColumn("comparable", F.lit(True))
    whole = vocabulary.with_values(vocab, pairs).join(F.broadcast(own), ["category", "value"], "left")
    return whole.select("category", "value", "added", F.coalesce("comparable", F.lit(False)).alias("comparable"))
