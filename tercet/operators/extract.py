"""The deterministic extractor: facts and features by expressions and keywords, all in one projection.

Every rule is an argument; the defaults are those for captions of skin conditions. Rules that look for keywords
take them as parts of the text, without regard to words' borders, and say present or unknown, never absent.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AGE = r"(?iU)\b([0-9]{1,3})[ -]?(?:yr|year)s?[ -]?old\b|\baged?\s*:?\s*([0-9]{1,3})\b"
AGE_GROUPS = ((13, "child"), (18, "adolescent"), (30, "18_29"), (45, "30_44"), (60, "45_59"), (75, "60_74"))
SEX = {1: ("boy", "he", "his", "male", "man"), 0: ("female", "girl", "her", "she", "woman")}
#: Tried in this order after an explicit number. A class of one character takes either of its members: that is how these rules have always read types.
SKIN_TYPES = (
    (r"very light|fair|type [1i]\b", 1), (r"type [2i]\b|light", 2), (r"olive|type [3i]\b|medium", 3), (r"type [4iv]\b|brown", 4), (r"type [5v]\b|dark brown", 5), (r"type [6iv]\b|deeply pigmented", 6),
)
DURATIONS = (
    *((rf"\b[0-9]+\s*{unit}", f"{unit}s") for unit in ("hour", "day", "week", "month", "year")),
    ("birth|congenital|lifelong|since childhood", "lifelong"), ("chronic|long.stand", "chronic"), ("abrupt|acute|sudden", "acute"),
)
ONSET = ((r"abrupt|sudden|overnight|acute onset|appeared\s+(?:today|yesterday)", 1), (r"gradual|progressive|slowly|over (?:months|time|weeks|years)", 0))
CERTAINTY = (
    ("biopsy.proven|confirmed|histolog|laboratory|patholog", "confirmed"), ("clinically diagnosed|consistent with|impression", "clinical"),
    ("likely|possible|probable|self.assumed|self.diagnos|suspected", "suspected"), ("differential|no definitive|uncertain|unclear", "uncertain"),
)
NUMBERS = ((r"isolated|one lesion|\bsingle\b|solitary", "single"), (r"\bfew\b|many|multiple|numerous|several", "multiple"), ("diffuse|generali[sz]ed|widespread", "widespread"))


def _terms(**lines: str) -> dict[str, list[str]]:
    return {name: line.split("|") for name, line in lines.items()}


LOCATIONS = {f"location_{k}": v for k, v in _terms(
    face="cheek|chin|eyelid|face|forehead|lip|nose|perioral|periorbital", scalp="hair|hairline|scalp", head_neck="cervical|head|neck", trunk="abdomen|back|chest|flank|torso|trunk",
    torso_front="abdomen|anterior trunk|chest|torso front", torso_back="back|dorsal|posterior trunk", arm="antecubital|arm|elbow|forearm|upper arm", hand="dorsum of hand|finger|hand|knuckle|wrist",
    palm="palm|palmar", back_of_hand="back of hand|dorsum of hand", leg="calf|knee|leg|popliteal|shin|thigh", foot="ankle|feet|foot|toe", foot_top_side="dorsum of foot|top of foot", foot_sole="heel|plantar|sole",
    genitalia_groin="genital|groin|inguinal|perianal|perineal|scrotal|vulva", buttocks="buttock|gluteal", mouth="buccal|gum|mouth|mucosa|oral|tongue", nail="nail|periungual|subungual|ungual",
    axilla="armpit|axilla|axillary", widespread="all over|diffuse|generalised|generalized|whole body|widespread",
).items()}
MORPHOLOGY = _terms(
    texture_raised="boil|bump|elevated|nodule|papular|papule|plaque|raised|verruca|wart", texture_flat="flat|macular|macule|patch", texture_rough_flaky="desquam|flak|hyperkeratotic|keratotic|rough|scale|scaly",
    texture_fluid_filled="blister|bulla|fluid|oozing|pustule|vesicle|weeping", texture_ulcerated="crust|crusted|erode|erosion|excoriat|ulcer|ulcerat", texture_smooth="glossy|shiny|smooth",
    color_red="erythema|erythematous|petechiae|pink|purpura|red|violaceous", color_brown="bronze|brown|hyperpigment|pigment|tan", color_white="depigment|hypopigment|leucoder|pale|white",
    color_yellow="xanth|yellow", color_black="black|dark|melanin|melanotic", color_blue_grey="blue|gray|grey|slate", distribution_unilateral="left |one side|right |unilateral",
    distribution_bilateral="bilateral|both sides|symmetric", distribution_dermatomal="dermatomal|dermatome", distribution_grouped="cluster|grouped|herpetiform", distribution_linear="along|linear|streak",
    distribution_annular="annular|circular|ring|ring-like",
)
SYMPTOMS = {f"symptom_{k}": v for k, v in _terms(
    itching="itch|pruritic|pruritus", burning="burn|burning|stinging", pain="hurt|pain|painful|sore|tender", bleeding="bleed|haemorrhage|hemorrhage", increasing_size="enlarg|expand|growing|increas|spreading",
    darkening="darken|getting darker|pigment increas", bothersome_appearance="bothersome|cosmetic concern|disfigur|unsightly", fever="febrile|fever|pyrexia", chills="chill|rigor",
    fatigue="fatigue|lethargy|malaise|tired", joint_pain="arthralgia|arthrit|joint pain", mouth_sores="aphth|mouth sore|mucosal lesion|oral ulcer",
    shortness_of_breath="breathing difficult|dyspnea|dyspnoea|shortness of breath", nail_change="nail change|nail dystrophy|nail pitting|onychol", hair_loss="alopecia|bald|hair loss",
).items()}


def first_match(text: Column, rules: Sequence[tuple[str, object]], otherwise: object) -> Column:
    """The value of the first rule that matches, in their order."""
    out = None
    for pattern, value in rules:
        out = F.when(text.rlike(pattern), value) if out is None else out.when(text.rlike(pattern), value)
    return out.otherwise(otherwise)


def age(text: Column) -> Column:
    one, two = (F.nullif(F.regexp_extract(text, AGE, k), F.lit("")) for k in (1, 2))
    return F.coalesce(one, two).cast("int")


def age_group(years: Column, groups: Sequence[tuple[int, str]] = AGE_GROUPS, beyond: str = "75_plus") -> Column:
    out = F.when(years.isNull(), "unknown")
    for bound, name in groups:
        out = out.when(years < bound, name)
    return out.otherwise(beyond)


def sex(text: Column, words: Mapping[int, Sequence[str]] = SEX) -> Column:
    """The number that the first of the words stands for, 2 without one."""
    pattern = r"(?iU)\b(" + "|".join(sorted(w for ws in words.values() for w in ws)) + r")\b"
    word, out = F.lower(F.regexp_extract(text, pattern, 1)), None
    for k, ws in words.items():
        out = F.when(word.isin(list(ws)), k) if out is None else out.when(word.isin(list(ws)), k)
    return out.otherwise(2).cast("tinyint")


def skin_type(text: Column, rules: Sequence[tuple[str, int]] = SKIN_TYPES) -> Column:
    """The number that the text gives, or the type of the first rule that matches, or 0. text: in lower case."""
    said = F.regexp_extract(text, r"fitzpatrick\s*(?:skin|type)?\s*([0-9])", 1)
    return F.coalesce(F.nullif(said, F.lit("")).cast("int"), first_match(text, rules, 0)).cast("int")


def onset(text: Column, rules: Sequence[tuple[str, int]] = ONSET) -> Column:
    return first_match(text, rules, 2).cast("tinyint")


def keywords(text: Column, lexicon: Mapping[str, Sequence[str]]) -> dict[str, Column]:
    out = {}
    for name, terms in lexicon.items():
        hit = F.lit(False)
        for t in terms:
            hit = hit | F.contains(text, F.lit(t))
        out[name] = F.when(hit, 1).otherwise(2).cast("tinyint")
    return out


def facts(df: DataFrame, text: str, keep: Sequence[str], lexicon: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """All that the rules tell of a text; a null text tells nothing. lexicon: the places, forms and symptoms if it isn't given."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    years = age(low)
    more = keywords(low, LOCATIONS | MORPHOLOGY | SYMPTOMS if lexicon is None else lexicon)
    return df.select(
        *keep, years.alias("age_numeric"), age_group(years).alias("age_group"), sex(low).alias("sex"), skin_type(low).alias("fitzpatrick_skin_type"),
        first_match(low, DURATIONS, "unknown").alias("duration_bucket"), onset(low).alias("onset_sudden"), first_match(low, CERTAINTY, "unknown").alias("diagnosis_confidence"),
        first_match(low, NUMBERS, "unknown").alias("lesion_count"), *(c.alias(n) for n, c in more.items()),
    )


Extractor = Callable[[list[str]], list[dict[str, list[str]]]]


class Truncated(Exception):
    """An extractor raises it when its answer broke off; `said` is what it had of it."""

    def __init__(self, said: Sequence[dict[str, list[str]]] = ()) -> None:
        super().__init__("the answer broke off")
        self.said = list(said)


def extracted(texts: list[str], extractor: Extractor, retries: int = 2, depth: int = 0, deepest: int = 4) -> list[dict[str, list[str]] | None]:
    """What the extractor says of each text, or None. A call that fails or says too little is repeated, but not when it breaks off at the same length again; if it
    broke off, both halves are asked for by themselves, down to `deepest` halvings; of what was said the longest part is kept."""
    best: list[dict[str, list[str]]] = []
    short, broke = -1, False
    for _ in range(retries + 1):
        try:
            said, broke = list(extractor(texts)), False
        except Truncated as e:
            said, broke = e.said, True
        except Exception:  # of the extractor's own, whatever it is; it is told by the status
            continue
        if len(said) >= len(texts):
            return said[: len(texts)]
        best = max(best, said, key=len)
        if short == len(said):
            break
        short = len(said)
    if broke and len(texts) > 1 and depth < deepest:
        half = len(texts) // 2
        parts = [extracted(some, extractor, min(retries, 1), depth + 1, deepest) for some in (texts[:half], texts[half:])]
        return [p if p is not None else (best[i] if i < len(best) else None) for i, p in enumerate(parts[0] + parts[1])]
    return [*best, *[None] * (len(texts) - len(best))]


def with_extractor(texts: DataFrame, extractor: Extractor, size: int = 10, retries: int = 2) -> DataFrame:
    """texts: (text). (text, category, value, status) from any extractor, a model for instance: it is called in the workers, for `size` texts at a time, as
    extracted() does; texts without an answer have the status 'failed' and no values, those of which nothing is said 'empty'."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_pylist()
            rows: list[tuple] = []
            for i in range(0, len(own), size):
                for t, got in zip(own[i : i + size], extracted(own[i : i + size], extractor, retries)):
                    values = [(t, c, v, "ok") for c, vs in (got or {}).items() for v in vs]
                    rows += values or [(t, None, None, "failed" if got is None else "empty")]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], ["text", "category", "value", "status"])

    return texts.select("text").mapInArrow(run, "text string, category string, value string, status string")
