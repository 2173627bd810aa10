"""Captions and documents put together from the tables' keys, and the SQL that says what the rules must tell of them.

The parts are inputs only. What is expected is computed by the SQL from rules that are written out here once more, for another engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.extract import LOCATIONS, MORPHOLOGY, SYMPTOMS
from .fixtures import table

#: For each part (the key's factor, phrases); a caption has one phrase of each.
PARTS = (
    (1, ("A 45-year-old", "Aged 72,", "7 yrs old,", "", "Age: 15", "an 80 year old", "12 yr old", "29-year old", "age 59", "The patient,", "17years old", "130-year-old", "manage 30 items")),
    (7, ("man", "woman", "girl", "", "boy", "She says", "He has", "in her words", "with his doctor", "female", "MALE", "the human", "others", "shed skin")),
    (3, ("has a sudden rash", "gradual onset", "appeared yesterday", "acute onset", "slowly growing", "spots", "progressive", "over weeks", "overnight", "acute pain", "appeared  today", "abrupt change")),
    (11, ("for 3 days", "for 2 hours", "since birth", "6 weeks", "chronic", "10 months", "long standing", "5 years", "acute", "since childhood", "", "a few days", "two weeks", "1day")),
    (5, ("single nodule", "multiple plaques", "widespread macules", "one lesion", "several blisters", "generalised crusts", "isolated ulcer", "a few papules", "smooth patch", "singles", "diffuse scaling", "")),
    (13, ("on the left cheek", "on both sides of the trunk", "on palms and soles", "in a ring on the arm", "along the shin", "all over", "of the scalp", "on the tongue", "near the nails", "in the groin", "on the back of hand", "clustered on the foot", "behind the knee", "")),
    (17, ("itching", "burning and painful", "bleeding", "with fever and chills", "", "enlarging", "getting darker", "tired, joint pain", "hair loss", "aphthae", "dyspnoea", "nail pitting", "unsightly")),
    (19, ("red", "brown", "pale", "dark brown", "yellow", "blue", "erythematous", "black", "bronze", "grey", "", "violaceous")),
    (23, ("likely eczema", "biopsy-proven", "impression: acne", "differential wide", "self diagnosed", "consistent with tinea", "confirmed", "unclear", "possible", "", "histology pending", "uncertain")),
    (29, ("Fitzpatrick type 3", "fitzpatrick 5", "fair skin", "olive", "type v", "very light", "", "deeply pigmented", "Fitzpatrick skin 2", "type 6", "medium tone", "type II", "type 4")),
)


def _pick(key: Column, factor: int, phrases: tuple[str, ...]) -> Column:
    return F.element_at(F.array(*map(F.lit, phrases)), (F.pmod(F.floor(key * factor / 7), F.lit(len(phrases))) + 1).cast("int"))


def captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, text) for each order."""
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(key.alias("id"), F.concat_ws(" ", *(_pick(key, k, p) for k, p in PARTS)).alias("text"))


def _sql_pick(key: str, factor: int, phrases: tuple[str, ...]) -> str:
    return f"[{', '.join(repr(p) for p in phrases)}][1 + ({key} * {factor} // 7) % {len(phrases)}]"


CAPTIONS_SQL = f"c as (select o_orderkey as id, lower(concat_ws(' ', {', '.join(_sql_pick('o_orderkey', k, p) for k, p in PARTS)})) as t from orders)"


def _first(rules: list[tuple[str, str]], otherwise: str) -> str:
    return "case " + " ".join(f"when regexp_matches(t, '{p}') then {v}" for p, v in rules) + f" else {otherwise} end"


_AGE = r"\b(\d{1,3})[- ]?(?:year|yr)s?[- ]?old\b|\bage[d]?\s*:?\s*(\d{1,3})\b"
_SEX = r"\b(male|female|man|woman|boy|girl|he|she|his|her)\b"
FACTS_SQL = {
    "age": f"select id, y as age_numeric, case when y is null then 'unknown' when y < 13 then 'child' when y < 18 then 'adolescent' when y < 30 then '18_29' when y < 45 then '30_44' when y < 60 then '45_59' when y < 75 then '60_74' else '75_plus' end as age_group "
    f"from (select id, cast(coalesce(nullif(regexp_extract(t, '{_AGE}', 1), ''), nullif(regexp_extract(t, '{_AGE}', 2), '')) as int) as y from c)",
    "sex": f"select id, case when regexp_extract(t, '{_SEX}', 1) in ('male', 'man', 'boy', 'he', 'his') then 1 when regexp_extract(t, '{_SEX}', 1) = '' then 2 else 0 end::tinyint as sex from c",
    "skin_type": "select id, cast(coalesce(nullif(regexp_extract(t, 'fitzpatrick\\s*(?:type|skin)?\\s*(\\d)', 1), ''), "
    + _first([(r"fair|type [i1]\b|very light", "'1'"), (r"light|type [i2]\b", "'2'"), (r"medium|olive|type [i3]\b", "'3'"), (r"brown|type [iv4]\b", "'4'"), (r"dark brown|type [v5]\b", "'5'"), (r"deeply pigmented|type [vi6]\b", "'6'")], "'0'")
    + ") as int) as fitzpatrick_skin_type from c",
    "duration": "select id, " + _first([(rf"\b\d+\s*{u}", f"'{u}s'") for u in ("hour", "day", "week", "month", "year")] + [("since childhood|lifelong|congenital|birth", "'lifelong'"), ("chronic|long.stand", "'chronic'"), ("acute|sudden|abrupt", "'acute'")], "'unknown'") + " as duration_bucket from c",
    "onset": "select id, (" + _first([(r"sudden|abrupt|acute onset|overnight|appeared\s+(yesterday|today)", "1"), ("gradual|slowly|progressive|over (time|weeks|months|years)", "0")], "2") + ")::tinyint as onset_sudden from c",
    "count": "select id, " + _first([(r"\bsingle\b|solitary|one lesion|isolated", "'single'"), (r"\bfew\b|several|multiple|numerous|many", "'multiple'"), ("diffuse|widespread|generali[sz]ed", "'widespread'")], "'unknown'") + " as lesion_count from c",
    "confidence": "select id, " + _first([("confirmed|biopsy.proven|histolog|patholog|laboratory", "'confirmed'"), ("clinically diagnosed|consistent with|impression", "'clinical'"), ("self.assumed|self.diagnos|possible|likely|suspected|probable", "'suspected'"), ("no definitive|uncertain|unclear|differential", "'uncertain'")], "'unknown'") + " as diagnosis_confidence from c",
}
FACT_COLUMNS = {"age": ("age_numeric", "age_group"), "sex": ("sex",), "skin_type": ("fitzpatrick_skin_type",), "duration": ("duration_bucket",), "onset": ("onset_sudden",), "count": ("lesion_count",), "confidence": ("diagnosis_confidence",)}


def keyword_sql(lexicon: dict[str, list[str]]) -> str:
    """Counts of texts that have a term, by bucket of the key; one row a feature and bucket."""
    dim = ", ".join(f"('{f}', {terms!r})" for f, terms in lexicon.items())
    return f"with {CAPTIONS_SQL}, dim(feature, terms) as (values {dim}) select feature, id % 5 as bucket, count(*) filter (where len(list_filter(terms, lambda x: contains(t, x))) > 0) as n_present, count(*) as n_rows from c cross join dim group by all"


LEXICONS = {"locations": LOCATIONS, "morphology": MORPHOLOGY, "symptoms": SYMPTOMS}

#: Answers of a model: what precedes, the shape (body, items, items that say something, whether it is JSON, whether it has a list of objects), what follows.
OPENINGS = ("", "```json\n", "<think>so {</think>", "Here it is: ")
SHAPES = (
    ('{"captions":[{"a":["x"]},{"a":["y"],"b":[]}]}', 2, 2, True, True), ('[{"a":["x"]},{"b":["p","q"]}]', 2, 2, True, True), ('{"results":[{"a":["x"]},{"a":[]},{"b":["z"]}]}', 3, 2, True, True),
    ('{"outputs":[{"a":["x"]}]}', 1, 1, True, True), ('{"10":{"a":["third"]},"2":{"a":["second"]},"1":{"a":["first"]}}', 3, 3, True, True), ("no answer", 0, 0, False, False), ('{"captions":["x","y"]}', 0, 0, True, False),
    ('{"captions":[{"a":[]},{}]}', 2, 0, True, True), ('{"captions":[{"a":[]}]}', 1, 0, True, True), ('{"captions":[{"a":["x"],"n":{"k":"} {"}},{"a":["y"', 1, 1, False, True), ('{"a":["x"]}', 0, 0, True, False), ('{"items":[]}', 0, 0, True, True),
)
CLOSINGS = ("", "", " ", "\n")


def _at(items: tuple, index: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, items)), (index % len(items) + 1).cast("int"))


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, text, n_expected, finish, longest): an answer for each order. Every seventeenth is null."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    text = F.when(k % 17 != 0, F.concat(_at(OPENINGS, c), _at(tuple(s[0] for s in SHAPES), k), _at(CLOSINGS, c)))
    finish = F.when(k % len(SHAPES) == 9, "length").otherwise("stop")
    return table(spark, sf_dir, "orders").select(k.alias("id"), text.alias("text"), (c % 3 + 1).cast("int").alias("n_expected"), finish.alias("finish"), (c % 31).cast("int").alias("longest"))


def _rows(index: int) -> str:
    return "[" + ", ".join(str(s[index]).lower() for s in SHAPES) + f"][1 + o_orderkey % {len(SHAPES)}]"


#: What the shapes mean, by their place; a null text has none.
ANSWERS_SQL = f"""s as (select o_orderkey as id, o_custkey % 3 + 1 as want, o_custkey % 31 as longest, o_orderkey % {len(SHAPES)} as shape, o_orderkey % 17 = 0 as missing,
  case when o_orderkey % 17 = 0 then 0 else {_rows(1)} end as n, case when o_orderkey % 17 = 0 then 0 else {_rows(2)} end as said, o_orderkey % 17 <> 0 and {_rows(3)} as json, o_orderkey % 17 <> 0 and {_rows(4)} as list from orders),
p as (select *, case when not json and n > 0 then 'salvaged' when not json then 'unparseable' when not list then 'shape' when n > want then 'loop' when n < want then 'short' else 'ok' end as status,
  case when missing then 0 else case shape when 2 then case when want = 3 then 2 else 1 end when 4 then least(want, 3) else least(said, want) end end as k from s)"""
#: (shape, place, category, value)
VALUES_SQL = """v(shape, place, category, value) as (values (0,0,'a','x'),(0,1,'a','y'),(1,0,'a','x'),(1,1,'b','p'),(1,1,'b','q'),(2,0,'a','x'),(2,2,'b','z'),(3,0,'a','x'),(4,0,'a','first'),(4,1,'a','second'),(4,2,'a','third'),(9,0,'a','x'))"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(line): what a batch's files say, a line an order: answers with a body that is an object or a string, errors with and without a code, another status, no JSON."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    usage = F.format_string('{"usage":{"prompt_tokens":%d,"completion_tokens":%d,"prompt_tokens_details":{"cached_tokens":%d}},"choices":[{"finish_reason":"%s","message":{"content":"%s"}}]}', c, k % 50, c % 10, F.when(k % 3 == 0, "length").otherwise("stop"), F.col("o_orderpriority"))
    quoted = F.to_json(F.struct(usage.alias("x")))
    quoted = F.substring(quoted, 6, 100_000)
    kind = c % 7
    line = (
        F.when(kind == 0, F.format_string('{"custom_id":"r%d","error":null,"response":{"status_code":200,"body":%s}}', k, usage))
        .when(kind == 1, F.concat(F.format_string('{"custom_id":"r%d","error":null,"response":{"status_code":200,"body":', k), F.substr(quoted, F.lit(1), F.char_length(quoted) - 1), F.lit("}}")))
        .when(kind == 2, F.format_string('{"custom_id":"r%d","error":{"code":"rate_limit"},"response":null}', k))
        .when(kind == 3, F.format_string('{"custom_id":"r%d","error":null,"response":{"status_code":500,"body":"{}"}}', k))
        .when(kind == 4, F.lit("not json"))
        .when(kind == 5, F.format_string('{"custom_id":"r%d","error":{"message":"x"}}', k))
        .otherwise(F.format_string('{"custom_id":"r%d","error":null,"response":{"status_code":200,"body":{"usage":{"prompt_tokens":%d,"completion_tokens":0},"choices":[{"finish_reason":"stop","message":{"content":""}}]}}}', k, c))
    )
    return table(spark, sf_dir, "orders").select(line.alias("line"))


LINES_SQL = """b as (select 'r' || o_orderkey as custom_id, case when o_custkey % 7 = 6 then '' else o_orderpriority end as content, case when o_custkey % 7 <> 6 and o_orderkey % 3 = 0 then 'length' else 'stop' end as finish_reason,
  o_custkey::bigint as prompt_tokens, case when o_custkey % 7 = 6 then 0 else o_orderkey % 50 end::bigint as completion_tokens, case when o_custkey % 7 = 6 then 0 else o_custkey % 10 end::bigint as cached_tokens from orders where o_custkey % 7 in (0, 1, 6))"""

#: Diagnoses by place: (condition, confidence, severity, features).
DIAGNOSES = (("a", 80, "mild", 3), ("b", 99, "moderate", 3), ("a", 60, "severe", 4), ("c", 50, "bad", 3), ("d", 95, "mild", 2), ("e", 49, "severe", 0), ("f", 70, "moderate", 3))


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, report): a report for each order, of 0 to 4 diagnoses that follow each other from a place on; some aren't JSON."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    each = [f'{{"condition":"{n}","icdCode":"L30.9","confidence":{p},"severity":"{s}","distinguishingFeatures":[' + ",".join(f'"f{i}"' for i in range(m)) + "]}" for n, p, s, m in DIAGNOSES]
    picked = F.transform(F.filter(F.sequence(F.lit(0), F.lit(3)), lambda i: i < c % 5), lambda i: F.element_at(F.array(*map(F.lit, each)), ((k + i) % len(each) + 1).cast("int")))
    report = F.concat(F.lit('{"reportId":"DIAG-1","diagnoses":['), F.concat_ws(",", picked), F.lit('],"summary":{"riskLevel":"Low"}}'))
    return table(spark, sf_dir, "orders").select(k.alias("id"), F.when(k % 13 == 0, "not a report").when(k % 13 != 1, report).alias("report"))


REPORTS_SQL = f"""dx(i, name, conf, sev, n) as (values {", ".join(f"({i}, '{n}', {p}, '{s}', {m})" for i, (n, p, s, m) in enumerate(DIAGNOSES))}),
o as (select o_orderkey as id, o_custkey % 5 as size, o_orderkey % 13 in (0, 1) as bad from orders),
x as (select id, size, bad, name, conf, sev, n from o left join (select unnest([0, 1, 2, 3]) as step) st on step < size and not bad left join dx on i = (id + step) % {len(DIAGNOSES)} and step is not null)
select id, concat_ws(',', case when any_value(bad) or any_value(size) = 0 then 'unreadable' end, case when count(name) > 3 then 'too_many' end, case when bool_or(conf not between 50 and 95) then 'confidence' end,
  case when bool_or(sev not in ('mild', 'moderate', 'severe')) then 'severity' end, case when bool_or(n < 3) then 'few_features' end, case when count(distinct name) < count(name) then 'repeated' end) as faults from x group by id"""

RAW = (
    ("severity", ("Mild", "very  severe", "awful", "none", "MODERATE")), ("demographics_skin_type", ("FST1", "fair", "fst 9", "Olive")), ("duration", ("days", "Weeks", "some time", "chronic")), ("colour", ("Red", "other", "N_A", "not mentioned", "blue grey", "NaN", "various")),
    ("demographics_age", ("0-5", "80-plus", "81", "10-20")),
)
ENDINGS = ("", "s", "es", "ies", "ches", "xes", "ss", "us", "ses")


def raw_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(category, value, position) of parts: the category and the value by the key."""
    k = F.col("p_partkey")
    value = F.when(F.lit(False), "")
    for i, (_, own) in enumerate(RAW):
        value = value.when(k % len(RAW) == i, F.element_at(F.array(*map(F.lit, own)), (F.floor(k / len(RAW)) % len(own) + 1).cast("int")))
    return table(spark, sf_dir, "part").select(_at(tuple(c for c, _ in RAW), k).alias("category"), value.alias("value"), k.alias("position"))


RAW_SQL = f"""r(c, i, m, category, value) as (values {", ".join(f"({c}, {i}, {len(own)}, '{name}', '{v}')" for c, (name, own) in enumerate(RAW) for i, v in enumerate(own))}),
n as (select category, regexp_replace(regexp_replace(lower(value), '\\s+', '_', 'g'), '_+', '_', 'g') as value, min(p_partkey) as position from part join r on p_partkey % {len(RAW)} = c and (p_partkey // {len(RAW)}) % m = i group by all)
select category, value, position from n where case category when 'severity' then value in ('mild', 'moderate', 'severe', 'very_severe') when 'duration' then value in ('hours', 'days', 'weeks', 'months', 'years', 'chronic')
  when 'demographics_age' then value in ('0-5', '5-10', '10-20', '20-30', '30-40', '40-50', '50-60', '60-70', '70-80', '80-plus')
  when 'demographics_skin_type' then case when (select count(*) from n where value in ('fst1', 'fst2', 'fst3', 'fst4', 'fst5', 'fst6') and category = 'demographics_skin_type') > 0 then value similar to 'fst[1-6]' else value in ('fair', 'light', 'medium', 'olive', 'brown', 'dark', 'deeply_pigmented') end
  else value not in ('', 'unknown', 'other', 'various', 'miscellaneous', 'not_specified', 'not_mentioned', 'none', 'none_mentioned', 'no_history', 'no_treatment', 'n_a', 'na', 'null', 'nan') end"""

SAID = (("lex_a", "the"), ("lex_a", "ing"), ("lex_b", "nothing"), ("lex_a", "lex_a_she"), ("other", "x"), ("lex_d", " Hand "), ("lex_d", "hand"), ("lex_e", None), (None, None), ("lex_c", "QUE"), ("lex_c", "los angeles"))
#: The feature that each of SAID means, or none; and whether it is one that can't be placed.
MEANT = ("lex_a_the", "lex_a_ing", None, "lex_a_she", None, "lex_d_hand", "lex_d_hand", None, None, "lex_c_que", None)


def said_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, category, value): two or three values for each customer."""
    k = F.col("c_custkey")
    pick = lambda part, i: F.element_at(F.array(*(F.lit(x[part]).cast("string") for x in SAID)), (i % len(SAID) + 1).cast("int"))
    steps = F.explode(F.when(k % 2 == 0, F.array(k, k * 3 + 1)).otherwise(F.array(k, k * 5 + 2, k + 7))).alias("i")
    return table(spark, sf_dir, "customer").select(k.alias("id"), steps).select("id", pick(0, F.col("i")).alias("category"), pick(1, F.col("i")).alias("value"))
