"""Every query by name, with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import captions, decisions, extract, requests, responses, signatures, statistics, tristate, vocabulary
from . import cases, fixtures
from .fixtures import CATEGORIES, FEATURES, LEXICON, MAPPING, ORDER_FEATURES, table
from .oracles import ORACLES

FLAGSHIP = "coverage"
_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CONFUSED = [("en", "de"), ("de", "en"), ("fr", "es"), ("es", "fr"), ("en", "xx")]
BY = "lang"


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    _QUERIES[f.__name__] = f
    return f


def values(spark: SparkSession, schema: str, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def confused(spark: SparkSession) -> DataFrame:
    return values(spark, "true_label string, confused_with string", CONFUSED)


@query
def coverage(spark, d):
    return statistics.coverage(fixtures.documents(spark, d), FEATURES)


@query
def coverage_wide_vs_long(spark, d):
    return statistics.coverage_of_long(tristate.to_long(fixtures.documents(spark, d), FEATURES))


@query
def coverage_of_order_lines(spark, d):
    return statistics.coverage(fixtures.lines(spark, d), ORDER_FEATURES)


@query
def informed_gap(spark, d):
    return statistics.gap(fixtures.documents(spark, d), fixtures.questionnaire(spark, d), MAPPING)


@query
def coverage_report(spark, d):
    return statistics.coverage_report(statistics.coverage(fixtures.documents(spark, d), FEATURES), MAPPING, CATEGORIES)


@query
def mutual_information(spark, d):
    return statistics.mutual_information(fixtures.documents(spark, d), FEATURES, BY)


@query
def chi_square_cramers_v(spark, d):
    return statistics.chi_square(fixtures.documents(spark, d), FEATURES, BY)


@query
def chi_square_p_values(spark, d):
    return statistics.with_p_value(statistics.chi_square(fixtures.documents(spark, d), FEATURES, BY))


@query
def classwise_odds(spark, d):
    return statistics.classwise_odds(fixtures.documents(spark, d), FEATURES, BY, top=8)


@query
def odds_of_order_lines(spark, d):
    return statistics.classwise_odds(fixtures.lines(spark, d), ORDER_FEATURES, "priority")


@query
def questionnaire(spark, d):
    odds = statistics.classwise_odds(fixtures.documents(spark, d), FEATURES, BY)
    clusters = signatures.clusters_of(confused(spark), {"all": ["en", "de", "fr", "es"], "en": ["fr"]})
    return statistics.questionnaire(odds, clusters, {"lex_a_the": "Is the article there?"}, top=5)


@query
def importance_context(spark, d):
    wide = fixtures.documents(spark, d)
    gaps = statistics.gap(wide, fixtures.questionnaire(spark, d), MAPPING)
    return statistics.importance_in_context(statistics.importance(wide, FEATURES, BY), gaps, list(MAPPING))


@query
def phi_matrix(spark, d):
    return statistics.phi_matrix(fixtures.documents(spark, d), FEATURES, BY, top=6)


@query
def strongest_correlations(spark, d):
    return statistics.strongest(statistics.phi_matrix(fixtures.documents(spark, d), FEATURES, BY), top=5)


@query
def redundant_pairs(spark, d):
    return statistics.redundant_pairs(fixtures.documents(spark, d), FEATURES, threshold=0.2)


@query
def redundant_order_lines(spark, d):
    return statistics.redundant_pairs(fixtures.lines(spark, d), ORDER_FEATURES, threshold=0.3)


def _singles(spark, d, part=False):
    wide = fixtures.documents(spark, d)
    wide = fixtures.subset(wide) if part else wide
    return wide, signatures.singles(wide, FEATURES, BY)


@query
def signature_singles(spark, d):
    return _singles(spark, d)[1].drop("feature_idx", "n")


@query
def signature_pairs(spark, d):
    wide, own = _singles(spark, d)
    return signatures.pairs(wide, FEATURES, BY, own).drop("i", "j")


@query
def signature_triplets(spark, d):
    wide, own = _singles(spark, d)
    return signatures.triplets(wide, FEATURES, BY, own)


def _completeness(spark, d):
    wide, own = _singles(spark, d)
    part = fixtures.subset(wide)
    theirs = statistics.counts(part, FEATURES, BY).select("label", "feature", F.try_divide((F.col("n1") + F.col("n0")) * 1.0, F.col("n")).alias("pct_informed"), F.try_divide(F.col("n1") * 1.0, F.col("n")).alias("pct_present"))
    pairs = statistics._named(statistics.pair_counts(part, FEATURES, BY), FEATURES)
    pairs = pairs.select("label", "feature_1", "feature_2", statistics.phi(*(F.col(c) for c in ("n", "n11", "n1x", "nx1"))).alias("their_phi"))
    own_pairs = signatures.pairs(wide, FEATURES, BY, own)
    return own, own_pairs, signatures.completeness(own, own_pairs, theirs, pairs)


@query
def completeness(spark, d):
    return _completeness(spark, d)[2]


@query
def signature_summary(spark, d):
    return signatures.summary(*_completeness(spark, d))


@query
def confusion_singles(spark, d):
    return signatures.confusion_singles(_singles(spark, d)[1], confused(spark))


@query
def confusion_pairs(spark, d):
    wide, own = _singles(spark, d)
    return signatures.confusion_pairs(signatures.pairs(wide, FEATURES, BY, own), confused(spark))


@query
def weighted_gap(spark, d):
    wide, own = _singles(spark, d)
    return signatures.weighted(signatures.confusion_singles(own, confused(spark)), statistics.mutual_information(wide, FEATURES, BY))


@query
def jaccard_labels(spark, d):
    return signatures.label_similarity(_singles(spark, d)[1], top=6)


@query
def cross_dataset_overlap(spark, d):
    return signatures.cross_dataset(_singles(spark, d)[1], _singles(spark, d, True)[1], top=5)


@query
def upgma_clusters(spark, d):
    return signatures.label_clusters(signatures.label_similarity(_singles(spark, d)[1], top=6), cut=0.7)


@query
def blend_scores(spark, d):
    ev = table(spark, d, "events")
    side = lambda k: ev.where(F.col("user_id") % 3 != k).groupBy(F.col("user_id").alias("case_id"), F.col("event_type").alias("condition")).agg(F.bround(F.avg("value"), 4).alias("score"))
    mixed = ev.where(F.col("user_id") % 3 == 2).groupBy(F.col("user_id").alias("case_id"), F.col("event_type").alias("condition")).agg(F.bround(F.max("value"), 4).alias("score"))
    return decisions.blended(side(0), mixed.union(side(2)))


@query
def dedup_captions(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", "source", "text")
    return captions.first_of_each(docs, "text", "doc_id", BY).select("doc_id", "lang", "source")


@query
def dedup_stats(spark, d):
    return captions.dedup_stats(table(spark, d, "documents"), "text")


@query
def replicate_vectors(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", "text")
    unique = captions.first_of_each(docs.where("lang <> 'es'"), "text", "doc_id")
    known = tristate.keyword_matrix(unique, "text", LEXICON, ["text"])
    return captions.replicate(docs, "text", known, FEATURES, ["doc_id"])


def _progress(spark, d):
    texts = table(spark, d, "documents").select(F.md5("text").alias("text"), "lang").distinct()
    done = texts.where("lang in ('en', 'de')").select("text").distinct()
    failed = texts.where("lang = 'de'").select("text").distinct()
    return texts.select("text").distinct(), done, failed


@query
def resume_remaining(spark, d):
    texts, done, failed = _progress(spark, d)
    return captions.remaining(texts, done, failed)


@query
def failed_requeue(spark, d):
    texts, done, failed = _progress(spark, d)
    return captions.remaining(texts, done, failed).join(failed, "text", "left_semi").agg(F.count("*").alias("n_requeued"))


@query
def stratified_sample(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", "source")
    return captions.stratified_sample(docs, "lang", "source", "doc_id", tiers=((500, 100), (100, 60), (20, 20)))


@query
def sample_tiers(spark, d):
    return captions.tiers_of(table(spark, d, "documents"), "lang", (500, 120, 20))


@query
def batch_assignment(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang")
    return captions.batches(docs, "lang", "doc_id", 15)


@query
def request_prompts(spark, d):
    said = table(spark, d, "conversations").where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "role", "text")
    rows = requests.request_rows(captions.batches(said, "role", "id", 6), "role", "id", "text")
    return requests.request_lines(rows, "role", "small", 512).select("custom_id", F.get_json_object("line", "$.body.messages[0].content").alias("prompt"), F.get_json_object("line", "$.body.max_tokens").cast("long").alias("max_tokens"))


@query
def chunk_plan(spark, d):
    docs = table(spark, d, "documents").select("source", "doc_id", F.octet_length("text").cast("long").alias("bytes"), requests.tokens(F.char_length("text"), F.lit(200)).alias("tokens"))
    return requests.chunks(docs, "source", "doc_id", most_jobs=20, most_bytes=10_000_000, most_tokens=20_000)


@query
def cost_estimate(spark, d):
    docs = table(spark, d, "documents").groupBy("lang").agg(F.sum(requests.tokens(F.char_length("text"), F.lit(0))).alias("input_tokens"), (F.count("*") * 90).alias("output_tokens"))
    model = F.when(F.col("lang") == "en", "small").when(F.col("lang") == "de", "large").otherwise("nano")
    return requests.cost(docs.select(model.alias("model"), "lang", "input_tokens", "output_tokens"))


@query
def output_budget(spark, d):
    n = table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n_texts"))
    return n.select(
        "source", "n_texts", requests.output_budget(F.col("n_texts"), True).alias("strict"), requests.output_budget(F.col("n_texts"), False).alias("loose"),
        requests.chunk_tokens(F.col("n_texts") * 40_000, F.lit(2)).alias("chunk_tokens"), requests.safe_batch(F.lit(16384), F.col("n_texts")).alias("safe_batch"),
    )


def _raw_words(spark, d):
    words = table(spark, d, "part").select(F.col("p_brand").alias("category"), F.explode(F.split("p_name", " ")).alias("value"), F.col("p_partkey").alias("position"))
    more = table(spark, d, "part").select(F.col("p_brand").alias("category"), F.concat(F.split_part("p_name", F.lit(" "), F.lit(1)), F.lit("s")).alias("value"), F.col("p_partkey").alias("position")).where("position % 3 = 0")
    return words.union(more).union(words.where("position % 5 = 0").select(F.upper("category"), F.concat(F.lit("  "), F.upper("value"), F.lit("  Type ")), "position"))


@query
def normalize_vocab(spark, d):
    return vocabulary.merged(_raw_words(spark, d))


@query
def plural_collapse(spark, d):
    return vocabulary.without_plurals(vocabulary.merged(_raw_words(spark, d)))


@query
def plural_candidates(spark, d):
    names = table(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("w"), "p_partkey")
    words = names.select(F.concat("w", F.element_at(F.array(*map(F.lit, cases.ENDINGS)), (F.col("p_partkey") % len(cases.ENDINGS) + 1).cast("int"))).alias("word")).distinct()
    return words.select("word", F.concat_ws("|", X.singular_candidates("word")).alias("singulars"))


@query
def enum_filter(spark, d):
    raw = vocabulary.merged(table(spark, d, "part").select(F.lit("type").alias("category"), F.col("p_type").alias("value"), F.col("p_partkey").alias("position")).union(table(spark, d, "orders").select(F.lit("status"), F.when(F.col("o_orderstatus") == "P", "None").otherwise(F.col("o_orderpriority")), "o_orderkey")))
    return vocabulary.allowed(raw, {"type": ["economy", "promo"]})


@query
def enforced_enums(spark, d):
    """The enumerations, scales and noise as they are by default, over values put together from keys."""
    return vocabulary.enforced(vocabulary.merged(cases.raw_values(spark, d)))


@query
def vocab_union(spark, d):
    return vocabulary.with_values(vocabulary.merged(_raw_words(spark, d)), [("brand#11", "extra"), ("brand#99", "new"), ("brand#99", "new")])


@query
def schema_document(spark, d):
    vocab = table(spark, d, "part").select(F.lower("p_brand").alias("category"), F.lower("p_type").alias("value"))
    return vocabulary.schema_document(vocab, ["brand#11_economy"])


@query
def safe_names(spark, d):
    urls = table(spark, d, "pages").select("page_id", "url")
    return urls.select("page_id", X.safe_name("url").alias("file_name"), X.short_label("url", 20).alias("label"))


def _facts(*columns: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: extract.facts(cases.captions(spark, d), "text", ["id"], {}).select("id", *columns)


for _name, _columns in cases.FACT_COLUMNS.items():
    _QUERIES[f"regex_{_name}"] = _facts(*_columns)


def _keywords(lexicon: dict[str, list[str]]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark, d):
        wide = extract.facts(cases.captions(spark, d), "text", ["id"], lexicon).withColumn("bucket", F.col("id") % 5)
        sums = wide.groupBy("bucket").agg(F.count("*").alias("n_rows"), *(F.count_if(F.col(f) == 1).alias(f) for f in lexicon))
        return sums.unpivot(["bucket", "n_rows"], list(lexicon), "feature", "n_present").select("feature", "bucket", "n_present", "n_rows")

    return run


for _name, _lexicon in cases.LEXICONS.items():
    _QUERIES[f"keyword_{_name}"] = _keywords(_lexicon)


@query
def extracted_facts(spark, d):
    """What the rules tell of whole documents."""
    facts = extract.facts(table(spark, d, "documents").withColumn("text", F.regexp_replace("text", r"[^\x00-\x7f]", "_")), "text", ["doc_id"], {})
    return facts.drop("doc_id").groupBy(facts.columns[1:]).agg(F.count("*").alias("n_documents"))


@query
def keyword_lane(spark, d):
    facts = extract.facts(table(spark, d, "documents"), "text", ["doc_id"], {f"{c}_{v}": t for c, vs in LEXICON.items() for v, t in vs.items()})
    return facts.select("doc_id", *FEATURES)


@query
def encoded_answers(spark, d):
    return tristate.encode(cases.said_values(spark, d), LEXICON, "id")


@query
def all_unknown_audit(spark, d):
    docs = table(spark, d, "documents")
    return tristate.all_unknown(tristate.keyword_matrix(docs, "text", {c: LEXICON[c] for c in ("lex_c", "lex_e")}, ["text"]), [f for f in FEATURES if CATEGORIES[f] in ("lex_c", "lex_e")], "text", least=300)


def _answers(spark, d):
    return responses.parsed(cases.answers(spark, d))


@query
def llm_parse_status(spark, d):
    return _answers(spark, d).select("id", "status", "n_items", "n_nontrivial")


@query
def retry_action(spark, d):
    return _answers(spark, d).select("id", responses.retry_action(F.col("status"), F.col("finish"), F.col("n_nontrivial"), F.col("longest")).alias("action"))


@query
def answered_values(spark, d):
    return responses.category_values(_answers(spark, d), "id")


@query
def batch_answers(spark, d):
    return requests.answers(cases.lines(spark, d))


@query
def batch_output_usage(spark, d):
    return requests.usage_totals(batch_answers(spark, d))


@query
def unanswered_requests(spark, d):
    return requests.unanswered(table(spark, d, "orders").select(F.concat(F.lit("r"), "o_orderkey").alias("custom_id")), batch_answers(spark, d))


@query
def error_histogram(spark, d):
    return requests.errors(cases.lines(spark, d))


@query
def label_distribution(spark, d):
    return statistics.label_distribution(table(spark, d, "documents"), BY)


@query
def prevalence_pivot(spark, d):
    return statistics.prevalence(fixtures.documents(spark, d), FEATURES, "source", labels=10, most=6)


@query
def eda_stats(spark, d):
    return statistics.eda(fixtures.documents(spark, d), FEATURES, BY)


@query
def category_mean(spark, d):
    return statistics.category_mean(statistics.coverage(fixtures.documents(spark, d), FEATURES), {f: c for f, c in CATEGORIES.items() if c != "lex_e"})


@query
def informativeness_histogram(spark, d):
    return statistics.histogram(statistics.coverage(fixtures.documents(spark, d), FEATURES), "informativeness", 8)


@query
def caption_lengths(spark, d):
    return captions.length_histogram(table(spark, d, "documents"), "text")


@query
def gate_matrix(spark, d):
    orders = table(spark, d, "orders")
    image = F.when(F.col("o_orderstatus") == "O", "NORMAL").when(F.col("o_orderstatus") == "F", "ABNORMAL").otherwise("BORDERLINE")
    symptoms = F.when(F.col("o_totalprice") > 300_000, "CONCERNING").when(F.col("o_totalprice") > 100_000, "MILD").otherwise("NORMAL")
    return decisions.gated(orders.select(image.alias("image"), symptoms.alias("symptoms"))).groupBy("image", "symptoms", "gate_case", "proceeds", "action").agg(F.count("*").alias("n_cases"))


@query
def report_validate(spark, d):
    return cases.reports(spark, d).select("id", F.concat_ws(",", decisions.report_faults(F.col("report"))).alias("faults"))


@query
def merged_questionnaire(spark, d):
    q = fixtures.questionnaire(spark, d)
    a, b = tristate.yes_no(q, "quality"), tristate.yes_no(q, "toxic")
    return q.select("doc_id", a.alias("quality"), b.alias("toxic"), tristate.either(a, b).alias("either"))


@query
def dry_run_calls(spark, d):
    return captions.calls(table(spark, d, "documents"), "source", "text", 10, ["src0", "src3"])


@query
def full_mode_rows(spark, d):
    rows = captions.sampled(table(spark, d, "documents").select("doc_id", "lang", "source"), "full", "lang", "source", "doc_id")
    return rows.groupBy("lang").agg(F.count("*").alias("n_rows"), F.ceil(F.count("*") / 25).alias("n_batches"))


@query
def counted_prompts(spark, d):
    said = table(spark, d, "conversations").where("text is not null").select("conv_id", "turn", "text")
    texts = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda r: r["text"])
    return said.groupBy("conv_id").agg(texts.alias("texts")).select("conv_id", F.md5(requests.counted("texts")).alias("digest"))


@query
def tagged_prompts(spark, d):
    said = table(spark, d, "conversations").where("text is not null").select("conv_id", "turn", "text", F.when(F.col("turn") % 2 == 0, F.array(F.lit("t"), F.col("role"))).otherwise(F.array().cast("array<string>")).alias("tags"))
    own = said.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text", "tags"))).alias("x"))
    return own.select("conv_id", F.md5(requests.tagged(F.col("x.text"), F.col("x.tags"))).alias("digest"))


@query
def flattened_conversations(spark, d):
    return requests.flattened(table(spark, d, "conversations"), "conv_id", "turn").select("conv_id", F.md5("prompt").alias("digest"))


@query
def repaired_answers(spark, d):
    rows = _answers(spark, d)
    fixed = responses.repaired(F.col("items"), F.col("n_expected"), F.lit("{}"))
    return rows.select("id", F.size(fixed).alias("n_repaired"), F.size(F.filter(fixed, lambda x: x == "{}")).alias("n_empty"))


@query
def coerced_states(spark, d):
    said = F.when(F.col("o_custkey") % 5 == 0, F.lit("x")).when(F.col("o_custkey") % 5 == 1, F.lit("1.0")).when(F.col("o_custkey") % 5 == 2, F.lit("0")).when(F.col("o_custkey") % 5 == 3, F.lit(" 1 "))
    return tristate.coerced(table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), said.alias("f")), ["f"])


@query
def feature_lanes(spark, d):
    parts = table(spark, d, "part").groupBy(F.col("p_type").alias("name")).agg((F.min("p_size") < 3).alias("small"), (F.max("p_size") > 48).alias("large"))
    return tristate.lanes(parts.select("name", F.when(F.col("large"), F.col("small")).alias("by_rule"))).select("name", "lane")


@query
def truncated_captions(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(X.truncated("text", 500)).alias("digest"), F.char_length(X.truncated("text", 500)).alias("n_chars"))


@query
def features_without_counterpart(spark, d):
    return statistics.without_counterpart(statistics.coverage(fixtures.documents(spark, d), FEATURES), MAPPING)


@query
def coverage_extremes(spark, d):
    return statistics.extremes(statistics.coverage(fixtures.documents(spark, d), FEATURES), "informativeness", "feature", 5)


@query
def first_features(spark, d):
    return statistics.coverage(fixtures.documents(spark, d), FEATURES[:10]).select("feature", "n_present", "n_absent", "n_unknown")


@query
def merged_records(spark, d):
    parts = table(spark, d, "part").select(F.col("p_brand").alias("category"), F.split_part("p_name", F.lit(" "), F.lit(1)).alias("value"), F.col("p_type").alias("examples"), F.col("p_name").alias("contexts"), F.concat(F.lit("size_"), F.col("p_size") % 3).alias("labels"))
    return vocabulary.merged_records(parts, ["category", "value"], {"examples": 10, "contexts": 5, "labels": None})


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in ORACLES.items() if k in _QUERIES}
