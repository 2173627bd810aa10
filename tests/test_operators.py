import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tercet.functions import text as X
from tercet.operators import captions, extract, mapping, requests, responses, signatures, statistics, tristate, vocabulary
from tercet.sources import files
from tercet.streaming import incremental

LEXICON = {"a": {"x": ["x"], "y": ["y"]}, "b": {"z": ["z"]}}


def first(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(column).first()[0]


@pytest.mark.parametrize(("raw", "want"), [("  Red  Spots ", "red_spots"), ("a__b\tc", "a_b_c"), (" x ", "x"), ("_lead_", "lead"), ("", "")])
def test_normalised(spark, raw, want):
    assert first(spark, X.normalised("c"), raw) == want


def test_names(spark):
    assert first(spark, X.category_before_first("c"), "a_b_c") == "a" and first(spark, X.category_before_last("c"), "a_b_c") == "a_b"
    assert first(spark, X.value_of("c", F.lit("a_b")), "a_b_c") == "c" and first(spark, X.value_of("c", F.lit("q")), "a_b_c") == "a_b_c"
    assert first(spark, X.short_label("c"), "l" * 50) == "l" * 39 + "..." and first(spark, X.safe_name("c", 5), "a/b c-d") == "a_b_c"
    assert first(spark, X.numbered("c"), ["p", "q"], "array<string>") == "[1] p\n\n[2] q"
    assert first(spark, X.without_thoughts("c"), "<think>a</think>b</think>```json\n{}```") == "{}"


def test_a_category_is_a_closed_world(spark):
    df = spark.createDataFrame([(1, "x"), (2, "Y z"), (3, ""), (4, None)], "id int, text string")
    got = {r["id"]: tuple(r)[1:] for r in tristate.keyword_matrix(df, "text", LEXICON, ["id"]).collect()}
    assert got == {1: (1, 0, 2), 2: (0, 1, 1), 3: (2, 2, 2), 4: (2, 2, 2)}


def test_inferred_features(spark):
    df = spark.createDataFrame([(i, i % 3, float(i), "m") for i in range(30)], "id int, f int, g double, meta string")
    assert tristate.infer_features(df, ["id", "meta"]) == ["f"]


def test_phi_against_numpy(spark):
    r = np.random.default_rng(0)
    x = r.integers(0, 3, (400, 4))
    wide = spark.createDataFrame([tuple(map(int, row)) for row in x], "p tinyint, q tinyint, r tinyint, s tinyint")
    got = {(g["feature_1"], g["feature_2"]): g["phi_coefficient"] for g in statistics.redundant_pairs(wide, list("pqrs"), threshold=0.0).collect()}
    for i in range(4):
        for j in range(i + 1, 4):
            ok = (x[:, i] != 2) & (x[:, j] != 2)
            assert got["pqrs"[i], "pqrs"[j]] == pytest.approx(np.corrcoef(x[ok, i] == 1, x[ok, j] == 1)[0, 1], abs=6e-5)


@pytest.mark.parametrize(("x", "k", "want"), [(3.841458820694124, 1, 0.05), (5.991464547107979, 2, 0.05), (18.307038053275146, 10, 0.05), (0.0, 3, 1.0), (100.0, 1, 1.523970604832105e-23), (1.0, 4, 0.9097959895689501)])
def test_chi2_survival(x, k, want):
    assert statistics._upper_gamma(k / 2, x / 2) == pytest.approx(want, rel=1e-10)


def test_empty_and_degenerate_tables(spark):
    empty = spark.createDataFrame([], "label string, f tinyint, g tinyint")
    assert [r["informativeness"] for r in statistics.coverage(empty, ["f", "g"]).collect()] == [0.0, 0.0]
    assert statistics.redundant_pairs(empty, ["f", "g"]).count() == 0 and statistics.classwise_odds(empty, ["f"], "label").count() == 0
    one = spark.createDataFrame([("a", 1, 2)] * 200, empty.schema)
    assert [(r["chi2_statistic"], r["cramers_v"]) for r in statistics.chi_square(one, ["f", "g"], "label").collect()] == [(0.0, 0.0)] * 2
    assert statistics.gap(one, one, {"h": "f"}).count() == 0


def test_upgma():
    d = np.array([[0, 0.1, 0.9, 0.8], [0.1, 0, 0.7, 0.9], [0.9, 0.7, 0, 0.2], [0.8, 0.9, 0.2, 0]])
    assert sorted(signatures.upgma(d, 0.5)) == [[0, 1], [2, 3]] and signatures.upgma(d, 0.83) == [[0, 1, 2, 3]] and len(signatures.upgma(d, 0.05)) == 4


def test_a_job_too_long_is_an_error(spark):
    jobs = spark.createDataFrame([("s", 1, 10, 5), ("s", 2, 99, 5)], "s string, k int, bytes long, tokens long")
    assert [r["chunk"] for r in requests.chunks(jobs, "s", "k", most_jobs=9, most_bytes=100, most_tokens=7).orderBy("k").collect()] == [0, 1]
    with pytest.raises(Exception, match="more bytes than a chunk"):
        requests.chunks(jobs, "s", "k", most_jobs=9, most_bytes=50, most_tokens=None).collect()


def test_the_extractor_is_pluggable(spark):
    calls = spark.sparkContext.accumulator(0)

    def extractor(texts):
        calls.add(1)
        if any("bad" in t for t in texts):
            raise RuntimeError("no")
        return [{"a": ["x"]} if "x" in t else {} for t in texts]

    texts = spark.createDataFrame([("x1",), ("none",), ("bad",)], "text string").coalesce(1)
    got = sorted(map(tuple, extract.with_extractor(texts, extractor, size=1, retries=1).collect()), key=repr)
    assert got == [("bad", None, None, "failed"), ("none", None, None, "empty"), ("x1", "a", "x", "ok")] and calls.value >= 4


def test_salvage(spark):
    df = spark.createDataFrame([(1, '{"captions":[{"a":["p"]},{"a":["q"],"b":[]},{"a":["r', 3)], "id int, text string, n_expected int")
    row = responses.parsed(df).first()
    assert row["status"] == "salvaged" and row["items"] == ['{"a":["p"]}', '{"a":["q"],"b":[]}']


def test_sources(spark, tmp_path):
    spark.createDataFrame([("a\nb", "en"), ("  ", "de"), (None, "fr")], "text string, lang string").write.csv(f"{tmp_path}/c", header=True, quoteAll=True)
    assert files.read_captions(spark, f"{tmp_path}/c", "text", ["lang"]).count() == 1 and files.read_captions(spark, f"{tmp_path}/c", "text", drop_blank=False).count() == 3
    with pytest.raises(ValueError, match="missing: nope"):
        files.read_captions(spark, f"{tmp_path}/c", "text", ["nope"])
    (tmp_path / "s.json").write_text('{"feature_categories":[{"category":"a","features":["y","x"," "]},{"category":"b","features":["z"]}]}')
    assert [(r["category"], r["value"]) for r in files.read_schema(spark, f"{tmp_path}/s.json").collect()] == [("a", "y"), ("a", "x"), ("b", "z")]
    (tmp_path / "p.csv").write_text("true_label,confused_with\n a , b \n,c\n")
    assert sorted(map(tuple, files.read_pairs(spark, f"{tmp_path}/p.csv", [("x", "y")]).collect())) == [("a", "b"), ("x", "y")]
    tags = spark.createDataFrame([(1, " t", '["p"]'), (2, "t", '["q"]'), (3, "u", "broken")], "id int, text string, tags string")
    assert {r["text"]: r["tags"] for r in files.read_tags(tags, "text", "tags", "id").collect()} == {"t": ["p"], "u": []}
    lines = spark.createDataFrame([('{"a":1}',)], "line string")
    files.write_lines(lines, f"{tmp_path}/l")
    assert [r["line"] for r in files.read_lines(spark, f"{tmp_path}/l").collect()] == ['{"a":1}']
    for kind in ("parquet", "json", "csv"):
        files.write_table(lines, f"{tmp_path}/{kind}", kind)


def test_resuming(spark, tmp_path):
    store = files.Checkpoint(spark, f"{tmp_path}/store")
    texts = spark.createDataFrame([("p",), ("q",), ("r",)], "text string")
    assert store.remaining(texts).count() == 3
    store.add(spark.createDataFrame([("p", "ok", {"f": 1}), ("q", "failed", None)], files.Checkpoint.SCHEMA))
    assert sorted(r["text"] for r in store.remaining(texts).collect()) == ["q", "r"]
    assert [tuple(r) for r in store.vectors(["f", "g"]).collect()] == [("p", 1, 2)]


def test_streaming(spark, tmp_path):
    store = files.Checkpoint(spark, f"{tmp_path}/store")
    for k, rows in enumerate(([("x",), ("y",)], [("y",), ("z",)])):
        spark.createDataFrame(rows, "text string").write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema("text string").parquet(f"{tmp_path}/in")
        done = incremental.extract_stream(stream, lambda t: t.select("text", F.lit("ok").alias("status"), F.create_map(F.lit("f"), F.lit(1).cast("tinyint")).alias("states")), store, f"{tmp_path}/state")
        done.awaitTermination()
        assert sorted(r["text"] for r in store.load().collect()) == ["x", "y", "z"][: 2 + k]


def test_sample_size(spark):
    df = spark.createDataFrame([(n,) for n in (1, 200, 201, 1000, 1001, 5000, 5001)], "n long")
    assert [r[0] for r in df.select(captions.sample_size(F.col("n"))).collect()] == [1, 200, 200, 200, 300, 300, 500]
    assert math.isclose(first(spark, requests.output_budget(F.col("c"), True), 10, "long"), 2400)


def test_salvage_of_nested_objects_and_strings_with_braces(spark):
    want = {
        '[{"a":{"b":[{"c":1}]},"d":"}{\\"]"},{"a":["q': ['{"a":{"b":[{"c":1}]},"d":"}{\\"]"}'],
        '{"outputs":["x", 3, {"a":1}, null, {"b":{"c":{"d":{}}}}, {"e":{"f":1}, "g"': ['{"a":1}', '{"b":{"c":{"d":{}}}}'],
        '[{"a":{"b":1}': [],
        '{"captions":[{"long":"' + "w " * 200_000 + '"},{"cut': ['{"long":"' + "w " * 200_000 + '"}'],
    }
    for text, items in want.items():
        df = spark.createDataFrame([(1, text, 9)], "id int, text string, n_expected int")
        assert responses.parsed(df).first()["items"] == items


def test_rules_by_default(spark):
    said = {
        "She has a rash": ("unknown", 0, 0, "unknown", 2, "unknown", "unknown"), "a 59 year-old Man, fitzpatrick type 4; lifelong, over years": ("45_59", 1, 4, "years", 0, "unknown", "unknown"),
        "likely acute eczema, many spots": ("unknown", 2, 0, "acute", 2, "suspected", "multiple"), "dark brown, clinically diagnosed": ("unknown", 2, 4, "unknown", 2, "clinical", "unknown"),
        None: ("unknown", 2, 0, "unknown", 2, "unknown", "unknown"), "éhe": ("unknown", 2, 0, "unknown", 2, "unknown", "unknown"),
    }
    df = spark.createDataFrame([(k,) for k in said], "text string")
    got = {r["text"]: tuple(r[c] for c in ("age_group", "sex", "fitzpatrick_skin_type", "duration_bucket", "onset_sudden", "diagnosis_confidence", "lesion_count")) for r in extract.facts(df, "text", ["text"]).collect()}
    assert got == said


def test_scales(spark):
    raw = [("demographics_skin_type", "fair"), ("demographics_skin_type", "fst2"), ("demographics_skin_type", "pinkish"), ("c", "other"), ("c", "x"), ("severity", "awful"), ("severity", "mild")]
    rows = lambda data: sorted((r["category"], r["value"]) for r in vocabulary.enforced(spark.createDataFrame([(*r, 0) for r in data], "category string, value string, position int")).collect())
    assert rows(raw) == [("c", "x"), ("demographics_skin_type", "fst2"), ("severity", "mild")]
    assert rows([raw[0], raw[2]]) == [("demographics_skin_type", "fair")] and rows([]) == []


def test_names_of_the_questionnaire(spark):
    got = {r["column"]: (r["category"], r["value"]) for r in mapping.resolved(spark).collect()}
    assert len(mapping.CANONICAL) == 46 and len(got) == 41 and len(mapping.COMPARED) == 28
    assert set(mapping.CANONICAL) - set(got) == {"age_group", "sex_at_birth", "fitzpatrick_skin_type", "condition_duration", "related_category"}
    assert got["body_parts_foot_top_or_side"] == ("body_location", "foot_top_side") and mapping.VALUES["age_group_18_to_29"] == ("demographics_age", "20-30")
    assert all(f"{c}_{v}" == mapping.COMPARED[k] for k, (c, v) in got.items() if k in mapping.COMPARED)
    vocab = spark.createDataFrame([("body_location", "arm"), ("c", "x")], "category string, value string")
    rows = {(r["category"], r["value"]): (r["added"], r["comparable"]) for r in mapping.verified(vocab).collect()}
    assert rows["body_location", "arm"] == (False, True) and rows["c", "x"] == (False, False) and rows["morphology_texture", "flat"] == (True, True) and len(rows) == 42


def test_bisection():
    asked = []

    def extractor(texts):
        asked.append(len(texts))
        if len(texts) > 2:
            raise extract.Truncated([{"a": [t]} for t in texts[:1]])
        return [{"a": [t]} for t in texts]

    assert extract.extracted(list("abcdefgh"), extractor) == [{"a": [t]} for t in "abcdefgh"] and asked == [8, 8, 4, 4, 2, 2, 4, 4, 2, 2]
    assert extract.extracted(["a", "b"], lambda t: [{}]) == [{}, None] and extract.extracted(["a"], lambda t: 1 / 0) == [None]

    def never(texts):
        raise extract.Truncated

    assert extract.extracted(list("abcd"), never) == [None] * 4


def test_batches_in_ranges(spark):
    rows = [(i * 37 % 1009 - 300, "a" if i % 3 else None) for i in range(900)] + [(None, "a"), (5000, "b")]
    df = spark.createDataFrame(rows, "k long, l string")
    got = {(r["k"], r["l"]): r["batch"] for r in captions.batches(df, "l", "k", 7, span=50).collect()}
    for label in ("a", "b", None):
        own = sorted((k for k, x in rows if x == label), key=lambda k: (k is not None, k or 0))
        assert [got[k, label] for k in own] == [i // 7 for i in range(len(own))]


def test_answer_schema_and_room(spark):
    a, b = requests.answer_schema({"b": ["y", "x"], "a": ["z"]}, 3), requests.answer_schema({"a": ["z"], "b": ["x", "y"]}, 3)
    assert a == b and a[0] != requests.answer_schema({"a": ["z"]}, 3)[0] and a[1]["properties"]["captions"]["items"]["properties"]["b"]["items"]["enum"] == ["x", "y"]
    assert first(spark, requests.context_room(F.col("c"), 4096, 1000), 3500, "long") == 564 and first(spark, requests.context_room(F.col("c"), 4096, 1000), 10, "long") == 1000
    with pytest.raises(Exception, match="no room"):
        first(spark, requests.context_room(F.col("c"), 4096, 1000), 4090, "long")
    with pytest.raises(ValueError, match="sampling mode"):
        captions.sampled(spark.range(1), "some", "id", "id", "id")


def test_report(spark):
    rows = [("f", 0.5, 0.4, 0.001, False), ("g", 0.02, 0.1, 0.2, True), ("h", 0.001, 0.1, None, False)]
    df = spark.createDataFrame(rows, "feature string, mutual_information double, cramers_v double, chi2_pvalue double, is_compared boolean")
    text = statistics.report(df, "l")
    assert text.index("| f | 0.5 |") < text.index("| g | 0.02 |") and text.count("| f |") == 2 and text.count("| h |") == 1
