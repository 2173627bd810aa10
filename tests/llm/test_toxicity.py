import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tercet.llm.toxicity import ANCHOR, END, RUN, STRIDE, TAIL, WORDS, Scorer, ToxicityModel, calibrated, compressor, fit, model_of, score, without_toxic

BAD = ["zvukrat", "gorblix", "snarfk", "wixxom", "krelpho", "vadruum"]


@pytest.fixture(scope="module")
def labelled(prose):
    """900 texts, of which each third has a few words of a list; (texts, toxic)."""
    r = random.Random(8)
    texts, toxic = prose(900, 8), [i % 3 == 0 for i in range(900)]
    for i, y in enumerate(toxic):
        if y:
            words = texts[i].split()
            for _ in range(6):
                words.insert(r.randrange(len(words)), r.choice(BAD))
            texts[i] = " ".join(words)
    return texts, toxic


@pytest.fixture(scope="module")
def model(labelled):
    texts, toxic = labelled
    return fit([(t, "en", y) for t, y in zip(texts[:600], toxic)])


def judged(model, rows):
    return Scorer(model).batch(pa.array([t for t, _ in rows], pa.string()), pa.array([x for _, x in rows], pa.string()))


def brute_score(model, text, lang):
    """From the definition, window by window, with compressors of its own."""
    own = model.dictionaries[lang if lang in model.dictionaries else None]
    ordinary, toxic = own.base + ANCHOR + own.ordinary, own.base + ANCHOR + own.toxic
    only = {own.toxic[i : i + RUN] for i in range(len(own.toxic) - RUN + 1)} - {ordinary[i : i + RUN] for i in range(len(ordinary) - RUN + 1)}
    a, b = compressor(ordinary + END), compressor(toxic + END)
    words = re.sub(r"[\x00-/:-`{-\x7f]+", " ", (text or "").lower()).split(" ")
    words = [w for w in words if w]
    total = n = 0
    for i in range(0, max(1, len(words) - WORDS + STRIDE) if words else 0, STRIDE):
        window = f" {' '.join(words[i : i + WORDS])} ".encode()
        n += 1
        if any(window[k : k + RUN] in only for k in range(len(window) - RUN + 1)):
            total += max(0, len(a.compress(ANCHOR + window + TAIL)) - len(b.compress(ANCHOR + window + TAIL)) - own.slack)
    return total / (20 + n) ** 0.6


def test_scores_are_those_of_the_definition(model, labelled):
    texts = [*labelled[0][600:700], "", "one", "Snarfk,wixxom!", "é " * 3000 + "gorblix", None]
    got = judged(model, [(t, x) for t, x in zip(texts, ["en", "xx", None] * 40)])[0]
    assert got == [brute_score(model, t, x) for t, x in zip(texts, ["en", "xx", None] * 40)] and sum(x > 0 for x in got) > 30


def test_held_out_accuracy(spark, make, labelled):
    texts, toxic = labelled
    docs = make(texts)
    labels = spark.createDataFrame([(i, 1, int(y)) for i, y in enumerate(toxic) if i < 600], "doc_id long, quality int, toxic int")
    model = model_of(docs, labels)
    said = {r["doc_id"]: r["toxic"] for r in score(docs, model).collect()}
    held = range(600, 900)
    assert np.mean([said[i] for i in held if toxic[i]]) > 0.95 and np.mean([said[i] for i in held if not toxic[i]]) < 0.02
    left = {r["doc_id"] for r in without_toxic(docs, model).collect()}
    assert left == {i for i in said if not said[i]}


def test_sample_bounds_the_fit(spark, make, labelled):
    texts, toxic = labelled
    labels = spark.createDataFrame([(i, int(y)) for i, y in enumerate(toxic)], "doc_id long, toxic int")
    assert model_of(make(texts), labels, sample=500).dictionaries
    assert isinstance(model_of(make(texts), labels, sample_bytes=20_000), ToxicityModel)


def test_dictionaries_are_trained_on_few_labels(spark):
    """On 399 labelled documents, 51 of them toxic; no single language but one has enough."""
    d = "/root/testdata/sf0.01"
    model = model_of(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet"))
    assert set(model.dictionaries) == {None, "en"} and all(0 < x < np.inf for x in model.thresholds.values())
    assert all(len(d.toxic) >= 512 and len(d.toxic) == len(d.ordinary) and len(d.base) == 1 << 16 for d in model.dictionaries.values())


def test_no_list_of_words(model, prose):
    """Words that no text had are found by what they share with toxic ones, and a word's gain hangs on its neighbours."""
    r = random.Random(5)
    texts = prose(200, 91)
    unseen = [w + end for w in BAD for end in ("isk", "oru", "enda", "ul")]
    bad = []
    for t in texts:
        words = t.split()
        for _ in range(6):
            words.insert(r.randrange(len(words)), r.choice(unseen))
        bad.append(" ".join(words))
    assert np.mean(judged(model, [(t, "en") for t in bad])[1]) > 0.9 and np.mean(judged(model, [(t, "en") for t in texts])[1]) < 0.03
    rest = texts[0].split()
    scores = judged(model, [(" ".join(rest[k : k + 3] + ["gorblix"] + rest[k + 3 : k + 5]), "en") for k in range(len(rest) - 5)])[0]
    assert len(set(scores)) > 1


def test_odd_rows(spark, odd, model):
    out = score(odd, model).collect()
    assert len(out) == 9 and all(r["score"] == 0 and not r["toxic"] for r in out if r["doc_id"] in (1, 2, 3))
    kept = without_toxic(odd, model)
    assert kept.columns == odd.columns and kept.count() == sum(not r["toxic"] for r in out)


def test_without_labels_nothing_is_toxic(spark, make, prose):
    labels = spark.createDataFrame([(None, 1), (1, None)], "doc_id long, toxic int")
    docs = make(prose(5))
    assert not any(r["toxic"] for r in score(docs, model_of(docs, labels)).collect())
    assert score(make([]), model_of(make([]), labels)).count() == 0
    for kind in (0, 1):
        labels = spark.createDataFrame([(i, kind) for i in range(5)], "doc_id long, toxic int")
        assert not any(r["toxic"] for r in score(docs, model_of(docs, labels)).collect())


def test_calibration_takes_the_best_f1():
    r = np.random.default_rng(0)
    for _ in range(50):
        s, y, w = r.integers(0, 8, 30).astype(float), r.integers(0, 2, 30).astype(float), r.integers(1, 4, 30).astype(float)
        t, best = calibrated(s, y, w)

        def f1(t):
            said = s >= t
            return 2 * (said * y * w).sum() / max((said * w).sum() + (y * w).sum(), 1)

        if y.sum() and s.max() > 0:
            assert abs(best - max(f1(x) for x in np.arange(0.5, 8))) < 1e-12 and abs(f1(t) - best) < 1e-12


def test_a_small_language_of_compounds():
    """Toxic words of one language in twenty never recur whole; they begin alike. A third language has too few labels and goes with all."""
    r = random.Random(4)

    def word(syllables):
        return "".join(r.choice(syllables) for _ in range(r.randint(2, 5)))

    en, xx = (["".join(r.choice(c) + r.choice("aeiou") for _ in range(1)) for _ in range(40)] for c in ("bdfglmnprst", "ckhvwzjqx"))
    rows = []
    for i in range(6000):
        lang = "xx" if i % 20 < 2 else "yy" if i % 200 == 2 else "en"
        toxic = i % 16 < 2
        words = [word(xx if lang == "xx" else en) for _ in range(40)]
        if toxic:
            for _ in range(4):
                words.insert(r.randrange(len(words)), "snurkvlem" + word(xx) if lang == "xx" else "gorblix")
        rows.append((" ".join(words), lang, toxic))
    r.shuffle(rows)
    model, fresh = fit(rows[:3000]), rows[3000:]
    assert set(model.dictionaries) == {None, "en", "xx"}
    said = judged(model, [(t, x) for t, x, _ in fresh])[1]
    for lang in ("xx", "yy", "en"):
        own = [(s, y) for s, (_, x, y) in zip(said, fresh) if x == lang]
        assert np.mean([s for s, y in own if y] or [1]) > 0.9 and np.mean([s for s, y in own if not y]) < 0.03, lang
