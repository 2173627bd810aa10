import math
import pickle
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tercet.llm import quality
from tercet.llm.common import WordHasher, pieces
from tercet.llm.quality import Table, blocks, perplexities, score, trained, words_of


def discounts(counts):
    n = [sum(c == k for c in counts) for k in (1, 2, 3, 4)]
    y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
    return [0.0] + [min(max(k + 1 - (k + 2) * y * n[k + 1] / n[k], 0.1), k + 0.9) if n[k] else 0.5 * (k + 1) for k in range(3)]


class Brute:
    """The same model from dictionaries."""

    def __init__(self, texts):
        tri = Counter()
        for t in texts:
            w = ["<s>", "<s>", *t.lower().split()]
            tri.update(zip(w, w[1:], w[2:]))
        bi, uni = Counter(), Counter()
        for (u, v, w), c in tri.items():
            bi[v, w] += c if v == "<s>" else 1
        for v, w in bi:
            uni[w] += 1
        self.levels = []
        for counts in (uni, bi, tri):
            d = discounts(list(counts.values()))
            total, freed = defaultdict(float), defaultdict(float)
            for k, c in counts.items():
                h = k[:-1] if counts is not uni else ()
                total[h] += c
                freed[h] += d[min(c, 3)]
            self.levels.append((counts, d, total, freed))
        self.base = 1 / (len(uni) + 1)

    def p(self, u, v, w):
        p = self.base
        for (counts, d, total, freed), h in zip(self.levels, ((), (v,), (u, v))):
            k = (*h, w) if h else w
            if total.get(h):
                c = counts.get(k, 0)
                p = (c - d[min(c, 3)]) / total[h] + freed[h] / total[h] * p
        return p

    def perplexity(self, text):
        w = ["<s>", "<s>", *text.lower().split()]
        return math.exp(-sum(math.log(self.p(*x)) for x in zip(w, w[1:], w[2:])) / (len(w) - 2))


def test_against_dictionaries(make, prose):
    texts = prose(80, 11)
    model, brute = trained(make(texts)), Brute(texts)
    new = [*prose(20, 12), *texts[:10], "never seen before", "a"]
    got = {r["doc_id"]: r for r in perplexities(make(new), model).collect()}
    for i, t in enumerate(new):
        assert got[i]["perplexity"] == pytest.approx(brute.perplexity(t), rel=1e-4) and got[i]["n_words"] == len(t.split())


def test_probabilities_sum_to_one(make, prose):
    texts = prose(30, 13, 5, 30)
    model = trained(make(texts))
    vocabulary = sorted({w for t in texts for w in t.split()})
    w = texts[0].split()
    for context in (w[:2], [w[0], "unheard"], ["unheard", w[1]], ["un", "heard"]):
        batch = pa.array([" ".join([*context, x]) for x in [*vocabulary, "unseen"]])
        p = np.concatenate([model.probabilities(*x)[2::3] for x in words_of(batch, WordHasher())])
        assert p.sum() == pytest.approx(1, rel=1e-4)


def test_table():
    r = np.random.default_rng(1)
    keys = np.unique(r.integers(0, 2**63, 5000).astype(np.uint64) * np.uint64(2))
    t = Table(keys, np.arange(len(keys)))
    asked = np.concatenate([keys, r.integers(0, 2**63, 5000).astype(np.uint64), np.array([0, 2**64 - 1], np.uint64)])
    place = {int(k): i for i, k in enumerate(keys)}
    got = t.values[0][t.places(asked)]
    assert [None if np.isnan(g) else int(g) for g in got] == [place.get(int(k)) for k in asked]
    assert np.isnan(Table(np.zeros(0, np.uint64), np.zeros(0)).values[0][Table(np.zeros(0, np.uint64), np.zeros(0)).places(asked)]).all()


def test_held_out_junk_goes_and_prose_stays(spark, make, prose):
    good = prose(900, 14)
    junk = [" ".join("".join(chr(97 + (i * j * 7 + k * k) % 26) for k in range(6)) for j in range(40)) for i in range(1, 60)]
    docs = make([*good, *junk])
    labels = spark.createDataFrame([(i, 1) for i in range(600)] + [(900, 0)], "doc_id long, quality int")
    out = {r["doc_id"]: r for r in score(docs, labels).collect()}
    assert sum(out[i]["keep"] for i in range(600, 900)) > 285 and not any(out[i]["keep"] for i in range(900, 959))
    assert {r["threshold"] for r in out.values()} == {out[0]["threshold"]}


def test_trained_on_all_of_a_half(spark, make):
    """More trusted text than 12 MiB, one document a row of words of its own: those of one half are all known to the model."""
    texts = [" ".join(f"d{i}w{k % 50}" for k in range(60_000)) for i in range(80)]
    labels = spark.createDataFrame([(i, 1) for i in range(80)], "doc_id long, quality int")
    half = {r[0] for r in spark.range(80).where("pmod(xxhash64(id, 1), 2) = 0").collect()}
    out = {r["doc_id"]: r["perplexity"] for r in score(make(texts), labels).collect()}
    assert sum(len(texts[i]) for i in half) > 12 << 20
    assert {i for i in out if out[i] < 2} == half


def test_odd_rows(spark, odd, make):
    labels = spark.createDataFrame([(1, 1), (None, 1), (5, 1), (5, 0), (6, None)], "doc_id long, quality int")
    out = score(odd, labels).collect()
    assert len(out) == 9 and all(r["perplexity"] is None and not r["keep"] for r in out if r["doc_id"] in (1, 2, 3))
    none = score(odd, labels.where("false")).collect()
    assert all(r["keep"] == (r["n_words"] > 0) and r["threshold"] is None for r in none)
    assert score(make([]), labels).count() == 0


def test_the_model_is_read_in_parts(make, prose, monkeypatch):
    """What the driver and the workers hold is each word's own probability and where the parts are; texts are scored in blocks."""
    texts = prose(60, 15)
    model, brute = trained(make(texts)), Brute(texts)
    assert len(pickle.dumps(model)) < 100_000 and len(dict(model.shards())) > 8
    monkeypatch.setattr(quality, "BLOCK", 100)
    monkeypatch.setattr(quality, "pieces", lambda offsets: pieces(offsets, 500))
    got = [x for words, begins in blocks(pa.array([*texts, None, ""]), WordHasher()) for x in np.add.reduceat(np.append(-np.log(model.probabilities(words, begins)), 0), begins[:-1]) / np.maximum(np.diff(begins), 1)]
    assert len(got) == 62 and got[:60] == pytest.approx([math.log(brute.perplexity(t)) for t in texts], rel=1e-5)
