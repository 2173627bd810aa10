from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tercet.llm.common import WordHasher
from tercet.llm.lm_scoring import Model, Trainer, counts_of, first_parameters, score, trained, triples, vocabulary_of
from tercet.llm.quality import words_of

SMALL = {"vocabulary": 60, "buckets": 8, "size": 12}


@pytest.fixture(scope="module")
def model(make, prose):
    return trained(make(prose(1500, 20)), **SMALL, batch=256)


def brute(model, text):
    """From the parameters, one word after another."""
    from tercet.llm.common import WordHasher
    from tercet.llm.quality import words_of
    import pyarrow as pa

    hashes = np.concatenate([w for w, _ in words_of(pa.array([text]), WordHasher())])
    ids, p, n = model.vocab.encoded(hashes).tolist(), {k: v.astype(float) for k, v in model.p.items()}, len(model.vocab)
    total, u, v = 0.0, n, n
    for w in ids:
        s = p["q"] @ (p["a1"] @ p["r"][u] + p["a2"] @ p["r"][v]) + p["b"]
        total += s[w] - np.log(np.exp(s).sum())
        u, v = v, w
    return total


def test_against_brute_force(make, prose, model):
    texts = prose(30, 21)
    got = {r["doc_id"]: r for r in score(make(texts), model).collect()}
    for i, t in enumerate(texts):
        assert got[i]["log_prob"] == pytest.approx(brute(model, t), rel=1e-4) and got[i]["n_words"] == len(t.split())


def test_probabilities_sum_to_one(model):
    n = len(model.vocab)
    w = np.arange(n)
    for u, v in ((n, n), (n, 3), (4, 5)):
        p = np.exp(model.log_probabilities(np.full(n, u), np.full(n, v), w))
        assert p.sum() == pytest.approx(1, rel=1e-4)


def test_it_learns_what_follows_what(make):
    """Each word determines the next: a model that doesn't look at the context can't do better than chance."""
    r = np.random.default_rng(0)
    names = [f"w{i}" for i in range(20)]
    texts = []
    for _ in range(600):
        at, out = r.integers(20), []
        for _ in range(60):
            out.append(names[at])
            at = (at * 3 + 1) % 20 if r.random() < 0.9 else r.integers(20)
        texts.append(" ".join(out))
    model = trained(make(texts[:500]), vocabulary=20, buckets=2, size=16, batch=256)
    mean = np.mean([x["mean_log_prob"] for x in score(make(texts[500:]), model).collect()])
    assert mean > np.log(1 / 20) + 1


def test_vocabulary_counts_all(make):
    docs = make(["a a a b b c", "a b d e f", None, ""] * 10)
    v = vocabulary_of(docs, 2, 4)
    p = np.exp(v.log_noise)
    assert p[0] == pytest.approx(40.5 / 113, rel=1e-6) and p[1] == pytest.approx(30.5 / 113, rel=1e-6) and p.sum() == pytest.approx(1)


def test_gradient_lowers_the_loss(make, prose, model):
    vocab = model.vocab
    t = Trainer(first_parameters(vocab, 8, 1), vocab, 16, 0.1, 2)
    ids = np.random.default_rng(3).integers(0, 5, 4000).astype(np.int32)
    u, v = triples(ids, np.array([0, 4000]), len(vocab))
    before = Model(vocab, {k: x.copy() for k, x in t.p.items()}).log_probabilities(u, v, ids).mean()
    for _ in range(5):
        t.learn(u, v, ids, 256)
    assert Model(vocab, t.p).log_probabilities(u, v, ids).mean() > before + 0.5


def test_odd_rows(odd, make, model):
    out = score(odd, model).collect()
    assert len(out) == 9 and all(r["n_words"] == 0 and r["log_prob"] == 0 and r["mean_log_prob"] is None for r in out if r["doc_id"] in (1, 2, 3))
    assert next(r["n_words"] for r in out if r["doc_id"] == 6) == 50_001
    none = trained(make([]), **SMALL)
    assert score(make([]), none).count() == 0 and score(odd, none).count() == 9


def test_words_of_a_bucket_have_their_own_share(make, odd, prose):
    """Texts that differ in words of one bucket only differ by the words' counts; a bucket's shares sum to one."""
    texts = prose(200, 22)
    docs = make(texts)
    counts = counts_of(docs)
    model = trained(docs, vocabulary=20, buckets=2, size=8, batch=256, counts=counts)
    n = Counter(w for t in texts for w in t.split())
    words = sorted(n)
    by_class = {r["doc_id"]: r["log_prob"] for r in score(make(words), model).collect()}
    over_words = {r["doc_id"]: r["log_prob"] for r in score(make(words), model, counts).collect()}
    ids = np.concatenate([model.vocab.encoded(h) for h, _ in words_of(pa.array(words), WordHasher())])
    for i, w in enumerate(words):
        share = 1 if ids[i] < 20 else n[w] / (sum(n[x] for x, j in zip(words, ids) if j == ids[i]) + 0.5)
        assert over_words[i] == pytest.approx(by_class[i] + np.log(share), rel=1e-4)
    assert 0.99 < sum(map(np.exp, over_words.values())) <= 1.001
    whole = {r["doc_id"]: r for r in score(docs, model, counts).collect()}
    assert len(whole) == 200
    for i, t in enumerate(texts):
        own = [model.vocab.encoded(h) for h, _ in words_of(pa.array([t]), WordHasher())][0]
        extra = sum(np.log(n[w] / (model.vocab.held[j - 20] + 0.5)) for w, j in zip(t.split(), own) if j >= 20)
        assert whole[i]["log_prob"] == pytest.approx(brute(model, t) + extra, rel=1e-4) and whole[i]["n_words"] == len(own)
    out = score(odd, model, counts).collect()
    assert len(out) == 9 and sum(r["doc_id"] is None for r in out) == 1 and all(r["n_words"] == 0 and r["log_prob"] == 0 and r["mean_log_prob"] is None for r in out if r["doc_id"] in (1, 2, 3))
    assert score(make([]), model, counts).count() == 0
