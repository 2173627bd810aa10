import random

import numpy as np

from tercet.llm.mixing import copies, duels, mixed, uniforms


def test_duels_keep_sums_and_expectations():
    r = random.Random(2)
    fractions = [r.random() for _ in range(7)]
    mean = np.zeros(7)
    for _ in range(20_000):
        fates, held, p = duels(fractions, [r.random() for _ in fractions])
        own = [(f if i != held else p) for i, f in enumerate(fates)]
        assert abs(sum(own) - sum(fractions)) < 1e-9 and sum(f < 0 for f in fates) <= 1
        mean += own
    assert np.abs(mean / 20_000 - fractions).max() < 0.015


def test_totals_meet_targets(spark, make):
    rows = [(i, "word " * (1 + i % 7), "en", f"s{i * i % 5}") for i in range(3000)]
    weights = {f"s{k}": k + 1.0 for k in range(5)}
    got = copies(make(rows), weights, budget=1.7)
    assert got.count() == 3000
    present = {r[3] for r in rows}
    total = sum(weights[s] for s in present)
    for r in got.groupBy("source").agg({"copies": "sum", "doc_id": "count"}).collect():
        target = 1.7 * 3000 * weights[r["source"]] / total
        assert abs(r["sum(copies)"] - target) < 1
    for r in got.collect():
        n = sum(x[3] == r["source"] for x in rows)
        rate = 1.7 * 3000 * weights[r["source"]] / total / n
        assert r["copies"] in (int(rate), int(rate) + 1)


def test_against_a_rounding_of_its_own(make):
    """Each source's duels, in the order of ids, by the rule as it is written; the one that is left is settled by a draw."""
    rows = [(i, "word " * (1 + i % 7), "en", f"s{i * i % 5}") for i in range(700)]
    weights, budget = {"s0": 1.0, "s1": 4.0, "s4": 2.5}, 1.3
    got = {r["doc_id"]: r["copies"] for r in copies(make(rows), weights, budget=budget, seed=17).collect()}
    for source in {r[3] for r in rows}:
        ids = [r[0] for r in rows if r[3] == source]
        rate = budget * len(rows) * weights[source] / sum(weights[s] for s in {r[3] for r in rows}) / len(ids)
        draws = dict(zip(ids, uniforms(np.array(ids), 17, 0).tolist()))
        extra, a, p = {}, None, 0.0
        for b in ids:
            q = rate % 1
            if a is None:
                a, p = b, q
                continue
            if p + q <= 1:
                winner, loser = (a, b) if draws[b] < p / (p + q) else (b, a)
                extra[loser], a, p = 0, winner, p + q
            else:
                winner, loser = (a, b) if draws[b] < (1 - q) / (2 - p - q) else (b, a)
                extra[winner], a, p = 1, loser, p + q - 1
            if p < 1e-9 or p > 1 - 1e-9:
                extra[a], a = round(p), None
        assert all(got[i] == int(rate) + x for i, x in extra.items()) and len(extra) >= len(ids) - 1


def test_a_deep_tree(spark, make, monkeypatch):
    import tercet.llm.mixing as m

    monkeypatch.setattr(m, "CELL", 7)
    rows = [(i, "w", "en", "a" if i % 4 else "b") for i in range(1000)]
    got = {r["source"]: r["sum(copies)"] for r in copies(make(rows), {"a": 1.0, "b": 1.0}, budget=0.5, fan=3).groupBy("source").sum("copies").collect()}
    assert got == {"a": 250, "b": 250}


def test_it_decides_alike_again(make):
    rows = [(i, "w", "en", f"s{i % 3}") for i in range(500)]
    a, b = (sorted(map(tuple, copies(make(rows)).collect())) for _ in range(2))
    assert a == b


def test_odd_rows(odd):
    out = copies(odd)
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in out.collect()) == [(False, i) for i in range(1, 7)] + [(True, 0)]
    assert {r["doc_id"]: r["source"] for r in out.collect()}[2] == ""
    m = mixed(odd, budget=20.0)
    assert set(m.columns) == set(odd.columns) and all(r["copies"] > 0 and r["settled"] == "own settled" for r in m.collect())


def test_empty_and_unnamed_sources(make):
    assert copies(make([])).count() == 0 and mixed(make([])).count() == 0
    assert all(r["copies"] == 0 for r in copies(make(["a", "b"]), {"other": 1.0}).collect())
