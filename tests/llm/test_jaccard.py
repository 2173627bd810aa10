import random
import tracemalloc
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from tercet.llm import common, jaccard
from tercet.llm.common import WordHasher
from tercet.llm.jaccard import components, jaccard_join, one_of_each


def grams(t, n=3):
    w = (t or "").lower().split()
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def brute(rows, threshold=0.6):
    """{(doc_id, n-grams): (class_id, n_links)}"""
    own = {}
    for d, t in rows:
        if d is not None:
            own.setdefault(grams(t), set()).add(d)
    parent = {g: g for g in own}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = {g: len(i) - 1 if g else 0 for g, i in own.items()}
    for g, h in combinations([g for g in own if g], 2):
        if len(g & h) >= threshold * len(g | h):
            links[g] += len(own[h])
            links[h] += len(own[g])
            parent[find(h)] = find(g)
    least = {}
    for g, i in own.items():
        least[find(g)] = min(least.get(find(g), min(i)), min(i))
    return sorted((d, least[find(g)] if g else d, links[g]) for g, i in own.items() for d in i)


def near(prose):
    texts = []
    for i, t in enumerate(prose(60, 5, 30, 80)):
        w = t.split()
        texts += [t, " ".join(w[:-2] + ["zz", "yy"]), " ".join(w[: len(w) // 2]), t.upper()][: 1 + i % 4]
    return texts


def without_a_least_hash_in_common(most=20):
    """Two similar texts: the `most` n-grams of least hash of each aren't in the other."""
    r = random.Random(8)
    words = lambda k: ["".join(r.choice("abcdefghij") for _ in range(8)) for _ in range(k)]
    shared, loose = words(300), words(90_000)
    floor = next(jaccard.sets_of(pa.array([" ".join(shared)]), 3, WordHasher())).min()
    triples = [" ".join(loose[i : i + 3]) for i in range(0, len(loose) - 2, 3)]
    low = [t for t, s in zip(triples, jaccard.sets_of(pa.array(triples), 3, WordHasher())) if s[0] < floor]
    assert len(low) >= 2 * most
    a, b = (" ".join([*shared, *own]) for own in (low[:most], low[most : 2 * most]))
    x, y = jaccard.sets_of(pa.array([a, b]), 3, WordHasher())
    assert not np.intersect1d(x[:most], y).size and not np.intersect1d(y[:most], x).size
    return a, b


def result(df):
    assert df.columns == ["doc_id", "class_id", "n_links"]
    return sorted(map(tuple, df.collect()))


def test_against_brute_force(make, prose):
    texts = near(prose)
    want = brute(list(enumerate(texts)))
    assert result(jaccard_join(make(texts))) == want and sum(n for *_, n in want) > 60


@pytest.mark.parametrize("hot", [10, 256])
def test_common_passage_and_deep_trees(make, prose, hot):
    shared = prose(1, 77, 140, 140)[0]
    texts = [shared + " " + t for t in prose(150, 6, 5, 25)]
    want = brute(list(enumerate(texts)))
    assert result(jaccard_join(make(texts), hot=hot)) == want and sum(n for *_, n in want) > 2000


def test_hot_keys_are_split_in_cells(make, prose, monkeypatch):
    """Many different texts around one passage, in sizes about the threshold."""
    monkeypatch.setattr(jaccard, "CELL", 16)
    shared = prose(1, 78, 60, 60)[0]
    texts = [shared + " " + t for t in prose(220, 9, 5, 60)]
    want = brute(list(enumerate(texts)))
    links = [n for *_, n in want]
    assert result(jaccard_join(make(texts))) == want and 0 < sum(links) < 220 * 219 and len(set(links)) > 20


def test_pairs_without_a_least_hash_in_common(make, prose):
    texts = [*without_a_least_hash_in_common(), *prose(20, 4)]
    want = brute(list(enumerate(texts)))
    assert want[1] == (1, 0, 1) and result(jaccard_join(make(texts))) == want


def test_threshold_is_met_by_few_common_ngrams(make):
    """Texts of 5 to 60 words that have just enough n-grams in common, or one too few, whatever their hashes."""
    texts, r = [], random.Random(12)
    for k in range(120):
        w = [f"w{r.randrange(10**9)}" for _ in range(r.randint(7, 60))]
        g = len(w) - 2
        texts += [" ".join(w), " ".join([*w[: max(3, round(0.75 * g) + 2 - k % 2)], *(f"x{r.randrange(10**9)}" for _ in range(g - round(0.75 * g)))])]
    want = brute(list(enumerate(texts)))
    assert result(jaccard_join(make(texts))) == want and 60 < sum(n for *_, n in want) < 240


def parts_of_longer_texts(count=150):
    """Texts and beginnings of them, a little above the threshold or just at it: the pairs' sizes differ, and so do the places up to which n-grams are looked up."""
    texts, r = [], random.Random(5)
    for k in range(count):
        w = [f"w{r.randrange(10**9)}" for _ in range(r.randint(20, 150))]
        g = len(w) - 2
        texts += [" ".join(w), " ".join(w[: -int(-g * (0.6 + 0.01 * (k % 6)) // 1) + 2])]
    return texts


def test_threshold_is_met_by_parts_of_longer_texts(make):
    texts = parts_of_longer_texts()
    want = brute(list(enumerate(texts)))
    assert sum(n for *_, n in want) == len(texts) and result(jaccard_join(make(texts))) == want


def test_without_a_broadcast(make, prose, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_BYTES", -1)
    monkeypatch.setattr(jaccard, "HEAVY", 2)
    texts = near(prose) + ["the same text in many rows"] * 9
    assert result(jaccard_join(make(texts))) == brute(list(enumerate(texts)))
    assert sorted(r["doc_id"] for r in one_of_each(make(texts)).collect()) == sorted({c for _, c, _ in brute(list(enumerate(texts)))})


def test_one_of_each(make, prose):
    texts = near(prose)
    want = sorted({c for _, c, _ in brute(list(enumerate(texts)))})
    assert sorted(r["doc_id"] for r in one_of_each(make(texts)).collect()) == want


def test_trees_take_little_memory():
    """A cell's points are compared in parts: those of all pairs at once don't fit in a worker."""
    points = 1 + np.random.default_rng(3).integers(0, 2, (2 * jaccard.CELL, jaccard.GROUPS)).astype(np.int32)
    sizes = points.sum(1)
    tracemalloc.start()
    x, y = jaccard.tree_pairs(sizes, points, 0.6)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(x) == len(points) * (len(points) - 1) // 2 and len({*zip(x.tolist(), y.tolist())}) == len(x)
    assert peak < 100 << 20


def test_repeated_ids(make):
    """Other texts under the id of a copy stay."""
    a, b, c = "one two three four five six", "seven eight nine ten eleven twelve", "red green blue black white"
    rows = [(1, a, "en", "s"), (2, a, "en", "s"), (2, b, "en", "s"), (2, b, "en", "s"), (3, b, "en", "s"), (3, c, "en", "s"), (None, a, "en", "s")]
    assert result(jaccard_join(make(rows))) == brute([r[:2] for r in rows])
    assert sorted(one_of_each(make(rows)).select("doc_id", "text").collect(), key=repr) == sorted([(1, a), (2, b), (2, b), (3, c), (None, a)], key=repr)


def test_components(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(5, 3), (3, 9), (9, 5), (7, 8)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 141)}, 3: 3, 5: 3, 9: 3, 7: 7, 8: 7}


def test_odd_rows(odd):
    assert result(jaccard_join(odd)) == brute([(r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").collect()])
    kept = one_of_each(odd)
    assert kept.columns == odd.columns and kept.count() == 9


def test_empty(make):
    assert jaccard_join(make([])).count() == 0 and one_of_each(make([])).count() == 0
    assert result(jaccard_join(make([None, ""]))) == [(0, 0, 0), (1, 1, 0)] and one_of_each(make([None, ""])).count() == 2


def test_shuffle_files_go_on_the_way(spark, make, prose):
    """What is shuffled for a written table is gone when the table is there; the join's shuffles don't all lie on the disk at once."""
    docs = make(near(prose))
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {f.getName() for f in (lambda all: (all.apply(i) for i in range(all.length())))(manager.getAllFiles().toSeq()) if f.getName().startswith("shuffle_")}
    before = files()
    out = common.written(docs.repartition(3, "doc_id").groupBy("source").count())
    assert not files() - before and out.count() == 3


@pytest.mark.parametrize("shares", [1, 3])
def test_shares_of_keys(make, prose, monkeypatch, shares):
    monkeypatch.setattr(jaccard, "SHARES", shares)
    texts = near(prose)
    assert result(jaccard_join(make(texts))) == brute(list(enumerate(texts)))
