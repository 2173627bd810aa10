import numpy as np

from tercet.llm.ann import codebook_of, neighbours, scan


def vectors(n, d=24, seed=0, groups=12):
    r = np.random.default_rng(seed)
    x = r.normal(0, 1, (groups, d))[r.integers(groups, size=n)] + r.normal(0, 0.7, (n, d))
    return (x * r.uniform(0.5, 1.5, (n, 1))).astype(np.float32)


def table(spark, x):
    return spark.createDataFrame([(i, v.tolist(), i % 3) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")


def test_recall_against_brute_force(spark):
    x = vectors(3000)
    got = {}
    for r in neighbours(table(spark, x), 10, every=1, block=500).collect():
        got.setdefault(r["vec_id"], {})[r["rank"]] = (r["neighbour_id"], r["score"])
    scores = x.astype(float) @ x.T.astype(float)
    np.fill_diagonal(scores, -np.inf)
    truth = np.argsort(-scores, axis=1)[:, :10]
    assert all(sorted(g) == list(range(1, 11)) for g in got.values()) and len(got) == 3000
    assert np.mean([len({j for j, _ in got[i].values()} & set(truth[i])) / 10 for i in range(3000)]) > 0.95
    for i in range(0, 3000, 50):
        own = [got[i][r] for r in range(1, 11)]
        assert own == sorted(own, key=lambda p: -p[1]) and all(abs(scores[i, j] - s) < 1e-5 for j, s in own)


def test_the_loss_is_score_aware():
    r = np.random.default_rng(1)
    x = vectors(2000, 16, 1)
    residual = x - x.mean(0)
    book = codebook_of(residual, x, width=4, threshold=0.5, rounds=6, rng=r)
    plain = codebook_of(residual, x, width=4, threshold=0.0, rounds=6, rng=np.random.default_rng(1))
    assert book.eta > 1 == plain.eta
    u = x / np.linalg.norm(x, axis=1, keepdims=True)

    def parallel(b):
        return ((((residual - b.decoded(b.encoded(residual, x))) * u).sum(1)) ** 2).mean()

    assert parallel(book) < parallel(plain)
    codes = book.encoded(residual, x)
    nearest = plain.encoded(residual, x)
    assert book.loss(residual, x, codes) < book.loss(residual, x, nearest.clip(0, 15))


def test_scan_sums_the_tables():
    r = np.random.default_rng(2)
    tables, codes = r.normal(0, 1, (5, 6, 16)), r.integers(0, 16, (40, 6)).astype(np.uint8)
    sums, unit = scan(tables, codes[:, 0::2] << 4 | codes[:, 1::2])
    want = np.array([[sum(t[m, c[m]] for m in range(6)) for c in codes] for t in tables])
    assert np.abs(sums * unit[:, None] - want).max() < 6 * unit.max()


def test_odd_rows(spark):
    rows = [(None, [1.0, 0.0]), (1, None), (2, []), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [1.0, 0.0]), (6, [1.0, 0.0]), (6, [1.0, 0.0]), (7, [0.0, 1.0]), (8, [0.0, 0.0]), (9, [1.0, 1.0, 1.0]), (10, [float("inf"), 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "'x' as v", "1 as cell", "2 as rank")
    got = {}
    for r in neighbours(df, 2, every=1).collect():
        got.setdefault(r["vec_id"], []).append((r["rank"], r["neighbour_id"], r["score"]))
    assert {k: sorted(v) for k, v in got.items()} == {5: [(1, 6, 1.0), (2, 7, 0.0)], 6: [(1, 5, 1.0), (2, 7, 0.0)], 7: [(1, 5, 0.0), (2, 6, 0.0)], 8: [(1, 5, 0.0), (2, 6, 0.0)]}
    assert neighbours(df.where("false")).count() == 0 and neighbours(df.where("vec_id = 9")).count() == 0


def test_queries_are_every_hundredth(spark):
    x = vectors(1200, seed=4)
    got = neighbours(table(spark, x), 10).collect()
    scores = x[::100].astype(float) @ x.T.astype(float)
    scores[np.arange(12), np.arange(12) * 100] = -np.inf
    truth = np.argsort(-scores, axis=1)[:, :10]
    assert sorted({r["vec_id"] for r in got}) == list(range(0, 1200, 100)) and len(got) == 120
    assert np.mean([r["neighbour_id"] in truth[r["vec_id"] // 100] for r in got]) > 0.9
