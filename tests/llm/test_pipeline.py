import random

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from tercet.llm.common import released, written
from tests.llm import brute_pipeline
from tests.llm.test_jaccard import parts_of_longer_texts, without_a_least_hash_in_common


@pytest.fixture(scope="module")
def tables(spark, make, prose, tmp_path_factory):
    r, folder = random.Random(31), tmp_path_factory.mktemp("sf")
    bad = ["zvukrat", "gorblix", "snarfk", "wixxom", "krelpho", "vadruum"]
    texts = ["\n".join(t[k : k + 70].strip() for k in range(0, len(t), 70)) for t in prose(300, 30, 30, 90)]
    items = prose(8, 33, 20, 30)
    toxic = [i % 4 == 0 for i in range(300)]
    for i, y in enumerate(toxic):
        if y:
            texts[i] += "\n" + " ".join(r.choice(bad) for _ in range(8))
        elif i % 17 == 1:
            texts[i] += "\n" + items[i % 8]
        elif i % 13 == 1:
            texts[i] = texts[i - 1 if not toxic[i - 1] else i - 2].replace(" ", "  ", 3) + "\nand a line at the end"
        elif i % 11 == 1:
            texts[i] += "\na line that many of the documents have"
    rows = [(i, t, "en", f"s{i % 5}") for i, t in enumerate(texts)] + [(None, "a null id with words", "en", None), (900, None, None, None), (901, "", "en", "s1"), (902, texts[5], "en", "s2"), (902, texts[5], "en", "s2")]
    make(rows).coalesce(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, int(y)) for i, y in enumerate(toxic)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), rows, toxic, items


def test_against_brute_force(spark, tables):
    folder, rows, toxic, items = tables
    got = sorted(((r["doc_id"], r["text"], r["source"], r["n_chars"]) for r in corpus_pipeline.run(spark, folder).where("copies > 0").collect()), key=repr)
    kept = brute_pipeline.run(rows, toxic, items)
    before_mixing = sorted({(d, t, s) for d, t, s in kept}, key=repr)
    assert {g[:3] for g in got} <= set(before_mixing) and 0 < len(got)
    assert all(n == (None if t is None else len(t)) for _, t, _, n in got)


def test_stages_keep_columns_and_chain(spark, tables):
    folder, rows, toxic, items = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, folder)
        assert docs.columns[: len(columns)] == columns
        assert (docs.columns == columns) == (k + 1 < len(corpus_pipeline.STAGES)), name
        if k + 1 < len(corpus_pipeline.STAGES):
            docs = spark.createDataFrame(docs.collect(), docs.schema)
            if k == 3:
                left = sorted(((r["doc_id"], r["text"], r["source"]) for r in docs.collect()), key=repr)
                assert left == sorted(brute_pipeline.run(rows, toxic, items), key=repr)
    total = docs.agg({"copies": "sum"}).first()[0]
    assert abs(total - len({d for d, _, _ in left})) <= 5


def test_empty_and_odd_tables(spark, odd, make, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for docs in (odd, make([])):
        n = docs.count()
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, str(tmp_path))
            assert out.columns == docs.columns and out.count() == n
        assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() <= n


def test_near_duplicates_without_a_least_hash_in_common(spark, make, prose):
    a, b = without_a_least_hash_in_common()
    docs = make([*prose(5, 3), b, a])
    assert sorted(r["doc_id"] for r in corpus_pipeline.keep_one_of_near_duplicates(spark, docs, "").collect()) == list(range(6))


def test_parts_of_longer_texts_are_near_duplicates(spark, make):
    docs = make(parts_of_longer_texts())
    assert sorted(r["doc_id"] for r in corpus_pipeline.keep_one_of_near_duplicates(spark, docs, "").collect()) == list(range(0, 300, 2))


def test_workers_get_few_rows_at_once_and_give_memory_back(spark, make, prose):
    """Beside an executor's heap, whole texts in large batches and what idle workers keep took it beyond its memory."""
    key, docs = "spark.sql.execution.arrow.maxRecordsPerBatch", make(prose(300, 40)).coalesce(1)
    before = spark.conf.get(key)

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], ["n"])

    out = [r["n"] for r in written(docs.mapInArrow(released(sizes), "n long"), 100).collect()]
    assert sum(out) == 300 and max(out) == 100 and spark.conf.get(key) == before

    def kept(batches):
        held = [np.ones(1000) for _ in range(20_000)]
        del held[1:-1:2]
        yield from batches

    def resident(batches):
        yield pa.RecordBatch.from_arrays([pa.array([int(open("/proc/self/statm").read().split()[1]) * 4096])], ["n"])

    least = [released(f)(iter([])) for f in (resident, kept, resident)]
    (a,), _, (b,) = (list(x) for x in least)
    assert b.column(0)[0].as_py() - a.column(0)[0].as_py() < 32 << 20
