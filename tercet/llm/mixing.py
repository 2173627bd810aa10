"""Mixing sources to target weights by pivotal dependent rounding.

A source's target is its share of the budget; a document's expected number of copies is the
target divided by the source's documents. The whole part is sure. The fractional parts are
rounded dependently, so that a source's copies add up to its target (rounded up or down where the
target isn't whole) and every document keeps its expectation.

A pivotal duel takes two documents with fractions a and b. With a + b <= 1, one gets a + b and the
other 0, the first with probability a / (a + b); else one gets 1 and the other a + b - 1, the first with
probability (1 - b) / (2 - a - b). One fate is sealed in each duel. Within a cell (a source and a
bucket of its documents' hashes) the duels run one after another and leave one residual at most;
residuals of `fan` cells meet in a further round, and so on up a reduction tree until one
is left for a source, which a draw settles. All draws come from hashes of the seed and the document's
id, so a task that is run again decides alike.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, mix, reduce_partitions, sized, written

SCHEMA = "source string, doc_id long, cell long, fraction double, settled int"
CELL = 50_000


def uniforms(ids: np.ndarray, seed: int, level: int) -> np.ndarray:
    """A number in [0, 1) for each id."""
    with np.errstate(over="ignore"):
        h = mix(mix(ids.astype(np.int64).view(np.uint64) + np.uint64(seed * 0x9E3779B97F4A7C15 % 2**64)) + np.uint64(level))
    return (h >> np.uint64(11)).astype(np.float64) / 2**53


def duels(fractions: list[float], draws: list[float]) -> tuple[list[int], int, float]:
    """Each unit's 0 or 1, or -1 for the one that is left; which is left (-1: none); its fraction."""
    out = [-1] * len(fractions)
    held, p = -1, 0.0
    for i, (q, u) in enumerate(zip(fractions, draws)):
        if q <= 1e-9 or q >= 1 - 1e-9:
            out[i] = int(q > 0.5)
            continue
        if held < 0:
            held, p = i, q
            continue
        total = p + q
        if total <= 1:
            loser, held = (i, held) if u * total < p else (held, i)
            out[loser], p = 0, total
        else:
            winner, held = (held, i) if u * (2 - total) < 1 - q else (i, held)
            out[winner], p = 1, total - 1
        if p <= 1e-9 or p >= 1 - 1e-9:
            out[held], held = int(p > 0.5), -1
    return out, held, p


def _round(units: DataFrame, seed: int, level: int) -> DataFrame:
    """Duels within each (source, cell); what is settled, and one residual (settled null) at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def decided(rows: pa.Table) -> pa.RecordBatch:
            ids = rows.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
            fractions = rows.column("fraction").to_pylist()
            fates, held, p = duels(fractions, uniforms(ids, seed, level).tolist())
            if held >= 0:
                fractions[held] = p
            return pa.RecordBatch.from_arrays(
                [*(rows.column(i).combine_chunks() for i in range(3)), pa.array(fractions, pa.float64()), pa.array([None if f < 0 else f for f in fates], pa.int32())], ["source", "doc_id", "cell", "fraction", "settled"]
            )

        # Rows come sorted by source, cell; a group may go on in the next batch.
        rest: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if rest is None else pa.concat_tables([rest, table])
            codes = table.column("source").combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
            cells = table.column("cell").to_numpy()
            edges = np.concatenate([[0], np.flatnonzero((np.diff(codes) != 0) | (np.diff(cells) != 0)) + 1]) if table.num_rows else np.zeros(1, int)
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
                yield decided(table.slice(a, b - a))
            rest = table.slice(int(edges[-1]))
        if rest is not None and rest.num_rows:
            yield decided(rest)

    n = reduce_partitions(units.sparkSession)
    ordered = units.repartition(n, "source", "cell").sortWithinPartitions("source", "cell", "doc_id")
    return ordered.select("source", "doc_id", "cell", "fraction").mapInArrow(run, SCHEMA)


def copies(docs: DataFrame, weights: Mapping[str, float] | None = None, *, power: float = 0.5, budget: float = 1.0, seed: int = 17, fan: int = 256) -> DataFrame:
    """(doc_id, source, copies) for each distinct doc_id.

    weights: each source's part, in any unit; sources that aren't named get none. Without it, a
    source's weight is its number of characters to `power`. The budget is a multiple of the number of documents.
    A null source is named ''. Of rows that repeat a doc_id one counts, that of least source. A
    null doc_id is one document. An empty table gives no rows.
    """
    spark = docs.sparkSession
    units = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("source", F.lit("")).alias("source"), F.coalesce(F.char_length("text"), F.lit(0)).cast("long").alias("size"))
    units = written(units.groupBy("doc_id").agg(F.min(F.struct("source", "size")).alias("u")).select("doc_id", "u.*"))
    sizes = units.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    if weights is None:
        sizes = sizes.withColumn("wanted", F.pow(F.greatest("size", F.lit(1)).cast("double"), F.lit(power)))
    else:
        named = spark.createDataFrame([(k, float(v)) for k, v in weights.items()], "source string, wanted double")
        sizes = sizes.join(named, "source", "left").withColumn("wanted", F.coalesce("wanted", F.lit(0.0)))
    sizes = written(sizes)
    total, n_docs, most = sizes.agg(F.sum("wanted"), F.sum("n"), F.max("n")).first()
    part = budget * n_docs / total if total else 0.0
    rate = sizes.select("source", (F.col("wanted") * part / F.col("n")).alias("rate"), F.ceil(F.col("n") / CELL).alias("cells"))
    cell = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.col("cells"))
    spread = units.join(sized(rate, 64), "source").select("source", "doc_id", cell.alias("cell"), (F.col("rate") - F.floor("rate")).alias("fraction"))
    settled, level, cells = [], 0, -(-(most or 1) // CELL)
    while True:
        done = written(_round(spread, seed, level))
        settled.append(done.where("settled is not null").select("doc_id", "settled"))
        spread = done.where("settled is null").withColumn("cell", F.floor(F.col("cell") / fan)).drop("settled")
        if cells == 1:
            break
        cells, level = -(-cells // fan), level + 1
    draw = F.pmod(F.xxhash64("doc_id", F.lit(seed), F.lit("last")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    settled.append(spread.select("doc_id", (draw < F.col("fraction")).cast("int").alias("settled")))
    rounded = settled[0]
    for s in settled[1:]:
        rounded = rounded.unionByName(s)
    rounded = rounded.select(F.col("doc_id").alias("__id"), "settled")
    out = units.join(sized(rate, 64), "source").join(rounded, F.col("doc_id").eqNullSafe(F.col("__id")))
    return out.select("doc_id", "source", (F.floor("rate") + F.col("settled")).cast("long").alias("copies"))


def mixed(docs: DataFrame, weights: Mapping[str, float] | None = None, **options: float) -> DataFrame:
    """docs with a column copies (of that name, it replaces docs' own); documents of no copies go. Rows that repeat a doc_id, or have
    none, have the copies that copies() gives to that id; null and empty texts count as of no characters. An empty table gives an empty one."""
    its_id, its_copies = fresh(docs, "__id", "__copies")
    plan = written(copies(docs, weights, **options).where("copies > 0").select(F.col("doc_id").alias(its_id), F.col("copies").alias(its_copies)))
    own = [c for c in docs.columns if c != "copies"]
    return docs.join(sized(plan, 16), F.col("doc_id").cast("long").eqNullSafe(F.col(its_id))).select(*own, F.col(its_copies).alias("copies"))
