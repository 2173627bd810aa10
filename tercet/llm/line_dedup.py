"""Removal of repeated lines.

A line is what lies between two newline characters. Of all lines with the same characters, over
the whole corpus, the first stays: that of the least doc_id, then of the least position. Blank
lines (spaces, tabs, carriage returns, form feeds only) are left as they are, and so are lines of fewer
than `min_words` words, if that is more than one.

How: each task enters hashes of its lines in two Bloom filters, one for what it has seen and one
for what it has seen again. The filters are cut into segments and packed; a shuffle brings the
packed segments together, and a bit is in the merged second filter if a task's second filter
has it or the first filters of two tasks have it. Every line that occurs twice is in the merged filter. Only lines found
there shuffle, with their text, to be confirmed and to choose the first occurrence. The places to remove are broadcast
to the documents if they are few enough; else the documents that have a suspect shuffle to them, and no others.

The filters have about `bits_per_byte` bits a byte of text, up to `most_bits`: beyond that more lines are
suspected and shuffle, and the result is the same.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, is_small, reduce_partitions, sized, written

BLANK = " \t\r\f\v"
SEGMENT_BITS = 1 << 20
#: A line that occurs more often is heavy.
HEAVY = 100_000


def _eligible(line: str, min_words: int) -> bool:
    if min_words > 1:
        return len(line.split(None, min_words - 1)) >= min_words
    return bool(line.strip(BLANK))


def _lines(text: str | None, min_words: int) -> list[tuple[int, str]]:
    return [] if text is None else [(i, x) for i, x in enumerate(text.split("\n")) if _eligible(x, min_words)]


def _hashes(texts: pa.Array, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all eligible lines, and each text's number of them."""
    h = xxhash.xxh3_64_intdigest
    found = [[h(x) for _, x in _lines(t, min_words)] for t in texts.to_pylist()]
    return np.array([x for f in found for x in f], np.uint64), np.array([len(f) for f in found], np.int64)


def _bits(hashes: np.ndarray, n_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two positions for each hash; n_bits is a power of two."""
    low = np.uint64(n_bits - 1)
    return (hashes & low).astype(np.int64), ((hashes >> np.uint64(32)) * np.uint64(0x9E3779B1) + (hashes >> np.uint64(17)) & low).astype(np.int64)


def filters_of(hashes: np.ndarray, n_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions in the filter of lines seen, and in that of lines seen again, for a task's lines."""
    values, counts = np.unique(hashes, return_counts=True)
    once = np.concatenate(_bits(values, n_bits))
    twice = np.concatenate(_bits(values[counts > 1], n_bits))
    return np.unique(once), np.unique(twice)


def _packed(positions: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """Ascending positions as packed segments."""
    segment = positions // SEGMENT_BITS
    cuts = np.flatnonzero(np.diff(segment)) + 1
    for part in np.split(positions, cuts):
        if len(part):
            yield int(part[0] // SEGMENT_BITS), zlib.compress(np.diff(part % SEGMENT_BITS, prepend=0).astype(np.uint32).tobytes(), 1)


def _unpacked(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(data), np.uint32).astype(np.int64))


def suspected_filter(docs: DataFrame, n_bits: int, min_words: int) -> np.ndarray:
    """The merged filter of lines seen twice, as bytes of n_bits // 8."""
    schema = "segment long, twice boolean, bits binary"

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = [_hashes(b.column(0), min_words)[0] for b in batches]
        once, twice = filters_of(np.concatenate(held) if held else np.zeros(0, np.uint64), n_bits)
        rows = [(s, False, z) for s, z in _packed(once)] + [(s, True, z) for s, z in _packed(twice)]
        if rows:
            a, b, c = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.bool_()), pa.array(c, pa.binary())], ["segment", "twice", "bits"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: dict[int, np.ndarray] = {}
        for batch in batches:
            for s, t, z in zip(*(c.to_pylist() for c in batch.columns)):
                seen = count.setdefault(s, np.zeros(SEGMENT_BITS, np.uint8))
                at = _unpacked(z)
                seen[at] = np.minimum(seen[at] + (2 if t else 1), 2)
        for s, seen in count.items():
            at = np.flatnonzero(seen >= 2)
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array([s], pa.int64()), pa.array([True]), pa.array([zlib.compress(np.diff(at, prepend=0).astype(np.uint32).tobytes(), 1)], pa.binary())], ["segment", "twice", "bits"])

    local = docs.select("text").mapInArrow(build, schema)
    merged = local.repartition(reduce_partitions(docs.sparkSession), "segment").mapInArrow(merge, schema)
    packed = np.zeros(n_bits // 8, np.uint8)
    for row in merged.toLocalIterator():
        bits = np.zeros(SEGMENT_BITS, bool)
        bits[_unpacked(row["bits"])] = True
        packed[row["segment"] * (SEGMENT_BITS // 8) :][: SEGMENT_BITS // 8] = np.packbits(bits, bitorder="little")
    return packed


def dedup_lines(docs: DataFrame, *, min_words: int = 1, bits_per_byte: float = 0.125, most_bits: int = 1 << 32, drop_emptied: bool = False) -> DataFrame:
    """docs, each text without the lines that occur before it in the corpus.

    A null text stays null and an empty one empty. A null doc_id comes before all others; rows
    with equal doc_id and text share their lines' fate, so the first of them keep theirs alike.
    Columns other than doc_id and text pass through; a column n_chars, if there is one, becomes
    the new length. With `drop_emptied`, a document of whose lines some were removed and none but
    blank ones stay goes; one that was empty before stays. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    n_bytes = docs.select(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    n_bits = SEGMENT_BITS
    while n_bits < min(n_bytes * bits_per_byte, most_bits):
        n_bits *= 2
    shared = spark.sparkContext.broadcast(zlib.compress(suspected_filter(docs, n_bits, min_words).tobytes(), 1))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
        bits = np.frombuffer(zlib.decompress(shared.value), np.uint8)
        for batch in batches:
            hashes, counts = _hashes(batch.column(batch.schema.get_field_index("text")), min_words)
            hit = np.ones(len(hashes), bool)
            for at in _bits(hashes, n_bits):
                hit &= (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
            yield batch, np.split(hit, np.cumsum(counts)[:-1]) if len(counts) else []

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, hits in probe(batches):
            ids, copies, texts = (batch.column(i).to_pylist() for i in range(3))
            rows = [(d, c, i, x) for d, c, t, h in zip(ids, copies, texts, hits) if h.any() for (i, x), y in zip(_lines(t, min_words), h) if y]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int32(), pa.string()))], ["doc_id", "copy", "at", "line"])

    def with_suspects(wanted: bool):  # noqa: ANN202
        def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, hits in probe(batches):
                yield batch.filter(pa.array([bool(h.any()) == wanted for h in hits], pa.bool_()))

        return chosen

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, gone = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("text", its_gone))
            kept, new = [], []
            for t, g in zip(texts, gone):
                if g:
                    drop = set(g)
                    t = "\n".join(x for i, x in enumerate(t.split("\n")) if i not in drop)
                kept.append(not (g and drop_emptied and not t.strip(BLANK + "\n")))
                new.append(t)
            arrays = {"text": pa.array(new, pa.string())}
            if has_length:
                arrays["n_chars"] = pa.array([None if t is None else len(t) for t in new], batch.schema.field("n_chars").type)
            yield pa.RecordBatch.from_arrays([arrays.get(f.name, c) for f, c in zip(batch.schema, batch.columns)][:-1], names=columns).filter(pa.array(kept, pa.bool_()))

    columns = docs.columns
    its_id, its_copy, its_gone, its_key = fresh(docs, "__id", "__copy", "__gone", "__key")
    has_length = dict(docs.dtypes).get("n_chars") in ("int", "bigint")
    # Rows that share a doc_id are told apart by a hash of their text.
    keyed = docs.select("doc_id", F.xxhash64("text").alias("copy"), "text")
    found = written(keyed.mapInArrow(suspects, "doc_id long, copy long, at int, line string"))
    place = F.struct("doc_id", "copy", "at")
    firsts = written(found.groupBy("line").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1"))
    # A line of very many occurrences, of which there are few, isn't brought to one task.
    heavy = sized(firsts.where(F.col("n") > HEAVY), 1000)
    repeats = found.join(heavy.select("line"), "line", "left_anti").join(firsts, "line").unionByName(found.join(heavy, "line"))
    gone = repeats.where(place != F.col("first")).groupBy(F.col("doc_id").alias(its_id), F.col("copy").alias(its_copy)).agg(F.collect_set("at").alias(its_gone))
    gone = written(gone)
    same = F.col("doc_id").eqNullSafe(F.col(its_id)) & (F.col(its_key) == F.col(its_copy))
    if is_small(gone, 100):
        clean, mixed, side = None, docs, F.broadcast(gone)
    else:
        clean, mixed, side = docs.mapInArrow(with_suspects(False), docs.schema), docs.mapInArrow(with_suspects(True), docs.schema), gone.hint("shuffle_merge")
    joined = mixed.withColumn(its_key, F.xxhash64("text")).join(side, same, "left").select(*docs.columns, its_gone).mapInArrow(rebuild, docs.schema)
    return joined if clean is None else clean.unionByName(joined)


def oracle(min_words: int = 1) -> str:
    return f"""
with lines as (
  select doc_id, lang, source, unnest(string_split(text, chr(10))) as line,
         unnest(range(len(string_split(text, chr(10))))) as pos
  from documents
), marked as (
  select *, len(string_split(trim(regexp_replace(line, '\\s+', ' ', 'g'), ' '), ' ')) >= {min_words} as eligible,
         row_number() over (partition by line order by doc_id, pos) as nth
  from lines
), joined as (
  select doc_id, lang, source, coalesce(string_agg(line, chr(10) order by pos) filter (where not eligible or nth = 1), '') as text
  from marked group by all
)
select doc_id, text, lang, source, length(text) as n_chars from joined"""
