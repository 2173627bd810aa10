"""Quality by the perplexity of an n-gram model of trusted text.

The model is an interpolated modified Kneser-Ney trigram model of lower-case words, trained on documents
labelled as of good quality: all those of one half, by a hash of their ids.
Shuffles shard the trigrams by their middle words, a share at a time; all counts that a word's probability takes, but its own, are in the part of
the word before it. The parts are written to the shared folder, and every document is scored whole, where it lies: for each BLOCK words a task reads
the parts from there, one at a time. The corpus isn't shuffled, and neither the driver nor a worker holds more of the model than a part and the words' own
probabilities. The reading grows with the corpus times the trusted text.

A document's perplexity is exp of the mean of -log p over its words, from a sentence start before the first. A language's threshold is the
quantile `quantile` of the perplexities of all its trusted documents of the other half; a language with
fewer than `least` of them has the threshold of all together.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import pyarrow.parquet as pq
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHasher, as_buffer, mix, pieces, reduce_partitions, released, sized, written
from .jaccard import BATCH, strewn

START = np.uint64(1)


def words_of(texts: pa.Array, hasher: WordHasher) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashed words, and where each text's begin, of the texts in turn, many at a time."""
    data, offsets = as_buffer(pc.utf8_lower(texts))
    for a, b in pieces(offsets):
        yield hasher(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])


def contexts(words: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each word the one two before, and the one before; START beyond a text's beginning."""
    u, v = np.full(len(words), START), np.full(len(words), START)
    v[1:], u[2:] = words[:-1], words[:-2]
    first = begins[:-1][begins[:-1] < begins[1:]]
    v[first] = u[first] = START
    second = first + 1
    u[second[second < len(words)]] = START
    return u, v


def key2(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mix(mix(v) + w)


def key3(u: np.ndarray, v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mix(key2(u, v) + w)


class Table:
    """Values by 64-bit keys. A key's place is sought from where its leading bits begin."""

    def __init__(self, keys: np.ndarray, *values: np.ndarray) -> None:
        order = np.argsort(keys, kind="stable")
        self.keys = np.append(keys[order], ~np.uint64(0))
        self.values = [np.append(v[order], np.nan).astype(np.float32) for v in values]
        self.bits = np.uint64(64 - max(1, len(keys).bit_length()))
        self.begin = np.searchsorted(self.keys[:-1], np.arange(1 << (64 - int(self.bits)), dtype=np.uint64) << self.bits).astype(np.int32)

    def places(self, keys: np.ndarray) -> np.ndarray:
        """Where each key is; the last place, whose values are missing, if it isn't here."""
        at = self.begin[(keys >> self.bits).astype(np.int64)]
        out = np.full(len(keys), len(self.keys) - 1, np.int32)
        left = np.arange(len(keys))
        while len(left):
            here = self.keys[at]
            found = here == keys
            out[left[found]] = at[found]
            on = here < keys
            left, keys, at = left[on], keys[on], at[on] + 1
        return out


def stowed(a: np.ndarray) -> bytes:
    """An array's bytes, those of equal significance together, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes())


def fetched(x: bytes, kind: type) -> np.ndarray:
    whole = np.frombuffer(zstandard.ZstdDecompressor().decompress(x), np.uint8)
    return np.ascontiguousarray(whole.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def found(keys: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the asked keys are among the ascending ones, and where those are."""
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    here = np.flatnonzero(keys[at] == asked)
    return here, at[here]


@dataclass
class Model:
    """Counts by the middle word, in files of which one part at a time is read; the words' own probabilities."""

    unknown: float = 1.0  # the probability of a word never seen
    one: Table = field(default_factory=lambda: Table(np.zeros(0, np.uint64), np.zeros(0)))
    d2: np.ndarray = field(default_factory=lambda: np.zeros(4))
    d3: np.ndarray = field(default_factory=lambda: np.zeros(4))
    parts: int = 1
    files: list[str] = field(default_factory=list)

    def shards(self) -> Iterator[tuple[int, list[np.ndarray]]]:
        for file in self.files:
            system, path = pa.fs.FileSystem.from_uri(file)
            for batch in pq.read_table(path, filesystem=system, partitioning=None).to_batches(max_chunksize=1):
                part, *columns = (c[0].as_py() for c in batch.columns)
                yield part, [fetched(x, kind) for x, kind in zip(columns, KINDS)]

    def probabilities(self, words: np.ndarray, begins: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            u, v = contexts(words, begins)
            p = np.nan_to_num(self.one.values[0][self.one.places(words)].astype(float), nan=self.unknown)
            part = (mix(v) % np.uint64(self.parts)).astype(np.int32)
            order = np.argsort(part, kind="stable")
            cuts = np.searchsorted(part[order], np.arange(self.parts + 1))
            del part
            for i, (k1, t1, g1, k2, c2, e2, t2, g2, k3, c3) in self.shards():
                at = order[cuts[i] : cuts[i + 1]]
                if not len(at):
                    continue
                own, w = p[at], words[at]
                here, x = found(k1, v[at])
                own[here] *= g1[x]
                total = np.ones(len(at))
                total[here] = t1[x]
                here, x = found(k2, key2(v[at], w))
                own[here] += (c2[x] - self.d2[np.minimum(c2[x], 3)]) / total[here]
                pair = key2(u[at], v[at])
                here, x = found(e2, pair)
                own[here] *= g2[x]
                total[here] = t2[x]
                here, x = found(k3, mix(pair + w))
                own[here] += (c3[x] - self.d3[np.minimum(c3[x], 3)]) / total[here]
                p[at] = own
        return p


def _discounts(n: list[int]) -> np.ndarray:
    """The discounts of the counts 1, 2 and 3 or more, at their places; n: the numbers of counts 1 to 4."""
    y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
    return np.array([0.0, *(min(max((k + 1) - (k + 2) * y * n[k + 1] / n[k], 0.1), k + 0.9) if n[k] else 0.5 * (k + 1) for k in range(3))])


def _of_counts(c: np.ndarray) -> list[int]:
    return np.bincount(np.minimum(c, 5), minlength=6)[1:5].tolist()


def grouped(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that sorts by the keys, the last first, and where groups of equal keys begin in it."""
    order = np.lexsort(keys)
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    return order, np.flatnonzero(new)


class Shard:
    """Trigrams (u, v, w), each once, with their counts c: all of those whose middle words are of the shard."""

    def __init__(self, u: np.ndarray, v: np.ndarray, w: np.ndarray, c: np.ndarray) -> None:
        order, cuts = grouped(w, u, v)
        self.u, self.v, self.w = u[order][cuts], v[order][cuts], w[order][cuts]
        self.c = np.add.reduceat(c[order], cuts) if len(cuts) else c
        self.by_pair, self.pairs = grouped(self.w, self.v)
        first = self.by_pair[self.pairs]
        self.pair_v, self.pair_w = self.v[first], self.w[first]
        # A pair's count is the number of words before it; at a text's start, where there is but one, that of its occurrences.
        sizes = np.diff(np.append(self.pairs, len(self.w)))
        self.pair_k = np.where(self.pair_v == START, np.add.reduceat(self.c[self.by_pair], self.pairs) if len(self.pairs) else sizes, sizes)

    @staticmethod
    def contexts(k: np.ndarray, cuts: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The total of each group's counts, and the share that its discounts free."""
        total = np.add.reduceat(k, cuts)
        return total, np.add.reduceat(d[np.minimum(k, 3)], cuts) / total

    def tables(self, d2: np.ndarray, d3: np.ndarray) -> list[np.ndarray]:
        """By ascending keys: of single words as contexts total and share freed, of pairs counts, of pairs as contexts total and share freed, of trigrams counts."""
        cuts = np.flatnonzero(np.append(True, self.pair_v[1:] != self.pair_v[:-1]))
        ends = np.flatnonzero(np.append(True, (self.v[1:] != self.v[:-1]) | (self.u[1:] != self.u[:-1])))
        out: list[np.ndarray] = []
        for keys, *values in (
            (self.pair_v[cuts], *self.contexts(self.pair_k, cuts, d2)),
            (key2(self.pair_v, self.pair_w), self.pair_k),
            (key2(self.u[ends], self.v[ends]), *self.contexts(self.c, ends, d3)),
            (key3(self.u, self.v, self.w), self.c),
        ):
            order = np.argsort(keys)
            out += [keys[order], *(x[order] for x in values)]
        return [x.astype(kind) for x, kind in zip(out, KINDS)]


#: What Shard.tables() gives, and a part of the model has in its row.
KINDS = [np.uint64, np.int64, np.float64, np.uint64, np.int64, np.uint64, np.int64, np.float64, np.uint64, np.int64]
#: So many times the training text is read, and a share of its trigrams shuffles, whose files then go.
SHARES = 4
#: Words that are scored with one reading of the model.
BLOCK = 1 << 21


def trained(docs: DataFrame) -> Model:
    """The model of the texts of docs, all of them.

    A shuffle brings all trigrams of a middle word together, and with them the pairs that begin with it and the pairs that end with
    it as contexts. It is done twice, a share of the words at a time: for the numbers of counts and the words' own counts, and for the model's parts, which are written and not collected."""
    spark = docs.sparkSession
    parts = SHARES * reduce_partitions(spark)

    def count(batches: Iterator[pa.RecordBatch], share: int) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            for words, begins in words_of(batch.column(0), hasher):
                with np.errstate(over="ignore"):
                    u, v = contexts(words, begins)
                    own = mix(v) % np.uint64(parts) % np.uint64(SHARES) == share
                    u, v, w = u[own], v[own], words[own]
                    _, first, c = np.unique(key3(u, v, w), return_index=True, return_counts=True)
                    yield strewn(v[first], parts, u[first], v[first], w[first], c.astype(np.uint64))

    def gathered_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Shard]]:
        held: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for part, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held.setdefault(part, []).append(np.frombuffer(x, np.uint64).reshape(-1, 4))
        for part in list(held):
            u, v, w, c = np.concatenate(held.pop(part)).T.copy()
            yield part, Shard(u, v, w, c.astype(np.int64))

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Kind 0: words and how many different ones precede them; 3 and 2: the numbers of trigrams' and pairs' counts."""
        for _, s in gathered_shards(batches):
            w, n = np.unique(s.pair_w, return_counts=True)
            for kind, key, k in ((0, w.view(np.int64), n), (3, np.arange(4), np.array(_of_counts(s.c))), (2, np.arange(4), np.array(_of_counts(s.pair_k)))):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), kind, np.int8)), pa.array(key, pa.int64()), pa.array(k, pa.int64())], ["kind", "w", "k"])

    def stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d2, d3 = shared.value
        for part, s in gathered_shards(batches):
            with np.errstate(over="ignore"):
                tables = s.tables(d2, d3)
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), *(pa.array([stowed(x)], pa.binary()) for x in tables)], ["part", *(f"x{i}" for i in range(len(KINDS)))])

    texts = docs.select("text").where("text is not null")

    def sent(share: int) -> DataFrame:
        return texts.mapInArrow(released(partial(count, share=share)), "part long, packed binary").repartition(reduce_partitions(spark), "part")

    counts = [written(sent(i).mapInArrow(released(numbers), "kind byte, w long, k long").groupBy("kind", "w").agg(F.sum("k").alias("k")), BATCH) for i in range(SHARES)]
    # What is collected grows with the different words of docs, not with their n-grams.
    rows = written(reduce(DataFrame.union, counts).groupBy("kind", "w").agg(F.sum("k").alias("k"))).toArrow()
    kind, key, k = (rows.column(i).to_numpy() for i in range(3))
    if not len(key):
        return Model()
    d2, d3 = (_discounts(k[kind == i][np.argsort(key[kind == i])].tolist()) for i in (2, 3))
    words, k = key[kind == 0].view(np.uint64), k[kind == 0]
    d1 = _discounts(_of_counts(k))
    unknown = d1[np.minimum(k, 3)].sum() / k.sum() / (len(k) + 1)
    p1 = Table(words, (k - d1[np.minimum(k, 3)]) / k.sum() + unknown)
    shared = spark.sparkContext.broadcast((d2, d3))
    schema = "part long, " + ", ".join(f"x{i} binary" for i in range(len(KINDS)))
    files = [f for i in range(SHARES) for f in written(sent(i).mapInArrow(released(stored), schema), BATCH).inputFiles()]
    return Model(float(unknown), p1, d2, d3, parts, files)


def blocks(texts: pa.Array, hasher: WordHasher) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """What words_of() gives, about BLOCK words at a time."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for last in (False, True):
        for piece in words_of(texts, hasher) if not last else [None]:
            if piece is not None:
                held.append(piece)
            starts = np.cumsum([0, *(len(w) for w, _ in held)])
            if held and (last or starts[-1] >= BLOCK):
                yield np.concatenate([w for w, _ in held]), np.concatenate([*(b[:-1] + a for (_, b), a in zip(held, starts)), starts[-1:]])
                held = []


def perplexities(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang, n_words, perplexity) for each row of docs; of a text without words the perplexity is null."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, hasher = shared.value, WordHasher()
        for batch in batches:
            counts, means = [], []
            for words, begins in blocks(batch.column(2), hasher):
                n = np.diff(begins)
                sums = np.append(0.0, np.cumsum(-np.log(model.probabilities(words, begins))))
                counts.append(n)
                means.append(np.where(n > 0, np.diff(sums[begins]) / np.maximum(n, 1), np.nan))
            n, mean = (np.concatenate(x) if x else np.zeros(0) for x in (counts, means))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n.astype(np.int64)), pa.array(np.exp(mean), pa.float64(), mask=n == 0)], ["doc_id", "lang", "n_words", "perplexity"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text").mapInArrow(released(run), "doc_id long, lang string, n_words long, perplexity double")


def score(docs: DataFrame, labels: DataFrame, *, quantile: float = 0.99, least: int = 30) -> DataFrame:
    """(doc_id, lang, n_words, perplexity, threshold, keep) for each row of docs, repeated ones and those with a null doc_id too.

    labels: (doc_id, quality); rows with a null on either side don't count, and a doc_id that is repeated is trusted if one of its labels is 1. A null or empty text
    has no words, a null perplexity and isn't kept. Without trusted documents nothing is known against a text: the perplexity is 1, the threshold null, and all
    texts with words are kept. A null language is one of its own. The model is trained on all trusted documents of one half,
    by a hash of their ids, and the thresholds come of all those of the other. An empty table gives no rows.
    """
    trusted = labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("__id")).distinct()
    half = F.pmod(F.xxhash64("__id", F.lit(1)), F.lit(2))
    chosen, held = (written(trusted.where(half == i)) for i in (0, 1))
    model = trained(docs.join(sized(chosen, 8), docs["doc_id"] == chosen["__id"], "left_semi"))
    scored = written(perplexities(docs, model))
    own = scored.where("perplexity is not null").join(sized(held, 8), F.col("doc_id") == F.col("__id"), "left_semi")
    level = F.percentile("perplexity", F.lit(quantile)).alias("threshold")
    everywhere = own.agg(level).first()["threshold"]
    by = own.groupBy(F.col("lang").alias("__lang")).agg(level, F.count("*").alias("n")).where(F.col("n") >= least).select("__lang", F.col("threshold").alias("own"))
    joined = scored.join(F.broadcast(by), F.col("lang").eqNullSafe(F.col("__lang")), "left")  # a row a language
    threshold = F.coalesce("own", F.lit(everywhere).cast("double"))
    return joined.select("doc_id", "lang", "n_words", "perplexity", threshold.alias("threshold"), F.coalesce(F.col("perplexity") <= threshold, F.col("perplexity").isNotNull()).alias("keep"))
