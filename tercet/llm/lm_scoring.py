"""Log-probabilities of texts' words under a log-bilinear neural model.

Words are runs of characters other than ASCII blanks and controls, in lower case. The vocabulary is the `vocabulary` words that are most
frequent in the whole corpus, counted in a shuffle, and `buckets` classes that share the rest by their hash; a special sign
stands before a text's first word. The model predicts a word w of the two before it, v and u:

    score(w | u, v) = (A r_u + B r_v) . q_w + b_w,   p(w | u, v) = exp score / sum over all words of exp score

It is trained by noise-contrastive estimation in numpy, with the words' frequencies as noise. Each task goes once through all the text of
its partition, from the same start; the models that result are averaged, weighted by their words, in a two-level reduction
by blocks of parameters. A task sends a fixed number of bytes, a small part of what it reads. What a task reads, and so the model, follows
the files' layout: the same files give the same scores, others of the same rows nearly the same.

Scoring is exact: scores of words in contexts and the normalising sums come from batched matrix products. A pair of context words' sum is kept once it is known.

With the corpus' word counts, probabilities are over words: a word of a bucket has the bucket's probability times its own share of it,
n(word) / n(bucket). Counts of any number of words are joined in shards by hash: a shuffle brings the words of texts, packed, to their
shard's counts, and a second one the sums to their texts. Without them, probabilities are over the vocabulary and the buckets.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHasher, reduce_partitions, written
from .quality import words_of

BLOCKS, FAN = 16, 64
NAMES = ("r", "q", "b", "a1", "a2")


@dataclass
class Vocabulary:
    words: np.ndarray  # hashes, ascending
    ids: np.ndarray  # of these
    buckets: int
    log_noise: np.ndarray  # log of each id's frequency
    held: np.ndarray  # the words that each bucket holds, counted as often as they occur

    def __len__(self) -> int:
        return len(self.words) + self.buckets

    def encoded(self, hashes: np.ndarray) -> np.ndarray:
        rest = (len(self.words) + (hashes >> np.uint64(40)) % np.uint64(self.buckets)).astype(np.int32)
        if not len(self.words):
            return rest
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        return np.where(self.words[at] == hashes, self.ids[at], rest)


def triples(words: np.ndarray, begins: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """The id two before each, and the id one before each; `start` beyond a text's beginning."""
    u, v = np.full(len(words), start, np.int32), np.full(len(words), start, np.int32)
    v[1:], u[2:] = words[:-1], words[:-2]
    first = begins[:-1][begins[:-1] < begins[1:]]
    v[first] = u[first] = start
    second = first + 1
    u[second[second < len(words)]] = start
    return u, v


def counts_of(docs: DataFrame) -> DataFrame:
    """(word, n) for each word of docs, by its hash."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            words, counts = (np.concatenate(x) for x in zip(*held))
            values, where = np.unique(words, return_inverse=True)
            return values, np.bincount(where, counts, len(values)).astype(np.int64)

        def out(values: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(counts)], ["word", "n"])

        size = 0
        for batch in batches:
            for words, _ in words_of(batch.column(0), hasher):
                held.append(np.unique(words, return_counts=True))
                size += len(held[-1][0])
            if size > 1 << 21:
                held = [merged()]
                size = len(held[0][0])
                if size > 1 << 20:
                    yield out(*held[0])
                    held, size = [], 0
        if held:
            yield out(*merged())

    return docs.select("text").where("text is not null").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def vocabulary_of(docs: DataFrame, vocabulary: int, buckets: int, counts: DataFrame | None = None) -> Vocabulary:
    """The words of docs that are most frequent; of equally frequent ones those of least hash."""
    counts = counts_of(docs) if counts is None else counts

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of a partition's words the most frequent ones, and what each bucket holds in all (of those, `word` is null)."""
        top, held = (np.zeros(0, np.int64), np.zeros(0, np.int64)), np.zeros(buckets)
        for batch in batches:
            word, n = (c.to_numpy() for c in batch.columns)
            held += np.bincount(((word.view(np.uint64) >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64), n, buckets)
            word, n = np.concatenate([top[0], word]), np.concatenate([top[1], n])
            order = np.lexsort((word, -n))[:vocabulary]
            top = word[order], n[order]
        words, n = np.append(top[0], np.zeros(buckets, np.int64)), np.append(top[1], held.astype(np.int64))
        of = np.append(np.full(len(top[0]), -1), np.arange(buckets))
        yield pa.RecordBatch.from_arrays([pa.array(words, mask=of >= 0), pa.array(of, pa.int32()), pa.array(n)], ["word", "bucket", "n"])

    sums = written(counts.mapInArrow(summed, "word long, bucket int, n long"))
    top = sums.where("bucket < 0").orderBy(F.desc("n"), "word").limit(vocabulary).collect()
    held = np.zeros(buckets)
    for row in sums.where("bucket >= 0").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        held[row["bucket"]] = row["n"]
    for row in top:
        held[(row["word"] % 2**64 >> 40) % buckets] -= row["n"]
    n = np.append(np.array([r["n"] for r in top], float), held) + 0.5
    words = np.array([r["word"] for r in top], np.int64).view(np.uint64)
    order = np.argsort(words)
    return Vocabulary(words[order], order.astype(np.int32), buckets, np.log(n / n.sum()), held)


def first_parameters(vocab: Vocabulary, size: int, seed: int) -> dict[str, np.ndarray]:
    """What training starts from: small vectors, and the words' frequencies."""
    rng, n = np.random.default_rng(seed), len(vocab)
    return {
        "r": rng.normal(0, 0.3, (n + 1, size)).astype(np.float32), "q": rng.normal(0, 0.1, (n, size)).astype(np.float32), "b": vocab.log_noise.astype(np.float32),
        "a1": (0.5 * np.eye(size)).astype(np.float32), "a2": np.eye(size).astype(np.float32),
    }


def _scattered(rows: int, ids: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids that occur, and the sums of their values."""
    order = np.argsort(ids, kind="stable")
    own = ids[order]
    cuts = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
    return own[cuts], np.add.reduceat(values[order], cuts, axis=0)


class Trainer:
    """Noise-contrastive estimation with Adagrad."""

    def __init__(self, p: dict[str, np.ndarray], vocab: Vocabulary, noise: int, rate: float, seed: int) -> None:
        self.p = {k: v.copy() for k, v in p.items()}
        self.squares = {k: np.full(v.shape, 1e-3, np.float32) for k, v in p.items()}
        self.noise, self.rate, self.rng = noise, rate, np.random.default_rng(seed)
        self.cumulative = np.cumsum(np.exp(vocab.log_noise))
        self.offset = (vocab.log_noise + np.log(noise)).astype(np.float32)

    def _moved(self, name: str, gradient: np.ndarray, ids: np.ndarray | None = None) -> None:
        p, s = self.p[name], self.squares[name]
        if ids is None:
            s += gradient * gradient
            p -= self.rate * gradient / np.sqrt(s)
        else:
            s[ids] += gradient * gradient
            p[ids] -= self.rate * gradient / np.sqrt(s[ids])

    def step(self, u: np.ndarray, v: np.ndarray, w: np.ndarray) -> None:
        p = self.p
        noise = np.minimum(np.searchsorted(self.cumulative, self.rng.random(self.noise) * self.cumulative[-1]), len(self.offset) - 1)
        ru, rv, qw, qn = p["r"][u], p["r"][v], p["q"][w], p["q"][noise]
        context = ru @ p["a1"].T + rv @ p["a2"].T
        real = 1 / (1 + np.exp(np.clip(self.offset[w] - p["b"][w] - (context * qw).sum(1), -30, 30))) - 1
        fake = 1 / (1 + np.exp(np.clip((self.offset - p["b"])[noise] - context @ qn.T, -30, 30)))
        scale = np.float32(1 / len(w) ** 0.5)
        real, fake = (real * scale)[:, None], fake * scale
        back = real * qw + fake @ qn
        du, dv = back @ p["a1"], back @ p["a2"]
        ids, dq = _scattered(len(p["q"]), np.concatenate([w, noise]), np.concatenate([np.concatenate([real * context, real], 1), np.concatenate([fake.T @ context, fake.sum(0)[:, None]], 1)]))
        a1, a2 = back.T @ ru, back.T @ rv
        self._moved("q", dq[:, :-1], ids)
        self._moved("b", dq[:, -1], ids)
        self._moved("a1", a1)
        self._moved("a2", a2)
        ids, dr = _scattered(len(p["r"]), np.concatenate([u, v]), np.concatenate([du, dv]))
        self._moved("r", dr, ids)

    def learn(self, u: np.ndarray, v: np.ndarray, w: np.ndarray, batch: int) -> None:
        order = self.rng.permutation(len(w))
        for i in range(0, len(w), batch):
            at = order[i : i + batch]
            self.step(u[at], v[at], w[at])


def trained(docs: DataFrame, *, vocabulary: int = 1472, buckets: int = 64, size: int = 32, noise: int = 32, rate: float = 0.1, batch: int = 2048, chunk: int = 1 << 18, seed: int = 5, counts: DataFrame | None = None) -> Model:
    """The model of all the texts of docs, whose word counts may be given."""
    spark = docs.sparkSession
    vocab = vocabulary_of(docs, vocabulary, buckets, counts)
    start = first_parameters(vocab, size, seed)
    shared = spark.sparkContext.broadcast((vocab, start))
    shapes = {k: v.shape for k, v in start.items()}
    schema = "block int, task int, weight double, values binary"

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, start = shared.value
        task = TaskContext.get().partitionId()
        trainer, hasher = Trainer(start, vocab, noise, rate, seed + 1 + task), WordHasher()
        held: list[tuple[np.ndarray, ...]] = []
        waiting = seen = 0
        for arrow in batches:
            for words, begins in words_of(arrow.column(0), hasher):
                ids = vocab.encoded(words)
                held.append((*triples(ids, begins, len(vocab)), ids))
                waiting += len(ids)
                if waiting >= chunk:
                    trainer.learn(*(np.concatenate(x) for x in zip(*held)), batch)
                    held, seen, waiting = [], seen + waiting, 0
        if waiting:
            trainer.learn(*(np.concatenate(x) for x in zip(*held)), batch)
            seen += waiting
        if seen:
            parts = np.array_split(np.concatenate([trainer.p[k].ravel() for k in NAMES]).astype(np.float64) * seen, BLOCKS)
            yield pa.RecordBatch.from_arrays([pa.array(range(BLOCKS), pa.int32()), pa.array([task] * BLOCKS, pa.int32()), pa.array([float(seen)] * BLOCKS), pa.array([x.astype("<f4").tobytes() for x in parts], pa.binary())], ["block", "task", "weight", "values"])

    def add(batches: Iterator[pa.RecordBatch], fan: int) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], list] = {}
        for arrow in batches:
            for b, t, n, x in zip(*(c.to_pylist() for c in arrow.columns)):
                own = sums.setdefault((b, t % fan), [0.0, 0.0])
                own[0] += n
                own[1] = own[1] + np.frombuffer(x, "<f4").astype(np.float64)
        for (b, t), (n, x) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([t], pa.int32()), pa.array([n]), pa.array([x.astype("<f4").tobytes()], pa.binary())], ["block", "task", "weight", "values"])

    n = reduce_partitions(spark)
    own = docs.select("text").where("text is not null").mapInArrow(learn, schema)
    sums = own.repartition(n, "block", F.pmod("task", F.lit(FAN))).sortWithinPartitions("block", "task").mapInArrow(lambda b: add(b, FAN), schema)
    sums = sums.repartition(n, "block").sortWithinPartitions("block", "task").mapInArrow(lambda b: add(b, 1), schema)
    blocks: dict[int, list] = {b: [0.0, 0.0] for b in range(BLOCKS)}
    for row in sums.collect():  # one a block
        blocks[row["block"]][0] += row["weight"]
        blocks[row["block"]][1] = blocks[row["block"]][1] + np.frombuffer(row["values"], "<f4").astype(np.float64)
    if not blocks[0][0]:
        return Model(vocab, start)
    flat, out, at = np.concatenate([x / w for w, x in blocks.values()]).astype(np.float32), {}, 0
    for k in NAMES:
        count = int(np.prod(shapes[k]))
        out[k] = flat[at : at + count].reshape(shapes[k])
        at += count
    return Model(vocab, out)


class Model:
    """The trained parameters. What scoring needs is made in the worker, and kept there."""

    def __init__(self, vocab: Vocabulary, p: dict[str, np.ndarray]) -> None:
        self.vocab, self.p = vocab, p
        self.ready = False

    def __getstate__(self) -> tuple:
        return self.vocab, self.p

    def __setstate__(self, state: tuple) -> None:
        self.__init__(*state)

    def prepare(self) -> None:
        if not self.ready:
            n = len(self.vocab)
            self.far, self.near = self.p["r"] @ self.p["a1"].T, self.p["r"] @ self.p["a2"].T
            self.by_far, self.by_near = self.far @ self.p["q"].T, self.near @ self.p["q"].T + self.p["b"]
            self.sums = np.full((n + 1) * (n + 1), np.nan, np.float32)
            self.ready = True

    def log_probabilities(self, u: np.ndarray, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        self.prepare()
        n = len(self.vocab)
        context = u.astype(np.int64) * (n + 1) + v
        new = np.unique(context[np.isnan(self.sums[context])])
        for i in range(0, len(new), 512):
            own = new[i : i + 512]
            scores = (self.far[own // (n + 1)] + self.near[own % (n + 1)]) @ self.p["q"].T + self.p["b"]
            most = scores.max(1, keepdims=True)
            scores -= most
            np.exp(scores, out=scores)
            self.sums[own] = np.log(scores.sum(1)) + most[:, 0]
        return self.by_far[u, w].astype(np.float64) + self.by_near[v, w] - self.sums[context]


def score(docs: DataFrame, model: Model, counts: DataFrame | None = None) -> DataFrame:
    """(doc_id, n_words, log_prob, mean_log_prob) for each row of docs, repeated ones and those with a null doc_id too.

    With `counts`, those that the model's vocabulary is of, the probabilities are over words. A word that wasn't counted has half an
    occurrence in its bucket. A null or empty text has no words, a log-probability of 0 and a null mean. Columns other than doc_id and text
    aren't read. No shuffle without counts.
    """
    if counts is not None:
        return _score_words(docs, model, counts)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, hasher = shared.value, WordHasher()
        for batch in batches:
            counts, totals = [], []
            for words, begins in words_of(batch.column(1), hasher):
                ids = model.vocab.encoded(words)
                sums = np.append(0.0, np.cumsum(model.log_probabilities(*triples(ids, begins, len(model.vocab)), ids)))
                counts.append(np.diff(begins))
                totals.append(np.diff(sums[begins]))
            n, total = (np.concatenate(x) if x else np.zeros(0) for x in (counts, totals))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n.astype(np.int64)), pa.array(total, pa.float64()), pa.array(total / np.maximum(n, 1), pa.float64(), mask=n == 0)], ["doc_id", "n_words", "log_prob", "mean_log_prob"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_words long, log_prob double, mean_log_prob double")


def _score_words(docs: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """The scores over words. What shuffles has three kinds: a shard's counts (0), a piece's words of buckets (1) and a piece's texts (2)."""
    spark = docs.sparkSession
    shared, n = spark.sparkContext.broadcast(model), reduce_partitions(spark)
    #: Some 2**20 words a shard: what a task holds doesn't grow.
    shards = max(n, -(-counts.count() // (1 << 20)))
    schema = "shard int, kind int, piece long, rows binary, numbers binary"
    names = ["shard", "kind", "piece", "rows", "numbers"]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names)

    def by_shard(words: np.ndarray, values: np.ndarray, kind: int, piece: int) -> list[tuple]:
        own = (words % np.uint64(shards)).astype(np.int64)
        order = np.argsort(own, kind="stable")
        own, words, values = own[order], words[order], values[order]
        cuts = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(own) else []
        return [(int(own[a]), kind, piece, values[a:b].tobytes(), words[a:b].tobytes()) for a, b in zip(cuts, [*cuts[1:], len(own)])]

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            word, count = (c.to_numpy() for c in batch.columns)
            if len(word):
                yield batch_of(by_shard(word.view(np.uint64), count.astype(np.int64), 0, -1))

    def classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, hasher = shared.value, WordHasher()
        vocab, piece = model.vocab, TaskContext.get().partitionId() << 32
        held = np.append(np.zeros(len(vocab.words)), np.log(vocab.held + 0.5))
        for batch in batches:
            at = 0
            for words, begins in words_of(batch.column(1), hasher):
                ids, k = vocab.encoded(words), len(begins) - 1
                sums = np.append(0.0, np.cumsum(model.log_probabilities(*triples(ids, begins, len(vocab)), ids)))
                lengths = np.diff(begins)
                doc_ids = batch.column(0).slice(at, k)
                rare = np.flatnonzero(ids >= len(vocab.words))
                #: The bucket's words count with the sum: what is joined is log n(word) alone.
                inside = np.append(0.0, np.cumsum(held[ids]))
                texts = np.stack([doc_ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), doc_ids.is_null().to_numpy(zero_copy_only=False).astype(np.int64), lengths.astype(np.int64)])
                out = by_shard(words[rare], np.repeat(np.arange(k, dtype=np.int32), lengths)[rare], 1, piece)
                yield batch_of([*out, (piece % shards, 2, piece, texts.tobytes(), (np.diff(sums[begins]) - np.diff(inside[begins])).tobytes())])
                at, piece = at + k, piece + 1

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held, words, logs = None, [], np.zeros(0, np.uint64), np.zeros(0)
        for batch in batches:
            out = []
            for s, kind, piece, rows, numbers in zip(*(c.to_pylist() for c in batch.columns)):
                if s != shard:
                    shard, held, words, logs = s, [], np.zeros(0, np.uint64), np.zeros(0)
                if kind == 0:
                    held.append((np.frombuffer(numbers, np.uint64), np.frombuffer(rows, np.int64)))
                elif kind == 2:
                    out.append((s, kind, piece, rows, numbers))
                else:
                    if held:
                        words, count = (np.concatenate(x) for x in zip(*held))
                        order, held = np.argsort(words), []
                        words, logs = words[order], np.log(count[order])
                    own, of = np.frombuffer(numbers, np.uint64), np.frombuffer(rows, np.int32)
                    found = np.minimum(np.searchsorted(words, own), max(len(words) - 1, 0))
                    log_n = np.where(words[found] == own, logs[found], np.log(0.5)) if len(words) else np.full(len(own), np.log(0.5))
                    texts, sums = _scattered(0, of, log_n)
                    out.append((s, kind, piece, texts.tobytes(), sums.tobytes()))
            if out:
                yield batch_of(out)

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, texts = None, [], None

        def result() -> pa.RecordBatch:
            (doc_ids, null, lengths), total = np.frombuffer(texts[0], np.int64).reshape(3, -1), np.frombuffer(texts[1], np.float64).copy()
            for rows, numbers in held:
                total[np.frombuffer(rows, np.int32)] += np.frombuffer(numbers, np.float64)
            return pa.RecordBatch.from_arrays([pa.array(doc_ids, mask=null > 0), pa.array(lengths), pa.array(total), pa.array(total / np.maximum(lengths, 1), mask=lengths == 0)], ["doc_id", "n_words", "log_prob", "mean_log_prob"])

        for batch in batches:
            for _, kind, piece, rows, numbers in zip(*(c.to_pylist() for c in batch.columns)):
                if piece != at:
                    if texts:
                        yield result()
                    at, held, texts = piece, [], None
                if kind == 2:
                    texts = rows, numbers
                else:
                    held.append((rows, numbers))
        if texts:
            yield result()

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(classes, schema)
    # Within a piece shards come in order, so that its sums are the same in each run.
    sums = counts.select("word", "n").mapInArrow(packed, schema).unionByName(own).repartition(n, "shard").sortWithinPartitions("shard", "kind").mapInArrow(joined, schema)
    return sums.repartition(n, "piece").sortWithinPartitions("piece", "shard").mapInArrow(added, "doc_id long, n_words long, log_prob double, mean_log_prob double")
