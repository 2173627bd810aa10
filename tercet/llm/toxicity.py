"""Toxicity by compression distance: a dictionary trained on toxic text against one on ordinary text.

For each language with enough labels, and for all together, two zstandard dictionaries are trained on windows
of several words of labelled documents: one on windows of ordinary documents, one on those windows of
toxic documents that hold a telling run. A run of RUN bytes is telling if the log-likelihood ratio between
its shares of toxic and of ordinary documents is at least `least_ratio`, and the one share at least LIFT times
the other: most of a toxic document is ordinary language, which would fill its dictionary otherwise. The two
end the same base of ordinary text, and are equally long, so that both code ordinary language alike.

Each document's words (bytes other than ASCII letters and digits and those above 127 part them; lower case)
are covered by overlapping windows of WORDS words, and a window is compressed with both dictionaries. Its
gain is the bytes by which the toxic code is the shorter, less `slack`, if that is above 0. A window
without any run of RUN bytes that only the toxic dictionary has can save nothing by it; its gain is 0 and it isn't compressed.
A document's score is its windows' total gain divided by (20 + number of windows) ** 0.6, so that long texts
need more than one slip. It is toxic if the score reaches the threshold: that of greatest F1 on labelled documents, scored with
dictionaries that were trained on the others: every second of either kind is held out for that.

A language with fewer than `least_toxic` toxic labelled documents, and a null or unseen one, has the dictionaries and the threshold of
all together, and so has one that no score of its own tells apart.

At most `sample` labelled documents of `sample_bytes` in all are used for the fit, those of least hash, up to three
tenths of them toxic (rates of sampling enter the thresholds); all documents are scored, whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_buffer, least_hashed, normalised_buffer, pieces, written

WORDS, STRIDE = 6, 3
RUN = 5
LIFT = 3.0
LEVEL = 12
AROUND = 1
#: These bytes don't occur in UTF-8 text. ANCHOR precedes each window and ends what both dictionaries have in common, so that each window
#: is coded as a compressed block; TAIL follows it, and END a dictionary, as the compressor looks for no matches there.
ANCHOR, TAIL, END = bytes([0xF8, 0xF9, 0xFA, 0xFB] * 4), bytes(range(1, 13)), bytes(range(0xF8, 0x100)) * 2
TABLE_BITS, SLOT_BITS = 20, 22


def runs_of(data: np.ndarray) -> np.ndarray:
    """Each run of RUN bytes as a number; the i-th begins at i."""
    n = max(len(data) - RUN + 1, 0)
    out = np.zeros(n, np.uint64)
    for j in range(RUN):
        out <<= np.uint64(8)
        out |= data[j : j + n]
    return out


class Runs:
    """A set of runs that long texts are looked through for."""

    def __init__(self, runs: np.ndarray) -> None:
        self.runs = np.unique(runs)
        self.table = np.zeros(1 << TABLE_BITS, bool)
        self.table[self.slots(self.runs)] = True

    @staticmethod
    def slots(runs: np.ndarray) -> np.ndarray:
        return ((runs * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)

    def found(self, data: np.ndarray, step: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
        """Where one of them begins, and its index."""
        at, which = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if len(self.runs):
            for begin in range(0, len(data), step):
                runs = runs_of(data[begin : begin + step + RUN - 1])
                likely = np.flatnonzero(self.table[self.slots(runs)])
                k = np.minimum(np.searchsorted(self.runs, runs[likely]), len(self.runs) - 1)
                sure = self.runs[k] == runs[likely]
                at.append(likely[sure] + begin)
                which.append(k[sure])
        return np.concatenate(at), np.concatenate(which)


def _ratio(a: np.ndarray, n: int, b: np.ndarray, m: int) -> np.ndarray:
    """The log-likelihood ratio for a of n against b of m, negative if a / n is the less."""

    def term(k: np.ndarray, n: int, p: np.ndarray) -> np.ndarray:
        return k * np.log(np.maximum(p, 1e-300)) + (n - k) * np.log(np.maximum(1 - p, 1e-300))

    p = (a + b) / (n + m)
    out = 2 * (term(a, n, a / n) + term(b, m, b / m) - term(a, n, p) - term(b, m, p))
    return np.where(a / n > b / m, out, -out)


def telling_runs(toxic: Sequence[np.ndarray], ordinary: Sequence[np.ndarray], least_ratio: float) -> Runs:
    """The runs that tell the toxic texts from the ordinary ones."""
    n, m = len(toxic), len(ordinary)
    # Counted by slots first, so that no more is held than the runs that may tell.
    slots = np.zeros(1 << SLOT_BITS, np.int32)
    slot = lambda runs: ((runs * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
    for x in toxic:
        slots[np.unique(slot(runs_of(x)))] += 1
    # The ratio grows with the count.
    likely = slots >= np.argmax(np.append(_ratio(np.arange(n + 1), n, np.zeros(1), m) >= least_ratio, True))
    runs = np.zeros(0, np.uint64)
    for at in range(0, n, 64):
        some = [runs_of(x) for x in toxic[at : at + 64]]
        runs = np.unique(np.concatenate([runs, *(r[likely[slot(r)]] for r in some)]))
    both = Runs(runs)

    def documents(texts: Sequence[np.ndarray]) -> np.ndarray:
        """In how many of the texts each run is."""
        counts = np.zeros(len(both.runs))
        for x in texts:
            counts[np.unique(both.found(x)[1])] += 1
        return counts

    counts, other = documents(toxic), documents(ordinary)
    return Runs(both.runs[(_ratio(counts, n, other, m) >= least_ratio) & (counts / n >= LIFT * other / m)])


def windows_of(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A normalised text's windows: where each begins and ends, at a space each."""
    spaces = np.flatnonzero(data == 32)
    words = len(spaces) - 1
    if words < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.arange(0, max(1, words - WORDS + STRIDE), STRIDE)
    return spaces[first], spaces[np.minimum(first + WORDS, words)] + 1


def trained(samples: list[bytes], size: int) -> bytes:
    """The content of a dictionary trained on the samples, of a quarter of their bytes at most, or 512: there is a header of some 100."""
    size = max(512, min(size, sum(map(len, samples)) // 4))
    try:
        return zstandard.train_dictionary(size, samples, k=16, d=6).as_bytes()
    except zstandard.ZstdError:  # so few that their own bytes are as good
        return b"".join(samples)[-size:]


def compressor(content: bytes) -> zstandard.ZstdCompressor:
    shared = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    options = zstandard.ZstdCompressionParameters.from_level(LEVEL, source_size=128, dict_size=len(content), write_content_size=False, write_dict_id=False, write_checksum=False)
    shared.precompute_compress(compression_params=options)
    return zstandard.ZstdCompressor(dict_data=shared, compression_params=options)


@dataclass
class Dictionaries:
    """What both have in common, what each ends with, and the bytes of a gain that don't count."""

    base: bytes
    ordinary: bytes
    toxic: bytes
    slack: int = 0


class Gains:
    """Scores texts with a pair of dictionaries. Made in the worker."""

    def __init__(self, own: Dictionaries) -> None:
        self.slack = own.slack
        ordinary, toxic = own.base + ANCHOR + own.ordinary, own.base + ANCHOR + own.toxic
        self.ordinary, self.toxic = compressor(ordinary + END), compressor(toxic + END)
        new, old = (np.unique(runs_of(np.frombuffer(x, np.uint8))) for x in (own.toxic, ordinary))
        self.only = Runs(np.setdiff1d(new, old))

    def gains(self, data: np.ndarray) -> tuple[np.ndarray, int]:
        """The gains above 0 of a normalised text's windows, and the number of all windows."""
        begins, ends = windows_of(data)
        hits = self.only.found(data)[0]
        if not len(hits) or not len(begins):
            return np.zeros(0), len(begins)
        # A window holds a run if it begins no later than the run and ends no sooner.
        low, high = np.searchsorted(ends, hits + RUN, "left"), np.searchsorted(begins, hits, "right")
        chosen = np.unique(np.concatenate([np.arange(a, b) for a, b in zip(low.tolist(), high.tolist())] + [np.zeros(0, np.int64)]).astype(np.int64))
        texts = [ANCHOR + data[a:b].tobytes() + TAIL for a, b in zip(begins[chosen].tolist(), ends[chosen].tolist())]
        saved = np.array([len(self.ordinary.compress(x)) - len(self.toxic.compress(x)) for x in texts])
        return saved[saved > 0], len(begins)

    def score(self, data: np.ndarray) -> float:
        return total_gain(*self.gains(data), self.slack)


def total_gain(saved: np.ndarray, windows: int, slack: int) -> float:
    return float(np.maximum(saved - slack, 0).sum()) / (20 + windows) ** 0.6


@dataclass
class ToxicityModel:
    """Dictionaries and thresholds by language; those under None are of all languages together."""

    dictionaries: dict[str | None, Dictionaries] = field(default_factory=dict)
    thresholds: dict[str | None, float] = field(default_factory=dict)

    def key(self, lang: str | None) -> str | None:
        return lang if lang in self.dictionaries else None


class Scorer:
    """Scores and judges texts. Made in the worker; a language's compressors are when it first occurs."""

    def __init__(self, model: ToxicityModel) -> None:
        self.model = model
        self.gains: dict[str | None, Gains] = {}

    def score(self, data: np.ndarray, lang: str | None) -> tuple[float, bool]:
        key = self.model.key(lang)
        if key not in self.model.dictionaries:
            return 0.0, False
        if key not in self.gains:
            self.gains[key] = Gains(self.model.dictionaries[key])
        score = self.gains[key].score(data)
        return score, score >= self.model.thresholds[key]

    def batch(self, texts: pa.Array, langs: pa.Array) -> tuple[list[float], list[bool]]:
        scores, toxic, names = [], [], langs.to_pylist()
        for at, data in enumerate(normalised(texts)):
            score, said = self.score(data, names[at])
            scores.append(score)
            toxic.append(said)
        return scores, toxic


def normalised(texts: pa.Array) -> Iterator[np.ndarray]:
    """Each text's words, a space before and after each."""
    _, offsets = as_buffer(texts)
    for a, b in pieces(offsets, 1 << 22):
        data, begins = normalised_buffer(texts.slice(a, b - a))
        yield from (data[x:y] for x, y in zip(begins[:-1].tolist(), begins[1:].tolist()))


def calibrated(scores: np.ndarray, labels: np.ndarray, weights: np.ndarray | None = None) -> tuple[float, float]:
    """The threshold of greatest F1, midway between two scores, and that F1; infinite and 0 if no score is above 0. weights: how many rows a row stands for."""
    weights = np.ones(len(scores)) if weights is None else weights
    order = np.argsort(-scores, kind="stable")
    ranked, hit = scores[order], (labels * weights)[order]
    f1 = 2 * np.cumsum(hit) / np.maximum(np.cumsum(weights[order]) + hit.sum(), 1e-9)
    last = np.append(ranked[1:] != ranked[:-1], True) & (ranked > 0)
    if not last.any():
        return math.inf, 0.0
    best = int(np.argmax(np.where(last, f1, -1)))
    return float((ranked[best] + (ranked[best + 1] if best + 1 < len(order) else 0)) / 2), float(f1[best])


def _dictionaries(texts: list[np.ndarray], labels: np.ndarray, *, base_size: int, toxic_sizes: Sequence[int], least_ratio: float) -> list[Dictionaries]:
    """Pairs of each size; none if the texts are all toxic or all ordinary, or if nothing tells them apart."""
    toxic, ordinary = [x for x, y in zip(texts, labels) if y], [x for x, y in zip(texts, labels) if not y]
    if not toxic or not ordinary:
        return []
    telling = telling_runs(toxic, ordinary, least_ratio)
    chosen, plain = [], []
    for data in toxic:
        spaces = np.flatnonzero(data == 32)
        hits = telling.found(data)[0]
        # The words of a run, and AROUND more on either side; those that meet make one passage.
        low = np.maximum(np.searchsorted(spaces, hits, "right") - 1 - AROUND, 0)
        high = np.minimum(np.searchsorted(spaces, hits + RUN - 1, "left") + AROUND, len(spaces) - 1)
        new = np.append(True, low[1:] >= np.maximum.accumulate(high)[:-1]) if len(hits) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        chosen += [data[spaces[a] : spaces[b] + 1].tobytes() for a, b in zip(low[first].tolist(), np.maximum.reduceat(high, first).tolist() if len(first) else [])]
    if not chosen:
        return []
    # Each ordinary document gives its share of what the base is chosen from, 32 times its size.
    part = min(1.0, 32 * base_size / sum(map(len, ordinary)))
    for data in ordinary:
        begins, ends = windows_of(data)
        begins, ends = begins[::2], ends[::2]
        at = np.unique(np.linspace(0, max(len(begins) - 1, 0), int(np.ceil(part * len(begins)))).astype(int))
        plain += [data[begins[i] : ends[i]].tobytes() for i in at.tolist()]
    base = trained(plain[::2], base_size)
    # A trained dictionary has what recurs; where that doesn't fill the base, windows as they are do.
    rest = b"".join(plain[::2])[: base_size - len(base)]
    pairs = {len(own): own for size in toxic_sizes if (own := trained(chosen, size))}
    return [Dictionaries(rest + base, trained(plain[1::2] or plain, size), own) for size, own in pairs.items()]


def fit(rows: list[tuple[str, str | None, bool]], weights: tuple[float, float] = (1.0, 1.0), *, slacks: Sequence[int] = (0, 1, 2), base_size: int = 1 << 16, toxic_sizes: Sequence[int] = (2048, 1024, 512), least_ratio: float = 24.0, least_toxic: int = 20, least_f1: float = 0.5) -> ToxicityModel:
    """rows: (text, lang, toxic). weights: how many rows an ordinary and a toxic one stand for. Without
    rows of both kinds that something tells apart, nothing is toxic. Of the sizes and slacks those of greatest F1 are taken."""
    texts = [x.copy() for i in range(0, len(rows), 256) for x in normalised(pa.array([t for t, _, _ in rows[i : i + 256]], pa.large_string()))]
    labels = np.array([bool(y) for *_, y in rows])
    langs = [x for _, x, _ in rows]
    groups: dict[str | None, np.ndarray] = {None: np.arange(len(rows))}
    for lang in sorted({x for x in langs if x is not None}):
        at = np.array([i for i, x in enumerate(langs) if x == lang])
        if labels[at].sum() >= least_toxic:
            groups[lang] = at
    model = ToxicityModel()
    for lang, at in groups.items():
        held = np.zeros(len(at), bool)
        for kind in (False, True):
            held[np.flatnonzero(labels[at] == kind)[1::2]] = True
        known, rest = at[~held], at[held]
        best = 0.0
        for own in _dictionaries([texts[i] for i in known], labels[known], base_size=base_size, toxic_sizes=toxic_sizes, least_ratio=least_ratio):
            gains = Gains(own)
            saved = [gains.gains(texts[i]) for i in rest]
            for slack in slacks:
                scores = np.array([total_gain(x, n, slack) for x, n in saved])
                threshold, f1 = calibrated(scores, labels[rest].astype(float), np.where(labels[rest], weights[1], weights[0]))
                if f1 > best and f1 >= least_f1:
                    best, model.dictionaries[lang], model.thresholds[lang] = f1, replace(own, slack=slack), threshold
    return model


def model_of(docs: DataFrame, labels: DataFrame, *, sample: int = 10_000, sample_bytes: int = 32 << 20, **options: float) -> ToxicityModel:
    """The model of at most `sample` labelled documents of `sample_bytes` in all; rows without id, label or text don't count,
    and a doc_id labelled twice is toxic if one label says so. Empty tables give a model by which nothing is toxic."""
    chosen = labels.select(F.col("doc_id").alias("__id"), F.col("toxic").alias("__toxic")).dropna().groupBy("__id").agg(F.max(F.col("__toxic").cast("int")).alias("__toxic"))
    counts = {bool(r["__toxic"]): r["n"] for r in chosen.groupBy("__toxic").agg(F.count("*").alias("n")).collect()}
    most = {True: min(counts.get(True, 0), sample * 3 // 10)}
    most[False] = sample - most[True]
    both = least_hashed(chosen.where("__toxic <> 0"), "__id", most[True]).union(least_hashed(chosen.where("__toxic = 0"), "__id", most[False]))
    # Written: `both` is bounded by sample, and what joins it by that too, unless an id is repeated.
    kept = written(docs.select("doc_id", "text", "lang").join(F.broadcast(both), F.col("doc_id") == F.col("__id")).where("text is not null").select("doc_id", "text", "lang", "__toxic"))
    total = kept.agg(F.sum(F.octet_length("text")).alias("n"), F.count("*").alias("rows")).first()
    part = min(1.0, sample_bytes / max(total["n"] or 0, 1), sample / max(total["rows"], 1))
    rows = kept.where(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 20)) < int(part * (1 << 20)) if part < 1 else F.lit(True)).collect()
    rows.sort(key=lambda r: (hash((r["doc_id"], 7)), r["text"], r["lang"] or ""))
    weights = tuple(max(counts.get(kind, 0), 1) / max(min(counts.get(kind, 0), most[kind]), 1) for kind in (False, True))
    rows = [(r["text"], r["lang"], bool(r["__toxic"])) for r in rows]
    return fit(rows, weights, **options)


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """(doc_id, score, toxic) for each row of docs, repeated ones and those with a null doc_id too.
    A null, empty or blank text scores 0 and isn't toxic; a null language is scored as all languages together. An empty table gives no rows."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            scores, toxic = scorer.batch(batch.column(1), batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(toxic, pa.bool_())], ["doc_id", "score", "toxic"])

    return docs.select(F.col("doc_id").cast("long"), "text", "lang").mapInArrow(run, "doc_id long, score double, toxic boolean")


def without_toxic(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """The rows of docs, all columns, that aren't toxic; no shuffle. Each row is judged for itself: rows with a null id,
    with a null or empty text (never toxic) or a repeated id too. An empty table gives an empty table."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            texts, langs = (batch.column(batch.schema.get_field_index(c)) for c in ("text", "lang"))
            yield batch.filter(pa.array([not x for x in scorer.batch(texts, langs)[1]], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
