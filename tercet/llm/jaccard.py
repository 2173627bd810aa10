"""Documents whose sets of word n-grams have a Jaccard similarity of `threshold` or more: how many each has, and the group it is in.

Words are runs of characters other than ASCII blanks and controls, in lower case; a text shorter than
n words has one n-gram, of all its words. Documents with the same n-grams form a class, which is
joined once, by one of them.

1. Each class becomes a point: its n-grams are hashed to GROUPS groups, and the groups' counts are the
   coordinates. The overlap of two sets is at most the sum of the coordinates' minima, and a Jaccard
   similarity of t needs an overlap of t / (1 + t) times the two sizes.
2. One R-tree over a whole corpus would prune nothing across hundreds of millions of
   unrelated points, and no machine holds it. So points are routed by keys. All n-grams have one order: by hash, those that a sample
   shows to be in more than `hot` documents last. A set of s n-grams that has a similarity of t to another shares
   t * s of them at least, so the least that both have is among the first (1 - t) * s + 1 of either: these are its keys, and no pair
   is missed, whatever the order.
3. A pair counts at the least n-gram that both have. Every class also looks up its n-grams below a limit that is the same for all. A shuffle
   finds those that several classes have. With that, a class knows
   at each key how many n-grams it can have in common from there on with any other (those below the limit that others have, and
   all beyond it, since others needn't look those up), and leaves keys where that is too few. With each of its keys a class has labels:
   the least of its lesser keys, by several hashes. Classes of equal labels meet at a lesser key, and
   a key whose classes all have a label in common goes. That can't happen to the least key of a pair.
4. Each key that is left gets an R-tree of its own, packed by size and coordinates, and is joined with
   itself: node pairs whose boxes can't reach the overlap, or whose sizes are too far apart, are
   cut. A key that more than CELL classes have is split in a grid of cells, so that no task holds it whole.
5. A class that has a survivor in a cell sends one of its texts there. The same trees give the pairs again, which are verified exactly, on the
   n-grams of the whole texts, and never leave the cell: what comes out is each class's number of links and a spanning forest of
   the links.

Every pair of documents whose similarity is `threshold` or more is found.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHasher, alone, as_buffer, fresh, mix, ngram_hashes, pieces, reduce_partitions, released, sized, tables_written, written

GROUPS = 256
NODE = 32
CELL = 512
#: Pairs whose points are compared at once: the arrays take 12 MiB.
AT_ONCE = 1 << 12
#: Rows that go to a Python worker at once: whole texts of as many are several times in its memory and in its executor's.
BATCH = 1000
#: So many times the texts are read, and a share of their looked-up n-grams shuffles, whose files then go: the disk holds one share's at once.
SHARES = 2
#: The share of all n-grams that are below the limit, beyond the share that are keys. The more, the fewer classes are compared in vain.
EXTRA = 0.1
#: A class of more documents is heavy: its rows aren't shuffled to one task.
HEAVY = 100_000
#: Hashes that labels are made with, and the label of a class's least key.
LABELS = [np.uint64(x) for x in (0x2545F4914F6CDD1D, 0x9E6C63D0876A9A47, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0x8BB84B93962EACC9, 0x2D358DCCAA6C78A5, 0x4B33A62ED433D4A3, 0xAAAAAAAAAAAAAAAB)]
NONE = ~np.uint64(0)
CELLED = "cell long, key long, side_a boolean, side_b boolean, cid long, doc_id long, copy long, n long, size long, rest long, labels binary"


def sets_of(texts: pa.Array, n: int, hasher: WordHasher) -> Iterator[np.ndarray]:
    """Each text's n-grams as ascending hashes."""
    lower = pc.utf8_lower(texts)
    data, offsets = as_buffer(lower)
    for a, b in pieces(offsets):
        words, begins = hasher(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        yield from ngram_hashes(words, begins, n)


def point_of(grams: np.ndarray) -> np.ndarray:
    return np.bincount((grams & np.uint64(GROUPS - 1)).astype(np.int64), minlength=GROUPS)


def common_grams(docs: DataFrame, n: int, hot: int, sample: int = 10_000, most: int = 1 << 20) -> np.ndarray:
    """N-grams that seem to be in more than `hot` documents, by a sample of them. They come last in the order of keys: what is missing here, or here by chance, costs time and changes no result."""
    rows = docs.where("doc_id is not null and text is not null")
    total = rows.count()
    step = max(1, total // sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            sets = list(sets_of(batch.column(0), n, hasher))
            grams, counts = np.unique(np.concatenate(sets), return_counts=True) if sets else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64)), pa.array(counts, pa.int64())], ["gram", "n"])

    chosen = rows.where(F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(step)) == 0).select("text")
    counts = chosen.mapInArrow(released(run), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).where(F.col("n") > max(hot / step, min(hot, 4)))
    return np.sort(counts.orderBy(F.desc("n"), "gram").limit(most).select("gram").toArrow().column(0).to_numpy().view(np.uint64))


#: Ranks are no less: lesser numbers among them are of sets, their size and how many of their n-grams are below the limit.
FIRST_RANK = np.uint64(1 << 62)
HALF = np.uint64(31)


class Order:
    """Ranks of n-grams: hashes of 62 bits, those of common ones after all others."""

    def __init__(self, common: np.ndarray) -> None:
        self.common, self.maybe = common, np.zeros(1 << 22, bool)
        self.maybe[(common >> np.uint64(42)).astype(np.int64)] = True

    def __call__(self, grams: np.ndarray) -> np.ndarray:
        """The ranks of ascending hashes, ascending."""
        ranks = grams >> np.uint64(2) | FIRST_RANK
        at = np.flatnonzero(self.maybe[(grams >> np.uint64(42)).astype(np.int64)])
        if len(at):
            at = at[self.common[np.minimum(np.searchsorted(self.common, grams[at]), len(self.common) - 1)] == grams[at]]
            ranks[at] |= np.uint64(1 << 63)
        ranks.sort()
        return ranks


def limit(threshold: float) -> np.uint64:
    """The rank below which every n-gram is looked up among others'."""
    return FIRST_RANK + np.uint64(int(min(1.0, 1 - threshold + EXTRA) * (1 << 62)))


def looked_up(ranks: np.ndarray, threshold: float) -> np.ndarray:
    """Of ascending ranks, the keys and those below the limit; before them a number that has the set's size and how many are below the limit."""
    size, below = len(ranks), int(np.searchsorted(ranks, limit(threshold)))
    keys = min(size, math.floor(size * (1 - threshold) + 1e-6) + 1)
    return np.append(np.uint64(size << int(HALF) | below), ranks[: max(keys, below)])


def class_of(grams: np.ndarray) -> np.uint64:
    return mix(grams ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) + np.uint64(len(grams))


def sketches(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, copy, cid, size, point) of documents that have an id; of those without a word cid and point are null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            cids, sizes, points = [], [], []
            with np.errstate(over="ignore"):
                for s in sets_of(batch.column(2), n, hasher):
                    sizes.append(len(s))
                    cids.append(int(class_of(s).astype(np.int64)) if len(s) else None)
                    points.append(packed(point_of(s)) if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(points, pa.binary())], ["doc_id", "copy", "cid", "size", "point"])

    source = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("copy"), "text")
    return source.mapInArrow(released(run), "doc_id long, copy long, cid long, size long, point binary")


def need(a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """The least overlap of sets of the sizes a and b."""
    return threshold / (1 + threshold) * (a + b) - 1e-6


def tree_pairs(sizes: np.ndarray, points: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of the pairs that an R-tree's self-join can't rule out."""
    m = len(sizes)
    order = np.lexsort((points[:, 2], points[:, 1], points[:, 0] // 2, np.log2(sizes) // 0.25))
    levels = []  # from the leaves up: (boxes' upper corners, least sizes, greatest sizes)
    top, least, most = points[order], sizes[order].astype(float), sizes[order].astype(float)
    levels.append((top, least, most))
    while len(top) > NODE:
        cuts = np.arange(0, len(top), NODE)
        top, least, most = np.maximum.reduceat(top, cuts), np.minimum.reduceat(least, cuts), np.maximum.reduceat(most, cuts)
        levels.append((top, least, most))
    left, right = np.triu_indices(len(top))
    for depth in range(len(levels) - 1, -1, -1):
        top, least, most = levels[depth]
        keep_l, keep_r = [], []
        for at in range(0, len(left), AT_ONCE):
            a, b = left[at : at + AT_ONCE], right[at : at + AT_ONCE]
            near = (most[a] >= threshold * least[b] - 1e-9) & (most[b] >= threshold * least[a] - 1e-9)
            a, b = a[near], b[near]
            reach = np.minimum(top[a], top[b]).sum(1) >= need(least[a], least[b], threshold)
            keep_l.append(a[reach])
            keep_r.append(b[reach])
        left, right = np.concatenate(keep_l), np.concatenate(keep_r)
        if depth:  # down to the children
            n = len(levels[depth - 1][1])
            child = np.arange(NODE)
            a = np.repeat(left * NODE, NODE * NODE) + np.tile(np.repeat(child, NODE), len(left))
            b = np.repeat(right * NODE, NODE * NODE) + np.tile(np.tile(child, NODE), len(right))
            own = (a < n) & (b < n) & (a <= b)
            left, right = a[own], b[own]
    other = left < right
    return order[left[other]], order[right[other]]


def packed(point: np.ndarray) -> bytes:
    """A point's coordinates in half a byte each, or in one or four bytes if one is too great for that."""
    top = point.max()
    if top < 16:
        point = point.astype("u1")
        return (point[0::2] << 4 | point[1::2]).tobytes()
    return point.astype("u1" if top < 256 else "<u4").tobytes()


def counted(points: list[bytes]) -> np.ndarray:
    out = np.empty((len(points), GROUPS), np.int32)
    lengths = np.array([len(p) for p in points])
    for length, kind in ((GROUPS // 2, "u1"), (GROUPS, "u1"), (4 * GROUPS, "<u4")):
        at = np.flatnonzero(lengths == length)
        if len(at):
            values = np.frombuffer(b"".join([points[i] for i in at.tolist()]), kind).reshape(len(at), -1)
            out[at] = np.stack([values >> 4, values & 15], 2).reshape(len(at), GROUPS) if length < GROUPS else values
    return out


def whole_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by their first column, many cells at a time, none of them in parts."""
    rest: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if rest is None else pa.concat_tables([rest, table])
        last = int(begins_of(table.column(0).to_numpy())[-1]) if table.num_rows else 0
        if last:
            yield table.slice(0, last)
        rest = table.slice(last)
    if rest is not None and rest.num_rows:
        yield rest


def cells_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by their first column, cell by cell."""
    for table in whole_cells(batches):
        begins = begins_of(table.column(0).to_numpy()).tolist()
        for a, b in zip(begins, [*begins[1:], table.num_rows]):
            yield table.slice(a, b - a)


def cell_pairs(cells: pa.Table, points: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indexes of the pairs of each cell that neither the R-tree can rule out nor the number of n-grams that follow the key, less those that labels show
    to meet at a lesser key; in a cell of two sides, those across."""
    sizes, rest = cells.column("size").to_numpy(), cells.column("rest").to_numpy()
    left, right = (cells.column(c).to_numpy(zero_copy_only=False) for c in ("side_a", "side_b"))
    labels = np.frombuffer(b"".join(cells.column("labels").to_pylist()), np.uint64).reshape(len(sizes), -1)
    begins = begins_of(cells.column("cell").to_numpy())
    members = np.diff(np.append(begins, len(sizes)))

    def found() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for m in np.unique(members[(members > 1) & (members <= NODE)]).tolist():
            i, j = np.triu_indices(m, 1)
            at = begins[members == m][:, None]
            yield (at + i).ravel(), (at + j).ravel()
        for a, m in zip(begins[members > NODE].tolist(), members[members > NODE].tolist()):
            i, j = tree_pairs(sizes[a : a + m], points[a : a + m], threshold)
            yield a + i, a + j

    for i, j in found():
        for at in range(0, len(i), AT_ONCE):
            x, y = i[at : at + AT_ONCE], j[at : at + AT_ONCE]
            here = ((left[x] & right[y]) | (right[x] & left[y])) & (np.minimum(rest[x], rest[y]) >= need(sizes[x], sizes[y], threshold))
            x, y = x[here], y[here]
            here = ~((labels[x] == labels[y]) & (labels[x] != NONE)).any(1)
            x, y = x[here], y[here]
            here = np.minimum(points[x], points[y]).sum(1) >= need(sizes[x], sizes[y], threshold)
            yield x[here], y[here]


def strewn(at: np.ndarray, parts: int, *columns: np.ndarray) -> pa.RecordBatch:
    """Rows (part, packed): the columns' values, in bytes, that go to each part."""
    part = (mix(at) % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    names, cuts = np.unique(part[order], return_index=True)
    rows = np.stack([c[order] for c in columns], 1)
    return pa.RecordBatch.from_arrays([pa.array(names), pa.array([x.tobytes() for x in np.split(rows, cuts[1:])] if len(names) else [], pa.binary())], ["part", "packed"])


def gathered(batches: Iterator[pa.RecordBatch], width: int) -> np.ndarray:
    """All rows of a task that strewn() sent there, each once, in ascending order of their first two columns."""
    held = [np.frombuffer(p.as_buffer(), np.uint64).reshape(-1, width) for batch in batches for p in batch.column(1)]
    rows = np.concatenate(held) if held else np.zeros((0, width), np.uint64)
    del held
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:, :2] != rows[:-1, :2]).any(1)
    return rows[new]


def begins_of(values: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.append(True, values[1:] != values[:-1])[: len(values)])


def runs_of(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    begins = begins_of(values)
    return begins, np.diff(np.append(begins, len(values)))


def labelled(keys: np.ndarray, begins: np.ndarray, most: int) -> np.ndarray:
    """Labels of the classes' ascending keys: by each of `most` hashes, the least of the same class's lesser keys, NONE at the first."""
    out = np.full((len(keys), most), NONE)
    for k, salt in enumerate(LABELS[:most]):
        hashed = mix(keys ^ salt)
        for a, b in zip(begins.tolist(), [*begins[1:].tolist(), len(keys)]):
            out[a + 1 : b, k] = np.minimum.accumulate(hashed[a : b - 1])
    return out


LOW = np.uint64((1 << 32) - 1)


def sizes_and_rests(info: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of sets, and how many n-grams from a key on they may have in common with others."""
    return (info >> np.uint64(32)).astype(np.int64), (info & LOW).astype(np.int64)


def with_partners(rows: np.ndarray, threshold: float) -> np.ndarray:
    """Which of the rows (key, cid, info, ...), sorted by key, may have a similar one at the same key whose sizes and rests allow the overlap.

    The greatest partner of a set of size s with r n-grams left has r * (1 + t) / t - s. The lesser set of a pair allows one of its own size."""
    begins, members = runs_of(rows[:, 0])
    if not len(begins):
        return np.zeros(0, bool)
    size, rest = sizes_and_rests(rows[:, 2])
    most = (rest + 1e-6) * (1 + threshold) / threshold - size
    lesser = most >= size
    least = np.minimum.reduceat(np.where(lesser, size, np.iinfo(np.int64).max), begins)
    kept = (np.repeat(least, members) <= most)
    return kept & np.repeat(np.add.reduceat(kept.astype(np.int64), begins) > 1, members)


def meetings(docs: DataFrame, classes: DataFrame, n: int, threshold: float, common: Broadcast) -> DataFrame:
    """(key, members, cid, rest, labels): the classes of each key that may be the least of a pair. What the shuffles on the way leave is written, so that their files can go."""
    tasks = reduce_partitions(docs.sparkSession)
    parts = 8 * tasks  # so that tasks have about equally much

    def by_key(batches: Iterator[pa.RecordBatch], share: int) -> Iterator[pa.RecordBatch]:
        hasher, ranks = WordHasher(), Order(common.value)

        def of_share(s: np.ndarray) -> np.ndarray:
            """The first, a class's numbers, is of the share 0."""
            here = s % np.uint64(SHARES) == share
            here[0] = share == 0
            return s[here]

        def some(keys: list[np.ndarray], cids: list[np.uint64]) -> pa.RecordBatch:
            cid, key = np.repeat(np.array(cids, np.uint64), [len(k) for k in keys]), np.concatenate(keys)
            return strewn(np.where(key < FIRST_RANK, cid, key), parts, key, cid)

        with np.errstate(over="ignore"):
            for batch in batches:
                keys, cids, held = [], [], 0
                for s in sets_of(batch.column(0), n, hasher):
                    if len(s):
                        keys.append(of_share(looked_up(ranks(s), threshold)))
                        cids.append(class_of(s))
                        held += len(keys[-1])
                        if held > 1 << 17:
                            yield some(keys, cids)
                            keys, cids, held = [], [], 0
                if keys:
                    yield some(keys, cids)

    def by_class(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = gathered(batches, 2)
        members = runs_of(rows[:, 0])[1]
        rows = rows[(rows[:, 0] < FIRST_RANK) | np.repeat(members > 1, members)]
        with np.errstate(over="ignore"):
            yield strewn(rows[:, 1], parts, rows[:, 1], rows[:, 0])

    def with_labels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = gathered(batches, 2)
        begins, members = runs_of(rows[:, 0])
        if not len(begins):
            return
        first = rows[begins, 1]  # a class's first row has its numbers
        sizes, below = (first >> HALF).astype(np.int64), (first & np.uint64((1 << int(HALF)) - 1)).astype(np.int64)
        found = np.add.reduceat((rows[:, 1] < limit(threshold)).astype(np.int64), begins)
        size, rest = np.repeat(sizes, members), np.repeat(sizes - below + found + begins, members) - np.arange(len(rows))
        own = np.ones(len(rows), bool)
        own[begins] = False
        rows, size, rest = rows[own], size[own], rest[own]
        with np.errstate(over="ignore"):
            labels = labelled(rows[:, 1], begins_of(rows[:, 0]), 2)
            info = size.astype(np.uint64) << np.uint64(32) | rest.astype(np.uint64)
            r = rest >= threshold * size - 1e-6
            yield strewn(rows[r, 1], parts, rows[r, 1], rows[r, 0], info[r], *labels[r].T)

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = gathered(batches, 5)
        rows = rows[with_partners(rows, threshold)]
        begins, members = runs_of(rows[:, 0])
        if len(rows):
            low, high = np.minimum.reduceat(rows[:, 3:], begins), np.maximum.reduceat(rows[:, 3:], begins)
            rows = rows[np.repeat(~((low == high) & (low != NONE)).any(1), members)]
        members = runs_of(rows[:, 0])[1]
        members = np.repeat(members, members).astype(np.uint64)
        with np.errstate(over="ignore"):
            yield strewn(rows[:, 1], parts, rows[:, 1], rows[:, 0], rows[:, 2], members)

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = gathered(batches, 4)
        with np.errstate(over="ignore"):
            labels = labelled(rows[:, 1], begins_of(rows[:, 0]), 2)
            yield strewn(rows[:, 1], parts, rows[:, 1], rows[:, 0], rows[:, 2], *labels.T)

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = gathered(batches, 4)
        with np.errstate(over="ignore"):
            labels = labelled(rows[:, 1], begins_of(rows[:, 0]), len(LABELS))
        for a in range(0, len(rows), 10_000):
            r = rows[a : a + 10_000]
            cid, key, members = (pa.array(r[:, i].view(np.int64)) for i in (0, 1, 3))
            yield pa.RecordBatch.from_arrays([key, members, cid, pa.array(sizes_and_rests(r[:, 2])[1]), pa.array([x.tobytes() for x in labels[a : a + 10_000]], pa.binary())], ["key", "members", "cid", "rest", "labels"])

    def sent(df: DataFrame, f: Callable) -> DataFrame:
        return df.mapInArrow(released(f), "part long, packed binary").repartition(tasks, "part")

    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("copy"), "text")
    texts = texts.join(sized(classes.select("doc_id", "copy"), 16), ["doc_id", "copy"], "left_semi").select("text")

    def shared_keys(share: int) -> DataFrame:
        return written(sent(texts, partial(by_key, share=share)).mapInArrow(released(by_class), "part long, packed binary"), BATCH)

    def least_keys() -> DataFrame:
        rows = reduce(DataFrame.union, [shared_keys(share) for share in range(SHARES)]).repartition(tasks, "part")
        return sent(rows, with_labels).mapInArrow(released(least), "part long, packed binary")

    rows = alone(least_keys, tables_written(), BATCH).repartition(tasks, "part")
    for f in (again, least):
        rows = sent(rows, f)
    return rows.mapInArrow(released(last), "key long, members long, cid long, rest long, labels binary")


def candidates(docs: DataFrame, classes: DataFrame, n: int, threshold: float, common: Broadcast) -> DataFrame:
    """The rows of CELLED of classes that may be similar to another one in a cell."""
    parts = reduce_partitions(classes.sparkSession)
    points = meetings(docs, classes, n, threshold, common).join(sized(classes, 300), "cid")
    # A key of s * CELL members has s sides; a class meets all sides in a cell each.
    points = points.withColumn("sides", F.ceil(F.col("members") / CELL)).withColumn("own", F.pmod(F.xxhash64("cid"), F.col("sides")))
    points = points.withColumn("met", F.explode(F.sequence(F.lit(0), F.col("sides") - 1)))
    cell = F.when(F.col("sides") == 1, F.col("key")).otherwise(F.xxhash64("key", F.least("own", "met"), F.greatest("own", "met")))
    points = points.select(cell.alias("cell"), "key", (F.col("own") <= F.col("met")).alias("side_a"), (F.col("own") >= F.col("met")).alias("side_b"), "cid", "doc_id", "copy", "n", "size", "rest", "labels", "point")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cells in whole_cells(batches):
            used = np.zeros(cells.num_rows, bool)
            for x, y in cell_pairs(cells, counted(cells.column("point").to_pylist()), threshold):
                used[x] = used[y] = True
            if used.any():
                yield from cells.drop_columns(["point"]).filter(pa.array(used)).combine_chunks().to_batches()

    return points.repartition(parts, "cell").sortWithinPartitions("cell").mapInArrow(released(run), CELLED)


def squeezed(docs: DataFrame) -> DataFrame:
    """(doc_id, copy, text), the text compressed, as it goes through shuffles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            data, offsets = as_buffer(batch.column(2))
            whole = memoryview(data)
            packed = [packer.compress(whole[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packed, pa.binary())], ["doc_id", "copy", "text"])

    return docs.mapInArrow(released(run), "doc_id long, copy long, text binary")


class Forest:
    """Joins nodes; tells which links joined two trees."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


def verified(wanted: DataFrame, docs: DataFrame, n: int, threshold: float, common: Broadcast) -> DataFrame:
    """(a, b, links): with b null, how many documents of other classes those of the class a are similar to, in a cell; else a link of a cell's spanning forest."""
    texts = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("copy"), "text")
    sought = written(wanted.select("doc_id", "copy").distinct())
    rows = squeezed(texts.join(sized(sought, 16), ["doc_id", "copy"], "left_semi")).join(sized(wanted, 100), ["doc_id", "copy"])
    rows = rows.select(*[c for c in wanted.columns], "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, unpacker, ranks = WordHasher(), zstandard.ZstdDecompressor(), Order(common.value)
        for cell in cells_of(batches):
            cids = cell.column("cid").to_numpy()
            cell = cell.take(pa.array(np.unique(cids, return_index=True)[1]))  # rows that repeat id and text
            cids, docs = cell.column("cid").to_numpy(), cell.column("n").to_numpy()
            if len(cids) < 2:
                continue
            own, points = [], np.empty((len(cids), GROUPS), np.int32)
            for i, t in enumerate(cell.column("text")):
                for s in sets_of(pa.array([unpacker.decompress(t.as_buffer())], pa.binary()).cast(pa.string()), n, hasher):
                    points[i] = point_of(s)
                    own.append(ranks(s))
            sizes = np.array([len(s) for s in own])
            values = np.unique(np.concatenate(own))
            key = np.uint64(cell.column("key")[0].as_py() % (1 << 64))
            for i, s in enumerate(own):
                own[i] = np.searchsorted(values, s).astype(np.int32)
            links, forest, edges = np.zeros(len(cids), np.int64), Forest(len(cids)), []
            mark, marked = np.zeros(len(values), bool), -1
            for x, y in cell_pairs(cell.drop_columns(["text"]), points, threshold):
                order = np.argsort(x, kind="stable")
                for a, b in zip(x[order].tolist(), y[order].tolist()):
                    if a != marked:
                        if marked >= 0:
                            mark[own[marked]] = False
                        mark[own[a]], marked = True, a
                    both = mark[own[b]]
                    overlap = int(np.count_nonzero(both))
                    if overlap / (sizes[a] + sizes[b] - overlap) >= threshold and values[own[b][both.argmax()]] == key:
                        links[a] += docs[b]
                        links[b] += docs[a]
                        if forest.join(a, b):
                            edges.append((a, b))
            at = np.flatnonzero(links)
            if len(at):
                a = np.concatenate([cids[at], cids[[e[0] for e in edges]]])
                b = pa.array([None] * len(at) + cids[[e[1] for e in edges]].tolist(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(a), b, pa.array(np.concatenate([links[at], np.zeros(len(edges), np.int64)]))], ["a", "b", "links"])

    ordered = rows.repartition(reduce_partitions(docs.sparkSession), "cell").sortWithinPartitions("cell")
    return ordered.mapInArrow(released(run), "a long, b long, links long")


def linked(docs: DataFrame, n: int, threshold: float, hot: int) -> tuple[DataFrame, DataFrame]:
    """The documents (doc_id, copy, cid, ...), written, and (cid, n, root, links) of each class that has a link or several documents; cid is null for documents
    without words. root: the least class of the group."""
    common = docs.sparkSession.sparkContext.broadcast(common_grams(docs, n, hot))
    sketch = written(sketches(docs, n), BATCH)
    worded = sketch.where("cid is not null")
    documents = worded.select("cid", "doc_id").distinct().groupBy("cid").agg(F.count("*").alias("n"))
    classes = worded.groupBy("cid").agg(F.first("size").alias("size"), F.first("point").alias("point"), F.min(F.struct("doc_id", "copy")).alias("first"))
    classes = written(classes.join(documents, "cid").select("cid", "size", "point", "first.*", "n"))
    found = written(verified(written(candidates(docs, classes, n, threshold, common), BATCH), docs, n, threshold, common), BATCH)
    roots = components(found.where("b is not null")).select(F.col("node").alias("cid"), "root")
    links = found.where("b is null").groupBy(F.col("a").alias("cid")).agg(F.sum("links").alias("links")).join(roots, "cid")
    several = classes.select("cid", "n", "doc_id", "copy").join(links, "cid", "left").where("n > 1 or links is not null")
    several = written(several.select("cid", "n", "doc_id", "copy", F.coalesce("root", "cid").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links")))
    least = several.groupBy("root").agg(F.min(F.struct("doc_id", "copy")).alias("least"))
    return sketch, written(several.select("cid", "n", "root", "links").join(least, "root").drop("root"))


def with_classes(rows: DataFrame, classes: DataFrame, how: str) -> DataFrame:
    """rows (cid, ...) joined with the classes; those of heavy classes, of which there are few, without a shuffle."""
    heavy = F.broadcast(classes.where(F.col("n") > HEAVY))
    few = rows.join(heavy.select("cid"), "cid", "left_anti").join(sized(classes, 64), "cid", how)
    return few.unionByName(rows.join(heavy, "cid"))


def jaccard_join(docs: DataFrame, *, n: int = 3, threshold: float = 0.6, hot: int = 256) -> DataFrame:
    """(doc_id, class_id, n_links) for each document: the least doc_id of those that it is linked to, over any number of similar pairs,
    and how many other documents are similar to it.

    Null, empty and blank texts have no n-grams and are like nothing: class_id is the own doc_id, n_links 0. Rows without
    doc_id are left out. A doc_id that is repeated with the same n-grams gives one row and counts once; with others, it gives a row for
    each. An empty table gives no rows.
    """
    sketch, classes = linked(docs, n, threshold, hot)
    rows = with_classes(sketch.select("doc_id", "cid").distinct(), classes, "left")
    return rows.select("doc_id", F.coalesce("least.doc_id", "doc_id").alias("class_id"), F.coalesce("links", F.lit(0)).alias("n_links"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of the edges (a, b); the root is the component's least node.

    Large-star and small-star steps in turn until nothing changes."""

    def star(e: DataFrame, large: bool) -> DataFrame:
        around = e.union(e.select("b", "a")) if large else e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = around.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        moved = around.join(least, "a")
        moved = moved.where("b > a").select("b", "m") if large else moved.select("b", "m").union(least.select("a", "m"))
        return moved.toDF("a", "b").where("a <> b").distinct()

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    edges = written(edges.select("a", "b").where("a <> b"))
    before = None
    while (now := state(edges)) != before:
        before = now
        edges = written(star(star(edges, True), False))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select("b", "b").distinct())


def one_of_each(docs: DataFrame, *, n: int = 3, threshold: float = 0.6, hot: int = 256) -> DataFrame:
    """The rows of docs, all columns, less those of documents that are linked, over any number of similar pairs, to
    one of lesser doc_id (of equal ones: of lesser hash of the text). Rows that repeat id and text are one document and stay or go together; rows
    without doc_id, and null, empty and blank texts stay. An empty table gives an empty table."""
    sketch, classes = linked(docs, n, threshold, hot)
    its_id, its_copy = fresh(docs, "__gone", "__copy")
    gone = with_classes(sketch.select("doc_id", "copy", "cid"), classes, "inner").where(F.struct("doc_id", "copy") > F.col("least"))
    gone = written(gone.select(F.col("doc_id").alias(its_id), F.col("copy").alias(its_copy)).distinct())
    return docs.join(sized(gone, 16), (F.col("doc_id").cast("long") == F.col(its_id)) & (F.xxhash64("text") == F.col(its_copy)), "left_anti")


def oracle(n: int = 3, threshold: float = 0.6) -> str:
    return f"""
with recursive words as (
  select doc_id, list_filter(string_split_regex(lower(text), '[\\x00-\\x20]+'), lambda x: x <> '') as w from documents
), grams as (
  select distinct doc_id, array_to_string(w[i:i + {n - 1}], ' ') as g
  from (select doc_id, w, unnest(range(1, greatest(len(w) - {n} + 1, 1) + 1)) as i from words where len(w) > 0)
), members as (
  select doc_id, min(doc_id) over (partition by s) as c, count(*) over (partition by s) as n
  from (select doc_id, list_sort(list(g)) as s from grams group by doc_id)
), own as (select c, g from members join grams using (doc_id) where doc_id = c), sizes as (select c, count(*) as k from own group by c),
shared as (select x.c as a, y.c as b, count(*) as o from own x join own y on x.g = y.g and x.c <> y.c group by all),
alike as (
  select a, b from shared join sizes p on p.c = a join sizes q on q.c = b where o / (p.k + q.k - o) >= {threshold}
), reached as (
  select a, b from alike union select r.a, e.b from reached r join alike e on r.b = e.a
), groups as (select a as c, least(a, min(b)) as class_id from reached group by a),
links as (select a as c, sum(n) as links from alike join (select distinct c, n from members) m on m.c = b group by a)
select doc_id, coalesce(class_id, c, doc_id) as class_id, cast(coalesce(links, 0) + coalesce(n, 1) - 1 as bigint) as n_links
from documents left join members using (doc_id) left join groups using (c) left join links using (c)"""
