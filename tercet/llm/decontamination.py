"""Benchmark decontamination by Wu-Manber multi-pattern search.

Texts are brought to lower case and every run of ASCII characters other than letters and digits
becomes one space. The patterns are the runs of `n` words of each benchmark item (a shorter item
is one pattern). A document matches an item if a pattern of it occurs in the document at word
borders.

With m the length in bytes of the shortest pattern, only the first m bytes of a pattern steer the
search. SHIFT tells for a block of B bytes how far the window may move on: to the block's
last place in any pattern, or m - B + 1 if it is in none. At shift 0 the bucket of the window's last
block gives the patterns to compare byte by byte. Many windows move at once: a buffer of
texts is cut into lanes, each with a window of its own, and one numpy step moves all of them.

The tables are broadcast. Their size depends on the benchmark alone; a benchmark of more than
`most_bytes` is searched part by part, with a scan of the documents for each.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_buffer, normalised_buffer, pieces

BLOCK = 8
TABLE_BITS = 20
LANE = 512
class WuManber:
    """patterns: distinct byte strings, each with a space at either end."""

    def __init__(self, patterns: list[bytes]) -> None:
        self.patterns = sorted(patterns, key=lambda p: (len(p), p))
        self.m = len(self.patterns[0])
        self.block = min(BLOCK, self.m)
        places = self.m - self.block + 1
        self.shift = np.full(1 << TABLE_BITS, places, np.int32)
        heads = np.frombuffer(b"".join(p[: self.m] for p in self.patterns), np.uint8).reshape(len(self.patterns), self.m)
        for j in range(places):
            blocks = np.zeros((len(heads), 8), np.uint8)
            blocks[:, : self.block] = heads[:, j : j + self.block]
            slots = self.slots(blocks.reshape(-1).view(np.uint64))
            np.minimum.at(self.shift, slots, places - 1 - j)
        order = np.argsort(slots, kind="stable")  # of the last blocks
        self.bucket_of, self.bucket = slots[order], order

    @staticmethod
    def slots(blocks: np.ndarray) -> np.ndarray:
        return ((blocks * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)

    def candidates(self, data: np.ndarray) -> np.ndarray:
        """Where a window starts whose last block has shift 0."""
        last = len(data) - self.m
        if last < 0:
            return np.zeros(0, np.int64)
        ends = np.zeros(8, np.uint8)
        words = np.lib.stride_tricks.sliding_window_view(np.concatenate([data, ends]), 8)
        mask = np.uint64((1 << 8 * self.block) - 1)
        at = np.arange(0, last + 1, LANE)
        stop = np.minimum(at + LANE, last + 1)
        found = []
        while len(at):
            blocks = words[at + (self.m - self.block)].reshape(-1).view(np.uint64) & mask
            step = self.shift[self.slots(blocks)].astype(np.int64)
            if (hit := step == 0).any():
                found.append(at[hit])
            at = at + np.maximum(step, 1)
            going = at < stop
            at, stop = at[going], stop[going]
        return np.sort(np.concatenate(found)) if found else np.zeros(0, np.int64)

    def search(self, data: np.ndarray) -> Iterator[tuple[int, int]]:
        """Every (position, index of a pattern) at which the pattern occurs."""
        at = self.candidates(data)
        if not len(at):
            return
        text = data.tobytes()
        ends = np.zeros((len(at), 8), np.uint8)
        ends[:, : self.block] = data[at[:, None] + np.arange(self.m - self.block, self.m)]
        slots = self.slots(ends.reshape(-1).view(np.uint64))
        low, high = np.searchsorted(self.bucket_of, slots, "left"), np.searchsorted(self.bucket_of, slots, "right")
        for p, a, b in zip(at.tolist(), low.tolist(), high.tolist()):
            for k in self.bucket[a:b].tolist():
                if text.startswith(self.patterns[k], p):
                    yield p, k


def patterns_of(items: list[tuple[int | None, str | None]], n: int) -> dict[bytes, list[int]]:
    """The items that hold each pattern. Items without an id or without words have none."""
    out: dict[bytes, set[int]] = {}
    for item, text in items:
        data, _ = normalised_buffer(pa.array([text], pa.large_string()))  # as documents are, to the byte
        words = [w for w in data.tobytes().split(b" ") if w]
        if item is None or not words:
            continue
        for i in range(max(1, len(words) - n + 1)):
            out.setdefault(b" " + b" ".join(words[i : i + n]) + b" ", set()).add(item)
    return {p: sorted(i) for p, i in out.items()}


def parts_of(benchmark: DataFrame, n: int, most_bytes: int) -> Iterator[dict[bytes, list[int]]]:
    """The benchmark's patterns, of about most_bytes at a time; it is read row by row."""
    part, size = [], 0
    for row in benchmark.select("item_id", "text").toLocalIterator():
        part.append((row["item_id"], row["text"]))
        size += len(row["text"] or "") * n
        if size > most_bytes:
            yield patterns_of(part, n)
            part, size = [], 0
    yield patterns_of(part, n)


def _search_part(docs: DataFrame, patterns: dict[bytes, list[int]]) -> DataFrame:
    machine = WuManber(list(patterns))
    shared = docs.sparkSession.sparkContext.broadcast((machine, [patterns[p] for p in machine.patterns]))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, items = shared.value
        for batch in batches:
            ids = batch.column(0)
            for a, b, doc, which in occurrences(machine, batch.column(1)):
                found: dict[tuple[int, int], set[int]] = {}
                for d, k in zip(doc, which):
                    for item in items[k]:
                        found.setdefault((d, item), set()).add(k)
                if found:
                    keys = list(found)
                    yield pa.RecordBatch.from_arrays(
                        [ids.slice(a, b - a).take(pa.array([d for d, _ in keys])), pa.array([i for _, i in keys], pa.int64()), pa.array([len(found[x]) for x in keys], pa.int64())],
                        ["doc_id", "item_id", "n_patterns"],
                    )

    return docs.select(F.col("doc_id").cast("long"), "text").where("text is not null").mapInArrow(search, "doc_id long, item_id long, n_patterns long")


def occurrences(machine: WuManber, texts: pa.Array) -> Iterator[tuple[int, int, list[int], list[int]]]:
    """For each range a:b of the texts, in which text of it a pattern occurs, and which pattern."""
    _, offsets = as_buffer(texts)
    for a, b in pieces(offsets, 1 << 22):
        data, begins = normalised_buffer(texts.slice(a, b - a))
        found = list(machine.search(data))
        yield a, b, (np.searchsorted(begins, [p for p, _ in found], "right") - 1).tolist(), [k for _, k in found]


def contaminated(docs: DataFrame, benchmark: DataFrame, *, n: int = 8, most_bytes: int = 64 << 20) -> DataFrame:
    """(doc_id, item_id, n_patterns): the documents in which text of an item occurs, and how many
    of the item's distinct patterns do.

    Null and empty texts match nothing. Items that share a pattern all match. Rows that repeat
    a doc_id are searched each for itself and give a row each; a null doc_id gives a row with a null.
    Items without an id are left out. An empty table on either side gives no rows.
    """
    schema = "doc_id long, item_id long, n_patterns long"
    found = [_search_part(docs, p) for p in parts_of(benchmark, n, most_bytes) if p]
    return reduce(DataFrame.unionByName, found) if found else docs.sparkSession.createDataFrame([], schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, n: int = 8, most_bytes: int = 64 << 20) -> DataFrame:
    """The rows of docs, all columns, in which no text of the benchmark occurs; no shuffle. Each row is judged by its own text,
    so rows that repeat an id, or have none, don't share a fate; null and empty texts stay. An empty
    benchmark leaves all, an empty table stays one."""
    for patterns in parts_of(benchmark, n, most_bytes):
        if patterns:
            docs = _without_part(docs, patterns)
    return docs


def _without_part(docs: DataFrame, patterns: dict[bytes, list[int]]) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(WuManber(list(patterns)))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clean = np.ones(batch.num_rows, bool)
            for a, _, doc, _ in occurrences(shared.value, batch.column(batch.schema.get_field_index("text"))):
                clean[a + np.array(doc, np.int64)] = False
            yield batch.filter(pa.array(clean))

    return docs.mapInArrow(keep, docs.schema)


def oracle(n: int = 8) -> str:
    norm = "trim(regexp_replace(lower(text), '[\\x00-/:-`{-\\x7f]+', ' ', 'g'), ' ')"
    return f"""
with items as (select item_id, string_split({norm}, ' ') as w from benchmark where {norm} <> ''),
grams as (
  select distinct item_id, array_to_string(w[i:i + {n - 1}], ' ') as g
  from (select item_id, w, unnest(range(1, greatest(len(w) - {n} + 1, 1) + 1)) as i from items)
),
texts as (select doc_id, string_split({norm}, ' ') as w from documents where {norm} <> ''),
sizes as (select distinct len(string_split(g, ' ')) as k from grams),
windows as (
  select distinct doc_id, array_to_string(w[i:i + k - 1], ' ') as g
  from (select doc_id, w, k, unnest(range(1, len(w) - k + 2)) as i from texts, sizes where len(w) >= k)
)
select doc_id, item_id, count(*) as n_patterns from windows join grams using (g) group by all"""
