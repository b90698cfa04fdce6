"""Operator 4: benchmark decontamination by greedy string tiling.

Words are maximal runs of letters, digits and underscores, lower-cased. Documents and benchmark items are joined on seeds,
runs of `LEAST` words (Karp-Rabin hashes); for each pair that shares some, the longest common run that overlaps no earlier
tile is marked, again and again (ties: the smallest position in the document, then in the item), until none of LEAST words
is left. A pair is a leak where tiles cover at least `COVERAGE` of the item's words, in whatever order the passages come.

Seeds that more than `FREQUENT` places of the benchmark share lead to candidates only for items that they could cover by
themselves; every other item must share a rarer seed as well, so none is lost, and a phrase that all items share costs
nothing. Items whose shared seeds can't cover enough of them are not tiled.

The benchmark's seeds are broadcast in blocks of at most `BLOCK_WORDS` words (or one item), and documents are scanned once
per block, each time by tasks of their own that hold one block, so that memory is bounded for benchmarks of any size. An item
of fewer than LEAST words has no seed and leaks only into a text whose words are that item and nothing else (one tile);
items and texts without words, and nulls, never match. Repeated items and rows, and null ids, are reported each; very long
and repetitive texts take memory in proportion to their length; empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

import functools
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lotwise.llm.common import mix, read_table

LEAST, COVERAGE = 5, 0.5
BLOCK_WORDS, FREQUENT = 2_000_000, 64
#: Pairs of equal places in a document and an item up to which they are held at once; beyond, matches are found row by row.
MOST_PAIRS = 2_000_000
WORD = re.compile(r"\w+")
Tile = tuple[int, int, int]


def free_runs(used_doc: bytearray, used_item: bytearray, i: int, j: int, n: int, least: int) -> list[Tile]:
    """Parts of a match of at least `least` words that no tile has marked."""
    used = np.frombuffer(used_doc, np.uint8, n, i) | np.frombuffer(used_item, np.uint8, n, j)
    edge = np.flatnonzero(np.diff(np.concatenate(([1], used, [1])).astype(np.int8)))
    return [(i + int(a), j + int(a), int(b - a)) for a, b in zip(edge[::2], edge[1::2]) if b - a >= least]


def matches(pairs: tuple[np.ndarray, np.ndarray], least: int) -> list[Tile]:
    """Maximal common runs (doc position, item position, length) from the pairs of places where runs of `least` words are equal."""
    i, j = pairs
    order = np.lexsort((i, i - j))
    i, j = i[order], j[order]
    first = np.concatenate(([True], (i[1:] != i[:-1] + 1) | (j[1:] != j[:-1] + 1)))
    at = np.flatnonzero(first)
    return list(zip(i[at].tolist(), j[at].tolist(), (np.diff(np.concatenate((at, [len(i)]))) + least - 1).tolist()))


def tiles(n_doc: int, n_item: int, least: int, found: list[Tile]) -> list[Tile]:
    """Greedy tiles out of all maximal common runs: longest first, ties by position.

    A run that a tile overlaps comes back as the parts that are left of it.
    """
    used_doc, used_item, out = bytearray(n_doc), bytearray(n_item), []
    queue = [(-n, i, j) for i, j, n in found]
    heapq.heapify(queue)
    while queue:
        n, i, j = heapq.heappop(queue)
        left = free_runs(used_doc, used_item, i, j, -n, least)
        if left == [(i, j, -n)]:
            used_doc[i : i - n] = used_item[j : j - n] = b"\1" * -n
            out.append((i, j, -n))
            if used_item.find(bytes(least)) < 0:
                break
        else:
            for a, b, m in left:
                heapq.heappush(queue, (-m, a, b))
    return out


def tiles_by_rows(doc: np.ndarray, item: np.ndarray, least: int) -> list[Tile]:
    """The same tiles for texts with very many equal places: memory in proportion to the document, one pass per tile."""
    doc, item, out = doc.copy(), item.copy(), []
    while True:
        best: Tile = (0, 0, 0)
        run = np.zeros(len(doc) + 1, np.int32)
        for j, word in enumerate(item.tolist()):
            run[1:] = np.where(doc == word, run[:-1] + 1, 0) if word > 0 else 0
            n = int(run.max())
            if n >= max(best[2], 1):
                tile = (int(run.argmax()) - n, j - n + 1, n)
                if (-tile[2], *tile[:2]) < (-best[2], *best[:2]):
                    best = tile
        i, j, n = best
        if n < least:
            return out
        out.append(best)
        doc[i : i + n], item[j : j + n] = -1, -2


class Seeds:
    """Runs of n words of a block's items: distinct hashes, and the places (item, position) that each leads to."""

    def __init__(self, items: list[tuple[int, np.ndarray]], n: int, lengths: np.ndarray, coverage: float):
        self.n = n
        runs = [karp_rabin(w, n) for _, w in items]
        owner = np.repeat(np.array([k for k, _ in items]), [len(r) for r in runs])
        position = np.concatenate([np.arange(len(r)) for r in runs])
        self.hashes, number, counts = np.unique(np.concatenate(runs), return_inverse=True, return_counts=True)
        frequent = (counts > FREQUENT)[number]
        self.by_frequent = covered(owner[frequent], position[frequent], n, len(lengths))
        able = self.by_frequent >= coverage * lengths
        #: Words that frequent seeds may add to what the places in this index show.
        self.by_frequent[able] = 0
        leads = ~frequent | able[owner]
        order = np.flatnonzero(leads)[np.argsort(number[leads], kind="stable")]
        self.owner, self.position = owner[order].astype(np.int32), position[order].astype(np.int32)
        self.start = np.searchsorted(number[order], np.arange(len(self.hashes) + 1))
        #: Of each item, the numbers of its runs.
        cuts = np.cumsum([0, *(len(r) for r in runs)])
        self.own = {k: number[a:b].astype(np.int32) for (k, _), a, b in zip(items, cuts, cuts[1:])}


def covered(owner: np.ndarray, position: np.ndarray, n: int, n_items: int) -> np.ndarray:
    """Words of each item that runs of n words at these places cover; places sorted by item and position."""
    if not len(owner):
        return np.zeros(n_items, np.int64)
    step = np.full(len(owner), n, np.int64)
    same = owner[1:] == owner[:-1]
    step[:-1][same] = np.minimum(n, (position[1:] - position[:-1])[same])
    return np.bincount(owner, step, n_items).astype(np.int64)


def karp_rabin(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of n words."""
    out = np.zeros(max(0, len(words) - n + 1), np.uint64)
    for k in range(n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + words[k : k + len(out)].astype(np.uint64)
    return mix(out)


class Block:
    """Items of one block: vocabulary, words by number, and seeds by run length."""

    def __init__(self, items: list[tuple[int | None, str | None]], least: int = LEAST, coverage: float = COVERAGE):
        self.coverage = coverage
        self.vocabulary: dict[str, int] = {}
        self.items: list[tuple[int | None, np.ndarray]] = []
        for item_id, text in items:
            words = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in WORD.findall((text or "").lower())]
            if words:
                self.items.append((item_id, np.array(words, np.int64)))
        self.lengths = np.array([len(w) for _, w in self.items], np.int64)
        #: Items without a seed, by all their words.
        self.short: dict[bytes, list[int]] = {}
        for k, (_, w) in enumerate(self.items):
            if len(w) < least:
                self.short.setdefault(w.tobytes(), []).append(k)
        seeded = [(k, w) for k, (_, w) in enumerate(self.items) if len(w) >= least]
        self.seeds = [Seeds(seeded, least, self.lengths, coverage)] if seeded else []

    def leaks(self, text: str | None) -> list[tuple[int | None, float, int, int]]:
        """(item_id, coverage, tiles, longest tile) of the items that a text holds, in the items' order."""
        words = WORD.findall((text or "").lower())
        doc = np.fromiter((self.vocabulary.get(w, 0) for w in words), np.int64, len(words))
        out = [(k, 1.0, 1, len(doc)) for k in self.short.get(doc.tobytes(), ())] if self.short else []
        for seeds in self.seeds:
            runs = karp_rabin(doc, seeds.n)
            number = np.minimum(np.searchsorted(seeds.hashes, runs), len(seeds.hashes) - 1)
            places = np.flatnonzero(seeds.hashes[number] == runs)
            if len(places):
                out += self.tiled(doc, seeds, number[places], places)
        out.sort(key=lambda x: x[0])
        return [(self.items[k][0], *rest) for k, *rest in out]

    def tiled(self, doc: np.ndarray, seeds: Seeds, number: np.ndarray, places: np.ndarray) -> Iterator[tuple[int, float, int, int]]:
        """(item, coverage, tiles, longest tile) of leaking items, given the document's places with seeds of a number."""
        n, shared = seeds.n, np.unique(number)
        start, count = seeds.start[shared], seeds.start[shared + 1] - seeds.start[shared]
        led = np.repeat(start - np.cumsum(count) + count, count) + np.arange(count.sum())
        owner, position = seeds.owner[led], seeds.position[led]
        order = np.lexsort((position, owner))
        candidates, where = np.unique(owner[order], return_inverse=True)
        bound = covered(where, position[order], n, len(candidates)) + seeds.by_frequent[candidates]
        order = np.argsort(number, kind="stable")
        number, places = number[order], places[order]
        for k in candidates[bound >= self.coverage * self.lengths[candidates]].tolist():
            own, item = seeds.own[k], self.items[k][1]
            at = np.flatnonzero(np.isin(own, shared))
            least_words = self.coverage * len(item)
            if covered(np.zeros(len(at), np.int64), at, n, 1)[0] < least_words:
                continue
            first = np.searchsorted(number, own[at])
            times = np.searchsorted(number, own[at], side="right") - first
            found = None
            if times.sum() <= MOST_PAIRS:
                i = places[np.repeat(first - np.cumsum(times) + times, times) + np.arange(times.sum())]
                found = matches((i, np.repeat(at, times)), n)
                if not all(np.array_equal(doc[a : a + m], item[b : b + m]) for a, b, m in found):
                    found = None  # hashes that agree by chance
            tiling = tiles_by_rows(doc, item, n) if found is None else tiles(len(doc), len(item), n, found)
            words = sum(t[2] for t in tiling)
            if words >= least_words and tiling:
                yield k, words / len(item), len(tiling), max(t[2] for t in tiling)


def blocks(benchmark: DataFrame, least: int = LEAST, coverage: float = COVERAGE, block_words: int = BLOCK_WORDS) -> Iterator[Block]:
    """The benchmark (item_id, text) in blocks of bounded size, streamed to the driver partition by partition."""
    held, size = [], 0
    for row in benchmark.select("item_id", "text").toLocalIterator():
        n = len(WORD.findall(row["text"] or ""))
        if held and size + n > block_words:
            yield Block(held, least, coverage)
            held, size = [], 0
        held.append((row["item_id"], row["text"]))
        size += n
    if held:
        yield Block(held, least, coverage)


_LEAK = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("coverage", T.DoubleType()), T.StructField("n_tiles", T.IntegerType()), T.StructField("longest", T.IntegerType())])


def find_leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST, coverage: float = COVERAGE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per (document, item) that leaks: key, item_id, coverage, n_tiles, longest. No shuffle."""
    schema = T.StructType([docs.schema[key], *_LEAK.fields])
    out = None
    for block in blocks(benchmark, least, coverage, block_words):
        sent = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows = [(k, *leak) for k, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for leak in sent.value.leaks(x)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (b.column(0).type, pa.int64(), pa.float64(), pa.int32(), pa.int32()))], names=schema.names)

        part = docs.select(key, text).mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def drop_leaking(docs: DataFrame, benchmark: DataFrame, text: str = "text", least: int = LEAST, coverage: float = COVERAGE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs without rows that leak any item; columns stay as they are.

    A benchmark of one block is a filter without a shuffle. With more, each block yields the texts that leak, by tasks of
    its own, and docs are joined against those; no task holds more than a block.
    """
    spark, first, rest = docs.sparkSession, None, []
    for block in blocks(benchmark, least, coverage, block_words):
        sent = spark.sparkContext.broadcast(block)
        first = first or sent
        rest.append(_leaking(docs.select(F.col(text).alias("_text")), sent))
    if first is None:
        return docs
    if len(rest) > 1:
        found = functools.reduce(DataFrame.unionByName, rest).distinct()
        return docs.withColumn("_key", _text_key(F.col(text))).join(found, "_key", "left_anti").drop("_key").select(*docs.columns)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([not first.value.leaks(x) for x in b.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def _text_key(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def _leaking(texts: DataFrame, sent) -> DataFrame:
    """_key of the texts (_text) that leak an item of a broadcast block."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([bool(sent.value.leaks(x)) for x in b.column(0).to_pylist()], pa.bool_()))

    return texts.mapInArrow(run, texts.schema).select(_text_key(F.col("_text")).alias("_key"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that hold a benchmark item go."""
    return drop_leaking(docs, read_table(spark, sf_dir, "benchmark"))
