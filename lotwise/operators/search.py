"""Many patterns in many texts of the same file: one pass of an automaton over each text, however many patterns there are, few ones by plain search."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotwise.operators.scratch import Scratch

#: Texts of a file that one task searches, and patterns that it searches for, about.
SLICE_TEXTS, BLOCK_PATTERNS = 20_000, 20_000
#: Patterns up to which each is looked for by itself: an automaton of long patterns takes more to make than a few short searches.
FEW_PATTERNS = 64
#: Files that are cut into slices or blocks, at most; beyond, only larger ones are cut.
MOST_CUT = 500_000
PLACE = "file_id string, pattern_id string, hits long, at long, page long"


def _automaton(words):
    import ahocorasick

    made = ahocorasick.Automaton()
    for w in words:
        made.add_word(w, w)
    made.make_automaton()
    return made


def flat(text: str) -> str:
    """In lower case, with single spaces."""
    return re.sub(r"\s+", " ", text.lower())


class FirstPlaces:
    """The first text, in the order in which texts come, that holds each pattern.

    A pattern's id may start with "~": then it is looked for in flattened texts, and is flattened itself. At most FEW_PATTERNS
    are looked for one by one, those that aren't found yet; more by an automaton.
    """

    def __init__(self, patterns: list[tuple[str, list[str]]]):
        self.rows: list[tuple[str, int, int, int]] = []
        self.wanted: list[dict[str, list[str]]] = [{}, {}]
        for ident, (pattern,) in patterns:
            loose = ident.startswith("~")
            self.wanted[loose].setdefault(flat(pattern) if loose else pattern, []).append(ident)
        self.automata = [_automaton(w) if len(w) > FEW_PATTERNS else None for w in self.wanted]

    def feed(self, at: int, page: int, text: str) -> None:
        for wanted, automaton, told in zip(self.wanted, self.automata, (str, flat)):
            if wanted:
                said = told(text)
                for p in {p for _, p in automaton.iter(said)} if automaton else [p for p in wanted if p in said]:
                    self.rows += [(ident, 1, at, page) for ident in wanted.pop(p, ())]

    def found(self) -> list[tuple[str, int, int, int]]:
        return self.rows


class MostWords:
    """The text that holds most of each pattern's words (repeated ones count so often) in lower case, the first of several."""

    def __init__(self, patterns: list[tuple[str, list[str]]]):
        self.owners: dict[str, dict[str, int]] = {}
        for ident, words in patterns:
            for w in words:
                own = self.owners.setdefault(w, {})
                own[ident] = own.get(ident, 0) + 1
        self.automaton = _automaton(self.owners)
        self.best: dict[str, tuple[int, int, int]] = {}

    def feed(self, at: int, page: int, text: str) -> None:
        hits: dict[str, int] = {}
        for w in {w for _, w in self.automaton.iter(text.lower())}:
            for ident, times in self.owners[w].items():
                hits[ident] = hits.get(ident, 0) + times
        for ident, n in hits.items():
            if n > self.best.get(ident, (0,))[0]:
                self.best[ident] = (n, at, page)

    def found(self) -> list[tuple[str, int, int, int]]:
        return [(ident, *b) for ident, b in self.best.items()]


def _values(column: pa.Array) -> list:
    """A column's values by way of NumPy, several times quicker than to_pylist(); nulls of whole numbers become 0, null lists empty."""
    if pa.types.is_list(column.type):
        at, inside = column.offsets.to_numpy().tolist(), _values(column.values)
        return [inside[i:j] for i, j in zip(at, at[1:])]
    column = column.fill_null(0) if pa.types.is_integer(column.type) else column
    return column.to_numpy(zero_copy_only=False).tolist()


def _parts(rows: DataFrame, most: int, name: str) -> DataFrame | None:
    """(file_id, name) of the files of more than so many rows: into how many parts they are cut; None where there can't be any."""
    n = rows.count()
    if n <= most:
        return None
    counts = rows.groupBy("file_id").agg(F.count("*").alias("_n"))
    # Files beyond the least size number at most total / least, which bounds what is broadcast.
    least = max(most, n // MOST_CUT)
    return counts.where(F.col("_n") > least).select("file_id", F.ceil(F.col("_n") / most).cast("int").alias(name))


def search(patterns: DataFrame, texts: DataFrame, finder: type, slice_texts: int = SLICE_TEXTS, block_patterns: int = BLOCK_PATTERNS) -> DataFrame:
    """PLACE rows of patterns (file_id, pattern_id, words: what a finder takes) that texts (file_id, at, page, text) of their file hold.

    A file's texts and patterns meet in one task, or, where there are more of them, each slice of its texts with each block
    of its patterns; a task holds a block's automaton and one text. Of several slices the best place counts: most hits, then
    the first. Work is in proportion to the texts, once for each block, and to what they hold. Patterns and places are
    written to the shared folder, so that what they are made from is computed once.
    """
    scratch = Scratch(patterns.sparkSession, "search")
    patterns = scratch.save(patterns, "patterns")
    many = {"_slices": _parts(texts, slice_texts, "_slices"), "_blocks": _parts(patterns, block_patterns, "_blocks")}

    def cut(df: DataFrame) -> DataFrame:
        for name, parts in many.items():
            df = df.withColumn(name, F.lit(1)) if parts is None else df.join(F.broadcast(parts), "file_id", "left").fillna({name: 1})
        return df

    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    none = lambda t: F.lit(None).cast(t)
    left = cut(patterns).select("file_id", every("_slices").alias("slice"), own("pattern_id", "_blocks").alias("block"), F.lit(0).alias("side"), none("long").alias("at"), none("long").alias("page"),
        "pattern_id", "words", none("string").alias("text"))
    right = cut(texts).select("file_id", own("at", "_slices").alias("slice"), every("_blocks").alias("block"), F.lit(1).alias("side"), F.col("at").cast("long").alias("at"),
        F.col("page").cast("long").alias("page"), none("string").alias("pattern_id"), none("array<string>").alias("words"), "text")
    cell = ["file_id", "slice", "block"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, made = None, [], None

        def ready() -> Iterator[pa.RecordBatch]:
            rows = made.found() if made else []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([key[0]] * len(rows)), *(pa.array(c) for c in zip(*rows))], names=["file_id", "pattern_id", "hits", "at", "page"])

        for b in batches:
            for *own_key, side, at, page, ident, words, text in zip(*(_values(c) for c in b.columns)):
                if own_key != key:
                    yield from ready()
                    key, held, made = own_key, [], None
                if side == 0:
                    held.append((ident, words))
                elif held or made:
                    if made is None:
                        made, held = finder(held), []
                    made.feed(at, page, text)
        yield from ready()

    met = left.unionByName(right).repartition(*cell).sortWithinPartitions(*cell, "side", "at").mapInArrow(run, PLACE)
    best = F.min_by(F.struct("hits", "at", "page"), F.struct(-F.col("hits"), "at"))
    return scratch.save(met.groupBy("file_id", "pattern_id").agg(best.alias("_b")).select("file_id", "pattern_id", "_b.*"), "places")


def first_places(patterns: DataFrame, texts: DataFrame, pattern: Column, **cut) -> DataFrame:
    """Where each pattern comes first: (file_id, pattern_id, at, page). Empty patterns are nowhere."""
    rows = patterns.select("file_id", "pattern_id", F.array(pattern).alias("words")).where(F.coalesce(F.length(F.get("words", F.lit(0))), F.lit(0)) > 0)
    return search(rows, texts, FirstPlaces, **cut).drop("hits")
