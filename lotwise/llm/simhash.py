"""Operator 11: document fingerprints by SimHash, and all fingerprints within a Hamming radius by permuted block tables.

A text's terms are its runs of WORDS words between ASCII white space (one run of all words where it has fewer). A term's hash
of BITS bits votes on each bit, for or against, with a weight of 1 + log2 of how often the text has it, rounded down. The
fingerprint has the bits that more weight is for. Two fingerprints' likeness is the cosine that their Hamming distance h
stands for, cos(pi h / BITS), at least 0.

`near_fingerprints` cuts the bits into blocks, more of them than the radius: two fingerprints within it agree in all but
`radius` blocks, so each choice of the remaining ones is a table in whose order they are neighbours. Tables have as many
agreeing blocks as tell the given number of fingerprints apart. Buckets of equal blocks are compared in cells of about CELL
fingerprints, however large they are, and a pair counts in the first table where it agrees, so no pair is emitted, kept twice
or lost. What is left per cell is a number of links and an edge per fingerprint, which make up classes.

Texts are paired with the next one in order of id (nulls first) and text, after one shuffle by range; only the first and last
rows of partitions meet in a join. Null texts are empty; texts without words have the fingerprint of no votes, all zeros;
equal texts have equal fingerprints in any table, so repeated rows and ids are likewise results each; a table of one row is
its own next; very long texts take memory in proportion to their length; empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lotwise.llm.common import Scratch, read_table, shingle_hashes
from lotwise.llm.components import components, with_totals

WORDS, BITS, RADIUS = 5, 128, 6
#: Word digests that a worker remembers, fingerprints of a cell about, and rows and characters of a batch.
REMEMBERED, CELL, ROWS, BATCH_CHARS = 1 << 18, 1024, 1000, 16 << 20
#: For each byte, its bits as votes.
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
_PLACES = (256 * np.arange(BITS // 8, dtype=np.int64))[None, :]


class _Digests(dict):
    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        made = self[word] = hashlib.md5(word, usedforsecurity=False).digest()
        return made


_digests = _Digests()


def term_hashes(text: str | None, words: int = WORDS) -> np.ndarray:
    """Two numbers of 64 bits for each run of words, in order."""
    found = (text or "").encode().split()
    halves = np.frombuffer(b"".join(map(_digests.__getitem__, found)), ">u8").reshape(-1, 2).astype(np.uint64)
    return np.stack([shingle_hashes(halves[:, k], words) for k in (0, 1)], axis=1)


def fingerprint(text: str | None, words: int = WORDS) -> str:
    """The fingerprint of a text, as hexadecimal digits."""
    terms = term_hashes(text, words)
    _, first, times = np.unique(terms[:, 0], return_index=True, return_counts=True)
    weight = np.frexp(times)[1].astype(np.float64)
    codes = terms[first].astype(">u8").view(np.uint8).reshape(-1, BITS // 8) + _PLACES
    votes = np.bincount(codes.ravel(), np.repeat(weight, BITS // 8), 256 * BITS // 8).reshape(-1, 256) @ _BITS
    return np.packbits(2 * votes > weight.sum()).tobytes().hex()


def distance(a: str, b: str) -> int:
    return (int(a, 16) ^ int(b, 16)).bit_count()


def likeness(a: str, b: str) -> float:
    """The cosine between two texts' weighted terms, as their fingerprints tell it; 1 where those are equal."""
    return max(0.0, round(math.cos(math.pi * distance(a, b) / BITS), 6))


def fingerprints(df: DataFrame, text: str = "text", out: str = "fingerprint", words: int = WORDS) -> DataFrame:
    """df with the fingerprint of its text. Row-local."""
    keep = [c for c in df.columns if c != out]
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField(out, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = pa.array([fingerprint(x, words) for x in b.column(keep.index(text)).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, made], names=schema.names)

    return df.select(*keep).mapInArrow(run, schema)


# ---- each text and the next one --------------------------------------------------------------------------------------

_PAIRED = (("n_chars", "long"), ("edited_sha256", "string"), ("fingerprint", "string"), ("edited_fingerprint", "string"), ("near_edited", "double"), ("near_next", "double"))
_ARROW = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}


def edited(text: str, following: str) -> str:
    """text with its second half replaced by as much of the start of the following text, or by all of that."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def paired(text: str, own: str, following: str, other: str) -> tuple:
    """Values of _PAIRED for a text and the one that follows it, given both fingerprints."""
    new = edited(text, following)
    made = fingerprint(new)
    return len(text), hashlib.sha256(new.encode()).hexdigest(), own, made, likeness(own, made), likeness(own, other)


def with_edits(docs: DataFrame, scratch: Scratch, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, _PAIRED) of every row: its fingerprint, and how like it its edited text and the next row's text are."""
    kind = docs.schema[key].dataType
    fields = [T.StructField("key", kind), *(T.StructField(n, T._parse_datatype_string(t)) for n, t in _PAIRED)]
    edges = [T.StructField("part", T.IntegerType()), T.StructField("edge", T.StringType()), T.StructField("text", T.StringType())]
    schema = T.StructType([*fields, *edges])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, out, size, ids = TaskContext.get().partitionId(), None, [], 0, None

        def ready() -> pa.RecordBatch:
            columns = list(zip(*out))
            out.clear()
            kinds = [ids, *(_ARROW[t] for _, t in _PAIRED), pa.int32(), pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=schema.names)

        def at_edge(edge: str) -> tuple:
            return (held[0], len(held[1]), None, held[2], None, None, None, part, edge, held[1])

        for b in batches:
            ids = b.column(0).type
            for own, said in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                said = said or ""
                now = (own, said, fingerprint(said))
                if held is not None:
                    out.append((held[0], *paired(*held[1:], *now[1:]), part, None, None))
                first, held = held is None, now
                if first:
                    out.append(at_edge("first"))
                size += 200 + len(said)
                if len(out) >= ROWS or size > BATCH_CHARS:
                    yield ready()
                    size = 0
        if held is not None:
            out.append(at_edge("last"))
            yield ready()

    placed = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_h"))
    ordered = placed.repartitionByRange("key", "_h").sortWithinPartitions("key", "_h").select("key", "text")
    made = scratch.save(ordered.mapInArrow(run, schema), "paired")
    # Partitions that hold rows, in order; after the last comes the first.
    parts = sorted(r[0] for r in made.where("edge = 'first'").select("part").collect())
    follows = docs.sparkSession.createDataFrame(list(zip(parts, parts[1:] + parts[:1])), "part int, next int")
    first = made.where("edge = 'first'").select(F.col("part").alias("next"), F.col("text").alias("_text"), F.col("fingerprint").alias("_other"))
    last = made.where("edge = 'last'").select("key", "text", "fingerprint", "part").join(follows, "part").join(first, "next").select("key", "text", "fingerprint", "_text", "_other")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [paired(*r) for r in zip(*(c.to_pylist() for c in b.columns[1:]))]
            if rows:
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, _ARROW[t]) for c, (_, t) in zip(zip(*rows), _PAIRED))], names=[f.name for f in fields])

    rest = made.where("edge is null").select(*(f.name for f in fields))
    return rest.unionByName(last.mapInArrow(finish, T.StructType(fields))).withColumnRenamed("key", key)


# ---- fingerprints within a radius ------------------------------------------------------------------------------------


class Tables:
    """Choices of blocks in which fingerprints within a radius agree."""

    def __init__(self, n: int, radius: int, bits: int = BITS, most_agreeing: int = 4):
        for agreeing in range(1, most_agreeing + 1):
            blocks = radius + agreeing
            if agreeing * (bits // blocks) >= math.log2(max(n, 2)):
                break
        cuts = [round(bits * k / blocks) for k in range(blocks + 1)]
        whole = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:])]
        self.radius = radius
        halves = lambda m: (m >> 64, m & (1 << 64) - 1)
        #: Each block's and each table's bits, as two numbers of 64 bits.
        self.blocks = np.array([halves(m) for m in whole], np.uint64)
        self.chosen = [sum(1 << k for k in c) for c in itertools.combinations(range(blocks), agreeing)]
        self.masks = np.array([halves(sum(whole[k] for k in c)) for c in itertools.combinations(range(blocks), agreeing)], np.uint64)

    def first(self, differ: np.ndarray) -> np.ndarray:
        """The first table in which pairs agree, given the bits in which they differ."""
        agree = np.zeros(len(differ), np.int64)
        for k, m in enumerate(self.blocks):
            agree |= (~((differ & m) != 0).any(axis=1)).astype(np.int64) << k
        found = np.full(len(differ), len(self.chosen), np.int64)
        for t in reversed(range(len(self.chosen))):
            found[(agree & self.chosen[t]) == self.chosen[t]] = t
        return found


def _numbers(column: pa.Array) -> np.ndarray:
    return np.frombuffer(bytes.fromhex("".join(column.to_pylist())), ">u8").reshape(-1, 2).astype(np.uint64)


def _buckets(prints: DataFrame, tables: Tables) -> DataFrame:
    """(bucket, table, fingerprint) of each fingerprint in each table; a bucket has equal bits in the table's blocks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                column = whole.column(0).slice(at, ROWS)
                x = _numbers(column)
                for t, mask in enumerate(tables.masks):
                    kept = (x & mask).astype(">u8").tobytes()
                    keys = [hashlib.blake2b(kept[16 * k : 16 * k + 16], digest_size=8, salt=t.to_bytes(2, "big")).digest() for k in range(len(x))]
                    bucket = np.frombuffer(b"".join(keys), np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(np.full(len(x), t, np.int32)), column], names=["bucket", "table", "fingerprint"])

    return prints.select("fingerprint").mapInArrow(run, "bucket long, table int, fingerprint string")


def _compare(x: np.ndarray, side: np.ndarray, table: int, tables: Tables) -> tuple[np.ndarray, np.ndarray]:
    """Links of each fingerprint of a cell, and the first of its component there; sides meet where there are two."""
    n, label = len(x), np.arange(len(x))
    a, b = [], []
    two = side.any() and not side.all()
    for at in range(0, n, 256):
        near = sum(np.bitwise_count(x[at : at + 256, None, k] ^ x[None, :, k]).astype(np.uint16) for k in (0, 1)) <= tables.radius
        i, j = np.nonzero(near)
        i += at
        good = (i < j) & (side[i] != side[j]) if two else i < j
        i, j = i[good], j[good]
        own = tables.first(x[i] ^ x[j]) == table
        a.append(i[own])
        b.append(j[own])
    i, j = np.concatenate(a), np.concatenate(b)
    links = np.bincount(i, minlength=n) + np.bincount(j, minlength=n)
    while True:
        before = label.copy()
        np.minimum.at(label, i, label[j])
        np.minimum.at(label, j, label[i])
        label = label[label]
        if np.array_equal(before, label):
            return links, label


def near_fingerprints(prints: DataFrame, scratch: Scratch, radius: int = RADIUS, cell: int = CELL) -> DataFrame:
    """(fingerprint, n_near, near_class) of distinct fingerprints that have others within the radius.

    n_near counts those others; near_class is the least fingerprint of all that chains of such links lead to.
    """
    n = prints.count()
    tables = Tables(n, radius)
    rows = _buckets(prints, tables)
    shared = with_totals(rows, "bucket", n * len(tables.masks), "_n > 1", (scratch, "buckets"), _n=F.count(F.lit(1)))
    # A fingerprint's own block meets every block; two of a kind form a cell, and one with itself.
    own = shared.withColumn("_blocks", F.ceil(F.col("_n") / cell).cast("int")).withColumn("_own", F.pmod(F.xxhash64("fingerprint", F.lit(7)), F.col("_blocks")).cast("int"))
    met = own.select("bucket", "table", "fingerprint", "_own", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_met"))
    cells = met.select("bucket", F.least("_own", "_met").alias("x"), F.greatest("_own", "_met").alias("y"), "table", (F.col("_own") > F.col("_met")).alias("side"), "fingerprint")
    names = ["bucket", "x", "y"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key = [], None

        def ready() -> Iterator[pa.RecordBatch]:
            side, names_ = np.array([r[0] for r in held], bool), [r[1] for r in held]
            if len(held) > 1 and (key[1] == key[2] or (side.any() and not side.all())):
                links, label = _compare(_numbers(pa.array(names_)), side, key[3], tables)
                at = np.flatnonzero(links)
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array([names_[k] for k in at]), pa.array(links[at], pa.int64()), pa.array([names_[k] for k in label[at]])],
                        names=["fingerprint", "links", "root"])

        for b in batches:
            for *own, side, name in zip(*(c.to_pylist() for c in b.columns)):
                if own != key:
                    if held:
                        yield from ready()
                    held, key = [], own
                held.append((side, name))
        if held:
            yield from ready()

    compared = cells.repartition(*names).sortWithinPartitions(*names, "table", "side", "fingerprint").mapInArrow(run, "fingerprint string, links long, root string")
    found = scratch.save(compared, "near")
    counts = found.groupBy("fingerprint").agg(F.sum("links").alias("n_near"))
    classes = components(found.select(F.col("fingerprint").alias("a"), F.col("root").alias("b")), scratch, "classes")
    return counts.join(classes.select(F.col("node").alias("fingerprint"), F.col("root").alias("near_class")), "fingerprint")


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "simhash")
    rows = with_edits(read_table(spark, sf_dir, "documents"), scratch)
    prints = scratch.save(rows.select("fingerprint").distinct(), "fingerprints")
    near = near_fingerprints(prints, scratch)
    return rows.join(near, "fingerprint", "left").select("doc_id", *(n for n, _ in _PAIRED), F.coalesce("n_near", F.lit(0)).alias("n_near"), F.coalesce("near_class", "fingerprint").alias("near_class"))
