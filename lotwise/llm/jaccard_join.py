"""Operator 8: n-gram Jaccard join by chosen paths.

Texts become sets of runs of `WORDS` words; equal sets are one class and are joined once. Each set is embedded as `SIZE`
minhash values. A run of the join starts from one node that holds all sets and splits a node by sampled values: a child
takes the sets that share that value, and each value is sampled with chance 1 / (threshold * SIZE), so that two sets at
the threshold are expected to meet in one child. Nodes of at most `SMALL` sets are compared by brute force (on the
embedding, with slack); larger ones are split again, except where splitting is of no use: a large node half of whose
sets share one more value, drawn by its path, is a crowd of near copies and is passed on whole, as are those still large
after `DEPTH` splits, so no link is lost to a cap. Where the large nodes have at most `FREQUENT` rows in all, they are
compared as well. Runs are repeated until the chance of meeting, 1 - (1 - f) ** runs with f the chance of a pair at
the threshold to meet at full depth, reaches `RECALL`.

What met is gathered into groups (components), and within each group every pair is compared exactly, once, on whole sets:
groups are cut into cells of two blocks, whose size is bounded, and a cell yields a count of links and one edge per set,
never its pairs. So links in a group of n different texts take n * n / 2 comparisons, spread over cells, and O(n) rows per
block. Blocks are cut by set size, and blocks whose sizes are too far apart to link are not compared.

Words are maximal runs of bytes that aren't ASCII white space. A text of fewer than WORDS words but at least one has one
run, all its words. Null, empty and wordless texts link to nothing; each row of them is a class of its own. Work is done on
distinct sets, which have numbers of their own, so doc_ids may repeat: every row gives one row, rows of equal texts are
copies, and rows of one doc_id but other texts are judged by their texts. Null doc_ids come after all others; a class of
none but null ids has a null class_id. An empty table gives no rows; extra columns are ignored. Runs are told apart by
64-bit hashes. A text of any length is one row: its set takes memory in proportion to the text.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwise.llm.common import Scratch, mix, read_table, shingle_hashes, word_hashes
from lotwise.llm.components import FREQUENT, components, with_totals

WORDS, THRESHOLD, RECALL = 5, 0.8, 0.99
SIZE, SMALL, DEPTH = 128, 64, 4
#: Estimates of similarity this far under the threshold (four standard errors) still count as met.
SLACK = 4 * math.sqrt(THRESHOLD * (1 - THRESHOLD) / SIZE)
#: Runs of words in a block of a group on average, and sets in it if they are short: both bound the memory of a cell.
BLOCK_SHINGLES, BLOCK_SETS = 1 << 17, 2048
_random = np.random.default_rng(8)
_A = _random.integers(1, 1 << 63, SIZE, np.uint64) | np.uint64(1)
_B = _random.integers(0, 1 << 63, SIZE, np.uint64)


def runs_for(recall: float, depth: int) -> int:
    """Runs after which a pair at the threshold has met with chance `recall`: a critical branching process each."""
    f = 1.0
    for _ in range(depth):
        f = 1 - math.exp(-f)
    return math.ceil(math.log(1 - recall) / math.log(1 - f))


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of a text's runs of words."""
    return np.unique(shingle_hashes(word_hashes((text or "").encode()), words))


def embed(sets: np.ndarray) -> np.ndarray:
    """SIZE minhash values of 32 bits of a non-empty set."""
    out = np.full(SIZE, 0xFFFFFFFF, np.uint64)
    for at in range(0, len(sets), 1024):
        part = (sets[at : at + 1024, None] * _A + _B) >> np.uint64(32)
        np.minimum(out, part.min(axis=0), out=out)
    return out.astype(np.uint32)


def row_key(key: str, text: str) -> Column:
    """What tells rows apart: doc_id and text; rows equal in both are repeats."""
    return F.unhex(F.md5(F.concat_ws(":", F.coalesce(F.col(key).cast("string"), F.lit("?")), F.coalesce(F.col(text), F.lit(""))).cast("binary")))


def sketch(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """(doc_id, row_key, n, set_id, minhashes) of each row; set_id and minhashes are null where there are no words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, ids, hashes = [], [], []
            for x in b.column(2).to_pylist():
                s = shingles(x, words)
                n.append(len(s))
                ids.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                hashes.append(embed(s).tobytes() if len(s) else None)
            made = [pa.array(n, pa.int64()), pa.array(ids, pa.binary()), pa.array(hashes, pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *made], names=["doc_id", "row_key", "n", "set_id", "minhashes"])

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), row_key(key, text).alias("row_key"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, row_key binary, n long, set_id binary, minhashes binary")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, SIZE)


def _chosen(paths: np.ndarray, threshold: float) -> np.ndarray:
    """Which values each path's node samples: a matrix of nodes by values."""
    places = mix(np.arange(1, SIZE + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
    return mix(paths[:, None] ^ places) < np.uint64(int(2**64 / (threshold * SIZE)))


def _child(paths: np.ndarray, places: np.ndarray, values: np.ndarray) -> np.ndarray:
    return mix(mix(paths + places.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ values.astype(np.uint64)).view(np.int64)


def first_nodes(sets: DataFrame, runs: int, threshold: float = THRESHOLD) -> DataFrame:
    """(path, rep): the children of every run's first node that each set (rep, minhashes) is in."""
    roots = mix(np.arange(1, runs + 1, dtype=np.uint64))
    run_at, place = np.nonzero(_chosen(roots, threshold))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values, reps = _matrix(b.column(1)), b.column(0).to_numpy()
            for at in range(0, len(reps), 4096):
                part = values[at : at + 4096]
                path = _child(roots[run_at][None, :], place[None, :], part[:, place])
                yield pa.RecordBatch.from_arrays([pa.array(path.ravel()), pa.array(np.repeat(reps[at : at + 4096], len(place)))], names=["path", "rep"])

    return sets.select("rep", "minhashes").mapInArrow(run, "path long, rep long")


def split(nodes: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(path, rep) of the children of nodes (path, rep, minhashes)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                c = b.slice(at, 4096)
                paths, values, reps = c.column(0).to_numpy().view(np.uint64), _matrix(c.column(2)), c.column(1).to_numpy()
                row, place = np.nonzero(_chosen(paths, threshold))
                yield pa.RecordBatch.from_arrays([pa.array(_child(paths[row], place, values[row, place])), pa.array(reps[row])], names=["path", "rep"])

    return nodes.select("path", "rep", "minhashes").mapInArrow(run, "path long, rep long")


def labels_of(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index linked to each of n, where a and b are linked."""
    label = np.arange(n)
    while True:
        before = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            return label


def compare_small(nodes: DataFrame, least: float) -> DataFrame:
    """Edges (a, b) of small nodes (path, rep, minhashes): sets whose estimated similarity is at least `least`.

    A node's rows come together; an edge leads from each set to the smallest it is linked to, so there are at most as
    many edges as rows.
    """
    def edges(paths: np.ndarray, reps: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
        found: list[tuple[np.ndarray, np.ndarray]] = []
        d = 1
        while d < len(paths):
            at = np.flatnonzero(paths[d:] == paths[:-d])
            if not len(at):
                break
            for k in range(0, len(at), 8192):
                part = at[k : k + 8192]
                alike = (values[part] == values[part + d]).mean(axis=1) >= least
                found.append((part[alike], part[alike] + d))
            d += 1
        a, b = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, int), np.zeros(0, int))
        label = labels_of(len(paths), a, b)
        moved = np.flatnonzero(label != np.arange(len(paths)))
        return pa.RecordBatch.from_arrays([pa.array(reps[moved]), pa.array(reps[label[moved]])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for b in batches:
            now = (b.column(0).to_numpy(), b.column(1).to_numpy(), _matrix(b.column(2)))
            if rest is not None:
                now = tuple(np.concatenate(x) for x in zip(rest, now))
            cut = int(np.searchsorted(now[0], now[0][-1])) if len(now[0]) else 0
            rest = tuple(x[cut:] for x in now)
            if cut:
                yield edges(*(x[:cut] for x in now))
        if rest is not None and len(rest[0]):
            yield edges(*rest)

    together = nodes.select("path", "rep", "minhashes").repartition("path").sortWithinPartitions("path", "rep")
    return together.mapInArrow(run, "a long, b long")


def candidate_edges(sets: DataFrame, scratch: Scratch, threshold: float = THRESHOLD, recall: float = RECALL, small: int = SMALL, depth: int = DEPTH) -> DataFrame:
    """Edges (a, b) between sets (rep, minhashes) that met in a small node alike, or in one passed on whole."""
    nodes, compared, edges = first_nodes(sets, runs_for(recall, depth), threshold), [], []
    for level in range(1, depth + 1):
        nodes = scratch.save(nodes, f"split-{level}")
        shared = scratch.save(with_totals(nodes, "path", nodes.count(), "size > 1", (scratch, f"sizes-{level}"), size=F.count("*")), f"nodes-{level}")
        large = shared.where(F.col("size") > small)
        few = large.count() <= FREQUENT
        compared.append((shared if few else shared.where(F.col("size") <= small)).select("path", "rep"))
        if few:
            break
        if level == depth:
            crowds = large.groupBy("path").agg(F.max("size").alias("size"), F.min("rep").alias("b"))
        else:
            probe = F.substring(F.col("minhashes"), 4 * F.pmod(F.xxhash64("path"), F.lit(SIZE)).cast("int") + 1, F.lit(4))
            values = large.join(sets.select("rep", "minhashes"), "rep").groupBy("path", "size", probe.alias("_value")).agg(F.count("*").alias("n"), F.min("rep").alias("b"))
            crowds = values.groupBy("path", "size").agg(F.max("n").alias("most"), F.min("b").alias("b")).where("2 * most >= size").select("path", "size", "b")
        crowds = scratch.save(crowds, f"crowds-{level}")
        edges.append(large.select("path", "rep").join(crowds.select("path", "b"), "path").where("rep <> b").select(F.col("rep").alias("a"), "b"))
        if level < depth:
            rest = large.select("path", "rep").join(crowds, "path", "left_anti")
            nodes = split(rest.join(sets.select("rep", "minhashes"), "rep"), threshold)
    every = compared[0]
    for more in compared[1:]:
        every = every.unionByName(more)
    edges.append(compare_small(every.join(sets.select("rep", "minhashes"), "rep"), threshold - SLACK))
    out = edges[0]
    for more in edges[1:]:
        out = out.unionByName(more)
    return out.distinct()


def cell_links(sets: list[np.ndarray], blocks: np.ndarray, across: bool, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of linked sets: those of one block with each other, or, across, those of two sides.

    Overlaps are counted by products of a dense incidence matrix, some columns at a time; only hashes that two sets have
    take part.
    """
    n = np.array([len(s) for s in sets])
    tokens, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), n)
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]
    starts = np.flatnonzero(np.concatenate(([True], tokens[1:] != tokens[:-1])))
    copies = np.diff(np.concatenate((starts, [len(tokens)])))
    column = np.repeat(np.cumsum(copies > 1) - 1, copies)
    shared = np.repeat(copies > 1, copies)
    owner, column = owner[shared], column[shared]
    overlap = np.zeros((len(sets), len(sets)), np.float32)
    width = 2048
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        lo, hi = np.searchsorted(column, [at, at + width])
        seen = np.zeros((len(sets), min(width, int(column[-1]) + 1 - at)), np.float32)
        seen[owner[lo:hi], column[lo:hi] - at] = 1
        overlap += seen @ seen.T
    a, b = [], []
    for at in range(0, len(sets), 256):
        rows = slice(at, at + 256)
        linked = overlap[rows].astype(np.float64) * (1 + threshold) >= threshold * (n[rows, None] + n[None, :]) - 1e-3
        if across:
            linked &= blocks[rows, None] != blocks[None, :]
        found = np.nonzero(np.triu(linked, at + 1))
        a.append(found[0] + at)
        b.append(found[1])
    return np.concatenate(a), np.concatenate(b)


def places_of(groups: DataFrame, scratch: Scratch, threshold: float, block_shingles: int, block_sets: int) -> DataFrame:
    """(rep, row_key, root, class, block, below, own, above): where each set of groups (rep, row_key, root, n) is compared.

    A group of at most one block is one cell. A larger one is cut into classes of size, a factor of 1 / threshold each, and
    those into blocks; below, own and above are the numbers of blocks of the class beneath, of the set's own and of the next
    one, as linked sets are at most one class apart.
    """
    weight = F.greatest("n", F.lit(max(1, block_shingles // block_sets)))
    whole = scratch.save(with_totals(groups, "root", groups.count(), into=(scratch, "weights"), _weight=F.sum(weight)), "group-weights")
    fits = F.col("_weight") <= block_shingles
    counts = {"class": 0, "block": 0, "below": 0, "own": 1, "above": 0}
    small = whole.where(fits).select("rep", "row_key", "root", *(F.lit(v).alias(k) for k, v in counts.items()))
    large = whole.where(~fits).select("rep", "row_key", "root", weight.alias("_weight"), F.floor(F.log("n") / -math.log(threshold)).cast("int").alias("class"))
    n_large = large.count()
    if not n_large:
        return small
    own = with_totals(large.withColumn("_of", F.struct("root", "class")), "_of", n_large, into=(scratch, "own-blocks"), own=F.ceil(F.sum("_weight") / block_shingles).cast("int"))
    own = scratch.save(own.drop("_of", "_weight").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("own")).cast("int")), "blocks")
    near = own.select("rep", "own", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))).alias("step"), "root", "class")
    near = near.withColumn("_of", F.struct("root", (F.col("class") + F.col("step")).alias("class")))
    near = with_totals(near, "_of", 3 * n_large, into=(scratch, "near-blocks"), blocks=F.max(F.when(F.col("step") == 0, F.col("own"))))
    sides = near.groupBy("rep").agg(*(F.coalesce(F.max(F.when(F.col("step") == k, F.col("blocks"))), F.lit(0)).alias(name) for k, name in ((-1, "below"), (1, "above"))))
    return small.unionByName(own.join(sides, "rep").select(small.columns))


def cells() -> Column:
    """The cells of a set's place: struct(low, i, high, j, side).

    Cell (low, i, high, j) compares block i of class low with block j of class high, the same class or the next one; sets
    of side 0 are of block i, those of side 1 of block j.
    """
    kind, block = F.col("class"), F.col("block")

    def each(n: str, low: Column, high: Column, first: Callable[[Column], Column]) -> Column:
        def cell(other: Column) -> Column:
            is_first = first(other)
            i, j = F.when(is_first, block).otherwise(other), F.when(is_first, other).otherwise(block)
            return F.struct(low.alias("low"), i.alias("i"), high.alias("high"), j.alias("j"), F.when(is_first, 0).otherwise(1).alias("side"))

        some = F.transform(F.sequence(F.lit(0), F.greatest(F.col(n) - 1, F.lit(0))), cell)
        return F.filter(some, lambda x: F.col(n) > 0)

    return F.concat(each("below", kind - 1, kind, lambda o: F.lit(False)), each("own", kind, kind, lambda o: block <= o), each("above", kind, kind + 1, lambda o: F.lit(True)))


def verify(texts: DataFrame, groups: DataFrame, scratch: Scratch, words: int = WORDS, threshold: float = THRESHOLD, block_shingles: int = BLOCK_SHINGLES, block_sets: int = BLOCK_SETS) -> DataFrame:
    """(rep, links, linked_to) rows from comparing all pairs within groups (rep, row_key, root, n), exactly.

    texts (row_key, text) has each set's text once. Texts and places meet in one shuffle, sets and their cells in the next.
    A set has a row for each cell in which it has links; linked_to is the smallest set of its part of the cell.
    """
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = pa.array([shingles(x, words).tobytes() for x in b.column(b.num_columns - 1).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], made], names=[*b.schema.names[:-1], "set"])

    placed = texts.join(places_of(groups, scratch, threshold, block_shingles, block_sets), "row_key")
    columns = ("rep long", "root long", "class int", "block int", "below int", "own int", "above int")
    made = placed.select(*(c.split()[0] for c in columns), "text").mapInArrow(sets, ", ".join(columns) + ", set binary")
    met = made.select("rep", "root", "set", F.explode(cells()).alias("_cell")).select("rep", "root", "set", "_cell.*")

    def one(rows: list[tuple]) -> Iterator[tuple[int, int, int]]:
        if len(rows) < 2:
            return
        reps = np.array([r[5] for r in rows])
        across = rows[0][1:3] != rows[0][3:5]
        a, b = cell_links([np.frombuffer(r[7], np.uint64) for r in rows], np.array([r[6] for r in rows]), across, threshold)
        links = np.bincount(a, minlength=len(rows)) + np.bincount(b, minlength=len(rows))
        label = labels_of(len(rows), a, b)
        for k in np.flatnonzero(links):
            yield int(reps[k]), int(links[k]), int(reps[label[k]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, out, now = [], [], None
        for b in batches:
            for row in zip(*(b.column(k).to_pylist() for k in range(8))):
                if row[:5] != now:
                    out.extend(one(held))
                    held, now = [], row[:5]
                held.append(row)
            if len(out) > 10_000:
                yield _links(out)
                out = []
        out.extend(one(held))
        if out:
            yield _links(out)

    cell = ["root", "low", "i", "high", "j"]
    dealt = met.select(*cell, "rep", "side", "set").repartition(*cell).sortWithinPartitions(*cell, "rep")
    return dealt.mapInArrow(run, "rep long, links long, linked_to long")


def _links(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["rep", "links", "linked_to"])


def judged(docs: DataFrame, scratch: Scratch, key: str = "doc_id", text: str = "text", words: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[DataFrame, DataFrame]:
    """(rows with words: doc_id, row_key, class, class_id, copy_of, n_links; rows without: doc_id).

    Aggregates are written before rows that may be many per key are joined with them, so that Spark can split those joins.
    """
    sketched = scratch.save(sketch(docs, key, text, words), "sketches")
    wordy = sketched.where("n > 0")
    distinct = wordy.groupBy("set_id").agg(F.min("doc_id").alias("copy_of"), F.min("n").alias("n"), F.min("row_key").alias("row_key"), F.first("minhashes").alias("minhashes"))
    sets = scratch.save(distinct.withColumn("rep", F.monotonically_increasing_id()), "sets")
    members = scratch.save(wordy.select("doc_id", "row_key", "set_id").join(sets.select("set_id", "rep"), "set_id").drop("set_id"), "members")
    edges = candidate_edges(sets.select("rep", "minhashes"), scratch, threshold, recall)
    met = components(edges, scratch, "met").select(F.col("node").alias("rep"), "root")
    groups = scratch.save(met.join(sets.select("rep", "n", "row_key"), "rep"), "groups")
    scratch.drop(*(f"{name}-{level}" for name in ("split", "sizes", "nodes", "crowds") for level in range(1, DEPTH + 1)))
    # Repeats are merged before the shuffle; the join then keeps its partitioning.
    texts = docs.select(row_key(key, text).alias("row_key"), F.col(text).alias("text")).dropDuplicates(["row_key"])
    links = scratch.save(verify(texts, groups, scratch, words, threshold), "links")
    roots = components(links.select(F.col("rep").alias("a"), F.col("linked_to").alias("b")), scratch, "linked").select(F.col("node").alias("rep"), "root")
    found = links.groupBy("rep").agg(F.sum("links").alias("n_links")).join(roots, "rep", "left")
    placed = sets.select("rep", "copy_of").join(found, "rep", "left").select("rep", "copy_of", F.coalesce("root", "rep").alias("class"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))
    placed = scratch.save(placed, "placed")
    classes = scratch.save(with_totals(placed, "class", placed.count(), into=(scratch, "class-ids"), class_id=F.min("copy_of")), "classes")
    return members.join(classes, "rep").drop("rep"), sketched.where("n = 0").select("doc_id")


def jaccard_classes(docs: DataFrame, scratch: Scratch, key: str = "doc_id", text: str = "text", words: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """One row per row of docs: doc_id, class_id, copy_of, n_links.

    copy_of is the smallest doc_id with an equal set, class_id the smallest of all documents that links connect, n_links
    the number of different sets that the document's set links to (similarity of at least the threshold).
    """
    linked, alone = judged(docs, scratch, key, text, words, threshold, recall)
    own = F.col("doc_id")
    return linked.select("doc_id", "class_id", "copy_of", "n_links").unionByName(alone.select("doc_id", own.alias("class_id"), own.alias("copy_of"), F.lit(0).cast("long").alias("n_links")))


def one_of_each(docs: DataFrame, scratch: Scratch, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each class, that of the smallest doc_id (of several texts the one of the smallest digest; of
    rows equal in doc_id and text any one), and all rows without words; columns stay as they are."""
    linked, _ = judged(docs, scratch, key, text)
    rank = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("row_key"))
    stay = linked.groupBy("class").agg(F.min_by("row_key", rank).alias("row_key"))
    own = "_row"
    while own in docs.columns:
        own += "_"
    has_words = F.coalesce(F.col(text), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    # Repeats are merged before the shuffle; the join then keeps its partitioning.
    distinct = docs.where(has_words).withColumn(own, row_key(key, text)).dropDuplicates([own])
    kept = distinct.join(stay.select(F.col("row_key").alias(own)), own, "left_semi").select(*docs.columns)
    return kept.unionByName(docs.where(~has_words))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(read_table(spark, sf_dir, "documents"), Scratch(spark, "jaccard-join"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each class one document stays."""
    return one_of_each(docs, Scratch(spark, "jaccard-join"))
