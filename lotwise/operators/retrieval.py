"""Exact top-k cosine search within jobs, and what is built on it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotwise.functions.rules import strip
from lotwise.operators.scratch import Scratch, running

#: Chunks of a job that are searched in one cell, and queries that it holds, about.
SLICE_ROWS, BLOCK_ROWS = 100_000, 4_096
#: Scores that a task holds at once, about.
SCORES = 4 << 20


def l2_normalize(vector: Column) -> Column:
    """Unit vector; a zero vector stays."""
    length = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    return F.transform(vector, lambda x: F.when(length > 0, x / length).otherwise(x.cast("double")))


def embedding_batches(chunks: DataFrame, size: int = 100, most_chars: int = 6000) -> DataFrame:
    """Chunks of a job in order, cut to the model's limit, with batch number and reference."""
    rows = running(chunks.select("job_id", "file_id", "chunk_index", F.substring("text", 1, most_chars).alias("text")), "job_id", ["file_id", "chunk_index"], F.lit(1), "position")
    return rows.select("job_id", "file_id", "chunk_index", "position", F.floor(F.col("position") / size).alias("batch"), "text", F.concat(F.lit("vector:"), "job_id",
        F.lit(":"), "position").alias("reference"))


def _unit(rows: list) -> np.ndarray:
    m = np.array([np.asarray(x, np.float64) for x in rows])
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=m, where=n > 0)


def _best(scores: np.ndarray, k: int) -> np.ndarray:
    """Which scores are the k best of their row; of those equal to the last of them, the first."""
    if scores.shape[1] <= k:
        return np.ones(scores.shape, bool)
    last = -np.partition(-scores, k - 1, axis=1)[:, k - 1 : k]
    above, equal = scores > last, scores == last
    return above | (equal & (np.cumsum(equal, axis=1) <= k - above.sum(axis=1, keepdims=True)))


def _cells(queries: DataFrame, chunks: DataFrame, slice_rows: int, block_rows: int) -> DataFrame:
    """Query and chunk rows dealt to cells (job_id, slice, block): a slice of a job's chunks with a block of its queries.

    A chunk goes to every block of its job's queries and a query to every slice of its job's chunks, so that no task holds
    a whole job; most jobs have one block, so chunks are shuffled once.
    """
    parts = lambda n, most: F.ceil(F.col(n) / most).cast("int")
    slices = chunks.groupBy("job_id").agg(F.count("*").alias("_n")).select("job_id", parts("_n", slice_rows).alias("_slices"))
    blocks = queries.groupBy("job_id").agg(F.count("*").alias("_n")).select("job_id", parts("_n", block_rows).alias("_blocks"))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    sizes = slices.join(blocks, "job_id")
    mine = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    q = queries.join(sizes, "job_id").select("job_id", each("_slices").alias("slice"), mine("query_id", "_blocks").alias("block"), F.lit(0).alias("side"),
        F.lit(-1).cast("long").alias("position"), F.col("query_id").alias("id"), "embedding")
    c = chunks.join(sizes, "job_id").select("job_id", mine("chunk_id", "_slices").alias("slice"), each("_blocks").alias("block"), F.lit(1).alias("side"), "position",
        F.col("chunk_id").alias("id"), "embedding")
    return q.unionByName(c)


def topk_cosine(queries: DataFrame, chunks: DataFrame, k: int = 5, slice_rows: int = SLICE_ROWS, block_rows: int = BLOCK_ROWS, decimals: int = 6) -> DataFrame:
    """The k best chunks (job_id, query_id, chunk_id, position, score, rank, total_searched) of each query's own job, exactly.

    Scores are rounded to so many decimals before they are ranked; of equal ones the first position counts.

    A cell's queries come first and are held, at most about block_rows of them; its chunks pass by in batches, each of
    which yields its own k best per query. A window keeps the k best of those. total_searched is how many a query got.
    """
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, ids, vectors, units = None, [], [], None
        for f in frames:
            for cell, g in f.groupby(["job_id", "slice", "block"], sort=False):
                if cell != now:
                    now, ids, vectors, units = cell, [], [], None
                asked, g = g[g.side == 0], g[g.side == 1]
                ids += list(asked.id)
                vectors += list(asked.embedding)
                if not len(g) or not ids:
                    continue
                if units is None:
                    units = _unit(vectors)
                near, step = _unit(list(g.embedding)).T, max(1, SCORES // len(g))
                for at in range(0, len(ids), step):
                    scores = np.round(units[at : at + step] @ near, decimals)
                    row, column = np.nonzero(_best(scores, k))
                    yield pd.DataFrame({"job_id": cell[0], "query_id": np.array(ids, object)[at + row], "chunk_id": g.id.to_numpy()[column],
                        "position": g.position.to_numpy()[column], "score": scores[row, column]})

    cell = ["job_id", "slice", "block"]
    dealt = _cells(queries, chunks, slice_rows, block_rows).repartition(*cell).sortWithinPartitions(*cell, "side", "position")
    scored = dealt.mapInPandas(run, "job_id string, query_id string, chunk_id string, position long, score double").withColumn("score", F.round("score", decimals))
    by_query = Window.partitionBy("job_id", "query_id")
    best = scored.withColumn("rank", F.row_number().over(by_query.orderBy(F.desc("score"), "position"))).where(F.col("rank") <= k)
    return best.withColumn("total_searched", F.count("*").over(by_query))


def _pivots(chunks: DataFrame, most: int) -> DataFrame:
    """(job_id, cell, embedding) of about the root of a job's chunks, `most` at most, taken by the hash of their ids."""
    wanted = chunks.groupBy("job_id").agg(F.least(F.ceil(F.sqrt(F.count("*"))), F.lit(most)).alias("_wanted"))
    # The window keeps the first few of each job before its shuffle.
    turn = F.row_number().over(Window.partitionBy("job_id").orderBy(F.xxhash64("chunk_id"), "chunk_id"))
    few = chunks.select("job_id", "chunk_id", "embedding").withColumn("cell", turn).where(F.col("cell") <= most)
    return few.join(wanted, "job_id").where(F.col("cell") <= F.col("_wanted")).select("job_id", F.col("cell").cast("string").alias("cell"), "embedding")


def _nearest(pivots: DataFrame, chunks: DataFrame) -> DataFrame:
    """chunks (job_id, chunk_id, position, embedding) with the cell of the nearest pivot and the distance of unit vectors from it."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, ids, vectors, units = None, [], [], None
        for f in frames:
            for cell, g in f.groupby(["job_id", "slice", "block"], sort=False):
                if cell != now:
                    now, ids, vectors, units = cell, [], [], None
                asked, g = g[g.side == 0], g[g.side == 1]
                ids += list(asked.id)
                vectors += list(asked.embedding)
                if not len(g) or not ids:
                    continue
                units = _unit(vectors) if units is None else units
                own = _unit(list(g.embedding))
                apart = np.maximum((own**2).sum(1)[:, None] + (units**2).sum(1)[None, :] - 2 * own @ units.T, 0)
                at = apart.argmin(1)
                yield pd.DataFrame({"job_id": cell[0], "cell": np.array(ids, object)[at], "chunk_id": g.id, "position": g.position, "embedding": g.embedding,
                    "distance": np.sqrt(apart[np.arange(len(at)), at])})

    cell = ["job_id", "slice", "block"]
    dealt = _cells(pivots.withColumnRenamed("cell", "query_id"), chunks, SLICE_ROWS, BLOCK_ROWS).repartition(*cell).sortWithinPartitions(*cell, "side", "position", "id")
    return dealt.mapInPandas(run, "job_id string, cell string, chunk_id string, position long, embedding array<float>, distance double")


#: What numbers of the bounds may be off by, more than scores are rounded by.
SLACK = 1e-5


def topk_pruned(queries: DataFrame, chunks: DataFrame, k: int = 5, most_pivots: int = 256) -> DataFrame:
    """topk_cosine's rows, exactly, with n_compared: how many chunks a query was compared with.

    A job's chunks lie in cells around pivots. Within a cell of radius r, no chunk is nearer to a query than its pivot's
    distance less r, which bounds their scores. A query is compared with the cells that promise most until they hold k
    chunks; of the others, only with those whose bound reaches the k-th of these scores. Worth while where many queries
    meet large jobs of clustered vectors: it takes more shuffles than comparing all.
    """
    scratch = Scratch(queries.sparkSession, "topk")
    pivots = scratch.save(_pivots(chunks, most_pivots), "pivots")
    placed = scratch.save(_nearest(pivots, chunks.select("job_id", "chunk_id", "position", "embedding")), "placed")
    cells = placed.groupBy("job_id", "cell").agg(F.max("distance").alias("_radius"), F.count("*").alias("n")).join(pivots, ["job_id", "cell"])
    unit = lambda c: l2_normalize(F.col(c))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    asked = queries.select("job_id", "query_id", unit("embedding").alias("_q"))
    met = asked.join(cells.select("job_id", "cell", "n", "_radius", unit("embedding").alias("_p")), "job_id")
    apart = F.sqrt(F.greatest(dot(F.col("_q"), F.col("_q")) + dot(F.col("_p"), F.col("_p")) - 2 * dot(F.col("_q"), F.col("_p")), F.lit(0.0)))
    gap = F.greatest(apart - F.col("_radius") - SLACK, F.lit(0.0))
    bound = (dot(F.col("_q"), F.col("_q")) + 1 - gap * gap) / 2 + SLACK
    promising = Window.partitionBy("job_id", "query_id").orderBy(F.desc("bound"), "cell").rowsBetween(Window.unboundedPreceding, -1)
    pairs = met.select("job_id", "query_id", "cell", "n", bound.alias("bound")).withColumn("near", F.coalesce(F.sum("n").over(promising), F.lit(0)) < k)
    pairs = scratch.save(pairs, "pairs")

    def compared(some: DataFrame, name: str) -> DataFrame:
        """The k best of each query in each of its cells, each cell searched as a job of its own."""
        within = lambda df: df.withColumn("job_id", F.concat("job_id", F.lit(":"), "cell"))
        wanted = within(some.join(queries.select("job_id", "query_id", "embedding"), ["job_id", "query_id"])).select("job_id", "query_id", "embedding")
        found = topk_cosine(wanted, within(placed), k).withColumn("job_id", F.regexp_replace("job_id", ":[^:]*$", ""))
        return scratch.save(found.select("job_id", "query_id", "chunk_id", "position", "score"), name)

    by_query = Window.partitionBy("job_id", "query_id")
    place = F.row_number().over(by_query.orderBy(F.desc("score"), "position"))
    first = compared(pairs.where("near"), "first")
    least = first.withColumn("_at", place).where(F.col("_at") == k).select("job_id", "query_id", F.col("score").alias("_least"))
    more = scratch.save(pairs.where("not near").join(least, ["job_id", "query_id"], "left").where("_least is null or bound >= _least").drop("_least"), "more")
    best = first.unionByName(compared(more, "second")).withColumn("rank", place).where(F.col("rank") <= k)
    counts = pairs.where("near").select("job_id", "query_id", "n").unionByName(more.select("job_id", "query_id", "n")).groupBy("job_id", "query_id").agg(F.sum("n").alias("n_compared"))
    return best.withColumn("total_searched", F.count("*").over(by_query)).join(counts, ["job_id", "query_id"])


def blank_queries(queries: DataFrame) -> DataFrame:
    """(job_id, query_id, error) of queries (with a column text) that ask nothing."""
    blank = F.coalesce(strip(F.col("text")), F.lit("")) == ""
    return queries.where(blank).select("job_id", "query_id", F.lit("EMPTY_QUERY").alias("error"))


def retrieve(queries: DataFrame, chunks: DataFrame, k: int = 5, least: float = 0.3, decimals: int = 6) -> DataFrame:
    """topk_cosine's rows of a least score (as rounded) with the chunk's file, and its text and page where chunks have them.

    Queries whose text is blank get none (see blank_queries).
    """
    asked = queries if "text" not in queries.columns else queries.where(F.coalesce(strip(F.col("text")), F.lit("")) != "")
    shown = [c for c in ("file_id", "text", "page") if c in chunks.columns]
    return topk_cosine(asked, chunks, k, decimals=decimals).where(F.col("score") >= least).join(chunks.select("job_id", "chunk_id", *shown), ["job_id", "chunk_id"])


def bidder_context(queries: DataFrame, chunks: DataFrame, files: DataFrame, k: int = 15, least: float = 0.15, decimals: int = 6) -> DataFrame:
    """Chunks per query and bidder file, in order of place: its share of the job's best by rank, or all its chunks by position where it has none."""
    rows = ["job_id", "query_id", "file_id"]
    hits = retrieve(queries, chunks, k, least, decimals).select(*rows, "chunk_id", F.col("rank").cast("long").alias("place"))
    wanted = queries.select("job_id", "query_id").join(files.select("job_id", "file_id"), "job_id")
    every = wanted.join(hits.select(*rows).distinct(), rows, "left_anti").join(chunks.select("job_id", "file_id", "chunk_id", F.col("position").alias("place")), ["job_id", "file_id"])
    return hits.join(wanted, rows, "left_semi").unionByName(every.select(*rows, "chunk_id", "place"))


def context_texts(context: DataFrame, chunks: DataFrame) -> DataFrame:
    """Per query and bidder file the texts of its context in order, parted by lines of dashes."""
    texts = context.join(chunks.select("job_id", "chunk_id", "text"), ["job_id", "chunk_id"])
    ordered = F.array_sort(F.collect_list(F.struct("place", "chunk_id", "text")))
    return texts.groupBy("job_id", "query_id", "file_id").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "\n\n---\n\n").alias("context"))
