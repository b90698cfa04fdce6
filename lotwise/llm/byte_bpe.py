"""Operator 6: byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

Long texts are split first at boundaries that no match of the pre-splitting pattern can span, so one call never sees
more than about `piece_chars` characters unless a single pre-token is longer. Null counts as an empty text; an empty
text has no ids; repeated rows give repeated results (nothing is ranked, so nothing ties); an empty table gives no rows;
extra columns are kept unless `out` columns would clash, in which
case the operator's own column replaces the old one.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lotwise.llm.common import read_table

#: Texts up to this many characters go to the library whole.
PIECE_CHARS = 100_000
#: Rows whose ids a worker holds at once.
ROWS = 500
#: White space after something else always starts a new match, and so does a change of class after a letter or a digit
#: (an apostrophe before a letter may be a contraction, so punctuation is no safe left side).
SAFE = regex.compile(r"(?<=\S)(?=\s)|(?<=\p{L})(?=[^\p{L}\s])|(?<=\p{N})(?=[^\p{N}\s])")


def safe_pieces(text: str, piece_chars: int = PIECE_CHARS) -> Iterator[str]:
    """Cut text at the first safe boundary at or after each piece_chars characters; the pieces join to the text."""
    at = 0
    while len(text) - at > piece_chars:
        m = SAFE.search(text, at + piece_chars)
        if not m or m.start() >= len(text):
            break
        yield text[at : m.start()]
        at = m.start()
    if at < len(text):
        yield text[at:]


@functools.lru_cache(maxsize=4)
def encoding(rank_file: str, pattern: str):
    """The library's encoder for a rank file, one per Python worker."""
    import tiktoken

    with open(rank_file, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def encode_text(text: str | None, rank_file: str, pattern: str, piece_chars: int = PIECE_CHARS) -> list[int]:
    """Ids of a text, each match of the pattern encoded separately, special strings as ordinary text."""
    enc, ids = encoding(rank_file, pattern), []
    for piece in safe_pieces(text or "", piece_chars):
        ids.extend(enc.encode_ordinary(piece))
    return ids


def encode(df: DataFrame, rank_file: str, pattern: str, text: str = "text", out: str = "ids", piece_chars: int = PIECE_CHARS) -> DataFrame:
    """df with an array<int> column `out` of token ids of `text`. Row-local: no shuffle."""
    keep = [c for c in df.columns if c != out]
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(out, T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                b = whole.slice(at, ROWS)
                ids = [np.array(encode_text(x, rank_file, pattern, piece_chars), np.int32) for x in b.column(keep.index(text)).to_pylist()]
                offsets = np.cumsum([0, *map(len, ids)], dtype=np.int32)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(offsets, np.concatenate(ids))], names=[*keep, out])

    return df.select(*keep).mapInArrow(run, schema)


def decode(df: DataFrame, rank_file: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """df with a binary column `out`: the raw bytes that the ids stand for (null ids: no bytes)."""
    keep = [c for c in df.columns if c != out]
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(out, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(rank_file, pattern)
        for b in batches:
            raw = pa.array([enc.decode_bytes(x or []) for x in b.column(keep.index(ids)).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns, raw], names=[*keep, out])

    return df.select(*keep).mapInArrow(run, schema)


@functools.lru_cache(maxsize=4)
def _decimals(n: int) -> list[bytes]:
    return [b"%d" % i for i in range(n)]


def round_trip_digests(df: DataFrame, rank_file: str, pattern: str, key: str = "doc_id", text: str = "text", piece_chars: int = PIECE_CHARS) -> DataFrame:
    """Per row: n_tokens, SHA-256 of the ids joined by commas, and SHA-256 of the bytes decoded from those ids.

    Encodes and decodes in one pass over the rows, piece by piece, so neither ids nor texts travel between stages.
    """
    schema = T.StructType([df.schema[key], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])

    def one(value: str | None) -> tuple[int, str, str]:
        enc, n, ids_sum, text_sum = encoding(rank_file, pattern), 0, hashlib.sha256(), hashlib.sha256()
        names = _decimals(enc.n_vocab)
        for piece in safe_pieces(value or "", piece_chars):
            ids = enc.encode_ordinary(piece)
            ids_sum.update(b"," * bool(n) + b",".join([names[i] for i in ids]))
            text_sum.update(enc.decode_bytes(ids))
            n += len(ids)
        return n, ids_sum.hexdigest(), text_sum.hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [one(x) for x in b.column(1).to_pylist()]
            n, a, d = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())], names=schema.names)

    return df.select(key, text).mapInArrow(run, schema)


def vocabulary() -> tuple[str, str]:
    """The rank file and the pattern that the query uses."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip_digests(read_table(spark, sf_dir, "documents"), *vocabulary())


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last pipeline stage: doc_id, n_tokens and ids of every document that is left; texts and other columns end here."""
    encoded = encode(docs.select("doc_id", "text"), *vocabulary())
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")
