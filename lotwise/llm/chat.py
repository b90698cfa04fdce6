"""Operator 9: chat formatting with typed content parts.

A visitor flattens the parts of each turn (text, image, audio, document) in order: texts are escaped, other parts become
placeholders that carry their position in the conversation and their expanded token count. The template marks turns and
is parsed back exactly, because no escaped text can hold a control string.

Conversations are formatted as a stream: rows are dealt by conversation and sorted by turn, each turn is written in
order, and output is cut into pieces of at least `piece_chars` characters, so a conversation of any length needs bounded
memory. Rows of equal conversation and turn, repeated ones too, are ordered by role, then content, and each is a turn. Null
roles, texts and kinds are empty (a null kind is a text), null units are one; null conversation ids form one group; an
empty table gives no rows; extra columns are ignored. A kind that no visitor's method knows is an error.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lotwise.llm.common import read_table

#: One part: kind is text, image, audio or document; ref names an attachment; units are tiles, seconds or pages.
PART = T.StructType([T.StructField("kind", T.StringType()), T.StructField("text", T.StringType()), T.StructField("ref", T.StringType()), T.StructField("units", T.LongType())])
#: Tokens that stand for one unit of an attachment once the model's input is expanded, and a fixed frame around them.
TOKENS_PER_UNIT, FRAME_TOKENS = {"image": 256, "audio": 25, "document": 640}, 2
#: The template's control strings. ESC starts each of them and each escape, so a text holds none once ESC is escaped.
ESC = "<|"
OPEN, MIDDLE, CLOSE = "<|turn:", "|>", "<|end|>\n"
#: What an ESC inside a text becomes; its own second character makes it reversible. "[" and "</" start
#: control strings of other common templates, so they are escaped as well.
#: A last "<" is escaped too, lest the next part complete a control string, and "|>" so that roles end where they end.
ESCAPES = {"<|": "<|lt|>", "[": "<|lb|>", "</": "<|ls|>", "<": "<|la|>", "|>": "<|lc|>"}
_ESCAPE = re.compile(r"<\||\[|</|<\Z|\|>")
_UNESCAPES = {v: k for k, v in ESCAPES.items()}
_UNESCAPE = re.compile(r"<\|l[tbsac]\|>")
_PLACE = re.compile(r"<\|(image|audio|document):(\d+):(\d+)\|>")
_TURN = re.compile(r"<\|turn:((?:[^<|]|<(?!\|)|\|(?!>)|<\|l[tbsac]\|>)*)\|>(.*?)<\|end\|>\n", re.S)
#: The role whose texts are learned.
LEARNED = "assistant"
PIECE_CHARS = 1 << 20

OUTPUT = T.StructType([
    T.StructField("conv_id", T.LongType()),
    T.StructField("piece", T.LongType()),
    T.StructField("formatted", T.StringType()),
    T.StructField("loss_spans", T.ArrayType(T.ArrayType(T.LongType()))),
    T.StructField("attachments", T.ArrayType(T.StructType([T.StructField("position", T.LongType()), T.StructField("kind", T.StringType()), T.StructField("ref",
        T.StringType()), T.StructField("tokens", T.LongType())]))),
    T.StructField("expanded_tokens", T.LongType()),
])


def escape(text: str) -> str:
    """Text without any control string; unescape() gives the text back."""
    return _ESCAPE.sub(lambda m: ESCAPES[m[0]], text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: _UNESCAPES[m[0]], text)


class Flatten:
    """The visitor: one method per kind of part; counts attachments through a conversation."""

    def __init__(self):
        self.position = 0

    def visit(self, part: dict) -> tuple[str, dict | None]:
        return getattr(self, f"visit_{part['kind'] or 'text'}", self.visit_unknown)(part)

    def visit_text(self, part: dict) -> tuple[str, None]:
        return escape(part["text"] or ""), None

    def attachment(self, part: dict) -> tuple[str, dict]:
        tokens = TOKENS_PER_UNIT[part["kind"]] * max(1, part["units"] or 1) + FRAME_TOKENS
        found = {"position": self.position, "kind": part["kind"], "ref": part["ref"], "tokens": tokens}
        self.position += 1
        return f"<|{part['kind']}:{found['position']}:{tokens}|>", found

    visit_image = visit_audio = visit_document = attachment

    def visit_unknown(self, part: dict) -> tuple[str, None]:
        raise ValueError(f"unknown kind of content part: {part['kind']!r}")


def text_parts(turns: DataFrame, text: str = "text") -> DataFrame:
    """Rows of plain texts as rows of typed parts, one text part each."""
    part = F.struct(F.lit("text").alias("kind"), F.col(text).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("long").alias("units"))
    return turns.select("conv_id", "turn", "role", F.array(part).alias("parts"))


def format_chat(turns: DataFrame, piece_chars: int = PIECE_CHARS) -> DataFrame:
    """Format turns (conv_id, turn, role, parts array<PART>) into OUTPUT rows, pieces of a conversation in order.

    loss_spans are [start, end) code points of learned texts within the piece; a turn is never cut, so joining a
    conversation's pieces in order gives its whole formatted text. One shuffle, by conversation.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, piece, visitor, held = object(), 0, Flatten(), None
        out: list[dict] = []

        def fresh(conv: int | None) -> dict:
            return {"conv_id": conv, "piece": piece, "formatted": [], "loss_spans": [], "attachments": [], "expanded_tokens": 0, "chars": 0}

        def flush() -> None:
            out.append(held | {"formatted": "".join(held["formatted"])})

        def ready() -> pa.RecordBatch:
            b = pa.RecordBatch.from_pylist([{k: v for k, v in x.items() if k != "chars"} for x in out], schema=_arrow_schema())
            out.clear()
            return b

        size = 0
        for b in batches:
            for row in b.to_pylist():
                if row["conv_id"] != now or held is None:
                    if held is not None:
                        flush()
                    now, piece, visitor = row["conv_id"], 0, Flatten()
                    held = fresh(now)
                elif held["chars"] >= piece_chars:
                    flush()
                    piece += 1
                    held = fresh(now)
                role = row["role"] or ""
                head = f"{OPEN}{escape(role)}{MIDDLE}"
                at = held["chars"] + len(head)
                body = []
                for part in row["parts"] or ():
                    shown, found = visitor.visit(part)
                    if found:
                        held["attachments"].append(found)
                        held["expanded_tokens"] += found["tokens"]
                    elif role == LEARNED and shown:
                        held["loss_spans"].append([at, at + len(shown)])
                    body.append(shown)
                    at += len(shown)
                held["formatted"] += [head, *body, CLOSE]
                held["chars"] = at + len(CLOSE)
                size += at
                if len(out) >= 1000 or size > 4 * piece_chars:
                    size = 0
                    if out:
                        yield ready()
        if held is not None:
            flush()
        if out:
            yield ready()

    keyed = turns.select(F.col("conv_id").cast("long"), "turn", "role", "parts")
    ordered = keyed.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", F.col("parts"))
    return ordered.mapInArrow(run, OUTPUT)


def _arrow_schema() -> pa.Schema:
    item = pa.struct([("position", pa.int64()), ("kind", pa.string()), ("ref", pa.string()), ("tokens", pa.int64())])
    return pa.schema([("conv_id", pa.int64()), ("piece", pa.int64()), ("formatted", pa.string()), ("loss_spans", pa.list_(pa.list_(pa.int64()))), ("attachments",
        pa.list_(item)), ("expanded_tokens", pa.int64())])


def parse_turns(formatted: str) -> Iterator[tuple[str, str]]:
    """(role, text) of each turn of a formatted text; placeholders stay in the text as they are."""
    end = 0
    for m in _TURN.finditer(formatted):
        if m.start() != end:
            raise ValueError(f"no turn at character {end}")
        end = m.end()
        yield unescape(m[1]), unescape(m[2])
    if end != len(formatted):
        raise ValueError(f"no turn at character {end}")


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of format_chat()'s rows, read from the formatted text and the loss mask alone; pieces come in order.

    Runs in the tasks that wrote the pieces (no further shuffle) and hashes as a stream.
    """
    schema = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("n_turns", T.LongType()), T.StructField("turns_sha256", T.StringType()),
        T.StructField("loss_chars", T.LongType()), T.StructField("loss_sha256", T.StringType()), T.StructField("formatted_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, out = None, []

        def done() -> None:
            out.append({"conv_id": held[0], "n_turns": held[1], "turns_sha256": held[2].hexdigest(), "loss_chars": held[3], "loss_sha256": held[4].hexdigest(), "formatted_chars": held[5]})

        def ready() -> pa.RecordBatch:
            columns = {f.name: [x[f.name] for x in out] for f in schema}
            out.clear()
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(columns.values(), kinds)], names=schema.names)

        for b in batches:
            for row in b.select(["conv_id", "piece", "formatted", "loss_spans"]).to_pylist():
                if row["piece"] == 0:
                    if held:
                        done()
                    held = [row["conv_id"], 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                text = row["formatted"]
                for role, said in parse_turns(text):
                    held[1] += 1
                    held[2].update(f"{role}\n{said}\n".encode())
                for start, end in row["loss_spans"]:
                    learned = unescape(text[start:end])
                    held[3] += len(learned)
                    held[4].update(learned.encode())
                held[5] += len(text)
            if out:
                yield ready()
        if held:
            done()
        if out:
            yield ready()

    return formatted.mapInArrow(run, schema)


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return read_back(format_chat(text_parts(turns.unionByName(probe))))
