"""Operator 12: repair of conversation structure by weighted CYK interval parsing.

Turns must spell `(s?(ua)+)?` in their roles' initials. Edits are Keep (0), Rerole to user or assistant (1), Delete (2;
blank and duplicate turns must go) and Insert of an empty user or assistant turn (5); a truncated turn that stays adds 5.
The repair grammar is in Chomsky normal form: a nonterminal N[i, j] derives what takes the language's automaton from
state i to j, its rules are N[i, j] -> N[i, k] N[k, j] and, for single turns, the edits with the closure of insertions on
both sides. A span's cell holds the least (cost, audit) of every nonterminal. As all rules are of this one kind, every
split of a span gives the same cell, so one split is enough, and cells are combined bottom-up in spans of doubling length.

Of equally cheap repairs the one with the ASCII-least audit (edits' initials in order) is taken. Parts can be minimised
alone: of two audits of a span with equal cost neither starts with the other, since more insertions cost more.

A conversation's turns are streamed in order of turn (nulls first), role and text, SPAN turns or SPAN_CHARS characters at
once. Up to four prefixes, one per state, carry their cost, audit and the digest of what they have repaired to, so that a
conversation of any length takes the memory of a span and four audits; its digest needs its order, so it is one task's.

Null ids are a conversation of their own; null roles and texts count as one space. Rows with `alive` false have no part in
the conversation but keep its row in the result. Turns of equal role and text repeat an earlier one, whatever their turn;
turns without an initial, or with another, can't be kept. Empty tables give no rows; other columns are left out.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lotwise.llm.common import SPACES, read_table

RETYPE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Turns, and characters of them, that a task holds at once; widest spans whose cells are remembered, and how many.
SPAN, SPAN_CHARS, REMEMBERED_TURNS, REMEMBERED = 4096, 8 << 20, 32, 1 << 14
#: The automaton: what each state expects, and where a role's initial leads from it. States 0 and 3 accept.
STATES, ACCEPTING = range(4), (0, 3)
EXPECTED = ("user", "user", "assistant", "user")
STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
REPAIRED = "conv_id long, position long, edit string, role string, text string"
Found = tuple[int, str] | None
Cell = tuple[tuple[Found, ...], ...]


def _least(*found: Found) -> Found:
    return min((f for f in found if f is not None), default=None)


def combine(left: Cell, right: Cell) -> Cell:
    """N[i, j] -> N[i, k] N[k, j]: the cell of two spans next to each other."""
    def one(i: int, j: int) -> Found:
        return _least(*((a[0] + b[0], a[1] + b[1]) for k in STATES if (a := left[i][k]) is not None and (b := right[k][j]) is not None))

    return tuple(tuple(one(i, j) for j in STATES) for i in STATES)


def _insertions() -> Cell:
    """What insertions alone derive: the closure of single ones."""
    one = [[(0, "") if i == j else None for j in STATES] for i in STATES]
    for i in STATES:
        j = STEP[i, EXPECTED[i][0]]
        one[i][j] = _least(one[i][j], (INSERT, "I"))
    cell = tuple(map(tuple, one))
    while (more := combine(cell, cell)) != cell:
        cell = more
    return cell


CLOSURE = _insertions()


@functools.lru_cache(maxsize=64)
def leaf(symbol: str) -> Cell:
    """The cell of one turn: its role's initial (other: x), in upper case where it is truncated; d must go."""
    kept = symbol.lower()
    extra = TRUNCATED if symbol != kept else 0
    cell: list[list[Found]] = [[(DELETE, "D") if i == j else None for j in STATES] for i in STATES]
    for i in STATES if symbol != "d" else ():
        if (j := STEP.get((i, kept))) is not None:
            cell[i][j] = _least(cell[i][j], (extra, "K"))
        j = STEP[i, EXPECTED[i][0]]
        cell[i][j] = _least(cell[i][j], (RETYPE + extra, "R"))
    return combine(combine(CLOSURE, tuple(map(tuple, cell))), CLOSURE)


@functools.lru_cache(maxsize=REMEMBERED)
def _remembered(symbols: str) -> Cell:
    if len(symbols) == 1:
        return leaf(symbols)
    half = 1 << (len(symbols) - 1).bit_length() - 1
    return combine(_remembered(symbols[:half]), _remembered(symbols[half:]))


def parse(symbols: str) -> Cell:
    """The cell of a span of turns: cells of up to REMEMBERED_TURNS turns first, then of pairs of them, level by level."""
    cells = [_remembered(symbols[at : at + REMEMBERED_TURNS]) for at in range(0, len(symbols), REMEMBERED_TURNS)]
    while len(cells) > 1:
        paired = [combine(a, b) for a, b in zip(cells[::2], cells[1::2])]
        cells = paired + cells[2 * len(paired) :]
    return cells[0]


def replay(audit: str, turns: list[tuple[str, str]], state: int) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of the turns that an audit leaves or makes, from a state on."""
    rest = iter(turns)
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(rest)
        if edit == "D":
            continue
        if edit != "K":
            role = EXPECTED[state]
        state = STEP[state, role[:1]]
        yield edit, role, text


class Prefix:
    """A repair of a conversation's turns so far that ends in one state."""

    def __init__(self, cost: int = 0, audit: str = "", lines: int = 0, digest=None):
        self.cost, self.audit, self.lines, self.digest = cost, audit, lines, digest or hashlib.sha256()

    def after(self, found: Found, turns: list[tuple[str, str]], state: int) -> Prefix:
        new = Prefix(self.cost + found[0], self.audit + found[1], self.lines, self.digest.copy())
        for _, role, text in replay(found[1], turns, state):
            new.digest.update(f"{chr(10) if new.lines else ''}{role}:{text}".encode())
            new.lines += 1
        return new


class Conversation:
    """Counts of a conversation's faults, its turns since the last whole span, and the prefixes before them."""

    def __init__(self, key: int | None):
        self.key, self.counts = key, {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
        self.first = self.last = self.before = None
        self.distinct = 0
        self.prefixes: dict[int, Prefix] = {0: Prefix()}
        self.turns: list[tuple[str, str]] = []
        self.symbols: list[str] = []
        self.chars = 0

    def add(self, turn: int | None, role: str, text: str, symbol: str, fault: str | None) -> None:
        if turn is not None:
            self.first = turn if self.first is None else self.first
            self.distinct += turn != self.last
            self.last = turn
        if fault:
            self.counts[fault] += 1
        if self.before is not None:
            self.counts["illegal"] += self.before + role[:1] not in ("su", "ua", "au")
        self.before = role[:1]
        if len(self.turns) >= SPAN or self.chars >= SPAN_CHARS:
            self.advance(STATES)
        self.turns.append((role, text))
        self.symbols.append(symbol)
        self.chars += len(role) + len(text)

    def advance(self, states) -> None:
        """Take the held turns into the cheapest prefixes that end in these states."""
        cell, made = parse("".join(self.symbols)), {}
        for j in states:
            ways = [(p.cost + f[0], p.audit + f[1], i) for i, p in self.prefixes.items() if (f := cell[i][j]) is not None]
            if ways:
                made[j] = min(ways)
        if states == ACCEPTING:
            best = min(made, key=lambda j: made[j])
            made = {best: made[best]}
        self.prefixes = {j: self.prefixes[i].after(cell[i][j], self.turns, i) for j, (_, _, i) in made.items()}
        self.turns, self.symbols, self.chars = [], [], 0

    def result(self) -> tuple:
        if self.turns:
            self.advance(ACCEPTING)
        (end,) = self.prefixes.values()
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.distinct
        return (self.key, gaps, *self.counts.values(), end.cost, end.audit, end.digest.hexdigest())


def _text(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(" "))


def in_order(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, alive, fault, symbol), conversation by conversation, in order, by one shuffle.

    A turn's first fault is blank, duplicate (of an earlier turn's role and text) or truncated.
    """
    alive = F.col("alive") if "alive" in turns.columns else F.lit(True)
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), _text("role").alias("role"), _text("text").alias("text"), alive.alias("alive"))
    same = Window.partitionBy("conv_id", "alive", "role", "text").orderBy("turn")
    blank = F.regexp_replace("text", SPACES, "") == ""
    last = F.substring(F.rtrim(F.col("text"), F.lit(" \t\n\x0b\x0c\r")), -1, 1)
    rows = rows.repartition("conv_id").withColumn("_n", F.row_number().over(same))
    rows = rows.withColumn("fault", F.when(blank, "blank").when(F.col("_n") > 1, "duplicate").when(~last.isin(".", "!", "?"), "truncated"))
    initial = F.when(F.substring("role", 1, 1).isin("s", "u", "a"), F.substring("role", 1, 1)).otherwise("x")
    symbol = F.when(F.col("fault").isin("blank", "duplicate"), "d").when(F.col("fault") == "truncated", F.upper(initial)).otherwise(initial)
    return rows.withColumn("symbol", symbol).sortWithinPartitions("conv_id", "turn", "role", "text", "_n").drop("_n")


def repair(turns: DataFrame) -> DataFrame:
    """One row per conversation of turns (conv_id, turn, role, text, perhaps alive): RESULT."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, out = None, []
        for b in batches:
            for key, turn, role, text, alive, fault, symbol in zip(*(c.to_pylist() for c in b.columns)):
                if held is None or held.key != key:
                    if held is not None:
                        out.append(held.result())
                    held = Conversation(key)
                if alive:
                    held.add(turn, role, text, symbol, fault)
            if out:
                yield _batch(out)
                out = []
        if held is not None:
            yield _batch([*out, held.result()])

    return in_order(turns).mapInArrow(run, RESULT)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [c.split()[0] for c in RESULT.split(", ")]
    kinds = [pa.int64()] * 7 + [pa.string()] * 2
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def repaired_turns(turns: DataFrame, plans: DataFrame) -> DataFrame:
    """The turns that repair()'s audits (conv_id, audit) leave or make, with position from 0 and edit: REPAIRED.

    A conversation's audit comes before its turns in one sorted stream, so no task holds a conversation's texts.
    """
    rows = in_order(turns).where("alive").select("conv_id", F.lit(1).alias("kind"), "turn", "role", "text")
    both = plans.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text")).unionByName(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, audit, at, state, place = None, "", 0, 0, 0
        for b in batches:
            out = []

            def put(edit: str, role: str, text: str) -> None:
                nonlocal state, place
                role = role if edit == "K" else EXPECTED[state]
                state = STEP[state, role[:1]]
                out.append((key, place, edit, role, text))
                place += 1

            for own, kind, _, role, text in zip(*(c.to_pylist() for c in b.columns)):
                if kind == 0:
                    key, audit, at, state, place = own, text, 0, 0, 0
                else:
                    if audit[at] != "D":
                        put(audit[at], role, text)
                    at += 1
                while at < len(audit) and audit[at] == "I":
                    put("I", "", "")
                    at += 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()))],
                    names=["conv_id", "position", "edit", "role", "text"])

    return both.repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "role", "text").mapInArrow(run, REPAIRED)


def damage(turns: DataFrame) -> DataFrame:
    """turns with faults by the CRC-32 of `conv_id:turn` modulo 20: 0 drops, 1 empties, 2 takes [.!?] out, 3 repeats, 4 makes it the user's."""
    code = F.crc32(F.concat(_text("conv_id"), F.lit(":"), _text("turn")).cast("binary")) % 20
    rows = turns.select("conv_id", "turn", _text("role").alias("role"), _text("text").alias("text"), code.alias("_c"))
    rows = rows.withColumn("_copies", F.explode(F.array_repeat(F.lit(0), F.when(F.col("_c") == 3, 2).otherwise(1))))
    text = F.when(F.col("_c") == 1, "").when(F.col("_c") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", F.when(F.col("_c") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("_c") != 0).alias("alive"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(damage(read_table(spark, sf_dir, "conversations")))
