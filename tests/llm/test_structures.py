"""Fingerprints, repaired conversations and transformed texts against brute force."""

import functools
import hashlib
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lotwise.llm import conversation_repair as repair
from lotwise.llm import fill_in_middle as fim
from lotwise.llm import simhash
from lotwise.llm.common import Scratch

# ---- fingerprints ----------------------------------------------------------------------------------------------------


def slow_fingerprint(text):
    """Votes bit by bit, over the terms' hashes as numbers."""
    counts = {}
    for a, b in simhash.term_hashes(text).tolist():
        counts[(a << 64) | b] = counts.get((a << 64) | b, 0) + 1
    out = 0
    for k in range(simhash.BITS):
        votes = sum((1 if h >> (127 - k) & 1 else -1) * n.bit_length() for h, n in counts.items())
        out = out << 1 | (votes > 0)
    return f"{out:032x}"


TEXTS = [None, "", " \n", "one", "one  two three\nfour", "a b c d e f g h " * 40, "é😀 ü ñ " * 9, "x" * 5000, "dup dup dup dup dup dup dup", "same text here for all of us", "same text here for all of us",
    " ".join(f"w{k % 97}" for k in range(3000))]


def test_fingerprints_of_texts():
    for t in TEXTS:
        assert simhash.fingerprint(t) == slow_fingerprint(t)
    rng = random.Random(4)
    words = [f"w{rng.randrange(5000)}" for _ in range(600)]
    base, half, none = " ".join(words), " ".join(words[:300] + [f"v{k}" for k in range(300)]), " ".join(f"u{k}" for k in range(600))
    a, b, c = map(simhash.fingerprint, (base, half, none))
    assert simhash.likeness(a, a) == 1 and 0.25 < simhash.likeness(a, b) < 0.75 and simhash.likeness(a, c) < 0.3


@pytest.mark.parametrize("ids", [list(range(len(TEXTS))), [None, None, 3, 3, 3, *range(10, 17)]])
def test_texts_and_the_next(spark, ids):
    rows = list(zip(ids, TEXTS))
    docs = spark.createDataFrame([(k, t, "clash", 1.0) for k, t in rows], "doc_id long, text string, fingerprint string, near_next double").repartition(5)
    got = simhash.with_edits(docs, Scratch(spark, "test")).collect()
    assert len(got) == len(rows)
    if len(set(ids)) == len(ids):
        for k, (key, text) in enumerate(rows):
            text, after = text or "", rows[(k + 1) % len(rows)][1] or ""
            new = text[: len(text) - len(text) // 2] + after[: len(text) // 2]
            (r,) = [r for r in got if r.doc_id == key]
            own, made, other = map(simhash.fingerprint, (text, new, after))
            assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (len(text), hashlib.sha256(new.encode()).hexdigest(), own, made)
            assert (r.near_edited, r.near_next) == (simhash.likeness(own, made), simhash.likeness(own, other))
    assert sorted(r.fingerprint for r in got) == sorted(map(simhash.fingerprint, TEXTS))
    assert simhash.with_edits(docs.limit(0), Scratch(spark, "test")).count() == 0


@pytest.mark.parametrize("radius,n", [(3, 400), (6, 300)])
def test_fingerprints_within_a_radius(spark, radius, n):
    """Groups around centres, and chains; cells are small, so that large buckets take many of them."""
    rng = random.Random(radius)
    prints = set()
    for _ in range(6):
        centre = rng.getrandbits(128)
        for _ in range(n // 8):
            flip = centre
            for k in rng.sample(range(128), rng.randrange(radius + 2)):
                flip ^= 1 << k
            prints.add(flip)
    prints |= {rng.getrandbits(128) for _ in range(n // 4)}
    names = sorted(f"{p:032x}" for p in prints)
    near = {a: {b for b in names if a != b and simhash.distance(a, b) <= radius} for a in names}
    least = {a: a for a in names}
    for _ in names:
        least = {a: min([least[a], *(least[b] for b in near[a])]) for a in names}
    df = spark.createDataFrame([(a,) for a in names], "fingerprint string")
    got = {r.fingerprint: (r.n_near, r.near_class) for r in simhash.near_fingerprints(df, Scratch(spark, "test"), radius, cell=8).collect()}
    assert got == {a: (len(b), least[a]) for a, b in near.items() if b} and len(got) > 100


def test_tables_miss_nothing():
    rng = np.random.default_rng(1)
    for n, radius in ((100, 3), (10**6, 6), (10**9, 6), (10**10, 3)):
        tables = simhash.Tables(n, radius)
        for _ in range(500):
            differ = np.zeros(128, np.uint8)
            differ[rng.choice(128, radius, replace=False)] = 1
            x = np.packbits(differ).view(">u8").astype(np.uint64)[None]
            assert tables.first(x)[0] < len(tables.chosen)
        assert tables.masks.shape == (len(tables.chosen), 2)


def test_no_fingerprints_are_near(spark):
    empty = spark.createDataFrame([], "fingerprint string")
    assert simhash.near_fingerprints(empty, Scratch(spark, "test")).count() == 0


# ---- conversations ---------------------------------------------------------------------------------------------------


def cheapest(symbols):
    """Least (cost, audit) over all edits, insertions before each turn and at the end up to two in a row."""
    best = None
    def walk(k, state, cost, audit, inserted):
        nonlocal best
        if best is not None and cost > best[0]:
            return
        if k == len(symbols) and state in (0, 3) and (best is None or (cost, audit) < best):
            best = cost, audit
        if inserted < 2:
            walk(k, repair.STEP[state, repair.EXPECTED[state][0]], cost + 5, audit + "I", inserted + 1)
        if k == len(symbols):
            return
        s = symbols[k]
        walk(k + 1, state, cost + 2, audit + "D", 0)
        if s != "d":
            extra = 5 if s.isupper() else 0
            if (state, s.lower()) in repair.STEP:
                walk(k + 1, repair.STEP[state, s.lower()], cost + extra, audit + "K", 0)
            walk(k + 1, repair.STEP[state, repair.EXPECTED[state][0]], cost + 1 + extra, audit + "R", 0)
    walk(0, 0, 0, "", 0)
    return best


@functools.lru_cache(maxsize=None)
def every_split(symbols):
    """A cell by all splits of its span, as CYK does it."""
    if len(symbols) == 1:
        return repair.leaf(symbols)
    cells = [repair.combine(every_split(symbols[:k]), every_split(symbols[k:])) for k in range(1, len(symbols))]
    return tuple(tuple(repair._least(*(c[i][j] for c in cells)) for j in repair.STATES) for i in repair.STATES)


def test_cells():
    rng = random.Random(7)
    spans = ["".join(s) for n in (1, 2, 3) for s in itertools.product("suaxUd", repeat=n)] + ["".join(rng.choice("suaxSUAXd") for _ in range(rng.randrange(4, 8))) for _ in range(150)]
    for s in spans:
        cell = repair.parse(s)
        assert cell == every_split(s)
        assert min(cell[0][0], cell[0][3]) == cheapest(s) if cell[0][3] else cell[0][0] == cheapest(s)


def slow_repair(rows):
    """Result of one conversation's rows (turn, role, text), in order."""
    seen, symbols, faults = set(), "", []
    for _, role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
        seen.add((role, text))
        initial = role[:1] if role[:1] in ("s", "u", "a") else "x"
        symbols += "d" if fault in ("blank", "duplicate") else initial.upper() if fault else initial
        faults.append(fault)
    cost, audit = min(c for c in (repair.parse(symbols)[0][0], repair.parse(symbols)[0][3]) if c) if rows else (0, "")
    lines = [f"{role}:{text}" for _, role, text in repair.replay(audit, [(r, t) for _, r, t in rows], 0)]
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()), lines


@pytest.mark.parametrize("span", [3, 4096])
def test_repair(spark, monkeypatch, span):
    monkeypatch.setattr(repair, "SPAN", span)
    rng = random.Random(span)
    rows = [(c, rng.choice([None, *range(9)]), rng.choice(["user", "assistant", "system", "tool", " ", ""]), rng.choice(["Yes.", "No", " ", "", "Why?", "é.\n", "So! \x85", f"n{rng.random()}."])) for c in (None, *range(60)) for _ in range(rng.randrange(1, 14))]
    rows += [(99, k, "user" if k % 2 else "assistant", "Long.") for k in range(300)] + [(98, 1, "user", "gone.")]
    df = spark.createDataFrame([(*r, r[0] != 98, "clash", 1) for r in rows], "conv_id long, turn long, role string, text string, alive boolean, audit string, cost int")
    got = {r.conv_id: tuple(r)[1:] for r in repair.repair(df).collect()}
    groups = {}
    for c, turn, role, text in rows:
        groups.setdefault(c, []).append((turn, role, text))
    want = {c: slow_repair(sorted(g if c != 98 else [], key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))) for c, g in groups.items()}
    assert got == {c: w[0] for c, w in want.items()}
    plans = repair.repair(df).select("conv_id", "audit")
    lines = {}
    for r in repair.repaired_turns(df, plans).orderBy("position").collect():
        lines.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    assert lines == {c: w[1] for c, w in want.items() if w[1]}
    assert repair.repair(df.limit(0)).count() == 0


def test_damage(spark):
    import zlib

    rows = [(c, t, r, x) for c in (None, 0, 7) for t in (None, *range(40)) for r, x in ((None, "A. b! c"), ("assistant", None))]
    got = sorted(map(tuple, repair.damage(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()), key=repr)
    want = []
    for c, t, r, x in rows:
        r, x = " " if r is None else r, " " if x is None else x
        code = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        x = "" if code == 1 else x.translate({ord(k): None for k in ".!?"}) if code == 2 else x
        want += [(c, t, "user" if code == 4 else r, x, code != 0)] * (2 if code == 3 else 1)
    assert got == sorted(want, key=repr)


# ---- fill in the middle ----------------------------------------------------------------------------------------------

LINES = [None, "", "\n", "one line", "a\nb\nc", "a\n\n\nb\n", "é😀\n" * 500, "x" * 70_000, "has <S> inside\nand more", "<", "<<P\n" * 3, "long\n" * 40_000, "dup\n", "dup\n", "a<\nS>b<\nM>"]


def slow_middle(key, text):
    text = text or ""
    units = text.splitlines(keepends=True) if "\r" not in text else None
    n = len(units)
    h = hashlib.sha256(f"7:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, _, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")):
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 50 else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


@pytest.mark.parametrize("frame_chars", [7, fim.FRAME_CHARS])
def test_fill_in_middle(spark, frame_chars):
    rows = [(k, t) for k, t in enumerate(LINES) if frame_chars > 7 or len(t or "") < 5000] + [(k + 100, t) for k, t in enumerate(LINES[:12]) if len(t or "") < 5000] + [(None, "a\nb\n")]
    df = spark.createDataFrame([(*r, b"x", 1, "y") for r in rows], "doc_id long, text string, frames binary, n int, form string")
    made = fim.transform(fim.pack(df, frame_chars=frame_chars))
    want = {k: (slow_middle(k, t), t or "") for k, t in rows}
    for r in fim.output_texts(made).collect():
        assert ((r.n, r.form, r.prefix_chars, r.middle_chars, r.output_text), r.restored_text) == want[r.doc_id]
    for r in fim.digests(made).collect():
        (*_, output), text = want[r.doc_id]
        assert (r.output_sha256, r.restored_sha256) == tuple(hashlib.sha256(x.encode()).hexdigest() for x in (output, text))
    assert fim.digests(fim.transform(fim.pack(df.limit(0)))).count() == 0


def test_frames_are_seekable():
    import zstandard

    text = "".join(f"line {k} é\n" for k in range(9000)) + "end"
    frames = fim.Frames(fim.pack_text(text, 1000))
    units = text.splitlines(keepends=True)
    assert frames.n_units == len(units) and frames.n_chars == len(text)
    for u in (0, 1, 77, 4000, len(units) - 1, len(units)):
        frames.opened = 0
        assert frames.unit_end(u) == len("".join(units[:u])) and frames.opened <= 1
    frames.opened = 0
    assert b"".join(frames.read(5000, 5100)).decode() == text[5000:5100] and frames.opened <= 2
    assert frames.find("line 4321 ") == text.index("line 4321 ")
    # Any reader of zstandard frames reads the whole, since the index is a frame to skip.
    reader = zstandard.ZstdDecompressor().stream_reader(fim.pack_text(text, 1000), read_across_frames=True)
    assert reader.read().decode() == text
